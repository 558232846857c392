"""One run of a pack over a table of responses, as one plan: from pages to records, profile and verdict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.functions import markup, scalars
from provenant.held import held
from provenant.operators import classify, detect, extract, quality, registry, scd2, validate
from provenant.sources.packs import Pack


@dataclass(frozen=True)
class Run:
    pages: DataFrame
    rows: DataFrame
    applied: scd2.Applied | None
    profile: DataFrame
    signals: DataFrame
    status: str
    verdict: str


def asks(pack: Pack) -> dict[str, markup.Ask]:
    """What the pack's sources ask of a page, in their order: rows, or the scripts that rows are made of."""
    out: dict[str, markup.Ask] = {}
    for i, source in enumerate(pack.sources):
        if source["kind"] == "css":
            out[f"_source{i}"] = markup.Rows(_paths(source), source.get("row_selector"))
        elif source["kind"] == "jsonld":
            out[f"_source{i}"] = extract.LINKED
        elif source["kind"] == "embedded_json":
            out[f"_source{i}"] = extract.script_ask(source.get("script_id"), source.get("var_name"))
        else:
            out |= registry.ask(source, f"_source{i}")
    return out


def _paths(source: dict) -> dict[str, str]:
    return {n: (w if isinstance(w, str) else w.get("selector") or w.get("path")) for n, w in source["fields"].items()}


def _rows(scanned: DataFrame, source: dict, name: str) -> DataFrame:
    """``scanned`` with the column of a source's answer replaced by its rows."""
    if source["kind"] == "jsonld":
        return scanned.withColumn(name, extract.linked_rows(F.col(name), source["type"], _paths(source)))
    if source["kind"] == "embedded_json":
        return scanned.withColumn(name, extract.script_rows(F.col(name), _paths(source), source.get("root", "$"), source.get("var_name")))
    return scanned


def extracted(scanned: DataFrame, pack: Pack, every: bool = False) -> DataFrame:
    """Rows of pages that were scanned for ``asks``: fields of the pack as raw texts, in the order of ``seq``; only a page's first row unless ``every``."""
    names = list(asks(pack))
    for name, source in zip(names, pack.sources, strict=True):
        scanned = _rows(scanned, source, name)
    keep = ["url", "seq"]
    rows = extract.one_row_each(scanned, names, keep, every)
    rows = extract.chain(rows, names, pack.transforms(), [*keep, "row_ix"])
    for name, (parts, transform) in pack.derived.items():
        rows = rows.withColumn(name, extract.derived([F.col(p) for p in parts], transform))
    money = [f.name for f in rows.schema.fields if f.dataType.typeName() == "struct"]
    return rows.withColumns({m: F.col(m)["amount"].cast("string") for m in money})


def run(pack: Pack, responses: DataFrame, current: DataFrame, at: Column) -> Run:
    """``responses`` (url, seq, http_status, html, unchanged) against the open records ``current``.

    Unchanged pages, and pages that are no success, are not parsed; each other page is, once, for signatures and all
    sources together. A block ends the run at its page and no record is written; the profile and the verdict are
    made all the same. Soft errors, failed pages and signals make a run degraded, too few rows make it failed.
    """
    todo = responses.filter(F.col("http_status").isin(200, 304) & ~F.col("unchanged"))
    found = extract.scanned(todo.select("url", "seq", "http_status", "html"), {"facts": detect.facts_ask(), **asks(pack)})
    seen = held(detect.detected(found).drop("html", "facts", "http_status"), "run-pages")
    stop = seen.filter("block is not null").agg(F.min("seq").alias("stop")).first().stop
    within = (lambda t: t) if stop is None else (lambda t: t.filter(F.col("seq") <= stop))
    pages = within(responses)
    good = within(seen).filter("block is null and soft_404 is null")
    checked = held(validate.validate(extracted(good, pack), pack.contract), "run-rows")
    fields = [f.name for f in pack.contract.fields]

    payload = scalars.json_safe({n: F.col(f"{n}_typed") for n in sorted(fields)}, {f.name: f.type for f in pack.contract.fields})
    key = scalars.encode_natural_key(*[F.col(k) for k in pack.contract.natural_key])
    incoming = checked.filter("accepted").select(F.lit(pack.entity).alias("entity"), key.alias("natural_key"), "seq", F.sha2(payload, 256).alias("payload_hash"), F.sha2("url", 256).alias("snapshot_id"))
    applied = scd2.apply(current, incoming, at) if stop is None else None

    # the rate of a field is over all pages that were not unchanged, also those that gave no row
    rows = pages.select("url", "unchanged").join(checked.filter("accepted").select("url", *[F.col(f"{n}_typed").alias(n) for n in fields]), "url", "left").withColumn("run", F.lit("run"))
    profile = quality.profile(rows, pack.contract, "run", "unchanged").drop("duplicates", "duplicate_rate", "natural_key_missing")
    lost = checked.agg(F.count_if(F.array_contains("reasons", "natural_key_missing")).alias("natural_key_missing"), F.count_if("accepted").alias("valid"), F.count_distinct(F.when(F.col("accepted"), key)).alias("distinct"))
    base = F.greatest(F.col("rows_considered") - F.col("rows_unchanged"), F.lit(0))
    profile = held(profile.crossJoin(F.broadcast(lost)).withColumn("duplicate_rate", F.when(base > 0, (F.col("valid") - F.col("distinct")) / base).otherwise(0.0)), "run-profile")  # one row each
    signals = quality.triggers(profile, pack.contract, "run")

    n = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("http_status") == 429).alias("n429"), F.count_if(F.col("http_status") == 403).alias("n403"), F.count_if(~F.col("http_status").isin(200, 304)).alias("failed"), F.count_if(F.col("http_status").isNotNull()).alias("answers"), F.count_if("unchanged").alias("unchanged")).first()
    soft = within(seen).filter("soft_404 is not null").count()
    valid = profile.first()["valid"] if n.pages else 0
    one = responses.sparkSession.range(1)
    verdict = one.select(classify.precheck_verdict(F.lit(n.pages > 0 and not n.answers), F.lit(stop is not None), classify.throttled(F.lit(n.pages), F.lit(n.n429), F.lit(n.n403)), F.lit(soft > 0 and not valid), F.lit(0), max(pack.contract.max_auto_versions, 1))).first()[0]
    # with nothing extracted and a good verdict, signals say nothing
    fired = bool(valid) and classify.incidents_of(signals).filter("severity <> 'info'").limit(1).count() > 0
    status = one.select(classify.final_status(F.lit(False), F.lit(verdict), F.lit(n.failed + soft > 0 or fired), F.lit(valid + n.unchanged), pack.contract.min_rows_per_run)).first()[0]
    return Run(pages, checked, applied, profile, signals, status, verdict)
