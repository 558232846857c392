"""Next versions of the smaller tables: incidents, packs, snapshots, blobs; and the gold view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.functions.scalars import blob_key

INCIDENT_KEY = ["pack_id", "kind", "field"]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert_incidents(open_incidents: DataFrame, reports: DataFrame) -> DataFrame:
    """The open incidents after ``reports`` (pack_id, kind, field, seq, run_id, severity, evidence).

    Null fields are one field. A key's reports count as occurrences; run and severity are those of the last, and
    evidence is overlaid in their order: a later value of a name replaces an earlier one.
    """
    # one row for each name that evidence has, its last value; then back to maps: groups stay small
    named = reports.select(*INCIDENT_KEY, "seq", F.explode("evidence").alias("name", "value"))
    named = named.groupBy(*INCIDENT_KEY, "name").agg(F.max_by("value", "seq").alias("value")).groupBy(*INCIDENT_KEY).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("evidence"))
    last = reports.groupBy(*INCIDENT_KEY).agg(F.max_by("run_id", "seq").alias("run_id"), F.max_by("severity", "seq").alias("severity"), F.count(F.lit(1)).alias("occurrences"))
    none = F.create_map().cast("map<string,string>")
    new = last.alias("l").join(named.alias("e"), _same(last, named, INCIDENT_KEY), "left").select(*[F.col(f"l.{c}") for c in last.columns], F.coalesce("e.evidence", none).alias("evidence"))
    o, n = open_incidents.alias("o"), new.alias("n")
    j = o.join(n, reduce(lambda x, y: x & y, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in INCIDENT_KEY]), "full_outer")
    is_new = F.col("n.occurrences").isNotNull()
    old = F.coalesce("o.evidence", none)
    overlaid = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.coalesce("n.evidence", none), k)), F.coalesce("n.evidence", none))
    keys = [F.when(is_new, F.col(f"n.{k}")).otherwise(F.col(f"o.{k}")).alias(k) for k in INCIDENT_KEY]
    rest = [F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("run_id", "severity")]
    return j.select(*keys, *rest, (F.coalesce("o.occurrences", F.lit(0)) + F.coalesce("n.occurrences", F.lit(0))).alias("occurrences"), overlaid.alias("evidence"))


def pack_versions(specs: DataFrame, keys: list[str], seq: str, spec: str) -> DataFrame:
    """Specs as they were submitted, numbered: one equal to the one before it makes no version. Specs with one ``seq`` stand in their own order."""
    order = Window.partitionBy(*keys).orderBy(seq, spec)
    changed = specs.filter(F.col(spec).isNotNull()).withColumn("_before", F.lag(spec).over(order)).filter(~F.col(spec).eqNullSafe(F.col("_before"))).drop("_before")
    return changed.withColumn("version", F.row_number().over(order))


def activate(packs: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """``packs`` with the given version active and what was active before retired, in one projection."""
    chosen = F.col("version") == version
    there = F.max(chosen).over(Window.partitionBy(*keys))
    return packs.withColumn("status", F.when(chosen, "active").when((F.col("status") == "active") & there, "retired").otherwise(F.col("status")))


def active_pack(packs: DataFrame, domain: str, entity: str | None = None):
    """The one active pack of a domain; none or several are an error. The table is small: a row for each pack."""
    found = packs.filter((F.col("domain") == domain) & (F.col("status") == "active") & (F.lit(entity is None) | (F.col("entity") == entity))).take(2)
    if len(found) != 1:
        raise LookupError(f"{len(found) or 'no'} active packs for {domain}")
    return found[0]


def latest(rows: DataFrame, keys: list[str], at: str, columns: list[str]) -> DataFrame:
    """Of each key the row with the largest ``at``; ties go to the largest values of the other columns."""
    top = rows.groupBy(*keys).agg(F.max(F.struct(at, *columns)).alias("t"))
    return top.select(*keys, "t.*")


def unchanged_pages(responses: DataFrame, snapshots: DataFrame, current: DataFrame, active_pack_id: Column, trigger: str = "schedule") -> DataFrame:
    """``responses`` (url, http_status, content_hash) with ``unchanged``: the same content as the last snapshot, read by the active pack.

    ``snapshots`` (url, fetched_at, content_hash), ``current`` (url, pack_id). A 304 is unchanged content. Runs on
    trial always read anew.
    """
    last = latest(snapshots, ["url"], "fetched_at", ["content_hash"]).select("url", F.col("content_hash").alias("_last"))
    j = responses.join(last, "url", "left").join(current.select("url", F.col("pack_id").alias("_pack")), "url", "left")
    same = (F.col("http_status") == 304) | F.coalesce(F.col("content_hash") == F.col("_last"), F.lit(False))
    by_pack = F.coalesce(F.col("_pack") == active_pack_id, F.lit(False))
    return j.withColumn("unchanged", same & by_pack & F.lit(trigger not in ("canary", "replay"))).drop("_last", "_pack")


def snapshot_rows(responses: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows to add to the snapshots for ``responses`` (url, fetched_at, http_status, body, etag).

    A 304 repeats hash, key and validators of the last 200 with no bytes; without one it is left for an
    unconditional retry (``dangling``). Network failures (null status) make no row. A hash that was stored before
    keeps its first key.
    """
    good = latest(snapshots.filter("http_status = 200"), ["url"], "fetched_at", ["content_hash", "blob_key", "etag"])
    good = good.select("url", F.col("content_hash").alias("_hash"), F.col("blob_key").alias("_key"), F.col("etag").alias("_etag"))
    stored = snapshots.groupBy("content_hash").agg(F.min("blob_key").alias("_stored"))
    r = responses.filter("http_status is not null").join(good, "url", "left")
    again = F.col("http_status") == 304
    r = r.withColumn("content_hash", F.when(again, F.col("_hash")).otherwise(F.sha2(F.col("body").cast("binary"), 256)))
    r = r.join(stored, "content_hash", "left")
    key = F.when(again, F.col("_key")).otherwise(F.coalesce("_stored", blob_key(F.col("url"), F.col("fetched_at"), F.col("content_hash"))))
    return r.select(
        "url", "fetched_at", "http_status", "content_hash",
        key.alias("blob_key"),
        F.when(again, 0).otherwise(F.octet_length("body")).cast("long").alias("byte_size"),
        F.when(again, F.coalesce("etag", "_etag")).otherwise(F.col("etag")).alias("etag"),
        (again & F.col("_hash").isNull()).alias("dangling"),
    )


def new_blobs(bodies: DataFrame, blobs: DataFrame) -> DataFrame:
    """(content_hash, body) of bodies that are not stored yet, each once."""
    hashed = bodies.filter("body is not null").select(F.sha2(F.col("body").cast("binary"), 256).alias("content_hash"), "body")
    return hashed.dropDuplicates(["content_hash"]).join(blobs.select("content_hash"), "content_hash", "left_anti")


def index_diff(committed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of two tables (path, digest): added, removed or changed."""
    j = committed.select("path", F.col("digest").alias("a")).join(now.select("path", F.col("digest").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    return j.filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", change.alias("change"))


def quarantined(quality: Column) -> Column:
    """Whether a row's quality document names violations: the key counts, even with null or an empty list."""
    return F.coalesce(F.array_contains(F.json_object_keys(quality), "violations"), F.lit(False))


def safe_number(text: Column, kind: str) -> Column:
    """A number if a text is plainly one, else null. A plain cast would take exponents and blanks too."""
    pattern = r"^-?[0-9]+$" if kind in ("int", "bigint") else r"^-?[0-9]+(\.[0-9]+)?$"
    return F.when(text.rlike(pattern), text.try_cast(kind))


def gold(records: DataFrame, packs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Open, unquarantined records with their pack's domain and version, and typed fields of their payload (JSON).

    ``records`` (pack_id, natural_key, payload, quality, valid_from, valid_to), ``packs`` (pack_id, domain, version).
    """
    typed = [(F.get_json_object("payload", f"$.{n}") if k == "string" else safe_number(F.get_json_object("payload", f"$.{n}"), k)).alias(n) for n, k in fields.items()]
    shown = records.filter(F.col("valid_to").isNull() & ~quarantined(F.col("quality")))
    return shown.join(packs.select("pack_id", "domain", "version"), "pack_id").select("domain", "version", "natural_key", *typed, "valid_from")
