"""From a run's circumstances and signals to its verdict, outcome and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The incident that a signal or a verdict makes, and how grave it is.
INCIDENT = {
    "fill_rate_below_declared": "fill_rate_drop",
    "fill_rate_drop_vs_median": "fill_rate_drop",
    "row_count_anomaly": "row_count_anomaly",
    "range_violation": "range_violation",
    "enum_violation": "enum_violation",
    "natural_key_missing": "natural_key_broken",
    "duplicate_rate": "duplicate_rate_anomaly",
    "unreachable": "unreachable",
    "blocked": "blocked",
    "rate_limited": "rate_limited",
    "soft_404": "unreachable",
    "quota_exhausted": "healer_exhausted",
}
SEVERITY = {
    "fill_rate_drop": "warn",
    "row_count_anomaly": "info",
    "range_violation": "warn",
    "enum_violation": "warn",
    "natural_key_broken": "critical",
    "duplicate_rate_anomaly": "warn",
    "unreachable": "warn",
    "blocked": "warn",
    "rate_limited": "warn",
    "healer_exhausted": "critical",
}
ESCALATE_ONLY = ("enum_violation", "natural_key_broken")


def _literal(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def precheck_verdict(unreachable: Column, blocked: Column, rate_limited: Column, soft_404: Column, auto_versions: Column, most: int) -> Column:
    """The first that holds; versions made on their own count against a quota that 0 always exhausts."""
    return F.when(unreachable, "unreachable").when(blocked, "blocked").when(rate_limited, "rate_limited").when(soft_404, "soft_404").when(auto_versions >= most, "quota_exhausted").otherwise("ok")


def throttled(pages: Column, n429: Column, n403: Column) -> Column:
    """Whether more than half of a run's pages were refused."""
    return (pages > 0) & (2 * (n429 + n403) > pages)


def final_status(error: Column, verdict: Column, partial: Column, rows: Column, least: int) -> Column:
    return F.when(error, "failed").when((verdict != "ok") | partial, "degraded").when(rows < least, "failed").otherwise("ok")


def incidents_of(signals: DataFrame) -> DataFrame:
    """``signals`` with the kind and severity of their incidents."""
    out = signals.withColumn("kind", _literal(F.col("trigger"), INCIDENT))
    return out.withColumn("severity", _literal(F.col("kind"), SEVERITY))


def classify(runs: DataFrame, signals: DataFrame, run: str, can_heal: bool = False) -> DataFrame:
    """(run, outcome, kinds) for each row of ``runs`` (run, verdict); ``kinds`` are the incidents', each where it is first seen.

    ``seq`` of the signals tells their order; without it they stand in the order in which triggers are checked.

    A verdict other than ok forces no_action with its own incident, but a missing natural key escalates beside
    it. Otherwise no signal, or only a row count anomaly, is no_action; the rest escalates, unless all of it can
    be healed.
    """
    place = F.col("seq") if "seq" in signals.columns else F.array_position(F.array(*[F.lit(t) for t in INCIDENT]), F.col("trigger"))
    # a row for each kind of a run, of which there are a few
    kinds = incidents_of(signals).groupBy(run, "kind").agg(F.min(place).alias("at")).groupBy(run).agg(F.array_sort(F.collect_list(F.struct("at", "kind"))).alias("at"))
    kinds = kinds.select(run, F.transform("at", lambda x: x["kind"]).alias("found"))
    j = runs.join(kinds, run, "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    ok, broken = F.col("verdict") == "ok", F.array_contains("found", "natural_key_broken")
    grave = F.array_remove("found", "row_count_anomaly")
    heals = F.lit(can_heal) & ~F.arrays_overlap(grave, F.array(*[F.lit(k) for k in ESCALATE_ONLY]))
    own = F.array(_literal(F.col("verdict"), {k: v for k, v in INCIDENT.items()}))
    outcome = F.when(~ok, F.when(broken, "escalated").otherwise("no_action")).when(F.size(grave) == 0, "no_action").when(heals, "auto_healed").otherwise("escalated")
    listed = F.when(ok, F.col("found")).when(broken, F.concat(own, F.array(F.lit("natural_key_broken")))).otherwise(own)
    return j.select(run, outcome.alias("outcome"), F.array_join(listed, ",").alias("kinds"))
