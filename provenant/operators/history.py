"""Runs and packs as tables: opening and closing runs, the history that counts, look-ups across records and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a run history for later ones, and who makes packs by himself.
STATUS = ("ok", "degraded")
TRIGGER = ("schedule", "manual")
HEALER = "healer:"


def open_runs(packs: DataFrame, run_id: Column, trigger: str, at: Column) -> DataFrame:
    """A running run for each active pack of ``packs`` (pack_id, status)."""
    active = packs.filter("status = 'active'")
    empty = F.lit(None).cast("string")
    return active.select(run_id.alias("run_id"), "pack_id", F.lit(trigger).alias("trigger"), F.lit("running").alias("status"), at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), empty.alias("error"), empty.alias("metrics"))


def close_runs(runs: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """``runs`` with the status, metrics and time of their ``results`` (run_id, status, error, metrics); others are as before.

    An error goes on a line of its own after those that a run has; a run can't end before it began.
    """
    r = results.select("run_id", F.col("status").alias("_status"), F.col("error").alias("_error"), F.col("metrics").alias("_metrics"), F.lit(True).alias("_closed"))
    j = runs.join(r, "run_id", "left")
    closed = F.col("_closed").isNotNull()
    error = F.when(F.col("_error").isNotNull(), F.concat_ws("\n", "error", "_error")).otherwise(F.col("error"))
    return j.select(
        *[c for c in runs.columns if c not in ("status", "finished_at", "error", "metrics")],
        F.when(closed, F.col("_status")).otherwise(F.col("status")).alias("status"),
        F.when(closed, F.greatest(at, F.col("started_at"))).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(closed, error).otherwise(F.col("error")).alias("error"),
        F.when(closed, F.col("_metrics")).otherwise(F.col("metrics")).alias("metrics"),
    )


def qualifying_runs(runs: DataFrame, packs: DataFrame, since: Column) -> DataFrame:
    """``runs`` (pack_id, started_at, status, trigger, ...) that count as history, with their pack's domain and entity.

    Whatever version of a pack made them, runs on trial, replays and failures don't count.
    """
    good = runs.filter((F.col("started_at") >= since) & F.col("status").isin(*STATUS) & F.col("trigger").isin(*TRIGGER))
    return good.join(packs.select("pack_id", "domain", "entity"), "pack_id")


def row_medians(qualifying: DataFrame, rows: str = "rows_extracted", least: int = 3) -> DataFrame:
    """(domain, entity, runs, median_rows, insufficient_baseline), medians rounded half to even; fewer than ``least`` runs have none."""
    out = qualifying.groupBy("domain", "entity").agg(F.count(F.lit(1)).alias("runs"), F.expr(f"bround(percentile_cont(0.5) WITHIN GROUP (ORDER BY {rows}), 0)").cast("bigint").alias("median_rows"))
    return out.withColumn("median_rows", F.when(F.col("runs") >= least, F.col("median_rows"))).withColumn("insufficient_baseline", F.col("runs") < least)


def rate_medians(qualifying: DataFrame, metrics: str = "metrics", least: int = 3) -> DataFrame:
    """(domain, entity, field, median) of the fill rates in the metrics (JSON) of each run; fewer than ``least`` runs, whether they have rates or not, have none."""
    enough = qualifying.groupBy("domain", "entity").agg(F.count(F.lit(1)).alias("_runs")).filter(F.col("_runs") >= least).select("domain", "entity")
    qualifying = qualifying.join(enough, ["domain", "entity"], "left_semi")
    rates = F.from_json(F.get_json_object(metrics, "$.quality.fill_rate"), "map<string,double>")
    each = qualifying.select("domain", "entity", F.explode(rates).alias("field", "rate"))
    return each.groupBy("domain", "entity", "field").agg(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY rate)").alias("median"))


def open_records_of(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Open ``records`` (entity, natural_key, pack_id, snapshot_id, valid_to) with the URL of their snapshot (snapshot_id, url)."""
    return records.filter(F.col("valid_to").isNull()).join(snapshots.select("snapshot_id", "url"), "snapshot_id")


def keys_of_urls(records: DataFrame, snapshots: DataFrame, urls: DataFrame) -> DataFrame:
    """(entity, natural_key), each once, of open records that were read from one of ``urls`` (url)."""
    return open_records_of(records, snapshots).join(urls.select("url"), "url", "left_semi").select("entity", "natural_key").distinct()


def pack_of_urls(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(entity, url, pack_id): a pack that made an open record of each URL, the smallest of several."""
    return open_records_of(records, snapshots).groupBy("entity", "url").agg(F.min("pack_id").alias("pack_id"))


def newest_version(packs: DataFrame) -> DataFrame:
    """Of ``packs`` (domain, entity, version, pack_id) the newest of each domain and entity."""
    return packs.groupBy("domain", "entity").agg(F.max(F.struct("version", "pack_id")).alias("t")).select("domain", "entity", "t.*")


def listed(packs: DataFrame, versions: bool = True) -> DataFrame:
    """``packs`` in the order of domain, entity and, if they have any, version."""
    return packs.orderBy("domain", "entity", *(["version"] if versions else []))


def window_days(window: str) -> int:
    """The days of a window such as "7d"; 7 for whatever isn't one."""
    found = re.fullmatch(r"\s*([+-]?\d+(?:_\d+)*)\s*d", window)
    return int(found[1]) if found else 7


def auto_versions(packs: DataFrame, window: str, now: Column) -> DataFrame:
    """(domain, entity, n): how many versions of ``packs`` (created_by, created_at) were made by a healer in the window before ``now``; 0 is shown."""
    made = F.col("created_by").startswith(HEALER) & (F.col("created_at") >= now - F.make_dt_interval(F.lit(window_days(window))))
    return packs.groupBy("domain", "entity").agg(F.count_if(made).alias("n"))


def blob_bodies(hashes: DataFrame, blobs: DataFrame) -> DataFrame:
    """(content_hash, body, intact) of ``hashes`` (content_hash): bodies of ``blobs`` (content_hash, body), and whether their digest is right; null without one."""
    found = hashes.select("content_hash").distinct().join(blobs, "content_hash", "left")
    return found.select("content_hash", "body", (F.sha2(F.col("body").cast("binary"), 256) == F.col("content_hash")).alias("intact"))


def golden_snapshots(golden: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Of ``golden`` (content_hash, ...) what is no golden row of ``snapshots`` (content_hash, is_golden) yet, each hash once, as golden rows of a replay."""
    have = snapshots.filter("is_golden").select("content_hash")
    return golden.dropDuplicates(["content_hash"]).join(have, "content_hash", "left_anti").withColumns({"is_golden": F.lit(True), "trigger": F.lit("replay")})


def metric_families(runs: DataFrame) -> DataFrame:
    """(run_id, name, label, value) of runs: rows extracted, duration in seconds, and pages by status (``pages``: a map)."""
    one = lambda name, label, value: F.struct(F.lit(name).alias("name"), label.cast("string").alias("label"), value.cast("double").alias("value"))
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    fixed = F.array(one("rows_extracted", F.lit(""), F.col("rows_extracted")), one("run_duration_seconds", F.lit(""), seconds))
    by_status = F.transform(F.map_entries("pages"), lambda e: F.struct(F.lit("pages").alias("name"), e["key"].cast("string").alias("label"), e["value"].cast("double").alias("value")))
    return runs.select("run_id", F.inline(F.concat(fixed, F.coalesce(by_status, F.array().cast("array<struct<name:string,label:string,value:double>>"))))).filter("value is not null")
