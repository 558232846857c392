"""Integrity rules of the stored tables: what must hold of each row, of each key, and between tables.

Rules of rows are counted by ``DataFrame.observe`` while a candidate of a table's next version is written, so they cost no
scan. Rules of keys are grouped counts over the key columns of what was written. A candidate that breaks a rule is
never handed on. As in SQL, a rule that comes to null holds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.held import shared_folder

# What columns of states may hold.
PACK_STATUS = ("draft", "canary", "active", "retired", "rejected")
RUN_STATUS = ("running", "ok", "degraded", "failed")
RUN_TRIGGER = ("schedule", "manual", "canary", "replay")
SEVERITY = ("info", "warn", "critical")
FETCHERS = ("httpx", "playwright")


def _among(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


@dataclass(frozen=True)
class Unique:
    """At most one row for each value of ``keys`` among those where ``among`` holds; nulls are values like any other."""

    name: str
    keys: tuple[str, ...]
    among: str = "true"


@dataclass(frozen=True)
class Rules:
    """SQL conditions of rows by name, columns that may not be null, and unique keys."""

    rows: dict[str, str]
    needed: tuple[str, ...]
    unique: tuple[Unique, ...] = ()


TABLES = {
    "site_pack": Rules(
        {
            "version_positive": "version >= 1",
            "parent_before_self": "parent_version IS NULL OR parent_version < version",
            "spec_domain_matches": "get_json_object(spec, '$.domain') = domain",
            "created_by_namespaced": "created_by RLIKE '^(human|healer):.+'",
            "active_needs_activation": "status <> 'active' OR activated_at IS NOT NULL",
            "status_known": _among("status", PACK_STATUS),
        },
        ("domain", "entity", "version", "status", "spec", "created_by"),
        (Unique("one_version", ("domain", "entity", "version")), Unique("one_active", ("domain", "entity"), "status = 'active'"), Unique("one_canary", ("domain", "entity"), "status = 'canary'")),
    ),
    "run": Rules(
        {
            "finished_after_started": "finished_at IS NULL OR finished_at >= started_at",
            "terminal_needs_finished": "status = 'running' OR finished_at IS NOT NULL",
            "pages_nonneg": "pages_fetched >= 0",
            "rows_nonneg": "rows_extracted >= 0",
            "status_known": _among("status", RUN_STATUS),
            "trigger_known": _among("trigger", RUN_TRIGGER),
        },
        ("run_id", "pack_id", "trigger", "status", "started_at"),
        (Unique("one_run", ("run_id",)),),
    ),
    "snapshot": Rules(
        {
            "http_status_range": "http_status BETWEEN 100 AND 599",
            "byte_size_nonneg": "byte_size >= 0",
            "content_hash_sha256": "content_hash RLIKE '^[0-9a-f]{64}$'",
            "fetcher_known": _among("fetcher", FETCHERS),
            "golden_needs_label": "NOT is_golden OR golden_label IS NOT NULL",
        },
        ("snapshot_id", "url", "fetched_at", "http_status", "content_hash", "byte_size", "blob_key", "fetcher"),
        (Unique("one_snapshot", ("snapshot_id",)),),
    ),
    "blob": Rules({"content_hash_of_body": "content_hash = sha2(body, 256)"}, ("content_hash", "body"), (Unique("one_blob", ("content_hash",)),)),
    "record": Rules(
        {"valid_interval": "valid_to IS NULL OR valid_to > valid_from", "payload_hash_sha256": "payload_hash RLIKE '^[0-9a-f]{64}$'"},
        ("entity", "natural_key", "snapshot_id", "pack_id", "valid_from", "payload_hash"),
        (Unique("one_open_row", ("entity", "natural_key"), "valid_to IS NULL"),),
    ),
    "incident": Rules(
        {"closure_needs_resolution": "(closed_at IS NULL) = (resolution IS NULL)", "closed_after_opened": "closed_at IS NULL OR closed_at >= opened_at", "severity_known": _among("severity", SEVERITY)},
        ("pack_id", "kind", "severity", "opened_at"),
        (Unique("one_open_incident", ("pack_id", "kind", "field"), "closed_at IS NULL"),),
    ),
}


class IntegrityError(ValueError):
    """A candidate that breaks rules: ``broken`` has how often each."""

    def __init__(self, table: str, broken: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{k} ({n})" for k, n in sorted(broken.items())))
        self.broken = broken


def row_counts(table: str) -> dict[str, Column]:
    """For each rule of a table's rows, and each column that may not be null, how many rows break it, as an aggregate."""
    rules = TABLES[table]
    out = {name: F.count_if(~F.expr(rule)) for name, rule in rules.rows.items()}
    return out | {f"{c}_needed": F.count_if(F.col(c).isNull()) for c in rules.needed}


def broken_keys(df: DataFrame, table: str) -> DataFrame:
    """(rule, n): for each unique key of a table how many values have more than one row, if any has."""
    out = []
    for u in TABLES[table].unique:
        several = df.filter(u.among).groupBy(*u.keys).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n"))
        out.append(several.select(F.lit(u.name).alias("rule"), "n"))
    return reduce(DataFrame.union, out).filter("n > 0")


@dataclass(frozen=True)
class Written:
    """A candidate as it was written, its path, and how often it breaks each rule; those that hold are left out."""

    rows: DataFrame
    path: str
    broken: dict[str, int]


def written(df: DataFrame, table: str, path: str | None = None) -> Written:
    """Writes a candidate of a table's next version as Parquet and counts what breaks its rules on the way.

    An empty table breaks none. Further columns are written as they are.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/{table}-{uuid.uuid4().hex}"
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    counts = row_counts(table)
    df.observe(seen, *[c.alias(name) for name, c in counts.items()]).write.parquet(path)
    rows = spark.read.schema(df.schema).parquet(path)
    broken = {name: n for name, n in seen.get.items() if n}
    return Written(rows, path, broken | {r.rule: r.n for r in broken_keys(rows, table).collect()})  # a row for each rule


def checked(df: DataFrame, table: str, path: str | None = None) -> DataFrame:
    """The rows of ``written``; an error if a rule is broken."""
    done = written(df, table, path)
    if done.broken:
        raise IntegrityError(table, done.broken)
    return done.rows


def interval_breaks(records: DataFrame, keys: list[str], begin: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(keys, at, kind) where the intervals of a key leave a ``gap`` or ``overlap``; a null end is open.

    The interval that begins at ``at`` begins after, or before, all of the key's earlier ones have ended. Null keys are
    a key. Beginnings count +1 and ends -1 at their time; a key whose intervals follow each other has one time
    above 0, its first. These sums are partial aggregates, so a key with very many rows is no large group, and only keys
    that have two such times, or intervals that begin together, are looked at in order.
    """
    times = records.select(*keys, F.col(begin).alias("_at"), F.lit(1).alias("_d")).union(records.filter(F.col(end).isNotNull()).select(*keys, end, F.lit(-1)))
    net = times.groupBy(*keys, "_at").agg(F.sum("_d").alias("_net"), F.count_if(F.col("_d") > 0).alias("_begin"))
    odd = net.groupBy(*keys).agg(F.count_if(F.col("_net") > 0).alias("_rises"), F.max("_begin").alias("_most")).filter("_rises > 1 or _most > 1").select(*keys)
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    rows = records.select(*keys, F.col(begin).alias("_b"), F.col(end).alias("_e")).alias("r").join(odd.alias("o"), same, "left_semi")
    order = Window.partitionBy(*keys).orderBy("_b", F.col("_e").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"_latest": F.max("_e").over(before), "_open": F.coalesce(F.max(F.col("_e").isNull()).over(before), F.lit(False))})
    kind = F.when(F.col("_open") | (F.col("_b") < F.col("_latest")), "overlap").when(F.col("_b") > F.col("_latest"), "gap")
    return rows.select(*keys, F.col("_b").alias("at"), kind.alias("kind")).filter("kind is not null")


def provenance(records: DataFrame, snapshots: DataFrame, packs: DataFrame) -> DataFrame:
    """(reference, records, missing, orphans, ambiguous, unused): whether each record leads to one snapshot and one pack.

    ``records`` (snapshot_id, pack_id), ``snapshots`` (snapshot_id), ``packs`` (pack_id). Records without a reference are ``missing``, those
    whose reference is not there ``orphans``, and those that would be joined with several rows ``ambiguous``; ``unused`` counts rows
    that no record leads to. All three tables are tagged and grouped by key in one shuffle, with partial sums, so a
    snapshot of very many records is no large group.
    """
    tag = lambda df, what, key, mine: df.select(F.lit(what).alias("reference"), F.col(key).cast("string").alias("key"), F.lit(mine).alias("r"), F.lit(1 - mine).alias("t"))
    both = F.inline(F.array(*[F.struct(F.lit(what).alias("reference"), F.col(key).cast("string").alias("key"), F.lit(1).alias("r"), F.lit(0).alias("t")) for what, key in (("snapshot", "snapshot_id"), ("pack", "pack_id"))]))
    rows = records.select(both).union(tag(snapshots, "snapshot", "snapshot_id", 0)).union(tag(packs, "pack", "pack_id", 0))
    each = rows.groupBy("reference", "key").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    named = F.col("key").isNotNull()
    total = lambda condition, what: F.coalesce(F.sum(F.when(condition, F.col(what))), F.lit(0))
    return each.groupBy("reference").agg(
        F.sum("r").alias("records"), total(~named, "r").alias("missing"), total(named & (F.col("t") == 0), "r").alias("orphans"), total(named & (F.col("t") > 1), "r").alias("ambiguous"), total((F.col("r") == 0) | ~named, "t").alias("unused"),
    )
