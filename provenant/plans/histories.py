"""Queries about runs and packs as tables: orders are runs, customers are packs of a nation and a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.operators import history
from provenant.plans.runs import table

_SINCE = "1996-01-01"
_LATE = "1998-07-15"


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packs: those of a nation and segment are its versions, some made by a healer."""
    c = table(spark, sf_dir, "customer")
    by = F.when(F.col("c_custkey") % 4 == 0, "healer:x").otherwise("team")
    at = F.lit("2024-01-31 00:00:00").cast("timestamp") - F.make_dt_interval((F.col("c_custkey") % 40).cast("int"))
    return c.select(F.col("c_custkey").alias("pack_id"), F.col("c_nationkey").alias("domain"), F.col("c_mktsegment").alias("entity"), F.col("c_custkey").alias("version"), by.alias("created_by"), at.alias("created_at"), F.when(F.col("c_custkey") % 3 == 0, "active").otherwise("draft").alias("status"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customer's pack."""
    k = F.col("o_orderkey")
    trigger = F.element_at(F.array(*[F.lit(t) for t in ("schedule", "manual", "canary", "replay")]), (k % 4 + 1).cast("int"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").otherwise("degraded")
    metrics = F.concat(F.lit('{"quality":{"fill_rate":{"a":'), (k % 8 / 8).cast("string"), F.lit(',"b":0.5}}}'))
    return table(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("pack_id"), trigger.alias("trigger"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"), F.col("o_totalprice").cast("int").alias("rows_extracted"), metrics.alias("metrics"))


def _qualifying(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.qualifying_runs(runs(spark, sf_dir), packs(spark, sf_dir), F.lit(_SINCE).cast("timestamp"))


def qualifying_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.row_medians(_qualifying(spark, sf_dir))


def qualifying_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.rate_medians(_qualifying(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of orders as records read from parts."""
    line = table(spark, sf_dir, "lineitem")
    open_until = F.when(F.col("l_linestatus") == "F", F.lit(1))
    records = line.select(F.col("l_returnflag").alias("entity"), F.concat_ws("-", "l_partkey", "l_linenumber").alias("natural_key"), F.col("l_suppkey").alias("pack_id"), F.col("l_partkey").alias("snapshot_id"), open_until.alias("valid_to"))
    return records, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snapshot_id"), F.concat_ws("/", "p_brand", "p_size").alias("url"))


def keys_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, snapshots = _records(spark, sf_dir)
    return history.keys_of_urls(records, snapshots, snapshots.filter(F.col("url").endswith("/7")).select("url"))


def pack_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.pack_of_urls(*_records(spark, sf_dir))


def newest_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.newest_version(packs(spark, sf_dir))


def packs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.listed(packs(spark, sf_dir).select("domain", "entity", "version"))


def auto_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.auto_versions(packs(spark, sf_dir), "14d", F.lit("2024-01-31 00:00:00").cast("timestamp"))


def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active packs' runs, opened and, for even packs, closed with an error for every tenth."""
    opened = history.open_runs(packs(spark, sf_dir), F.col("pack_id"), "schedule", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    opened = opened.withColumn("error", F.when(F.col("run_id") % 20 == 0, "first"))
    results = opened.filter("run_id % 2 = 0").select("run_id", F.lit("degraded").alias("status"), F.when(F.col("run_id") % 10 == 0, "second").alias("error"), F.lit("{}").alias("metrics"))
    done = history.close_runs(opened, results, F.lit("2024-02-01 01:00:00").cast("timestamp"))
    return done.select("run_id", "status", F.replace("error", F.lit("\n"), F.lit("|")).alias("error"), "metrics", F.date_format("finished_at", "HH:mm").alias("finished"))


def blob_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of pages by their hash; every fifth is another page's, every seventh is not there."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"), "html")
    blobs = p.filter("page_id % 7 <> 0").select("content_hash", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")).alias("body"))
    return history.blob_bodies(p, blobs).select("content_hash", F.length("body").alias("n"), "intact")


def metric_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of as many hours as they have lines, with pages by the lines' status."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    line = line.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "n"))).alias("pages"), F.sum("n").alias("hours"))  # two entries at most
    r = runs(spark, sf_dir).join(line, "run_id", "left").withColumn("finished_at", F.col("started_at") + F.make_dt_interval(F.lit(0), F.col("hours").cast("int")))
    return history.metric_families(r)


def short_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of the last days: most packs have none, one or two, which are no baseline; with the medians of those that have more."""
    late = history.qualifying_runs(runs(spark, sf_dir), packs(spark, sf_dir), F.lit(_LATE).cast("timestamp"))
    known = packs(spark, sf_dir).select("domain", "entity").distinct().join(history.row_medians(late), ["domain", "entity"], "left")
    rates = history.rate_medians(late).filter("field = 'a'").select("domain", "entity", F.col("median").alias("median_a"))
    return known.join(rates, ["domain", "entity"], "left").select("domain", "entity", F.coalesce("runs", F.lit(0)).alias("runs"), "median_rows", F.coalesce("insufficient_baseline", F.lit(True)).alias("insufficient_baseline"), "median_a")


QUERIES = {f.__name__: f for f in (qualifying_history, short_histories, qualifying_rates, keys_of_urls, pack_of_urls, newest_packs, packs_listed, auto_versions, closed_runs, blob_bodies, metric_families)}

_QUALIFYING = f"""q AS (
  SELECT c_nationkey AS domain, c_mktsegment AS entity, o_totalprice::DECIMAL(18, 6) AS price, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey
  WHERE o_orderdate >= TIMESTAMP '{_SINCE}' AND o_orderstatus <> 'F' AND o_orderkey % 4 < 2
)"""
SQL = {
    "qualifying_history": f"WITH {_QUALIFYING} SELECT domain, entity, count(*) AS runs, CASE WHEN count(*) >= 3 THEN round_even(quantile_cont(trunc(price)::INT, 0.5), 0)::BIGINT END AS median_rows, count(*) < 3 AS insufficient_baseline FROM q GROUP BY 1, 2",
    "short_histories": f"""WITH {_QUALIFYING.replace(_SINCE, _LATE)}, packs AS (SELECT DISTINCT c_nationkey AS domain, c_mktsegment AS entity FROM customer)
SELECT domain, entity, count(o_orderkey) AS runs, CASE WHEN count(o_orderkey) >= 3 THEN round_even(quantile_cont(trunc(price)::INT, 0.5), 0)::BIGINT END AS median_rows, count(o_orderkey) < 3 AS insufficient_baseline,
  CASE WHEN count(o_orderkey) >= 3 THEN quantile_cont((o_orderkey % 8) / 8, 0.5) END AS median_a FROM packs LEFT JOIN q USING (domain, entity) GROUP BY 1, 2""",
    "qualifying_rates": f"""WITH {_QUALIFYING} SELECT domain, entity, field, quantile_cont(rate, 0.5) AS median FROM (
  SELECT domain, entity, 'a' AS field, (o_orderkey % 8) / 8 AS rate FROM q UNION ALL SELECT domain, entity, 'b', 0.5::DOUBLE FROM q) GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "keys_of_urls": "SELECT DISTINCT l_returnflag AS entity, l_partkey || '-' || l_linenumber AS natural_key FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus <> 'F' AND p_size = 7",
    "pack_of_urls": "SELECT l_returnflag AS entity, p_brand || '/' || p_size AS url, min(l_suppkey) AS pack_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus <> 'F' GROUP BY 1, 2",
    "newest_packs": "SELECT c_nationkey AS domain, c_mktsegment AS entity, max(c_custkey) AS version, max(c_custkey) AS pack_id FROM customer GROUP BY 1, 2",
    "packs_listed": "SELECT c_nationkey AS domain, c_mktsegment AS entity, c_custkey AS version FROM customer ORDER BY 1, 2, 3",
    "auto_versions": "SELECT c_nationkey AS domain, c_mktsegment AS entity, count(*) FILTER (c_custkey % 4 = 0 AND c_custkey % 40 <= 14) AS n FROM customer GROUP BY 1, 2",
    "closed_runs": """SELECT c_custkey AS run_id, CASE WHEN c_custkey % 2 = 0 THEN 'degraded' ELSE 'running' END AS status,
  CASE WHEN c_custkey % 20 = 0 THEN 'first|second' WHEN c_custkey % 10 = 0 THEN 'second' END AS error, CASE WHEN c_custkey % 2 = 0 THEN '{}' END AS metrics, CASE WHEN c_custkey % 2 = 0 THEN '01:00' END AS finished FROM customer WHERE c_custkey % 3 = 0""",
    "blob_bodies": """SELECT sha256(html) AS content_hash, CASE WHEN page_id % 7 <> 0 THEN (length(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END)::INT END AS n, CASE WHEN page_id % 7 <> 0 THEN page_id % 5 <> 0 END AS intact FROM pages""",
    "metric_families": """WITH n AS (SELECT l_orderkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS run_id, 'rows_extracted' AS name, '' AS label, trunc(o_totalprice) AS value FROM orders UNION ALL SELECT l_orderkey, 'run_duration_seconds', '', sum(n) * 3600.0::DOUBLE FROM n JOIN orders ON o_orderkey = l_orderkey GROUP BY 1
UNION ALL SELECT l_orderkey, 'pages', l_linestatus, n FROM n JOIN orders ON o_orderkey = l_orderkey""",
}
