"""Queries about what is stored: integrity rules, intervals, provenance, ordered keys, intervals between requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.held import held
from provenant.operators import integrity, replay, responses
from provenant.plans.runs import table
from provenant.plans.web import _robots
from provenant.sources import folders

#: The tables of the rules as SQL over the given ones; the same text in both engines. Each rule has rows that break it.
_TABLES = {
    "site_pack": """SELECT c_nationkey AS domain, c_mktsegment AS entity, c_custkey % 40 AS version, CASE WHEN c_custkey % 30 = 2 THEN c_custkey % 40 ELSE c_custkey % 40 - 1 END AS parent_version,
  CASE c_custkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'canary' WHEN 2 THEN 'retired' WHEN 3 THEN 'draft' ELSE CASE WHEN c_custkey % 25 = 4 THEN 'odd' ELSE 'rejected' END END AS status,
  concat('{{"domain":"', CAST(CASE WHEN c_custkey % 50 = 1 THEN -1 ELSE c_nationkey END AS {text}), '"}}') AS spec, CASE c_custkey % 60 WHEN 3 THEN 'bot' WHEN 4 THEN 'healer:' WHEN 5 THEN NULL WHEN 6 THEN 'healer:2' ELSE 'human:x' END AS created_by,
  CASE WHEN c_custkey % 15 <> 0 THEN c_custkey END AS activated_at FROM customer""",
    "run": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 300 <> 5 THEN o_custkey END AS pack_id, CASE o_orderkey % 5 WHEN 0 THEN 'schedule' WHEN 1 THEN 'manual' WHEN 2 THEN 'canary' WHEN 3 THEN 'replay' ELSE 'cron' END AS trigger,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'done' END AS status, o_orderkey % 100 AS started_at, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 101 END AS finished_at, o_orderkey % 50 - 1 AS pages_fetched, CAST(floor(o_totalprice) AS BIGINT) - 2000 AS rows_extracted FROM orders""",
    "snapshot": """SELECT page_id AS snapshot_id, url, page_id AS fetched_at, page_id * 7 % 620 AS http_status, CASE WHEN page_id % 6 = 1 THEN 'x' ELSE {sha}(html{bits}) END AS content_hash, page_id % 8 - 1 AS byte_size, 'k' AS blob_key,
  CASE WHEN page_id % 20 = 7 THEN 'curl' WHEN page_id % 2 = 0 THEN 'httpx' ELSE 'playwright' END AS fetcher, page_id % 3 = 0 AS is_golden, CASE WHEN page_id % 9 <> 0 THEN 'l' END AS golden_label FROM pages""",
    "blob": "SELECT CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE {sha}(text{bits}) END AS content_hash, text AS body FROM documents",
    "record": """SELECT l_returnflag AS entity, l_partkey AS natural_key, l_orderkey AS snapshot_id, CASE WHEN l_suppkey % 50 <> 1 THEN l_suppkey END AS pack_id, l_orderkey AS valid_from, CASE WHEN l_linestatus = 'F' THEN l_orderkey + l_linenumber - 1 END AS valid_to,
  CASE WHEN l_linenumber = 7 THEN 'x' ELSE {sha}(CAST(l_partkey AS {text}){bits}) END AS payload_hash FROM lineitem""",
    "incident": """SELECT user_id AS pack_id, event_type AS kind, CASE WHEN user_id % 3 <> 0 THEN 'f' END AS field, CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warn' WHEN 2 THEN 'critical' ELSE 'bad' END AS severity, event_id % 10 AS opened_at,
  CASE WHEN event_id % 7 > 0 THEN event_id % 11 END AS closed_at, CASE WHEN event_id % 7 > 1 THEN 'fixed' END AS resolution FROM events""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in ("customer", "orders", "pages", "documents", "lineitem", "events"):
        table(spark, sf_dir, t).createOrReplaceTempView(f"stored_{t}")
    text = _TABLES[name].format(text="STRING", sha="sha2", bits=", 256")
    head, _, source = text.rpartition(" FROM ")
    return spark.sql(f"{head} FROM stored_{source}")


def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of each table is broken, counted while the tables are written."""
    found = [(name, rule, n) for name in _TABLES for rule, n in integrity.written(_table(spark, sf_dir, name), name).broken.items()]
    return spark.createDataFrame(found, "name string, rule string, n long")  # a row for each rule


def interval_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as intervals from their number to the next thousand: many overlap, others leave gaps."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    end = F.when(k % 97 > 0, F.ceil((k + 1) / 1000) * 1000)
    rows = o.select((F.col("o_custkey") % 400).alias("natural_key"), (F.floor(k / 500) * 500).alias("valid_from"), end.alias("valid_to")).distinct()
    return integrity.interval_breaks(rows, ["natural_key"]).select("natural_key", "at", "kind")


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records: some orders are no snapshots, some suppliers are no packs or several, some lines name none."""
    line = table(spark, sf_dir, "lineitem")
    records = line.select(F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("snapshot_id"), F.col("l_suppkey").alias("pack_id"))
    s = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("pack_id"))
    packs = s.union(s.filter("pack_id % 7 = 0")).union(table(spark, sf_dir, "nation").select(-F.col("n_nationkey") - 1))
    return integrity.provenance(records, table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 3").select(F.col("o_orderkey").alias("snapshot_id")), packs)


def key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of brands: in one brand two rows have changed places, in others keys are lost, added or null."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    expected = p.select(F.col("p_brand").alias("fixture"), k.alias("row_ix"), F.col("p_name").alias("key"))
    swapped = F.when((F.col("fixture") == "Brand#2") & (k.between(60, 99)), 159 - k).otherwise(k)
    actual = p.select(F.col("p_brand").alias("fixture"), k, F.col("p_name").alias("key")).withColumn("row_ix", swapped)
    actual = actual.filter("NOT (fixture = 'Brand#4' AND p_partkey > 150) AND fixture <> 'Brand#5'").withColumn("key", F.when((F.col("fixture") == "Brand#1") & (k > 100), None).otherwise(F.col("key")))
    more = actual.filter("fixture = 'Brand#3'").select("fixture", (F.col("row_ix") + 1_000_000).alias("row_ix"), "key")
    return replay.key_order(expected, actual.select("fixture", "row_ix", "key").union(more)).withColumn("first_difference", F.col("first_difference").cast("bigint"))


def host_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, some of which answered that it was too much, or have a delay in their robots file."""
    k = F.col("page_id")
    pages, policy = _robots(spark, sf_dir)
    answers = pages.select("url", F.when(k % 7 == 0, 429).when(k % 11 == 0, 403).when(k % 13 == 0, 503).otherwise(200).alias("http_status"), F.when(k % 2 == 0, (k % 400).cast("string")).alias("retry_after"))
    return responses.host_intervals(answers, F.lit("2024-02-01 00:00:00").cast("timestamp"), 0.5, policy)


def index_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files in folders of their source and language, indexed twice: in some sources nothing has changed."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("path"), F.md5("text").alias("digest"), "doc_id", "source")
    odd = F.col("source").isin("src3", "src7")
    now = d.filter(~(odd & (F.col("doc_id") % 10 == 1))).withColumn("digest", F.when(odd & (F.col("doc_id") % 10 == 2), "x").otherwise(F.col("digest")))
    before = d.filter(~(odd & (F.col("doc_id") % 10 == 3)))
    return folders.descend(held(folders.index(before), "index"), held(folders.index(now), "index"))[0]


def edge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of cheap parts as fixtures of their brand, which should have each type's sizes; those of one type are waived."""
    p = table(spark, sf_dir, "part")
    label = F.concat_ws(":", "p_type", F.col("p_size") % 9).alias("label")
    fixtures = p.filter("p_retailprice < 950").select(F.col("p_brand").alias("source"), label)
    required = p.select(F.col("p_brand").alias("source"), label)
    waived = p.filter("p_type = 'PROMO' or p_brand = 'Brand#3'").select(F.col("p_brand").alias("source"), label).distinct()
    return replay.edge_coverage(fixtures, required, waived, floor=30)


def page_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as pages of many statuses, unchanged or not, refused or not."""
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 304, 404, 500, None, 206, 200)]), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", responses.page_use(status, k % 3 == 0, k % 11 != 0).alias("use"))


QUERIES = {f.__name__: f for f in (edge_coverage, page_uses, index_descent, integrity_rules, interval_breaks, provenance, key_order, host_intervals)}


def _rules_sql() -> str:
    """Each rule again, by hand, over the same tables."""
    rules = {
        "site_pack": {
            "version_positive": "version < 1", "parent_before_self": "parent_version >= version", "spec_domain_matches": "json_extract_string(spec, '$.domain') <> domain::VARCHAR", "created_by_namespaced": "NOT regexp_matches(created_by, '^(human|healer):.+')",
            "active_needs_activation": "status = 'active' AND activated_at IS NULL", "status_known": "status = 'odd'", "created_by_needed": "created_by IS NULL",
        },
        "run": {
            "finished_after_started": "finished_at < started_at", "terminal_needs_finished": "status <> 'running' AND finished_at IS NULL", "pages_nonneg": "pages_fetched < 0", "rows_nonneg": "rows_extracted < 0", "status_known": "status = 'done'", "trigger_known": "trigger = 'cron'", "pack_id_needed": "pack_id IS NULL",
        },
        "snapshot": {"http_status_range": "http_status < 100 OR http_status > 599", "byte_size_nonneg": "byte_size < 0", "content_hash_sha256": "length(content_hash) <> 64", "fetcher_known": "fetcher = 'curl'", "golden_needs_label": "is_golden AND golden_label IS NULL"},
        "blob": {"content_hash_of_body": "content_hash = 'x'"},
        "record": {"valid_interval": "valid_to <= valid_from", "payload_hash_sha256": "length(payload_hash) <> 64", "pack_id_needed": "pack_id IS NULL"},
        "incident": {"closure_needs_resolution": "(closed_at IS NULL) <> (resolution IS NULL)", "closed_after_opened": "closed_at < opened_at", "severity_known": "severity = 'bad'"},
    }
    unique = {
        "site_pack": {"one_version": ("domain, entity, version", "true"), "one_active": ("domain, entity", "status = 'active'"), "one_canary": ("domain, entity", "status = 'canary'")}, "run": {"one_run": ("run_id", "true")}, "snapshot": {"one_snapshot": ("snapshot_id", "true")},
        "blob": {"one_blob": ("content_hash", "true")}, "record": {"one_open_row": ("entity, natural_key", "valid_to IS NULL")}, "incident": {"one_open_incident": ("pack_id, kind, field", "closed_at IS NULL")},
    }
    tables = ", ".join(f"t_{n} AS ({t.format(text='VARCHAR', sha='sha256', bits='')})" for n, t in _TABLES.items())
    counts = [f"SELECT '{n}' AS name, '{rule}' AS rule, count(*) FILTER ({breaks}) AS n FROM t_{n}" for n, some in rules.items() for rule, breaks in some.items()]
    counts += [f"SELECT '{n}', '{rule}', count(*) FROM (SELECT 1 FROM t_{n} WHERE {among} GROUP BY {keys} HAVING count(*) > 1)" for n, some in unique.items() for rule, (keys, among) in some.items()]
    return f"WITH {tables} SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE n > 0"


_URL = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '')"
SQL = {
    "edge_coverage": """WITH p AS (SELECT p_brand AS source, p_type || ':' || (p_size % 9) AS label, p_type, p_retailprice FROM part), f AS (SELECT * FROM p WHERE p_retailprice < 950),
m AS (SELECT DISTINCT source, label FROM p WHERE p_type <> 'PROMO' AND source <> 'Brand#3' AND (source, label) NOT IN (SELECT (source, label) FROM p WHERE p_type = 'PROMO') AND (source, label) NOT IN (SELECT (source, label) FROM f)),
c AS (SELECT source, (SELECT count(*) FROM f WHERE f.source = s.source) AS fixtures, (SELECT count(*) FROM m WHERE m.source = s.source) AS missing FROM (SELECT DISTINCT source FROM p) s)
SELECT *, CASE WHEN fixtures < 30 THEN 'insufficient_fixtures' WHEN missing > 0 THEN 'missing_labels' ELSE 'covered' END AS verdict FROM c""",
    "page_uses": """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'refused' WHEN o_orderkey % 7 IN (2, 3, 4, 5) THEN 'partial_failure' WHEN o_orderkey % 3 = 0 THEN 'skip' ELSE 'extract' END AS use FROM orders""",
    "index_descent": """WITH d AS (SELECT source || '/' || lang || '/' || doc_id AS path, md5(text) AS digest, doc_id, source IN ('src3', 'src7') AS odd FROM documents),
a AS (SELECT path, digest FROM d WHERE NOT (odd AND doc_id % 10 = 3)), b AS (SELECT path, CASE WHEN odd AND doc_id % 10 = 2 THEN 'x' ELSE digest END AS digest FROM d WHERE NOT (odd AND doc_id % 10 = 1))
SELECT path, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (path) WHERE a.digest IS DISTINCT FROM b.digest""",
    "integrity_rules": _rules_sql(),
    "interval_breaks": """WITH i AS (SELECT DISTINCT o_custkey % 400 AS k, o_orderkey // 500 * 500 AS b, CASE WHEN o_orderkey % 97 > 0 THEN ceil((o_orderkey + 1) / 1000)::BIGINT * 1000 END AS e FROM orders),
s AS (SELECT k, b, max(e) OVER w AS latest, coalesce(max((e IS NULL)::INT) OVER w, 0) AS open FROM i WINDOW w AS (PARTITION BY k ORDER BY b, e NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT k AS natural_key, b AS at, CASE WHEN open = 1 OR b < latest THEN 'overlap' ELSE 'gap' END AS kind FROM s WHERE open = 1 OR b <> latest""",
    "provenance": """WITH r AS (SELECT CASE WHEN l_linenumber < 7 THEN l_orderkey END AS snapshot_id, l_suppkey AS pack_id FROM lineitem), s AS (SELECT o_orderkey AS snapshot_id FROM orders WHERE o_orderkey % 4 <> 3),
p AS (SELECT s_suppkey AS pack_id FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 35 <> 0 AND s_suppkey % 7 = 0 UNION ALL SELECT -n_nationkey - 1 FROM nation)
SELECT 'snapshot' AS reference, count(*) AS records, count(*) FILTER (snapshot_id IS NULL) AS missing, count(*) FILTER (snapshot_id IS NOT NULL AND snapshot_id NOT IN (FROM s)) AS orphans, 0 AS ambiguous,
  (SELECT count(*) FROM s WHERE snapshot_id NOT IN (SELECT snapshot_id FROM r WHERE snapshot_id IS NOT NULL)) AS unused FROM r
UNION ALL SELECT 'pack', count(*), 0, count(*) FILTER (pack_id NOT IN (FROM p)), count(*) FILTER (pack_id IN (SELECT pack_id FROM p GROUP BY pack_id HAVING count(*) > 1)), (SELECT count(*) FROM p WHERE pack_id NOT IN (SELECT pack_id FROM r)) FROM r""",
    "key_order": """WITH e AS (SELECT p_brand AS fixture, p_name AS key, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos FROM part),
raw AS (
  SELECT p_brand AS fixture, CASE WHEN p_brand = 'Brand#2' AND p_partkey BETWEEN 60 AND 99 THEN 159 - p_partkey ELSE p_partkey END AS ix, CASE WHEN p_brand = 'Brand#1' AND p_partkey > 100 THEN NULL ELSE p_name END AS key FROM part WHERE p_brand <> 'Brand#5' AND NOT (p_brand = 'Brand#4' AND p_partkey > 150)
), a AS (SELECT fixture, key, row_number() OVER (PARTITION BY fixture ORDER BY ix) - 1 AS pos FROM (SELECT * FROM raw UNION ALL SELECT fixture, ix + 1000000, key FROM raw WHERE fixture = 'Brand#3')),
j AS (SELECT coalesce(e.fixture, a.fixture) AS fixture, coalesce(e.pos, a.pos) AS pos, e.fixture IS NULL OR a.fixture IS NULL OR e.key IS DISTINCT FROM a.key AS differs, e.fixture IS NOT NULL AS mine, a.fixture IS NOT NULL AS theirs FROM e FULL JOIN a ON e.fixture = a.fixture AND e.pos = a.pos)
SELECT fixture, count(*) FILTER (mine) AS keys, count(*) FILTER (theirs) AS got, count(*) FILTER (differs) = 0 AS same, min(pos) FILTER (differs) AS first_difference FROM j GROUP BY fixture HAVING count(*) FILTER (mine) > 0""",
    "host_intervals": f"""WITH w AS (SELECT {_URL} AS host, length(lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1))) % 5 AS kind, CASE WHEN page_id % 7 = 0 OR page_id % 11 = 0 THEN CASE WHEN page_id % 2 = 0 THEN least(300, page_id % 400) ELSE 1 END END AS wait FROM pages)
SELECT host, greatest(2.0, coalesce(max(wait), 0), max(CASE kind WHEN 0 THEN 1.5 ELSE 0 END))::DOUBLE AS interval FROM w GROUP BY host""",
}
