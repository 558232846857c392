"""Queries about records and the tables around them: history, incidents, packs, gold, keys and hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import scalars
from provenant.operators import quality, replay, responses, scd2, tables
from provenant.plans.runs import table

_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations of a user's state."""
    return table(spark, sf_dir, "events").select("user_id", F.date_format("ts", _TS).alias("at"), F.col("event_type").alias("state"))


def scd2_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.build_history(observations(spark, sf_dir), ["user_id"], "at", "state")


HISTORY = """obs AS (
  SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS t, event_type AS state FROM events
), marked AS (
  SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY t) IS DISTINCT FROM state AS fresh FROM obs
), numbered AS (
  SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS version FROM marked
), stretches AS (
  SELECT user_id, version, any_value(state) AS state, min(t) AS valid_from, max(t) AS last_seen_at FROM numbered GROUP BY user_id, version
), history AS (
  SELECT user_id, state, valid_from, last_seen_at, lead(valid_from) OVER (PARTITION BY user_id ORDER BY version) AS valid_to FROM stretches
)"""


def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2.point_in_time(scd2_history(spark, sf_dir), F.lit("2024-01-15 12:00:00.000000")).select("user_id", "state", "valid_from")


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The open records after a first run (even orders), and what a second run brings in: some twice."""
    o = table(spark, sf_dir, "orders")
    row = [F.lit("order").alias("entity"), F.col("o_custkey").cast("string").alias("natural_key"), F.col("o_orderkey").alias("seq"), F.sha2("o_orderpriority", 256).alias("payload_hash"), F.concat(F.lit("s"), "o_orderkey").alias("snapshot_id")]
    first = quality.first_of_each(o.filter("o_orderkey % 2 = 0").select(*row), scd2.KEYS, "seq")
    current = first.select(*scd2.KEYS, "payload_hash", "snapshot_id", F.lit(1).alias("valid_from"), F.lit(1).alias("last_seen_at"))
    return current, o.filter("o_orderkey % 2 = 1 AND o_custkey % 3 <> 0").select(*row)


ORDERS = """rows AS (
  SELECT o_custkey::VARCHAR AS natural_key, o_orderkey AS seq, sha256(o_orderpriority) AS payload_hash, 's' || o_orderkey AS snapshot_id, o_orderkey % 2 = 0 AS first FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 <> 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY first, natural_key ORDER BY seq) AS n FROM rows
), current AS (SELECT * FROM ranked WHERE first AND n = 1), incoming AS (
  SELECT r.*, CASE WHEN r.n > 1 THEN 'duplicate' WHEN c.natural_key IS NULL THEN 'inserted' WHEN c.payload_hash = r.payload_hash THEN 'unchanged' ELSE 'versioned' END AS change
  FROM ranked r LEFT JOIN current c USING (natural_key) WHERE NOT r.first
)"""


def scd2_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows after the second run: open ones and those it closed."""
    current, incoming = _orders(spark, sf_dir)
    done = scd2.apply(current, incoming, F.lit(2))
    return done.current.withColumn("valid_to", F.lit(None).cast("int")).unionByName(done.closed)


def scd2_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = _orders(spark, sf_dir)
    return scd2.apply(current, incoming, F.lit(2)).counters


def touch_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, incoming = _orders(spark, sf_dir)
    return scd2.touch_last_seen(current, incoming, F.lit(2)).select("natural_key", "snapshot_id", "last_seen_at")


def current_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scd2_history(spark, sf_dir).filter(F.col("valid_to").isNull()).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def latest_run_per_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with their last order, if any."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("run_orders")
    table(spark, sf_dir, "customer").createOrReplaceTempView("pack_customer")
    return spark.sql(
        "SELECT c.c_custkey, r.o_orderkey, r.o_orderstatus FROM pack_customer c LEFT JOIN LATERAL"
        " (SELECT max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS o_orderkey, max_by(o_orderstatus, struct(o_orderdate, o_orderkey)) AS o_orderstatus FROM run_orders o WHERE o.o_custkey = c.c_custkey) r"
    )


def latest_ok_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event of any type, and their last view."""
    e = table(spark, sf_dir, "events")
    any_type = tables.latest(e, ["user_id"], "ts", ["event_id"]).select("user_id", F.col("event_id").alias("last_id"))
    view = tables.latest(e.filter("event_type = 'view'"), ["user_id"], "ts", ["event_id"]).select("user_id", F.col("event_id").alias("last_view"))
    return any_type.join(view, "user_id", "left")


def unchanged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half of the month against the first half's: the same type as last time is the same content."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), F.date_format("ts", _TS).alias("fetched_at"), F.col("event_type").alias("content_hash"), F.when(F.col("event_id") % 20 == 0, 304).otherwise(200).alias("http_status"), "event_id")
    before, now = e.filter("fetched_at < '2024-01-16'"), e.filter("fetched_at >= '2024-01-16'")
    current = before.select("url").distinct().withColumn("pack_id", F.when(F.col("url") % 4 == 0, 2).otherwise(1))
    return tables.unchanged_pages(now, before, current, F.lit(1)).select("event_id", "unchanged")


def incident_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and signups as reports over open incidents of even users."""
    e = table(spark, sf_dir, "events")
    r = e.filter("event_type IN ('error', 'signup')").select(
        F.col("user_id").alias("pack_id"), F.col("event_type").alias("kind"), F.when(F.col("user_id") % 3 != 0, "f").alias("field"), F.col("event_id").alias("seq"), F.concat(F.lit("r"), "event_id").alias("run_id"),
        F.when(F.col("value") > 100, "critical").otherwise("warn").alias("severity"), F.create_map(F.concat(F.lit("v"), F.col("event_id") % 2), F.col("event_id").cast("string")).alias("evidence"),
    )
    users = e.select(F.col("user_id").alias("pack_id")).distinct().filter("pack_id % 2 = 0")
    opened = users.select("pack_id", F.lit("error").alias("kind"), F.when(F.col("pack_id") % 3 != 0, "f").alias("field"), F.lit("r0").alias("run_id"), F.lit("warn").alias("severity"), F.lit(1).alias("occurrences"), F.create_map(F.lit("v0"), F.lit("old"), F.lit("w"), F.lit("old")).alias("evidence"))
    out = tables.upsert_incidents(opened, r)
    evidence = F.array_join(F.transform(F.array_sort(F.map_entries("evidence")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return out.withColumn("evidence", evidence).withColumn("occurrences", F.col("occurrences").cast("bigint"))


def pack_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types by brand as submitted specs."""
    return tables.pack_versions(table(spark, sf_dir, "part"), ["p_brand"], "p_partkey", "p_type").select("p_brand", "version", "p_type", "p_partkey")


def activate_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pack_versions(spark, sf_dir).withColumn("status", F.when(F.col("version") == 1, "active").otherwise("draft"))
    return tables.activate(v, ["p_brand"], F.lit(3)).select("p_brand", "version", "status")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    price = F.when(key % 5 == 0, "n/a").when(key % 5 == 1, "1e3").otherwise(F.col("s_acctbal").cast("decimal(12,2)").cast("string"))
    payload = F.concat(F.lit('{"name":"'), "s_name", F.lit('","price":"'), price, F.lit('"}'))
    marks = F.when(key % 7 == 0, '{"violations":null}').when(key % 7 == 1, '{"violations":[]}').when(key % 7 == 2, '{"note":"violations"}').otherwise("{}")
    return s.select(F.col("s_nationkey").alias("pack_id"), F.concat(F.lit("k"), key).alias("natural_key"), payload.alias("payload"), marks.alias("quality"), F.lit(1).alias("valid_from"), F.when(key % 10 == 9, 2).alias("valid_to"))


def gold_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    packs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pack_id"), F.col("n_name").alias("domain"), F.col("n_regionkey").alias("version"))
    return tables.gold(_records(spark, sf_dir), packs, {"name": "string", "price": "decimal(12,2)"}).withColumn("price", F.col("price").cast("double"))


def gold_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).filter(tables.quarantined(F.col("quality"))).select("natural_key", "quality")


def blob_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.blob_key(F.col("url"), F.lit("2024-03-05 01:02:03").cast("timestamp"), F.sha2("html", 256)).alias("key"))


def domain_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.domain_of(F.col("url")).alias("domain"), scalars.registrable_domain(F.col("url")).alias("registrable"))


def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that are not stored yet; those of even documents are."""
    d = table(spark, sf_dir, "documents")
    stored = d.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("content_hash"))
    return tables.new_blobs(d.select(F.col("text").alias("body")), stored).select("content_hash", F.octet_length("body").alias("bytes"))


def index_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("digest"), "doc_id")
    now = d.filter("doc_id % 10 <> 1").withColumn("digest", F.when(F.col("doc_id") % 10 == 2, "x").otherwise(F.col("digest")))
    return tables.index_diff(d.filter("doc_id % 10 <> 3"), now)


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("p_partkey"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    text = (
        F.when(key % 8 == 0, F.concat(F.lit("£"), price)).when(key % 8 == 1, F.concat(F.lit("CHF 1'"), price)).when(key % 8 == 2, F.concat(F.lit("1."), F.replace(price, F.lit("."), F.lit(",")), F.lit(" €")))
        .when(key % 8 == 3, F.concat(F.lit("$1,"), F.substring(price, 1, 3))).when(key % 8 == 4, price).when(key % 8 == 5, F.lit("£")).when(key % 8 == 6, F.concat(F.lit("EUR "), F.substring(price, 1, 3), F.lit(" "))).otherwise(F.lit("1,234,567 €"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("t"))


def parse_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = scalars.parse_currency(F.col("t"))
    return _prices(spark, sf_dir).select("p_partkey", money["amount"].cast("double").alias("amount"), scalars.currency_from_symbol(money).alias("currency"))


def int_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("In stock ("), "p_size", F.lit(" available)"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-"), "p_size", F.lit(" 7"))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.int_from_text(text).alias("n"))


def natural_key_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("l_linenumber") == 1, "a|b\\c").when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.encode_natural_key(F.col("l_orderkey"), odd).alias("key"))


def natural_key_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.concat_ws(scalars.UNIT, F.col("lang"), "text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.natural_key_16(parts).alias("key"))


def sha256_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.sha256_slug(F.col("text")).alias("slug"))


def canonical_payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = scalars.canonical_json({"name": F.concat("p_name", F.lit('"\n\\')), "price": F.col("p_retailprice").cast("decimal(12,3)"), "size": F.col("p_size"), "big": F.col("p_size") > 25}, {"name": "string", "price": "decimal", "size": "integer", "big": "boolean"})
    return p.select("p_partkey", text.alias("canonical"), scalars.payload_hash(text).alias("hash"))


def virtual_rate_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return responses.schedule(pages, "url", "page_id", 0.5).select("page_id", "starts_after")


def replay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fixtures, by brand; some extracted values differ, one brand lacks a row."""
    p = table(spark, sf_dir, "part")
    melted = p.select(F.col("p_brand").alias("fixture"), F.col("p_partkey").alias("row_ix"), F.explode(F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.col("p_type"))).alias("field", "value"))
    actual = melted.filter("NOT (fixture = 'Brand#7' AND row_ix % 50 = 0)").withColumn("value", F.when((F.col("fixture") == "Brand#3") & (F.col("row_ix") % 40 == 0), "x").when((F.col("fixture") == "Brand#5") & (F.col("field") == "type"), None).otherwise(F.col("value")))
    return replay.replay(melted.withColumn("required", F.col("field") == "name"), actual)


QUERIES = {
    f.__name__: f
    for f in (
        scd2_history, point_in_time, scd2_apply, scd2_counters, touch_last_seen, current_rows, latest_run_per_pack, latest_ok_snapshot, unchanged_pages, incident_upsert, pack_versions, activate_pack, gold_view,
        gold_quarantine, blob_key, domain_of, content_dedup, index_diff, parse_currency, int_from_text, natural_key_encode, natural_key_16, sha256_slug, canonical_payload_hash, virtual_rate_schedule, replay_gate,
    )
}

_VERSIONS = """versions AS (
  SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS version, p_type, p_partkey FROM (SELECT *, lag(p_type) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS before FROM part) WHERE p_type IS DISTINCT FROM before
)"""
_RECORDS = """records AS (
  SELECT s_suppkey, s_nationkey, s_name, 'k' || s_suppkey AS natural_key, CASE s_suppkey % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN '1e3' ELSE s_acctbal::DECIMAL(12, 2)::VARCHAR END AS price,
    CASE s_suppkey % 7 WHEN 0 THEN '{"violations":null}' WHEN 1 THEN '{"violations":[]}' WHEN 2 THEN '{"note":"violations"}' ELSE '{}' END AS quality FROM supplier
)"""
_SPACE = "[\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"

SQL = {
    "scd2_history": f"WITH {HISTORY} SELECT * FROM history",
    "point_in_time": f"WITH {HISTORY} SELECT user_id, state, valid_from FROM history WHERE valid_from <= '2024-01-15 12:00:00.000000' AND (valid_to IS NULL OR '2024-01-15 12:00:00.000000' < valid_to)",
    "scd2_apply": f"""WITH {ORDERS}
SELECT 'order' AS entity, c.natural_key, c.payload_hash, c.snapshot_id, 1 AS valid_from, CASE WHEN i.change = 'unchanged' THEN 2 ELSE 1 END AS last_seen_at, CASE WHEN i.change = 'versioned' THEN 2 END AS valid_to
FROM current c LEFT JOIN (SELECT * FROM incoming WHERE change <> 'duplicate') i USING (natural_key)
UNION ALL SELECT 'order', natural_key, payload_hash, snapshot_id, 2, 2, NULL FROM incoming WHERE change IN ('inserted', 'versioned')""",
    "scd2_counters": f"WITH {ORDERS} SELECT change, count(*) AS n FROM incoming GROUP BY change",
    "touch_last_seen": f"WITH {ORDERS} SELECT natural_key, snapshot_id, CASE WHEN natural_key IN (SELECT natural_key FROM incoming) THEN 2 ELSE 1 END AS last_seen_at FROM current",
    "current_rows": f"WITH {HISTORY} SELECT state, count(*) AS n FROM history WHERE valid_to IS NULL GROUP BY state",
    "latest_run_per_pack": """SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (
  SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""",
    "latest_ok_snapshot": """SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'view') AS last_view FROM events GROUP BY user_id""",
    "unchanged_pages": """WITH before AS (SELECT user_id, arg_max(event_type, (ts, event_type)) AS last FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT event_id, coalesce((event_id % 20 = 0 OR event_type = last) AND b.user_id IS NOT NULL AND e.user_id % 4 <> 0, false) AS unchanged FROM events e LEFT JOIN before b USING (user_id) WHERE ts >= TIMESTAMP '2024-01-16'""",
    "incident_upsert": """WITH reports AS (
  SELECT user_id AS pack_id, event_type AS kind, CASE WHEN user_id % 3 <> 0 THEN 'f' END AS field, event_id AS seq, CASE WHEN value > 100 THEN 'critical' ELSE 'warn' END AS severity FROM events WHERE event_type IN ('error', 'signup')
), fresh AS (
  SELECT pack_id, kind, field, 'r' || max(seq) AS run_id, arg_max(severity, seq) AS severity, count(*) AS n, max(seq) FILTER (seq % 2 = 0) AS v0, max(seq) FILTER (seq % 2 = 1) AS v1 FROM reports GROUP BY 1, 2, 3
), opened AS (SELECT DISTINCT user_id AS pack_id, 'error' AS kind, CASE WHEN user_id % 3 <> 0 THEN 'f' END AS field FROM events WHERE user_id % 2 = 0)
SELECT coalesce(f.pack_id, o.pack_id) AS pack_id, coalesce(f.kind, o.kind) AS kind, CASE WHEN f.pack_id IS NOT NULL THEN f.field ELSE o.field END AS field, coalesce(f.run_id, 'r0') AS run_id, coalesce(f.severity, 'warn') AS severity,
  (coalesce(f.n, 0) + CASE WHEN o.pack_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS occurrences,
  concat_ws(',', CASE WHEN f.v0 IS NOT NULL THEN 'v0=' || f.v0 WHEN o.pack_id IS NOT NULL THEN 'v0=old' END, CASE WHEN f.v1 IS NOT NULL THEN 'v1=' || f.v1 END, CASE WHEN o.pack_id IS NOT NULL THEN 'w=old' END) AS evidence
FROM fresh f FULL JOIN opened o ON f.pack_id = o.pack_id AND f.kind = o.kind AND f.field IS NOT DISTINCT FROM o.field""",
    "pack_versions": f"WITH {_VERSIONS} SELECT * FROM versions",
    "activate_pack": f"""WITH {_VERSIONS} SELECT p_brand, version, CASE WHEN version = 3 THEN 'active' WHEN version = 1 THEN CASE WHEN max(version) OVER (PARTITION BY p_brand) >= 3 THEN 'retired' ELSE 'active' END ELSE 'draft' END AS status
FROM versions""",
    "gold_view": f"""WITH {_RECORDS} SELECT n_name AS domain, n_regionkey AS version, natural_key, s_name AS name, CASE WHEN regexp_matches(price, '^-?[0-9]+(\\.[0-9]+)?$') THEN price::DOUBLE END AS price, 1 AS valid_from
FROM records JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey % 7 NOT IN (0, 1) AND s_suppkey % 10 <> 9""",
    "gold_quarantine": f"WITH {_RECORDS} SELECT natural_key, quality FROM records WHERE s_suppkey % 7 IN (0, 1)",
    "blob_key": "SELECT page_id, 'raw/' || lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) || '/2024/03/' || sha256(html) || '.gz' AS key FROM pages",
    "domain_of": "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS domain, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') AS registrable FROM pages",
    "content_dedup": "SELECT DISTINCT sha256(text) AS content_hash, strlen(text)::INT AS bytes FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)",
    "index_diff": "SELECT doc_id::VARCHAR AS path, CASE doc_id % 10 WHEN 1 THEN 'removed' WHEN 2 THEN 'changed' ELSE 'added' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)",
    "parse_currency": """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_retailprice WHEN 1 THEN 1000 + p_retailprice WHEN 2 THEN 1000 + p_retailprice WHEN 3 THEN 1000 + floor(p_retailprice) WHEN 6 THEN floor(p_retailprice) END AS amount,
  CASE p_partkey % 8 WHEN 0 THEN 'GBP' WHEN 1 THEN 'CHF' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USD' WHEN 6 THEN 'EUR' END AS currency FROM part""",
    "int_from_text": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN -p_size END::BIGINT AS n FROM part",
    "natural_key_encode": "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_orderkey || '|a\\|b\\\\c' WHEN 2 THEN NULL ELSE l_orderkey || '|' || l_linestatus END AS key FROM lineitem",
    "natural_key_16": f"SELECT doc_id, substring(sha256(trim(regexp_replace(nfc_normalize(lang || chr(31) || text), '{_SPACE}+', ' ', 'g'))), 1, 16) AS key FROM documents",
    "sha256_slug": "SELECT doc_id, sha256(nfc_normalize(text)) AS slug FROM documents",
    "canonical_payload_hash": """WITH c AS (SELECT p_partkey, '{"big":' || (p_size > 25)::VARCHAR || ',"name":"' || p_name || '\\"\\n\\\\","price":' || regexp_replace(p_retailprice::DECIMAL(12, 3)::VARCHAR, '\\.?0+$', '') || ',"size":' || p_size || '}' AS canonical FROM part)
SELECT p_partkey, canonical, sha256(canonical) AS hash FROM c""",
    "virtual_rate_schedule": "SELECT page_id, (row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') ORDER BY page_id) - 1) * 2.0::DOUBLE AS starts_after FROM pages",
    "replay_gate": """WITH e AS (SELECT p_brand AS fixture, p_partkey AS ix, unnest([{'f': 'name', 'v': p_name}, {'f': 'type', 'v': p_type}], recursive := true) FROM part),
a AS (SELECT fixture, ix, f, CASE WHEN fixture = 'Brand#3' AND ix % 40 = 0 THEN 'x' WHEN fixture = 'Brand#5' AND f = 'type' THEN NULL ELSE v END AS v FROM e WHERE NOT (fixture = 'Brand#7' AND ix % 50 = 0)),
j AS (SELECT e.fixture, count(*) AS compared, count(*) FILTER (e.f = 'name' AND e.v IS DISTINCT FROM a.v) AS differing, count(DISTINCT e.ix) AS n FROM e LEFT JOIN a ON a.fixture = e.fixture AND a.ix = e.ix AND a.f = e.f GROUP BY e.fixture)
SELECT j.fixture, compared, differing, differing = 0 AND n = (SELECT count(DISTINCT ix) FROM a WHERE a.fixture = j.fixture) AS passed FROM j""",
}
