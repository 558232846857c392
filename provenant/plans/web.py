"""Queries about responses: robots, waits, encodings, JSON in pages and answers, snapshots, verdicts of pages, chains of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import scalars
from provenant.operators import detect, extract, replay, responses, robots, tables
from provenant.plans.runs import table

_NOW = "2024-02-01 00:00:00"


def _pick(key: Column, *values: object) -> Column:
    """One of the values by a key's remainder; None is null."""
    n = len(values)
    as_column = [v if isinstance(v, Column) else F.lit(v) for v in values]
    out = F.when(key % n == 0, as_column[0])
    for k, v in enumerate(as_column[1:], 1):
        out = out.when(key % n == k, v)
    return out


#: Robots files of five kinds of hosts; of the last one no status came.
_ROBOTS = (
    (200, "User-agent: *\nDisallow: /*/1*5$\nDisallow: /fr/\nAllow: /fr/*page=\nDisallow: /*caf%C3%A9\nDisallow: /e%6E/9*?*utm\nAllow: /en/9*?*ut*\nCrawl-delay: 1.5\n\nUser-agent: other\nDisallow: /"),
    (404, "ignored"),
    (403, "ignored"),
    (200, "User-agent: *\nDisallow: /\n\nUser-agent: PROVENANT/2 # ours\nUser-agent: third\nDisallow: /de/2 # note\nDisallow:\nDisallow: /*/*7*7\nAllow: /*/*7*7?*\nDisallow: /*%24x\nDisallow: /es/$\nDisallow: /de$x\n\nUser-agent: provenantbot\nDisallow: /"),
    (503, "ignored"),
)


def _robots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages' URLs, some with escapes, non-ASCII and characters of patterns behind them; a robots file for each host."""
    k = F.col("page_id")
    head, tail = F.substring_index("url", "?", 1), F.regexp_extract("url", "[?#].*$", 0)
    url = F.concat(F.substring_index(head, "#", 1), _pick(k, "", "/caf\u00e9", "/caf%c3%A9", "/$x", "/a%24x", "/%7e", "*7", "", "", "", ""), tail)
    pages = table(spark, sf_dir, "pages").select(k, url.alias("url"))
    where = robots.origin(F.col("url"))
    kind = F.length("origin") % 5
    files = pages.select(where.alias("origin")).distinct().select("origin", _pick(kind, *[x[0] for x in _ROBOTS]).alias("http_status"), _pick(kind, *[x[1] for x in _ROBOTS]).alias("body"))
    return pages, robots.policies(files, "Provenant/1.0")


def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages may be fetched, by which rule."""
    pages, policy = _robots(spark, sf_dir)
    return robots.decisions(pages, policy)


def source_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as sources whose entry URLs are their pages."""
    pages, policy = _robots(spark, sf_dir)
    return robots.admissions(pages.select(robots.origin(F.col("url")).alias("label"), F.col("page_id").alias("seq"), "url"), policy)


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as Retry-After headers: seconds, dates in the past and the future, nonsense, none."""
    k = F.col("o_orderkey")
    now = F.lit(_NOW).cast("timestamp")
    date = F.date_format(now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 700 - 200).cast("decimal(18,6)")), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    header = _pick(k, F.concat(F.lit(" "), (k % 500).cast("string")), date, "soon", None)
    return table(spark, sf_dir, "orders").select("o_orderkey", responses.retry_after(header, now).alias("seconds"))


def charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' URLs as bodies with a BOM, a charset in the header, one of their own, none, or an unknown one."""
    k = F.col("page_id")
    text = F.concat(F.lit("<p>é "), "url")
    meta = F.concat(F.lit("<META charset='Windows-1252'>"), text)
    body = _pick(k, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8")), F.encode(text, "UTF-16"), F.encode(text, "ISO-8859-1"), F.encode(meta, "ISO-8859-1"), F.encode(text, "UTF-8"), F.encode(text, "UTF-8"))
    kind = _pick(k, "text/html; charset=ascii", "text/html", 'Text/HTML; Charset="ISO-8859-1"', "text/html", None, "text/html; charset=x-none")
    named = table(spark, sf_dir, "pages").select("page_id", body.alias("body"), responses.encoding(body, kind).alias("encoding"))
    return named.select("page_id", "encoding", F.md5(responses.decoded(F.col("body"), F.col("encoding"))).alias("digest"))


def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = _pick(F.col("o_orderkey"), "application/json; charset=utf-8", "Text/JSON", " application/ld+json ", "text/html", "application/jsonp", None)
    return table(spark, sf_dir, "orders").select("o_orderkey", responses.media_type(kind).alias("kind"), responses.is_json(kind).alias("is_json"))


def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with as many items in a script as their id's remainder says; every third has no such script."""
    k = F.col("page_id")
    item = lambda i: F.concat(F.lit('{"n":'), i.cast("string"), F.lit(',"of":{"url":"'), F.col("url"), F.lit('"}}'))
    items = F.when(k % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(1), k % 4), item), ",")).otherwise("")
    script = F.concat(F.lit('<script type="application/json" id="state">{"list":{"items":['), items, F.lit("]}}</script>"))
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(k % 3 > 0, F.concat(script, "html")).otherwise(F.col("html")))
    rows = extract.embedded_json(pages, {"n": "n", "url": "of.url"}, root="$.list.items[*]", script_id="state")
    return rows.select("page_id", F.posexplode("rows").alias("pos", "r")).select("page_id", "pos", "r.n", "r.url")


def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the answers of their nation's endpoint, some of which fail or are no JSON."""
    k = F.col("n_nationkey")
    body = F.concat(F.lit('{"items":[{"id":'), k, F.lit("},{\"id\":null},7]"), F.when(k % 6 == 4, "").otherwise("}"))
    answers = table(spark, sf_dir, "nation").select(F.concat(F.lit("https://api.example.com/"), k).alias("url"), F.when(k % 6 == 2, 503).otherwise(200).alias("http_status"), F.when(k % 6 == 3, "text/html").otherwise("application/json").alias("content_type"), body.alias("body"))
    pages = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = extract.json_responses(pages, answers, F.concat(F.lit("https://api.example.com/"), "s_nationkey"), {"id": "id"}, "$.items[*]")
    return rows.select("s_suppkey", F.posexplode("rows").alias("pos", "r")).select("s_suppkey", "pos", F.col("r")["id"].alias("id"))


def snapshot_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the second half of the month as responses, those of the first half as snapshots."""
    e = table(spark, sf_dir, "events")
    url = F.concat(F.lit("http://h"), "user_id", F.lit(".example.com/"))
    k = F.col("event_id")
    early = e.filter("ts < timestamp'2024-01-16'")
    old = early.select(url.alias("url"), F.col("ts").alias("fetched_at"), _pick(k, 200, 200, 404).alias("http_status"), F.sha2("event_type", 256).alias("content_hash"), F.concat(F.lit("k"), k).alias("blob_key"), F.when(k % 2 == 0, F.concat(F.lit("e"), k)).alias("etag"))
    body = F.when(k % 7 == 0, F.concat(F.lit("new "), k)).otherwise(F.col("event_type"))
    now = e.filter("ts >= timestamp'2024-01-16'").select("event_id", url.alias("url"), F.col("ts").alias("fetched_at"), _pick(k, 200, 304, 304, 404, None).alias("http_status"), body.alias("body"), F.when(k % 3 == 0, "now").alias("etag"))
    rows = tables.snapshot_rows(now, old)
    return rows.select("url", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "http_status", "content_hash", "blob_key", "byte_size", "etag", "dangling")


def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a telling header or title, a refresh to a consent page, too little text, or nothing odd."""
    k = F.col("page_id")
    long = F.concat(F.lit("<p>"), F.repeat(F.lit("word "), 60))
    html = _pick(
        k, F.concat(F.lit("<title>A page</title>"), long), F.concat(F.lit("<title>Page Not Found</title>"), long), F.concat(F.lit("<head><meta http-equiv=Refresh content='0; url=/Cookie-wall'></head><body>"), long),
        F.concat(F.lit("<title>t</title><body>"), F.repeat(F.lit("é"), (k % 200).cast("int")), F.lit("<script>"), F.repeat(F.lit("x"), 300), F.lit("</script>")),
    )
    headers = F.when(k % 5 == 0, F.create_map(F.lit("CF-Mitigated"), F.lit("challenge"))).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    pages = table(spark, sf_dir, "pages").select("page_id", html.alias("html"), headers.alias("headers"), F.when(k % 9 == 0, 404).otherwise(200).alias("http_status"))
    return detect.detect(pages, headers="headers").select("page_id", "block", "soft_404")


def source_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with two sources of rows: the first one's rows count, fields come from whichever has something in them."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, F.col("p_name")).otherwise("")
    one = F.create_map(F.lit("name"), name, F.lit("price"), F.when(k % 3 == 0, "free").otherwise(F.concat(F.lit("€"), F.col("p_size"))))
    two = F.create_map(F.lit("name"), F.col("p_type"), F.lit("price"), F.concat(F.lit("USD "), F.col("p_size") + 1))
    a = F.when(k % 5 == 0, F.array()).when(k % 5 == 1, F.array(one, one)).otherwise(F.array(one)).cast("array<map<string,string>>")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", a.alias("a"), F.array(two).cast("array<map<string,string>>").alias("b"))
    rows = extract.one_row_each(parts, ["a", "b"], ["p_partkey", "p_brand"])
    done = extract.chain(rows, ["a", "b"], {"name": [], "price": ["parse_currency"]}, ["p_partkey", "p_brand", "row_ix"])
    key = extract.derived([F.col("p_brand"), F.col("name")], "natural_key_16")
    return done.select("p_partkey", "row_ix", "name", "name_source", F.col("price.amount").cast("double").alias("amount"), F.col("price.currency").alias("currency"), "price_source", key.alias("key"))


def optional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.optional_counts(_extracted(spark, sf_dir), ["name"])


def gate_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand is a fixture; all values are as expected, but one optional field lost values since the baseline."""
    got = _extracted(spark, sf_dir)
    results = replay.replay(got.withColumn("required", F.col("field") == "name"), got)
    before = table(spark, sf_dir, "part").agg(F.count("p_type").alias("n")).select(F.lit("type").alias("field"), "n")
    counts = replay.optional_counts(got, ["name"])
    ok, fewer = replay.gate(results, counts), replay.gate(results, counts, before)
    return ok.select(F.lit("fixtures").alias("what"), "passed").unionByName(fewer.select(F.lit("baseline").alias("what"), "passed"))


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 7 > 0, F.col("p_type"))
    return p.select(F.col("p_brand").alias("fixture"), F.col("p_partkey").alias("row_ix"), F.explode(F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), kind, F.lit("size"), F.col("p_size").cast("string"))).alias("field", "value"))


def labels_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and sizes as labels of an edge case; large parts have them, those of one brand are waived."""
    label = F.concat_ws(":", "p_brand", "p_size").alias("label")
    p = table(spark, sf_dir, "part")
    missing = replay.missing_labels(p.select(label).distinct(), p.filter("p_retailprice > 1500").select(label).distinct(), p.filter("p_brand = 'Brand#1'").select(label).distinct())
    return missing.select("label", scalars.label_dirname(F.col("label")).alias("folder"))


def safe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = _pick(F.col("p_partkey"), F.concat(F.lit("raw/a/"), "p_size"), F.concat(F.lit("/"), "p_size"), F.concat(F.lit("raw/../"), "p_size"), "", F.concat(F.lit("c:"), "p_size"), F.concat(F.lit("raw/..a/"), "p_size"), F.concat(F.lit("a\\"), "p_size"), F.concat("p_size", F.lit("/..")))
    return table(spark, sf_dir, "part").select("p_partkey", scalars.safe_key(key).alias("safe"))


QUERIES = {f.__name__: f for f in (robots_allowed, source_admissions, retry_waits, charsets, json_kinds, script_rows, json_answers, snapshot_plan, page_verdicts, source_chain, optional_counts, gate_verdict, labels_missing, safe_keys)}

_PARTS = "p AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS first, p_partkey % 5 AS five FROM part)"
#: The rule itself: each pattern as a regular expression over the unescaped path; the longest that matches decides.
_DECIDED = """u AS (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') || ['', '/caf\u00e9', '/caf%c3%A9', '/$x', '/a%24x', '/%7e', '*7', '', '', '', ''][(page_id % 11)::INT + 1] || regexp_extract(url, '[?#].*$') AS url,
    length(lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1))) % 5 AS kind FROM pages
), r(kind, allow, line, pattern) AS (
  VALUES (0, false, 'Disallow: /*/1*5$', '/*/1*5$'), (0, false, 'Disallow: /fr/', '/fr/'), (0, true, 'Allow: /fr/*page=', '/fr/*page='), (0, false, 'Disallow: /*caf%C3%A9', '/*caf%C3%A9'),
    (0, false, 'Disallow: /e%6E/9*?*utm', '/en/9*?*utm'), (0, true, 'Allow: /en/9*?*ut*', '/en/9*?*ut*'), (3, false, 'Disallow: /de/2 # note', '/de/2'), (3, false, 'Disallow: /*/*7*7', '/*/*7*7'),
    (3, true, 'Allow: /*/*7*7?*', '/*/*7*7?*'), (3, false, 'Disallow: /*%24x', '/*%24x'), (3, false, 'Disallow: /es/$', '/es/$'), (3, false, 'Disallow: /de$x', '/de%24x')
), hits AS (
  SELECT url, allow, line, length(pattern) AS size FROM u JOIN r ON u.kind = r.kind
    AND regexp_matches(url_decode(regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1)), '^' || replace(regexp_escape(url_decode(rtrim(pattern, '$'))), '\\*', '.*') || CASE WHEN ends_with(pattern, '$') THEN '$' ELSE '' END)
), best AS (SELECT url, arg_max(allow, (size, allow, line)) AS allow, arg_max(line, (size, allow, line)) AS line FROM hits GROUP BY url),
decided AS (
  SELECT DISTINCT u.url, u.kind, b.line, CASE kind WHEN 1 THEN 'allowed' WHEN 2 THEN 'disallowed' WHEN 4 THEN 'unavailable' ELSE CASE WHEN coalesce(b.allow, true) THEN 'allowed' ELSE 'disallowed' END END AS decision FROM u LEFT JOIN best b ON b.url = u.url
)"""
SQL = {
    "robots_allowed": f"WITH {_DECIDED} SELECT url, decision, decision = 'allowed' AS allowed, line, CASE kind WHEN 0 THEN 1.5 END::DOUBLE AS crawl_delay FROM decided",
    "source_admissions": f"""WITH {_DECIDED}, v AS (
  SELECT lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS label, url, page_id, kind, decision, line, row_number() OVER (PARTITION BY lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) ORDER BY decision = 'allowed', page_id, url) AS n FROM decided JOIN u USING (url, kind)
)
SELECT label, url, decision = 'allowed' AS admitted, CASE WHEN decision = 'disallowed' THEN concat_ws(': ', 'disallowed', line) WHEN decision = 'allowed' AND kind = 1 THEN 'allowed (no robots file)' ELSE decision END AS reason FROM v WHERE n = 1""",
    "retry_waits": """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN least(300, o_orderkey % 500) WHEN 1 THEN greatest(0, least(300, o_orderkey % 700 - 200)) ELSE 1 END::DOUBLE AS seconds FROM orders""",
    "charsets": """SELECT page_id, ['utf-8', 'utf-16', 'iso-8859-1', 'windows-1252', 'utf-8', 'x-none'][(page_id % 6)::INT + 1] AS encoding, md5(CASE WHEN page_id % 6 = 3 THEN '<META charset=''Windows-1252''>' ELSE '' END || '<p>é ' || url) AS digest FROM pages""",
    "json_kinds": """SELECT o_orderkey, ['application/json', 'text/json', 'application/ld+json', 'text/html', 'application/jsonp', NULL][(o_orderkey % 6)::INT + 1] AS kind, o_orderkey % 6 < 3 AS is_json FROM orders""",
    "script_rows": """WITH p AS (
  SELECT page_id, '{"list":{"items":[' || coalesce(array_to_string(list_transform(range(1, page_id % 4 + 1), lambda i: '{"n":' || i || ',"of":{"url":"' || url || '"}}'), ','), '') || ']}}' AS j FROM pages WHERE page_id % 3 > 0
), r AS (SELECT page_id, unnest(json_extract(j, '$.list.items[*]')) AS r, generate_subscripts(json_extract(j, '$.list.items[*]'), 1) - 1 AS pos FROM p)
SELECT page_id, pos::INT AS pos, json_extract_string(r, '$.n') AS n, json_extract_string(r, '$.of.url') AS url FROM r""",
    "json_answers": """WITH a AS (
  SELECT n_nationkey AS k, CASE WHEN k % 6 = 2 THEN 503 ELSE 200 END AS status, CASE WHEN k % 6 = 3 THEN 'text/html' ELSE 'application/json' END AS kind, '{"items":[{"id":' || k || '},{"id":null},7]' || CASE WHEN k % 6 = 4 THEN '' ELSE '}' END AS body FROM nation
), i AS (SELECT k, list_filter(json_extract(body, '$.items[*]'), lambda x: json_type(x) = 'OBJECT') AS r FROM a WHERE status = 200 AND kind LIKE '%json' AND json_valid(body)),
e AS (SELECT k, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS pos FROM i)
SELECT s_suppkey, pos::INT AS pos, json_extract_string(x, '$.id') AS id FROM supplier JOIN e ON k = s_nationkey""",
    "snapshot_plan": """WITH old AS (
  SELECT user_id, ts, event_id, sha256(event_type) AS hash, 'k' || event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id END AS etag FROM events WHERE ts < TIMESTAMP '2024-01-16'
), good AS (SELECT * FROM old WHERE event_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, hash DESC, key DESC, etag DESC NULLS LAST) = 1),
stored AS (SELECT hash, min(key) AS key FROM old GROUP BY hash),
now AS (
  SELECT event_id, user_id, ts, [200, 304, 304, 404, NULL][(event_id % 5)::INT + 1] AS status, CASE WHEN event_id % 7 = 0 THEN 'new ' || event_id ELSE event_type END AS body, CASE WHEN event_id % 3 = 0 THEN 'now' END AS etag
  FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_id % 5 < 4
)
SELECT 'http://h' || n.user_id || '.example.com/' AS url, strftime(n.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, status AS http_status, CASE WHEN status = 304 THEN g.hash ELSE sha256(body) END AS content_hash,
  CASE WHEN status = 304 THEN g.key ELSE coalesce(s.key, 'raw/h' || n.user_id || '.example.com/' || strftime(n.ts, '%Y/%m/') || sha256(body) || '.gz') END AS blob_key,
  CASE WHEN status = 304 THEN 0 ELSE strlen(body) END::BIGINT AS byte_size, CASE WHEN status = 304 THEN coalesce(n.etag, g.etag) ELSE n.etag END AS etag, status = 304 AND g.hash IS NULL AS dangling
FROM now n LEFT JOIN good g ON g.user_id = n.user_id LEFT JOIN stored s ON s.hash = CASE WHEN status = 304 THEN g.hash ELSE sha256(body) END""",
    "page_verdicts": """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'cf_mitigated_header' WHEN page_id % 4 = 2 THEN 'meta_refresh_consent' WHEN page_id % 4 = 3 AND 2 * (page_id % 200) < 200 THEN 'text_floor' END AS block,
  CASE WHEN page_id % 4 = 1 AND page_id % 9 > 0 THEN 'soft_404_title' END AS soft_404 FROM pages""",
    "source_chain": f"""WITH {_PARTS}, r AS (SELECT *, unnest(range(CASE five WHEN 1 THEN 2 ELSE 1 END))::INT AS row_ix FROM p),
c AS (SELECT *, five > 0 AND first <> '' AS in_a, five > 0 AND p_partkey % 3 > 0 AS priced, row_ix = 0 AS in_b FROM r)
SELECT p_partkey, row_ix, CASE WHEN in_a THEN first WHEN in_b THEN p_type END AS name, CASE WHEN in_a THEN 'a' WHEN in_b THEN 'b' END AS name_source,
  CASE WHEN priced THEN p_size WHEN in_b THEN p_size + 1 END::DOUBLE AS amount, CASE WHEN priced THEN 'EUR' WHEN in_b THEN 'USD' END AS currency, CASE WHEN priced THEN 'a' WHEN in_b THEN 'b' END AS price_source,
  substring(sha256(trim(p_brand || ' ' || coalesce(CASE WHEN in_a THEN first WHEN in_b THEN p_type END, ''))), 1, 16) AS key FROM c""",
    "optional_counts": "SELECT 'type' AS field, count(*) FILTER (p_partkey % 7 > 0 AND p_type IS NOT NULL) AS n FROM part UNION ALL SELECT 'size', count(p_size) FROM part",
    "gate_verdict": """WITH e AS (SELECT p_brand AS fixture, p_partkey AS ix, unnest([{'f': 'name', 'v': p_name}, {'f': 'type', 'v': CASE WHEN p_partkey % 7 > 0 THEN p_type END}, {'f': 'size', 'v': p_size::VARCHAR}], recursive := true) FROM part),
ok AS (SELECT count(*) FILTER (e.f = 'name' AND e.v IS DISTINCT FROM a.v) = 0 AS passed FROM e LEFT JOIN e a ON a.fixture = e.fixture AND a.ix = e.ix AND a.f = e.f)
SELECT 'fixtures' AS what, passed FROM ok UNION ALL SELECT 'baseline', passed AND (SELECT count(v) FROM e WHERE f = 'type') >= (SELECT count(p_type) FROM part) FROM ok""",
    "labels_missing": """SELECT label, replace(label, ':', '__') AS folder FROM (SELECT p_brand || ':' || p_size AS label FROM part WHERE p_brand <> 'Brand#1' EXCEPT SELECT p_brand || ':' || p_size FROM part WHERE p_retailprice > 1500)""",
    "safe_keys": "SELECT p_partkey, p_partkey % 8 IN (0, 5) AS safe FROM part",
}
