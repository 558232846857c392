"""Queries about pages: discovery, extraction, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import markup, scalars
from provenant.operators import detect, discovery, extract, responses
from provenant.plans.runs import table


def seed_list_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs without their query as seeds, so that some repeat."""
    seeds = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), F.col("page_id").alias("seq"))
    return discovery.seed_list(seeds, r"^https?://[^/]+/(en|fr)/")


def paginate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in the navigation of the pages, walked by page id until a page brings nothing new."""
    index = table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), "url", F.lit(200).alias("http_status"), "html")
    return discovery.paginate(index, "nav li a", ".", pages_walked=None)


def css_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and heading of each page."""
    rows = extract.css(table(spark, sf_dir, "pages"), {"title": "title", "h1": "article > h1", "lang": "html@lang"})
    return rows.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.title", "r.h1", "r.lang")


def css_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each navigation link."""
    rows = extract.css(table(spark, sf_dir, "pages"), {"href": "a@href", "text": "a"}, row_selector="nav li")
    return rows.select("page_id", F.posexplode("rows").alias("pos", "r")).select("page_id", "pos", "r.href", "r.text")


def extract_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields from the sixth link of a menu, if a page has one, else from its heading; with what made them."""
    pages = extract.scanned(table(spark, sf_dir, "pages"), {"promo": markup.Rows({"text": "nav ul > li:nth-child(6) a"}), "page": markup.Rows({"text": "article h1", "lang": "html@lang"})})
    rows = extract.one_row_each(pages, ["promo", "page"], ["page_id"])
    return extract.chain(rows, ["promo", "page"], {"text": ["strip"], "lang": []}, ["page_id", "row_ix"])


def _augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with data of their own: an assignment, a JSON-LD block, or the marks of a block or an error page."""
    key = F.col("page_id")
    name = F.concat(F.lit("p"), key)
    script = F.concat(F.lit('<script>var data = [{"text":"a; b ]","author":{"name":"'), name, F.lit('"},"tags":["x","y"]},{"text":"c","author":{"name":"z"}}]; f();</script>'))
    linked = F.concat(F.lit('<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"Product","name":"'), name, F.lit('","offers":{"price":"9.5"}}]}</script>'))
    marks = F.element_at(F.array(F.lit('<div id="onetrust-consent-sdk"></div>'), F.lit("<p>Just a moment...</p>"), F.lit("Reference #7"), F.lit(""), F.lit('<div class="x error-404"></div>'), F.lit("the page could not be found")), (key % 6 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", script, linked, marks).alias("html"), F.when(key % 12 == 4, 404).otherwise(200).alias("http_status"))


def inline_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.embedded_json(_augmented(spark, sf_dir), {"text": "text", "author": "$.author.name", "tags": "tags[*]"}, variable="data")
    return rows.select("page_id", F.posexplode("rows").alias("pos", "r")).select("page_id", "pos", F.col("r")["text"].alias("text"), F.col("r")["author"].alias("author"), F.col("r")["tags"].alias("tags"))


def jsonld_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.linked_data(_augmented(spark, sf_dir), "Product", {"name": "name", "price": "offers.price"})
    return rows.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.name", "r.price")


def block_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_augmented(spark, sf_dir)).filter("block is not null and block <> 'text_floor'").select("page_id", "block")


def soft_404(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(_augmented(spark, sf_dir)).filter("soft_404 is not null").select("page_id", "soft_404")


def strip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce(scalars.strip_text(F.col("text")), F.lit("")), 256).alias("digest"))


def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys as status codes."""
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 204, 301, 304, 403, 404, 429, 500, 503)]), (F.col("o_orderkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", responses.fetch_outcome(status).alias("outcome"))


def retry_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its attempts."""
    line = table(spark, sf_dir, "lineitem")
    attempts = line.groupBy(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("attempt")).agg(F.max("l_quantity").alias("q"))
    status = F.when(F.col("q") > 30, 503).when(F.col("q") > 25, None).when(F.col("q") > 20, 404).otherwise(200)
    return responses.last_attempts(attempts.withColumn("http_status", status)).select("request_id", "attempt", "http_status")


def endpoint_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = extract.endpoint(F.col("url"), "https://api.example.com/items?page={page}&from={ref}", {"q": "a b&c"})
    return table(spark, sf_dir, "pages").select("page_id", url.alias("endpoint"))


QUERIES = {f.__name__: f for f in (seed_list_urls, paginate_links, css_fields, css_rows, extract_chain, inline_json_rows, jsonld_first, block_detect, soft_404, strip_text, fetch_outcome, retry_attempts, endpoint_urls)}

#: The pages of ``_augmented`` once more.
_PAGES = """a AS (
  SELECT page_id, CASE WHEN page_id % 12 = 4 THEN 404 ELSE 200 END AS status,
    '<script>var data = [{"text":"a; b ]","author":{"name":"p' || page_id || '"},"tags":["x","y"]},{"text":"c","author":{"name":"z"}}]; f();</script>' AS script,
    '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"Product","name":"p' || page_id || '","offers":{"price":"9.5"}}]}</script>' AS linked,
    html, ['<div id="onetrust-consent-sdk"></div>', '<p>Just a moment...</p>', 'Reference #7', '', '<div class="x error-404"></div>', 'the page could not be found'][(page_id % 6)::INT + 1] AS marks FROM pages
), p AS (SELECT *, html || script || linked || marks AS whole FROM a)"""
SQL = {
    "seed_list_urls": """SELECT url, min(page_id) AS seq FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages) WHERE regexp_matches(url, '^https?://[^/]+/(en|fr)/') GROUP BY url""",
    "paginate_links": """WITH m AS (SELECT page_id, url, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="([^"]+)"', 1) AS x FROM pages),
l AS (SELECT page_id AS n, i - 1 AS pos, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) || x[i] AS url FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM m)),
first AS (SELECT url, n, pos FROM l QUALIFY row_number() OVER (PARTITION BY url ORDER BY n, pos) = 1),
ends AS (SELECT min(n) AS stop FROM (SELECT page_id AS n FROM pages WHERE page_id NOT IN (SELECT n FROM first) UNION ALL SELECT page_id + 1 FROM pages WHERE page_id + 1 NOT IN (SELECT page_id FROM pages)))
SELECT url, n, pos::INT AS pos FROM first, ends WHERE n < stop""",
    "css_fields": """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '<article><h1>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang FROM pages""",
    "extract_chain": """WITH p AS (
  SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<article><h1>(.*?)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS h1, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
    regexp_extract(regexp_extract(html, '<nav>(.*?)</nav>', 1), '^<ul>(?:<li>.*?</li>){5}<li><a href="[^"]*">(.*?)</a>', 1) AS sixth FROM pages)
SELECT page_id, 0 AS row_ix, coalesce(nullif(sixth, ''), nullif(h1, '')) AS text, CASE WHEN sixth <> '' THEN 'promo' WHEN h1 <> '' THEN 'page' END AS text_source, nullif(lang, '') AS lang, CASE WHEN lang <> '' THEN 'page' END AS lang_source FROM p""",
    "css_rows": """SELECT page_id, i - 1 AS pos, regexp_extract(m[i], 'href="([^"]*)"', 1) AS href, regexp_extract(m[i], '>([^<]*)</a>', 1) AS text
FROM (SELECT page_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a .*?</a></li>') AS m FROM pages))""",
    "inline_json_rows": f"""WITH {_PAGES}, r AS (SELECT page_id, json_extract(regexp_extract(whole, '<script>[^<]*var data = (\\[.*\\]); f', 1), '$[*]') AS r FROM p), e AS (SELECT page_id, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS pos FROM r)
SELECT page_id, pos::INT AS pos, json_extract_string(x, '$.text') AS text, json_extract_string(x, '$.author.name') AS author, json_extract(x, '$.tags')::VARCHAR AS tags FROM e""",
    "jsonld_first": f"""WITH {_PAGES}, s AS (SELECT page_id, unnest(regexp_extract_all(whole, '<script type="application/ld\\+json">(.*?)</script>', 1)) AS j FROM p),
o AS (SELECT page_id, list_filter(json_extract(j, '$."@graph"[*]'), lambda x: json_extract_string(x, '$."@type"') = 'Product')[1] AS x FROM s WHERE json_valid(j))
SELECT page_id, json_extract_string(x, '$.name') AS name, json_extract_string(x, '$.offers.price') AS price FROM o WHERE x IS NOT NULL""",
    "block_detect": f"""WITH {_PAGES}, h AS (
  SELECT page_id, CASE WHEN contains(whole, 'id="onetrust-consent-sdk"') THEN 'onetrust_cmp' WHEN contains(whole, 'id="usercentrics-root"') THEN 'usercentrics_cmp' WHEN contains(whole, 'id="didomi-host"') THEN 'didomi_cmp' WHEN regexp_matches(whole, 'class="([^"]* )?cmp-container[ "]') THEN 'generic_cmp'
    WHEN contains(whole, 'cf-browser-verification') THEN 'cloudflare_challenge' WHEN contains(whole, 'Just a moment...') THEN 'cloudflare_just_a_moment' WHEN contains(whole, '_Incapsula_Resource') THEN 'incapsula' WHEN regexp_matches(whole, 'Reference #[0-9]') THEN 'reference_id'
    WHEN contains(whole, 'hcaptcha.com') THEN 'hcaptcha' WHEN contains(whole, 'google.com/recaptcha') THEN 'recaptcha' END AS block FROM p
) SELECT * FROM h WHERE block IS NOT NULL""",
    "soft_404": f"""WITH {_PAGES}, h AS (
  SELECT page_id, CASE WHEN regexp_matches(regexp_extract(whole, '<title>(.*?)</title>', 1), '(?i)\\b404\\b|not found|page not found') THEN 'soft_404_title'
    WHEN regexp_matches(whole, '(?i)page (you requested |you were looking for )?(could not|couldn''t|cannot|can''t) be found') THEN 'soft_404_body_not_found' WHEN regexp_matches(whole, 'class="([^"]* )?error-404[ "]') THEN 'soft_404_error_container' END AS soft_404 FROM p WHERE status = 200
) SELECT * FROM h WHERE soft_404 IS NOT NULL""",
    "fetch_outcome": "SELECT o_orderkey, CASE o_orderkey % 9 WHEN 3 THEN 'not_modified' WHEN 4 THEN 'rate_limited' WHEN 5 THEN 'not_found' WHEN 6 THEN 'rate_limited' WHEN 7 THEN 'error' WHEN 8 THEN 'error' ELSE 'ok' END AS outcome FROM orders",
    "retry_attempts": """WITH a AS (SELECT l_orderkey AS request_id, l_linenumber AS attempt, max(l_quantity) AS q FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN q > 30 THEN 503 WHEN q > 25 THEN NULL WHEN q > 20 THEN 404 ELSE 200 END AS http_status, q > 25 AS passing FROM a)
SELECT request_id, attempt, http_status FROM s QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY passing, CASE WHEN passing THEN -attempt ELSE attempt END) = 1""",
    "endpoint_urls": """SELECT page_id, 'https://api.example.com/items?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) || '&from=' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) || '&q=a+b%26c' AS endpoint FROM pages""",
}
