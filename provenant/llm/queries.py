"""The queries of this subpackage, by name, and their SQL.

Each reads its whole table. What nulls, empty and very long texts, ties, repeated rows, empty tables and further columns
give stands at the operator that the query calls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import bit_sliced, divergence, exact_dedup, filter_audit, line_dedup, main_text, mixing, ngram_join, pseudonyms, sentencepieces, sharding, token_files, toxicity
from provenant.llm.shared import documents, scratch_dir


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(documents(spark, sf_dir), key="a key for tests; a real one is a secret of at least 128 bits")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_dir(spark)}/op9-{uuid.uuid4().hex}"
    return token_files.read(token_files.write(documents(spark, sf_dir), folder, tokenizer("word_bpe_49k.json"), end_id=2), digest=True)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(documents(spark, sf_dir))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pipeline's stage does; op8_line_dedup has the chunks of its SQL."""
    return line_dedup.removals(documents(spark, sf_dir), line_dedup.passage_dedup)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_toxicity": op4_toxicity,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_line_dedup": op8_line_dedup,
    "op8_passages": op8_passages,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_main_text": op12_main_text,
    "op13_divergence": op13_divergence,
}

SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q ON p.gram = q.gram AND p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * x.c >= 75 * (na.n + nb.n - x.c)
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.r AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS r FROM reach GROUP BY id) c ON c.id = d.doc_id
""",
    "op6_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(concat(coalesce(doc_id::VARCHAR, '-'), ':', md5(coalesce(text, '')))) AS key FROM documents
), each AS (
  SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM rows GROUP BY source
), levels AS (
  SELECT source, source_size, w, 3 * source_size AS bound, (3 * source_size)::DOUBLE / w AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM each
), target AS (
  SELECT source, source_size, least(bound::DOUBLE, (SELECT level FROM levels WHERE level * w <= bound ORDER BY ratio, source NULLS LAST LIMIT 1) * w) AS target FROM levels
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, sum(size) OVER (PARTITION BY r.source ORDER BY key)::BIGINT AS upto, sum(size) OVER (PARTITION BY r.source, key)::BIGINT AS peers,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 1 END AS turns
  FROM rows r JOIN target t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (turns + CASE WHEN 2 * (upto - peers) + peers <= 2 * (target - turns * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
""",
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i, x[i] AS line, greatest(length(x[i]) - length(translate(x[i], ' ', '')) + 1, strlen(x[i]) // 30) >= 50 AS long, md5(x[i]) AS h
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))
), marked AS (
  SELECT *, CASE WHEN i = 1 OR long OR lag(long) OVER w OR md5(lag(h, 2) OVER w || lag(h) OVER w) < '8' THEN 1 ELSE 0 END AS begins FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM marked
), chunks AS (
  SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n, any_value(long) AS long FROM numbered GROUP BY doc_id, pos
), judged AS (
  SELECT *, ((n > 1 AND greatest(length(chunk) - length(translate(chunk, ' ' || chr(10), '')) + 1, strlen(chunk) // 30) >= 20) OR (n = 1 AND long))
    AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) > 1 AS gone FROM chunks
), kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS removed, coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS t FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.removed, 0)::INT AS removed, length(coalesce(k.t, ''))::BIGINT AS n_chars, md5(coalesce(k.t, '')) AS text_md5 FROM documents d LEFT JOIN kept k USING (doc_id)
""",
    "op10_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op3_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored
) WHERE rank <= 5
""",
    "op11_filter_audit": r"""
WITH RECURSIVE orders AS (
  SELECT '' AS o UNION ALL SELECT o || l.c FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) l WHERE NOT contains(o, l.c)
), w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), flags AS (
  SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
  FROM w
), masks AS (
  SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS mask,
    count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM flags GROUP BY ALL
), steps AS (
  SELECT o, s, o[s] AS f, o[1:s - 1] AS earlier FROM orders, range(1, 6) t(s) WHERE len(o) = 5
), seen AS (
  SELECT part, o, s, f, mask, n, good, toxic, contains(mask, f) AS fails, mask <> translate(mask, earlier, '') AS gone FROM steps, masks
), each AS (
  SELECT part, o AS filter_order, s::INT AS step, f, sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed, sum(n) FILTER (WHERE fails AND gone) AS redundant,
    sum(n) FILTER (WHERE mask = f) AS unique_fails, sum(good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fails AND NOT gone) AS toxic_lost FROM seen GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM each
""",
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), words AS (
  SELECT r, lang, source, unnest(ts) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.total, s.v, s.n AS all_n, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v)::HUGEINT) AS p, (1 + (1000000000::HUGEINT * (total + 2)) // (all_n + 2 * v)) AS q FROM dense
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE c > 0 AND p > q
), parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "binary") AS rank FROM parts
) WHERE part = 'pair' OR rank <= 10
""",
}
