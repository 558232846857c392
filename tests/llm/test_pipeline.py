"""The pipeline: each stage on nasty rows, the whole on a small and on an empty folder of tables."""

import hashlib
from array import array
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_operators import SCHEMA, grams, rows

from provenant.llm import line_dedup, mixing, toxicity

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module", params=["full", "empty"])
def folder(request, spark, tmp_path_factory):
    home = tmp_path_factory.mktemp(request.param)
    some = rows() if request.param == "full" else []
    spark.createDataFrame(some, SCHEMA).repartition(3).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 9 == 0)) for i in range(60)][: len(some)], LABELS).write.parquet(f"{home}/labels.parquet")
    return str(home)


def test_stages_are_those_named():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "mixing", "encoding"]


def test_each_stage_works_on_what_the_one_before_kept(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    key = lambda r: (r.doc_id, r.text, r.source)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        if name == "toxicity":
            model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
            bad = {(r.doc_id, r.text) for r in toxicity.score(docs.select("doc_id", "text"), model).filter(F.col("score") >= 0.7).collect()}
            assert Counter(map(key, after)) == Counter(key(r) for r in before if (r.doc_id, r.text) not in bad)
        elif name == "line_dedup":
            assert sorted(str((r.doc_id, r.source)) for r in after) == sorted(str((r.doc_id, r.source)) for r in before)
            left = {(r.doc_id, r.row): r.kept_text for r in line_dedup.passage_dedup(docs).collect()}
            assert len({r.text for r in after} - {r.text for r in before} - set(left.values())) == 0
        elif name == "near_copies":
            kept = [grams(r.text) for r in after if r.doc_id is not None]
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and not out.columns != docs.columns
            alike = lambda s, t: bool(s and t) and 100 * len(s & t) >= 75 * len(s | t)
            gone = [r for r in before if r.doc_id not in {x.doc_id for x in after}]
            assert not any(alike(s, t) for i, s in enumerate(kept) for t in kept[:i] if s is not t and s != t)
            assert all(any(alike(grams(r.text), grams(x.text)) for x in before if x.doc_id is not None and x.doc_id < r.doc_id) for r in gone)
        elif name == "mixing":
            copies = {(r.doc_id, r.key, r.src): r.copies for r in mixing.mix(docs).collect()}
            want = Counter()
            for r in docs.withColumns({"_k": mixing.row_key(), "_s": mixing.source_name()}).collect():
                want[key(r)] += copies[r.doc_id, r["_k"], r["_s"]]
            assert Counter(map(key, after)) == +want
        else:
            lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = Counter()
            for r in before:
                ids = [1, *lib.encode(r.text or ""), 2]
                want[r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()] += 1
            assert Counter(map(tuple, after)) == want
        if name != "encoding":
            assert out.columns == docs.columns
        docs = out


def test_the_whole_runs(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert (out.count() > 0) == (spark.read.parquet(f"{folder}/documents.parquet").count() > 0)
