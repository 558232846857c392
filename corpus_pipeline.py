"""Toxicity, line dedup, near copies, mixing and encoding, one after the other over a whole corpus.

Each stage takes the documents that the one before it kept and returns a table with the same columns; the last
returns the encoded documents. Between stages the documents are a Parquet table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from provenant.llm import line_dedup, mixing, ngram_join, sentencepieces, toxicity
from provenant.llm.shared import hold

#: Rows and bytes that go to Python at a time while a stage runs, so that long texts don't fill an executor beside its heap.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def _bounded(name: str | None = None) -> Callable:
    """A stage that runs while ``BATCHES`` are set; then the session's settings are as they were.

    With a ``name`` the stage's result is held in that time, too, as it is made by Python; without, only what the stage itself runs is.
    """

    def wrap(function: Callable) -> Callable:
        @wraps(function)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            before = {key: spark.conf.get(key, None) for key in BATCHES}
            try:
                for key, value in BATCHES.items():
                    spark.conf.set(key, value)
                out = function(spark, docs, sf_dir)
                return hold(out, f"pipeline-{name}") if name else out
            finally:
                for key, value in before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)

        run.held = bool(name)
        return run

    return wrap


@_bounded("toxicity")
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; null and empty texts, repeated rows and further columns are as in ``without_toxic``."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go from the texts, but for their first occurrence; every document stays, null and empty texts as they are."""
    return line_dedup.without_repeats(docs)


@_bounded()
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; null, empty and blank texts all stay."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives words by its weight; documents come as often as the mix takes them. A null source is one, too; rows without words come as their place says."""
    return mixing.mixed(docs)


@_bounded("encoding")
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row (doc_id, n_tokens, ids_sha256, decoded_sha256) for each document of the mix; null counts as empty, an empty table gives no rows."""
    import public_tokenizers

    return sentencepieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Learned scores and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result held before the next stage reads it; the rows of the last one.

    Null and empty texts, repeated rows and further columns are as each stage says; no documents give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if not getattr(stage, "held", False):
            docs = hold(docs, f"pipeline-{name}")
    return docs
