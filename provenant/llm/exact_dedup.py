"""Exact dedup as a stateful stream, with DataFrame functions only.

Each document's digest, identifier and content locator land in a folder, in parts; these are read as a stream, in
several batches. Spark's own keyed state holds, for each digest, the identifier that stays, where its content lies (file
and row), and how many rows had the digest. The state is on disk (RocksDB), has no watermark and so never expires, and is
kept in the shared folder: a lost executor's part is loaded again by another one, and a restarted stream takes in only new
files. A batch is reduced to one row for each digest and task before it is shuffled to its state.

Each batch hands on the digests that it changed. Those that have more than one row by then are hits: their whole
texts are compared byte by byte in the same batch, before it ends. Texts of one digest that differ, should there ever be
any, are grouped by text instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.llm.shared import hold, keep_ids, scratch_dir

_ENTRY = "digest string, keep struct<doc_id:bigint,file:string,row:bigint>, n bigint"
#: Batches that the files there are make, at least; each looks up what those before it have left in the state.
BATCHES = 4

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a store has few megabytes: none of them is to be set aside before, and all stores of an executor share one bound
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _rows(docs: DataFrame) -> DataFrame:
    """A row's identifier, digest and locator; null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text, 256).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _landed(spark: SparkSession, path: str, state_dir: str) -> str:
    """Adds the rows of files that are not there yet to the folder that the stream reads, in parts of at most a ``BATCHES``-th each."""
    folder = f"{state_dir}/landed"
    rows = _rows(spark.read.parquet(path))
    before = spark.createDataFrame([], rows.schema)
    try:
        before = spark.read.schema(rows.schema).parquet(folder)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows = rows.join(before.select("file").distinct(), "file", "left_anti").select(*rows.columns)
    total = rows.count()
    rows.write.mode("append").option("maxRecordsPerFile", str(max(1, -(-total // BATCHES)))).parquet(folder)
    return folder


def _apart(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests among ``hits`` (doc_id, digest) whose texts are not all the same bytes: low and high text, partial in each task."""
    ids = hold(hits.filter("doc_id is not null").select("doc_id").distinct(), "op10-ids")
    text = F.coalesce("text", F.lit("")).alias("text")
    wide = keep_ids(docs.filter("doc_id is not null").select("doc_id", text), ids, "doc_id").union(docs.filter("doc_id is null").select("doc_id", text))
    texts = wide.select(F.sha2("text", 256).alias("digest"), "text")
    return texts.groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).filter("low <> high").select("digest")


def digest_state(spark: SparkSession, path: str, state_dir: str, per_batch: int | None = None) -> DataFrame:
    """Runs the stream over all rows there are, and returns its state: (digest, keep, n).

    ``keep`` is (doc_id, file, row) of the row that stays: the largest doc_id; of equal ones the last row. Run
    again with the same ``state_dir`` it takes in only new files. Digests and locators land first, in as many parts as make
    ``BATCHES`` batches, however few files there are; ``per_batch`` sets the parts that a batch takes. A batch's hits, digests
    that have more than one row by then, are compared byte by byte within the batch; those whose texts differ are in
    the folder ``apart``. The state is what the batches handed on, of each digest the newest.
    """
    folder = _landed(spark, path, state_dir)
    rows = spark.read.parquet(folder)
    per_batch = per_batch or max(1, -(-len(rows.inputFiles()) // BATCHES))

    def save(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        changed = f"{state_dir}/changed/batch={number}"
        batch.write.mode("overwrite").parquet(changed)  # anew, if the batch is run again
        hits = own.read.parquet(changed).filter("n > 1").select("digest")
        if not hits.isEmpty():
            places = own.read.parquet(folder).join(hits.hint("merge"), "digest", "left_semi")
            _apart(own.read.parquet(path), places).write.mode("overwrite").parquet(f"{state_dir}/apart/batch={number}")

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", str(per_batch)).parquet(folder)
    state = stream.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    with _settings(spark, _STORE):
        run = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/stream").trigger(availableNow=True).foreachBatch(save).start()
        run.awaitTermination()
    changed = spark.read.schema(f"{_ENTRY}, batch bigint").parquet(f"{state_dir}/changed")
    return changed.groupBy("digest").agg(F.max_by("keep", "batch").alias("keep"), F.max("n").alias("n"))


def digests_apart(spark: SparkSession, state_dir: str) -> DataFrame:
    """(digest), each once, whose texts differ, as any batch found."""
    try:
        return spark.read.schema("digest string, batch bigint").parquet(f"{state_dir}/apart").select("digest").distinct()
    except AnalysisException as missing:  # no batch had a hit
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], "digest string")


def exact_dedup(spark: SparkSession, path: str, state_dir: str | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of the Parquet documents at ``path``.

    Texts are equal if their bytes are; null counts as empty. Of equal texts the row with the largest doc_id is
    kept, a null doc_id being the smallest; of rows that repeat it, one. Other columns are ignored. An empty table
    gives no rows.
    """
    state_dir = state_dir or f"{scratch_dir(spark)}/op10-{uuid.uuid4().hex}"
    docs = spark.read.parquet(path)
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string")
    state = hold(digest_state(spark, path, state_dir), "op10-state")
    rows = spark.read.parquet(f"{state_dir}/landed")
    apart = hold(digests_apart(spark, state_dir), "op10-apart")

    def result(rows: DataFrame, state: DataFrame) -> DataFrame:
        kept = (F.col("keep.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
        return rows.join(state, "digest").select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.col("digest").alias("text_sha256"))

    if apart.isEmpty():
        return result(rows, state)
    same = result(rows.join(apart, "digest", "left_anti"), state)
    full = docs.select("*", "_metadata.file_path", "_metadata.row_index").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.col("file_path").alias("file"), F.col("row_index").alias("row"), F.coalesce("text", F.lit("")).alias("text")).join(apart, "digest", "left_semi")
    groups = full.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    differ = full.join(groups, ["digest", "text"])
    kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return same.union(differ.select("doc_id", "keep.doc_id", "n", kept, "digest"))
