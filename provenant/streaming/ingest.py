"""Responses as a stream: each batch becomes snapshots and new blobs, written to a folder of its own number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from provenant.functions.scalars import blob_key


def ingest(responses: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Writes the stream ``responses`` (url, fetched_at, http_status, body) below ``root``, as far as there is input now.

    Blobs are content-addressed: a body is stored once in a batch and left out if an earlier batch has it. A batch
    that is run again overwrites its own folders only.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        digest = F.sha2(F.col("body").cast("binary"), 256)
        rows = batch.filter("http_status is not null").withColumn("content_hash", digest)
        rows.select("url", "fetched_at", "http_status", "content_hash", blob_key(F.col("url"), F.col("fetched_at"), F.col("content_hash")).alias("blob_key"), F.octet_length("body").alias("byte_size")).write.mode("overwrite").parquet(f"{root}/snapshots/batch={number}")
        new = rows.filter("body is not null").select("content_hash", "body").dropDuplicates(["content_hash"])
        if number:
            stored = spark.read.schema("content_hash string, body string, batch long").parquet(f"{root}/blobs").filter(F.col("batch") < number)
            new = new.join(stored.select("content_hash"), "content_hash", "left_anti")
        new.write.mode("overwrite").parquet(f"{root}/blobs/batch={number}")

    return responses.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
