"""Golden fixtures on disk: a folder each, with meta.json, expected.json and page.html.gz."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """(label, folder, expected, html) of each fixture below ``root``; folders whose meta.json names no golden_label are left out.

    Files are read by tasks, gzip included; a fixture without a page or expectation has null there.
    """

    def files(name: str, to: str) -> DataFrame:
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
        return read.select(F.regexp_replace("_metadata.file_path", "/[^/]+$", "").alias("folder"), F.col("value").alias(to))

    labelled = files("meta.json", "meta").withColumn("label", F.get_json_object("meta", "$.golden_label")).filter("label is not null")
    return labelled.join(files("expected.json", "expected"), "folder", "left").join(files("page.html.gz", "html"), "folder", "left").select("label", "folder", "expected", "html")
