"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "provenant", master: str | None = None, **settings: str) -> SparkSession:
    """UTC and adaptive execution; ``settings`` with dots written as two underscores, e.g. spark__driver__memory."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
