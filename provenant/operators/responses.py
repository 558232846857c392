"""Decisions over a table of web responses: outcome, retries, throttling, schedule, encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from provenant.functions.scalars import registrable_domain

MOST_WAIT = 300.0
TRANSIENT = (502, 503, 504)


def fetch_outcome(status: Column) -> Column:
    return F.when(status == 304, "not_modified").when(status == 404, "not_found").when(status.isin(403, 429), "rate_limited").when(status.between(200, 399), "ok").otherwise("error")


def page_use(status: Column, unchanged: Column, allowed: Column | None = None) -> Column:
    """What a run does with a page: ``extract``, ``skip`` if it has not changed, ``refused`` by robots, or ``partial_failure`` for any status but 200 and 304."""
    refused = ~allowed if allowed is not None else F.lit(False)
    return F.when(refused, "refused").when(~F.coalesce(status.isin(200, 304), F.lit(False)), "partial_failure").when(unchanged, "skip").otherwise("extract")


def retry_after(header: Column, now: Column) -> Column:
    """Seconds to wait: digits, or an HTTP date; 1 without a header that can be read, never below 0 or above 300."""
    date = F.try_to_timestamp(F.regexp_replace(F.trim(header), "^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))
    seconds = F.when(F.trim(header).rlike("^[0-9]+$"), F.trim(header).try_cast("double")).otherwise((F.unix_micros(date) - F.unix_micros(now)) / 1e6)
    return F.greatest(F.lit(0.0), F.least(F.lit(MOST_WAIT), F.coalesce(seconds, F.lit(1.0))))


def last_attempts(attempts: DataFrame, most: int = 3) -> DataFrame:
    """Of each request (request_id, attempt, http_status, ...) the attempt that counts: the first that is no passing failure, or the last of ``most``."""
    passing = F.col("http_status").isNull() | F.col("http_status").isin(*TRANSIENT)
    order = Window.partitionBy("request_id").orderBy(passing, F.when(passing, -F.col("attempt")).otherwise(F.col("attempt")))
    return attempts.filter(F.col("attempt") <= most).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def schedule(requests: DataFrame, url: str, seq: str, rps: float, crawl_delay: Column | None = None) -> DataFrame:
    """``requests`` with ``starts_after``: seconds from the start, one request of a host at a time by its interval."""
    interval = F.greatest(F.lit(1 / rps), F.coalesce(crawl_delay, F.lit(0.0))) if crawl_delay is not None else F.lit(1 / rps)
    turn = F.row_number().over(Window.partitionBy(registrable_domain(F.col(url))).orderBy(seq))
    return requests.withColumn("starts_after", (turn - 1) * interval)


def host_intervals(responses: DataFrame, now: Column, rps: float, policies: DataFrame | None = None) -> DataFrame:
    """(host, interval): seconds between requests to each host after ``responses`` (url, http_status, retry_after).

    The least is 1 / ``rps``; a crawl delay of the host's robots (``policies``: origin, crawl_delay) raises it, and so does the longest
    wait that a throttled answer asked for.
    """
    host = registrable_domain(F.col("url"))
    wait = F.when(F.col("http_status").isin(403, 429), retry_after(F.col("retry_after"), now))
    out = responses.groupBy(host.alias("host")).agg(F.max(wait).alias("_wait"))
    if policies is not None:
        out = out.join(policies.groupBy(registrable_domain(F.col("origin")).alias("host")).agg(F.max("crawl_delay").alias("_delay")), "host", "left")
    return out.select("host", F.greatest(F.lit(1 / rps), *[c for c in ("_wait", "_delay") if c in out.columns]).alias("interval"))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def is_json(content_type: Column) -> Column:
    kind = media_type(content_type)
    return F.coalesce(kind.isin("application/json", "text/json") | kind.endswith("+json"), F.lit(False))


def encoding(body: Column, content_type: Column) -> Column:
    """BOM, then the header's charset, then the document's own, else utf-8; in lower case."""
    head = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    first = F.hex(F.substring(body, 1, 3))
    charset = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", 1)), F.lit(""))
    in_meta = F.nullif(F.lower(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([A-Za-z0-9._:-]+)", 1)), F.lit(""))
    return F.when(first == "EFBBBF", "utf-8").when(F.substring(first, 1, 4).isin("FFFE", "FEFF"), "utf-16").otherwise(F.coalesce(charset(content_type), in_meta, F.lit("utf-8")))


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, name: pd.Series) -> pd.Series:
    """Bytes as text; what an encoding lacks is replaced, an unknown encoding is utf-8."""

    def one(b: bytes | None, n: str) -> str | None:
        if b is None:
            return None
        try:
            return bytes(b).decode(n, "replace").removeprefix("﻿")
        except LookupError:
            return bytes(b).decode("utf-8", "replace")

    return pd.Series([one(b, n) for b, n in zip(body, name, strict=True)])


__all__ = ["decoded", "encoding", "fetch_outcome", "host_intervals", "is_json", "last_attempts", "media_type", "page_use", "retry_after", "schedule"]
