"""Discovery: the URLs of a run, in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.held import held
from provenant.operators.extract import with_links

#: Pages of the first batch of a walk.
FIRST_BATCH = 16


def _capped(urls: DataFrame, order: list[str], most: int | None) -> DataFrame:
    first = urls.groupBy("url").agg(F.min(F.struct(*order)).alias("o"))
    ordered = first.select("url", "o.*").orderBy(*order)
    return ordered if most is None else ordered.limit(most)


def seed_list(seeds: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """(url, seq) of ``seeds`` (url, seq): each once, at its first place, those that the pattern finds, at most ``most``."""
    return _capped(seeds.filter(F.col("url").rlike(pattern)).select("url", "seq"), ["seq"], most)


@dataclass(frozen=True)
class Walk:
    """The links of a walk (url, n, pos), where it stopped (no page from there on was walked), and how many pages were parsed."""

    urls: DataFrame
    stop: int | None
    pages_parsed: int


def walk(index_pages: DataFrame, selector: str, pattern: str, most: int | None = None, pages_walked: int | None = 5000, start: int | None = None) -> Walk:
    """Walks over ``index_pages`` (n, url, http_status, html), page by page; see ``paginate``.

    Pages are parsed in batches that double, so that no more than twice the pages walked, and ``FIRST_BATCH``, are ever
    parsed. Links of earlier batches are held, and what a batch brings is what they don't have. A link on every
    page is a partial minimum, never a group in one task.
    """
    if "allowed" in index_pages.columns:
        index_pages = index_pages.withColumn("http_status", F.when(F.coalesce("allowed", F.lit(True)), F.col("http_status")).otherwise(403))
    pages = index_pages.select("n", "url", "http_status", "html")
    if start is None:
        start = pages.agg(F.min("n")).first()[0]
    seen: DataFrame | None = None
    at, size, parsed, found, stop = start, FIRST_BATCH, 0, 0, start
    while at is not None and (pages_walked is None or at < start + pages_walked) and (most is None or found < most):
        to = at + size if pages_walked is None else min(at + size, start + pages_walked)
        batch = pages.filter((F.col("n") >= at) & (F.col("n") < to))
        good = F.col("http_status").between(200, 299)
        here = with_links(batch.filter(good), selector).select("n", F.posexplode("links").alias("pos", "url")).filter(F.col("url").rlike(pattern))
        first = here.groupBy("url").agg(F.min(F.struct("n", "pos")).alias("o")).select("url", "o.*")
        if seen is not None:
            first = first.join(seen, "url", "left_anti")
        first = held(first, "walk")
        bad = batch.filter(~F.coalesce(good, F.lit(False))).select("n")
        ok = first.select("n").distinct().join(bad, "n", "left_anti")
        # the first page that is missing, no success, or brings nothing: where the run of good ones from ``at`` on ends
        ends = ok.select((F.col("n") + 1).alias("n")).join(ok, "n", "left_anti").agg(F.min("n").alias("end"))
        end, begins = ends.crossJoin(ok.agg(F.min("n").alias("begins"))).first()  # one row each
        parsed += batch.filter(good).count()
        stop = at if begins != at else end
        first = first.filter(F.col("n") < stop)
        found += first.count() if most is not None else 0
        seen = first if seen is None else seen.union(first)
        if stop < to:
            break
        at, size = to, 2 * size
    empty = pages.select("url", "n", F.lit(0).alias("pos")).limit(0)
    return Walk(_capped(seen if seen is not None else empty, ["n", "pos"], most), stop, parsed)


def paginate(index_pages: DataFrame, selector: str, pattern: str, most: int | None = None, pages_walked: int | None = 5000, start: int | None = None) -> DataFrame:
    """(url, n, pos): links of ``index_pages`` (n, url, http_status, html), page by page.

    The walk begins at page ``start``, the first there is by itself, and goes over at most ``pages_walked`` pages. It
    ends before the first page that is missing, no success, refused by robots (``allowed`` is false, if there is
    such a column) or brings no new link. A link counts where it is first seen. A null page has no links, null
    numbers are no pages, and rows that repeat are one page.
    """
    return walk(index_pages, selector, pattern, most, pages_walked, start).urls


def run_cap(limit: int | None, max_urls: int | None) -> int | None:
    """URLs that a run may visit: the smaller bound; a limit of 0 alone is none."""
    if limit and max_urls is not None:
        return min(limit, max_urls)
    if limit is not None and max_urls is not None:
        return min(limit, max_urls)
    return limit or max_urls


def sitemap(*_: object) -> DataFrame:
    raise NotImplementedError("sitemap discovery")


STRATEGIES = {"seed_list": seed_list, "pagination": paginate, "sitemap": sitemap, "api": sitemap}
