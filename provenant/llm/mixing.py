"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Rows of a source are thought of as sorted by key; the mix takes a source from
its start as often as its target asks, whole documents each time, and cuts the last turn where the running word
count comes nearest to the target. The running counts are distributed: keys fall into 16 ** ``DIGITS`` equal ranges,
sums by source and range give each range its offset, and only inside a range are rows sorted. So a source with a
third of all rows is thousands of small sorts, not one large one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.shared import WORD, free_name, hold

#: Weights of sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A source is repeated up to so many times.
MOST = 3
#: Leading hex digits of a key that make a range: 16**3 ranges.
DIGITS = 3


def row_key(text: str = "text"):
    """A key by hash; rows share one only if they agree in doc_id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce(F.col(text), F.lit("")))))


def source_name(source: str = "source"):
    """A source as a string that is never null; "0" goes before "1", so null comes last."""
    return F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, target): what each source is to give of all words.

    All sources together give as many words as they have. Shares go by weight; none is above ``MOST`` times its
    source's size, and what is cut off goes to the others by weight. That is one water level: with sources
    sorted by bound / weight, the first at which (words left) / (weights left) fits under its own bound.
    """
    each = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    each = each.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))).cast("int") + 1))
    each = each.withColumn("bound", MOST * F.col("source_size"))
    rising = Window.orderBy(F.col("bound") / F.col("w"), "src")
    each = each.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("bound").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = each.withColumn("level", F.col("left") / F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
    fits = F.when(F.col("level") * F.col("w") <= F.col("bound"), F.struct(F.col("bound") / F.col("w"), "src", "level"))
    level = F.min(fits).over(Window.partitionBy()).getField("level")
    return each.select("src", "source_size", F.least(F.col("bound").cast("double"), level * F.col("w")).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, src, key, size, source_size, target, taken, copies) for each row of ``docs`` (doc_id, text, source).

    Sizes are words of non-white-space; null texts have none. Sources go by code point, null last, and a null
    source is a source of its own. ``copies`` is how often the row is in the mix and ``taken`` its words there.
    Rows that agree in doc_id, source and text stand at one place and are taken together. Rows without words are
    taken as those with words at their place are, but never more than ``MOST`` times. Reruns agree, since keys hang
    on nothing but the row. Other columns are ignored; an empty table gives no rows.
    """
    src = source_name()
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("doc_id", src.alias("src"), words.alias("size"), row_key().alias("key"))
    rows = hold(rows.withColumn("range", F.substring("key", 1, DIGITS)), "op6-sizes")

    ranges = rows.groupBy("src", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets(rows), "src")
    ranges = hold(ranges.drop("words"), "op6-ranges")

    own = Window.partitionBy("src", "range")
    rows = rows.withColumn("to", F.sum("size").over(own.orderBy("key"))).withColumn("peers", F.sum("size").over(Window.partitionBy("src", "range", "key")))
    rows = rows.join(ranges, ["src", "range"])
    turns = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1))
    rest = F.col("target") - F.col("turns") * F.col("source_size")
    start = F.col("offset") + F.col("to") - F.col("peers")
    copies = F.least(F.col("turns") + F.when(2 * start + F.col("peers") <= 2 * rest, 1).otherwise(0), F.lit(MOST))
    rows = rows.withColumn("turns", turns.cast("long")).withColumn("copies", copies)
    return rows.select("doc_id", "src", "key", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: a row for each copy, none for rows that are not taken.

    Nulls in any column, empty texts and repeated rows are as in ``mix``: each row, by its doc_id, text and source,
    comes as often as it has copies there. Other columns are kept as they are; an empty table stays empty.
    """
    own = {n: free_name(docs, n) for n in ("_key", "_src", "_copies", "_copy")}
    # a row for each place of a source; rows that stand there are taken alike
    copies = mix(docs).groupBy(F.col("key").alias(own["_key"]), F.col("src").alias(own["_src"])).agg(F.max("copies").cast("int").alias(own["_copies"]))
    copies = hold(copies.filter(F.col(own["_copies"]) > 0), "op6-copies")
    taken = docs.withColumns({own["_key"]: row_key(), own["_src"]: source_name()}).join(copies, [own["_key"], own["_src"]])
    return taken.withColumn(own["_copy"], F.explode(F.sequence(F.lit(1), F.col(own["_copies"])))).select(*docs.columns)
