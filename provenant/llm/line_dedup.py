r"""Line dedup by content-defined chunks, with DataFrame functions only.

A text's lines are grouped into chunks. A chunk ends after a line where the rolling hash of this line and the
one before it, over the lines' own hashes, is in the lower half; so a passage is cut alike wherever it stands, and lines put
in front of it only change the chunks around the place. A line of ``LONG`` words and more is a chunk by itself:
it is a passage without line feeds. Chunks of at least two lines and ``LEAST`` words, or of one long line, that
occur more than once in the whole corpus are removed but for their first occurrence, after their bytes have been
compared.

Only hashes of chunks are shuffled for the count, and only texts in which something repeats are read again.

Chunks miss most passages of few short lines, as their borders seldom fall together with the passage's.
``passages`` and ``without_repeats`` have no chunks: they take every passage of at least two lines and ``LEAST``
words, or of one line of ``LONG`` words, that stood somewhere before. It is enough to look up, for each line, the
shortest such run that begins there and the shortest that ends there: both are inside any passage that has room
for them, and together they cover it. A line is a word at least, so such a run has at most ``LEAST`` lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import free_name, hold, keep_ids, with_values

#: Words that a line must have to be a chunk by itself, and that a chunk of several lines must have.
LONG, LEAST = 50, 20
#: Bytes that count as a word where there are no blanks: some ten characters of Chinese, Japanese or Thai.
WIDE = 30
#: Put before a line that begins a chunk; texts have a third character after each first one of their own.
_SIGN, _OWN, _WRITTEN = "\x01\x02", "\x01", "\x01\x03"


def _words(text: Column) -> Column:
    """Blank-separated words of a line or chunk, about: its blanks and line feeds, and one; or as many as ``WIDE`` bytes go into it, if that is more."""
    without = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    size = F.octet_length(text)
    return F.greatest(size - F.octet_length(without) + 1, F.floor(size / WIDE).cast("int"))


def _has_words(text: Column, least: Column | int) -> Column:
    """Whether there are so many words; short texts can't have them and aren't looked through."""
    return (F.octet_length(text) >= 2 * F.lit(least) - 1) & (_words(text) >= least)


def with_chunks(docs: DataFrame, to: str) -> DataFrame:
    """``docs`` with the chunks of ``text`` as an array; joined by line feeds they are the text again.

    Lines are looked at side by side with the two before them, as arrays that are shifted against each other:
    nothing here looks up an array from inside a loop over it, so long texts take linear time.
    """
    none = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit(False).alias("long")))
    rolled = lambda z: F.coalesce(F.md5(F.concat(z["_c"]["h"], z["_b"]["h"])) < "8", F.lit(False))
    cut = docs.withColumn("_lines", F.split("text", "\n", -1))
    cut = cut.withColumn("_a", F.transform("_lines", lambda x: F.struct(F.md5(x).alias("h"), _has_words(x, LONG).alias("long"))))
    cut = cut.withColumns({"_b": F.concat(none, "_a"), "_c": F.concat(none, none, "_a")})
    begins = F.transform(F.arrays_zip("_a", "_b", "_c"), lambda z: F.coalesce(z["_a"]["long"], F.lit(False)) | z["_b"]["long"] | rolled(z))
    begins = F.concat(F.array(F.lit(False)), F.slice(begins, F.lit(2), F.size("_lines")))
    written = lambda x: F.when(F.contains(x, F.lit(_OWN)), F.replace(x, F.lit(_OWN), F.lit(_WRITTEN))).otherwise(x)
    signed = F.zip_with("_lines", F.slice(begins, F.lit(1), F.size("_lines")), lambda x, b: F.when(b, F.concat(F.lit(_SIGN), written(x))).otherwise(written(x)))
    parts = F.split(F.array_join(signed, "\n"), f"\n{_SIGN}", -1)
    parts = F.when(F.contains("text", F.lit(_OWN)), F.transform(parts, lambda x: F.replace(x, F.lit(_WRITTEN), F.lit(_OWN)))).otherwise(parts)
    return cut.withColumn(to, parts).drop("_lines", "_a", "_b", "_c")


def _parts(docs: DataFrame, columns: list[str], least: int) -> DataFrame:
    """A row for each chunk that may be removed: ``columns``, its place, its hash and its text."""
    one = F.col("col")
    words = F.when(F.contains(one, F.lit("\n")), least).otherwise(LONG)
    parts = with_chunks(docs.select(*columns, "text"), "parts").select(*columns, F.posexplode("parts"))
    return parts.filter(_has_words(one, words)).select(*columns, "pos", F.md5("col").alias("hash"), F.col("col").alias("chunk"))


def repeated_chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, pos) of every chunk to remove from ``docs`` (doc_id, row, text), by its number in its text.

    The first occurrence is the one with the smallest doc_id (null last), row and place. Chunks whose hashes
    agree and whose bytes don't are not removed; nor are chunks of several lines with fewer than ``least`` words.
    """
    found = hold(_parts(docs, ["doc_id", "row"], least).select("doc_id", "row", "pos", "hash"), "op8-chunks")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "row", "pos")
    # partial sums: one row for each hash and task, however often a chunk occurs
    often = hold(found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "op8-repeated")
    again = hold(with_values(found, often, "hash").select("doc_id", "row", "pos", "hash", (place != F.col("first")).alias("later")), "op8-again")

    ids = hold(again.select("row").distinct(), "op8-rows")
    # what is read again is partitioned anew before it is grouped, so that a very common chunk is many partial rows
    same = keep_ids(_parts(keep_ids(docs, ids, "row"), ["row"], least), often, "hash")
    same = same.groupBy("hash", F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt")).agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    equal = same.groupBy("hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low = high").select("hash")
    return keep_ids(again.filter("later"), hold(equal, "op8-equal"), "hash").select("doc_id", "row", "pos")


def _runs(docs: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each shortest run of lines that may be removed: ``columns``, its first line, how many, its hash and text.

    Lines stand side by side with those after and before them, as arrays shifted against each other: linear time.
    """
    none = F.lit(None).cast("struct<x:string,w:int>")
    cut = docs.select(*columns, F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("x"), _words(x).cast("int").alias("w"))).alias("_0"))
    after, before = [f"_a{k}" for k in range(1, LEAST)], [f"_b{k}" for k in range(1, LEAST)]
    shifts = {c: F.slice("_0", F.lit(k), F.size("_0")) for k, c in enumerate(after, 2)} | {c: F.concat(F.array(*[none] * k), "_0") for k, c in enumerate(before, 1)}
    cut = cut.select(*columns, "_0", *[v.alias(c) for c, v in shifts.items()])

    def run(i: Column, lines: list[Column]) -> Column:
        whole = F.concat_ws("\n", *[z["x"] for z in lines])
        return F.struct(i.cast("int").alias("pos"), F.lit(len(lines)).alias("n"), whole.alias("text"))

    def shortest(z: Column, i: Column) -> Column:
        here = z["_0"]
        down, up = [here, *[z[c] for c in after]], [here, *[z[c] for c in before]]
        total = lambda lines: sum((x["w"] for x in lines[1:]), lines[0]["w"])
        begins = F.when(F.lit(False), run(i, [here]))
        # a run of two that ends here also begins where it begins, as does one too short without its last line
        ends = F.when(total(up[:2]) >= LEAST, F.lit(None))
        for k in range(2, LEAST + 1):
            begins = begins.when(total(down[:k]) >= LEAST, run(i, down[:k]))
            if k > 2:
                ends = ends.when(total(up[:k]) >= LEAST, F.when(total(up[1:k]) >= LEAST, run(i - (k - 1), up[:k][::-1])))
        alone = F.when(here["w"] >= LONG, run(i, [here]))
        return F.array(alone, begins, ends)

    runs = F.flatten(F.transform(F.arrays_zip("_0", *after, *before), shortest))
    runs = cut.select(*columns, F.explode(runs).alias("r")).filter("r is not null")
    return runs.select(*columns, "r.pos", "r.n", F.md5("r.text").alias("hash"), F.col("r.text").alias("run"))


def passages(docs: DataFrame) -> DataFrame:
    """(row, gone) for each row of ``docs`` (doc_id, row, text) that has lines to remove: their numbers, ascending.

    A line goes if it is in a run that occurs before, as in ``repeated_chunks``, and doesn't overlap that occurrence.
    So the first occurrence of whatever repeats stays whole unless it is itself made of earlier passages.
    """
    found = hold(_runs(docs, ["doc_id", "row"]).drop("run"), "op8-runs")
    often = hold(found.groupBy("hash").count().filter("count > 1").select("hash"), "op8-often")
    again = hold(keep_ids(found, often, "hash"), "op8-again")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), "row", "pos")

    ids = hold(again.select("row").distinct(), "op8-rows")
    same = keep_ids(_runs(keep_ids(docs, ids, "row"), ["row"]).select("hash", "run"), often, "hash")
    equal = hold(same.groupBy("hash").agg(F.min("run").alias("low"), F.max("run").alias("high")).filter("low = high").select("hash"), "op8-equal")
    first = hold(again.groupBy("hash").agg(F.min(place).alias("first")), "op8-first")
    over = (F.col("first.row") == F.col("row")) & (F.col("pos") < F.col("first.pos") + F.col("n"))
    later = with_values(keep_ids(again, equal, "hash"), first, "hash").filter((place != F.col("first")) & ~over)
    lines = later.select("row", F.explode(F.sequence("pos", F.expr("pos + n - 1"))).alias("pos")).distinct()
    return hold(lines.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "op8-lines")


def _without(parts: Column, gone: Column) -> Column:
    """An array without the places (from 0) in another, ascending one; in linear time."""
    # a mark for each place, made of the gaps between the numbers
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    marks = F.array_join(F.zip_with(gone, before, lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1"))), "")
    each = F.zip_with(parts, F.split(marks, ""), lambda x, m: F.struct(x.alias("x"), m.alias("m")))
    return F.transform(F.filter(each, lambda z: z["x"].isNotNull() & ~z["m"].eqNullSafe("1")), lambda z: z["x"])


def passage_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, row, removed, kept_text) for each row of ``docs`` that loses lines of repeated passages: how many, and what stays."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").filter("text is not null")
    gone = passages(keyed)
    touched = keep_ids(keyed, gone, "row").join(gone, "row")
    return touched.select("doc_id", "row", F.size("gone").alias("removed"), F.array_join(_without(F.split("text", "\n", -1), F.col("gone")), "\n").alias("kept_text"))


def _row(text: str = "text"):
    """Names a row by doc_id and text; rows that agree in both are one occurrence."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def line_dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, row, removed, kept_text) for each row of ``docs`` that loses chunks: how many, and what stays.

    Chunks of several lines go from ``least`` words on, single lines from ``LONG``. Null and empty texts have
    nothing to lose.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), "text").filter("text is not null")
    # a text has at most its own chunks in the list
    gone = hold(repeated_chunks(keyed, least).distinct().groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("gone")), "op8-gone")
    touched = with_chunks(keep_ids(keyed, gone, "row").join(gone, "row"), "parts")
    return touched.select("doc_id", "row", F.size("gone").alias("removed"), F.array_join(_without(F.col("parts"), F.col("gone")), "\n").alias("kept_text"))


def removals(docs: DataFrame, dedup: Callable[[DataFrame], DataFrame] = line_dedup) -> DataFrame:
    """(doc_id, removed, n_chars, text_md5) for each row: chunks or lines taken out, and length and digest of what stays.

    Null texts count as empty and lose nothing. Rows that agree in doc_id and text are one occurrence and lose
    alike; equal texts of different doc_ids are several. Rows without a doc_id are later than all others. Other
    columns are ignored; an empty table gives no rows.
    """
    lost = dedup(docs).select("row", "removed", F.length("kept_text").cast("long").alias("n_left"), F.md5("kept_text").alias("md5_left")).dropDuplicates(["row"])
    every = docs.select("doc_id", _row().alias("row"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    every = every.join(lost, "row", "left")
    return every.select("doc_id", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("n_left", "n").alias("n_chars"), F.coalesce("md5_left", "md5").alias("text_md5"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; no row is dropped. ``n_chars``, if there, is renewed.

    Nulls, empty texts and repeated rows are as in ``removals``; other columns are kept as they are, and an empty
    table stays empty.
    """
    row, kept = free_name(docs, "_row"), free_name(docs, "_kept")
    lost = hold(passage_dedup(docs).select(F.col("row").alias(row), F.col("kept_text").alias(kept)).dropDuplicates([row]), "op8-lost")
    keyed = docs.withColumn(row, _row())
    same = keep_ids(keyed, lost, row, "left_anti").select(*docs.columns)
    less = keep_ids(keyed, lost, row).join(lost, row).withColumn("text", F.col(kept))
    if "n_chars" in docs.columns:
        less = less.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(less.select(*docs.columns))
