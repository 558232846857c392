"""Shards of nearly equal bytes by minimax contiguous partition.

Equal texts are one atomic group; groups stand in the order of their digests. The smallest capacity is searched
at which cutting greedily, as late as the capacity allows, needs no more than the wanted shards; there it is cut.

The driver never sees the groups. It works on weights of digest prefixes, at first 4096 of them. A capacity found
for whole prefixes bounds the exact one from above, the mean and the heaviest group bound it from below; so each
cut is known to be in a short stretch of prefixes, and only these are split further by two more digits, again and
again, until the stretches consist of single groups. Then the search is exact. A round has some thousand weights,
however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.shared import free_name, hold

SHARDS = 8
_DIGITS = 3  # of the first prefixes: 16**3
_CELL = 10_000  # rows of a cell in which slots are numbered, about


def greedy(prefix: list[int], capacity: int, shards: int) -> list[int] | None:
    """Cuts (numbers of atoms before each next shard) with at most ``capacity`` a shard; None if it needs more shards.

    ``prefix`` are the running sums of the atoms' weights, with a leading 0.
    """
    cuts, at = [], 0
    while at < len(prefix) - 1:
        to = bisect_right(prefix, prefix[at] + capacity) - 1
        if to == at or len(cuts) == shards:
            return None
        cuts.append(to)
        at = to
    return cuts[:-1]


def smallest_capacity(weights: list[int], shards: int, low: int) -> int:
    """The smallest capacity from ``low`` on that greedy cuts keep to."""
    prefix = [0, *accumulate(weights)]
    low, high = max(low, max(weights, default=0)), max(prefix[-1], low)
    while low < high:
        middle = (low + high) // 2
        if greedy(prefix, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _stretches(prefix: list[int], low: int, high: int, shards: int) -> set[int]:
    """Atoms in which a cut may lie for a capacity from low to high."""
    found: set[int] = set()
    first = last = 0
    for _ in range(shards - 1):
        first = prefix[bisect_right(prefix, first + low) - 1]
        last = min(last + high, prefix[-1])
        found.update(range(bisect_right(prefix, first) - 1, min(bisect_right(prefix, last), len(prefix) - 1)))
    return found


def boundaries(groups: DataFrame, shards: int = SHARDS) -> tuple[list[str], int]:
    """The digests at which shards 1, 2, ... begin, and the capacity; ``groups`` is held: (key, weight).

    A group that is heavier than a shard's share is a shard by itself, if what stands before and after it fits into
    shards of at most its weight: these two stretches are cut by themselves, with the shards that are left.
    """
    total, heaviest, key = groups.agg(F.sum("weight"), F.max("weight"), F.max_by("key", F.struct("weight", "key"))).first()
    if not shards:
        return [], 0
    if total and shards > 1 and heaviest * shards > total:
        sides = [groups.filter(F.col("key") < key), groups.filter(F.col("key") > key)]
        before, first_after = groups.agg(F.coalesce(F.sum(F.when(F.col("key") < key, F.col("weight"))), F.lit(0)), F.min(F.when(F.col("key") > key, F.col("key")))).first()
        after = total - heaviest - before
        rest = shards - 1
        if rest >= (before > 0) + (after > 0):
            # the split whose larger share is the smallest; both sides have a shard at least, if they have anything
            few, most = int(before > 0), rest - int(after > 0)
            left = min(range(few, most + 1), key=lambda a: max(before / a if a else 0, after / (rest - a) if rest > a else 0))
            (a, high_a), (b, high_b) = (boundaries(side, n) for side, n in zip(sides, (left, rest - left), strict=True))
            if max(high_a, high_b) <= heaviest:
                return [*a, *([key] if before else []), *([first_after] if after else []), *b], heaviest
    return _plain(groups, shards)


def _plain(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """``boundaries`` where no group is set apart."""

    def weights(rows: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        return [tuple(r) for r in rows.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("weight"), F.count(F.lit(1))).collect()]

    total, heaviest = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    low = max(-(-total // shards), heaviest)
    atoms = sorted(weights(groups, _DIGITS))
    digits = _DIGITS
    while True:
        sums = [w for _, w, _ in atoms]
        prefix = [0, *accumulate(sums)]
        high = smallest_capacity(sums, shards, low) if sums else 0
        split = [i for i in _stretches(prefix, low, high, shards) if atoms[i][2] > 1] if sums else []
        if not split:
            break
        digits += 2
        names = [atoms[i][0] for i in split]
        by_length: dict[int, list[str]] = {}
        for name in names:
            by_length.setdefault(len(name), []).append(name)
        wanted = F.lit(False)
        for size, some in by_length.items():
            wanted = wanted | F.substring("key", 1, size).isin(some)
        finer = weights(groups.filter(wanted), digits)
        gone = set(split)
        atoms = sorted([a for i, a in enumerate(atoms) if i not in gone] + finer)
    cuts = greedy(prefix, high, shards) or []
    return [atoms[c][0] for c in cuts], high


def _shard(key: Column, begins: list[str]) -> Column:
    found = F.lit(0)
    for b in begins:
        found = found + (key >= b).cast("int")
    return found


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``, by the law ``bytes``.

    A size is the text's UTF-8 bytes and 1; null texts count as empty. Equal texts share a shard, so a shard can
    be no smaller than the largest group of copies; the other shards share what is left. Rows that repeat, and rows without a
    doc_id, have slots of their own; other columns are ignored; an empty table gives no rows. Slots number the rows of a shard
    without gaps, by digest and then doc_id in each of some cells, so that neither a shard nor a group of copies has to be
    sorted in one task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = hold(rows, "op7-rows")
    groups = hold(rows.groupBy("key").agg(F.sum("size").alias("weight")), "op7-groups")
    begins, _ = boundaries(groups, shards)

    # ranges of digests are cut into cells by their rows, so that a large group of copies is many of them
    rows = rows.withColumn("shard", _shard(F.col("key"), begins)).withColumn("range", F.substring("key", 1, _DIGITS))
    ranges = rows.groupBy("shard", "range").agg(F.ceil(F.count(F.lit(1)) / _CELL).alias("cells"))
    ranges = hold(ranges, "op7-ranges")  # 16 ** _DIGITS + shards rows at most: safe to broadcast
    rows = rows.join(F.broadcast(ranges), ["shard", "range"]).withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("cells"))).drop("cells")
    cells = rows.groupBy("shard", "range", "cell").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("shard").orderBy("range", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = hold(cells.withColumn("offset", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k"), "op7-cells")
    own = Window.partitionBy("shard", "range", "cell").orderBy("key", "doc_id")
    rows = rows.withColumn("n", F.row_number().over(own)).join(cells, ["shard", "range", "cell"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, files: int = 8) -> None:
    """Writes ``docs`` to folders shard=0, shard=1, ... of up to ``files`` Parquet files each. Rows go where their text's digest says.

    Null texts count as empty, repeated rows stay, an empty table writes no folder. A column of the caller's that is
    called ``shard`` is kept as ``shard_``, with more underscores if that is taken, too.
    """
    text = F.coalesce("text", F.lit(""))
    groups = hold(docs.select(F.sha2(text, 256).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size")).groupBy("key").agg(F.sum("size").alias("weight")), "op7-groups")
    begins, _ = boundaries(groups, shards)
    for own in [c for c in docs.columns if c.lower() == "shard"]:
        docs = docs.withColumnRenamed(own, free_name(docs, "shard"))
    columns = docs.columns
    dealt = docs.withColumn("shard", _shard(F.sha2(text, 256), begins))
    dealt.select(*columns, "shard").repartition(shards * files, "shard", F.pmod(F.xxhash64(*columns), F.lit(files))).write.partitionBy("shard").parquet(path)
