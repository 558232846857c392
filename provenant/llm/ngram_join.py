"""N-gram Jaccard join: components of documents whose sets of word 5-grams overlap enough.

Let A be the 0/1 matrix with a row for each distinct set and a column for each 5-gram; A x A' holds the
sizes of all intersections. Spark computes the part of it that can matter, in blocks of columns (the shuffle
partitions of the incidence rows), and adds up each pair's counts over the blocks:

* Equal sets become one row of A (``classes``), so a group of copies costs one row however large it is.
* Columns in one fixed order, frequent ones last; a row keeps its first ``floor(n / 4) + 1`` columns. Two rows
  that are similar enough share one of these, whatever the order is.
* A pair with c shared columns there has at most ``c + max(n_a - p_a, n_b - p_b)`` in all, and needs
  ``75 (n_a + n_b) / 175``; pairs below that and pairs of too different sizes are dropped.
* Each row has a sketch: the parities of its columns over at least n buckets. Where two sketches differ, the sets
  do; so pairs with more differences than ``25 (n_a + n_b) / 175`` are dropped before any text is moved.
* What is left is counted exactly on the whole texts.

A word is its bytes, or a 128-bit digest if it is long, and a gram 128 bits made of its words (``shared.Words``): a
hash, too. Both depend on a random key that a run draws, so unlike grams that agree can't be constructed, and by
chance two of n agree with a probability of n^2 / 2^129.

A group of thousands of near copies would still be millions of pairs, of which a component needs few. So the
product is done in two rounds: first each row only with some hubs of each of its columns, which gives
preliminary components; then all pairs of rows *from different components*: of each row's pairs the most
promising are checked first, and then all pairs that are still apart. No pair is skipped unless its rows have
been linked otherwise, so no link between components can be lost.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.components import components
from provenant.llm.shared import Words, hold, keep_ids, mixed, pieces

SIZE = 5  # words in a gram
#: Sets are linked when 100 * intersection >= 75 * union.
PERCENT = 75
#: The counters that tell frequent columns from others; a fixed number, so their size never grows.
COUNTER_BITS = 18
_SLICES = 64
#: Hubs that a row is compared with in round 1. More of them leave fewer pairs to round 2, none changes the result.
STARS = 6
#: Pairs of a row that are checked before all others that may be similar; this changes no result either.
TOP = 4
#: Rows that make a cluster worth dense products, and rows of a block of it.
HEAVY, BLOCK = 32, 512
#: Grams of all sets of a block, about: longer texts make smaller blocks.
GRAMS = 1 << 21


#: For each lane and place in a gram, an odd factor.
_FACTORS = mixed(np.arange(1, 2 * SIZE + 1, dtype=np.uint64)).reshape(2, SIZE) | np.uint64(1)


def gram_sets(batch: pa.RecordBatch, both: bool = True, key: bytes = b"") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of (doc_id, text): its index in the batch and its distinct grams, 128 bits in two arrays.

    They are sorted by the first array, in which two grams of one set hardly ever agree; not ``both``: the second
    array is left empty, and grams that agree in the first are one. Sets compare only under the same ``key``.
    """
    base = 0
    for part in pieces(batch, "text"):
        w = Words(part.column("text"), key=key)
        lanes = []
        for lane in range(1 + both):
            v = w.values(lane)
            n = max(0, len(v) - SIZE + 1)
            g = np.zeros(n, np.uint64)
            for j in range(SIZE):
                g += v[j : j + n] * _FACTORS[lane, j]
            lanes.append((v, mixed(g + np.uint64(SIZE))))
        for i in range(part.num_rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if b - a >= SIZE:
                s = [g[a : b - SIZE + 1] for _, g in lanes]
            elif b > a:
                s = [mixed((v[a:b] * _FACTORS[lane, : b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a)) for lane, (v, _) in enumerate(lanes)]
            else:
                s = [np.zeros(0, np.uint64)] * len(lanes)
            if not both:
                yield base + i, np.unique(s[0]), s[0][:0]
                continue
            order = np.argsort(s[0])
            x, y = s[0][order], s[1][order]
            new = np.append(True, x[1:] != x[:-1])[: len(x)]
            if not (y[1:] == y[:-1])[~new[1:]].all():  # grams that agree in half their bits
                order = np.lexsort((s[1], s[0]))
                x, y = s[0][order], s[1][order]
                new = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            yield base + i, x[new], y[new]
        base += part.num_rows


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The size of the intersection of two sets of ``gram_sets``."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = (b[0][at] == a[0]) & (b[1][at] == a[1])
    n = int(hit.sum())
    odd = (b[0][at] == a[0]) & ~hit
    if odd.any():  # agreement in half the bits: told apart by all of them
        n = len(set(zip(*map(np.ndarray.tolist, a), strict=True)) & set(zip(*map(np.ndarray.tolist, b), strict=True)))
    return n


def sketch(grams: np.ndarray) -> bytes:
    """Parities of a set's grams over at least as many buckets as it has, a power of two from 64 on."""
    buckets = max(64, 1 << (len(grams) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of some sets; two of different sizes are compared at the smaller one, the larger being folded."""

    def __init__(self, raw: pa.Array):
        self.all = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
        self.size = np.array([len(x) for x in self.all], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each set, or -1; matrix) of all sketches of this size and larger."""
        if size not in self.folded:
            place, rows = np.full(len(self.all), -1), []
            for i in np.flatnonzero(self.size >= size):
                place[i] = len(rows)
                rows.append(np.bitwise_xor.reduce(self.all[i].reshape(-1, size), axis=0))
            self.folded[size] = place, np.array(rows, np.uint64)
        return self.folded[size]

    def may_agree(self, i: np.ndarray, other: Sketches, j: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Which pairs (i, j of ``other``) differ in few enough places; ``total`` has the sums of their sets' sizes."""
        out = np.zeros(len(i), bool)
        both = np.minimum(self.size[i], other.size[j])
        for size in np.unique(both):
            (a, x), (b, y) = self.at(int(size)), other.at(int(size))
            these = np.flatnonzero(both == size)
            step = max(1, (1 << 20) // int(size))
            for k in range(0, len(these), step):
                t = these[k : k + step]
                differ = np.bitwise_count(x[a[i[t]]] ^ y[b[j[t]]]).sum(axis=1, dtype=np.int64)
                out[t] = differ * (100 + PERCENT) <= (100 - PERCENT) * total[t]
        return out


_SIGNATURE = "doc_id long, n int, digest binary, sketch binary, part int"


def _signatures(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, n, digest of the set, sketch) for each document; at the end the task's counters, in slices."""
    names = [x.split()[0] for x in _SIGNATURE.split(", ")]
    counters = np.zeros(1 << COUNTER_BITS, np.int64)
    shift = np.uint64(64 - COUNTER_BITS)
    for batch in batches:
        n, digest, sketches = [], [], []
        for _, x, y in gram_sets(batch, key=key):
            n.append(len(x))
            digest.append(hashlib.blake2b(x.tobytes() + y.tobytes(), digest_size=16).digest())
            sketches.append(sketch(y) if len(y) else None)
            counters += np.bincount((x >> shift).astype(np.int64), minlength=len(counters)) if len(x) > 4096 else 0
            if len(x) <= 4096:
                np.add.at(counters, (x >> shift).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(sketches, pa.binary()), pa.nulls(len(n), pa.int32())], names)
    cut = np.split(counters, _SLICES)
    yield pa.RecordBatch.from_arrays([pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int32()), pa.array([x.tobytes() for x in cut], pa.binary()), pa.nulls(_SLICES, pa.binary()), pa.array(range(_SLICES), pa.int32())], names)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counter slices of a partition: one row for each slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("digest"), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.int64)
            sums[part] = sums[part] + x if part in sums else x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["part", "digest"])


def column_levels(counter_rows: DataFrame) -> bytes:
    """For each counter: 0 if its count is usual, else how many doublings its excess is worth.

    2**18 bytes, whatever the input. Frequent grams stand out of their counter; a usual gram that shares
    one is only ordered later, which changes no result.
    """
    rows = counter_rows.mapInArrow(_summed, "part int, digest binary").repartition(8, "part").mapInArrow(_summed, "part int, digest binary").collect()
    counts = np.zeros((_SLICES, (1 << COUNTER_BITS) // _SLICES), np.int64)
    for part, raw in rows:
        counts[part] += np.frombuffer(raw, np.int64)
    counts = counts.ravel()
    usual = float(np.median(counts))
    excess = counts - usual - 6 * np.sqrt(usual + 1) - 8
    return np.where(excess > 0, np.floor(np.log2(np.maximum(excess, 1))) + 1, 0).astype(np.uint8).tobytes()


def _prefixes(levels, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        shift = np.uint64(64 - COUNTER_BITS)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            grams, salts, docs, sizes = [], [], [], []
            for i, s, _ in gram_sets(batch, both=False, key=key):
                n = len(s)
                if not n:
                    continue
                level = table[(s >> shift).astype(np.int64)]
                # a stable sort by level keeps the order by value inside a level
                order = np.argsort(level, kind="stable")[: n // 4 + 1] if level.any() else np.arange(n // 4 + 1)
                # a column with about 2**level rows is dealt out over cells of about 2**10, numbered from 1
                cells = np.left_shift(np.int64(1), np.maximum(level[order].astype(np.int64) - 10, 0))
                grams.append(s[order].view(np.int64))
                own = int(mixed(np.array([ids[i]], np.int64).view(np.uint64))[0] >> np.uint64(8))
                salts.append(np.where(cells > 1, own % cells + 1, 0))
                docs.append(np.full(len(order), ids[i]))
                sizes.append(np.full(len(order), n, np.int32))
                if len(grams) >= 256:
                    yield _posting_batch(grams, salts, docs, sizes)
                    grams, salts, docs, sizes = [], [], [], []
            if grams:
                yield _posting_batch(grams, salts, docs, sizes)

    return run


def _posting_batch(grams, salts, docs, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(sizes))], ["gram", "salt", "doc_id", "n"])


def _counted(key: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact check of pairs. Rows come sorted: the text of a block's first document, then those to compare with it.

    One set is held at a time, so memory does not grow with a block.
    """
    hub_block, hubs = None, {}
    for batch in batches:
        a, b, cell = batch.column("a").to_numpy(), batch.column("b").to_numpy(), batch.column("cell").to_numpy()
        is_hub = batch.column("is_hub").to_pylist()
        out_a, out_b = [], []
        for i, x, y in gram_sets(batch, key=key):
            block = (a[i], cell[i])
            if is_hub[i]:
                hubs = hubs if block == hub_block else {}
                hubs[x.tobytes()] = x, y  # more than one only if texts share a doc_id
                hub_block = block
                continue
            for hub in hubs.values() if block == hub_block else ():
                both = common(hub, (x, y))
                if 100 * both >= PERCENT * (len(hub[0]) + len(x) - both):
                    out_a.append(a[i])
                    out_b.append(b[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b, ...) whose sketches (doc_id, n, sketch) differ in few enough places."""
    names = pairs.columns
    two = pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("n").alias("_na"), F.col("sketch").alias("_sa")), "a")
    two = two.join(sketches.select(F.col("doc_id").alias("b"), F.col("n").alias("_nb"), F.col("sketch").alias("_sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = np.arange(batch.num_rows)
            total = batch.column("_na").to_numpy().astype(np.int64) + batch.column("_nb").to_numpy()
            good = Sketches(batch.column("_sa")).may_agree(each, Sketches(batch.column("_sb")), each, total)
            yield batch.select(names).filter(pa.array(good))

    return two.mapInArrow(run, pairs.schema)


def confirmed(texts: DataFrame, pairs: DataFrame, key: bytes = b"") -> DataFrame:
    """Those of the held ``pairs`` (a, b) whose sets are similar enough, counted on the whole texts; held.

    Pairs are blocked by ``a``; a block is cut into cells of at most some thousand rows, each with its own
    copy of the text of ``a``, so that a hub of a third of all documents is many small cells.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 2000).cast("int").alias("cells"))
    pairs = pairs.join(blocks, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), cells) as int)").alias("cell"))
    hubs = pairs.select(F.col("a").alias("doc_id"), "a", F.col("a").alias("b"), "cell", F.lit(True).alias("is_hub")).distinct()
    places = hold(hubs.union(pairs.select(F.col("b").alias("doc_id"), "a", "b", "cell", F.lit(False))), "op1-places")
    rows = keep_ids(texts, hold(places.select("doc_id").distinct(), "op1-ids"), "doc_id").join(places, "doc_id")
    rows = rows.select("a", "b", "cell", "is_hub", "text").repartition("a", "cell").sortWithinPartitions("a", "cell", F.desc("is_hub"))
    return hold(rows.mapInArrow(partial(_counted, key), "a long, b long"), "op1-links")


def _hubs(window):
    """Some rows of a column that all its rows are compared with: those at the ends of two orders."""
    mixed_id = F.xxhash64("doc_id")
    ends = [F.min("doc_id"), F.max("doc_id"), F.min_by("doc_id", mixed_id), F.max_by("doc_id", mixed_id)]
    return F.array(*[e.over(window) for e in ends])


def _product(blocks: pa.Table) -> pa.Table:
    """Counts of a block of rows times another, added up over blocks of their common columns; pairs that may be similar."""
    sides = []
    for second in (False, True):
        t = blocks.filter(pc.equal(blocks.column("second"), second)).combine_chunks()
        lists = t.column("grams").combine_chunks()
        sides.append((t.column("doc_id").to_numpy(), t.column("n").to_numpy().astype(np.int64), t.column("comp").to_numpy(), np.repeat(np.arange(t.num_rows), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), Sketches(t.column("sketch").combine_chunks())))
    (x, nx, cx, rx, gx, sx), (y, ny, cy, ry, gy, sy) = sides
    counts = np.zeros((len(x), len(y)), np.float32)
    shared = np.intersect1d(gx, gy)
    for at in range(0, len(shared), 4096):
        columns = shared[at : at + 4096]
        dense = []
        for rows, grams, height in ((rx, gx, len(x)), (ry, gy, len(y))):
            place = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
            hit = columns[place] == grams
            m = np.zeros((height, len(columns)), np.float32)
            m[rows[hit], place[hit]] = 1
            dense.append(m)
        counts += dense[0] @ dense[1].T
    total = nx[:, None] + ny[None, :]
    rest = np.maximum((nx - nx // 4)[:, None], (ny - ny // 4)[None, :]) - 1
    sizes = 100 * np.minimum(nx[:, None], ny[None, :]) >= PERCENT * np.maximum(nx[:, None], ny[None, :])
    good = (counts > 0) & sizes & (cx[:, None] != cy[None, :]) & ((counts + rest) * (100 + PERCENT) >= PERCENT * total)
    if blocks.column("b1")[0] == blocks.column("b2")[0]:
        good &= x[:, None] < y[None, :]
    i, j = np.nonzero(good)
    may = sx.may_agree(i, sy, j, total[i, j])
    i, j = i[may], j[may]
    return pa.table([pa.array(x[i], pa.int64()), pa.array(y[j], pa.int64()), pa.array(cy[j], pa.int64()), pa.array(counts[i, j].astype(np.int64), pa.int64())], names=["x", "y", "comp", "c"])


def cross_pairs(posts: DataFrame, sketches: DataFrame, found: DataFrame, hub_of: DataFrame) -> DataFrame:
    """Held pairs (x, y, comp, c) from different components that may be similar by their first columns and sketches.

    ``comp`` is the component of y, ``c`` the count of shared columns. Rows of one component, or single ones with one
    best hub, are a cluster. Clusters of at least ``HEAVY`` rows are cut into blocks, those of its component apart
    from the others, and blocks that share a column are multiplied as matrices, one pair of blocks at a time, but for
    pairs of one component; so a cluster of thousands, which would be millions of joined rows, is some dense
    products. Pairs with a row of a smaller cluster are joined by column; a column with very many rows is a skewed
    key of a sort-merge join, which adaptive execution splits.
    """
    comp = found.select(F.col("id").alias("doc_id"), F.col("component").alias("own"))
    via = hub_of.join(found.select(F.col("id").alias("hub"), "component"), "hub", "left").select("doc_id", F.coalesce("component", "hub").alias("near"))
    docs = sketches.groupBy("doc_id").agg(F.max("n").alias("n")).join(comp, "doc_id", "left").join(via, "doc_id", "left")
    docs = docs.select("doc_id", "n", F.coalesce("own", "doc_id").alias("comp"), F.coalesce("own", "near", "doc_id").alias("cluster"))
    docs = docs.withColumn("inner", F.col("comp") == F.col("cluster"))
    sides = docs.groupBy("cluster", "inner").agg(F.count(F.lit(1)).alias("side"), F.sum(F.col("n").cast("long")).alias("grams"))
    sides = sides.join(sides.groupBy("cluster").agg(F.sum("side").alias("size")).filter(F.col("size") >= HEAVY), "cluster")
    block = F.concat_ws("/", "cluster", F.when(F.col("inner"), "i").otherwise("o"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.greatest(F.col("side") / BLOCK, F.col("grams") / GRAMS))))
    docs = hold(docs.join(sides, ["cluster", "inner"], "left").select("doc_id", "comp", F.when(F.col("size").isNotNull(), block).alias("block")), "op1-blocked")

    # columns with rows of one component only go; those of very many rows (with a salt) are not gathered to see that
    cell = Window.partitionBy("gram")
    posts = posts.select("gram", "salt", "doc_id", "n").join(docs, "doc_id")
    usual = posts.filter("salt = 0").withColumn("several", F.min("comp").over(cell) < F.max("comp").over(cell)).filter("several").drop("several")
    posts = hold(usual.union(posts.filter("salt > 0")).drop("salt"), "op1-mixed")

    x, y = posts.filter("block is null").alias("x"), posts.alias("y")
    joined = x.join(
        y,
        F.expr(f"x.gram = y.gram and x.comp <> y.comp and (y.block is not null or x.doc_id < y.doc_id) and 100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n)"),
    )
    light = joined.select(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y"), F.col("y.comp").alias("comp"), F.expr("x.n + y.n").alias("total"), F.expr("greatest(x.n - x.n div 4, y.n - y.n div 4) - 1").alias("rest"))
    light = light.groupBy("x", "y", "comp", "total", "rest").agg(F.count(F.lit(1)).alias("c")).filter(f"(c + rest) * {100 + PERCENT} >= {PERCENT} * total")
    light = likely(light.select(F.col("x").alias("a"), F.col("y").alias("b"), "comp", "c"), sketches).toDF("x", "y", "comp", "c")

    heavy = posts.filter("block is not null")
    touching = heavy.select("gram", "block").distinct()
    inside = F.col("b1").contains("/i/") & F.col("b2").contains("/i/") & (F.substring_index("b1", "/", 1) == F.substring_index("b2", "/", 1))
    blocks = touching.select("gram", F.col("block").alias("b1")).join(touching.select("gram", F.col("block").alias("b2")), "gram").filter(F.col("b1") <= F.col("b2")).select("b1", "b2").distinct()
    blocks = hold(blocks.filter(~inside), "op1-blocks")
    # a row has at most a quarter of its own grams in its list
    rows = heavy.groupBy("block", "doc_id", "n", "comp").agg(F.collect_list("gram").alias("grams"))
    rows = hold(rows.join(sketches.select("doc_id", "sketch"), "doc_id"), "op1-rows")
    pairs = [blocks.withColumn("block", F.col(b)).join(rows, "block").select("b1", "b2", "doc_id", "n", "comp", "grams", "sketch", F.lit(b == "b2").alias("second")) for b in ("b1", "b2")]
    dense = pairs[0].union(pairs[1]).groupBy("b1", "b2").applyInArrow(_product, "x long, y long, comp long, c long")
    return hold(light.union(dense), "op1-pairs")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of non-white-space, A-Z lower-cased; a set is the distinct 5-word grams, or the whole
    sequence if there are fewer words. Null, empty and blank texts have an empty set and stand alone. A
    doc_id on several rows is one document: it is linked as any of its texts is, and has a row for each. A
    null doc_id names no component: such rows belong to the documents with the same set, or to null. An empty
    table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = os.urandom(16)
    sign = hold(texts.mapInArrow(partial(_signatures, key), _SIGNATURE), "op1-signatures")
    members = sign.filter("part is null").select("doc_id", "n", "digest")
    levels = docs.sparkSession.sparkContext.broadcast(column_levels(sign.filter("part is not null")))

    # equal sets: one class, named by its smallest doc_id
    classes = hold(members.filter("n > 0 and doc_id is not null").groupBy("digest", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "op1-classes")
    in_class = members.join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    in_class = hold(in_class, "op1-members")
    spread = in_class.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
    copies = hold(spread.filter("lo = hi and lo <> doc_id").select("doc_id"), "op1-copies")
    same_id = in_class.join(spread.filter("lo < hi").select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    reps = keep_ids(texts.filter("doc_id is not null"), copies, "doc_id", "left_anti")
    sketches = hold(keep_ids(sign.filter("part is null and n > 0 and doc_id is not null").select("doc_id", "n", "sketch"), copies, "doc_id", "left_anti"), "op1-sketches")

    # incidence rows of A, limited to the first columns; columns with one row only link nothing
    posts = reps.mapInArrow(_prefixes(levels, key), "gram long, salt int, doc_id long, n int")
    cell = Window.partitionBy("gram", "salt")
    posts = posts.withColumn("hubs", _hubs(cell)).withColumn("rows", F.count(F.lit(1)).over(cell))
    posts = hold(posts.filter("rows > 1 or salt > 0").select("gram", "salt", "doc_id", "n", "hubs"), "op1-postings")

    # round 1: each row with the hubs that it meets in most columns
    heads = posts.filter("salt > 0").groupBy("gram", "salt").agg(F.min_by(F.struct("doc_id", "n"), "doc_id").alias("h")).select("gram", "h.*")
    heads = heads.withColumn("hubs", _hubs(Window.partitionBy("gram"))).select("doc_id", "n", "hubs")
    stars = posts.select("doc_id", "n", "hubs").union(heads).select("doc_id", "n", F.explode(F.array_distinct("hubs")).alias("hub")).filter("doc_id <> hub")
    stars = stars.groupBy("doc_id", "n", "hub").agg(F.count(F.lit(1)).alias("c")).filter("c * 8 >= n / 4")
    near = Window.partitionBy("doc_id").orderBy(F.desc("c"), "hub")
    best = hold(stars.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= STARS).select(F.col("hub").alias("a"), F.col("doc_id").alias("b"), "rank"), "op1-best")
    stars = hold(likely(best.select("a", "b").distinct(), sketches).distinct(), "op1-stars")
    links = confirmed(reps, stars, key).union(same_id)

    # round 2: all pairs of rows from different components; first each row's best, which leaves few components apart
    found = hold(components(links), "op1-found")
    pairs = cross_pairs(posts, sketches, found, best.filter("rank = 1").select(F.col("b").alias("doc_id"), F.col("a").alias("hub")))
    of = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("c"), other))
    first = pairs.withColumns({"_x": of("x", "y"), "_y": of("y", "x")}).filter((F.col("_x") <= TOP) | (F.col("_y") <= TOP)).select(F.col("y").alias("a"), F.col("x").alias("b"))
    first = hold(first.join(stars, ["a", "b"], "left_anti").distinct(), "op1-first")
    links = links.union(confirmed(reps, first, key))
    found = hold(components(links), "op1-found")
    own = lambda side, to: found.select(F.col("id").alias(side), F.col("component").alias(to))
    rest = pairs.select(F.col("y").alias("a"), F.col("x").alias("b")).join(own("a", "_ca"), "a", "left").join(own("b", "_cb"), "b", "left")
    rest = rest.filter("coalesce(_ca, a) <> coalesce(_cb, b)").select("a", "b").distinct().join(first.union(stars), ["a", "b"], "left_anti")
    links = hold(links.union(confirmed(reps, hold(rest, "op1-rest"), key)), "op1-links")
    found = components(links)

    out = in_class.join(found, F.col("rep") == F.col("id"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest doc_id stays, and rows without one.

    Rows that repeat a doc_id that stays are kept, too; null, empty and blank texts are alone in their components
    and stay. Other columns are kept as they are, and an empty table stays empty.
    """
    found = jaccard_components(docs)
    gone = hold(found.filter("component_id is not null and component_id <> doc_id").select("doc_id").distinct(), "op1-gone")
    return keep_ids(docs, gone, "doc_id", "left_anti")
