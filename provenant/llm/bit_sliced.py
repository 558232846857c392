"""Exact top-k inner products by a bit-sliced index.

Components are quantised to floor(256 x). The index keeps, for blocks of vectors and each attribute, one bitmap
per binary digit of the value above the block's least (a slice). A query's score of all rows of a block is a sum
of slices, each shifted by the digits of the query's own component: slices of one weight are added three to two
by full adders on bitmaps, carries go on to the next weight, and what comes out are the slices of the scores.
From the most significant of these downward the top rows are selected; rows that tie at the boundary are resolved
by vec_id. A block's best rows for each query are few; the best of all blocks are ranked by a window.

Integers that 64 bits can't hold are Python's own, as are their sums; a score beyond a long is ranked by its exact
value and shown as the largest or smallest long.

Queries are not broadcast: groups of queries meet groups of blocks by key, one pair of groups in a task at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.shared import hold

SCALE = 256
ROWS, COMPONENTS = 4096, 1 << 20  # vectors in a block, and components, at most
CELL_BYTES = 32 << 20  # of blocks in a group, about
QUERIES = 4096  # queries in a group, at most
#: Quantised components below this are 64-bit integers.
_SMALL = 1 << 61
_LONGEST = (1 << 63) - 1
#: More than the bits of any score of doubles.
_WIDE = 4096

_INDEX = "block long, width int, n int, ids binary, low binary, bits int, slices binary"


def _quantised(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, integers) of those vectors that take part; integers are Python's own where one is large."""
    for i, v in enumerate(vectors):
        if v.is_valid and v.values.null_count == 0 and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(x).all():
                continue
            if (np.abs(x) < _SMALL // SCALE).all():
                yield i, np.floor(SCALE * x).astype(np.int64)
            else:  # a large double is a whole number
                yield i, np.array([int(c) * SCALE if abs(c) >= 1 << 53 else math.floor(SCALE * c) for c in x.tolist()], object)


def _block(number: int, ids: list[int], rows: list[np.ndarray]) -> list:
    m = np.array(rows, object if any(r.dtype == object for r in rows) else np.int64)
    low = m.min(axis=0)
    u = (m - low).T  # attribute by row
    bits = max(1, int(u.max()).bit_length())
    padded = np.zeros((u.shape[0], -(-len(ids) // 64) * 64), m.dtype)
    padded[:, : len(ids)] = u
    planes = np.stack([np.packbits(((padded >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)], axis=1)
    return [number, m.shape[1], len(ids), np.array(ids, np.int64).tobytes(), ",".join(map(str, low.tolist())).encode(), bits, planes.tobytes()]


def build_index(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The index of all vectors, held: a row for each block of up to ``ROWS`` vectors of one length.

    Vectors that are null or empty, or hold null or non-finite components, take no part; nor do rows without an id.
    Rows that repeat are each a row of the index; other columns are ignored; an empty table is an empty index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_blocks: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        names = [x.split()[0] for x in _INDEX.split(", ")]

        def done(width: int) -> pa.RecordBatch:
            nonlocal number
            row = _block(number, *open_blocks.pop(width))
            number += 1
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids = batch.column(id_column).to_pylist()
            for i, x in _quantised(batch.column(vector_column)):
                if ids[i] is None:
                    continue
                block = open_blocks.setdefault(len(x), ([], []))
                block[0].append(ids[i])
                block[1].append(x)
                if len(block[0]) == max(64, min(ROWS, COMPONENTS // len(x))):
                    yield done(len(x))
        for width in list(open_blocks):
            yield done(width)

    return hold(vectors.select(F.col(id_column).cast("long").alias(id_column), vector_column).mapInArrow(run, _INDEX), "op3-index")


def add_slices(planes: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of a sum; ``planes`` has for each weight the bitmaps (as rows of arrays) to be added there."""
    out: list[np.ndarray] = []
    weight, last = 0, max(planes, default=-1)
    carried: list[np.ndarray] = []
    while weight <= last or carried:
        stack = [*planes.get(weight, []), *carried]
        carried = []
        if not stack:
            out.append(np.zeros(0, np.uint64))
            weight += 1
            continue
        p = np.concatenate(stack) if len(stack) > 1 else stack[0]
        while len(p) > 1:
            third = len(p) // 3
            if third:
                a, b, c = p[:third], p[third : 2 * third], p[2 * third : 3 * third]
                half = a ^ b
                carried.append((a & b) | (half & c))
                p = np.concatenate([half ^ c, p[3 * third :]])
            else:
                carried.append((p[:1] & p[1:]))
                p = p[:1] ^ p[1:]
        out.append(p[0])
        weight += 1
    return out


def top_rows(slices: list[np.ndarray], valid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bitmaps of rows that are surely among the top k, and of those at the boundary; how many to take of these."""
    sure, edge, have = np.zeros_like(valid), valid, 0
    for s in reversed(slices):
        if not len(s):
            continue
        with_bit = edge & s
        n = have + int(np.bitwise_count(with_bit).sum())
        if n > k:
            edge = with_bit
        else:
            sure, edge, have = sure | with_bit, edge & ~s, n
            if n == k:
                break
    return sure, edge, k - have


def _positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _dot(a: np.ndarray, b: np.ndarray) -> int:
    """Exactly."""
    if a.dtype != object and b.dtype != object and int(np.abs(a).max()) * int(np.abs(b).max()) * len(a) < _SMALL:
        return int(a @ b)
    return sum(x * y for x, y in zip(a.tolist(), b.tolist(), strict=True))


def search_block(query_id: int, q: np.ndarray, ids: np.ndarray, low: np.ndarray, planes: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
    """(vec_ids, scores) of the best k rows of a block, the query's own left out; ties go to smaller ids."""
    width, bits, words = planes.shape
    negative = q < 0
    # -|q| u = |q| (M - u) - |q| M: slices of negative components are complemented, so that all terms add up
    used = np.where(negative[:, None, None], ~planes, planes) if negative.any() else planes
    size = np.abs(q)
    constant = _dot(q, low) - sum(size[negative.astype(bool)].tolist()) * ((1 << bits) - 1)
    by_weight: dict[int, list[np.ndarray]] = {}
    for a in range(int(size.max()).bit_length()):
        rows = used[((size >> a) & 1).astype(bool)]
        if len(rows):
            for b in range(bits):
                by_weight.setdefault(a + b, []).append(rows[:, b])
    slices = add_slices(by_weight)
    valid = np.packbits(np.arange(words * 64) < len(ids), bitorder="little").view(np.uint64).copy()
    for own in np.flatnonzero(ids == query_id):
        valid[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
    sure, edge, more = top_rows(slices, valid, k)
    rows = _positions(sure)
    if more > 0:
        ties = _positions(edge)
        rows = np.append(rows, ties[np.argsort(ids[ties], kind="stable")[:more]])
    word, bit = rows >> 6, (rows & 63).astype(np.uint64)
    digits = [((s[word] >> bit) & np.uint64(1)).tolist() if len(s) else [0] * len(rows) for s in slices]
    return ids[rows], [constant + sum(d[i] << w for w, d in enumerate(digits)) for i in range(len(rows))]


def search(index: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of ``index`` for each row of ``queries``, fewer if there are fewer.

    Vectors are compared with vectors of their own length. Rows of the index with the query's id are its own and
    left out. Of queries that share an id the one with the least vector counts. Null and non-finite queries, and
    those without an id, have no rows; no queries or an empty index give none.
    """
    queries = queries.select(F.col(id_column).cast("long").alias("query_id"), F.col(vector_column).alias("vector")).filter("query_id is not null")
    queries = hold(queries.groupBy("query_id").agg(F.min("vector").alias("vector")), "op3-queries")
    n_blocks, size = index.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("slices")), F.lit(0))).first()
    groups = max(1, -(-queries.count() // QUERIES))
    cells = max(1, min(n_blocks, 64), -(-size // CELL_BYTES))
    left = index.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    # each pair of groups is much work on few bytes: as many tasks as pairs, whatever their bytes
    tasks = min(cells * groups, 20_000)

    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        names = asked.column("query_id").to_pylist()
        wanted = [(names[i], q) for i, q in _quantised(asked.column("vector").combine_chunks())]
        for b in blocks.to_batches(max_chunksize=1):
            row = b.to_pylist()[0]
            planes = np.frombuffer(row["slices"], np.uint64).reshape(row["width"], row["bits"], -1)
            low = list(map(int, row["low"].split(b",")))
            ids, low = np.frombuffer(row["ids"], np.int64), np.array(low, np.int64 if max(map(abs, low)) < 2 * _SMALL else object)
            for name, q in wanted:
                if len(q) == row["width"]:
                    found, scores = search_block(name, q, ids, low, planes, k)
                    out[0] += [name] * len(found)
                    out[1] += found.tolist()
                    out[2] += [max(-_LONGEST - 1, min(_LONGEST, s)) for s in scores]
                    # beyond a long the exact value, as bytes that sort as it does
                    out[3] += [(s + (1 << _WIDE)).to_bytes(_WIDE // 8 + 1, "big") if abs(s) >= _LONGEST else b"" for s in scores]
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["query_id", "vec_id", "score", "beyond"])

    left, right = (t.repartition(tasks, "cell", "group") for t in (left, right))
    found = left.groupBy("cell", "group").cogroup(right.groupBy("cell", "group")).applyInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all ``vectors`` (vec_id, embedding) for each row whose vec_id is
    divisible by ``every``.

    Ties go to the smaller vec_id. Vectors that are null, empty or hold null or non-finite components, and rows
    without a vec_id, take no part, as queries or candidates; of queries with one vec_id the one with the least
    vector counts, while each of their rows is a candidate for others. An empty table gives no rows.
    """
    return search(build_index(vectors), vectors.filter(F.col("vec_id") % every == 0), k)
