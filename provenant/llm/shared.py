"""What the operators of this subpackage share: scratch tables, size-checked joins and vectorised words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a one-column table of keys that may be broadcast, 16 being counted for each row besides its text.
BROADCAST_BYTES = 16 << 20

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset a local master gets a folder of its own; a
    cluster is an error, as its executors would not see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hold(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there.

    The table outlives any executor, so a lost one costs only its running tasks.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of wide rows with a held one-column table.

    The bytes of the ids are summed first. Up to ``BROADCAST_BYTES`` of them are broadcast, so that the wide rows
    need no shuffle; more are joined by a sort-merge join, with the same result.
    """
    ids = ids.select(key)
    if ids.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        return df.join(F.broadcast(ids), key, how)
    return df.join(ids.hint("merge"), key, how)


def with_values(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Inner join of wide rows with a held table that has one row for each key and some values.

    Up to ``BROADCAST_BYTES`` of it, counted as 96 bytes a row and its key, are broadcast; more is joined by a
    sort-merge join, in which adaptive execution splits the rows of a very common key.
    """
    size = values.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 96), F.lit(0))).first()[0]
    return df.join(F.broadcast(values) if size <= BROADCAST_BYTES else values.hint("merge"), key)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_field(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with a further column."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------- words as pairs of 64-bit values, vectorised

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_K = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of eight bytes, the first 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Words:
    """All words of some texts, A-Z lower-cased: where each starts and ends, whose it is, and its 128-bit value.

    ``separators`` tells for each byte whether it stands between words; a word also ends between a byte of the first
    and one of the second of two ``borders``. A value is two 64-bit numbers, ``head`` and ``tail``: the bytes themselves
    of a word of up to 16 bytes without NUL, else a BLAKE2 digest. With a secret ``key``, the digests and ``values`` depend
    on it, so that nobody can make texts whose words agree; values compare only under the same key.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = _SPACE, borders: tuple[np.ndarray, np.ndarray] | None = None, key: bytes = b""):
        self._k, self._l = np.frombuffer(hashlib.blake2b(b"lanes", digest_size=16, key=key).digest(), np.uint64) if key else (_K, _M1)
        texts = texts.cast(pa.binary()).fill_null(b"")
        at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
        at = (at - at[0]).astype(np.int64)
        word = ~separators[data]
        before, after = np.empty_like(word), np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        after[-1:], after[:-1] = False, word[1:]
        full = at[1:] > at[:-1]
        before[at[:-1][full]] = False
        after[at[1:][full] - 1] = False
        if borders:
            cut = np.flatnonzero(borders[0][data[:-1]] & borders[1][data[1:]])
            after[cut] = before[cut + 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: The words of text i are those from first[i] to first[i + 1].
        self.first = np.searchsorted(self.start, at)
        low = np.zeros(len(data) + 8, np.uint8)
        low[: len(data)] = _LOWER[data]
        windows = np.lib.stride_tricks.sliding_window_view(low, 8)
        size = self.end - self.start

        def eight(which: np.ndarray | slice, skip: int) -> np.ndarray:
            """Eight bytes of these words from a place on; zeros beyond a word's end."""
            x = windows[self.start[which] + skip].view(np.uint64).ravel()
            return x & _FIRST[np.minimum(size[which] - skip, 8)]

        #: The bytes, lower-cased, and eight zeros.
        self.low = low
        self._initial = eight(slice(None), 0)
        head, tail = self._initial.copy(), np.zeros(len(size), np.uint64)
        digested = size > 16
        nul = np.flatnonzero(data == 0) if not separators[0] else ()
        if len(nul):
            digested[np.searchsorted(self.start, nul, "right") - 1] = True
        more = np.flatnonzero((size > 8) & ~digested)
        tail[more] = eight(more, 8)
        digested = np.flatnonzero(digested)
        if len(digested):
            raw, digest = low.tobytes(), hashlib.blake2b
            each = [digest(raw[a:b], digest_size=16, key=key).digest() for a, b in zip(self.start[digested].tolist(), self.end[digested].tolist(), strict=True)]
            head[digested], tail[digested] = np.frombuffer(b"".join(each), np.uint64).reshape(-1, 2).T
        self.head, self.tail = head, tail

    def values(self, lane: int = 0) -> np.ndarray:
        """One of two independent 64-bit hashes of the words."""
        return mixed(self.head + mixed(self.tail + self._k)) if lane == 0 else mixed(self.tail + mixed(self.head + self._l))

    def beginnings(self, which: np.ndarray, size: int) -> np.ndarray:
        """What ``values`` has for words that are the first ``size`` bytes, up to 8, of these longer words."""
        return mixed((self._initial[which] & _FIRST[size]) + mixed(np.array([self._k])))


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``limit`` bytes together; a longer text is a slice by itself."""
    texts = batch.column(column)
    if not len(texts):
        return
    sizes = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    begin = 0
    while begin < len(texts):
        stop = int(np.searchsorted(sizes, sizes[begin] + limit, "right")) - 1
        stop = min(max(stop, begin + 1), len(texts))
        yield batch.slice(begin, stop - begin)
        begin = stop
