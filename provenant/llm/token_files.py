"""Token ids as binary files of patched frame-of-reference blocks.

A file holds segments, each of whole documents in order:

    file     "PFB1" segment... directory "PFB1"
    segment  u32 documents, u32 ids, u32 blocks, then for each document i64 doc_id, u8 is null, u32 ids,
             for each block u32 start (from the first block's start), then the blocks
    block    u16 values, u32 minimum, u8 width, u16 exceptions, the values less the minimum packed at that width,
             then u16 place and u32 value less the minimum of each exception
    directory  for each segment u64 start, u64 bytes, u64 ids before it in the file; then u32 segments

The width is that of the ``PERCENTILE`` of a block's values, so few large ids don't widen the rest; they are
exceptions. Numbers are little-endian. The starts make any block, and the directory any segment, readable alone.

Documents are range-partitioned by doc_id, one file for each partition. A file is written under another name and
then renamed, and its bytes hang only on its rows, so a task that is run again leaves the same file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.shared import Words, hold, pieces

MAGIC = b"PFB1"
BLOCK = 4096
PERCENTILE = 98
#: Ids after which a segment ends; only a longer document makes a longer one.
SEGMENT = 1 << 20
#: Bytes of segments that a task reads, about.
TASK = 16 << 20
#: Words that a worker's table may hold (some 40 bytes each) before it starts anew.
CACHE = 2_000_000
#: Words that go to the library at a time: its results are large until they are read.
_AT_ONCE = 2_000
#: The characters that stand for the bytes that are no printing Latin-1 characters, in a byte-level vocabulary.
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}


# ---------------------------------------------------------------- blocks


def pack_block(values: np.ndarray) -> bytes:
    low = int(values.min())
    rest = (values - np.uint32(low)).astype(np.uint32)
    rank = -(-PERCENTILE * (len(rest) - 1) // 100)
    width = int(np.partition(rest, rank)[rank]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    kept = rest.copy()
    kept[over] = 0
    bits = (kept[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return struct.pack("<HIBH", len(values), low, width, len(over)) + packed + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(raw: memoryview) -> np.ndarray:
    n, low, width, over = struct.unpack_from("<HIBH", raw)
    at = 9
    size = (n * width + 7) // 8
    values = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        whole = np.zeros((n, 32), np.uint8)
        whole[:, :width] = bits
        values = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel().copy()
    at += size
    places = np.frombuffer(raw, "<u2", over, at)
    values[places] = np.frombuffer(raw, "<u4", over, at + 2 * over)
    return values + np.uint32(low)


def pack_segment(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    head = struct.pack("<III", len(doc_ids), len(ids), len(blocks))
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(sizes, "<u4").tobytes()
    return head + table + starts.astype("<u4").tobytes() + b"".join(blocks)


def unpack_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids of each document as sizes, all ids)."""
    docs, total, blocks = struct.unpack_from("<III", raw)
    at = 12
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
    sizes = np.frombuffer(raw, "<u4", docs, at + 9 * docs)
    at += 13 * docs
    starts = np.frombuffer(raw, "<u4", blocks, at).astype(np.int64) + at + 4 * blocks
    view = memoryview(raw)
    ids = np.concatenate([unpack_block(view[a:]) for a in starts]) if blocks else np.zeros(0, np.uint32)
    assert len(ids) == total
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], sizes, ids


# ---------------------------------------------------------------- encoding


#: Letters of which words are given to the library's merges alone.
_PLAIN = "".join(c for c in map(chr, [*range(97, 123), *range(0xC0, 0x17F)]) if c.isalpha() and len(c.lower()) == 1)
#: Marks that end a run of letters or digits. An apostrophe may belong to what follows it.
_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
#: A word of plain letters, and marks behind it.
_STEM = re.compile(f"([{_PLAIN}]+)([{re.escape(_MARKS)}]*)")


def _table(characters: str) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters.encode())] = True
    return found


_ALNUM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_BORDERS = (_table(_ALNUM), _table(_MARKS))
_LETTER = _table(_ALNUM[:26])


class WordEncoder:
    """Ids of texts by a tokenizer that lets no token cross white space and lower-cases; words are encoded once and remembered.

    Words of a piece are found side by side (``shared.Words``), each distinct one is looked up in a sorted table by its
    128 bits, and the ids of the piece are gathered from the table. Where the tokenizer is seen to keep letters and
    marks apart, words also end before a mark, and one of plain letters goes to the library's merge model directly,
    its bytes written as the model's characters. Everything else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        probe = ["Ab c's 12", "a\x85b\xa0c\u2009d\u3000e\x1cf", "\tx\x0by\x0cz \r\n é ", "a, b.. 7! c*. İx.", "AB CD'S É"]
        for t in probe:
            words = [w for w in re.split("[ \t-\r]+", t) if w]
            if not self._ids([t])[0] == [i for x in self._ids(words) for i in x] == self._ids([re.sub("[A-Z]", lambda m: m[0].lower(), t)])[0]:
                raise ValueError("this tokenizer has tokens across white space, or tells capitals from small letters")
        pairs = [(a, b) for a in _ALNUM for b in _MARKS]
        alone = dict(zip(_ALNUM + _MARKS, self._ids([*_ALNUM, *_MARKS]), strict=True))
        self.direct = self._ids([a + b for a, b in pairs]) == [alone[a] + alone[b] for a, b in pairs]
        stems = [*_PLAIN, _PLAIN]
        merged = [self._merged(w) for w in stems]
        self.direct &= self._ids(stems) == merged and self._ids([f"{w}.{w}" for w in stems]) == [m + alone["."] + m for m in merged]
        self._forget()

    def _forget(self) -> None:
        #: Values of words are a worker's own, so no text can be made whose words it takes for others.
        self.key = os.urandom(16)
        #: Sorted values (lane 0) of the words, their other values, and where each one's ids begin and end.
        self.keys, self.other = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.stems: dict[str, list[int]] = {}

    def _ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _merged(self, word: str) -> list[int]:
        """Ids of a word of plain letters."""
        if not word.isascii():
            word = word.lower().encode().decode("latin-1").translate(_BYTES)
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """Ids of words that have no ASCII capitals."""
        if not self.direct:
            return self._ids(words)
        out, rest, merged, stem_of = [], [], self._merged, _STEM.fullmatch
        for w in words:
            if w.isascii() and w.isalpha():
                out.append(merged(w))
            elif m := stem_of(w):
                stem, marks = m.groups()
                ids = merged(stem)
                if marks:
                    if marks not in self.stems:
                        self.stems[marks] = self._ids([marks])[0]
                    ids = ids + self.stems[marks]
                out.append(ids)
            else:
                rest.append((len(out), w))
                out.append([])
        for i in range(0, len(rest), _AT_ONCE):
            some = rest[i : i + _AT_ONCE]
            for (at, _), ids in zip(some, self._ids([w for _, w in some]), strict=True):
                out[at] = ids
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); null counts as empty."""
        w = Words(texts, borders=_BORDERS if self.direct else None, key=self.key)
        value, other = w.values(), w.values(1)
        distinct, sample, which = np.unique(value, return_index=True, return_inverse=True)
        if (other[sample][which] != other).any():  # two words that agree in half their bits
            each = self._ids([t or "" for t in texts.to_pylist()])
            return np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
        at = np.searchsorted(self.keys, distinct)
        near = np.minimum(at, max(len(self.keys) - 1, 0))
        known = self.keys[near] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if len(self.keys) > CACHE or (known & (self.other[near] != other[sample])).any() if len(self.keys) else False:
            self._forget()
            return self.encode(texts)
        new = np.flatnonzero(~known)
        if len(new):
            low, start, end = w.low, w.start[sample[new]].tolist(), w.end[sample[new]].tolist()
            raw = low.tobytes()
            lists = self._encoded([raw[a:b].decode() for a, b in zip(start, end, strict=True)])
            size = np.fromiter(map(len, lists), np.int32, len(lists))
            more = np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum()))
            begin = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
            self.ids = np.concatenate([self.ids, more])
            places = at[new]
            self.keys = np.insert(self.keys, places, distinct[new])
            self.other = np.insert(self.other, places, other[sample[new]])
            self.begin = np.insert(self.begin, places, begin)
            self.size = np.insert(self.size, places, size)
            at = np.searchsorted(self.keys, distinct)
        size = self.size[at][which].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[at][which] - (ends - size), size) + np.arange(total)]
        counts = np.append(0, ends)[w.first]
        return ids, np.diff(counts)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- files


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


_MANIFEST = "file string, number int, segment int, start long, bytes long, before long, n_ids long"


def write(docs: DataFrame, uri: str, path: str, end_id: int) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text), each document's followed by ``end_id``, to files in the folder ``uri``.

    ``uri`` must be a folder that all executors share and pyarrow can open. Null texts count as empty; documents
    are in ascending order of doc_id, null first, rows that share one in the order of their texts' hashes.
    Returns the held directory of segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        fs, folder = _file_system(uri)
        fs.create_dir(folder, recursive=True)
        final = f"{folder}/part-{number:06d}.pfb"
        draft = f"{final}.{TaskContext.get().taskAttemptId()}"
        e, last = encoder(path), np.array([end_id], np.uint32)
        directory: list[tuple[int, int, int, int]] = []
        at, before = len(MAGIC), 0
        doc_ids, sizes, parts, total = [], [], [], 0
        with fs.open_output_stream(draft) as out:
            out.write(MAGIC)

            def flush():
                nonlocal at, before, total
                if doc_ids:
                    raw = pack_segment(doc_ids, sizes, np.concatenate(parts).astype("<u4", copy=False))
                    out.write(raw)
                    directory.append((at, len(raw), before, total))
                    at, before, total = at + len(raw), before + total, 0
                    doc_ids.clear(), sizes.clear(), parts.clear()

            for batch in batches:
                for piece in pieces(batch, "text", 1 << 21):
                    ids, counts = e.encode(piece.column("text"))
                    cuts = np.split(ids, np.cumsum(counts)[:-1])
                    for doc_id, some in zip(piece.column("doc_id").to_pylist(), cuts, strict=True):
                        doc_ids.append(doc_id)
                        parts += some, last
                        sizes.append(len(some) + 1)
                        total += sizes[-1]
                        if total >= SEGMENT:
                            flush()
            flush()
            for entry in directory:
                out.write(struct.pack("<QQQ", *entry[:3]))
            out.write(struct.pack("<I", len(directory)) + MAGIC)
        fs.move(draft, final)
        scheme = uri[: len(uri) - len(folder)] if uri.endswith(folder) else "file://"
        columns = [[f"{scheme}{final}"] * len(directory), [number] * len(directory), list(range(len(directory))), *map(list, zip(*directory, strict=True))] if directory else [[]] * 7
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _MANIFEST.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    return hold(rows.mapInArrow(run, _MANIFEST), "op9-directory")


def directory(spark: SparkSession, uri: str) -> DataFrame:
    """The directory of segments, as ``write`` returns it, from the files' own directories."""
    fs, folder = _file_system(uri)
    found = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(folder)) if f.path.endswith(".pfb"))
    scheme = uri[: len(uri) - len(folder)] if uri.endswith(folder) else "file://"
    files = spark.createDataFrame([(f"{scheme}{f}", i) for i, f in enumerate(found)], "file string, number int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, number in zip(batch.column("file").to_pylist(), batch.column("number").to_pylist(), strict=True):
                fs, name = _file_system(uri)
                with fs.open_input_file(name) as f:
                    size = f.size()
                    tail = f.read_at(8, size - 8)
                    (n,) = struct.unpack("<I", tail[:4])
                    assert tail[4:] == MAGIC
                    entries = np.frombuffer(f.read_at(24 * n, size - 8 - 24 * n), "<u8").reshape(n, 3).astype(np.int64)
                    ids = [struct.unpack_from("<II", f.read_at(8, a))[1] for a in entries[:, 0].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * n), pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(entries[:, 0]), pa.array(entries[:, 1]), pa.array(entries[:, 2]), pa.array(ids, pa.int64())], [x.split()[0] for x in _MANIFEST.split(", ")])

    return files.repartition(len(found) or 1).mapInArrow(run, _MANIFEST)


def read(segments: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the held segments; ``digest``: ids_crc32 in place of the ids.

    ``start`` counts the ids of all documents before it, over all files. Each segment is read alone, in tasks of
    about ``TASK`` bytes of segments. No segments give no rows.
    """
    tasks = max(1, -(-(segments.agg(F.sum("bytes")).first()[0] or 0) // TASK))
    files = segments.groupBy("number").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = files.select("number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = segments.join(files, "number").withColumn("first", F.col("offset") + F.col("before")).select("file", "start", "bytes", "first")
    last = "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _file_system(row["file"])
                with fs.open_input_file(name) as f:
                    doc_ids, sizes, ids = unpack_segment(f.read_at(row["bytes"], row["start"]))
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    what = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    what = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["first"]), pa.array(sizes.astype(np.int64)), what], ["doc_id", "start", "n_tokens", last.split()[0]])

    # as many tasks as the files ask for, not as the few rows do
    return rows.repartition(tasks, "file", "start").mapInArrow(run, f"doc_id long, start long, n_tokens long, {last}")
