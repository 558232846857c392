"""Encoding and decoding with a SentencePiece merge model, as the library does it.

A merge model joins, again and again, the adjacent pair with the best score. The same result is found without
merging whole texts: a sequence of pieces is the encoding exactly if every two neighbours, merged anew by
themselves, come out as these two pieces. So the encoder walks through a chunk, takes the longest piece at each
position (one Aho-Corasick pass gives them), goes to shorter ones where neighbours are not compatible, steps
back where none is left, and marks in a bitfield the positions from which no way leads on. As the encoding of
each prefix is unique, a marked position never has to be tried again: the work is linear in the text.

Chunks are the parts between places that no piece of the vocabulary crosses: before a space mark that follows
another character, and around line feeds. The encoder checks that the vocabulary keeps to this; where one does
not, the whole text is a single chunk, with the same result.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import with_field

MARK = "▁"
#: Entries of a generation of a worker's cache of chunks, or of pairs (some 30 MB). When it is full, it becomes the
#: old one and the old one goes; what is found in the old one moves to the young one, so frequent chunks stay.
CACHE = 150_000
_CHUNK = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PieceModel:
    """The vocabulary of a merge model, with encoding and decoding of texts."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = "a  b\tÅ ｆ "
        if lib.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("only models that leave texts as they are, but for a space in front, are supported")
        n = lib.get_piece_size()
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.byte_ids: list[int] = [self.unknown] * 256
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.surface: list[bytes] = []
        self.control: set[int] = set()
        self.is_byte = bytearray(n)
        for i in range(n):
            piece = lib.id_to_piece(i)
            raw = piece.replace(MARK, " ").encode()
            if lib.is_byte(i):
                raw = bytes([int(piece[3:5], 16)])
                self.byte_ids[raw[0]] = i
                self.is_byte[i] = 1
            elif lib.is_control(i):
                raw = b""
                self.control.add(i)
            elif lib.is_unknown(i):
                raw = " ⁇ ".encode()
            else:
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
            self.surface.append(raw)
        self.pieces = {i: p for p, i in self.ids.items()}
        self.found = ahocorasick.Automaton()
        for p in self.ids:
            self.found.add_word(p, len(p))
        self.found.make_automaton()
        #: The next shorter piece that a piece begins with.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) for p in self.ids}
        self.chunked = not any("\n" in p and len(p) > 1 or re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._old_pairs: dict[tuple[str, str], bool] = {}
        self._known = _Chunks(self, {})

    # ------------------------------------------------------------ encoding

    def merged(self, text: str) -> list[str]:
        """Merging from single characters: the best score first, of equal ones the leftmost. For short texts."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether two pieces stay as they are when their characters are merged anew."""
        fits = self._old_pairs.get((left, right))
        if fits is None:
            fits = self.merged(left + right) == ([left, right] if left else [right])
        self._pairs[left, right] = fits
        return fits

    def split(self, chunk: str) -> list[str]:
        """The pieces of a chunk; a character that no piece has stands by itself."""
        n = len(chunk)
        longest = [1] * n
        for last, size in self.found.iter(chunk):
            if size > longest[last - size + 1]:
                longest[last - size + 1] = size
        out: list[str] = []
        failed = bytearray(n // 8 + 1)
        at, left = 0, ""
        piece = chunk[: longest[0]] if n else None
        pairs, shorter = self._pairs, self.shorter
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    fits = pairs.get((left, piece))
                    if fits or fits is None and self.compatible(left, piece):
                        break
                piece = shorter.get(piece)
            if piece is not None:
                out.append(piece)
                at, left = to, piece
                piece = chunk[at : at + longest[at]] if at < n else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                left = out[-1] if out else ""
                piece = shorter.get(piece)
        return out

    def chunk_ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for p in self.split(chunk):
            i = self.ids.get(p)
            if i is None:
                ids.extend(self.byte_ids[b] for b in p.encode())
            else:
                ids.append(i)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as unsigned 32-bit integers, without begin and end."""
        if not text:
            return b""
        text = MARK + text.replace(" ", MARK)
        known = self._known
        if len(known) >= CACHE:
            known.old = {}  # two generations at most
            known = self._known = _Chunks(self, known)
        if len(self._pairs) >= CACHE:
            self._old_pairs, self._pairs = self._pairs, {}
        return b"".join(map(known.__getitem__, _CHUNK.findall(text) if self.chunked else [text]))

    # ------------------------------------------------------------ decoding

    def decode(self, ids) -> str:
        """The text of ids; control ids have none, bytes that are no UTF-8 become one U+FFFD each."""
        ids = list(ids)
        surface = self.surface
        k = 0
        while k < len(ids) and ids[k] in self.control:
            k += 1
        raw = b"".join(map(surface.__getitem__, ids[k:]))
        if k < len(ids) and raw[:1] == b" " and not self.is_byte[ids[k]] and ids[k] != self.unknown:
            raw = raw[1:]
        rest = ids[k:-1] if ids and ids[-1] in self.control else ids[k:]
        if self.control.isdisjoint(rest):  # inside, a control id ends a run of bytes
            try:
                return raw.decode()
            except UnicodeDecodeError:
                pass
        return self._decode_runs(ids[k:])

    def _decode_runs(self, ids: list[int]) -> str:
        """Each run of byte ids by itself."""
        out, run = [], bytearray()
        for j, i in enumerate([*ids, None]):
            if i is not None and self.is_byte[i]:
                run += self.surface[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    size = 1
                    out.append("�")
                del run[:size]
            if i is not None:
                s = self.surface[i].decode()
                out.append(s[1:] if j == 0 and s[:1] == " " and i != self.unknown else s)
        return "".join(out)


class _Chunks(dict):
    """Ids of chunks: a young generation, and the one before it."""

    def __init__(self, model: PieceModel, old: dict[str, bytes]):
        super().__init__()
        self.model, self.old = model, old

    def __missing__(self, chunk: str) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            ids = self.model.chunk_ids(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    """One model for each worker, which goes on to its next tasks."""
    return PieceModel(path)


def encode(docs: DataFrame, path: str, begin: bool = True, end: bool = True, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` (array<int>): the whole text's ids, null counting as empty.

    The model's path must be readable on every executor. Other columns are kept; one that has the name of the
    new column is replaced.
    """
    docs = docs.drop(to) if to != text else docs
    schema = with_field(docs, to, "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        first, last = [m.begin] if begin else [], [m.end] if end else []
        for batch in batches:
            ids = [first + array("I", m.encode(t or "")).tolist() + last for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], schema=pa.schema([*batch.schema, pa.field(to, pa.list_(pa.int32()))]))

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``tokens`` with the text of its column of ids; null ids give an empty text."""
    tokens = tokens.drop(to)
    schema = with_field(tokens, to, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], schema=pa.schema([*batch.schema, pa.field(to, pa.string())]))

    return tokens.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row: its ids, with begin and end, and their text, as digests.

    Ids and decoded texts of a batch are dropped as soon as they are digested, so nothing large leaves a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        first, last = array("I", [m.begin]).tobytes(), array("I", [m.end]).tobytes()
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("text"):
                raw = first + m.encode(t.as_py() or "") + last
                ids = array("I", raw)
                n.append(len(ids))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
