"""Source divergence audit: how differently the sources of a language use its terms.

Terms that too few documents of a language have are most of all distinct terms. So documents are read twice:

* First each task adds what document frequencies it has seen, (lang, term) by (lang, term), to the counters of a
  count-min sketch, one counter in each of ``DEPTH`` rows. Counters stop at the least frequency that matters, which no
  sum over tasks can make smaller than the truth: sketches are merged by adding, and what is left of the merged one
  is a bitmap of ``DEPTH * WIDTH`` bits that tells which counters reach it.
* Then terms are counted exactly by language, source and task, and a term is passed on only if all its counters do.
  What passes by a shared counter is discarded by its exact frequency, so the sketch decides nothing but the bytes that
  are shuffled. At very many distinct terms it lets more through; the result is the same.

The comparison of two sources over all kept terms is taken apart, so that terms that neither has need no rows. With
f00 the value of a term that is in none, f(t, 0) and f(0, t) of one that is in the first or second only:

    sum over all terms = V f00 + sum over terms of a (f(t, 0) - f00) + sum over terms of b (f(0, t) - f00)
                         + sum over terms of both (f - f(t, 0) - f(0, t) + f00)

The second and third sum depend on a term by its count only, so they come from histograms of counts; the last one is
a join of sparse rows on the term.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.llm.shared import hold

#: Documents of a language that must have a term.
LEAST = 10
#: Ranks of terms that are shown for a group.
TOP = 10
SCALE = 1_000_000_000
#: Rows of the sketch and counters of each, whatever the input: a byte each in a task, a bit each in the bitmap (1 MiB).
DEPTH, WIDTH = 4, 1 << 21
_SLICES = 64
#: Entries of a task's tables before they are passed on.
ENTRIES = 300_000
#: Bytes of a text that are cut into terms at a time.
PIECE = 1 << 20

#: A-Z become a-z; other ASCII characters, but for a-z, stand between terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text."""
    text = text.translate(_FOLD)
    if len(text) <= PIECE:
        return Counter(text.split())
    found, at = Counter(), 0
    while at < len(text):
        stop = min(len(text), at + PIECE)
        while stop < len(text) and text[stop] != 32:  # a term is never cut
            stop += 1
        found.update(text[at:stop].split())
        at = stop
    return found


def _cells(lang: str, terms: list[bytes]) -> np.ndarray:
    """Where the counters of these terms are: a row for each row of the sketch."""
    key = hashlib.blake2b(lang.encode(), digest_size=16).digest()
    raw = b"".join([hashlib.blake2b(t, digest_size=4 * DEPTH, key=key).digest() for t in terms])
    return (np.frombuffer(raw, np.uint32).reshape(-1, DEPTH) % WIDTH + np.arange(DEPTH) * WIDTH).T


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's sketch, in slices; counters stop at ``LEAST``."""
    counters = np.zeros(DEPTH * WIDTH, np.uint8)
    seen: dict[str, Counter] = {}

    def add() -> None:
        for lang, terms in seen.items():
            n = np.minimum(np.fromiter(terms.values(), np.int64, len(terms)), LEAST)
            for cells in _cells(lang, list(terms)):
                some, at = np.unique(cells, return_inverse=True)
                counters[some] = np.minimum(counters[some] + np.bincount(at, n), LEAST)
        seen.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            mine = seen.setdefault(lang, Counter())
            size -= len(mine)
            mine.update(term_counts(text.as_py()).keys())
            size += len(mine)
            if size > ENTRIES:
                add()
                size = 0
    add()
    for k, part in enumerate(np.split(counters, _SLICES)):
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()])], ["slice", "counters"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the slices of a partition, one after the other."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, raw in zip(batch.column("slice").to_pylist(), batch.column("counters"), strict=True):
            x = np.frombuffer(raw.as_buffer(), np.uint8)
            sums[k] = np.minimum(sums[k] + x, LEAST) if k in sums else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.packbits(x >= LEAST).tobytes() for x in sums.values()], pa.binary())], ["slice", "bits"])


def sketch(rows: DataFrame) -> bytes:
    """The bitmap of counters that reach ``LEAST`` for documents (lang, text), not null: ``DEPTH * WIDTH`` bits."""
    merged = rows.mapInArrow(_sketched, "slice int, counters binary").repartition(_SLICES, "slice").mapInArrow(_merged, "slice int, bits binary")
    bits = np.zeros((_SLICES, DEPTH * WIDTH // _SLICES // 8), np.uint8)
    for k, raw in merged.collect():  # at most a MiB
        bits[k] = np.frombuffer(raw, np.uint8)
    return bits.tobytes()


def _counted(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap.value, np.uint8)
        counts: dict[tuple[str, str], Counter] = {}
        has: dict[tuple[str, str], Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in counts.items():
                cells = _cells(lang, list(terms))
                good = np.flatnonzero(((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0))
                names, n, df = list(terms), list(terms.values()), has[lang, source]
                names, n = [names[i] for i in good], [n[i] for i in good]
                some = [pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array([df[t] for t in names], pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), *some], ["lang", "source", "term", "n", "df"])
            counts.clear()
            has.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                terms = term_counts(text.as_py())
                mine = counts.setdefault((lang, source), Counter())
                size -= len(mine)
                mine.update(terms)
                size += len(mine)
                has.setdefault((lang, source), Counter()).update(terms.keys())
                if size > ENTRIES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def kept_terms(docs: DataFrame) -> DataFrame:
    """Held (lang, source, term, n, total): how often each kept term stands in each source that has it, and in its language."""
    rows = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(sketch(rows.select("lang", "text")))
    counts = rows.mapInArrow(_counted(bitmap), "lang string, source string, term string, n long, df long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    over = Window.partitionBy("lang", "term")  # a row for each source of the language
    counts = counts.withColumns({"total": F.sum("n").over(over), "df": F.sum("df").over(over)})
    return hold(counts.filter(F.col("df") >= LEAST).drop("df"), "op13-terms")


def _p(count, words, terms):
    """1 + floor(SCALE * (count + 2) / (words + 2 * terms)), with products beyond a long."""
    return F.lit(1) + F.expr(f"({SCALE}BD * ({count} + 2)) div cast({words} + 2 * {terms} as decimal(20,0))")


def _f(p: str, q: str) -> str:
    """What two values, each at most SCALE + 1, differ by: their squared difference fits into a long."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (doc_id, text, lang, source; other columns are ignored).

    Part ``pair`` has for each group (lang, source) every other source of the language with the sum of f over all
    kept terms; part ``term`` the ``TOP`` kept terms that are more likely in the group than in its language. A null
    text, lang or source is the empty string. Repeated rows are documents of their own. A language without kept
    terms has pairs of value 0 and no terms; an empty table gives no rows. A pair of sources is a row of the
    result, so pairs of groups grow as the result does.
    """
    kept = kept_terms(docs)
    words = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"))
    langs = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("total").alias("all_words"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    groups = groups.join(words, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["words", "terms", "all_words"])
    groups = hold(groups.withColumn("p0", F.when(F.col("terms") > 0, _p("0", "words", "terms"))), "op13-groups")
    sparse = hold(kept.join(groups, ["lang", "source"]).withColumn("p", _p("n", "words", "terms")).withColumn("q", _p("total", "all_words", "terms")).select("lang", "source", "term", "p", "p0", "q"), "op13-sparse")

    side = lambda df, name, *columns: df.select("lang", *[F.col(c).alias(f"{c}_{name}") for c in ("source", *columns)])
    two = side(groups, "a", "p0", "terms").join(side(groups, "b", "p0"), "lang").filter("source_a <> source_b")
    rest = two.select("lang", "source_a", "source_b", F.expr(f"coalesce(terms_a * ({_f('p0_a', 'p0_b')}), 0L)").alias("value"))
    shown = sparse.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("n"))
    single = side(shown, "a", "p", "p0", "n").join(side(groups, "b", "p0"), "lang").filter("source_a <> source_b")
    single = single.groupBy("lang", "source_a", "source_b").agg(F.expr(f"sum(n_a * ({_f('p_a', 'p0_b')} - {_f('p0_a', 'p0_b')}))").alias("value"))
    on = lambda name: sparse.select("lang", "term", *[F.col(c).alias(f"{c}_{name}") for c in ("source", "p", "p0")])
    both = on("a").join(on("b"), ["lang", "term"]).filter("source_a < source_b").groupBy("lang", "source_a", "source_b")
    both = both.agg(F.expr(f"sum({_f('p_a', 'p_b')} - {_f('p_a', 'p0_b')} - {_f('p0_a', 'p_b')} + {_f('p0_a', 'p0_b')})").alias("value"))
    turned = lambda df: df.select("lang", F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), "value")
    pairs = rest.union(single).union(turned(single)).union(both).union(turned(both)).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), "value")

    terms = sparse.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).union(ranked(terms).filter(F.col("rank") <= TOP))
