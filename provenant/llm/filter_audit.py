"""Filter interaction audit: what each of five filters removes in every order, and its Shapley value.

A document's failing conditions are a mask of five bits. What a set S of filters removes is the number of
documents whose mask meets S, so all that orders can tell is in the counts of masks. Over x in [0, 1]^5 the
multilinear extension of that set function is

    f(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)) = sum over sets T of c_T * product of x_i, i in T

with ``c_T = -(-1)^|T| * (documents whose mask holds T)``. At a corner of the cube f is what those filters remove, and the
integral of its derivative by x_i along the diagonal, ``sum of c_T / |T| over the T with i``, is filter i's Shapley
value; in exact rationals, times the 120 orders, it is a whole number.

Spark makes the masks and counts them; polynomials are made of the at most 32 counts of a part, a task for some parts.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import WORD, hold

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text):
    """The bits of A to D for a text that is not null."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum(F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the conditions that they fail.

    ``docs`` has (doc_id, text, lang), ``labels`` (doc_id, quality, toxic); further columns are ignored. A null text is an
    empty one, and a null lang the part of the empty string. A document is good or toxic if any of its labels says so;
    a null doc_id has no labels, and is neither smaller nor larger than another.

    Texts are equal when their SHA-256 digests are. Only digests of repeated texts are joined back to the
    narrow rows, and adaptive execution splits the rows of a very common one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = hold(rows, "op11-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)).alias("mask"))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = rows.join(marks.filter("good + toxic > 0"), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


class Removal:
    """The multilinear extension of what sets of filters remove, from the counts of masks."""

    def __init__(self, counts: dict[int, int]):
        self.coefficients = {t: -((-1) ** t.bit_count()) * sum(n for m, n in counts.items() if m & t == t) for t in range(1, 1 << len(FILTERS))}

    def at(self, corner: int) -> int:
        """The value where x_i is 1 for the filters of ``corner`` and 0 for others."""
        return sum(c for t, c in self.coefficients.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The integral of the derivative by x_i over the diagonal: a term with k factors gives one of k - 1, and that 1 / k."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.coefficients.items() if t >> i & 1), Fraction(0))


def _audited(counts: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, whose masks are the rows of ``counts``."""
    f, good, toxic = (Removal(dict(zip(counts["mask"].tolist(), counts[c].tolist(), strict=True))) for c in ("n", "good", "toxic"))
    total, all_of = int(counts["n"].sum()), (1 << len(FILTERS)) - 1
    shapley = [f.shapley(i) * len(ORDERS) for i in range(len(FILTERS))]
    assert all(s.denominator == 1 for s in shapley)
    out = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            removed = f.at(after) - f.at(before)
            redundant, unique = f.at(1 << i) - removed, f.at(all_of) - f.at(all_of ^ 1 << i)
            out.append((counts["part"].iloc[0], order, step, total - f.at(after), removed, redundant, unique, good.at(after) - good.at(before), toxic.at(after) - toxic.at(before), int(shapley[i])))
            before = after
    return pd.DataFrame(out, columns=[c.split()[0] for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows for each part of ``docs``, zeros included: each order of the five filters and each step of it.

    A: under 200 words; B: fewer than half of the words are distinct; C: more than 3 % of the characters are A-Z; D: holds
    one of ``#$%&*|``; E: the same text has a smaller doc_id. Columns as in ``AUDIT``; see ``masks`` for nulls. Repeated
    rows are documents of their own, and equal doc_ids don't fail E for each other. An empty table gives no rows.
    """
    return masks(docs, labels).groupBy("part").applyInPandas(_audited, AUDIT)
