"""The gate of golden fixtures: expected against extracted fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Expected and extracted values that a task of ``replay`` compares, about.
TASK_ROWS = 200_000


def replay(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(fixture, compared, differing, passed) for each fixture of ``expected`` (fixture, row_ix, field, value, required).

    ``actual`` has (fixture, row_ix, field, value). Every required value must be the same, nulls included, and
    there must be as many valid rows: those that validation rejects (``valid`` is false, if there is such a column) don't
    count. A fixture whose one expected row has no field (all nulls) expects no rows. The order of keys is ``key_order``'s.

    Values are counted first, so that tasks are as many as their number asks for: such rows shrink a lot in files and
    shuffles, whose bytes would give a task more rows than its memory should hold.
    """
    valid = F.col("valid") if "valid" in actual.columns else F.lit(True)
    keys = ["fixture", "row_ix", "field"]
    want = expected.select(*keys, "value", "required", F.lit(True).alias("_wanted"))
    got = actual.select(*keys, F.col("value").alias("_got"), valid.alias("_valid"))
    tasks = 1 + want.select("fixture").unionAll(got.select("fixture")).count() // TASK_ROWS
    j = want.repartition(tasks, *keys).join(got.repartition(tasks, *keys), keys, "full_outer")
    wanted, row = F.col("_wanted").isNotNull(), F.col("row_ix").isNotNull()
    rows = j.repartition(tasks, "fixture", "row_ix").groupBy("fixture", "row_ix").agg(
        F.count("_wanted").alias("wanted"),
        F.count_if(wanted & F.col("field").isNotNull()).alias("compared"),
        F.count_if(wanted & F.col("required") & ~F.col("value").eqNullSafe(F.col("_got"))).alias("differing"),
        F.count_if("_valid").alias("valid"),
    )
    out = rows.groupBy("fixture").agg(
        F.sum("wanted").alias("wanted"),
        F.sum("compared").alias("compared"),
        F.sum("differing").alias("differing"),
        F.count_if(row & (F.col("compared") > 0)).alias("_rows"),
        F.count_if(row & F.col("fixture").isNotNull() & (F.col("valid") > 0)).alias("_valid_rows"),
    )
    passed = (F.col("differing") == 0) & (F.col("_rows") == F.col("_valid_rows"))
    return out.filter("wanted > 0").select("fixture", "compared", "differing", passed.alias("passed"))


def key_order(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(fixture, keys, got, same, first_difference) of ordered keys: ``expected`` and ``actual`` have (fixture, row_ix, key).

    A side's keys in order are a fingerprint, made of partial sums: how many there are, and two independent hashes
    of each position and key added up. Positions are those that rows take in the order of ``row_ix``. For a fixture whose
    fingerprints differ, and for no other, rows are compared: ``first_difference`` is the least position, from 0, at which
    the keys differ or only one side has any. A null key is a key. Fixtures that only ``actual`` has are left out.
    """
    place = Window.partitionBy("fixture").orderBy("row_ix")  # rows of one page
    numbered = lambda df: df.select("fixture", "key", (F.row_number().over(place) - 1).alias("at"))
    mix = lambda seed: F.sum(F.xxhash64(F.lit(seed), F.col("at"), F.col("key").isNull(), F.coalesce("key", F.lit(""))).cast("decimal(38,0)"))
    print_of = lambda df, name: numbered(df).groupBy("fixture").agg(F.count(F.lit(1)).alias(name), F.struct(mix(1).alias("a"), mix(2).alias("b")).alias(f"_{name}"))
    both = print_of(expected, "keys").join(print_of(actual, "got"), "fixture", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    both = both.withColumn("same", (F.col("keys") == F.col("got")) & F.coalesce(F.col("_keys") == F.col("_got"), F.lit(False)))
    odd = both.filter("not same").select("fixture")
    side = lambda df, name: numbered(df.join(odd, "fixture", "left_semi")).select("fixture", "at", F.struct("key").alias(name))
    first = side(expected, "x").join(side(actual, "y"), ["fixture", "at"], "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).groupBy("fixture").agg(F.min("at").alias("first_difference"))
    return both.join(first, "fixture", "left").select("fixture", "keys", "got", "same", "first_difference")


def optional_counts(actual: DataFrame, required: list[str]) -> DataFrame:
    """(field, n): how many values each optional field has over all fixtures."""
    return actual.filter(~F.col("field").isin(*required)).groupBy("field").agg(F.count("value").alias("n"))


def gate(results: DataFrame, counts: DataFrame, baseline: DataFrame | None = None, orders: DataFrame | None = None) -> DataFrame:
    """(passed): every fixture passed, with its keys in order if ``orders`` (of ``key_order``) are given, and no optional field has fewer values than in ``baseline`` (field, n)."""
    if orders is not None:
        results = results.select("fixture", "passed").union(orders.select("fixture", F.col("same")))
    ok = results.agg(F.coalesce(F.every("passed"), F.lit(True)).alias("passed"))
    if baseline is None:
        return ok
    fewer = baseline.join(counts.withColumnRenamed("n", "now"), "field", "left").agg(F.count_if(F.coalesce("now", F.lit(0)) < F.col("n")).alias("fewer"))
    return ok.crossJoin(fewer).select((F.col("passed") & (F.col("fewer") == 0)).alias("passed"))  # one row each


#: Fixtures that a source must have before its labels count.
FLOOR = 20


def edge_coverage(fixtures: DataFrame, required: DataFrame, waived: DataFrame, floor: int = FLOOR) -> DataFrame:
    """(source, fixtures, missing, verdict) for each source of ``fixtures`` and ``required``; all three tables have (source, label).

    ``missing`` counts the required labels that no fixture has and nobody waived. The verdict is ``insufficient_fixtures``
    below the floor, else ``missing_labels`` or ``covered``. Null labels are no fixtures; a label that comes twice is two
    fixtures, and one requirement.
    """
    have = fixtures.filter("label is not null")
    missing = required.distinct().join(have, ["source", "label"], "left_anti").join(waived, ["source", "label"], "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("missing"))
    out = have.groupBy("source").agg(F.count(F.lit(1)).alias("fixtures")).join(required.select("source").distinct(), "source", "full_outer").join(missing, "source", "left").fillna(0, ["fixtures", "missing"])
    verdict = F.when(F.col("fixtures") < floor, "insufficient_fixtures").when(F.col("missing") > 0, "missing_labels").otherwise("covered")
    return out.select("source", "fixtures", "missing", verdict.alias("verdict"))


def missing_labels(required: DataFrame, present: DataFrame, waived: DataFrame) -> DataFrame:
    """Labels that fixtures should have and don't."""
    return required.join(present, "label", "left_anti").join(waived, "label", "left_anti")
