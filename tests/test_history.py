"""Histories from observations by the segmented scan, against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from provenant.operators import scd2


def brute(rows):
    by_key = {}
    for user, kind, at, state in rows:
        by_key.setdefault((user, kind), []).append((at, state))
    out = []
    for key, seen in by_key.items():
        stretches = []
        for at, state in sorted(seen, key=lambda x: (x[0], x[1] is not None, x[1] or "")):
            if stretches and stretches[-1][0] == state:
                stretches[-1][2] = at
            else:
                stretches.append([state, at, at])
        for k, (state, begin, last) in enumerate(stretches):
            out.append((*key, state, begin, last, stretches[k + 1][1] if k + 1 < len(stretches) else None))
    return sorted(out, key=str)


@pytest.fixture
def many_parts(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_history_with_one_key_on_half_of_all_rows(many_parts, seed):
    spark, r = many_parts, random.Random(seed)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(r.choice([1, 3, 7, 1000])))
    users = [None, 1, 2, 3, 4] + [7] * 5
    # long runs of one value, so that stretches go over whole partitions
    rows = [(u, r.choice(["a", None]), t, r.choice(["x", "y", None]) if t < 200 else ["x", "y", None][t // 180 % 3]) for t in range(600) for u in [r.choice(users)]]
    rows += rows[:50]
    t = spark.createDataFrame(rows, "user int, kind string, t int, state string").repartition(5)
    got = scd2.build_history(t, ["user", "kind"], "t", "state").select("user", "kind", "state", "valid_from", "last_seen_at", "valid_to")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_a_history_of_one_stretch_and_of_nothing(many_parts):
    rows = [(1, "a", t, "same") for t in range(300)]
    t = many_parts.createDataFrame(rows, "user int, kind string, t int, state string")
    assert [tuple(x) for x in scd2.build_history(t, ["user"], "t", "state").select("state", "valid_from", "last_seen_at", "valid_to").collect()] == [("same", 0, 299, None)]
    assert scd2.build_history(t.limit(0), ["user"], "t", "state").count() == 0
    # no window over a key: the only one is over the ends of partitions
    plan = scd2.build_history(t, ["user"], "t", "state")._jdf.queryExecution().optimizedPlan().toString()
    assert "user" not in "".join(x.split("windowspecdefinition(")[1].split("ASC")[0] for x in plan.splitlines() if "windowspecdefinition(" in x)
