"""History of records (slowly changing dimension, type 2) as joins that compute the next version of a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.held import held
from provenant.operators.integrity import interval_breaks

KEYS = ["entity", "natural_key"]


@dataclass(frozen=True)
class Applied:
    """The next open rows, the rows that were closed, and how many rows of each kind came in."""

    current: DataFrame
    closed: DataFrame
    counters: DataFrame


def apply(current: DataFrame, incoming: DataFrame, at: Column) -> Applied:
    """Writes ``incoming`` (entity, natural_key, seq, payload_hash, snapshot_id) at one time ``at`` over ``current`` (entity, natural_key, payload_hash, snapshot_id, valid_from, last_seen_at).

    Of incoming rows with one key the first by ``seq`` counts, of equal ones that with the least payload_hash; the others are
    duplicates, whatever they hold. New and changed keys get an open row from ``at``; what they replace is closed at ``at``,
    so history has no gap. Unchanged rows keep all but ``last_seen_at``. A replaced row that began at or after ``at`` is an error.

    The first row of a key is a partial minimum, so a key that comes very often is no large group. Each key is joined
    once with its open row, and the outcome is held: all parts of the result are read from it.
    """
    first = incoming.groupBy(*KEYS).agg(F.min(F.struct("seq", "payload_hash", "snapshot_id")).alias("_new"), F.count(F.lit(1)).alias("_rows"))
    j = current.withColumn("_known", F.lit(True)).join(first, KEYS, "full_outer")
    change = F.when(F.col("_new").isNull(), None).when(F.col("_known").isNull(), "inserted").when(F.col("payload_hash").eqNullSafe(F.col("_new.payload_hash")), "unchanged").otherwise("versioned")
    rows = held(j.withColumn("change", change), "scd2")
    stay = rows.filter("change is null or change = 'unchanged'").withColumn("last_seen_at", F.when(F.col("change") == "unchanged", at).otherwise(F.col("last_seen_at"))).select(*current.columns)
    fresh = rows.filter("change in ('inserted', 'versioned')").select(*KEYS, "_new.payload_hash", "_new.snapshot_id", at.alias("valid_from"), at.alias("last_seen_at"))
    closed = rows.filter("change = 'versioned'").select(*current.columns).withColumn("valid_to", F.when(at > F.col("valid_from"), at).otherwise(F.raise_error(F.lit("a version must end after it begins"))))
    kinds = rows.filter("change is not null").select(F.explode(F.array(F.struct("change", F.lit(1).cast("long").alias("k")), F.struct(F.lit("duplicate").alias("change"), (F.col("_rows") - 1).alias("k")))).alias("c"))
    counters = kinds.groupBy("c.change").agg(F.sum("c.k").alias("n")).filter("n > 0")
    return Applied(stay.unionByName(fresh), closed, counters)


def touch_last_seen(current: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    """``current`` with ``last_seen_at`` moved for the given keys."""
    seen = keys.select(*KEYS).distinct().withColumn("_seen", F.lit(True))
    return current.join(seen, KEYS, "left").withColumn("last_seen_at", F.when(F.col("_seen"), at).otherwise(F.col("last_seen_at"))).drop("_seen")


def _stretches(keys: list[str], at: str, value: str):
    """Stretches of equal values in a partition whose rows come sorted; batches are compared as columns, with the row before."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def differs(column: pa.Array, last: pa.Array | None) -> np.ndarray:
        """Whether each element differs from the one before it, nulls being equal; the first from ``last``."""
        whole = pa.concat_arrays([last, column]) if last is not None else column
        a, b = whole.slice(1), whole.slice(0, len(whole) - 1)
        out = np.asarray(pc.fill_null(pc.not_equal(a, b), False)) | np.asarray(pc.xor(pc.is_null(a), pc.is_null(b)))
        return out if last is not None else np.append(True, out)

    def run(batches):
        from pyspark import TaskContext

        part, count, held_back, last = TaskContext.get().partitionId(), 0, None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c) for c in (*keys, value, at)}
            other = np.zeros(batch.num_rows, bool)
            for k in keys:
                other |= differs(columns[k], last.get(k))
            new = other | differs(columns[value], last.get(value))
            last = {c: columns[c].slice(batch.num_rows - 1) for c in (*keys, value)}
            first = np.flatnonzero(new)
            ends = np.append(first[1:], batch.num_rows) - 1
            if held_back is not None and (not len(first) or first[0] > 0):  # the stretch before goes on
                stop = int(first[0]) - 1 if len(first) else batch.num_rows - 1
                held_back["seen"] = columns[at].slice(stop, 1)
            # what is complete: the stretch before, and all of this batch but its last one
            starts = [held_back] if held_back is not None and len(first) else []
            done = {c: pa.concat_arrays([*(s[c] for s in starts), columns[c].take(first[:-1])]) for c in (*keys, value)} if len(first) else None
            if done is not None:
                begin = pa.concat_arrays([*(s["from"] for s in starts), columns[at].take(first)])
                seen = pa.concat_arrays([*(s["seen"] for s in starts), columns[at].take(ends[:-1])])
                # a stretch ends where the next one begins, if that has the same keys
                follows = ~other[first] if starts else ~other[first[1:]]
                to = pc.if_else(pa.array(follows), begin.slice(1), pa.nulls(len(follows), begin.type))
                n = len(follows)
                yield pa.RecordBatch.from_arrays([*done.values(), begin.slice(0, n), seen, to, pa.array([part] * n, pa.int32()), pa.array(np.arange(count, count + n), pa.int64()), pa.array([False] * n, pa.bool_())], [*keys, value, "valid_from", "last_seen_at", "valid_to", "_part", "_ix", "_last"])
                count += n
                held_back = {**{c: columns[c].slice(int(first[-1]), 1) for c in (*keys, value)}, "from": columns[at].slice(int(first[-1]), 1), "seen": columns[at].slice(batch.num_rows - 1)}
        if held_back is not None:
            yield pa.RecordBatch.from_arrays([*(held_back[c] for c in (*keys, value)), held_back["from"], held_back["seen"], pa.nulls(1, held_back["from"].type), pa.array([part], pa.int32()), pa.array([count], pa.int64()), pa.array([True])], [*keys, value, "valid_from", "last_seen_at", "valid_to", "_part", "_ix", "_last"])

    return run


def build_history(observations: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The whole history from observations: (keys, value, valid_from, valid_to, last_seen_at), one row for each stretch of equal values.

    Observations of one key at one time stand in the order of their values, null first. Null keys are a key; an empty
    table has no history.

    A segmented scan: rows are sorted by key, time and value over range partitions, so that the rows of a very common
    key are dealt over many of them. Each task makes the stretches of its own rows. Of a partition's stretches only the
    first and the last can go on in others; these two rows of each partition, and nothing else, are scanned in one order to
    put stretches together that go over a border, and to end those that end beyond it.
    """
    kinds = {f.name: f.dataType.simpleString() for f in observations.schema.fields}
    order = [*keys, at, value]
    rows = observations.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    columns = [*keys, value, "valid_from", "last_seen_at", "valid_to"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, value)), *(f"{c} {kinds[at]}" for c in columns[-3:]), "_part int, _ix long, _last boolean"])
    found = held(rows.mapInArrow(_stretches(keys, at, value), schema), "stretches")

    inner = found.filter("_ix > 0 and not _last").select(*columns)
    edges = Window.orderBy("_part", "_ix")  # at most two rows of each partition
    same_key = reduce(lambda x, y: x & y, [F.lag(k).over(edges).eqNullSafe(F.col(k)) for k in keys])
    goes_on = (F.col("_ix") == 0) & (F.row_number().over(edges) > 1) & same_key
    edge = found.filter("_ix = 0 or _last").withColumns({"_key": goes_on, "_on": goes_on & F.lag(value).over(edges).eqNullSafe(F.col(value))})
    edge = edge.withColumn("_group", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(edges.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("_part", "_ix")
    groups = edge.groupBy("_group").agg(*[F.min_by(c, place).alias(c) for c in (*keys, value)], F.min_by("valid_from", place).alias("valid_from"), F.max_by("last_seen_at", place).alias("last_seen_at"), F.max_by("valid_to", place).alias("_to"), F.max_by("_last", place).alias("_last"), F.min_by("_key", place).alias("_key"))
    next_one = Window.orderBy("_group")
    # the next group's first row is a partition's first one, if this group ends with its partition
    beyond = F.when(F.col("_last") & F.lead("_key").over(next_one), F.lead("valid_from").over(next_one))
    return inner.unionByName(groups.withColumn("valid_to", F.coalesce("_to", beyond)).select(*columns))


def point_in_time(history: DataFrame, at: Column) -> DataFrame:
    """The rows that held at a time: begun by then, and not yet ended."""
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def broken_rules(current: DataFrame, closed: DataFrame) -> DataFrame:
    """(rule, n) of what may not be: two open rows of a key, a closed row that ends before it begins, intervals of a key that leave gaps or overlap."""
    rows = current.select(*KEYS, "valid_from", F.lit(None).cast(closed.schema["valid_to"].dataType).alias("valid_to")).union(closed.select(*KEYS, "valid_from", "valid_to"))
    open_twice = current.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("one_open_row").alias("rule"), "n")
    ends = closed.agg(F.count_if(F.col("valid_to") <= F.col("valid_from")).alias("n")).select(F.lit("ends_after_begin").alias("rule"), "n")
    breaks = interval_breaks(rows, KEYS).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("kind").alias("rule"), "n")
    return open_twice.union(ends).filter("n > 0").union(breaks)
