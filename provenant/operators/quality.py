"""The quality profile of runs, what it sets off, and checks of whole frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provenant.operators.contract import Contract
from provenant.operators.validate import empty, out_of_range


def profile(rows: DataFrame, contract: Contract, run: str, unchanged: str | None = None) -> DataFrame:
    """A row for each run: counts, and fill, range and enum rates by field, all in one aggregation.

    Rates are over the rows considered less the unchanged ones, 0 if there are none. Duplicates are rows less
    distinct natural keys.
    """
    still = F.count_if(F.col(unchanged)) if unchanged else F.lit(0)
    aggs = [F.count(F.lit(1)).alias("rows_considered"), still.alias("rows_unchanged")]
    aggs += [F.count_if(~empty(F.col(f.name))).alias(f"filled_{f.name}") for f in contract.fields]
    aggs += [F.count_if(out_of_range(F.col(f.name), f)).alias(f"range_{f.name}") for f in contract.fields if f.low is not None or f.high is not None]
    aggs += [F.count_if(F.col(f.name).isNotNull() & ~F.col(f.name).isin(*f.enum)).alias(f"enum_{f.name}") for f in contract.fields if f.enum]
    missing = reduce(lambda a, b: a | b, [empty(F.col(k)) for k in contract.natural_key])
    aggs += [F.count_if(missing).alias("natural_key_missing"), F.count_distinct(F.struct(*contract.natural_key)).alias("keys")]
    out = rows.groupBy(run).agg(*aggs)
    base = F.greatest(F.col("rows_considered") - F.col("rows_unchanged"), F.lit(0))
    rate = lambda c: F.when(base > 0, F.col(c) / base).otherwise(F.lit(0.0))
    columns = {f"fill_rate_{f.name}": rate(f"filled_{f.name}") for f in contract.fields}
    columns |= {f"range_rate_{f.name}": rate(f"range_{f.name}") for f in contract.fields if f"range_{f.name}" in out.columns}
    out = out.withColumn("duplicates", F.col("rows_considered") - F.col("keys"))
    return out.withColumns(columns | {"duplicate_rate": rate("duplicates")})


def with_baseline(profiles: DataFrame, contract: Contract, run: str, days: int = 14, count: str = "rows_considered") -> DataFrame:
    """Each run with the median of the runs of the ``days`` before it, and its deviation; ``run`` is a date, one run each. Fewer
    runs than ``baseline_runs`` of the contract have no median.

    A run is carried to the days that it is history for, so that the look back is a plain grouping.
    """
    history = profiles.select(F.explode(F.sequence(F.date_add(run, 1), F.date_add(run, days))).alias(run), F.col(count).alias("c"))
    history = history.groupBy(run).agg(F.count(F.lit(1)).alias("baseline_runs"), F.expr("bround(percentile_cont(0.5) WITHIN GROUP (ORDER BY c), 0)").cast("bigint").alias("median_14d"))
    out = profiles.join(history, run, "left").withColumn("baseline_runs", F.coalesce("baseline_runs", F.lit(0)))
    out = out.withColumn("median_14d", F.when(F.col("baseline_runs") >= contract.baseline_runs, F.col("median_14d")))
    deviation = F.when(F.col("median_14d") != 0, (F.col(count) - F.col("median_14d")) / F.col("median_14d"))
    return out.withColumn("deviation", deviation).withColumn("insufficient_baseline", F.col("baseline_runs") < contract.baseline_runs)


def triggers(profiles: DataFrame, contract: Contract, run: str, medians: DataFrame | None = None) -> DataFrame:
    """(run, trigger, field, escalate_only, observed, threshold): a row for each signal that a run sets off.

    ``medians`` (run, field, median) adds the comparison of fill rates with their history; a run with too short
    a history is spared that.
    """
    made = []

    def signal(name: str, field: str | None, when, observed, threshold, only: bool = False) -> None:
        made.append(F.when(when, F.struct(F.lit(name).alias("trigger"), F.lit(field).cast("string").alias("field"), F.lit(only).alias("escalate_only"), observed.cast("double").alias("observed"), F.lit(threshold).cast("double").alias("threshold"))))

    for f in contract.fields:
        rate = F.col(f"fill_rate_{f.name}")
        signal("fill_rate_below_declared", f.name, rate < f.min_fill_rate, rate, f.min_fill_rate)
    if "deviation" in profiles.columns:
        signal("row_count_anomaly", None, F.abs("deviation") > contract.row_count_deviation, F.abs("deviation"), contract.row_count_deviation)
    for f in contract.fields:
        if f"range_rate_{f.name}" in profiles.columns:
            rate = F.col(f"range_rate_{f.name}")
            signal("range_violation", f.name, rate > contract.max_range_violation_rate, rate, contract.max_range_violation_rate)
    for f in contract.fields:
        if f"enum_{f.name}" in profiles.columns:
            signal("enum_violation", f.name, F.col(f"enum_{f.name}") > 0, F.col(f"enum_{f.name}"), 0, True)
    signal("natural_key_missing", None, F.col("natural_key_missing") > 0, F.col("natural_key_missing"), 0, True)
    signal("duplicate_rate", None, F.col("duplicate_rate") > contract.max_duplicate_rate, F.col("duplicate_rate"), contract.max_duplicate_rate)
    out = profiles.select(run, F.inline(F.array_compact(F.array(*made))))
    if medians is not None:
        pairs = F.map_from_arrays(F.array(*[F.lit(f.name) for f in contract.fields]), F.array(*[F.col(f"fill_rate_{f.name}") for f in contract.fields]))
        rates = profiles.filter(~F.col("insufficient_baseline")).select(run, F.explode(pairs).alias("field", "rate"))
        drop = rates.join(medians, [run, "field"]).filter("rate < median")
        out = out.unionByName(drop.select(run, F.lit("fill_rate_drop_vs_median").alias("trigger"), "field", F.lit(False).alias("escalate_only"), F.col("rate").alias("observed"), F.col("median").alias("threshold")))
    return out


def field_medians(profiles: DataFrame, contract: Contract, run: str, days: int = 14) -> DataFrame:
    """(run, field, median): the median fill rate of each field over the runs of the ``days`` before, if they are enough for a baseline."""
    pairs = F.map_from_arrays(F.array(*[F.lit(f.name) for f in contract.fields]), F.array(*[F.col(f"fill_rate_{f.name}") for f in contract.fields]))
    carried = profiles.select(F.explode(F.sequence(F.date_add(run, 1), F.date_add(run, days))).alias(run), pairs.alias("rates"))
    return carried.select(run, F.explode("rates").alias("field", "rate")).groupBy(run, "field").agg(F.count("rate").alias("_n"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY rate)").alias("median")).filter(F.col("_n") >= contract.baseline_runs).drop("_n")


def frame_checks(rows: DataFrame, contract: Contract, median: float | None = None) -> DataFrame:
    """(check, observed, passed) over a whole frame, from one aggregation; an empty frame passes all but the row count."""
    outside = reduce(lambda a, b: a | b, [out_of_range(F.col(f.name), f) for f in contract.fields], F.lit(False))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*contract.natural_key)).alias("keys"), F.count_if(outside).alias("outside"))
    rate = lambda c: F.when(F.col("n") > 0, c / F.col("n")).otherwise(F.lit(0.0))
    deviation = F.abs(F.col("n") - median) / median if median else F.lit(0.0)
    checks = [
        ("min_rows", F.col("n").cast("double"), F.col("n") >= contract.min_rows_per_run),
        ("duplicate_rate", rate(F.col("n") - F.col("keys")), rate(F.col("n") - F.col("keys")) <= contract.max_duplicate_rate),
        ("range_rate", rate(F.col("outside")), rate(F.col("outside")) <= contract.max_range_violation_rate),
        ("row_count", deviation, deviation <= contract.row_count_deviation),
    ]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check"), o.alias("observed"), p.alias("passed")) for n, o, p in checks])))


def column_checks(rows: DataFrame, contract: Contract) -> DataFrame:
    """(field, check, observed, passed) of each declared column over a whole frame, from one aggregation.

    Types must be the declared ones (any decimal or float for a decimal), required fields and natural keys may not be
    null, and values must be in the enum and fit the pattern from their start; nulls do both. Ranges are no
    column checks: some rows may be outside. A missing column fails its type alone; an empty frame passes.
    """
    types = {"string": ("string",), "decimal": ("decimal", "double", "float"), "integer": ("bigint", "int"), "boolean": ("boolean",), "datetime": ("timestamp", "timestamp_ntz")}
    have = dict(rows.dtypes)
    made = []
    for f in contract.fields:
        right = f.name in have and have[f.name].split("(")[0] in types[f.type]
        made.append((f.name, "dtype", F.count_if(F.lit(not right))))
        if f.name not in have:
            made[-1] = (f.name, "dtype", F.lit(1))
            continue
        c = F.col(f.name)
        if f.required or f.name in contract.natural_key:
            made.append((f.name, "nullable", F.count_if(c.isNull())))
        if f.enum:
            made.append((f.name, "enum", F.count_if(~c.isin(*f.enum))))
        if f.pattern:
            made.append((f.name, "pattern", F.count_if(~c.cast("string").rlike(f"^(?:{f.pattern})"))))
    one = rows.agg(*[n.cast("long").alias(f"_{i}") for i, (_, _, n) in enumerate(made)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("field"), F.lit(check).alias("check"), F.col(f"_{i}").alias("observed"), (F.col(f"_{i}") == 0).alias("passed")) for i, (name, check, _) in enumerate(made)])))


def strict_profiles(runs: DataFrame, kinds: dict[str, str], metrics: str = "metrics") -> DataFrame:
    """``runs`` with ``profile``: the quality block of their metrics (JSON) as a struct of ``kinds`` (name, Spark type).

    A block that lacks a name, has another one, or has a value of another type than declared is an error, not a null.
    """
    block = F.get_json_object(metrics, "$.quality")
    names = F.array_sort(F.coalesce(F.json_object_keys(block), F.array().cast("array<string>")))
    typed = F.from_json(block, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
    lost = [F.get_json_object(block, f"$.{n}").isNotNull() & typed[n].isNull() for n in kinds]
    drift = ~names.eqNullSafe(F.array(*[F.lit(n) for n in sorted(kinds)])) | reduce(lambda a, b: a | b, lost)
    return runs.withColumn("profile", F.when(drift, F.raise_error(F.concat(F.lit("a stored profile is not of its schema: "), F.coalesce(block, F.lit("none"))))).otherwise(typed))


def metric_rows(profiles: DataFrame, contract: Contract, run: str, domain: str, entity: str, status: str = "status", seconds: str = "seconds", http: str = "http", fetcher: str = "httpx") -> DataFrame:
    """(run, name, labels, value): the seven families of a run's metrics for export; ``labels`` is a map.

    Fill rates and counts of range violations (those above 0) by field, the deviation where the baseline is sufficient, the duplicate
    rate, rows, duration by ``status``, and pages by HTTP status (``http``: a map). A null value, and a null map, give no row.
    """
    of = {"domain": F.lit(domain), "entity": F.lit(entity)}

    def row(name: str, value, labels: dict[str, Column]):
        pairs = F.create_map(*[c for k, v in labels.items() for c in (F.lit(k), v.cast("string"))])
        return F.struct(F.lit(name).alias("name"), pairs.alias("labels"), value.cast("double").alias("value"))

    made = [row("field_fill_rate", F.col(f"fill_rate_{f.name}"), {**of, "field": F.lit(f.name)}) for f in contract.fields]
    made += [row("range_violations_total", F.nullif(F.col(f"range_{f.name}"), F.lit(0)), {**of, "field": F.lit(f.name)}) for f in contract.fields if f"range_{f.name}" in profiles.columns]
    made += [row("row_count_deviation", F.when(~F.col("insufficient_baseline"), F.col("deviation")), of), row("duplicate_rate", F.col("duplicate_rate"), of), row("rows_extracted_total", F.col("rows_considered"), of), row("run_duration_seconds", F.col(seconds), {**of, "status": F.col(status)})]
    pages = F.transform(F.map_entries(http), lambda e: row("pages_fetched_total", e["value"], {"domain": F.lit(domain), "fetcher": F.lit(fetcher), "http_status": e["key"]}))
    return profiles.select(run, F.inline(F.concat(F.array(*made), F.coalesce(pages, F.array().cast("array<struct<name:string,labels:map<string,string>,value:double>>"))))).filter("value is not null")


def p95_nearest_rank(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, p95): the value of rank ceil(0.95 n) of each group's n values, exact; nulls don't count, a group without values has 0.

    An approximate quantile, whose rank is wrong by 0.0001 n at most, gives bounds at 0.949 and 0.951. Rows below are
    only counted, and the distinct values between the bounds are all that is sorted.
    """
    x = rows.select(F.col(key).alias("_key"), F.col(value).alias("_x"))
    groups = x.groupBy("_key").agg(F.count("_x").alias("_n"), F.percentile_approx("_x", [0.949, 0.951], 10000).alias("_b"))
    g = groups.withColumnRenamed("_key", "_group")
    below = F.when(F.col("_x") >= F.col("_b")[0], F.col("_x"))  # null stands for all that is below
    near = x.filter("_x is not null").join(g, F.col("_key").eqNullSafe(F.col("_group"))).filter(F.col("_x") <= F.col("_b")[1])
    counted = near.groupBy("_key", below.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    upto = F.sum("_c").over(Window.partitionBy("_key").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("_upto", upto).filter(F.col("_upto") >= F.ceil(F.lit(0.95) * F.col("_n")))
    found = ranked.groupBy("_key").agg(F.min("_v").alias("p95"))
    return g.join(found, F.col("_key").eqNullSafe(F.col("_group")), "left").select(F.col("_group").alias(key), F.coalesce("p95", F.lit(0)).alias("p95"))


def first_of_each(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key in the order of ``seq``, null first; a partial minimum, so a very common key is no large group."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(seq)).alias("_first"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_first.{c}") for c in rows.columns])
