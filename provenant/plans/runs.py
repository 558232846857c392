"""Queries about runs: profiles, baselines, signals, verdicts. A day of events stands for a run."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.held import held
from provenant.operators import classify, quality, validate
from provenant.operators.contract import Contract, Field

EVENTS = Contract(
    fields=(
        Field("user_id", "integer", required=True),
        Field("event_type", required=True, enum=("click", "purchase", "signup", "view")),
        Field("value", "decimal", required=True, low=0.05, high=300.0, min_fill_rate=0.9),
        Field("k", "integer", min_fill_rate=0.9),
    ),
    natural_key=("user_id", "event_type"),
    row_count_deviation=0.05,
    max_range_violation_rate=0.01,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of daily runs; every tenth k is missing, so that a field has gaps."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_id", "user_id", "event_type", "value", F.when(k.cast("int") % 10 != 3, k).alias("k"))


EVENT_ROWS = """rows AS (
  SELECT ts::DATE AS day, event_id, user_id, event_type, value, CASE WHEN json_extract_string(props, '$.k')::INT % 10 <> 3 THEN json_extract_string(props, '$.k') END AS k FROM events
)"""
PROFILES = (
    EVENT_ROWS
    + """, profiles AS (
  SELECT day, count(*) AS rows_considered, count(user_id) / count(*) AS fill_rate_user_id, count(event_type) / count(*) AS fill_rate_event_type, count(value) / count(*) AS fill_rate_value, count(k) / count(*) AS fill_rate_k,
    count(*) FILTER (value < 0.05 OR value > 300.0) / count(*) AS range_rate_value, count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup', 'view')) AS enum_event_type,
    count(*) FILTER (user_id IS NULL OR event_type IS NULL) AS natural_key_missing, (count(*) - count(DISTINCT (user_id, event_type))) / count(*) AS duplicate_rate
  FROM rows GROUP BY day
), judged AS (
  SELECT p.*, b.baseline_runs, b.median_14d, CASE WHEN b.median_14d <> 0 THEN (p.rows_considered - b.median_14d) / b.median_14d END AS deviation, b.baseline_runs < 3 AS insufficient_baseline
  FROM profiles p JOIN (
    SELECT p.day, count(q.day) AS baseline_runs, CASE WHEN count(q.day) >= 3 THEN round_even(quantile_cont(q.rows_considered, 0.5), 0)::BIGINT END AS median_14d FROM profiles p LEFT JOIN profiles q ON q.day < p.day AND q.day >= p.day - 14 GROUP BY p.day
  ) b ON b.day = p.day
), signals AS (
  SELECT day, 'fill_rate_below_declared' AS trigger, 'k' AS field, false AS escalate_only, fill_rate_k AS observed, 0.9::DOUBLE AS threshold FROM judged WHERE fill_rate_k < 0.9
  UNION ALL SELECT day, 'fill_rate_below_declared', 'value', false, fill_rate_value, 0.9 FROM judged WHERE fill_rate_value < 0.9
  UNION ALL SELECT day, 'fill_rate_below_declared', 'user_id', false, fill_rate_user_id, 1 FROM judged WHERE fill_rate_user_id < 1
  UNION ALL SELECT day, 'fill_rate_below_declared', 'event_type', false, fill_rate_event_type, 1 FROM judged WHERE fill_rate_event_type < 1
  UNION ALL SELECT day, 'row_count_anomaly', NULL, false, abs(deviation), 0.05 FROM judged WHERE abs(deviation) > 0.05
  UNION ALL SELECT day, 'range_violation', 'value', false, range_rate_value, 0.01 FROM judged WHERE range_rate_value > 0.01
  UNION ALL SELECT day, 'enum_violation', 'event_type', true, enum_event_type, 0 FROM judged WHERE enum_event_type > 0
  UNION ALL SELECT day, 'natural_key_missing', NULL, true, natural_key_missing, 0 FROM judged WHERE natural_key_missing > 0
  UNION ALL SELECT day, 'duplicate_rate', NULL, false, duplicate_rate, 0.02 FROM judged WHERE duplicate_rate > 0.02
)"""
)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each day, held: what reads it several times doesn't make it again."""
    return held(quality.with_baseline(held(quality.profile(event_rows(spark, sf_dir), EVENTS, "day"), "profile"), EVENTS, "day"), "baseline")


def daily_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's profile, deviation from the median of the 14 days before, signals and outcome."""
    days = profiles(spark, sf_dir)
    signals = quality.triggers(days, EVENTS, "day")
    outcome = classify.classify(days.select("day", F.lit("ok").alias("verdict")), signals, "day")
    shown = ["day", "rows_considered", "fill_rate_k", "range_rate_value", "enum_event_type", "duplicate_rate", "baseline_runs", "median_14d", "deviation"]
    return days.select(*shown).join(outcome, "day")


DAILY_PROFILE = f"""WITH {PROFILES}, kinds AS (
  SELECT day, CASE trigger WHEN 'fill_rate_below_declared' THEN 'fill_rate_drop' WHEN 'natural_key_missing' THEN 'natural_key_broken' WHEN 'duplicate_rate' THEN 'duplicate_rate_anomaly' ELSE trigger END AS kind FROM signals
)
SELECT j.day, rows_considered, fill_rate_k, range_rate_value, enum_event_type, duplicate_rate, baseline_runs, median_14d, deviation,
  CASE WHEN (SELECT count(*) FROM kinds k WHERE k.day = j.day AND kind <> 'row_count_anomaly') = 0 THEN 'no_action' ELSE 'escalated' END AS outcome,
  coalesce((SELECT string_agg(kind, ',' ORDER BY list_position(['fill_rate_drop', 'row_count_anomaly', 'range_violation', 'enum_violation', 'natural_key_broken', 'duplicate_rate_anomaly'], kind)) FROM (SELECT DISTINCT day, kind FROM kinds) k WHERE k.day = j.day), '') AS kinds
FROM judged j"""


def history_count_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: runs (days) in the last 14 days before the end, and the rounded median of their events."""
    e = event_rows(spark, sf_dir)
    end = e.agg(F.max("day").alias("end"))
    days = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    recent = days.crossJoin(F.broadcast(end)).filter(F.col("day") > F.date_sub("end", 14))  # one row: the last day
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.expr("CASE WHEN count(1) >= 3 THEN cast(bround(percentile_cont(0.5) WITHIN GROUP (ORDER BY n), 0) AS bigint) END").alias("median_rows"))


def history_field_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median fill rate of each field over all days, by exploding each run's map of rates."""
    p = quality.profile(event_rows(spark, sf_dir), EVENTS, "day")
    rates = F.map_from_arrays(F.array(*[F.lit(f.name) for f in EVENTS.fields]), F.array(*[F.col(f"fill_rate_{f.name}") for f in EVENTS.fields]))
    p.select("day", rates.alias("fill_rate")).createOrReplaceTempView("run_fill_rates")
    return spark.sql("SELECT f.field, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY f.rate), 9) AS median FROM run_fill_rates r, LATERAL explode(r.fill_rate) AS f(field, rate) GROUP BY f.field")


def p95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.p95_nearest_rank(event_rows(spark, sf_dir), "event_type", "value")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract((Field("doc_id", "integer"), Field("quality", "integer"), Field("n_chars", "integer")), ("doc_id",))
    p = quality.profile(labelled(spark, sf_dir), contract, "lang")
    return p.select("lang", "rows_considered", "fill_rate_quality", "fill_rate_n_chars")


PARTS = Contract((Field("p_partkey", "integer", required=True), Field("p_size", "integer", low=5, high=45), Field("p_retailprice", "decimal", low=905, high=990), Field("p_type", enum=("ECONOMY", "STANDARD", "PROMO"))), ("p_partkey",))


def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = quality.profile(table(spark, sf_dir, "part"), PARTS, "p_brand")
    return p.select("p_brand", F.col("range_p_size").alias("n_size"), "range_rate_p_size", F.col("range_p_retailprice").alias("n_price"), "range_rate_p_retailprice")


def enum_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(table(spark, sf_dir, "part"), PARTS, "p_brand").select("p_brand", F.col("enum_p_type").alias("n"))


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract((Field("l_orderkey", "integer"), Field("l_linenumber", "integer")), ("l_orderkey", "l_linenumber"))
    return quality.profile(table(spark, sf_dir, "lineitem"), contract, "l_returnflag").select("l_returnflag", "rows_considered", "keys", "duplicates", "duplicate_rate")


def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    contract = Contract((Field("l_orderkey", "integer"), Field("l_linenumber", "integer"), Field("l_quantity", "decimal", low=2, high=49), Field("l_discount", "decimal", high=0.09)), ("l_orderkey", "l_linenumber"), min_rows_per_run=1000)
    return quality.frame_checks(table(spark, sf_dir, "lineitem"), contract, median=6000.0)


def run_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.triggers(profiles(spark, sf_dir), EVENTS, "day")


def fill_drop_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profiles(spark, sf_dir)
    found = quality.triggers(p, EVENTS, "day", quality.field_medians(p, EVENTS, "day"))
    return found.filter("trigger = 'fill_rate_drop_vs_median'").select("day", "field", F.round("observed", 9).alias("observed"), F.round("threshold", 9).alias("threshold"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's metrics; types of events stand for HTTP statuses, tenths of rows for seconds."""
    http = event_rows(spark, sf_dir).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("http"))  # a day's types are few
    p = profiles(spark, sf_dir).join(http, "day").withColumns({"status": F.when(F.col("duplicate_rate") > 0.02, "degraded").otherwise("ok"), "seconds": F.col("rows_considered") / 10})
    rows = quality.metric_rows(p, EVENTS, "day", "shop", "event")
    return rows.withColumn("labels", F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with circumstances: an error stands for a refused page, a signup for a block, and so on."""
    kind = lambda x: F.count_if(F.col("event_type") == x)
    return event_rows(spark, sf_dir).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("pages"), kind("error").alias("n429"), kind("signup").alias("n403"), kind("purchase").alias("autos"), F.count("k").alias("valid"), F.count_if(F.col("value") > 200).alias("bad"))


USER_DAYS = (
    EVENT_ROWS
    + """, runs AS (
  SELECT user_id, day, count(*) AS pages, count(*) FILTER (event_type = 'error') AS n429, count(*) FILTER (event_type = 'signup') AS n403, count(*) FILTER (event_type = 'purchase') AS autos, count(k) AS valid, count(*) FILTER (value > 200) AS bad FROM rows GROUP BY user_id, day
), verdicts AS (
  SELECT *, CASE WHEN pages > 5 THEN 'unreachable' WHEN bad > 0 THEN 'blocked' WHEN pages > 0 AND 2 * (n429 + n403) > pages THEN 'rate_limited' WHEN valid = 0 THEN 'soft_404' WHEN autos >= 2 THEN 'quota_exhausted' ELSE 'ok' END AS verdict FROM runs
)"""
)


def with_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = user_days(spark, sf_dir)
    verdict = classify.precheck_verdict(F.col("pages") > 5, F.col("bad") > 0, classify.throttled(F.col("pages"), F.col("n429"), F.col("n403")), F.col("valid") == 0, F.col("autos"), 2)
    return r.withColumn("verdict", verdict)


def precheck_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_verdicts(spark, sf_dir).select("user_id", "day", "verdict")


def throttle_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_days(spark, sf_dir).select("user_id", "day", classify.throttled(F.col("pages"), F.col("n429"), F.col("n403")).alias("throttled"))


def final_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_verdicts(spark, sf_dir)
    return r.select("user_id", "day", classify.final_status(F.col("autos") > 3, F.col("verdict"), F.col("n429") > 0, F.col("valid"), 2).alias("status"))


def classify_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = with_verdicts(spark, sf_dir).withColumn("run", F.concat_ws("/", "user_id", "day"))
    signals = r.select("run", F.explode(F.array_compact(F.array(F.when(F.col("pages") > 2, "row_count_anomaly"), F.when(F.col("n403") > 0, "natural_key_missing"), F.when(F.col("n429") > 0, "duplicate_rate")))).alias("trigger"))
    return classify.classify(r, signals, "run", can_heal=True)


def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_rows(spark, sf_dir).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.groupBy("day").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda s: F.concat_ws("=", s["event_type"], s["n"])), ",").alias("histogram"))


CUSTOMERS = Contract(
    (Field("c_custkey", "integer", required=True), Field("c_name", pattern="Customer#0000[0-9]+$"), Field("c_acctbal", "decimal", low=0, high=9000), Field("c_mktsegment", enum=("BUILDING", "MACHINERY", "HOUSEHOLD")), Field("code", "integer")),
    ("c_custkey", "c_mktsegment"),
)


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as texts, some with an empty key or a code that is no number."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    code = F.when(key % 7 == 0, "n/a").when(key % 7 == 1, F.concat(key.cast("string"), F.lit(".0"))).when(key % 7 == 2, F.lit("")).otherwise(key.cast("string"))
    return c.select(key.cast("string").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("c_acctbal"), F.when(key % 11 != 0, F.col("c_mktsegment")).otherwise("").alias("c_mktsegment"), code.alias("code"))


def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = validate.validate(customer_rows(spark, sf_dir), CUSTOMERS)
    return v.select("c_custkey", "accepted", F.array_join("reasons", ",").alias("reasons"), F.when(F.col("accepted"), F.col("code_typed")).alias("code"))


VALIDATED = """texts AS (
  SELECT c_custkey, c_name, c_acctbal::DECIMAL(12, 2) AS c_acctbal, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment ELSE '' END AS seg, CASE c_custkey % 7 WHEN 0 THEN 'n/a' WHEN 1 THEN c_custkey || '.0' WHEN 2 THEN '' ELSE c_custkey::VARCHAR END AS code FROM customer
), hard AS (
  SELECT *, seg = '' AS missing, CASE WHEN code = 'n/a' THEN 'type_error:code' WHEN NOT regexp_matches(c_name, '^Customer#0000[0-9]+$') THEN 'type_error:c_name' ELSE '' END AS wrong,
    concat_ws(',', CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'range_violation:c_acctbal' END, CASE WHEN seg NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'enum_violation:c_mktsegment' END) AS soft FROM texts
), validated AS (
  SELECT c_custkey::VARCHAR AS c_custkey, NOT missing AND wrong = '' AS accepted, CASE WHEN missing THEN 'natural_key_missing' WHEN wrong <> '' THEN wrong ELSE soft END AS reasons, CASE WHEN code NOT IN ('n/a', '') THEN replace(code, '.0', '')::BIGINT END AS code FROM hard
)"""


def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.reject_histogram(validate.validate(customer_rows(spark, sf_dir), CUSTOMERS))


def _dated(query):
    """The query with its days as texts, so that dates and timestamps of other engines compare alike."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.withColumn("day", F.col("day").cast("string")) if "day" in out.columns else out

    return run


QUERIES = {
    f.__name__: _dated(f)
    for f in (
        daily_profile, history_count_median, history_field_median, p95_nearest_rank, fill_rate, range_violations, enum_violations, duplicate_rate, frame_checks, run_triggers, fill_drop_triggers,
        metric_rows, precheck_verdict, throttle_verdict, final_status, classify_outcome, status_histogram, validate_rows, reject_histogram,
    )
}

SQL = {
    "daily_profile": DAILY_PROFILE,
    "history_count_median": f"""WITH {EVENT_ROWS}, days AS (SELECT user_id, day, count(*) AS n FROM rows GROUP BY 1, 2)
SELECT user_id, count(*) AS runs, CASE WHEN count(*) >= 3 THEN round_even(quantile_cont(n, 0.5), 0)::BIGINT END AS median_rows FROM days WHERE day > (SELECT max(day) FROM rows) - 14 GROUP BY user_id""",
    "history_field_median": f"""WITH {PROFILES} SELECT field, round(quantile_cont(rate, 0.5), 9) AS median FROM (
  SELECT 'user_id' AS field, fill_rate_user_id AS rate FROM profiles UNION ALL SELECT 'event_type', fill_rate_event_type FROM profiles UNION ALL SELECT 'value', fill_rate_value FROM profiles UNION ALL SELECT 'k', fill_rate_k FROM profiles) GROUP BY field""",
    "p95_nearest_rank": "SELECT event_type, coalesce(quantile_disc(value, 0.95), 0) AS p95 FROM events GROUP BY event_type",
    "fill_rate": "SELECT lang, count(*) AS rows_considered, count(quality) / count(*) AS fill_rate_quality, count(n_chars) / count(*) AS fill_rate_n_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "range_violations": """SELECT p_brand, count(*) FILTER (p_size < 5 OR p_size > 45) AS n_size, count(*) FILTER (p_size < 5 OR p_size > 45) / count(*) AS range_rate_p_size,
  count(*) FILTER (p_retailprice < 905 OR p_retailprice > 990) AS n_price, count(*) FILTER (p_retailprice < 905 OR p_retailprice > 990) / count(*) AS range_rate_p_retailprice FROM part GROUP BY p_brand""",
    "enum_violations": "SELECT p_brand, count(*) FILTER (p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO')) AS n FROM part GROUP BY p_brand",
    "duplicate_rate": """SELECT l_returnflag, count(*) AS rows_considered, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicates,
  (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*) AS duplicate_rate FROM lineitem GROUP BY l_returnflag""",
    "frame_checks": """WITH one AS (SELECT count(*) AS n, count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) FILTER (l_quantity < 2 OR l_quantity > 49 OR l_discount > 0.09) AS outside FROM lineitem)
SELECT 'min_rows' AS "check", n::DOUBLE AS observed, n >= 1000 AS passed FROM one UNION ALL SELECT 'duplicate_rate', (n - keys) / n, (n - keys) / n <= 0.02 FROM one
UNION ALL SELECT 'range_rate', outside / n, outside / n <= 0.05 FROM one UNION ALL SELECT 'row_count', abs(n - 6000.0::DOUBLE) / 6000.0::DOUBLE, abs(n - 6000.0::DOUBLE) / 6000.0::DOUBLE <= 0.3 FROM one""",
    "run_triggers": f"WITH {PROFILES} SELECT * FROM signals",
    "fill_drop_triggers": f"""WITH {PROFILES}, rates AS (
  SELECT day, insufficient_baseline, unnest([('user_id', fill_rate_user_id), ('event_type', fill_rate_event_type), ('value', fill_rate_value), ('k', fill_rate_k)]) AS r FROM judged
), flat AS (SELECT day, insufficient_baseline, r[1] AS field, r[2] AS rate FROM rates), medians AS (
  SELECT p.day, p.field, quantile_cont(q.rate, 0.5) AS median FROM flat p JOIN flat q ON q.field = p.field AND q.day < p.day AND q.day >= p.day - 14 GROUP BY p.day, p.field HAVING count(*) >= 3
) SELECT f.day, f.field, round(f.rate, 9) AS observed, round(m.median, 9) AS threshold FROM flat f JOIN medians m USING (day, field) WHERE NOT insufficient_baseline AND f.rate < m.median""",
    "metric_rows": f"""WITH {PROFILES}, x AS (SELECT j.*, 'domain=shop,entity=event' AS de FROM judged j) SELECT * FROM (
  SELECT day, 'field_fill_rate' AS name, de || ',field=user_id' AS labels, fill_rate_user_id::DOUBLE AS value FROM x UNION ALL SELECT day, 'field_fill_rate', de || ',field=event_type', fill_rate_event_type FROM x UNION ALL SELECT day, 'field_fill_rate', de || ',field=value', fill_rate_value FROM x
  UNION ALL SELECT day, 'field_fill_rate', de || ',field=k', fill_rate_k FROM x UNION ALL SELECT day, 'range_violations_total', de || ',field=value', nullif(round(range_rate_value * rows_considered), 0) FROM x
  UNION ALL SELECT day, 'row_count_deviation', de, CASE WHEN NOT insufficient_baseline THEN deviation END FROM x UNION ALL SELECT day, 'duplicate_rate', de, duplicate_rate FROM x UNION ALL SELECT day, 'rows_extracted_total', de, rows_considered FROM x
  UNION ALL SELECT day, 'run_duration_seconds', de || ',status=' || CASE WHEN duplicate_rate > 0.02 THEN 'degraded' ELSE 'ok' END, rows_considered / 10 FROM x
  UNION ALL SELECT day, 'pages_fetched_total', 'domain=shop,fetcher=httpx,http_status=' || event_type, count(*) FROM rows GROUP BY day, event_type) WHERE value IS NOT NULL""",
    "precheck_verdict": f"WITH {USER_DAYS} SELECT user_id, day, verdict FROM verdicts",
    "throttle_verdict": f"WITH {USER_DAYS} SELECT user_id, day, pages > 0 AND 2 * (n429 + n403) > pages AS throttled FROM runs",
    "final_status": f"WITH {USER_DAYS} SELECT user_id, day, CASE WHEN autos > 3 THEN 'failed' WHEN verdict <> 'ok' OR n429 > 0 THEN 'degraded' WHEN valid < 2 THEN 'failed' ELSE 'ok' END AS status FROM verdicts",
    "classify_outcome": f"""WITH {USER_DAYS}, own AS (
  SELECT user_id || '/' || day AS run, verdict, CASE verdict WHEN 'soft_404' THEN 'unreachable' WHEN 'quota_exhausted' THEN 'healer_exhausted' ELSE verdict END AS mine, n403 > 0 AS broken, n429 > 0 AS dup, pages > 2 AS anomaly FROM verdicts
) SELECT run, CASE WHEN verdict <> 'ok' THEN CASE WHEN broken THEN 'escalated' ELSE 'no_action' END WHEN NOT broken AND NOT dup THEN 'no_action' WHEN NOT broken THEN 'auto_healed' ELSE 'escalated' END AS outcome,
  CASE WHEN verdict <> 'ok' THEN CASE WHEN broken THEN mine || ',natural_key_broken' ELSE mine END
  ELSE concat_ws(',', CASE WHEN anomaly THEN 'row_count_anomaly' END, CASE WHEN broken THEN 'natural_key_broken' END, CASE WHEN dup THEN 'duplicate_rate_anomaly' END) END AS kinds FROM own""",
    "status_histogram": f"WITH {EVENT_ROWS} SELECT day, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT day, event_type, count(*) AS n FROM rows GROUP BY 1, 2) GROUP BY day",
    "validate_rows": f"WITH {VALIDATED} SELECT c_custkey, accepted, reasons, CASE WHEN accepted THEN code END AS code FROM validated",
    "reject_histogram": f"WITH {VALIDATED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM validated WHERE NOT accepted) GROUP BY reason",
}

_DAYS = ("daily_profile", "run_triggers", "fill_drop_triggers", "metric_rows", "precheck_verdict", "throttle_verdict", "final_status", "status_histogram")
SQL |= {name: f"SELECT * REPLACE (strftime(day, '%Y-%m-%d') AS day) FROM ({SQL[name]})" for name in _DAYS}
