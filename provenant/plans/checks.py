"""Queries about whole columns, stored profiles, golden rows and values as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenant.functions import scalars
from provenant.operators import history, quality, replay
from provenant.operators.contract import Contract, Field
from provenant.plans import histories
from provenant.plans.runs import table

PARTS = Contract((Field("p_partkey", "integer", required=True), Field("p_name", required=True, pattern=".* 1?[0-9]$"), Field("p_type", enum=("ECONOMY", "STANDARD", "PROMO")), Field("p_size", "string"), Field("absent")), ("p_partkey",))


def column_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return quality.column_checks(p.withColumn("p_name", F.when(F.col("p_partkey") % 9 != 0, F.concat_ws(" ", F.lit("part"), F.col("p_partkey") % 30))), PARTS)


def strict_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fill rates of orders as runs."""
    done = quality.strict_profiles(histories.runs(spark, sf_dir), {"fill_rate": "map<string,double>"})
    return done.select("run_id", F.col("profile.fill_rate")["a"].alias("a"), F.col("profile.fill_rate")["b"].alias("b"))


def golden_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as golden rows; every third has been brought in before, every fourth only as another row."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("content_hash"))
    have = p.filter("page_id % 3 = 0 OR page_id % 4 = 0").select("content_hash", (F.col("page_id") % 3 == 0).alias("is_golden"))
    return history.golden_snapshots(p, have).select("content_hash", "is_golden", "trigger")


def zero_row_fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as fixtures that expect no rows, their suppliers as what was extracted; a debt makes a row invalid."""
    none = F.lit(None).cast("string")
    expected = table(spark, sf_dir, "nation").select(F.col("n_name").alias("fixture"), F.lit(0).cast("bigint").alias("row_ix"), none.alias("field"), none.alias("value"), F.lit(False).alias("required"), "n_nationkey")
    valid = (F.col("s_acctbal") >= 0) & (F.col("s_nationkey") % 2 == 0)
    actual = table(spark, sf_dir, "supplier").join(expected, F.col("s_nationkey") == F.col("n_nationkey")).select("fixture", F.col("s_suppkey").alias("row_ix"), F.lit("name").alias("field"), F.col("s_name").alias("value"), valid.alias("valid"))
    return replay.replay(expected.drop("n_nationkey"), actual)


def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON objects with their balance's share rounded; a third have no phone code."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    fields = {"name": F.col("c_name"), "balance": F.col("c_acctbal").cast("decimal(12,2)"), "key": key, "code": F.when(key % 3 != 0, key % 7), "even": key % 2 == 0}
    return c.select("c_custkey", scalars.json_safe(fields, {"name": "string", "balance": "decimal", "key": "integer", "code": "integer", "even": "boolean"}).alias("doc"), scalars.round6(key / 64).alias("share"))


QUERIES = {f.__name__: f for f in (column_checks, strict_profiles, golden_snapshots, zero_row_fixtures, json_safe)}

SQL = {
    "column_checks": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN 'part ' || (p_partkey % 30) END AS name, p_type FROM part), n AS (
  SELECT 'p_partkey' AS field, 'dtype' AS "check", 0 AS observed UNION ALL SELECT 'p_partkey', 'nullable', count(*) FILTER (p_partkey IS NULL) FROM p
  UNION ALL SELECT 'p_name', 'dtype', 0 UNION ALL SELECT 'p_name', 'nullable', count(*) FILTER (name IS NULL) FROM p UNION ALL SELECT 'p_name', 'pattern', count(*) FILTER (NOT regexp_full_match(name, '.* 1?[0-9]')) FROM p
  UNION ALL SELECT 'p_type', 'dtype', 0 UNION ALL SELECT 'p_type', 'enum', count(*) FILTER (p_type NOT IN ('ECONOMY', 'STANDARD', 'PROMO')) FROM p
  UNION ALL SELECT 'p_size', 'dtype', count(*) FROM p UNION ALL SELECT 'absent', 'dtype', 1
) SELECT field, "check", observed::BIGINT AS observed, observed = 0 AS passed FROM n""",
    "strict_profiles": "SELECT o_orderkey AS run_id, (o_orderkey % 8) / 8 AS a, 0.5::DOUBLE AS b FROM orders",
    "golden_snapshots": "SELECT DISTINCT sha256(html) AS content_hash, true AS is_golden, 'replay' AS trigger FROM pages WHERE html NOT IN (SELECT html FROM pages WHERE page_id % 3 = 0)",
    "zero_row_fixtures": """SELECT n_name AS fixture, 0::BIGINT AS compared, 0::BIGINT AS differing, count(*) FILTER (s_acctbal >= 0 AND n_nationkey % 2 = 0) = 0 AS passed
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
    "json_safe": """SELECT c_custkey, '{"name":"' || c_name || '","balance":"' || c_acctbal::DECIMAL(12, 2) || '","key":' || c_custkey || CASE WHEN c_custkey % 3 <> 0 THEN ',"code":' || (c_custkey % 7) ELSE '' END
  || ',"even":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS doc, round_even(c_custkey / 64, 6) AS share FROM customer""",
}
