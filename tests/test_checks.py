"""Ranks, column checks, stored profiles, golden rows, fixtures and a pack's answers, by cases and against brute force."""

import gzip
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenant.functions import scalars
from provenant.operators import history, quality, replay
from provenant.operators.contract import Contract, Field
from provenant.plans import checks
from provenant.sources import fixtures, packs

from test_lifecycle import BIKE


def test_p95_is_exact(spark):
    rng = random.Random(3)
    groups = {"one": [5.0], "twenty": [float(i) for i in range(20)], "ties": [1.0] * 90 + [2.0] * 10, "hot": [rng.lognormvariate(0, 4) for _ in range(30_000)], None: [3.0, -1.0], "none": []}
    rows = [(k, x) for k, xs in groups.items() for x in [*xs, None]]
    got = {r.k: r.p95 for r in quality.p95_nearest_rank(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()}
    assert got == {k: sorted(xs)[math.ceil(0.95 * len(xs)) - 1] if xs else 0.0 for k, xs in groups.items()}


def test_column_checks(spark):
    c = Contract((Field("a", required=True, pattern="x"), Field("n", "integer", enum=(1, 2)), Field("gone")), ("a",))
    t = spark.createDataFrame([("x1", 1.0), ("y", 3.0), (None, None)], "a string, n double")
    got = {(r.field, r.check): (r.observed, r.passed) for r in quality.column_checks(t, c).collect()}
    assert got == {("a", "dtype"): (0, True), ("a", "nullable"): (1, False), ("a", "pattern"): (1, False), ("n", "dtype"): (3, False), ("n", "enum"): (1, False), ("gone", "dtype"): (1, False)}
    assert all(r.passed for r in quality.column_checks(t.limit(0), Contract(c.fields[:1], ("a",))).collect())


@pytest.mark.parametrize("block", ['{"n":1}', '{"n":1,"rate":{"a":0.5},"more":2}', '{"n":"many","rate":{"a":0.5}}', None])
def test_a_profile_that_drifted_is_an_error(spark, block):
    kinds = {"n": "bigint", "rate": "map<string,double>"}
    good = spark.createDataFrame([('{"quality":{"n":1,"rate":{"a":0.5}}}',)], "metrics string")
    assert quality.strict_profiles(good, kinds).first().profile.rate == {"a": 0.5}
    bad = spark.createDataFrame([(None if block is None else '{"quality":%s}' % block,)], "metrics string")
    with pytest.raises(PySparkException):
        quality.strict_profiles(bad, kinds).collect()


def test_golden_rows_come_once(spark):
    golden = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "content_hash string, n int")
    have = spark.createDataFrame([("b", True), ("c", False), ("c", None)], "content_hash string, is_golden boolean")
    assert sorted(r.content_hash for r in history.golden_snapshots(golden, have).collect()) == ["a", "c"]


def test_fixtures_without_rows(spark):
    none = spark.createDataFrame([("f", 0, None, None, False), ("g", 0, None, None, False)], "fixture string, row_ix int, field string, value string, required boolean")
    actual = spark.createDataFrame([("f", 0, "a", "1", False), ("g", 0, "a", "1", True)], "fixture string, row_ix int, field string, value string, valid boolean")
    assert {r.fixture: r.passed for r in replay.replay(none, actual).collect()} == {"f": True, "g": False}


def test_a_corpus_of_fixtures(spark, tmp_path):
    for name, meta in (("x", {"golden_label": "L1"}), ("y", {"other": 1})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps(meta))
        (tmp_path / name / "expected.json").write_text('{"rows": 1}')
        (tmp_path / name / "page.html.gz").write_bytes(gzip.compress("<p>é\n</p>".encode()))
    got = fixtures.corpus(spark, str(tmp_path)).collect()
    assert [(r.label, r.expected, r.html) for r in got] == [("L1", '{"rows": 1}', "<p>é\n</p>")]


def test_values_as_json(spark):
    t = spark.sql("SELECT 'a\"b' AS s, CAST('1.50' AS DECIMAL(9,2)) AS d, true AS b, CAST(NULL AS INT) AS n, TIMESTAMP '2026-01-02 03:04:05' AS t")
    kinds = {"s": "string", "d": "decimal", "b": "boolean", "n": "integer", "t": "datetime"}
    doc = t.select(scalars.json_safe({k: F.col(k) for k in kinds}, kinds).alias("j")).first().j
    assert doc == '{"s":"a\\"b","d":"1.50","b":true,"t":"2026-01-02T03:04:05"}'


@pytest.mark.parametrize(
    "change, wrong",
    [({}, []), ({"tos_verdict": "forbids"}, ["compliance:tos_verdict"]), ({"personal_data": True, "legal_basis": " "}, ["compliance:legal_basis"]), ({"personal_data": True, "legal_basis": "contract"}, []), ({"reviewed_by": ""}, ["compliance:reviewed_by"])],
)
def test_answers_of_a_pack(change, wrong):
    assert packs.check({**BIKE, "compliance": {**BIKE["compliance"], **change}}) == wrong


def test_a_pack_must_answer_and_heed_robots():
    assert packs.check({k: v for k, v in BIKE.items() if k != "compliance"}) == ["compliance"]
    assert packs.check({**BIKE, "fetch": {"respect_robots": False}}) == ["fetch:respect_robots"]
    assert packs.css_fields(BIKE) == {"model", "deposit", "frame"}


def test_sources_and_domains_of_a_pack():
    sources = lambda *x: [w for w in packs.check({**BIKE, "extract": {"sources": list(x)}}) if not w.startswith("unsourced")]
    assert packs.check({**BIKE, "domain": "a..b"}) == [] and packs.check({**BIKE, "domain": "a..Amazon." + "x" * 70}) == ["denied:amazon"]
    assert sources({"kind": "xhr", "method": "post", "fields": {}}) == ["xhr:method"] and sources({"kind": "xhr", "fields": {}}) == []
    assert sources({"kind": "ftp", "fields": {}}) == ["source:ftp"]
    assert sources({"kind": "css", "row_selector": "a:hover", "fields": {"x": "b > c@d", "y": {"selector": "p["}}}) == ["y:selector", "row_selector:selector"]


def test_what_a_contract_must_have():
    css = {"kind": "css", "fields": {"frame": "td", "model": "h2"}}
    only = lambda **f: {**BIKE, "extract": {"sources": [css]}, "schema": {"natural_key": ["frame"], "fields": {"frame": {"type": "string", "required": True}, **f}}}
    assert packs.check(only()) == [] and packs.check(only(gears={"type": "integer"})) == ["unsourced:gears"]
    assert packs.check(only(gears={"type": "integer", "derived_from": {"source": "model", "transform": "int_from_text"}})) == []
    assert packs.check(only(model={"type": "string", "required": True, "min_fill_rate": 0.4})) == ["min_fill_rate:model"]
    assert packs.check(only(frame={"type": "string"})) == ["natural_key_optional:frame"]
    linked = {"kind": "jsonld", "type": "P", "fields": {"gears": "gears"}, "transforms": {"gears": ["parse_currency", "strip"]}}
    document = only(gears={"type": "integer"})
    document["extract"] = {"sources": [css, linked]}
    assert packs.check(document) == ["gears:transform_type_mismatch:strip"]
    linked["transforms"]["gears"] = ["strip"]
    assert packs.pack(document).transforms() == {"frame": [], "model": [], "gears": ["strip"]}


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_checks_agree_with_their_sql(spark, name):
    import duckdb

    con, home = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("orders", "customer", "supplier", "nation", "part", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{home}/{t}.parquet')")
    got = checks.QUERIES[name](spark, home)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({checks.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
