"""Histories, incidents, validation, detection and the queries against their SQL."""

import datetime as dt
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenant.operators import classify, detect, discovery, history, quality, replay, responses, scd2, tables, validate
from provenant.operators.contract import Contract, Field
from provenant.plans import histories
from provenant.plans import pages as page_plans

CURRENT = "entity string, natural_key string, payload_hash string, snapshot_id string, valid_from int, last_seen_at int"
INCOMING = "entity string, natural_key string, seq int, payload_hash string, snapshot_id string"


def test_scd2_changes(spark):
    current = spark.createDataFrame([("e", "same", "h", "s0", 1, 1), ("e", "new version", "h", "s0", 1, 1), ("e", "untouched", "h", "s0", 1, 1)], CURRENT)
    incoming = spark.createDataFrame([("e", "same", 1, "h", "s1"), ("e", "new version", 2, "i", "s1"), ("e", "fresh", 3, "a", "s1"), ("e", "fresh", 4, "b", "s1")], INCOMING)
    done = scd2.apply(current, incoming, F.lit(5))
    assert {(r.natural_key, r.payload_hash, r.snapshot_id, r.valid_from, r.last_seen_at) for r in done.current.collect()} == {("same", "h", "s0", 1, 5), ("new version", "i", "s1", 5, 5), ("untouched", "h", "s0", 1, 1), ("fresh", "a", "s1", 5, 5)}
    assert [(r.natural_key, r.valid_to) for r in done.closed.collect()] == [("new version", 5)]
    assert {r.change: r.n for r in done.counters.collect()} == {"unchanged": 1, "versioned": 1, "inserted": 1, "duplicate": 1}
    assert scd2.broken_rules(done.current, done.closed).count() == 0
    with pytest.raises(PySparkException):
        scd2.apply(current, incoming, F.lit(1)).closed.collect()


def test_incidents_are_upserted(spark):
    kind = "pack_id int, kind string, field string, run_id string, severity string, occurrences int, evidence map<string,string>"
    opened = spark.createDataFrame([(1, "a", None, "r0", "warn", 2, {"x": "old", "y": "old"}), (2, "a", "f", "r0", "warn", 1, {})], kind)
    reports = spark.createDataFrame([(1, "a", None, 1, "r1", "warn", {"x": "1"}), (1, "a", None, 2, "r2", "critical", {"z": "2"}), (3, "b", None, 3, "r3", "warn", None)], "pack_id int, kind string, field string, seq int, run_id string, severity string, evidence map<string,string>")
    got = {(r.pack_id, r.field): (r.run_id, r.severity, r.occurrences, r.evidence) for r in tables.upsert_incidents(opened, reports).collect()}
    assert got == {(1, None): ("r2", "critical", 4, {"x": "1", "y": "old", "z": "2"}), (2, "f"): ("r0", "warn", 1, {}), (3, None): ("r3", "warn", 1, {})}


def test_validation_reasons(spark):
    c = Contract((Field("id", pattern="[a-f0-9]{4}$"), Field("n", "integer", low=0, high=9), Field("b", "boolean"), Field("k", enum=("x", "y"))), ("id",))
    rows = [("ab12", "5.0", "yes", "x"), ("", "5", "yes", "x"), ("zz", "5.5", "2", "x"), ("ab12", "12", "TRUE", "z"), ("ab12", None, None, None)]
    got = validate.validate(spark.createDataFrame(rows, "id string, n string, b string, k string"), c).collect()
    assert [(r.accepted, r.reasons) for r in got] == [(True, []), (False, ["natural_key_missing"]), (False, ["type_error:n", "type_error:b"]), (True, ["range_violation:n", "enum_violation:k"]), (True, [])]
    assert got[0].n_typed == 5 and got[0].b_typed is True


def test_profile_of_an_empty_denominator(spark):
    c = Contract((Field("a", required=True), Field("v", "decimal", low=1)), ("a",))
    p = quality.profile(spark.createDataFrame([("r", "x", 0.5, True)], "run string, a string, v double, same boolean"), c, "run", "same").first()
    assert (p.rows_considered, p.fill_rate_a, p.range_v, p.range_rate_v) == (1, 0.0, 1, 0.0)


def test_gold_leaves_out_what_is_quarantined(spark):
    packs = spark.createDataFrame([(1, "d", 7)], "pack_id int, domain string, version int")
    rows = [(1, "a", '{"p":"1.5"}', "{}", 1, None), (1, "b", '{"p":"1e3"}', None, 1, None), (1, "c", "{}", '{"violations":null}', 1, None), (1, "d", "{}", "{}", 1, 2)]
    got = tables.gold(spark.createDataFrame(rows, "pack_id int, natural_key string, payload string, quality string, valid_from int, valid_to int"), packs, {"p": "decimal(9,2)"})
    assert {(r.natural_key, None if r.p is None else float(r.p)) for r in got.collect()} == {("a", 1.5), ("b", None)}


def test_responses(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    t = spark.createDataFrame([("7",), ("900",), ("Thu, 01 Jan 2026 00:01:00 GMT",), ("Wed, 31 Dec 2025 00:00:00 GMT",), ("soon",), (None,)], "h string")
    assert [r[0] for r in t.select(responses.retry_after(F.col("h"), now)).collect()] == [7.0, 300.0, 60.0, 0.0, 1.0, 1.0]
    b = spark.createDataFrame([(b"\xef\xbb\xbfx", None), (b"<meta charset='Latin-1'>", "text/html"), (b"x", "text/html; charset=UTF-16"), (b"x", None)], "b binary, c string")
    assert [r[0] for r in b.select(responses.encoding(F.col("b"), F.col("c"))).collect()] == ["utf-8", "latin-1", "utf-16", "utf-8"]


def test_snapshots(spark):
    at = dt.datetime(2026, 3, 1)
    have = spark.createDataFrame([("http://a/1", at, 200, "h", "k", "e1"), ("http://a/1", dt.datetime(2026, 3, 2), 500, "x", "kx", None)], "url string, fetched_at timestamp, http_status int, content_hash string, blob_key string, etag string")
    come = spark.createDataFrame([("http://a/1", at, 304, None, None), ("http://a/2", at, 304, None, None), ("http://a/3", at, 200, "body", "e3"), ("http://a/4", at, None, None, None)], "url string, fetched_at timestamp, http_status int, body string, etag string")
    got = {r.url: r for r in tables.snapshot_rows(come, have).collect()}
    assert set(got) == {"http://a/1", "http://a/2", "http://a/3"}
    assert (got["http://a/1"].content_hash, got["http://a/1"].blob_key, got["http://a/1"].byte_size, got["http://a/1"].etag) == ("h", "k", 0, "e1")
    assert got["http://a/2"].dangling and got["http://a/3"].blob_key.startswith("raw/a/2026/03/") and got["http://a/3"].byte_size == 4


def test_detection(spark):
    good = "<html><title>T</title><body>" + "word " * 60
    pages = [(1, good, 200), (2, good + '<i class="cmp-container">', 200), (3, "<title>404</title><body>" + "w " * 200, 200), (4, "<title>404</title><body>" + "w " * 200, 404), (5, "<body>short<script>" + "x" * 300 + "</script>", 200), (6, '<meta http-equiv="Refresh" content="0; url=/consent">' + good, 200)]
    got = {r.i: (r.block, r.soft_404) for r in detect.detect(spark.createDataFrame(pages, "i int, html string, http_status int")).collect()}
    assert got == {1: (None, None), 2: ("generic_cmp", None), 3: (None, "soft_404_title"), 4: (None, None), 5: ("text_floor", None), 6: ("meta_refresh_consent", None)}


def test_pagination_ends_where_nothing_is_new(spark):
    page = lambda *x: "".join(f'<a href="{h}">x</a>' for h in x)
    pages = [(1, "http://a/1", 200, page("/p", "/q")), (2, "http://a/2", 200, page("/q", "/r")), (3, "http://a/3", 200, page("/p")), (4, "http://a/4", 200, page("/s"))]
    t = spark.createDataFrame(pages, "n int, url string, http_status int, html string")
    assert [r.url for r in discovery.paginate(t, "a", ".").collect()] == ["http://a/p", "http://a/q", "http://a/r"]
    assert [r.url for r in discovery.paginate(t, "a", ".", most=2).collect()] == ["http://a/p", "http://a/q"]
    assert (discovery.run_cap(0, None), discovery.run_cap(0, 5), discovery.run_cap(3, 2)) == (None, 0, 2)


def test_replay_gate(spark):
    expected = spark.createDataFrame([("f", 0, "a", "1", True), ("f", 0, "b", None, False), ("g", 0, "a", "1", True), ("z", 0, None, None, False)], "fixture string, row_ix int, field string, value string, required boolean")
    actual = spark.createDataFrame([("f", 0, "a", "1"), ("f", 0, "b", "x"), ("g", 0, "a", "2")], "fixture string, row_ix int, field string, value string")
    got = replay.replay(expected, actual)
    assert {r.fixture: r.passed for r in got.collect()} == {"f": True, "g": False, "z": True}
    counts = replay.optional_counts(actual, ["a"])
    assert not replay.gate(got, counts).first().passed
    assert replay.gate(got.filter("passed"), counts, spark.createDataFrame([("b", 1)], "field string, n int")).first().passed
    assert not replay.gate(got.filter("passed"), counts, spark.createDataFrame([("b", 2)], "field string, n int")).first().passed


@pytest.mark.parametrize("per_task", [replay.TASK_ROWS, 7])
def test_replay_deals_rows_by_their_number(spark, monkeypatch, per_task):
    monkeypatch.setattr(replay, "TASK_ROWS", per_task)
    draw = random.Random(5)
    key = lambda names: (draw.choice(names), draw.choice([0, 1, 2, 2**40, None]), draw.choice(["x", "y", None]))
    value = lambda: draw.choice(["1", "1", "1", None])
    want = [(*key(["a", "b", "c", None]), value(), draw.random() < 0.4) for _ in range(40)] + [("d", i, "x", "1", True) for i in range(30)] + [("e", 0, None, None, False)]
    got = [(*key(["a", "b", "z", None]), value(), draw.choice([True, True, False, None])) for _ in range(40)] + [("d", i, "x", "1", True) for i in range(30)]
    left = [(w, g) for w in want for g in [g for g in got if None not in w[:3] and g[:3] == w[:3]] or [None]]
    fixtures = {}
    for name in {w[0] for w in want}:
        pairs = [(w, g) for w, g in left if w[0] == name]
        wrong = sum(w[4] and w[3] != (g[3] if g else None) for w, g in pairs)
        rows = {w[1] for w, _ in pairs if w[2] is not None} - {None}
        valid = {g[1] for g in got if name is not None and g[0] == name and g[4]} - {None}
        fixtures[name] = (sum(w[2] is not None for w, _ in pairs), wrong, wrong == 0 and len(rows) == len(valid))
    columns = "fixture string, row_ix bigint, field string, value string"
    out = replay.replay(spark.createDataFrame(want, f"{columns}, required boolean"), spark.createDataFrame(got, f"{columns}, valid boolean"))
    assert {r.fixture: (r.compared, r.differing, r.passed) for r in out.collect()} == fixtures
    assert fixtures["d"] == (30, 0, True) and fixtures["e"] == (0, 0, True)
    # no size of files or shuffles decides how many rows a task gets
    dealt = re.findall(r"hashpartitioning\(fixture#\d+, row_ix#\d+L?(?:, field#\d+)?, (\d+)\), REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())
    assert per_task > 7 or len(dealt) >= 3 and min(map(int, dealt)) == 1 + (len(want) + len(got)) // 7


def test_verdicts(spark):
    t = spark.createDataFrame([(True, True, 0), (False, True, 0), (False, False, 3), (False, False, 0)], "u boolean, b boolean, autos int")
    no = F.lit(False)
    assert [r[0] for r in t.select(classify.precheck_verdict(F.col("u"), F.col("b"), no, no, F.col("autos"), 3)).collect()] == ["unreachable", "blocked", "quota_exhausted", "ok"]


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from provenant.plans import catalogue

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("customer", "supplier", "nation", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    shown = lambda rows: sorted(tuple("~" if v is None else f"{float(v):.6g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)
    for name, sql in catalogue.SQL.items():
        got = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        names = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall()
        assert shown(got.select(*names).collect()) == shown(want), name


def test_all_pages_are_extracted(spark, tmp_path):
    html = '<html lang="en"><body><article><h1> Heading </h1></article></body></html>'
    spark.createDataFrame([(i, f"http://a/{i}", html) for i in range(6)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted((r.page_id, r.text) for r in page_plans.extract_chain(spark, str(tmp_path)).collect()) == [(i, "Heading") for i in range(6)]


def test_links_are_walked_beyond_page_200(spark, tmp_path):
    ids = range(1, 5003)  # without a gap, which would end the walk
    html = "<html><body><nav><ul>{}</ul></nav></body></html>"
    rows = [(i, f"http://a/{i}", html.format("".join(f'<li><a href="/{i}/{k}">x</a></li>' for k in range(3)))) for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.n, r.url) for r in page_plans.paginate_links(spark, str(tmp_path)).collect()]
    assert got == [(i, f"http://a/{i}/{k}") for i in ids for k in range(3)]
    spark.createDataFrame([*rows[:3], *rows[4:6]], "page_id long, url string, html string").write.parquet(f"{tmp_path}/gap/pages.parquet")
    assert [r.n for r in page_plans.paginate_links(spark, f"{tmp_path}/gap").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_casts_reject_before_patterns(spark):
    fields = (Field("k", required=True, pattern="[a-z]+$"), Field("m", pattern="[0-9]+$"), Field("n", "integer"), Field("p", "integer", pattern="9"))
    rows = [("a", "1", "2", "3"), ("A", "x", "y", "9"), ("A", "x", "1", "9"), ("a", "x", "1", None), ("", "x", "y", "z")]
    got = validate.validate(spark.createDataFrame(rows, "k string, m string, n string, p string"), Contract(fields, ("k",))).select("accepted", "reasons").collect()
    assert [tuple(r) for r in got] == [(True, []), (False, ["type_error:n"]), (False, ["type_error:k"]), (False, ["type_error:m"]), (False, ["natural_key_missing"])]


def test_kinds_stand_where_they_are_first_seen(spark):
    runs = spark.createDataFrame([("r", "ok"), ("s", "blocked")], "run string, verdict string")
    signals = spark.createDataFrame([("r", "duplicate_rate"), ("r", "row_count_anomaly"), ("r", "fill_rate_below_declared"), ("s", "natural_key_missing"), ("s", "duplicate_rate")], "run string, trigger string")
    got = {r.run: (r.outcome, r.kinds) for r in classify.classify(runs, signals, "run").collect()}
    assert got == {"r": ("escalated", "fill_rate_drop,row_count_anomaly,duplicate_rate_anomaly"), "s": ("escalated", "blocked,natural_key_broken")}


def test_a_walk_ends_where_a_page_is_missing(spark):
    page = lambda n: f'<a href="/x{n}">x</a>'
    t = spark.createDataFrame([(n, "http://a/", 200, page(n)) for n in (1, 2, 4)], "n int, url string, http_status int, html string")
    urls = lambda **k: [r.url[-1] for r in discovery.paginate(t, "a", ".", **k).collect()]
    assert urls() == ["1", "2"] and urls(start=2) == ["2"] and urls(start=4) == ["4"] and urls(start=3) == [] and urls(pages_walked=1) == ["1"]
    assert urls(start=0) == []
    refused = t.withColumn("allowed", F.col("n") < 2)
    assert [r.url[-1] for r in discovery.paginate(refused, "a", ".").collect()] == ["1"]


def test_windows_are_days():
    assert [history.window_days(x) for x in ("7d", "30d", "x", "3w", "d", "1_0d")] == [7, 30, 7, 7, 7, 10]


@pytest.mark.parametrize("name", sorted(histories.QUERIES))
def test_histories_agree_with_their_sql(spark, name):
    import duckdb

    con, home = duckdb.connect(), "/root/testdata/sf0.001"
    for t in ("orders", "customer", "lineitem", "part", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{home}/{t}.parquet')")
    got = histories.QUERIES[name](spark, home)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({histories.SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
