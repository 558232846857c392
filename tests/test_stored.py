"""Integrity rules, intervals, provenance, ordered keys, indexes of folders, packs and fixtures as data sources."""

import gzip
import json
import random

import pytest
import yaml
from pyspark.sql import functions as F

from provenant.held import held
from provenant.operators import history, integrity, quality, replay, responses, scd2
from provenant.operators.contract import Contract, Field
from provenant.sources import folders

from test_lifecycle import BIKE

HASH = "a" * 64
GOOD = {
    "site_pack": ("domain string, entity string, version int, parent_version int, status string, spec string, created_by string, activated_at int", ("d", "e", 2, 1, "active", '{"domain":"d"}', "human:x", 1)),
    "run": ("run_id int, pack_id int, trigger string, status string, started_at int, finished_at int, pages_fetched int, rows_extracted int", (1, 1, "manual", "ok", 1, 2, 0, 0)),
    "snapshot": ("snapshot_id int, url string, fetched_at int, http_status int, content_hash string, byte_size int, blob_key string, fetcher string, is_golden boolean, golden_label string", (1, "u", 1, 200, HASH, 0, "k", "httpx", True, "l")),
    "blob": ("content_hash string, body string", ("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", "abc")),
    "record": ("entity string, natural_key string, snapshot_id int, pack_id int, valid_from int, valid_to int, payload_hash string", ("e", "k", 1, 1, 1, None, HASH)),
    "incident": ("pack_id int, kind string, field string, severity string, opened_at int, closed_at int, resolution string", (1, "k", None, "warn", 1, None, None)),
}
#: A column and a value that break the rule.
BAD = [
    ("site_pack", "version", 0, {"version_positive", "parent_before_self"}), ("site_pack", "parent_version", 2, {"parent_before_self"}), ("site_pack", "spec", '{"domain":"x"}', {"spec_domain_matches"}), ("site_pack", "created_by", "healer:", {"created_by_namespaced"}),
    ("site_pack", "activated_at", None, {"active_needs_activation"}), ("site_pack", "status", "odd", {"status_known"}), ("site_pack", "domain", None, {"domain_needed"}), ("run", "finished_at", 0, {"finished_after_started"}), ("run", "finished_at", None, {"terminal_needs_finished"}),
    ("run", "pages_fetched", -1, {"pages_nonneg"}), ("run", "rows_extracted", -1, {"rows_nonneg"}), ("run", "status", "x", {"status_known"}), ("run", "trigger", "x", {"trigger_known"}), ("run", "pack_id", None, {"pack_id_needed"}), ("snapshot", "http_status", 99, {"http_status_range"}),
    ("snapshot", "http_status", 600, {"http_status_range"}), ("snapshot", "byte_size", -1, {"byte_size_nonneg"}), ("snapshot", "content_hash", "x", {"content_hash_sha256"}), ("snapshot", "fetcher", "curl", {"fetcher_known"}), ("snapshot", "golden_label", None, {"golden_needs_label"}),
    ("blob", "body", "abd", {"content_hash_of_body"}), ("record", "valid_to", 1, {"valid_interval"}), ("record", "payload_hash", "A" * 64, {"payload_hash_sha256"}), ("record", "snapshot_id", None, {"snapshot_id_needed"}),
    ("incident", "resolution", "x", {"closure_needs_resolution"}), ("incident", "closed_at", 3, {"closure_needs_resolution"}), ("incident", "closed_at", 0, {"closure_needs_resolution", "closed_after_opened"}), ("incident", "severity", "bad", {"severity_known"}),
]


def test_each_rule_of_each_table_is_counted_on_the_write(spark):
    for name, (schema, row) in GOOD.items():
        columns = [x.split()[0] for x in schema.split(", ")]
        many = [row]
        want = {}
        keys = {k for u in integrity.TABLES[name].unique for k in u.keys}
        for i, (_, column, value, rules) in enumerate(x for x in BAD if x[0] == name):
            # other keys, so that no unique rule is broken by the way
            other = [f"{v}{i}" if c in keys and isinstance(v, str) and c not in ("domain", "content_hash") else v + i + 5 if c in keys and isinstance(v, int) and c not in ("version",) else v for c, v in zip(columns, row, strict=True)]
            other[columns.index(column)] = value
            many.append(tuple(other))
            for r in rules:
                want[r] = want.get(r, 0) + 1
        done = integrity.written(spark.createDataFrame(many, schema), name)
        unique = {u.name for u in integrity.TABLES[name].unique}
        assert {k: n for k, n in done.broken.items() if k not in unique} == want, name
        assert done.rows.count() == len(many)
        twice = integrity.written(spark.createDataFrame([row, row], schema), name).broken
        assert twice and set(twice) <= unique and set(twice.values()) == {1}
        assert integrity.checked(spark.createDataFrame([row], schema).withColumn("more", F.lit(1)), name).count() == 1
        assert integrity.written(spark.createDataFrame([], schema), name).broken == {}
        with pytest.raises(integrity.IntegrityError) as error:
            integrity.checked(spark.createDataFrame([row, row], schema), name)
        assert error.value.broken == twice


def test_null_fields_are_one_field_and_closed_rows_are_free(spark):
    schema, row = GOOD["incident"]
    closed = (*row[:5], 2, "fixed")
    assert integrity.written(spark.createDataFrame([row, closed, closed], schema), "incident").broken == {}
    assert integrity.written(spark.createDataFrame([row, row, closed], schema), "incident").broken == {"one_open_incident": 1}


def test_gaps_and_overlaps(spark):
    r = random.Random(4)
    rows = [("good", 1, 3), ("good", 3, 5), ("good", 5, None), ("gap", 1, 3), ("gap", 4, None), ("over", 1, 4), ("over", 3, None), ("open", 1, None), ("open", 5, None), ("same", 1, 3), ("same", 1, 3), (None, 1, 2), (None, 3, 4), ("inner", 1, 9), ("inner", 2, 3), ("inner", 9, None)]
    rows += [(f"r{i % 40}", b, None if r.random() < 0.1 else b + r.randint(1, 3)) for i in range(160) for b in [r.randint(0, 9)]]
    want = []
    for key in {x[0] for x in rows}:
        latest = None
        for _, b, e in sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2] is None, x[2] or 0)):
            if latest is not None and b != latest:
                want.append((key, b, "overlap" if b < latest else "gap"))
            e = float("inf") if e is None else e
            latest = e if latest is None else max(latest, e)
    t = spark.createDataFrame(rows, "k string, valid_from int, valid_to int").repartition(4)
    assert sorted(map(tuple, integrity.interval_breaks(t, ["k"]).collect()), key=str) == sorted(want, key=str)
    current = spark.createDataFrame([("e", "a", 5)], "entity string, natural_key string, valid_from int")
    closed = spark.createDataFrame([("e", "a", 1, 4)], "entity string, natural_key string, valid_from int, valid_to int")
    assert [tuple(x) for x in scd2.broken_rules(current, closed).collect()] == [("gap", 1)]


def test_provenance_counts_orphans_on_each_side(spark):
    records = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (None, 1), (7, None)], "snapshot_id int, pack_id int")
    found = integrity.provenance(records, spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "snapshot_id int"), spark.createDataFrame([(1,), (2,), (5,)], "pack_id int"))
    assert {r.reference: tuple(r)[1:] for r in found.collect()} == {"snapshot": (5, 1, 1, 1, 2), "pack": (5, 1, 1, 0, 1)}
    assert integrity.provenance(records.limit(0), spark.createDataFrame([], "snapshot_id int"), spark.createDataFrame([], "pack_id int")).count() == 0


def test_a_swapped_pair_of_rows_fails_the_gate(spark):
    schema = "fixture string, row_ix int, key string"
    expected = spark.createDataFrame([(f, i, k) for f in "abcde" for i, k in enumerate(["x", "y", None, "y"])], schema)
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, None), ("a", 3, "y"), ("b", 0, "x"), ("b", 1, None), ("b", 2, "y"), ("b", 3, "y"), ("c", 0, "x"), ("c", 1, "y"), ("c", 2, None)]
    rows += [("d", i, k) for i, k in enumerate(["x", "y", None, "y", "z"])] + [("other", 0, "x")]
    got = {r.fixture: tuple(r)[1:] for r in replay.key_order(expected, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": (4, 4, True, None), "b": (4, 4, False, 1), "c": (4, 3, False, 3), "d": (4, 5, False, 4), "e": (4, 0, False, 0)}
    results = spark.createDataFrame([("a", True), ("b", True)], "fixture string, passed boolean")
    counts = spark.createDataFrame([], "field string, n long")
    orders = replay.key_order(expected, spark.createDataFrame(rows, schema))
    assert replay.gate(results, counts).first().passed and not replay.gate(results, counts, orders=orders).first().passed
    assert replay.gate(results, counts, orders=orders.filter("fixture = 'a'")).first().passed


def test_only_valid_rows_count(spark):
    expected = spark.createDataFrame([("f", 0, "a", "1", True), ("f", 1, "a", "2", True)], "fixture string, row_ix int, field string, value string, required boolean")
    actual = spark.createDataFrame([("f", 0, "a", "1", True), ("f", 1, "a", "2", True), ("f", 2, "a", "3", False)], "fixture string, row_ix int, field string, value string, valid boolean")
    assert replay.replay(expected, actual).first().passed
    assert not replay.replay(expected, actual.withColumn("valid", F.col("row_ix") == 1)).first().passed


def test_fewer_than_three_runs_have_no_medians(spark):
    runs = [("d", f"e{k}", i, '{"quality":{"fill_rate":{"a":%s}}}' % (i / 10) if i < 2 or k != 3 else "{}") for k in range(5) for i in range(k)]
    t = spark.createDataFrame(runs, "domain string, entity string, rows_extracted int, metrics string")
    got = {r.entity: (r.runs, r.median_rows, r.insufficient_baseline) for r in history.row_medians(t).collect()}
    assert got == {"e1": (1, None, True), "e2": (2, None, True), "e3": (3, 1, False), "e4": (4, 2, False)}
    # a run without rates counts as a run
    assert {r.entity: r.median for r in history.rate_medians(t).collect()} == {"e3": 0.05, "e4": pytest.approx(0.15)}
    c = Contract((Field("x"),), ("x",))
    p = spark.createDataFrame([(d, 10 * d, 1.0) for d in range(1, 6)], "day int, rows_considered int, fill_rate_x double").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))
    got = [(r.baseline_runs, r.median_14d, r.deviation) for r in quality.with_baseline(p, c, "day").orderBy("day").collect()]
    assert got == [(0, None, None), (1, None, None), (2, None, None), (3, 20, 1.0), (4, 25 // 1, 1.0)] or got[3:] == [(3, 20, 1.0), (4, 25, 1.0)] and all(m is None for _, m, _ in got[:3])
    assert quality.field_medians(p, c, "day").count() == 14  # the days that three of these are history for


def test_intervals_between_requests_rise(spark):
    answers = spark.createDataFrame([("http://www.a/x", 429, "7"), ("http://a/y", 403, "500"), ("http://b/", 200, "9"), ("http://c/", 429, None), ("http://d/", None, None)], "url string, http_status int, retry_after string")
    policy = spark.createDataFrame([("http://b", 4.5), ("http://d", None)], "origin string, crawl_delay double")
    got = responses.host_intervals(answers, F.lit("2024-01-01").cast("timestamp"), 0.5, policy)
    assert {r.host: r.interval for r in got.collect()} == {"a": 300.0, "b": 4.5, "c": 2.0, "d": 2.0}


# ---------------------------------------------------------------- folders


@pytest.fixture
def corpus(tmp_path):
    for domain in ("one.example", "two.example"):
        for k in range(3):
            folder = tmp_path / domain / "golden" / f"f{k}"
            folder.mkdir(parents=True)
            (folder / "meta.json").write_text(json.dumps({"golden_label": f"l{k}"}) if k < 2 else '{"other": 1}')
            (folder / "expected.json").write_text('{"rows": %d}' % k)
            if k:
                (folder / "page.html.gz").write_bytes(gzip.compress("<p>é".encode()))
    (tmp_path / "one.example" / "meta.json").write_text("no json")
    return tmp_path


def test_fixtures_and_packs_are_formats(spark, corpus, tmp_path):
    spark.conf.set(folders.PUSHDOWN, "true")
    try:
        folders.register(spark)
        t = spark.read.format("fixtures").option("path", str(corpus)).load()
        assert sorted((r.domain, r.label, r.expected, r.html) for r in t.collect()) == [(d, f"l{k}", '{"rows": %d}' % k, "<p>é" if k else None) for d in ("one.example", "two.example") for k in range(2)]
        assert t.rdd.getNumPartitions() == 2
        one = t.filter("domain = 'two.example' and label = 'l1'")
        assert [r.folder.split("/")[-3:] for r in one.collect()] == [["two.example", "golden", "f1"]]
        assert one.rdd.getNumPartitions() == 1  # the other domain's folder is not opened
        assert t.filter("domain = 'no.example'").count() == 0
    finally:
        spark.conf.unset(folders.PUSHDOWN)
    folders.register(spark)
    root = tmp_path / "packs"
    (root / "hire.example").mkdir(parents=True)
    (root / "hire.example" / "bike.yaml").write_text(yaml.safe_dump({**BIKE, "version": 3}))
    p = spark.read.format("packs").option("path", f"file://{root}").load()
    assert [(r.domain, r.entity, r.version, json.loads(r.document)["schema"]["natural_key"]) for r in p.filter("domain = 'hire.example'").collect()] == [("hire.example", "bike", 3, ["frame"])]
    (root / "hire.example" / "car.yaml").write_text(yaml.safe_dump(BIKE))
    with pytest.raises(Exception, match="differ"):
        spark.read.format("packs").option("path", f"file://{root}").load().collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("packs").option("path", str(tmp_path / "none")).load().count() == 0


def test_an_index_is_built_verified_and_compared_only_where_folders_differ(spark, corpus):
    before = held(folders.index(folders.files(spark, str(corpus))), "index")
    by_path = {r.path: r for r in before.collect()}
    assert by_path[""].n == 10 and by_path["one.example/golden/f1"].n == 2 and by_path["one.example/golden/f1/expected.json"].is_file and "meta.json" not in str(by_path)
    assert folders.descend(before, folders.index(folders.files(spark, f"file://{corpus}")))[0].count() == 0
    (corpus / "two.example" / "golden" / "f1" / "expected.json").write_text('{"rows": 9}')
    (corpus / "two.example" / "golden" / "f0" / "expected.json").unlink()
    (corpus / "two.example" / "golden" / "f0" / "page.html.gz").write_bytes(b"x")
    changes, compared = folders.descend(before, folders.index(folders.files(spark, str(corpus))))
    assert sorted(map(tuple, changes.collect())) == [("two.example/golden/f0/expected.json", "removed"), ("two.example/golden/f0/page.html.gz", "added"), ("two.example/golden/f1/expected.json", "changed")]
    assert compared == 1 + 2 + 1 + 3 + 2 + 2  # nothing below one.example
    r = random.Random(1)
    paths = ["/".join(r.choice("abc") for _ in range(r.randint(1, 4))) + f"/{i}" for i in range(300)]
    old = {p: "x" for p in paths if r.random() < 0.95}
    new = {p: "y" if r.random() < 0.03 else "x" for p in paths if r.random() < 0.95}
    t = lambda d: folders.index(spark.createDataFrame(list(d.items()), "path string, digest string"))
    got = dict(map(tuple, folders.descend(t(old), t(new))[0].collect()))
    assert got == {p: "added" if p not in old else "removed" if p not in new else "changed" for p in paths if old.get(p) != new.get(p)}


def test_labels_count_only_from_the_floor_on(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "source string, label string")
    fixtures = t(*[("a", f"l{i}") for i in range(3)], ("a", None), ("b", "l0"), ("c", "x"), ("c", "x"), ("c", "y"))
    required = t(("a", "l0"), ("a", "l1"), ("a", "l1"), ("b", "l9"), ("c", "x"), ("c", "z"), ("c", "z"), ("c", "w"), ("d", "q"))
    got = {r.source: tuple(r)[1:] for r in replay.edge_coverage(fixtures, required, t(("c", "w"), ("b", "l9")), floor=3).collect()}
    assert got == {"a": (3, 0, "covered"), "b": (1, 0, "insufficient_fixtures"), "c": (3, 1, "missing_labels"), "d": (0, 1, "insufficient_fixtures")}
