"""A pack's run over generated pages, packs, and the stream of responses."""

import pytest
from pyspark.sql import functions as F

from provenant.plans import lifecycle
from provenant.sources import packs
from provenant.streaming import ingest

BIKE = {
    "domain": "hire.example",
    "entity": "bike",
    "discovery": {"strategy": "seed_list", "seeds": ["https://hire.example/bikes"], "url_pattern": "/bikes/"},
    "extract": {
        "sources": [
            {"kind": "css", "fields": {"model": {"selector": "#bike > h2", "transform": ["strip"]}, "deposit": {"selector": "dl dd.deposit", "transform": ["strip", "parse_currency"]}, "frame": {"selector": "tr:nth-child(2) td", "transform": ["strip"]}}},
            {"kind": "jsonld", "type": "Product", "fields": {"model": {"path": "$.name"}, "gears": {"path": "specs[0].gears"}}},
            {"kind": "embedded_json", "script_id": "state", "fields": {"gears": {"path": "gears"}}},
        ]
    },
    "schema": {
        "natural_key": ["frame"],
        "fields": {
            "frame": {"type": "string", "required": True, "pattern": "F[0-9]{4}$"}, "model": {"type": "string", "required": True}, "gears": {"type": "integer", "min_fill_rate": 0.1},
            "deposit": {"type": "decimal", "required": True, "sane_range": [5, 300]}, "coin": {"type": "string", "enum": ["CHF", "EUR"], "derived_from": {"source": "deposit", "transform": "currency_from_symbol"}},
        },
    },
    "quality": {"min_rows_per_run": 5},
    "compliance": {"tos_url": "https://hire.example/terms", "tos_verdict": "silent", "tos_reviewed_at": "2026-01-01", "reviewed_by": "us", "robots_checked_at": "2026-01-01", "public_content": True, "personal_data": False},
}
RECORDS = "entity string, natural_key string, payload_hash string, snapshot_id string, valid_from int, last_seen_at int"


def bike(i, deposit="CHF 40"):
    linked = '<script type="application/ld+json">[{"@graph": [{"@type": "Shop"}, {"@type": "Product", "name": "other name", "specs": [{"gears": %d}]}]}]</script>' % (i + 3)
    state = '<script id="state">{"gears": 99}</script>'
    words = "<p>" + "what the bike can do " * 20
    return f"<title>T</title><body><div id=bike><h2>Bike {i}</h2><dl><dt>Deposit<dd class='deposit big'>{deposit}</dl><table><tr><td>no<tr><td>F{i:04d}</table></div>{linked if i % 2 else ''}{state}{words}"


def responses(spark, n=8, deposit="CHF 40", odd=None):
    rows = [(f"https://hire.example/bikes/{i}", i, 200, bike(i, deposit), False) for i in range(n)]
    return spark.createDataFrame(rows + ([odd] if odd else []), "url string, seq int, http_status int, html string, unchanged boolean")


def test_a_run_and_the_next(spark):
    pack, none = packs.pack(BIKE), spark.createDataFrame([], RECORDS)
    first = lifecycle.run(pack, responses(spark), none, F.lit(1))
    assert (first.status, first.verdict) == ("ok", "ok")
    assert first.applied.current.count() == 8 and first.signals.count() == 0
    assert [tuple(r) for r in first.rows.orderBy("seq").select("model", "gears", "gears_source", "deposit", "coin").take(2)] == [("Bike 0", "99", "_source2", "40.000000000000000000", "CHF"), ("Bike 1", "4", "_source1", "40.000000000000000000", "CHF")]
    second = lifecycle.run(pack, responses(spark), first.applied.current, F.lit(2))
    assert {r.change: r.n for r in second.applied.counters.collect()} == {"unchanged": 8}
    third = lifecycle.run(pack, responses(spark, deposit="GBP 950"), second.applied.current, F.lit(3))
    assert third.status == "degraded" and third.applied.closed.count() == 8
    assert {r.trigger for r in third.signals.collect()} == {"range_violation", "enum_violation"}


def test_a_block_writes_no_record(spark):
    pack, none = packs.pack(BIKE), spark.createDataFrame([], RECORDS)
    blocked = lifecycle.run(pack, responses(spark, odd=("https://hire.example/x", 3, 200, "Just a moment...", False)), none, F.lit(1))
    assert (blocked.status, blocked.verdict, blocked.applied) == ("degraded", "blocked", None)
    failed = lifecycle.run(pack, responses(spark, odd=("https://hire.example/x", 9, 500, None, False)), none, F.lit(1))
    assert failed.status == "degraded" and failed.applied.current.count() == 8
    few = lifecycle.run(pack, responses(spark, n=3), none, F.lit(1))
    assert few.status == "failed"


def test_packs_are_checked(tmp_path):
    wrong = {**BIKE, "domain": "shop.amazon.example", "password": "x", "discovery": {"strategy": "pagination", "url_template": "x"}}
    assert packs.check(wrong) == ["credential:password", "denied:amazon", "discovery_needs:{n}"]
    with pytest.raises(packs.PackError):
        packs.pack({**BIKE, "schema": {"natural_key": ["no"], "fields": {}}})
    import yaml

    (tmp_path / "hire.example").mkdir()
    (tmp_path / "hire.example" / "bike.yaml").write_text(yaml.safe_dump(BIKE))
    assert [p.contract.natural_key for p in packs.load(tmp_path)] == [("frame",)]
    (tmp_path / "hire.example" / "other.yaml").write_text(yaml.safe_dump(BIKE))
    with pytest.raises(packs.PackError):
        packs.load(tmp_path)


def test_responses_as_a_stream(spark, tmp_path):
    rows = [("http://a/1", "2026-01-01 00:00:00", 200, "x"), ("http://a/2", "2026-01-01 00:00:00", 200, "x"), ("http://a/3", "2026-01-01 00:00:00", None, None)]
    t = spark.createDataFrame(rows, "url string, fetched_at string, http_status int, body string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    for k in range(2):
        t.write.mode("append").parquet(f"{tmp_path}/in")
        ingest.ingest(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/out/snapshots").count() == 2 * (k + 1)
        assert spark.read.schema("content_hash string, batch long").parquet(f"{tmp_path}/out/blobs").count() == 1
