"""Column functions, by cases."""

import tracemalloc
import unicodedata
from decimal import Decimal

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.functions import scalars


def column(spark, values, make, kind="string"):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in t.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_money(spark):
    texts = ["£51.77", "CHF 1'299.00", "1.299,00 €", "49,90 CHF", "$0.99", "GBP 51.77", "51.77", "", None, "$0.999", "1,234,567 €", "£"]
    got = column(spark, texts, scalars.parse_currency)
    want = [("51.77", "GBP"), ("1299", "CHF"), ("1299", "EUR"), ("49.9", "CHF"), ("0.99", "USD"), ("51.77", "GBP"), None, None, None, ("999", "USD"), None, None]
    assert [None if g is None else (g.amount.normalize(), g.currency) for g in got] == [None if w is None else (Decimal(w[0]).normalize(), w[1]) for w in want]


def test_texts_and_numbers(spark):
    assert column(spark, ["In stock (22 available)", "-5 x", "none", None], scalars.int_from_text) == [22, -5, None, None]
    assert column(spark, [" a&amp;amp; \u00a0b\n½ ", "\u2009", None], scalars.strip_text) == ["a&amp; b 1⁄2", None, None]
    # a unit separator is white space here, so it keeps nothing apart
    assert len(set(column(spark, ["a b\x1fc", "a\x1fb c", "a b c"], scalars.natural_key_16))) == 1
    quote = "autor-01-alpha\x1fZitat 01-A ueber das Leben und die Wahrheit."
    assert column(spark, [quote], scalars.natural_key_16) == ["807ae6c9c533e229"]


def test_nfc_sends_only_what_may_change_to_python(spark):
    assert all(unicodedata.normalize("NFC", a := chr(c)) == a and not unicodedata.combining(a) for c in range(0x300))
    second = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    assert all(len(d) != 2 or d[0].startswith("<") or int(d[1], 16) >= 0x300 for d in second)
    texts = ["plain \u02ff", "cafe\u0301", "\u212b", "\u1100\u1161\u11a8", "q\u0307\u0323", "\U0001d15e", "\u201cq\u201d", "", None, "a\x00b"]
    want = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert column(spark, texts, scalars.nfc) == want
    sent = spark.createDataFrame([(t,) for t in texts], "x string").select(scalars.nfc(F.col("x")))
    assert "CASE WHEN RLIKE(x" in sent._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("change", [str.upper, str.lower])
def test_texts_of_a_batch_are_held_in_pieces(change):
    texts, held, most = pa.array([*(f"t{i}" * 2_000 for i in range(1_000)), None, ""]), 0, 0

    def counted(t):
        nonlocal held, most
        held += 1
        most = max(most, tracemalloc.get_traced_memory()[0])
        return change(t)

    tracemalloc.start()
    got = scalars._each(counted)(texts)
    tracemalloc.stop()
    assert got.to_pylist() == [None if t is None else change(t) for t in texts.to_pylist()]
    assert held == 1_001 and most < 3_000_000  # the batch has 8 MB
    assert (got is texts) == (change is str.lower)  # nothing is copied where nothing changes


def test_natural_keys(spark):
    t = spark.createDataFrame([("a|b\\", "c"), (" ", "c"), (None, "c"), ("a", " c ")], "x string, y string")
    assert [r[0] for r in t.select(scalars.encode_natural_key(F.col("x"), F.col("y"))).collect()] == ["a\\|b\\\\|c", None, None, "a|c"]
    assert [r[0] for r in t.select(scalars.encode_natural_key(F.col("x"))).collect()] == ["a|b\\", None, None, "a"]


def test_canonical_payload(spark):
    t = spark.sql("SELECT 'A Light in the Attic' AS title, CAST('51.770' AS DECIMAL(10,3)) AS price, 'GBP' AS currency, 22 AS availability, 'a897fe39b1053632' AS upc")
    kinds = {"title": "string", "price": "decimal", "currency": "string", "availability": "integer", "upc": "string"}
    text = scalars.canonical_json({k: F.col(k) for k in kinds}, kinds)
    got = t.select(text.alias("c"), scalars.payload_hash(text).alias("h")).first()
    assert got.c == '{"availability":22,"currency":"GBP","price":51.77,"title":"A Light in the Attic","upc":"a897fe39b1053632"}'
    assert got.h == "c5eeefaa2a1f3f8063301d647db8328691a79ea4e700391b769b659085e01bb3"
    assert column(spark, ['a"\\\n\x01\t'], scalars.json_string) == ['"a\\"\\\\\\n\\u0001\\t"']


def test_urls_and_blobs(spark):
    urls = ["https://User@WWW.Ex.com:80/a", "nothing", None]
    assert column(spark, urls, scalars.domain_of) == ["www.ex.com", None, None]
    assert column(spark, urls, scalars.registrable_domain) == ["ex.com", "nothing", None]
    assert column(spark, ["raw/a/b.gz", "/a", "a/../b", "c:\\x", "", "a\\b"], scalars.safe_key) == [True, False, False, False, False, False]


def test_chains_of_transforms():
    assert scalars.check_chain(["strip", "parse_currency", "currency_from_symbol"]) == []
    assert scalars.check_chain(["parse_currency", "strip"]) == ["transform_type_mismatch:strip"]
    assert scalars.check_chain(["strip", "no", "parse_currency"]) == ["unknown_transform:no"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=8)), min_size=1, max_size=8))
def test_encoded_keys_are_told_apart(spark, pairs):
    import unicodedata

    clean = [tuple(unicodedata.normalize("NFC", p).strip() for p in pair) for pair in pairs]
    t = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    got = [r.k for r in t.select("i", scalars.encode_natural_key(F.col("x"), F.col("y")).alias("k")).orderBy("i").collect()]
    for a, c in zip(got, clean, strict=True):
        for b, d in zip(got, clean, strict=True):
            if a is not None and b is not None:
                assert (a == b) == (c == d)
