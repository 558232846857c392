"""Robots: patterns, escapes, sections and states, against a plain matcher."""

import random
import re
from urllib.parse import unquote_to_bytes

from pyspark.sql import functions as F

from provenant.operators import robots

FILE = "origin string, http_status int, body string"


def decided(spark, body, paths, agent="bot", status=200):
    policy = robots.policies(spark.createDataFrame([("http://a", status, body)], FILE), agent)
    urls = spark.createDataFrame([(f"http://a{p}",) for p in paths], "url string")
    return {r.url.removeprefix("http://a"): r for r in robots.decisions(urls, policy).collect()}


def test_states_and_unknown_origins(spark):
    files = [("http://a", 200, "User-agent: *\nDisallow: /x\nAllow: /x/y\n"), ("http://b", 404, None), ("http://c", 403, None), ("http://d", 503, "x"), ("http://e", None, None), ("http://f", 302, ""), ("http://g", 200, None), ("HTTP://A", 200, "")]
    urls = ["http://a/x/1", "http://a/x/y/1", "HTTP://A/z", "http://b/x", "http://c/", "http://d/", "http://e/", "http://f/", "http://g/", "http://z/", "no url", None, "http://a"]
    policy = robots.policies(spark.createDataFrame([*files, files[0]], FILE), "bot")
    got = {r.url: r.decision for r in robots.decisions(spark.createDataFrame([(u,) for u in [*urls, urls[0]]], "url string"), policy).collect()}
    # the empty file is the lesser of two of one origin
    assert got == dict(zip(urls, ["allowed", "allowed", "allowed", "allowed", "disallowed", "unavailable", "unavailable", "disallowed", "allowed", "unknown", "unknown", "unknown", "allowed"], strict=True))
    assert robots.decisions(spark.createDataFrame([], "url string"), policy).count() == 0
    assert robots.policies(spark.createDataFrame([], FILE), "bot").count() == 0


def test_patterns_escapes_ties_and_sections(spark):
    body = "\ufeffUser-agent: nobot\r\nDisallow: /\r\n\r\nUser-agent: Bot/2.0\nUser-agent: x\nDisallow: /*.pdf$ # files\nDisallow: /x*y\nDisallow: /caf%C3%A9\nDisallow: /t\nAllow: /t\nAllow: /x*yes\nDisallow: no-slash\nDisallow: /a%2fb\nDisallow: /star%2A\nWibble\nCrawl-delay: 3\n\nUser-agent: *\nDisallow: /plain\n"
    paths = {"/a.pdf": 0, "/a.pdf?x": 1, "/x12y3": 0, "/xyes": 1, "/x": 1, "/caf\u00e9": 0, "/caf%c3%a9/1": 0, "/cafe": 1, "/t1": 1, "/no-slash": 0, "/a%2Fb": 0, "/a/b": 1, "/star*": 0, "/star": 1, "/plain": 1, "/%70lain": 1, "/%74": 1, "#f": 1, "?q.pdf": 0}
    got = decided(spark, body, paths, "Bot/1.1 (+mail)")
    assert {p: int(r.allowed) for p, r in got.items()} == paths
    assert got["/a.pdf"].line == "Disallow: /*.pdf$ # files" and got["/t1"].line == "Allow: /t" and got["/cafe"].line is None
    assert {r.crawl_delay for r in got.values()} == {3.0}
    assert not decided(spark, body, ["/plain"], "elsewhere")["/plain"].allowed
    assert not decided(spark, "User-agent: a\nUser-agent: *\nDisallow: /%zz%\n", ["/%zz%25"])["/%zz%25"].allowed


def test_patterns_against_a_regular_expression(spark):
    r = random.Random(2)
    text = lambda n, letters: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    rules = [(r.random() < 0.5, "/" + text(5, "ab*$") + r.choice(["", "$", "*"])) for _ in range(60)]
    paths = ["/" + text(6, "ab$*") for _ in range(200)]
    got = decided(spark, "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {p}" for a, p in rules), set(paths))

    def matches(pattern, path):
        ends, body = pattern.endswith("$"), pattern.removesuffix("$")
        return re.match(".*".join(re.escape(x) for x in body.split("*")) + ("$" if ends else ""), path)

    for path, row in got.items():
        # in the form of comparison a $ inside a pattern has three characters
        hits = [(len(p[:-1].replace("$", "%24")) + 1, a) for a, p in rules if matches(p, path)]
        assert row.allowed == (max(hits)[1] if hits else True), (path, row)


def test_paths_in_the_form_of_comparison(spark):
    texts = ["/a b", "/%41%7E", "/%2f%25%2a%24", "/*$", "/%", "/%4", "/\u4e2d\U0001f389", "/\"<>", "/plain?x=1&y", "/%c3%a9"]
    t = spark.createDataFrame([(x,) for x in texts], "x string").select("x", robots.normalised(F.col("x")).alias("y"), robots.normalised(F.col("x"), True).alias("z"))
    got = {r.x: r for r in t.collect()}
    assert got["/a b"].y == "/a%20b" and got["/%41%7E"].y == "/A~" and got["/%2f%25%2a%24"].y == "/%2F%25%2A%24"
    assert got["/*$"].y == "/%2A%24" and got["/*$"].z == "/*$" and got["/%"].y == "/%25" and got["/%4"].y == "/%254"
    assert all(r.y.isascii() and unquote_to_bytes(r.y) == unquote_to_bytes(x) for x, r in got.items())


def test_admissions(spark):
    policy = robots.policies(spark.createDataFrame([("http://a", 200, "User-agent: *\nDisallow: /no"), ("http://b", 404, "")], FILE), "bot")
    entries = [("one", 1, "http://a/"), ("one", 2, "http://a/no/2"), ("one", 3, "http://a/no/1"), ("two", 1, "http://b/x"), ("three", 1, "http://z/"), ("four", 1, None), ("five", 2, "http://a/2"), ("five", 1, "http://a/1"), ("five", 1, "http://a/1")]
    got = robots.admissions(spark.createDataFrame(entries, "label string, seq int, url string"), policy).collect()
    assert sorted(tuple(r) for r in got) == [
        ("five", "http://a/1", True, "allowed"), ("four", None, False, "unknown"), ("one", "http://a/no/2", False, "disallowed: Disallow: /no"), ("three", "http://z/", False, "unknown"), ("two", "http://b/x", True, "allowed (no robots file)"),
    ]
