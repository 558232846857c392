"""One pass over a page against a tree, paths into JSON, JSON-LD, registered sources and transforms."""

import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenant.functions import json_paths, markup, scalars
from provenant.operators import discovery, extract, registry


class Tree(HTMLParser):
    """Elements of a page without implied ends: (name, attributes, parent, place, texts)."""

    def __init__(self, page):
        super().__init__()
        self.all, self.open = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        parent = self.open[-1] if self.open else None
        place = 1 + sum(e["parent"] is parent for e in self.all)
        e = {"name": tag, "attrs": dict(attrs), "parent": parent, "place": place, "texts": []}
        self.all.append(e)
        if tag not in markup.VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        while self.open.pop()["name"] != tag:
            pass

    def handle_data(self, data):
        for e in self.open:
            e["texts"].append(data.strip())


def fits(e, steps):
    c = markup.compound(steps[-1])
    if c.name not in (None, e["name"]) or not c.fits(e["place"], e["attrs"]):
        return False
    if len(steps) == 1:
        return True
    if steps[-2] == ">":
        return e["parent"] is not None and fits(e["parent"], steps[:-2])
    up = e["parent"]
    while up is not None:
        if fits(up, steps[:-1]):
            return True
        up = up["parent"]
    return False


def below(e, base):
    while e is not None:
        e = e["parent"]
        if e is base:
            return True
    return False


def matches(tree, selector, base=None):
    return [e for e in tree.all if (base is None or below(e, base)) and any(fits(e, w.split()) for w in selector.split(","))]


def page(r, depth=0):
    name = r.choice(["div", "span", "b", "em", "img", "section", "div"])
    attrs = "".join(f' {k}="{v}"' for k, v in {"class": r.choice(["", "x", "x y", "y"]), "id": r.choice(["", "i", "j"]), "data-k": r.choice(["", "1"])}.items() if v)
    if name == "img":
        return f"<img{attrs}>"
    inner = "".join(page(r, depth + 1) if r.random() < 0.7 else r.choice([" t1 ", "t2", "&amp; ", ""]) for _ in range(r.randint(0, 5 if depth < 4 else 0)))
    return f"<{name}{attrs}>{inner}</{name}>"


SELECTORS = ["div", "div div", "div > span", ".x", ".x.y", "#i", "div#i .y", "[data-k]", "div[data-k=1] > *", "b:nth-child(2)", "section em, #j", "* > .x b", "div > div > b", "img"]


@pytest.mark.parametrize("seed", range(40))
def test_all_selectors_in_one_pass_are_those_of_a_tree(seed):
    r = random.Random(seed)
    text = "".join(page(r) for _ in range(4))
    tree = Tree(text)
    rows = [(row, {s: s for s in r.sample(SELECTORS, 4)} | {"id": f"{r.choice(SELECTORS)}@id"}) for row in [None, *r.sample(SELECTORS, 5)]]
    asks = [markup.Rows(fields, row) for row, fields in rows] + [markup.Values(s, "class") for s in SELECTORS] + [markup.Facts(tuple(SELECTORS))]
    got = markup.Scan(asks)(text)
    for (row, fields), found in zip(rows, got, strict=False):
        want = []
        for base in matches(tree, row) if row else [None]:
            one = {}
            for name, what in fields.items():
                hits = matches(tree, what.partition("@")[0], base)
                one[name] = None if not hits else hits[0]["attrs"].get("id") if name == "id" else "".join(hits[0]["texts"]) or None
            want.append(one)
        assert found == want, (row, fields, text)
    for s, found in zip(SELECTORS, got[len(rows) :], strict=False):
        assert found == [e["attrs"]["class"] for e in matches(tree, s) if e["attrs"].get("class")]
    assert got[-1]["matches"] == [s for s in SELECTORS if matches(tree, s)]


def one(text, selector, row=None):
    return [r["x"] for r in markup.Scan([markup.Rows({"x": selector}, row)])(text)[0]]


def test_implied_ends_raw_text_and_odd_pages():
    text = '<div class="a b"><h1>x<p>one<p id=i>two</div><table><tr><td>1<td>2<tr><td>3</table><script>var t="</p>";</script>'
    assert one(text, "p#i") == ["two"] and one(text, "td:nth-child(2)") == ["2"] and one(text, "tr:nth-child(2) td") == ["3"] and one(text, "script") == ['var t="</p>";']
    assert one("<title>a &amp; <b>c</title>", "title") == ["a & <b>c"] and one("<p>1 < 2 <!-- x --> y</p></b></p>", "p") == ["1 < 2y"]
    assert one("<LI Class='A'>q<li>r</LI>", "li", None) == ["q"] and one("<ul><li>q<li>r</ul>", "b", "li") == [None, None]
    assert one("<a href='x>y' title=b>t</a>", "a@href") == ["x>y"] and one("", "a") == [None] == one(None, "a") and one("<a", "a") == [None]
    assert one("<p>" * 3000 + "deep", "p > p") == [None] and one("<div>" * 3000 + "deep", "div > div") == ["deep"]
    facts = markup.Scan([markup.Facts()])("<title> T </title><style>s</style> é<noscript>n</noscript><meta http-equiv=refresh content='0;/Cookie'>")[0]
    assert facts == {"title": "T", "visible": 2 + 2, "consent": True, "matches": []} or facts["visible"] in (2, 4)
    for wrong in ("a:hover", "p[", "a >> b!"):
        with pytest.raises(ValueError):
            markup.Automaton([wrong])


def test_json_is_cut_out_of_scripts():
    text = '<!-- var data = [1] --><p title="var data = [2]">let data = [3]</p><script>y</script><script>x; const data = [{"a": "] }\\"", "b": [1, 2]}]; more</script><script>var data = [4]</script>'
    scripts = markup.Scan([markup.Texts("script")])(text)[0]
    assert json.loads(markup.assigned(scripts, "data")) == [{"a": '] }"', "b": [1, 2]}]
    assert markup.assigned(scripts, "other") is None and markup.assigned(["var x = [1"], "x") is None


def at_path(value, path):
    """What paths mean, by hand."""
    import re

    found = [value]
    for name, number in re.findall(r"\.?([\w-]+)|\[(\d+|\*)\]", path.removeprefix("$")):
        if name:
            found = [x[name] for x in found if isinstance(x, dict) and name in x]
        elif number == "*":
            found = [y for x in found if isinstance(x, list) for y in x]
        else:
            found = [x[int(number)] for x in found if isinstance(x, list) and int(number) < len(x)]
    return found


def test_paths_over_variants(spark):
    documents = [{"a": {"b": [1, 2]}, "k-1": [{"c": [[1], [2, 3]]}, {"c": [], "d": None}]}, [{"a": 1}, {"a": None}, 7, "s"], [[1, [2]]], "text", 5, None, {"a": [[{"b": 1}], [{"b": "x"}, {}]]}]
    paths = ["$", "a.b[*]", "$.a.b[1]", "a.c", "[*]", "[*].a", "k-1[*].c[*]", "k-1[0].c[*][*]", "k-1[*].d", "a[*][*].b", "[0][1][0]", "a[*]"]
    t = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "i int, j string").withColumn("v", F.parse_json("j"))
    got = {r.i: r for r in t.select("i", *[F.transform(json_paths.matches(F.col("v"), p), lambda x: F.to_json(x)).alias(f"p{k}") for k, p in enumerate(paths)]).collect()}
    for i, d in enumerate(documents):
        for k, p in enumerate(paths):
            assert [json.loads(x) for x in got[i][f"p{k}"]] == at_path(d, p), (d, p)
    with pytest.raises(ValueError):
        json_paths.matches(F.lit(1), "a..b!")
    fields = t.filter("i = 0").select(json_paths.field(F.col("v"), "$.a.b[*]").alias("x"), json_paths.field(F.col("v"), "a.b[1]").alias("y"), json_paths.field(F.col("v"), "a.c").alias("z"), json_paths.field(F.col("v"), "a").alias("w")).first()
    assert tuple(fields) == ("[1,2]", "2", None, '{"b":[1,2]}')


def test_linked_data_in_the_order_of_a_page(spark):
    blocks = [
        ['{"@type":"P","n":1}'], ["{bad", '[[{"@type":"Q"},{"@graph":[{"@graph":[{"@type":"P","n":2}]}, {"@type":"P","n":3}]}],{"@type":"P","n":4}]'], ['{"@type":"P","n":5,"@graph":[{"@type":"P","n":6}]}'],
        ['{"@type":["P"],"@graph":[{"@type":"p"}]}'], [], ["", "5", "null"], ['{"@type":"Q","@graph":{"@type":"P"}}', '{"@type":"P","n":7}'], None,
    ]
    t = spark.createDataFrame(list(enumerate(blocks)), "i int, s array<string>")
    got = {r.i: r.x for r in t.select("i", extract.linked_rows(F.col("s"), "P", {"n": "n", "m": "no"}).alias("x")).collect()}
    assert {i: x and x[0]["n"] for i, x in got.items()} == {0: "1", 1: "2", 2: "5", 3: [], 4: [], 5: [], 6: "7", 7: []}
    plan = t.select(extract.linked_rows(F.col("s"), "P", {"n": "n"}).alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_embedded_json(spark):
    pages = [(1, '<script id="s">{"list":[{"a":1,"b":[1,2]},5,{"a":null}]}</script>'), (2, "<p>none</p>"), (3, None)]
    t = spark.createDataFrame(pages, "i int, html string")
    got = extract.embedded_json(t, {"a": "a", "b": "b[*]"}, root="list[*]", script_id="s").select("i", F.posexplode_outer("rows")).collect()
    assert sorted(tuple(r) for r in got if r.i == 1) == [(1, 0, {"a": "1", "b": "[1,2]"}), (1, 1, {"a": None, "b": None})] and sum(r.i > 1 for r in got) == 2
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        extract.embedded_json(spark.createDataFrame([("<script id=s>{</script>",)], "html string"), {"a": "a"}, script_id="s").collect()
    with pytest.raises(PySparkException):
        extract.embedded_json(t, {"a": "a"}, variable="gone").collect()
    with pytest.raises(ValueError):
        extract.embedded_json(t, {"a": "a"})


# ---------------------------------------------------------------- walks


def test_a_walk_parses_at_most_twice_the_pages_it_walks(spark):
    link = lambda n: f'<a href="/x{n}">x</a><a href="/everywhere">y</a>'
    t = spark.createDataFrame([(n, "http://a/", 200, link(min(n, 100))) for n in range(1, 2001)], "n int, url string, http_status int, html string").repartition(7)
    w = discovery.walk(t, "a", ".", pages_walked=None)
    assert w.stop == 101 and w.urls.count() == 101 and w.pages_parsed <= 2 * 100 + discovery.FIRST_BATCH
    assert [r.pos for r in w.urls.filter("url like '%everywhere'").collect()] == [1]
    capped = discovery.walk(t, "a", ".", most=5)
    assert [r.url[-2:] for r in capped.urls.collect()] == ["x1", "re", "x2", "x3", "x4"] and capped.pages_parsed == discovery.FIRST_BATCH
    assert discovery.walk(t, "a", ".", pages_walked=3).pages_parsed == 3
    none = discovery.walk(t.limit(0), "a", ".")
    assert (none.urls.count(), none.pages_parsed) == (0, 0)


def test_walks_against_a_loop(spark):
    r = random.Random(8)
    for _ in range(4):
        pages = [(n, "http://a/b/", r.choice([200] * 30 + [404, None, 301]), "".join(f'<a href="{r.choice(["", "/", "../"])}{r.randint(0, n + 3)}">x</a>' for _ in range(r.randint(1, 3)))) for n in range(r.randint(0, 3), 60) if r.random() < 0.98]
        seen, want = set(), []
        for k, (n, _, status, html) in enumerate(pages):
            if k and n != pages[k - 1][0] + 1 or status is None or not 200 <= status < 300:
                break
            new = [u for u in dict.fromkeys(f"http://a/{'b/' if h[:1] not in '/.' else ''}{h.strip('./')}" for h in one_hrefs(html)) if u not in seen]
            if not new:
                break
            seen.update(new)
            want += [(n, u) for u in new]
        t = spark.createDataFrame(pages, "n int, url string, http_status int, html string")
        assert [(x.n, x.url) for x in discovery.paginate(t, "a", ".").collect()] == want


def one_hrefs(html):
    return markup.Scan([markup.Values("a", "href")])(html)[0]


# ---------------------------------------------------------------- extension points


def test_registered_transforms_and_sources(spark, monkeypatch):
    monkeypatch.setattr(scalars, "TRANSFORMS", dict(scalars.TRANSFORMS))
    monkeypatch.setattr(scalars, "TRANSFORM_TYPES", dict(scalars.TRANSFORM_TYPES))
    monkeypatch.setattr(registry, "TRANSFORMS", scalars.TRANSFORMS)
    monkeypatch.setattr(registry, "TRANSFORM_TYPES", scalars.TRANSFORM_TYPES)
    monkeypatch.setattr(registry, "_SOURCES", {})

    @registry.transform("shout")
    def shout(x):
        return F.concat(F.upper(x), F.lit("!"))

    assert scalars.check_chain(["strip", "shout", "parse_currency"]) == [] and scalars.check_chain(["parse_currency", "shout"]) == ["transform_type_mismatch:shout"]

    class Lines:
        """A row for each line of a page, with the fields that the declaration names."""

        @staticmethod
        def analyze(page, declaration):
            import json

            from pyspark.sql.types import StringType, StructType
            from pyspark.sql.udtf import AnalyzeResult

            schema = StructType()
            for name in json.loads(declaration.value)["columns"]:
                schema = schema.add(name, StringType())
            return AnalyzeResult(schema)

        def eval(self, page, declaration):
            import json

            n = len(json.loads(declaration)["columns"])
            for line in (page or "").splitlines():
                yield tuple((line.split(";") + [None] * n)[:n])

    registry.source("lines")(Lines)
    declared = {"kind": "lines", "columns": ["who", "what"], "fields": {"who": {"path": "who", "transform": ["strip", "shout"]}}}
    pages = spark.createDataFrame([(1, "a;b\nc"), (2, ""), (3, None)], "i int, html string")
    assert registry.fields(declared) == ["who", "what"]
    assert sorted(tuple(r) for r in registry.joined(pages, declared).select("i", "who", "what").collect()) == [(1, "a", "b"), (1, "c", None)]
    assert registry.joined(pages, {**declared, "columns": ["all"]}).columns == ["i", "html", "all"]

    from provenant.plans import lifecycle
    from provenant.sources import packs
    from test_lifecycle import BIKE

    document = {**BIKE, "extract": {"sources": [declared]}, "schema": {"natural_key": ["who"], "fields": {"who": {"type": "string", "required": True}}}}
    pack = packs.pack(document)
    scanned = extract.scanned(spark.createDataFrame([("u", 1, "x;y\nz")], "url string, seq int, html string"), lifecycle.asks(pack))
    assert [r.who for r in lifecycle.extracted(scanned, pack, every=True).orderBy("row_ix").collect()] == ["X!", "Z!"]

    with pytest.raises(NotImplementedError):
        registry.ask({"kind": "llm"}, "x")
    with pytest.raises(LookupError):
        registry.ask({"kind": "none"}, "x")
    for wrong in (type("No", (), {}), type("Method", (), {"analyze": lambda self: 1, "eval": lambda self: 1})):
        with pytest.raises(ValueError):
            registry.source("wrong")(wrong)
    with pytest.raises(ValueError):
        registry.source("css")
