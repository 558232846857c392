"""The filter audit, main texts of pages and the divergence of sources, against brute force, on nasty rows and empty tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from provenant.llm import divergence, filter_audit, main_text

DOCS = "doc_id long, text string, lang string, source string, mask int, digest string, part string, n int, term string, p long, rank int"


def rows():
    r = random.Random(3)
    some = ["The", "the", "é", "Straße", "x", "don't", "foo-bar", "naïve", "Ä", "ABC", "z" * 30, "中文", "1st", "a_b"]
    texts = [None, "", "", "A B C $", "word " * 250, "word " * 250, " ".join(f"w{i}" for i in range(250)), "UPPER " * 60, "a|b", "\x00\x85 nul", None, "tie"]
    texts += [" ".join(r.choices(some, k=r.randint(1, 60))) for _ in range(80)]
    texts += [" ".join(r.choices(["common", "häufig", f"rare{i}"], k=400)) for i in range(12)]
    out = [(i, t, [None, "", "en", "de"][i % 4], [None, "a", "b", "ß", ""][i % 5], 1, "x", "y", 2, "z", 3, 4) for i, t in enumerate(texts)]
    return [*out, out[6], out[6], (None, "tie", "en", "a", *[None] * 7), (3, "A B C $", "de", "b", *[None] * 7)]


LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (5, 1, 1), (None, 1, 1), (11, None, 1), (7, 1, 0), (999, 1, 1)]


def expected_audit(docs, labels):
    first = {}
    for d in docs:
        if d[0] is not None:
            first[d[1] or ""] = min(first.get(d[1] or "", d[0]), d[0])
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    parts = defaultdict(list)
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and t in first and doc_id > first[t]}
        parts[lang or ""].append(({k for k, v in fails.items() if v}, doc_id in good, doc_id in toxic))
    out = []
    for part, those in parts.items():
        steps = {}
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = [x for x in those if x[0] & set(order[:k])]
                removed = [x for x in those if f in x[0] and not x[0] & set(order[:k])]
                kept = len(those) - len(gone) - len(removed)
                steps[order, k] = (kept, len(removed), sum(f in x[0] for x in gone), sum(x[0] == {f} for x in those), sum(x[1] for x in removed), sum(x[2] for x in removed))
        for (order, k), v in steps.items():
            out.append((part, "".join(order), k + 1, *v, sum(x[1] for (o, j), x in steps.items() if o[j] == order[k])))
    return sorted(out)


def test_filter_audit(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    labels = spark.createDataFrame([(*x, "e") for x in LABELS], "doc_id long, quality int, toxic int, text string")
    found = filter_audit.audit(docs, labels)
    assert sorted(map(tuple, found.collect())) == expected_audit(rows(), LABELS)
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).agg({"good_lost": "max"}).first()[0] == 0


@pytest.mark.parametrize("seed", range(5))
def test_polynomial_values_and_shapley_are_those_of_all_orders(seed):
    r = random.Random(seed)
    counts = {m: r.randint(0, 9) for m in range(32) if r.random() < 0.7}
    f = filter_audit.Removal(counts)
    for corner in range(32):
        assert f.at(corner) == sum(n for m, n in counts.items() if m & corner)
    for i in range(5):
        total = 0
        for order in itertools.permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += sum(n for m, n in counts.items() if m >> i & 1 and not m & before)
        assert f.shapley(i) * 120 == total


# ---------------------------------------------------------------- sources


def expected_divergence(docs):
    terms_of = lambda t: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df, n, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in docs:
        lang, source, ts = lang or "", source or "", terms_of(text)
        groups.add((lang, source))
        df[lang].update(set(ts))
        n[lang, source].update(ts)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, c in df[lang].items() if c >= divergence.LEAST]
        v, mine = len(kept), sorted(s for x, s in groups if x == lang)
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        each = {s: p(n[lang, s]) for s in mine}
        q = p(sum((n[lang, s] for s in mine), Counter()))
        for s in mine:
            pairs = [(o, sum(f(each[s][t], each[o][t]) for t in kept)) for o in mine if o != s]
            terms = [(t, f(each[s][t], q[t])) for t in kept if n[lang, s][t] and each[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 10)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence(spark):
    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == expected_divergence(rows())
    assert divergence.divergence(docs.limit(0)).count() == 0
    few = docs.filter("doc_id < 9")  # no term is kept
    assert sorted(map(tuple, divergence.divergence(few).collect())) == expected_divergence([x for x in rows() if x[0] is not None and x[0] < 9])


def test_a_full_sketch_and_small_tables_change_nothing(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows(), DOCS).repartition(3)
    terms = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bits = divergence.sketch(terms)
    # no term that is frequent enough is ever discarded
    import numpy as np

    bits = np.unpackbits(np.frombuffer(bits, np.uint8))
    for lang, term in {(lang, t) for lang in ("", "en", "de") for t in ("the", "common", "häufig", "straße")}:
        has = sum(term.encode() in divergence.term_counts((x[1] or "").encode()) for x in rows() if (x[2] or "") == lang)
        if has >= divergence.LEAST:
            assert bits[divergence._cells(lang, [term.encode()])].all()
    assert 0 < bits.sum() < 1000


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = " ".join(f"Wort{'ä' * (i % 7)}-{i % 13}x" for i in range(2000)).encode()
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 50)
    assert divergence.term_counts(text) == whole and sum(whole.values()) == 4000


# ---------------------------------------------------------------- pages


ARTICLE = ["A title & more", "First paragraph that is long enough to be a passage of its own, with some words.", "Short.", "Second one: it goes on, and on, and has a link inside it, which is no menu."]
AROUND = '<nav><ul><li><a href="/a">Home</a><li><a href=\'/b>c\'>About us</a></ul></nav>'
BLOCKS = "<h1>A title &amp; more</h1><p>First paragraph that is <b>long enough</b>\n to be a\tpassage of its own,&nbsp;with some words.<p>Short.<p>Second one: it goes on,<!-- <p>no</p> --> and on, and has a <a href='x'>link inside it</a>, which is no menu."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><style>p{{}}</style><script>var x='</p><p>no</p>';</script></head><body>{AROUND}<article>{BLOCKS}</article><footer>&copy; x</footer></body></html>",
        f"<!DOCTYPE html>{AROUND}<main><header>{BLOCKS.replace('<p>', '</header><p>', 1)}<aside>see also</aside><form><p>Mail<input></form></main><section id=comments><article class=comment><p>I think that this is a very good text and I have read it all twice.</article></section>",
        f"<body><div id=header>My site, all of it, with a very long line about what it is, and what it was.</div><div class='content main'>{BLOCKS}</div><div class='left sideBar'><p>{'other words ' * 20}</p></div><div class=footer>x</div>",
        f"<body><div><div><a href=1>One of the links that are in the menu</a> <a href=2>Two of the links that are in the menu</a></div></div><div><div>{BLOCKS}</div></div><div><div>Copyright</div></div></body>",
        f"<body class='has-sidebar'><div role=navigation>Menu of the site</div><div>{BLOCKS}</div><div hidden>{'not seen ' * 20}</div><div style='display: none'>no</div><div class='cookie-notice'>We use cookies, and so on, and so on, and so on, and so on, and so on.</div>",
        f"<article>{BLOCKS}<div class=ad><p>Buy this<div>now</div></div></article><a href=x",
        f"<ARTICLE>{BLOCKS.replace('<p>', '<P CLASS=x>').replace('</b>', '</B>')}<noscript>no</noscript><div class='share'>x</div><p class=ad>ad</p></ARTICLE><p>After it.",
    ],
)
def test_main_text_of_pages(page):
    assert main_text.main_text(page).split("\n") == ARTICLE


def test_inline_removals_keep_a_block_together_and_breaks_are_white_space():
    assert main_text.main_text("<article><p>one <span class=ad>buy</span>two<br>three</p></article>") == "one two three"
    assert main_text.main_text("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>z</article>") == "a\nb\nc\nx\ny\nz"


def test_pages_that_are_short_strange_or_empty():
    assert main_text.main_text("") == "" and main_text.main_text("<nav>only a menu</nav>") == ""
    assert main_text.main_text("no markup at all") == "no markup at all"
    assert main_text.main_text("<p>tiny</p>") == "tiny"
    assert main_text.main_text("1 < 2 && 3 > 2 <p>é &eacute; &#x4e2d; &lt;b&gt;") == "1 < 2 && 3 > 2\né é 中 <b>"
    assert main_text.main_text("<div class=sidebar><p>a page whose only text has a name of a sidebar</p></div>") == "a page whose only text has a name of a sidebar"
    assert main_text.main_text("<p>an end <a href='") == "an end"
    long = "<article>" + "<p>word" * 50_000 + "</article>"
    assert main_text.main_text(long) == "\n".join(["word"] * 50_000)
    assert main_text.main_text("<" * 20_000 + "a='" * 20_000).startswith("<")


def test_surge_and_dive_of_sums():
    import numpy as np

    def brute(lengths, surge):
        n, sums = len(lengths), [sum(lengths[i : i + main_text.WINDOW]) for i in range(len(lengths))]
        surge, kept, inside = min(surge, max(sums, default=0)), [], False
        for i in range(n):
            inside = sums[i] > 0 and (inside or sums[i] >= surge)
            kept.append(inside)
        return kept

    r = random.Random(1)
    for _ in range(300):
        lengths = [r.choice([0, 0, 0, 5, 30, 100]) for _ in range(r.randint(0, 30))]
        assert main_text.between(np.array(lengths, np.int64), 80).tolist() == brute(lengths, 80)


def test_main_texts_as_a_table(spark):
    pages = [(1, "u", f"<article>{BLOCKS}</article>", "x", 5), (None, None, None, None, None), (2, "v", "", "y", 6), (1, "u", f"<article>{BLOCKS}</article>", "x", 5), (3, "w", "<p>" + "é" * 200_000, "z", 7)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int")
    found = main_text.extract(table)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, main_text.main_text(h or ""), len(main_text.main_text(h or ""))) for i, u, h, *_ in pages]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert main_text.extract(table.limit(0)).count() == 0
