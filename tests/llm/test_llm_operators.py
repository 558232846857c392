"""Each operator on nasty rows and on an empty table, against brute force or the libraries."""

import datetime as dt
import hashlib
import random
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from fractions import Fraction
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from provenant.llm import bit_sliced, exact_dedup, line_dedup, mixing, ngram_join, pseudonyms, sentencepieces, sharding, token_files, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Names that the operators use for their own columns are here as further ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, found string, key string, size string, row int, n int, block int, gram int"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    long = "\n".join(" ".join(word() for _ in range(r.choice([3, 20, 60]))) for _ in range(900))
    base = [word() for _ in range(120)]
    near = []
    for k in range(12):
        w = list(base)
        for _ in range(k % 5):
            w[r.randrange(len(w))] = word()
        near.append(" ".join(w))
    passage = "\n".join(" ".join(word() for _ in range(15)) for _ in range(6))
    texts = [None, "", " \n\t", "One two", "one TWO", "a b c d e", long, long, long + " x", "ünïcode 中文 🎉 " * 9, "x" * 30_000, *near]
    texts += [f"{word()} {word()}\n{passage}\n{word()}" for _ in range(5)]
    texts += [" ".join(word() for _ in range(r.randint(1, 300))) for _ in range(40)]
    out = [(i, t, None if i % 3 == 0 else "en", [None, "a", "b", "ß", "a"][i % 5], None if i % 7 == 0 else len(t or ""), 0.5, "x", "y", "k", "s", 1, 2, 3, 4) for i, t in enumerate(texts)]
    return [*out, out[6], out[3], (None, "one two three", None, None, None, *[None] * 9), (3, "another text of this number", "en", "a", 3, *[None] * 9)]


PATHS = {}


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    PATHS["docs"] = path
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('empty')}/documents.parquet"
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    PATHS["empty"] = path
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(60)] + [(None, 1, 1), (5, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_components_are_those_of_all_pairs(docs, empty):
    given = [(r.doc_id, grams(r.text)) for r in docs.collect()]
    parent = {d: d for d, _ in given if d is not None}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    some = [(d, s) for d, s in given if d is not None]
    for i, (d, s) in enumerate(some):
        for e, t in some[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    want = sorted((d, len(s), top(d)) for d, s in some)
    got = ngram_join.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.filter("doc_id is not null").collect()) == want
    assert got.filter("doc_id is null").count() == 1
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None, *(top(d) for d, _ in some)}


def test_words_are_told_apart_by_all_their_bytes(spark):
    one, other = "a", "b"
    for _ in range(10):  # Thue and Morse's word and its complement, of 1,024 letters
        one, other = one + other, other + one
    r = random.Random(9)
    pairs = [(one, other), ("a" * 16 + "b", "a" * 16 + "c"), ("nul\x00", "nul"), ("a\x00" * 9, "a" * 18), ("x" * 70, "x" * 71)]
    pairs += [(w, w[:k] + chr(ord(w[k]) ^ 1) + w[k + 1 :]) for n in range(1, 70) for w in ["".join(r.choice("bdfhjl") for _ in range(n))] for k in (0, n - 1)]
    texts = [w for p in pairs for w in p]
    t = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "doc_id long, text string")
    got = ngram_join.jaccard_components(t).collect()
    first = {}
    for i, w in enumerate(texts):
        first.setdefault(w, i)
    assert {r.doc_id: r.component_id for r in got} == {i: first[w] for i, w in enumerate(texts)}
    assert all(r.n_shingles == 1 for r in got)


#: Two words of 32 bytes that an invertible scramble of eight bytes at a time takes for one.
ALIKE = ("?<$!{]`<_,:^%+%:|,~~~)|(/.|?.^]}", "};@(*~#(,+:]!^))@@,{?@~/`&~~@//!")


def test_words_that_were_made_to_agree_stay_apart(spark):
    r = random.Random(4)
    mine = [*ALIKE, *("".join(r.choice("{}@#~!^,.;:ab") for _ in range(r.choice([16, 17, 24, 32, 33, 64, 65]))) for _ in range(1000))]
    t = spark.createDataFrame(list(enumerate(mine)), "doc_id long, text string")
    assert all(x.component_id == x.doc_id for x in ngram_join.jaccard_components(t).collect())
    e = token_files.WordEncoder(WORDS)
    ids, counts = e.encode(pa.array(mine))
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [x.ids for x in e.tokenizer.encode_batch(mine, add_special_tokens=False)]


def test_keys_change_values_but_no_set():
    texts = pa.array(["one two three four five six", "a-very-long-word-of-more-than-sixteen-bytes b", "a\x00b c", ""])
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    one, other = ([(len(x), x.tolist()) for _, x, _ in ngram_join.gram_sets(batch, key=k)] for k in (b"k" * 16, b"l" * 16))
    assert [n for n, _ in one] == [n for n, _ in other] == [2, 1, 1, 0] and one[0] != other[0]


@pytest.mark.parametrize("seed", range(5))
def test_sketches_drop_no_similar_pair(seed):
    import pyarrow as pa

    r = np.random.default_rng(seed)
    for _ in range(60):
        n = int(r.integers(1, 3000))
        a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.append(a[r.random(len(a)) < r.random() * 0.3 + 0.7], r.integers(0, 2**64, int(n * r.random() * 0.3), dtype=np.uint64)))
        if not len(b):
            continue
        both = len(np.intersect1d(a, b))
        sides = [ngram_join.Sketches(pa.array([ngram_join.sketch(x)])) for x in (a, b)]
        may = sides[0].may_agree(np.array([0]), sides[1], np.array([0]), np.array([len(a) + len(b)]))[0]
        assert may or 100 * both < 75 * (len(a) + len(b) - both)


def test_dense_blocks_find_the_same(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(60)] = f"x{r.random()}"
        texts.append(" ".join(w))
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "STARS", 1)
    got = {d: c for d, _, c in ngram_join.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [grams(t) for t in texts]
    want = list(range(150))
    changed = True
    while changed:
        changed = False
        for i in range(150):
            for j in range(i):
                if want[i] != want[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
                    changed = True
    assert got == dict(enumerate(want))


def test_pieces_are_those_of_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for r in docs.collect():
        ids = [1, *lib.encode(r.text or ""), 2]
        want.append((r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in sentencepieces.round_trip(docs, PIECES).collect())
    assert sentencepieces.round_trip(empty, PIECES).count() == 0
    back = sentencepieces.decode(sentencepieces.encode(docs.select("doc_id", "text", "found", F.col("ids")), PIECES), PIECES, to="again")
    assert back.filter("doc_id <> 10 and again <> coalesce(text, '')").count() == 0


def test_decoding_of_any_ids():
    import sentencepiece

    lib, own, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepieces.model(PIECES), random.Random(4)
    for _ in range(3000):
        ids = [r.choice([0, 1, 2, r.randint(3, 258), r.randint(3, 258), r.randint(259, 31999), 259]) for _ in range(r.randint(0, 8))]
        assert own.decode(ids) == lib.decode(ids), ids


def test_top_rows_are_exact(spark):
    r = np.random.default_rng(1)
    m = (r.normal(size=(400, 8)) / 3).astype(np.float32)
    m[50:60] = m[49]
    vectors = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)] + [(400, None, 0), (401, [None] * 8, 0), (402, [float("nan")] * 8, 0), (450, [1.0, 2.0], 0), (7, [float(x) for x in m[7]], 0), (None, [0.0] * 8, 0), (451, [], 1)]
    t = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    got = {(q, k): (v, s) for q, k, v, s in bit_sliced.top_k(t).collect()}
    ints = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    for q in range(0, 400, 50):
        s = ints @ ints[q]
        order = sorted((-int(s[i]), i) for i in range(400) if i != q)
        order = sorted([*order, (-int(s[7]), 7)])[:5]
        assert [(i, -x) for x, i in order] == [got[q, k] for k in range(1, 6)]
    assert (450, 1) not in got
    assert bit_sliced.top_k(t.limit(0)).count() == 0
    assert bit_sliced.search(bit_sliced.build_index(t.limit(0)), t, 5).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_large_components_are_ranked_exactly(spark, kind):
    r = np.random.default_rng(7)
    size = {"float": np.float32, "double": np.float64}[kind]
    wide = [r.normal(size=6) * 10.0 ** r.integers(-3, 38 if kind == "float" else 307) for _ in range(60)]
    wide += [[6e5, 1, 0, 0, 0, 0], [1e12, -1e12, 3, 0, 0, 1], [-6e5, 1e12, 0.001, -0.001, 0, 0], *r.normal(size=(30, 6))]
    long = [r.normal(size=1024) * 3e6 for _ in range(20)]
    rows = [(i, [float(size(x)) for x in v], "z") for i, v in enumerate([*wide, *long])]
    t = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string")
    exact = [[int(np.floor(Fraction(x) * 256)) for x in v] for _, v, _ in rows]
    want = []
    for q in range(0, len(rows), 5):
        s = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in enumerate(exact) if i != q and len(v) == len(exact[q]))
        want += [(q, k, i, max(-(2**63), min(2**63 - 1, -x))) for k, (x, i) in enumerate(s[:5], 1)]
    assert sorted(tuple(r) for r in bit_sliced.top_k(t, every=5).collect()) == want


def test_toxic_words_are_learned(spark, docs, empty, labels):
    r = random.Random(3)
    clean = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(1500):
        w = [r.choice(clean) for _ in range(30)]
        if i % 6 == 0:
            w[3], w[9] = r.choice(["Vile", "nasty,", "foul"]), r.choice(["vile!", "nasty", "foul."])
        texts.append((i, " ".join(w)))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(0, 1500) if i % 5 < 3], "doc_id long, toxic int")
    got = toxicity.toxicity(table, known).collect()
    assert [r.held_out for r in sorted(got)] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(1500)]
    held = [(r.doc_id % 6 == 0, r.predicted == 1) for r in got if r.held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)

    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).columns == docs.columns


def test_pseudonyms_keep_format_and_link(spark, docs, empty):
    def luhn(s):
        return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", s))))) % 10

    texts = ["4041894974608795, +1 (988) 555-2485", "ab 4041894974608795 4041894974608796", "x.yz@mail.example 42.144.35.254 999.1.1.1", "DE89 3704 0044 0532 0130 00 078-05-1120", "1985-02-28 31.12.1999 12/31/1999 1985-02-30", None, ""]
    t = spark.createDataFrame([(i, x, "z") for i, x in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: r for r in pseudonyms.with_pseudonyms(t, "key").collect()}
    card = got[0].found[0].pseudonym
    assert card != "4041894974608795" and luhn(card) == 0 and re.fullmatch(r"\d{16}", card)
    assert got[1].text == f"ab {card} 4041894974608796"
    assert re.fullmatch(r"\w\.\w\w@mail\.example (\d+\.){3}\d+ 999\.1\.1\.1", got[2].text) and "x.yz" not in got[2].text
    iban = re.sub(" ", "", got[3].found[0].pseudonym)
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert [f.kind for f in got[4].found] == ["date"] * 3 and got[4].text.endswith(" 1985-02-30")
    assert got[5].text is None and got[6].text == ""
    days = spark.range(0, 73049, 7).select(F.col("id").alias("doc_id"), F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pseudonyms.with_pseudonyms(days, "key").select("text").distinct().count() == days.count()
    values = spark.createDataFrame([([3, 9, 0], [10, 10, 7]), ([5], [12]), ([], [])], "v array<long>, q array<long>")
    there = values.withColumn("p", pseudonyms.feistel(F.col("v"), F.col("q"), F.lit("kind"), "key"))
    assert all(r.v == r.b for r in there.withColumn("b", pseudonyms.feistel(F.col("p"), F.col("q"), F.lit("kind"), "key", invert=True)).collect())
    assert pseudonyms.pseudonymised(docs, "key").count() == docs.count()
    assert pseudonyms.pseudonymised(empty, "key").count() == 0


def test_dates_are_permuted_in_each_format(spark):
    days = [dt.date(1900, 1, 1) + dt.timedelta(i) for i in range(73049)]
    forms = {"%Y-%m-%d": days, "%d.%m.%Y": days, "%d/%m/%Y": days, "%m/%d/%Y": [d for d in days if d.day > 12]}
    texts = [d.strftime(f) for f, some in forms.items() for d in some]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in sorted(pseudonyms.with_pseudonyms(t, "key").collect(), key=lambda r: r.doc_id)]
    at = 0
    for some in forms.values():
        before, after = texts[at : at + len(some)], got[at : at + len(some)]
        assert set(after) == set(before) and sum(a == b for a, b in zip(after, before, strict=True)) < 0.02 * len(some)
        at += len(some)


def test_long_texts_without_and_with_values(spark):
    tail = "ab@example.com 4041894974608795"
    long = ["x@" + "a." * 500_000 + "com", "a." * 500_000, "1." * 300_000, "1-" * 300_000, "+1 " * 300_000, "DE89 " * 200_000, "@" * 100_000, "a@b." * 200_000, "9" * 500_000, "12/" * 300_000]
    t = spark.createDataFrame([(i, f"{x} {tail}") for i, x in enumerate(["", *long])], "doc_id long, text string")
    got = {r.doc_id: r for r in pseudonyms.with_pseudonyms(t, "key").collect()}
    end = got[0].text[1:]
    assert tail.split()[0] not in end and all(r.text.endswith(end) and len(r.text) == len(long[i - 1]) + 1 + len(tail) for i, r in got.items() if i)


def test_the_key_stands_in_no_plan(spark, docs):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        pseudonyms.pseudonymised(docs, "a very secret key").explain("extended")
    assert "Project" in out.getvalue() and "very secret" not in out.getvalue()


def test_pseudonyms_link_formats_and_shift_apart(spark):
    groups = [
        ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111 1111 1111 123"], ["378282246310005", "3782 822463 10005"], ["6304000000000000000", "6304 0000 0000 0000 000"],
        ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00"], ["+4915112345678", "+49 151 12345678", "+49 151 1234 5678"], ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485"],
    ]
    names = ["anna", "anne", "bbbb", "zoey", *"abcdefghijklmnopqrstuvwxyz", *[x + y for x in "abcdefghij" for y in "klmnopqrst"]]
    texts = [t for g in groups for t in g] + [f"{n}@example.com" for n in names] + ["anna@example.org"]
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r.doc_id]: r.text for r in pseudonyms.with_pseudonyms(t, "key").collect()}
    plain = lambda x: re.sub(r"\W", "", x)
    assert got["4111 1111 1111 1111 123"] == got["4111 1111 1111 1111"] + " 123"
    for g in groups:
        long = [x for x in g if not x.endswith(" 123")]
        ends = {plain(got[x])[-10:] for x in long}
        assert len(ends) == 1 and all(got[x] != x and re.sub("[A-Z0-9]", "0", got[x]) == re.sub("[A-Z0-9]", "0", x) for x in long), (g, [got[x] for x in g])
    mail = lambda n: got[f"{n}@example.com"].split("@")[0]
    shift = lambda n: tuple((ord(b) - ord(a)) % 26 for a, b in zip(n, mail(n), strict=True))
    assert len({shift(n) for n in names[:4]}) == 4 and len({shift(n) for n in names[4:30]}) > 2 and len({shift(n) for n in names[30:]}) > 20
    assert len({mail(n) for n in names}) == len(names) and got["anna@example.org"].split("@")[0] != mail("anna")


def test_mix_comes_near_its_targets(docs, empty):
    got = mixing.mix(docs.join(docs.select("doc_id", "source").distinct().groupBy("doc_id").agg(F.first("source").alias("own")), "doc_id", "left").drop("own")).collect()
    assert len(got) == docs.count()
    sizes = {}
    for r in docs.collect():
        s = (r.source is None, r.source or "")
        sizes[s] = sizes.get(s, 0) + len(words(r.text))
    names, total = sorted(sizes), sum(sizes.values())
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = [s for s in names if s not in capped and left * weight[s] / free > 3 * sizes[s]]
        if not over:
            break
        capped.update(over)
    target = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in names})
    assert all(r.taken <= 3 * r.size for r in got)
    largest = max(r.size for r in got)
    for size, goal in {(r.source_size, r.target) for r in got}:
        assert abs(sum(r.taken for r in got if (r.source_size, r.target) == (size, goal)) - goal) <= 2 * largest
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(empty).count() == 0
    given = docs.withColumns({"_copies": F.lit("x"), "_key": F.lit("y")})
    done = mixing.mixed(given)
    assert done.columns == given.columns
    # of each row and source as many as the mix says
    count = lambda rows: Counter((r.doc_id, r.text, r.source) for r in rows)
    keyed = {(r.doc_id, r.key, r.src): r.copies for r in mixing.mix(docs).collect()}
    want = Counter()
    for r in docs.withColumns({"k": mixing.row_key(), "s": mixing.source_name()}).collect():
        want[r.doc_id, r.text, r.source] += keyed[r.doc_id, r.k, r.s]
    assert count(done.collect()) == +want


def test_one_text_of_two_sources_is_mixed_by_each(spark):
    rows = [(1, "a b c d", "s1"), (1, "a b c d", "s2"), *[(i, f"x{i} y z", "s2") for i in range(2, 40)]]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix(t).collect():
        taken[r.doc_id, r.src] = taken.get((r.doc_id, r.src), 0) + r.copies
    done = Counter((r.doc_id, "0" + r.source) for r in mixing.mixed(t).collect())
    assert done == +Counter(taken) and done[1, "0s1"] == 3 and done[1, "0s2"] < 3


def test_shards_have_the_smallest_capacity(docs, empty):
    got = sharding.shard(docs).collect()
    groups = {}
    for r in docs.collect():
        key = hashlib.sha256((r.text or "").encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((r.text or "").encode()) + 1
    order = [groups[k] for k in sorted(groups)]

    def needed(cap):
        n, at = 1, 0
        for w in order:
            n, at = (n, at + w) if at + w <= cap else (n + 1, w)
        return n

    cap = next(c for c in range(max(order), sum(order) + 1) if needed(c) <= 8)
    loads = {}
    for r in got:
        loads.setdefault(r.shard, []).append(r)
    assert max(sum(r.size for r in v) for v in loads.values()) <= cap
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in loads.values())
    assert set(loads) <= set(range(8)) and {r.law for r in got} == {"bytes"}
    assert len({(r.text_crc32, r.size): r.shard for r in got}) == len({(r.text_crc32, r.size, r.shard) for r in got})
    assert sharding.shard(empty).count() == 0


def test_shards_are_written(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "_CELL", 2)
    place = {}
    for r in sharding.shard(docs).collect():
        place.setdefault(r.text_crc32, set()).add(r.shard)
    sharding.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert all({r.shard} == place[zlib.crc32((r.text or "").encode())] for r in back.collect())


def test_passages_that_repeat_go(spark, docs, empty):
    r = random.Random(8)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    passage, long = [line(12) for _ in range(12)], line(80)
    texts = [[line(9), *passage, line(9)], [line(4), line(11), *passage], [line(9) for _ in range(30)], [line(6), long, line(6)], [long]]
    t = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id: x.text.split("\n") for x in line_dedup.without_repeats(t).collect()}
    assert kept[0] == texts[0] and kept[2] == texts[2] and kept[3] == texts[3] and kept[4] == [""]
    assert kept[1][:2] == texts[1][:2] and len(set(kept[1]) & set(passage)) <= 8
    done = line_dedup.without_repeats(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    left = {x.doc_id: len(x.text or "") for x in done.collect()}
    assert left[7] < left[6] / 2  # of a copy only short single lines stay
    assert line_dedup.removals(docs).count() == docs.count()
    assert line_dedup.without_repeats(empty).count() == 0
    assert line_dedup.removals(empty).count() == 0
    cut = line_dedup.with_chunks(docs.select("doc_id", "text"), "parts")
    assert cut.filter("text is not null and array_join(parts, '\n') <> text").count() == 0


def test_chunks_are_those_of_a_plain_loop(spark):
    r = random.Random(21)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    line = lambda n: " ".join(r.choice(["aa", "b", "\x01", "\x01\x02", "\x01\x03x", "dd"]) + str(r.randrange(9)) for _ in range(n))
    passage = [line(r.choice([1, 12, 60])) for _ in range(25)]
    texts = [[line(r.choice([0, 2, 9, 55])) for _ in range(r.randint(0, 5))] + passage[r.randrange(3) :] + [line(3)] for _ in range(12)]
    t = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    for least in (1, 20):
        seen, want = set(), {}
        for i, lines in enumerate(texts):
            lines = "\n".join(lines).split("\n")
            long = [x.count(" ") + 1 >= 50 for x in lines]
            chunks = []
            for k, x in enumerate(lines):
                if k == 0 or long[k] or long[k - 1] or k > 1 and md5(md5(lines[k - 2]) + md5(lines[k - 1])) < "8":
                    chunks.append([])
                chunks[-1].append(x)
            kept = []
            for c in chunks:
                whole = "\n".join(c)
                counts = whole.count(" ") + whole.count("\n") + 1 >= (least if len(c) > 1 else 50)
                if not (counts and whole in seen):
                    kept.append(whole)
                if counts:
                    seen.add(whole)
            want[i] = "\n".join(kept)
        got = {x.doc_id: x.kept_text for x in line_dedup.line_dedup(t, least).collect()}
        assert {i: got.get(i, "\n".join(x)) for i, x in enumerate(texts)} == want


def test_passages_of_short_lines_go_whole(spark):
    r = random.Random(11)
    line = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shapes = [(2, 45), (2, 10), (3, 40), (4, 30), (5, 11), (7, 9), (10, 27), (10, 6)]
    first, later, stays = [], [], []
    for n, each in shapes:
        passage = [line(each) for _ in range(n)]
        first.append([line(9), *passage, line(8)])
        before, after, end = [line(5), line(7)], [line(3)], [line(3)]
        later += [[*before, *passage, *after], passage, [*passage, *end]]
        stays += [[*before, *after], [""], end]
    few = ["no", "more", line(17)]  # 19 words repeat and stay
    spam = ["one two three four"] * 40  # the first five are the first occurrence of 20 words
    texts = [*first, *later, [line(4), *few], [*few, line(6)], spam]
    want = [*first, *stays, *texts[-3:-1], spam[:5]]
    t = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id: x.text for x in line_dedup.without_repeats(t).collect()}
    assert kept == {i: "\n".join(x) for i, x in enumerate(want)}


def test_token_files_come_back(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = token_files.read(token_files.write(docs, f"file://{tmp_path}/a", WORDS, end_id=2), digest=True).collect()
    want = {}
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    have = {}
    for r in sorted(got, key=lambda r: r.start):
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {d: sorted(v) for d, v in have.items()} == {d: sorted(v) for d, v in want.items()}
    inorder = sorted(got, key=lambda r: r.start)
    assert inorder[0].start == 0 and all(a.start + a.n_tokens == b.start and (a.doc_id is None or a.doc_id <= b.doc_id) for a, b in pairwise(inorder))
    assert token_files.read(token_files.directory(spark, f"file://{tmp_path}/a")).count() == len(got)
    assert token_files.read(token_files.write(empty, f"file://{tmp_path}/b", WORDS, end_id=2)).count() == 0


def test_marks_after_letters_that_come_apart():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    letters = [c for c in map(chr, range(0x110000)) if c.isalnum() and unicodedata.normalize("NFC", c) != c]
    assert "\u095d" in letters and "\ufb1d" in letters
    texts = [f"{stem}{c}{mark}" for c in letters for mark in ".,;:!?" for stem in ("", "\u092a", "a")]
    assert own.direct
    r = random.Random(12)
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    for _ in range(4000):  # letters of many scripts, digits and marks in any order
        parts = [r.choice(["ab", "É", "ŉ", "İ", "ſ", "ß", "don't", "we'LL", "7", "½", "中", "Ж", "ﬁ", "e\u0301", "ǆ", "_", "\x00", *marks, chr(r.randrange(0xC0, 0x250))]) for _ in range(r.randint(1, 6))]
        texts.append("".join(parts))
    same_ids(lib, own, texts)
    own.direct = False
    own._forget()
    same_ids(lib, own, texts)


def same_ids(lib, own, texts):
    ids, counts = own.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(x) for x in want]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_words_that_agree_in_half_their_bits_are_encoded_apart(monkeypatch):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = ["one two", None, "three, one", ""]
    same_ids(lib, own, texts)
    values = token_files.Words.values
    monkeypatch.setattr(token_files.Words, "values", lambda w, lane=0: values(w, lane) >> np.uint64(63 - lane * 63))
    own._forget()
    for some in (["one two three four five"], ["six"], ["seven"], ["eight"]):
        same_ids(lib, own, some)


def test_words_of_the_documents_have_the_librarys_ids():
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    for i in range(0, len(texts), 100):
        same_ids(lib, own, texts[i : i + 100])


@pytest.mark.parametrize("seed", range(20))
def test_blocks_come_back(seed):
    r = np.random.default_rng(seed)
    v = (r.integers(0, 2**32, r.integers(1, 4097), dtype=np.uint64) >> np.uint64(r.integers(0, 33))).astype(np.uint32)
    v = np.where(r.random(len(v)) < 0.02, np.uint32(2**32 - 1), v)
    assert (token_files.unpack_block(memoryview(token_files.pack_block(v))) == v).all()


def test_equal_texts_have_one_keeper(spark, docs, empty):
    got = exact_dedup.exact_dedup(spark, PATHS["docs"]).collect()
    groups = {}
    for r in docs.collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(spark, PATHS["empty"]).count() == 0


def test_texts_of_one_digest_are_compared(spark, tmp_path, monkeypatch):
    texts = ["ab", "ac", "ab", "b", None, "", "ac", "ad", "b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs.parquet")
    sha2 = F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: sha2(F.substring(c, 1, 1), n))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(spark, f"{tmp_path}/docs.parquet", f"{tmp_path}/state").collect()}
    alike = [[j for j, y in enumerate(texts) if (y or "") == (x or "")] for x in texts]
    assert got == {i: (max(a), len(a), i == max(a)) for i, a in enumerate(alike)}


def test_a_stream_goes_on_with_its_state(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    docs.repartition(3).write.parquet(f"{tmp_path}/in")
    assert {(r.keep.doc_id, r.n) for r in exact_dedup.digest_state(spark, f"{tmp_path}/in", f"{tmp_path}/s").collect()} == {(3, 2), (2, 1)}
    spark.createDataFrame([(9, "b"), (0, "a"), (4, "c")], docs.schema).write.mode("append").parquet(f"{tmp_path}/in")
    assert {(r.keep.doc_id, r.n) for r in exact_dedup.digest_state(spark, f"{tmp_path}/in", f"{tmp_path}/s").collect()} == {(3, 3), (9, 2), (4, 1)}
