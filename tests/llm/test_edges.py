"""Heavy groups, linked values, single files, texts without blanks, passages: against brute force or doubles in plain Python."""

import datetime as dt
import hashlib
import os
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from provenant.llm import exact_dedup, line_dedup, pseudonyms, sharding


def loads(spark, texts, shards):
    t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = [0] * shards
    for r in sharding.shard(t, shards).collect():
        out[r.shard] += r.size
    return out


def test_what_stands_beside_a_heavy_group_is_cut_by_itself(spark):
    r = random.Random(6)
    others = ["".join(r.choice("abcdef ") for _ in range(r.randint(500, 1500))) for _ in range(200)]
    for copies in (100, 240, 700):
        got = loads(spark, ["x" * 1000] * copies + others, 8)
        heavy, rest = copies * 1001, sum(len(x) + 1 for x in others)
        assert sum(got) == heavy + rest and min(got) > 0
        if heavy > rest:
            assert max(got) == heavy and sorted(got)[-2] < 1.35 * rest / 7
        else:
            assert max(got) <= max(heavy, 1.35 * (rest + heavy) / 8)
    two = loads(spark, ["x" * 1000] * 300 + ["y" * 1000] * 250 + others[:40], 8)
    assert sorted(two)[-2:] == [250 * 1001, 300 * 1001] and min(two) > 0
    assert sorted(loads(spark, ["x" * 10] * 5 + ["y"], 3)) == [0, 2, 55]
    assert loads(spark, ["same"] * 9, 4) == [45, 0, 0, 0]


def feistel(values, radices, kind, key):
    """The permutation once more."""
    half = len(values) // 2
    parts, q = [list(values[:half]), list(values[half:])], [radices[:half], radices[half:]]
    for number in range(1, pseudonyms.ROUNDS + 1):
        mine = 0 if number % 2 else 1
        seed = hashlib.sha512(":".join([key, kind, str(len(values)), str(number), ",".join(map(str, parts[1 - mine]))]).encode()).hexdigest()
        parts[mine] = [(v + int(seed[4 * (i % 32) : 4 * (i % 32) + 4], 16)) % m for i, (v, m) in enumerate(zip(parts[mine], q[mine], strict=True))]
    return parts[0] + parts[1]


def double(raw, key="key"):
    """What a security number, an address or a date becomes; None if it is none."""
    if m := re.fullmatch(r"(\d{3})-(\d\d)-(\d{4})", raw):
        area, group, serial = map(int, m.groups())
        areas = [a for a in range(1, 900) if a != 666]
        if area not in areas or not group or not serial:
            return None
        a, g, s = feistel([areas.index(area), group - 1, serial - 1], [898, 99, 9999], "ssn", key)
        return f"{areas[a]:03}-{g + 1:02}-{s + 1:04}"
    if re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", raw):
        octets = [int(x) for x in raw.split(".")]
        return ".".join(map(str, feistel(octets, [256] * 4, "ip", key))) if max(octets) < 256 else None
    forms = ["%Y-%m-%d"] if raw[4:5] == "-" else ["%d/%m/%Y", "%m/%d/%Y"] if "/" in raw else ["%d.%m.%Y"]
    for form in forms:
        try:
            day = dt.datetime.strptime(raw, form).date()
            break
        except ValueError:
            pass
    else:
        return None
    if not 1900 <= day.year <= 2099:
        return None
    every = [dt.date(1900, 1, 1) + dt.timedelta(i) for i in range(73049)]
    name = lambda d: "12" if d.day <= 12 else "28" if d.day <= 28 else "leap" if (d.month, d.day) == (2, 29) else str(d.day)
    like = sorted(d for d in every if name(d) == name(day))
    if name(day) in ("12", "28"):
        months, numbers, radices = [(y, m) for y in range(1900, 2100) for m in range(1, 13)], None, [2400, 12 if name(day) == "12" else 16]
        low = 1 if name(day) == "12" else 13
        numbers = [months.index((day.year, day.month)), day.day - low]
        a, b = feistel(numbers, radices, f"date:{name(day)}", key)
        new = dt.date(*months[a], b + low)
    elif name(day) == "leap":
        a, b = feistel(list(divmod(like.index(day), 7)), [7, 7], "date:leap", key)
        new = like[7 * a + b]
    else:
        months = sorted({d.month for d in like if name(day) != "29" or d.month != 2})
        a, b = feistel([day.year - 1900, months.index(day.month)], [200, len(months)], f"date:{name(day)}", key)
        new = dt.date(1900 + a, months[b], day.day)
    return new.strftime(form)


def test_numbers_and_dates_against_a_double(spark):
    r = random.Random(11)
    values = [f"{r.randrange(1000):03}-{r.randrange(100):02}-{r.randrange(10000):04}" for _ in range(300)] + ["665-01-0001", "667-99-9999", "899-01-0001", "001-01-0001", "666-11-1111", "000-11-1111", "900-11-1111", "123-00-1234", "123-45-0000"]
    values += [".".join(str(r.choice([0, 7, 255, 256, r.randrange(256)])) for _ in range(4)) for _ in range(40)]
    days = [dt.date(1900, 1, 1) + dt.timedelta(r.randrange(73049)) for _ in range(120)] + [dt.date(2000, 2, 29), dt.date(1999, 12, 31), dt.date(2099, 11, 30), dt.date(1900, 1, 29)]
    values += [d.strftime(f) for d in days for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")] + ["1899-12-31", "2020-02-30", "31.02.2020", "99/99/2020"]
    t = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    got = {x.doc_id: x for x in pseudonyms.with_pseudonyms(t, "key").collect()}
    for i, raw in enumerate(values):
        want = double(raw)
        assert (got[i].found[0].pseudonym if got[i].found else None) == want, raw
        assert got[i].text == (want or raw)
        if want and re.fullmatch(r"\d{3}-\d\d-\d{4}", raw):
            assert double(want) is not None and not re.search("^(000|666|9)|-00-|-0000$", want)


def test_a_day_has_one_pseudonym(spark):
    forms = ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y")
    days = [dt.date(2020, 1, 13), dt.date(1999, 12, 31), dt.date(2000, 2, 29), dt.date(1984, 6, 30), dt.date(2011, 3, 29)]
    t = spark.createDataFrame([(i, " ".join(d.strftime(f) for f in forms)) for i, d in enumerate(days)], "doc_id long, text string")
    for r in pseudonyms.with_pseudonyms(t, "key").collect():
        new = [dt.datetime.strptime(x, f).date() for x, f in zip(r.text.split(" "), forms, strict=True)]
        assert len(set(new)) == 1 and new[0].day > 12


def test_one_file_makes_several_batches(spark, tmp_path):
    texts = [f"t{i % 37}" for i in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs.parquet")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(spark, f"{tmp_path}/docs.parquet", f"{tmp_path}/state").collect()}
    alike = {t: [j for j, y in enumerate(texts) if y == t] for t in set(texts)}
    assert got == {i: (max(alike[t]), len(alike[t])) for i, t in enumerate(texts)}
    batches = [x for x in os.listdir(f"{tmp_path}/state/changed") if x.startswith("batch=")]
    assert len(batches) >= exact_dedup.BATCHES
    # later batches found what earlier ones had left in the state, and compared their bytes
    assert len([x for x in os.listdir(f"{tmp_path}/state/apart") if x.startswith("batch=")]) >= exact_dedup.BATCHES - 1


def test_texts_without_blanks_have_words(spark):
    r = random.Random(3)
    line = lambda: "".join(chr(r.randrange(0x4E00, 0x9FA0)) for _ in range(60))
    passage = [line() for _ in range(40)]
    t = spark.createDataFrame([(1, "\n".join([line(), *passage])), (2, "\n".join([*passage, line()])), (3, "\n".join(line() for _ in range(40)))], "doc_id long, text string")
    got = {x.doc_id: x.removed for x in line_dedup.removals(t, line_dedup.passage_dedup).collect()}
    assert got == {1: 0, 2: 40, 3: 0}
    chunks = {x.doc_id: x.removed for x in line_dedup.removals(t).collect()}
    assert chunks[1] == chunks[3] == 0 and chunks[2] > 1


def brute_passages(texts):
    """The lines that go from each text, by looking at every run of every text."""
    words = lambda x: max(x.count(" ") + 1, len(x.encode()) // line_dedup.WIDE)
    runs = []
    for doc, text in enumerate(texts):
        lines = text.split("\n")
        size = [words(x) for x in lines]
        for i in range(len(lines)):
            if size[i] >= line_dedup.LONG:
                runs.append((lines[i], doc, i, 1))
            for way in (1, -1):  # the shortest run of several lines that begins, or ends, at this line
                for n in range(2, len(lines) + 1):
                    a = i if way == 1 else i - n + 1
                    if a < 0 or a + n > len(lines):
                        break
                    if sum(size[a : a + n]) >= line_dedup.LEAST:
                        runs.append(("\n".join(lines[a : a + n]), doc, a, n))
                        break
    first = {}
    for run, doc, i, _ in sorted(runs, key=lambda x: x[1:3]):
        first.setdefault(run, (doc, i))
    gone = [set() for _ in texts]
    for run, doc, i, n in runs:
        d, j = first[run]
        if (d, j) != (doc, i) and not (d == doc and i < j + n):
            gone[doc].update(range(i, i + n))
    return gone


def test_passages_against_brute_force(spark):
    for seed in range(3):
        r = random.Random(seed)
        line = lambda: " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.choice([1, 1, 3, 8, 15, 60])))
        pool = [[line() for _ in range(r.randint(1, 9))] for _ in range(6)]
        texts = ["\n".join(x for _ in range(r.randint(1, 5)) for x in (r.choice(pool) if r.random() < 0.6 else [line()])) for _ in range(25)] + ["", "\n\n"]
        t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {x.doc_id: x for x in line_dedup.passage_dedup(t).collect()}
        for doc, gone in enumerate(brute_passages(texts)):
            kept = "\n".join(x for i, x in enumerate(texts[doc].split("\n")) if i not in gone)
            assert (doc in got) == bool(gone)
            assert not gone or (got[doc].removed, got[doc].kept_text) == (len(gone), kept)


def test_stages_leave_the_session_as_it_was(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    before = {k: spark.conf.get(k, None) for k in corpus_pipeline.BATCHES}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path)).agg(F.count("doc_id")).first()[0] == 1
    assert {k: spark.conf.get(k, None) for k in corpus_pipeline.BATCHES} == before
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
