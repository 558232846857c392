"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame functions only.

Each value is validated and then permuted by a keyed Feistel network within its own format: a card number becomes
another one with a right check digit, a date another date. The permutation hangs on nothing but key, kind and
value. So equal values stay equal everywhere, different ones stay different, and who has the key can invert it;
no table of values is kept, nothing is shuffled.

A value is an array of small numbers, each below its own radix: digits (10), letters (26), octets (256), or for a
date the two digits of its day number. Only characters that change are in it, so a value is the same in any format;
one place alone is taken as two factors. The array is cut in halves; in each round one half is shifted, place by
place, by numbers from a SHA-512 over key, kind, an address's domain or an account's country, length, round and the other half.

=====  =======================================================  =============================================
kind   what is taken                                            what changes
=====  =======================================================  =============================================
card   13 to 19 digits, in groups of four or 4-6-5, by Luhn      all digits; the last one is the new check digit
iban   country, check digits, account; right modulo 97          the account; check digits are made anew
ssn    ddd-dd-dddd with a possible area, group and serial       area, group and serial, each a possible one
phone  with + and country, with an area in brackets, ddd-ddd-dddd  all digits but the country's
ip     four octets                                              the octets
date   yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy or mm/dd/yyyy,        the day, within the same two hundred years;
       1900 to 2099, existing                                   among days of the same kind, see below
email  name@domain                                              letters and digits of the name
=====  =======================================================  =============================================

What fails its validation is left as it is; so is a name of more than 64 characters before an @, which is no address. A
date with slashes is read day first where that is a day. A day has one pseudonym, however it is written: days up to
the 12th are permuted among themselves, those up to the 28th, and the 29th, 30th, 31st and leap days each by itself, so
that a date written month first is never taken for one written day first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.llm.shared import free_name

ROUNDS = 8

#: What is looked at, most specific first.
PATTERN = "|".join(
    [
        # a repeated group costs the regular expression engine stack, so its repeats are bounded: names have at most 127 parts
        r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,126}",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
        r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\1[0-9]{4})(?![0-9-])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
        r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
        r"(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
        r"(?<![0-9-])[0-9]{3}([.-])[0-9]{3}\2[0-9]{4}(?![0-9-])",
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{4}(?:\3[0-9]{3}(?![0-9]))?|[0-9]{4}([ -])[0-9]{6}\4[0-9]{5})(?![0-9])",
    ]
)
#: A country's calling code, at the start of a number's digits.
_COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _ord(c: Column) -> Column:
    return F.ascii(c).cast("long")


def _luhn_sum(digits: Column) -> Column:
    """The sum of a digit string whose last digit counts once."""
    turned = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (_ord(c) - 48) * (1 + i % 2))
    return F.aggregate(turned, F.lit(0).cast("long"), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0))


def _mod97(text: Column) -> Column:
    """Of letters and digits, a letter being two digits from 10 on."""
    step = lambda s, c: F.when(c.rlike("[0-9]"), s * 10 + _ord(c) - 48).otherwise(s * 100 + _ord(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), step)


def _iso(raw: Column) -> Column:
    """A date as yyyy-mm-dd, day first where that is possible; null if there is no such day."""
    a, b, year = F.substring(raw, 1, 2), F.substring(raw, 4, 2), F.substring(raw, 7, 4)
    day_first = F.concat_ws("-", year, b, a)
    month_first = F.when(raw.contains("/"), F.concat_ws("-", year, a, b))
    found = F.when(F.substring(raw, 5, 1) == "-", raw.try_cast("date")).otherwise(F.coalesce(day_first.try_cast("date"), month_first.try_cast("date")))
    return F.when((F.year(found) >= 1900) & (F.year(found) <= 2099), found)


#: Months (from 1) that have a 31st, and that have a 29th and a 30th in any year.
_LONG_MONTHS, _MONTHS = (1, 3, 5, 7, 8, 10, 12), (1, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)


def _month_first(raw: Column) -> Column:
    """Whether a validated date can only be read month first."""
    return raw.contains("/") & F.concat_ws("-", F.substring(raw, 7, 4), F.substring(raw, 4, 2), F.substring(raw, 1, 2)).try_cast("date").isNull()


def _day_group(day: Column) -> Column:
    """Days in groups, each a rectangle of two numbers."""
    d = F.dayofmonth(day)
    return F.when(d <= 12, "12").when(d <= 28, "28").when(d == 31, "31").when(d == 30, "30").when(F.month(day) == 2, "leap").otherwise("29")


def _group_numbers(day: Column) -> tuple[Column, Column]:
    """(values, radices) of a day in its group."""
    year, month, d, group = F.year(day) - 1900, F.month(day), F.dayofmonth(day), _day_group(day)
    longs = lambda *x: F.array(*[(v if isinstance(v, Column) else F.lit(v)).cast("long") for v in x])
    at = lambda months: F.array_position(F.array(*[F.lit(m) for m in months]), month) - 1
    leap = F.floor((year - 4) / 4)  # 1904 is the first leap year, and there are 49
    values = F.when(group == "12", longs(year * 12 + month - 1, d - 1)).when(group == "28", longs(year * 12 + month - 1, d - 13)).when(group == "31", longs(year, at(_LONG_MONTHS))).when(group == "leap", longs(F.floor(leap / 7), leap % 7)).otherwise(longs(year, at(_MONTHS)))
    radices = F.when(group == "12", longs(2400, 12)).when(group == "28", longs(2400, 16)).when(group == "31", longs(200, len(_LONG_MONTHS))).when(group == "leap", longs(7, 7)).otherwise(longs(200, len(_MONTHS)))
    return values, radices


def _of_group(group: Column, v: Column) -> Column:
    """The day of a group that has these numbers."""
    month = lambda months: F.get(F.array(*[F.lit(m) for m in months]), v[1].cast("int"))
    date = lambda y, m, d: F.make_date(y.cast("int"), m.cast("int"), d.cast("int") if isinstance(d, Column) else F.lit(d))
    return (
        F.when(group.isin("12", "28"), date(1900 + F.floor(v[0] / 12), v[0] % 12 + 1, v[1] + F.when(group == "12", 1).otherwise(13)))
        .when(group == "31", date(1900 + v[0], month(_LONG_MONTHS), 31))
        .when(group == "leap", date(1904 + 4 * (7 * v[0] + v[1]), F.lit(2), 29))
        .when(group == "30", date(1900 + v[0], month(_MONTHS), 30))
        .otherwise(date(1900 + v[0], month(_MONTHS), 29))
    )


def _kind(raw: Column) -> Column:
    """The kind of a match, null if its validation fails."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    plain = F.regexp_replace(raw, " ", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    octets = F.split(raw, r"\.")
    is_ip = raw.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike("^[A-Z]{2}"), F.when(_mod97(turned) == 1, "iban"))
        .when(raw.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([./])[0-9]{2}\\2[0-9]{4})$"), F.when(_iso(raw).isNotNull(), "date"))
        .when(raw.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~raw.rlike("^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(is_ip, F.when(F.forall(octets, lambda o: o.cast("int") < 256), "ip"))
        .when(raw.rlike(r"^[+(]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$"), F.when(F.length(digits).between(7, 15), "phone"))
        .otherwise(F.when(_luhn_sum(digits) % 10 == 0, "card"))
    )


def _head(raw: Column) -> Column:
    """A match without a last group of three digits that belongs to no card number."""
    long = raw.rlike("^[0-9]{4}([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}\\1[0-9]{3}$")
    return F.when(long & (_luhn_sum(F.regexp_replace(raw, "[^0-9]", "")) % 10 != 0), F.substring(raw, 1, 19)).otherwise(raw)


def _span(raw: Column, kind: Column) -> Column:
    """First and last place (from 0) of the characters that change, for kinds that change characters."""
    n = F.length(F.regexp_extract(F.regexp_replace(raw, "[^0-9]", ""), _COUNTRY, 0))
    upto = lambda k: F.length(F.regexp_extract(raw, r"^\+(?:[^0-9]*[0-9]){%d}" % k, 0))
    country = F.when(~raw.startswith("+"), 0).when(n == 1, upto(1)).when(n == 2, upto(2)).otherwise(upto(3))
    last = F.length(raw) - 1
    return (
        F.when(kind == "email", F.array(F.lit(0), F.instr(raw, "@") - 2))
        .when(kind == "iban", F.array(F.lit(4), last))
        .when(kind == "phone", F.array(country, last))
        .when(kind == "card", F.array(F.lit(0), last - 1))
        .otherwise(F.array(F.lit(0), last))
    )


def _tweak(raw: Column, kind: Column) -> Column:
    """What stays of a value and tells its permutation from others of its kind."""
    return F.when(kind == "email", F.concat(F.lit("email:"), F.lower(F.substring_index(raw, "@", -1)))).when(kind == "iban", F.concat(F.lit("iban:"), F.substring(raw, 1, 2))).when(kind == "date", F.concat(F.lit("date:"), _day_group(_iso(raw)))).otherwise(kind)


def _radix(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 10).when(c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("long")


def _base(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).otherwise(65).cast("long")


def _places(chars: Column, span: Column) -> Column:
    """The places (from 0) of the characters that change."""
    at = F.transform(chars, lambda c, i: F.when((i >= span[0]) & (i <= span[1]) & (_radix(c) > 1), i))
    return F.filter(at, lambda i: i.isNotNull())


def _numbers(s: Column) -> Column:
    """(values, radices) of a validated match."""
    raw, kind, at = s["raw"], s["kind"], s["places"]
    chars = lambda f: F.transform(at, lambda i: f(F.get(s["chars"], i)))
    radices, values = chars(_radix), chars(lambda c: _ord(c) - _base(c))
    one, part = F.size(at) == 1, F.floor(F.get(radices, F.lit(0)) / 2)
    first, two = F.get(values, F.lit(0)), F.lit(2).cast("long")
    radices, values = F.when(one, F.array(two, part)).otherwise(radices), F.when(one, F.array(F.floor(first / part), first % part)).otherwise(values)
    many = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    area, group, serial = (F.substring(raw, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    social = F.array(area - F.when(area < 666, 1).otherwise(2), group - 1, serial - 1)
    group_values, group_radices = _group_numbers(_iso(raw))
    return F.struct(
        F.when(kind == "date", group_values).when(kind == "ssn", social).when(kind == "ip", F.transform(F.split(raw, r"\."), lambda o: o.cast("long"))).otherwise(values).alias("values"),
        F.when(kind == "date", group_radices).when(kind == "ssn", many(898, 99, 9999)).when(kind == "ip", many(256, 256, 256, 256)).otherwise(radices).alias("radices"),
    )


def feistel(values: Column, radices: Column, kind: Column, key: Column | str, invert: bool = False) -> Column:
    """A keyed permutation of arrays of numbers below their radices; ``invert`` undoes it."""
    key = F.lit(key) if isinstance(key, str) else key
    half = F.floor(F.size(values) / 2).cast("int")
    cut = lambda x: (F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.size(x) - half))
    low, high = cut(values)
    q_low, q_high = cut(radices)

    def shifted(part: Column, other: Column, radix: Column, number: Column) -> Column:
        seed = F.sha2(F.concat_ws(":", key, kind, F.size(values).cast("string"), number.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ",")), 512)
        amount = lambda i: F.conv(F.substr(seed, 1 + 4 * (i % 32), F.lit(4)), 16, 10).cast("long")
        sign = -1 if invert else 1
        return F.transform(part, lambda v, i: F.pmod(v + sign * amount(i), F.get(radix, i)))

    start = F.struct(low.alias("l"), high.alias("h"))
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))

    def step(a: Column, number: Column) -> Column:
        odd = number % 2 == 1
        return F.struct(
            F.when(odd, shifted(a["l"], a["h"], q_low, number)).otherwise(a["l"]).alias("l"),
            F.when(odd, a["h"]).otherwise(shifted(a["h"], a["l"], q_high, number)).alias("h"),
        )

    return F.aggregate(rounds, start, step, lambda a: F.concat(a["l"], a["h"]))


def _written(s: Column) -> Column:
    """The permuted numbers in the format of the match."""
    raw, kind, v, chars, at = s["raw"], s["kind"], s["values"], s["chars"], s["places"]
    alone = F.size(at) == 1
    new = lambda c, i: F.when(alone, v[0] * F.floor(_radix(c) / 2) + v[1]).otherwise(F.get(v, (F.array_position(at, i) - 1).cast("int")))
    text = F.array_join(F.transform(chars, lambda c, i: F.when(F.array_contains(at, i), F.char(_base(c) + new(c, i))).otherwise(c)), "")
    digits = F.regexp_replace(text, "[^0-9]", "")
    # the last digit is still the old one: replaced by 0, the sum tells the right one
    luhn = F.pmod(-_luhn_sum(F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))), F.lit(10))
    card = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), luhn.cast("string"))
    plain = F.regexp_replace(text, " ", "")
    check = 98 - _mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 2), F.lit("00")))
    iban = F.concat(F.substring(text, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(text, 5, 60))
    mark = F.substring(raw, 3, 1)
    day_first = ~_month_first(raw)
    day = _of_group(_day_group(_iso(raw)), v)
    date = (
        F.when(F.substring(raw, 5, 1) == "-", F.date_format(day, "yyyy-MM-dd"))
        .when(day_first, F.concat_ws("", F.date_format(day, "dd"), mark, F.date_format(day, "MM"), mark, F.date_format(day, "yyyy")))
        .otherwise(F.concat_ws("", F.date_format(day, "MM"), mark, F.date_format(day, "dd"), mark, F.date_format(day, "yyyy")))
    )
    number = lambda x, n: F.lpad(x.cast("string"), n, "0")
    ssn = F.concat_ws("-", number(v[0] + F.when(v[0] < 665, 1).otherwise(2), 3), number(v[1] + 1, 2), number(v[2] + 1, 4))
    ip = F.array_join(F.transform(v, lambda o: o.cast("string")), ".")
    return F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "ip", ip).otherwise(text)


def with_pseudonyms(docs: DataFrame, key: str, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``found``: (raw, kind, pseudonym) of each value, in order.

    Null texts stay null and, like texts without such values, have an empty list. Equal values have one pseudonym in
    all rows; repeated rows and other columns are kept as they are, an empty table stays empty. A column that has the
    new one's name is replaced. ``found`` has the old values: drop it where the result leaves safe ground.

    The key is the one row of a table that is joined to the rows, so that it stands in no plan, user interface or event log.
    """
    own = free_name(docs, "_key")
    secret = docs.sparkSession.createDataFrame([(key,)], f"`{own}` string")
    docs = docs.join(F.broadcast(secret), how="cross")  # one row
    names = [c for c in docs.columns if c not in (found, own)]
    # matches and what stands between them, by one pattern; most texts have no digit or sign that could begin one
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    nothing = F.array().cast("array<string>")
    work = docs.select(*names, own, F.when(may, F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(nothing).alias("_raw"))
    carried = lambda s, *names: [s[n].alias(n) for n in names]
    work = work.withColumn("_v", F.transform("_raw", lambda x: F.struct(x.alias("whole"), _head(x).alias("raw"))))
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, "whole", "raw"), _kind(s["raw"]).alias("kind"), F.split(s["raw"], "").alias("chars"))))
    keep = ["whole", "raw", "kind", "chars"]
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, *keep), _span(s["raw"], s["kind"]).alias("span"))))
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, *keep), _places(s["chars"], s["span"]).alias("places"))))
    keep.append("places")
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, *keep), F.when(s["kind"].isNotNull(), _numbers(s)).alias("n"))))
    dealt = lambda s: F.when(s["kind"].isNotNull(), feistel(s["n"]["values"], s["n"]["radices"], _tweak(s["raw"], s["kind"]), F.col(own)))
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, *keep), dealt(s).alias("values"))))
    work = work.withColumn("_v", F.transform("_v", lambda s: F.struct(*carried(s, "whole", "raw", "kind"), F.when(s["kind"].isNotNull(), _written(s)).otherwise(s["raw"]).alias("pseudonym"))))
    gaps = F.split(text, PATTERN, -1)
    new = F.array_join(F.zip_with(gaps, F.concat(F.transform("_v", lambda s: F.concat(s["pseudonym"], F.substr(s["whole"], F.length(s["raw"]) + 1))), F.array(F.lit(""))), lambda g, p: F.concat(g, p)), "")
    work = work.withColumn(text, F.when(F.size("_v") > 0, new).otherwise(F.col(text)))
    return work.select(*names, F.transform(F.filter("_v", lambda s: s["kind"].isNotNull()), lambda s: F.struct(*carried(s, "raw", "kind", "pseudonym"))).alias(found))


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_values, kinds, text) for each row: the text with pseudonyms, how many, and their kinds in order.

    Nulls, empty texts, repeated rows and empty tables are as in ``with_pseudonyms``.
    """
    done = with_pseudonyms(docs.select("doc_id", "text"), key)
    return done.select("doc_id", F.size("found").alias("n_values"), F.array_join(F.transform("found", lambda s: s["kind"]), ",").alias("kinds"), "text")
