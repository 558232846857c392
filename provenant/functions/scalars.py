"""Column functions: text, money, numbers, keys and hashes.

All are built from Spark's own functions but ``strip_text`` and ``nfc``: Spark has no HTML unescaping and no
Unicode normalisation, so these two run Arrow-batched UDFs, which hold a few texts at a time.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Money symbols in the order in which they are looked for, and their currencies.
SYMBOLS = (("£", "GBP"), ("€", "EUR"), ("$", "USD"), ("GBP", "GBP"), ("EUR", "EUR"), ("USD", "USD"), ("CHF", "CHF"))
# Spaces that don't break lines, and what Python's \s matches, in Java's notation.
NO_BREAK = "    ⁠"
SPACE_CLASS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
UNIT = "\x1f"


#: Texts that a worker holds as Python's at once; all else of a batch stays in Arrow's memory.
_PIECE = 64


def _each(change: Callable[[str], str | None]) -> Callable[[pa.Array], pa.Array]:
    """A batch with each text changed, nulls kept. Pieces of which nothing changes are the batch's own memory."""

    def texts_of(texts: pa.Array) -> pa.Array:
        parts, same = [], True
        for at in range(0, len(texts), _PIECE):
            part = texts.slice(at, _PIECE)
            old = part.to_pylist()
            new = [None if t is None else change(t) for t in old]
            parts.append(part if new == old else pa.array(new, texts.type))
            same = same and parts[-1] is part
        return texts if same else pa.concat_arrays(parts)

    return texts_of


_PLAIN = str.maketrans(dict.fromkeys(NO_BREAK, " "))
#: Entities resolved, NFKC, all runs of white space one space, trimmed; null if nothing is left.
strip_text = F.arrow_udf(_each(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(t)).translate(_PLAIN)).strip() or None), T.StringType())
_composed = F.arrow_udf(_each(lambda t: unicodedata.normalize("NFC", t)), T.StringType())


def nfc(x: Column) -> Column:
    """A text in NFC. Python sees only texts with a character from U+0300 on: those before neither change nor combine."""
    return F.coalesce(_composed(F.when(x.rlike(r"[^\x00-\x{2ff}]"), x)), x)


def _separated(x: Column) -> Column:
    """A number with '.' for the decimals: the rightmost separator is the decimal one, unless it stands alone with three digits after it."""
    comma, dot = F.instr(F.reverse(x), ","), F.instr(F.reverse(x), ".")
    single = lambda sign: (F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit(""))) == 1)
    drop = lambda c, sign: F.replace(c, F.lit(sign), F.lit(""))
    to_dot = lambda c: F.replace(c, F.lit(","), F.lit("."))
    return (
        F.when((comma > 0) & (dot > 0), F.when(comma < dot, to_dot(drop(x, "."))).otherwise(drop(x, ",")))
        .when(comma > 0, F.when(single(",") & (comma == 4), drop(x, ",")).otherwise(to_dot(x)))
        .when((dot == 4) & single("."), drop(x, "."))
        .otherwise(x)
    )


def parse_currency(x: Column) -> Column:
    """(amount, currency) of a price text, null where there is no symbol or no number."""
    currency = reduce(lambda c, s: c.when(x.contains(s[0]), s[1]), SYMBOLS[1:], F.when(x.contains(SYMBOLS[0][0]), SYMBOLS[0][1]))
    bare = reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit("")), SYMBOLS, x)
    bare = F.translate(bare, NO_BREAK + " '", "")
    # arrays of one, so that each step is computed once and generated code stays small
    number = F.transform(F.array(bare), _separated)
    amount = F.transform(number, lambda n: F.when(n.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), n.try_cast("decimal(38,18)")))[0]
    return F.when(currency.isNotNull() & amount.isNotNull(), F.struct(amount.alias("amount"), currency.alias("currency")))


def currency_from_symbol(money: Column) -> Column:
    return money.getField("currency")


def int_from_text(x: Column) -> Column:
    """The first whole number in a text, null if there is none."""
    return F.regexp_substr(x, F.lit("-?[0-9]+")).try_cast("bigint")


def sha256_slug(x: Column) -> Column:
    return F.sha2(nfc(x), 256)


def natural_key_16(x: Column) -> Column:
    """16 hex digits of a text's SHA-256 after white space, unit separators included, has been collapsed."""
    return F.substring(F.sha2(F.trim(F.regexp_replace(nfc(x), f"{SPACE_CLASS}+", " ")), 256), 1, 16)


def encode_natural_key(*parts: Column) -> Column:
    """One part as it is; several escaped and joined by pipes. Null if a part is null or blank."""
    clean = [F.regexp_replace(nfc(p.cast("string")), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "") for p in parts]
    there = reduce(lambda a, b: a & b, [F.coalesce(c != "", F.lit(False)) for c in clean])
    if len(clean) == 1:
        return F.when(there, clean[0])
    escaped = [F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for c in clean]
    return F.when(there, F.concat_ws("|", *escaped))


def decimal_token(x: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")


def json_string(x: Column) -> Column:
    """A JSON string, NFC, in which only what must be is escaped."""
    out = F.replace(F.replace(nfc(x), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    named = {"\n": "\\n", "\r": "\\r", "\t": "\\t"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(named.get(chr(code), f"\\u{code:04x}")))
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(fields: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Members in the byte order of their names, nulls left out; kinds: string, decimal, integer or boolean."""
    write = {"string": json_string, "decimal": decimal_token, "integer": lambda c: c.cast("string"), "boolean": lambda c: c.cast("string")}
    members = [F.concat(F.lit(f'"{name}":'), write[kinds[name]](fields[name])) for name in sorted(fields, key=str.encode)]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def payload_hash(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def round6(x: Column) -> Column:
    """Six decimals, half to even."""
    return F.bround(x, 6)


def json_value(x: Column, kind: str) -> Column:
    """A value as JSON text: numbers that are whole, booleans and texts as they are, all else (decimals, times) as a text; null for null."""
    if kind in ("integer", "boolean"):
        return x.cast("string")
    text = F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") if kind == "datetime" else x.cast("string")
    if kind == "datetime":
        text = F.regexp_replace(text, r"\.000000$", "")
    return json_string(text)


def json_safe(fields: dict[str, Column], kinds: dict[str, str]) -> Column:
    """A JSON object in the order of ``fields``, without those that are null."""
    members = [F.concat(json_string(F.lit(name)), F.lit(":"), json_value(c, kinds[name])) for name, c in fields.items()]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members)), ","), F.lit("}"))


def domain_of(url: Column) -> Column:
    """Lower-case host without port and user; null if there is none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def registrable_domain(url: Column) -> Column:
    return F.regexp_replace(F.coalesce(domain_of(url), F.lower(url)), r"^www\.", "")


def blob_key(url: Column, fetched_at: Column, digest: Column) -> Column:
    """raw/<domain>/<yyyy>/<mm>/<digest>.gz for a hex SHA-256; null for anything else."""
    return F.when(digest.rlike("^[0-9a-f]{64}$"), F.concat_ws("/", F.lit("raw"), domain_of(url), F.date_format(fetched_at, "yyyy"), F.date_format(fetched_at, "MM"), F.concat(digest, F.lit(".gz"))))


def safe_key(key: Column) -> Column:
    """Whether a key stays in its folder."""
    return ~key.rlike(r"^$|\\|^/|^[A-Za-z]:|(^|/)\.\.(/|$)")


def label_dirname(label: Column) -> Column:
    return F.replace(label, F.lit(":"), F.lit("__"))


def apply_transforms(x: Column, names: list[str]) -> Column:
    """Named functions, one after the other; an unknown name is an error."""
    return reduce(lambda c, name: TRANSFORMS[name](c), names, x)


TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "strip": strip_text,
    "nfc": nfc,
    "parse_currency": parse_currency,
    "currency_from_symbol": currency_from_symbol,
    "int_from_text": int_from_text,
    "sha256_slug": sha256_slug,
    "natural_key_16": natural_key_16,
}
#: What each takes and gives.
TRANSFORM_TYPES = {
    "strip": ("string", "string"),
    "nfc": ("string", "string"),
    "parse_currency": ("string", "money"),
    "currency_from_symbol": ("money", "string"),
    "int_from_text": ("string", "integer"),
    "sha256_slug": ("string", "string"),
    "natural_key_16": ("string", "string"),
}


def check_chain(names: list[str]) -> list[str]:
    """What is wrong with a chain of transforms: an unknown one ends the check."""
    kind, wrong = "string", []
    for name in names:
        if name not in TRANSFORM_TYPES:
            return [*wrong, f"unknown_transform:{name}"]
        takes, gives = TRANSFORM_TYPES[name]
        if takes != kind:
            wrong.append(f"transform_type_mismatch:{name}")
        kind = gives
    return wrong
