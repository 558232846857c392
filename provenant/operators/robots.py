"""Robots rules as an index of patterns: which URLs an agent may fetch.

A rule's path is an anchored pattern in which ``*`` stands for any characters and ``$`` at its end for the end. It is
cut into the literal text before its first ``*`` and the rest. Rules are joined with URLs by origin and that text, as the
beginnings of a URL's path of those lengths that its origin's rules have; what the join finds is then matched with the
rest of the pattern, piece by piece from left to right. The longest pattern that matches decides, and of two of one
length the allowing one.

Paths and patterns are compared in one form: escapes of printable ASCII are undone, other bytes are escaped in capitals.
``%2F``, ``%25``, ``%2A`` and ``%24`` stay escaped, as they differ from what they stand for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an origin's file comes to: its rules count, all is allowed, all is refused, or nobody can tell.
STATES = ("rules", "allow", "deny", "unavailable")
_PRODUCT = re.compile(r"[A-Za-z_-]+")


def origin(url: Column) -> Column:
    """Scheme and authority in lower case; null for what is no absolute URL."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)), F.lit(""))


def path(url: Column) -> Column:
    """Path and query, at least a slash, in the form that patterns are compared in."""
    raw = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return normalised(F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), raw)))


def normalised(text: Column, pattern: bool = False) -> Column:
    """A path in the form of comparison; a pattern keeps its ``*`` and a ``$`` at its end."""
    special = "%/" if pattern else "%*$/"

    def one(token: Column) -> Column:
        code = F.conv(F.substring(token, 2, 2), 16, 10).cast("int")
        escaped = F.regexp_replace(F.hex(F.encode(token, "UTF-8")), "(..)", "%$1")
        stays = code.between(0x21, 0x7E) & ~code.isin(*map(ord, "%*$/"))
        literal = token.rlike(r"^[\x21-\x7E]$") & ~token.isin(*(c for c in special if c != "/"))
        return F.when(F.length(token) == 3, F.when(stays, F.char(code)).otherwise(F.upper(token))).when(literal, token).otherwise(escaped)

    each = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)%[0-9A-Fa-f]{2}|."), F.lit(0)), one), "")
    if pattern:  # a $ elsewhere is a character
        each = F.concat(F.replace(F.substring(each, F.lit(1), F.length(each) - 1), F.lit("$"), F.lit("%24")), F.right(each, F.lit(1)))
    return F.when(text.rlike(r"[%*$]|[^\x21-\x7E]"), each).otherwise(text)


def _parsed(body: str, product: str) -> tuple[list[tuple[bool, str, str]], float | None]:
    """(allow, path, line) of the rules for a product, and its delay; sections that name it go before those of ``*``."""
    rules: dict[bool, list[tuple[bool, str, str]]] = {True: [], False: []}
    delays: dict[bool, float] = {}
    named, kinds, in_rules = False, set(), False
    for line in body.removeprefix("﻿").splitlines():
        name, colon, value = (x.strip() for x in line.split("#")[0].partition(":"))
        name = name.lower()
        if not colon:
            continue
        if name == "user-agent":
            kinds, in_rules = (set() if in_rules else kinds), False
            if value == "*":
                kinds.add(False)
            elif (m := _PRODUCT.match(value)) and m[0].lower() == product:
                kinds.add(True)
                named = True
            continue
        if name in ("allow", "disallow"):
            in_rules = True
            if value:
                value = value if value[0] in "/*" else f"/{value}"
                for kind in kinds:
                    rules[kind].append((name == "allow", value, line.strip()))
        elif name == "crawl-delay":
            in_rules = True
            if re.fullmatch(r"\d+(\.\d*)?|\.\d+", value):
                for kind in kinds:
                    delays.setdefault(kind, float(value))
    return rules[named], delays.get(named)


def policies(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, state, crawl_delay, rules) for ``robots`` (origin, http_status, body): a row for each origin.

    A file that is missing (404, 410) allows all; 500 and above, and no status, make the origin unavailable; any other
    status but success refuses all. ``rules`` is an array of (allow, path, line). Of several rows of an origin
    that counts whose state is last in ``STATES``, and of equal ones that with the least body. A null body is an empty
    one, which allows all.
    """
    product = (_PRODUCT.match(agent) or [""])[0].lower()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for where, state, body in zip(frame.origin, frame.state, frame.body, strict=True):
                rules, delay = _parsed(body or "", product) if state == "rules" else ([], None)
                out.append((where, state, delay, [{"allow": a, "path": p, "line": x} for a, p, x in rules]))
            yield pd.DataFrame(out, columns=["origin", "state", "crawl_delay", "rules"])

    status = F.col("http_status")
    state = F.when(status.isin(404, 410), "allow").when(status.isNull() | (status >= 500), "unavailable").when(status.between(200, 299), "rules").otherwise("deny")
    rank = F.array_position(F.array(*map(F.lit, STATES)), state)
    one = robots.groupBy(F.lower("origin").alias("origin")).agg(F.min(F.struct((-rank).alias("r"), F.coalesce("body", F.lit("")).alias("body"), state.alias("state"))).alias("o"))
    return one.select("origin", "o.state", "o.body").mapInPandas(run, "origin string, state string, crawl_delay double, rules array<struct<allow:boolean,path:string,line:string>>")


def pattern_index(policy: DataFrame) -> DataFrame:
    """(origin, prefix, rest, ends, size, allow, line): the rules of ``policies`` as patterns.

    ``rest`` has the pieces after the first ``*``, ``ends`` tells whether the pattern ends with ``$``, and ``size`` is its length.
    """
    rules = policy.filter("state = 'rules'").select("origin", F.explode("rules").alias("rule")).select("origin", "rule.allow", "rule.line", normalised(F.col("rule.path"), pattern=True).alias("pattern"))
    ends = F.col("pattern").endswith("$")
    body = F.when(ends, F.substring("pattern", F.lit(1), F.length("pattern") - 1)).otherwise(F.col("pattern"))
    pieces = F.split(body, r"\*")
    return rules.select("origin", pieces[0].alias("prefix"), F.slice(pieces, 2, F.size(pieces)).alias("rest"), ends.alias("ends"), F.length("pattern").alias("size"), "allow", "line").distinct()


def _matches(text: Column, prefix: Column, rest: Column, ends: Column) -> Column:
    """Whether a path that begins with ``prefix`` matches what comes after it: each piece at its first place, the last one at the end."""
    at = F.length(prefix) + 1
    inner = F.when(ends, F.slice(rest, 1, F.size(rest) - 1)).otherwise(rest)
    found = lambda p, piece: F.position(piece, text, p)
    after = F.aggregate(F.filter(inner, lambda x: x != ""), at, lambda p, piece: F.when((p == 0) | (found(p, piece) == 0), 0).otherwise(found(p, piece) + F.length(piece)))
    last = F.element_at(rest, -1)
    to_end = text.endswith(last) & (F.length(text) - F.length(last) + 1 >= after)
    return F.when(F.size(rest) == 0, ~ends | (F.length(text) == F.length(prefix))).otherwise((after > 0) & (~ends | to_end))


def decisions(urls: DataFrame, policy: DataFrame) -> DataFrame:
    """(url, decision, allowed, line, crawl_delay): a row for each distinct ``url`` of ``urls``.

    ``decision`` is ``allowed``, ``disallowed``, ``unavailable``, or ``unknown`` for an origin that has no policy and for what is no
    URL; only the first may be fetched. ``line`` is the rule that decided, or null. Rows of an origin with very many URLs
    meet its few rules in joins that adaptive execution splits; the decision is a partial aggregate.
    """
    each = urls.select("url").distinct().select("url", origin(F.col("url")).alias("origin"), path(F.col("url")).alias("path"))
    index = pattern_index(policy)
    lengths = index.groupBy("origin").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    known = each.join(policy.select("origin", "state", "crawl_delay"), "origin", "left")
    ruled = known.filter("state = 'rules'").join(lengths, "origin")
    starts = ruled.select("url", "origin", "path", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n")).withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).drop("n")
    found = starts.join(index, ["origin", "prefix"]).filter(_matches(F.col("path"), F.col("prefix"), F.col("rest"), F.col("ends")))
    best = found.groupBy("url").agg(F.max(F.struct("size", "allow", "line")).alias("best")).select("url", "best.allow", "best.line")
    decided = F.when(F.col("state").isNull(), "unknown").when(F.col("state") == "unavailable", "unavailable").when((F.col("state") == "deny") | ~F.coalesce("allow", F.lit(True)), "disallowed").otherwise("allowed")
    out = known.join(best, "url", "left").withColumn("decision", decided)
    return out.select("url", "decision", (F.col("decision") == "allowed").alias("allowed"), "line", "crawl_delay")


def admissions(entries: DataFrame, policy: DataFrame) -> DataFrame:
    """(label, url, admitted, reason): a verdict for each source of ``entries`` (label, seq, url), its entry URLs.

    A source is admitted if all its entry URLs may be fetched. The verdict names the first that may not, by ``seq``, with
    the rule that says so, else the first of all. A source whose only entry is null is not admitted.
    """
    j = entries.join(decisions(entries.filter("url is not null"), policy), "url", "left").join(policy.select("origin", "state"), F.col("origin") == origin(F.col("url")), "left")
    decision = F.coalesce("decision", F.lit("unknown"))
    reason = F.when(decision == "disallowed", F.concat_ws(": ", F.lit("disallowed"), "line")).when((decision == "allowed") & (F.col("state") == "allow"), "allowed (no robots file)").otherwise(decision)
    first = F.min(F.struct((decision == "allowed").alias("ok"), "seq", "url", reason.alias("reason")))
    return j.groupBy("label").agg(first.alias("v")).select("label", "v.url", F.col("v.ok").alias("admitted"), "v.reason")
