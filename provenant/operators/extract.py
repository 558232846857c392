"""Extraction of rows from pages: each source makes rows of raw texts, the chain merges sources field by field."""

from __future__ import annotations

from functools import reduce
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenant.functions import json_paths, markup
from provenant.functions.scalars import UNIT, apply_transforms

_KINDS = {
    markup.Rows: ("array<map<string,string>>", pa.list_(pa.map_(pa.string(), pa.string()))),
    markup.Custom: ("array<map<string,string>>", pa.list_(pa.map_(pa.string(), pa.string()))),
    markup.Texts: ("array<string>", pa.list_(pa.string())),
    markup.Values: ("array<string>", pa.list_(pa.string())),
    markup.Facts: ("struct<title:string,visible:int,consent:boolean,matches:array<string>>", pa.struct([("title", pa.string()), ("visible", pa.int32()), ("consent", pa.bool_()), ("matches", pa.list_(pa.string()))])),
}


def scanned(pages: DataFrame, asks: dict[str, markup.Ask], html: str = "html") -> DataFrame:
    """``pages`` with a column for each of ``asks``; a page is read once for all of them. A null page is an empty one."""
    scan = markup.Scan(list(asks.values()))
    kinds = [_KINDS[type(a)] for a in asks.values()]

    @F.arrow_udf("struct<" + ",".join(f"c{i}:{kind}" for i, (kind, _) in enumerate(kinds)) + ">")
    def run(page: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in kinds]
        for x in page:
            for column, ask, got in zip(columns, scan.asks, scan(x.as_py()), strict=True):
                column.append([[(k, None if v is None else str(v)) for k, v in r.items()] for r in got] if isinstance(ask, markup.Rows | markup.Custom) else got)
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[f"c{i}" for i in range(len(kinds))])

    return pages.withColumn("_scan", run(html)).withColumns({name: F.col(f"_scan.c{i}") for i, name in enumerate(asks)}).drop("_scan")


def css(pages: DataFrame, fields: dict[str, str], row_selector: str | None = None, html: str = "html", to: str = "rows") -> DataFrame:
    """A row for each match of ``row_selector``, or one for the page; a field is ``selector`` or ``selector@attribute``."""
    return scanned(pages, {to: markup.Rows(fields, row_selector)}, html)


LINKED = markup.Texts('script[type="application/ld+json"]')


def linked_rows(scripts: Column, kind: str, fields: dict[str, str]) -> Column:
    """At most one row from the texts of JSON-LD scripts: the first object of a type."""
    found = json_paths.first_of_type(scripts, kind)
    return F.transform(F.filter(F.array(found), lambda x: x.isNotNull()), lambda x: json_paths.mapped(x, fields))


def linked_data(pages: DataFrame, kind: str, fields: dict[str, str], html: str = "html", to: str = "rows") -> DataFrame:
    """At most one row: the first JSON-LD object of a type."""
    return scanned(pages, {"_linked": LINKED}, html).withColumn(to, linked_rows(F.col("_linked"), kind, fields)).drop("_linked")


def script_ask(script_id: str | None, variable: str | None) -> markup.Ask:
    """The texts that an embedded source reads: a script with an id, or all scripts."""
    if (script_id is None) == (variable is None):
        raise ValueError("exactly one of script_id and variable")
    return markup.Texts(f"script#{script_id}" if script_id else "script")


def script_rows(scripts: Column, fields: dict[str, str], root: str = "$", variable: str | None = None) -> Column:
    """Rows from the first script's JSON, none if there is no script; with ``variable`` from what is assigned to it, which must be there."""
    if variable is None:
        return F.when(F.size(scripts) == 0, F.array().cast("array<map<string,string>>")).otherwise(json_paths.rows(F.parse_json(F.get(scripts, F.lit(0))), root, fields))

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([markup.assigned(x.as_py() or [], variable) for x in texts], pa.string())

    text = cut(scripts)
    return json_paths.rows(F.parse_json(F.coalesce(text, F.raise_error(F.lit(f"no variable {variable}")).cast("string"))), root, fields)


def embedded_json(pages: DataFrame, fields: dict[str, str], root: str = "$", script_id: str | None = None, variable: str | None = None, html: str = "html", to: str = "rows") -> DataFrame:
    """Rows from JSON in a script with an id (none if there is no such script) or a variable (an error if there is none)."""
    return scanned(pages, {"_scripts": script_ask(script_id, variable)}, html).withColumn(to, script_rows(F.col("_scripts"), fields, root, variable)).drop("_scripts")


def json_responses(pages: DataFrame, responses: DataFrame, endpoint: Column, fields: dict[str, str], root: str, url: str = "url", to: str = "rows") -> DataFrame:
    """Rows from the JSON responses of each page's ``endpoint``; refused, failed and other answers give none."""
    from provenant.operators.responses import is_json

    good = responses.filter((F.col("http_status") == 200) & is_json(F.col("content_type"))).select(F.col("url").alias("_endpoint"), F.col("body").alias("_body"))
    j = pages.withColumn("_endpoint", endpoint).join(good, "_endpoint", "left")
    return j.withColumn(to, json_paths.rows(F.try_parse_json("_body"), root, fields)).drop("_endpoint", "_body")


def endpoint(url: Column, template: str, params: dict[str, str] | None = None) -> Column:
    """A template's ``{name}`` from the page URL's query, and further parameters, encoded."""
    import re

    out = F.lit(template)
    for name in re.findall(r"{(\w+)}", template):
        out = F.replace(out, F.lit(f"{{{name}}}"), F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit("")))
    if params:
        query = F.concat_ws("&", *[F.concat(F.url_encode(F.lit(k)), F.lit("="), F.url_encode(F.lit(v))) for k, v in params.items()])
        out = F.concat(out, F.when(out.contains("?"), "&").otherwise("?"), query)
    return out


def one_row_each(pages: DataFrame, sources: list[str], keep: list[str], every: bool = True) -> DataFrame:
    """A row for each row of the first source that has any (or only its first), with the other sources' rows of the same number beside it."""
    count = F.coalesce(*[F.nullif(F.size(s), F.lit(0)) for s in sources], F.lit(0))
    numbers = F.sequence(F.lit(0), count - 1) if every else F.array(F.lit(0))
    out = pages.withColumn("row_ix", F.explode(F.when(count > 0, numbers).otherwise(F.array().cast("array<int>"))))
    return out.select(*keep, "row_ix", *[F.get(s, F.col("row_ix")).alias(s) for s in sources])


def chain(rows: DataFrame, sources: list[str], fields: dict[str, list[str]], keep: list[str]) -> DataFrame:
    """Each field from the first source with something in it, after the field's transforms, and where it came from.

    ``fields`` has the transforms of each field, ``sources`` are map columns in the order of priority.
    """
    out: list[Column] = []
    for name, transforms in fields.items():
        values = [apply_transforms(F.col(s)[name], transforms) for s in sources]
        there = [v.isNotNull() & (v.cast("string") != "") if "parse_currency" not in transforms else v.isNotNull() for v in values]
        first = reduce(lambda c, x: c.when(x[0], x[1]), zip(there[1:], values[1:], strict=True), F.when(there[0], values[0]))
        source = reduce(lambda c, x: c.when(x[0], x[1]), zip(there[1:], sources[1:], strict=True), F.when(there[0], sources[0]))
        out += [first.alias(name), source.alias(f"{name}_source")]
    return rows.select(*keep, *out)


def derived(parts: list[Column], transform: str) -> Column:
    """A field made from others: one part as it is, several joined by unit separators."""
    return apply_transforms(parts[0] if len(parts) == 1 else F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), [transform])


@F.arrow_udf(T.ArrayType(T.StringType()))
def _joined(url: pa.Array, found: pa.Array) -> pa.Array:
    return pa.array([[urljoin(u.as_py() or "", h) for h in x.as_py() or []] for u, x in zip(url, found, strict=True)], pa.list_(pa.string()))


def with_links(pages: DataFrame, selector: str, to: str = "links", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the absolute links of each, in its order."""
    return scanned(pages, {"_hrefs": markup.Values(selector, "href")}, html).withColumn(to, _joined(url, "_hrefs")).drop("_hrefs")
