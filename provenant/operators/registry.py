"""Extension points: transforms and sources of rows that a user registers by name, for packs to use.

A transform is a function from column to column with the types that it takes and gives. A source is a Python UDTF that
is polymorphic: its ``analyze`` says, from the source's declaration, which fields its rows have, and ``eval`` gives rows for
a page. It is registered with the session, and each page is joined with its own rows.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType
from pyspark.sql.udtf import AnalyzeArgument

from provenant.functions import markup
from provenant.functions.scalars import TRANSFORM_TYPES, TRANSFORMS

#: Kinds of sources that a pack may name but nobody has registered.
STUBS = ("api", "llm", "xhr")
_BUILT_IN = ("css", "jsonld", "embedded_json")
_SOURCES: dict[str, type] = {}


def transform(name: str, takes: str = "string", gives: str = "string") -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    """Registers a function from column to column as a transform of packs; the last one of a name counts."""

    def register(function: Callable[[Column], Column]) -> Callable[[Column], Column]:
        TRANSFORMS[name], TRANSFORM_TYPES[name] = function, (takes, gives)
        return function

    return register


def source(kind: str) -> Callable[[type], type]:
    """Registers a UDTF class as a kind of source; the last one of a kind counts.

    It has ``analyze(page, declaration)``, a static method whose result's schema names the fields (all strings), and ``eval(page,
    declaration)``; ``page`` is the markup, ``declaration`` the source's part of the pack as JSON, a constant.
    """
    if kind in _BUILT_IN:
        raise ValueError(f"{kind} is built in")

    def register(handler: type) -> type:
        for needed in ("analyze", "eval"):
            if not callable(getattr(handler, needed, None)):
                raise ValueError(f"source {kind} has no {needed}")
        if not isinstance(inspect.getattr_static(handler, "analyze"), staticmethod):
            raise ValueError(f"source {kind}: analyze must be static")
        _SOURCES[kind] = handler
        return handler

    return register


def known(kind: str) -> bool:
    return kind in _BUILT_IN or kind in _SOURCES


def _handler(kind: str) -> type:
    if kind in _SOURCES:
        return _SOURCES[kind]
    if kind in STUBS:
        raise NotImplementedError(f"source {kind}")
    raise LookupError(f"no source {kind}")


def fields(declared: dict[str, Any]) -> list[str]:
    """The names of a registered source's fields, as its ``analyze`` gives them for this declaration."""
    arguments = [AnalyzeArgument(StringType(), None, False, False), AnalyzeArgument(StringType(), json.dumps(declared, sort_keys=True), False, True)]
    return _handler(declared["kind"]).analyze(*arguments).schema.names


def ask(declared: dict[str, Any], name: str) -> dict[str, markup.Ask]:
    """A registered source as something that is asked of a page, beside other sources and in the same pass over the pages."""
    handler, names, declaration = _handler(declared["kind"]), fields(declared), json.dumps(declared, sort_keys=True)

    def rows(page: str) -> list[dict[str, object]]:
        return [dict(zip(names, row, strict=True)) for row in handler().eval(page, declaration) or ()]

    return {name: markup.Custom(rows)}


def joined(pages: DataFrame, declared: dict[str, Any], html: str = "html") -> DataFrame:
    """``pages`` with the columns of a registered source's rows, a row for each; pages without rows go.

    The source is a table function of the session, ``source_<kind>``, which SQL can use, too.
    """
    spark, name = pages.sparkSession, f"source_{declared['kind']}"
    spark.udtf.register(name, udtf(_handler(declared["kind"])))
    return spark.sql(f"SELECT p.*, r.* FROM {{pages}} p, LATERAL {name}(p.`{html}`, :declared) r", args={"declared": json.dumps(declared, sort_keys=True)}, pages=pages)
