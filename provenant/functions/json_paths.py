"""Paths into JSON as expressions over VARIANT: names, ``[n]`` and ``[*]``, with or without a leading ``$``."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.?([\w-]+)|\[(\d+|\*)\]")


def _steps(path: str) -> list[str]:
    """Parts of a path between its ``[*]``, each as a path of its own."""
    path = path.removeprefix("$")
    if "".join(m[0] for m in _STEP.finditer(path)) != path:
        raise ValueError(f"path {path!r}")
    out = ["$"]
    for name, number in _STEP.findall(path):
        if number == "*":
            out.append("$")
        else:
            out[-1] += f'["{name}"]' if name else f"[{number}]"
    return out


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _items(value: Column, path: str = "$") -> Column:
    """The elements of an array at a path; none if there is no array."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _at(get: Callable[[Column, str], Column], path: str) -> Callable[[Column], Column]:
    return lambda x: get(x, path)


def matches(value: Column, path: str) -> Column:
    """All matches of a path in a variant, in order: array<variant>."""
    first, *more = _steps(path)
    if not more:
        return F.array_compact(F.array(_get(value, first)))
    out = _items(value, first)
    for k, step in enumerate(more):
        if k < len(more) - 1:
            out = F.flatten(F.transform(out, _at(_items, step)))
        else:
            out = F.filter(F.transform(out, _at(_get, step)), lambda x: x.isNotNull()) if step != "$" else out
    return out


def text(value: Column) -> Column:
    """A string as it is, null as null, anything else as JSON."""
    return F.try_variant_get(value, "$", "string")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def field(row: Column, path: str) -> Column:
    """One match as text, several as a JSON list, none as null."""
    found = matches(row, path)
    if "*" not in path:
        return text(_get(row, _steps(path)[0]))
    listed = F.concat(F.lit("["), F.array_join(F.transform(found, lambda x: F.to_json(x)), ","), F.lit("]"))
    return F.when(F.size(found) == 1, text(found[0])).when(F.size(found) > 1, listed)


def rows(value: Column, root: str, fields: dict[str, str]) -> Column:
    """array<map<string,string>>: a row for each object among the matches of ``root``; a single match that is a list has its elements as rows."""
    found = matches(value, root)
    found = F.when(F.size(found) == 1, F.coalesce(F.try_variant_get(found[0], "$", "array<variant>"), found)).otherwise(found)
    objects = F.filter(F.coalesce(found, F.array().cast("array<variant>")), is_object)
    return F.transform(objects, lambda x: mapped(x, fields))


def mapped(row: Column, fields: dict[str, str]) -> Column:
    return F.create_map(*[c for name, path in fields.items() for c in (F.lit(name), field(row, path))])


def first_of_type(documents: Column, kind: str) -> Column:
    """Of an array of JSON texts the first object whose ``@type`` is ``kind``; texts that are no JSON are passed over.

    Arrays and ``@graph`` lists are opened in document order, level by level, but not inside an object that is the one
    looked for. A text has no more levels than opening brackets, and when nothing is left to open no level does anything.
    """
    is_it = lambda x: F.coalesce(F.try_variant_get(x, '$["@type"]', "string") == F.lit(kind), F.lit(False))
    inside = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.try_variant_get(x, '$["@graph"]', "array<variant>"))
    opens = lambda x: inside(x).isNotNull() & ~is_it(x)
    parsed = F.filter(F.transform(documents, F.try_parse_json), lambda x: x.isNotNull())
    levels = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(documents, lambda t: F.length(t) - F.length(F.replace(t, F.lit("["), F.lit(""))))), F.lit(0)))
    level = lambda found, _: F.when(F.exists(found, opens), F.flatten(F.transform(found, lambda x: F.when(opens(x), inside(x)).otherwise(F.array(x))))).otherwise(found)
    return F.get(F.filter(F.aggregate(F.sequence(F.lit(1), levels), parsed, level), is_it), F.lit(0))
