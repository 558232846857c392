"""Row validation as one projection: typed columns, and an array of reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenant.operators.contract import TYPES, Contract, Field

# Words that count as booleans.
_TRUE, _FALSE = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


def empty(c: Column) -> Column:
    return c.isNull() | (c.cast("string") == "")


def lax_cast(c: Column, kind: str) -> Column:
    """A text as a field's type; null where it can't be. Whole numbers may have a zero fraction."""
    if kind == "string":
        return c.cast("string")
    text = F.trim(c.cast("string"))
    if kind == "integer":
        return F.when(text.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_replace(text, r"\..*$", "").try_cast("bigint"))
    if kind == "decimal":
        return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("decimal(38,18)"))
    if kind == "boolean":
        return F.when(F.lower(text).isin(*_TRUE), True).when(F.lower(text).isin(*_FALSE), False)
    return F.when(text.rlike("^-?[0-9]+$"), F.timestamp_seconds(text.try_cast("bigint"))).otherwise(text.try_cast(TYPES[kind]))


def validate(rows: DataFrame, contract: Contract) -> DataFrame:
    """``rows`` with ``accepted``, ``reasons`` and, for each field, a typed column ``<field>_typed``.

    A missing natural key rejects at once; then every field that can't be cast does, with a reason each. Where all
    can be cast, the first text field, in the contract's order, whose pattern fails does, with the one reason. Values out
    of range or enum are reasons that don't reject. Patterns hold from the start of a value.
    """
    missing = reduce(lambda a, b: a | b, [empty(F.col(k)) for k in contract.natural_key])
    typed = {f.name: F.when(~empty(F.col(f.name)), lax_cast(F.col(f.name), f.type)) for f in contract.fields}

    def bad(f: Field) -> Column:
        return F.when(~empty(F.col(f.name)) & typed[f.name].isNull(), F.lit(f"type_error:{f.name}"))

    def unlike(f: Field) -> Column:
        return F.when(~typed[f.name].cast("string").rlike(f"^(?:{f.pattern})"), F.lit(f"type_error:{f.name}"))

    def soft(f: Field) -> list[Column]:
        out = []
        if f.low is not None or f.high is not None:
            out.append(F.when(out_of_range(typed[f.name], f), F.lit(f"range_violation:{f.name}")))
        if f.enum:
            out.append(F.when(~typed[f.name].isin(*f.enum), F.lit(f"enum_violation:{f.name}")))
        return out

    casts = F.array_compact(F.array(*[bad(f) for f in contract.fields]))
    pattern = F.coalesce(*[unlike(f) for f in contract.fields if f.pattern and f.type == "string"], F.lit(None).cast("string"))
    hard = F.when(F.size(casts) > 0, casts).when(pattern.isNotNull(), F.array(pattern)).otherwise(F.array().cast("array<string>"))
    gentle = [c for f in contract.fields for c in soft(f)]
    gentle = F.array_compact(F.array(*gentle)) if gentle else F.array().cast("array<string>")
    reasons = F.when(missing, F.array(F.lit("natural_key_missing"))).when(F.size(hard) > 0, hard).otherwise(gentle)
    out = rows.withColumns({"reasons": reasons, "accepted": ~missing & (F.size(hard) == 0)})
    return out.withColumns({f"{name}_typed": c for name, c in typed.items()})


def out_of_range(value: Column, f: Field) -> Column:
    """Strictly outside; as doubles. Null is not."""
    x = value.cast("double")
    outside = F.lit(False)
    if f.low is not None:
        outside = outside | (x < f.low)
    if f.high is not None:
        outside = outside | (x > f.high)
    return F.coalesce(outside, F.lit(False))


def reject_histogram(validated: DataFrame) -> DataFrame:
    """How often each reason rejected a row."""
    return validated.filter(~F.col("accepted")).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
