"""Cells of mixed kinds: columns of Spark's VARIANT type, whose cells keep the kind they were given.

A cell is a whole number, a float, a text, a truth value, a list, a dictionary or missing (SQL null). Operators look at
the kinds of both cells when rows are read and stay inside generated code; a pair of kinds that an operator doesn't know
is an error then. VARIANT has neither order nor hash in Spark, so grouping goes by `key`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANT = "variant"
#: Nested lists are compared and shown item by item down to this depth, by their JSON text below it.
DEPTH = 1
_KINDS = {"BIGINT": "int", "DOUBLE": "float", "FLOAT": "float", "STRING": "string", "BOOLEAN": "bool", "VOID": "null"}


def cells(*values: Any) -> Mixed:
    """A literal column whose values keep their kinds, even if all are numbers: `Grid.table(spark, a=cells(1, 2.5, "x"))`."""
    return Mixed(values)


class Mixed(list):
    """Values of a literal column of mixed kinds."""


def literal(value: Any) -> str | None:
    """A cell as text for `from_literals`: JSON, with floats always in exponent form, so that they stay floats."""
    if value is None or isinstance(value, (bool, int, str)):
        return None if value is None else json.dumps(value)
    if isinstance(value, float):
        if value != value or abs(value) == float("inf"):
            return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(value)]
        return repr(value) if "e" in repr(value) else f"{value!r}e0"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join("null" if x is None else literal(x) for x in value) + "]"
    return "{" + ",".join(f"{json.dumps(str(k))}:{'null' if v is None else literal(v)}" for k, v in value.items()) + "}"


def from_literals(c: Column) -> Column:
    odd = c.isin("NaN", "Infinity", "-Infinity")
    return F.when(odd, F.when(odd, c).cast("double").cast(VARIANT)).otherwise(F.parse_json(F.when(~odd, c)))


def of(c: Column, kind: str) -> Column:
    """A typed column as cells."""
    if kind == VARIANT:
        return c
    return F.to_variant_object(c) if kind.startswith(("map", "struct")) else c.cast("bigint").cast(VARIANT) if kind in ("int", "smallint", "tinyint") else c.cast(VARIANT)


def kind_of(c: Column) -> Column:
    """int, float, string, bool, list, dict or null."""
    schema = F.schema_of_variant(c)
    found = F.when(c.isNull(), "null")
    for name, kind in _KINDS.items():
        found = found.when(schema == name, kind)
    return found.when(schema.startswith("DECIMAL"), "float").when(schema.startswith("ARRAY"), "list").otherwise("dict")


def as_int(c: Column) -> Column:
    return F.try_variant_get(c, "$", "bigint")


def as_float(c: Column) -> Column:
    return F.try_variant_get(c, "$", "double")


def as_text(c: Column) -> Column:
    return F.try_variant_get(c, "$", "string")


def as_bool(c: Column) -> Column:
    return F.try_variant_get(c, "$", "boolean")


def as_items(c: Column) -> Column:
    return F.try_variant_get(c, "$", "array<variant>")


def number(kind: Column) -> Column:
    return kind.isin("int", "float")


def _failed(code: str, what: str, a: Column, b: Column, kind: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"{code}: {what} isn't defined on "), a, F.lit(" and "), b)).cast(kind)


def equal(a: Column, b: Column, depth: int = DEPTH) -> Column:
    """Numbers across kinds by their float values, two whole numbers exactly; null equals null, NaN nothing; else one kind."""
    ka, kb = kind_of(a), kind_of(b)
    fa, fb = as_float(a), as_float(b)
    same = F.when((ka == "int") & (kb == "int"), as_int(a) == as_int(b))
    same = same.when(number(ka) & number(kb), (fa == fb) & ~F.isnan(fa)).when(ka != kb, False).when(ka == "null", True)
    same = same.when(ka == "string", as_text(a) == as_text(b)).when(ka == "bool", as_bool(a) == as_bool(b))
    if depth:
        x, y = as_items(a), as_items(b)
        items = F.forall(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: equal(p["x"], p["y"], depth - 1))
        same = same.when(ka == "list", (F.size(x) == F.size(y)) & items)
    return F.coalesce(same.otherwise(F.to_json(a) == F.to_json(b)), F.lit(False))


def key(c: Column) -> Column:
    """A text that is equal for equal scalars. Beyond 2^53, where equality by floats isn't transitive, numbers go by their exact value."""
    kind, f = kind_of(c), as_float(c)
    whole = (f == F.rint(f)) & (F.abs(f) < float(1 << 63))
    shown = F.when(kind == "int", as_int(c).cast("string")).when(kind == "float", F.when(whole, F.when(whole, f).cast("bigint").cast("string")).otherwise(f.cast("string")))
    tag = F.when(number(kind), "n").otherwise(kind)
    text = shown.when(kind == "string", as_text(c)).when(kind == "bool", as_bool(c).cast("string")).when(kind == "null", "").otherwise(F.to_json(c))
    return F.concat(tag, F.lit(":"), text)


def truthy(c: Column) -> Column:
    """Zero, empty and missing are false."""
    kind = kind_of(c)
    found = F.when(kind == "bool", as_bool(c)).when(number(kind), as_float(c) != 0).when(kind == "string", as_text(c) != "")
    return F.coalesce(found.when(kind == "list", F.size(as_items(c)) > 0).when(kind == "dict", F.to_json(c) != "{}"), F.lit(False))


def text_of(c: Column, depth: int = DEPTH) -> Column:
    from .values import text_of as typed

    kind = kind_of(c)
    shown = F.when(kind == "int", as_int(c).cast("string")).when(kind == "float", typed(as_float(c), "double")).when(kind == "string", as_text(c))
    shown = shown.when(kind == "bool", as_bool(c).cast("string")).when(kind == "null", "None")
    if depth:
        inside = F.array_join(F.transform(as_items(c), lambda x: text_of(x, depth - 1)), ",")
        shown = shown.when(kind == "list", F.concat(F.lit("["), inside, F.lit("]")))
    return shown.otherwise(F.to_json(c))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """`+ - *` of two cells, by their kinds: whole numbers wrap, a float makes both floats, text is joined or repeated."""
    from .values import arithmetic as typed

    ka, kb = kind_of(a), kind_of(b)
    found = F.when((ka == "int") & (kb == "int"), typed(op, as_int(a), as_int(b), ("bigint", "bigint")).cast(VARIANT))
    found = found.when(number(ka) & number(kb), typed(op, as_float(a), as_float(b), ("double", "double")).cast(VARIANT))
    if op == "+":
        found = found.when((ka == "string") | (kb == "string"), F.concat(text_of(a), text_of(b)).cast(VARIANT))
    if op == "*":
        for x, y, one, two in ((a, b, ka, kb), (b, a, kb, ka)):
            repeated = typed(op, as_text(x), F.when(two == "int", as_int(y)), ("string", "bigint"))
            found = found.when((one == "string") & (two == "int"), repeated.cast(VARIANT))
    return found.otherwise(_failed("E105", op, ka, kb, VARIANT))


def compare(op: str, a: Column, b: Column) -> Column:
    """`< <= > >=` of two numbers as floats or two texts by bytes; other kinds have no order."""
    from .values import compare as typed

    ka, kb = kind_of(a), kind_of(b)
    found = F.when(number(ka) & number(kb), typed(op, as_float(a), as_float(b), ("double", "double")))
    found = found.when((ka == "string") & (kb == "string"), typed(op, as_text(a), as_text(b), ("string", "string")))
    return found.otherwise(_failed("E110", op, ka, kb, "boolean"))


def converted(c: Column, to: Any, kinds: Sequence[str] = ("bigint", "double", "boolean", "string")) -> Column:
    """`to(column, kind)` of the cell by its kind; lists, dictionaries and missing cells can't be converted."""
    kind = kind_of(c)
    found = F.when(kind == "int", to(as_int(c), kinds[0])).when(kind == "float", to(as_float(c), kinds[1])).when(kind == "bool", to(as_bool(c), kinds[2]))
    text = to(F.when(kind == "string", as_text(c)), kinds[3])
    return found.when(kind == "string", text).otherwise(F.raise_error(F.concat(F.lit("E106: can't convert "), kind)))
