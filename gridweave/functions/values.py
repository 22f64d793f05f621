"""Scalar and vector semantics as column expressions, and the few that the driver needs for literals."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells
from .cells import VARIANT

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
INT = r"^[+-]?[0-9]+\z"
FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
#: Longest text that repeating may give, in bytes.
MOST_BYTES = 1 << 20
NUMBERS = ("bigint", "double")


class GridError(ValueError):
    """An error with its code."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


def check_names(names: Sequence[str]) -> tuple[str, ...]:
    """Column names must be shell names and differ."""
    if bad := [n for n in names if not NAME.fullmatch(n)]:
        raise GridError("E106", f"invalid column names {bad}")
    if len(set(names)) < len(names):
        raise GridError("E106", "duplicate column names")
    return tuple(names)


def wrap(op: str, a: Column, b: Column) -> Column:
    """Signed 64-bit `+ - *` that wraps around: in decimals, folded back into the range of a long."""
    wide = [x.cast("decimal(20,0)") for x in (a, b)]
    result = {"+": lambda: wide[0] + wide[1], "-": lambda: wide[0] - wide[1], "*": lambda: wide[0] * wide[1]}[op]()
    half, whole = F.lit(str(1 << 63)).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    return (F.pmod(result.cast("decimal(38,0)") + half, whole) - half).cast("bigint")


def _fail(code: str, message: str, kind: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {message}")).cast(kind)


def arithmetic(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """`+ - *` of two cells: whole numbers wrap, a float makes both floats, text is joined or repeated."""
    if VARIANT in kinds:
        return cells.arithmetic(op, cells.of(a, kinds[0]), cells.of(b, kinds[1]))
    if op == "+" and "string" in kinds:
        return F.concat(text_of(a, kinds[0]), text_of(b, kinds[1]))
    if op == "*" and sorted(kinds) == ["bigint", "string"]:
        word, times = (a, b) if kinds[0] == "string" else (b, a)
        bad = (times < 0) | (F.octet_length(word).cast("long") * times > MOST_BYTES)
        return F.when(bad, _fail("E106", "text can't be repeated so often", "string")).otherwise(F.repeat(word, times.cast("int")))
    if not set(kinds) <= set(NUMBERS):
        raise GridError("E105", f"{op} isn't defined on {kinds[0]} and {kinds[1]}")
    if kinds == ("bigint", "bigint"):
        return wrap(op, a, b)
    a, b = a.cast("double"), b.cast("double")
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()


def wrapped(op: str, a: Column, b: Column) -> Column:
    """Whether `+ - *` of two whole numbers leaves 64 bits; false where one is null."""
    wide = [x.cast("decimal(20,0)") for x in (a, b)]
    result = {"+": lambda: wide[0] + wide[1], "-": lambda: wide[0] - wide[1], "*": lambda: wide[0] * wide[1]}[op]()
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.coalesce((result >= half) | (result < -half), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """Always a float; by zero is an error when the rows are read."""
    return F.when(b == 0, _fail("E107", "division by zero", "double")).otherwise(a.cast("double") / b.cast("double"))


def remainder(a: Column, b: Column) -> Column:
    """Of whole numbers, with the sign of the dividend; by zero is an error when the rows are read."""
    # The least number modulo -1 is 0, without the overflow of the division.
    return F.when(b == 0, _fail("E107", "remainder by zero", "bigint")).when(b == -1, F.lit(0).cast("bigint")).otherwise(a % b)


def negative(c: Column, kind: str) -> Column:
    return wrap("-", F.lit(0), c) if kind == "bigint" else -c


def equals(a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """Whole numbers exactly, across kinds by float values; null equals null, NaN nothing; other kinds that differ are unequal."""
    if VARIANT in kinds:
        return cells.equal(cells.of(a, kinds[0]), cells.of(b, kinds[1]))
    if set(kinds) <= set(NUMBERS) and kinds != ("bigint", "bigint"):
        a, b = a.cast("double"), b.cast("double")
        return a.eqNullSafe(b) & ~F.coalesce(F.isnan(a), F.lit(False))
    return a.eqNullSafe(b) if kinds[0] == kinds[1] else a.isNull() & b.isNull()


def compare(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """`< <= > >=` of two texts by bytes or two numbers as floats; other kinds have no order."""
    if VARIANT in kinds:
        return cells.compare(op, cells.of(a, kinds[0]), cells.of(b, kinds[1]))
    if set(kinds) <= set(NUMBERS):
        a, b = a.cast("double"), b.cast("double")
        ordered = {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        return ordered & ~F.isnan(a) & ~F.isnan(b)
    if kinds != ("string", "string"):
        raise GridError("E110", f"{kinds[0]} and {kinds[1]} have no order")
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def logic(op: str, a: Column, b: Column, kinds: tuple[str, str]) -> Column:
    """`and`, `or` of truth values, never null."""
    a, b = truthy(a, kinds[0]), truthy(b, kinds[1])
    return a & b if op == "and" else a | b


def choose(condition: Column, kind: str, yes: Column, no: Column) -> Column:
    return F.when(truthy(condition, kind), yes).otherwise(no)


def length(c: Column, kind: str) -> Column:
    """Code points of a text, items of a list or map."""
    if kind != "string" and not kind.startswith(("array", "map")):
        raise GridError("E106", f"{kind} has no length")
    return (F.length(c) if kind == "string" else F.size(c)).cast("bigint")


def text_of(c: Column, kind: str) -> Column:
    """A cell as text: None, true and false, whole floats with one decimal, others with six digits before an exponent."""
    if kind == VARIANT:
        return cells.text_of(c)
    if kind.startswith("array<"):
        inside = F.array_join(F.transform(c, lambda x: text_of(x, kind[6:-1])), ",")
        return F.coalesce(F.concat(F.lit("["), inside, F.lit("]")), F.lit("None"))
    if kind not in ("double", "float"):
        return F.coalesce(c.cast("string"), F.lit("None"))
    shown = F.abs(c).cast("string")
    mantissa = F.regexp_extract(shown, r"^([0-9.]+)", 1)
    digits = F.regexp_replace(F.translate(mantissa, ".", ""), "^0+|0+$", "")
    # Place of the first digit: by the exponent, or by what stands before or after the point.
    scale = F.coalesce(F.regexp_extract(shown, r"E(-?[0-9]+)", 1).try_cast("int"), F.lit(0))
    zeros = F.length(F.regexp_extract(mantissa, r"^0\.(0*)", 1))
    first = scale + F.when(mantissa.startswith("0."), -zeros - 1).otherwise(F.instr(mantissa, ".") - 2)
    tail = F.substring(digits, 2, 32)
    power = F.concat(F.when(first < 0, "e-").otherwise("e+"), F.lpad(F.abs(first).cast("string"), 2, "0"))
    power = F.when(F.abs(first) > 99, F.concat(F.when(first < 0, "e-").otherwise("e+"), F.abs(first).cast("string"))).otherwise(power)
    short = F.concat(F.substring(digits, 1, 1), F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -first - 1), digits)
    plain = F.when((first < -4) | (first >= 6), short).when(first < 0, small).otherwise(mantissa)
    # A whole float in full: 62 bits at a time, since a cast to a decimal takes its shortest digits.
    high = F.floor(F.abs(c) / float(1 << 62))
    exact = high.cast("decimal(20,0)") * F.lit(str(1 << 62)).cast("decimal(20,0)") + (F.abs(c) - high * float(1 << 62)).cast("bigint").cast("decimal(20,0)")
    whole = F.concat(exact.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    out = F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "+Inf").otherwise("-Inf"))
    signed = F.concat(F.when(c < 0, "-").otherwise(""), F.when((c == F.rint(c)) & (F.abs(c) < 1e37), whole).otherwise(plain))
    return F.coalesce(out, signed, F.lit("None"))


def truthy(c: Column, kind: str) -> Column:
    """Zero, empty and null are false."""
    if kind == VARIANT:
        return cells.truthy(c)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    if kind.startswith(("array", "map")):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    return F.coalesce(c != 0, F.lit(False))


def to_int(c: Column, kind: str) -> Column:
    """Numbers are cut towards zero, text must be a decimal integer; what 64 bits don't hold is an error when the rows are read."""
    if kind == VARIANT:
        return cells.converted(c, to_int)
    if kind == "string":
        number = F.when(c.rlike(INT), c.try_cast("bigint"))
        return F.coalesce(number, F.when(c.isNotNull(), _fail("E106", "not an integer of 64 bits", "bigint")))
    if kind in ("double", "float"):
        fits = (c >= -float(1 << 63)) & (c < float(1 << 63)) & ~F.isnan(c)
        return F.when(fits, F.when(fits, c).cast("bigint")).when(c.isNotNull(), _fail("E106", "the float doesn't fit into 64 bits", "bigint"))
    return c.cast("bigint")


def to_float(c: Column, kind: str) -> Column:
    """Text must be a finite number; else reading raises."""
    if kind == VARIANT:
        return cells.converted(c, to_float)
    if kind == "string":
        number = F.when(c.rlike(FLOAT), c.try_cast("double"))
        finite = F.when(F.abs(number) < float("inf"), number)
        return F.coalesce(finite, F.when(c.isNotNull(), _fail("E106", "not a finite number", "double")))
    return c.cast("double")


def cyclic(a: Column, b: Column, op: Any) -> Column:
    """Element-wise over arrays; the shorter repeats, an empty one empties the result."""
    n = F.greatest(F.size(a), F.size(b))
    at = lambda x, i: F.element_at(x, (i % F.size(x) + 1).cast("int"))
    steps = F.when((F.size(a) > 0) & (F.size(b) > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: op(at(a, i), at(b, i)))


def float_text(x: float) -> str:
    """Whole floats with one decimal, others in their shortest form, with an exponent from 1e6 on and below 1e-4."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "+Inf", "-inf": "-Inf"}[str(x)]
    if x == int(x):
        return f"{x:.1f}"
    digits = f"{x:e}" if abs(x) < 1e-4 or abs(x) >= 1e6 else repr(x)
    if "e" in digits:
        shortest = next(y for p in range(17) if float(y := f"{x:.{p}e}") == x)
        return shortest
    return digits


def text(value: Any) -> str:
    """Text form of a literal."""
    if value is None:
        return "None"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, (list, tuple)):
        inner = ",".join(map(text, value))
        return f"[{inner}]" if isinstance(value, list) else f"({inner})"
    if isinstance(value, dict):
        return "{" + ",".join(f"{text(k)}:{text(v)}" for k, v in value.items()) + "}"
    return str(value)


def equal(a: Any, b: Any) -> bool:
    """Equality of literals: numbers across kinds, lists and tuples apart, booleans only with booleans."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b) if isinstance(a, float) or isinstance(b, float) else a == b
    if isinstance(a, (list, tuple)) and type(a) is type(b):
        return len(a) == len(b) and all(map(equal, a, b))
    return type(a) is type(b) and a == b


def number_range(start: float, stop: float | None = None, step: float | None = None, most: int = 1 << 20) -> list[float]:
    """Half-open; two numbers count down if the first is larger; floats add up step by step."""
    if stop is None:
        start, stop = 0, start
    if step is None:
        if any(isinstance(x, float) for x in (start, stop)):
            raise GridError("E106", "a range of floats needs a step")
        step = 1 if start <= stop else -1
    if step == 0:
        raise GridError("E106", "zero step")
    whole = all(isinstance(x, int) for x in (start, stop, step))
    if not whole and any(x != x or abs(x) == float("inf") for x in (start, stop, step)):
        raise GridError("E106", "a range needs finite numbers")
    out, x = [], start
    while (x < stop) if step > 0 else (x > stop):
        if len(out) >= most:
            raise GridError("E106", "too many items")
        out.append(x)
        after = x + step
        if (whole and not -(1 << 63) <= after < 1 << 63) or abs(after) == float("inf"):
            raise GridError("E106", "the range runs past the largest number")
        if after == x:
            raise GridError("E106", "the step is too small to get on")
        x = after
    return out
