"""Folds, sorts and look-ups over lists and maps in a column, and folds of a whole column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cells
from .tracing import Expr, expression
from .values import GridError, arithmetic, truthy

Pair = Callable[[Column, Column], Column]
#: A Python function of one or two items, traced into a typed expression.
Traced = Callable[..., object]
#: Fixed value: the most items that a repetition may make.
MOST_ITEMS = 1 << 20
_START = {("+", "bigint"): 0, ("+", "double"): 0.0, ("+", "string"): "", ("*", "bigint"): 1, ("*", "double"): 1.0}


def fold(op: str, items: Column, kind: str) -> Column:
    """Left fold of `+` or `*` over a list of one kind: whole numbers wrap, floats add up in order, texts join."""
    if (op, kind) not in _START:
        raise GridError("E106", f"a list of {kind} has no {op}")
    return F.aggregate(items, F.lit(_START[op, kind]).cast(kind), lambda a, x: arithmetic(op, a, x, (kind, kind)))


def reduce_list(items: Column, step: Pair, kind: str) -> Column:
    """Left fold whose first item is the start; an empty list is an error when the rows are read."""
    rest = F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0)))
    empty = F.raise_error(F.lit("E106: an empty list has nothing to start from")).cast(kind)
    return F.when(F.size(items) > 0, F.aggregate(rest, F.get(items, F.lit(0)), step)).otherwise(empty)


def every(items: Column, kind: str) -> Column:
    return F.forall(items, lambda x: truthy(x, kind))


def some(items: Column, kind: str) -> Column:
    return F.exists(items, lambda x: truthy(x, kind))


def column_sum(c: Column, kind: str) -> Column:
    """The fold of `+` over all rows of a number column: whole numbers are summed in full and wrapped at the end."""
    if kind == "double":
        return F.coalesce(F.sum(c), F.lit(0.0))
    half, whole = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    total = F.coalesce(F.sum(c.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")
    return (F.pmod(total + half, whole) - half).cast("bigint")


def column_every(c: Column, kind: str) -> Column:
    return F.coalesce(F.bool_and(truthy(c, kind)), F.lit(True))


def column_some(c: Column, kind: str) -> Column:
    return F.coalesce(F.bool_or(truthy(c, kind)), F.lit(False))


def order_list(items: Column, less: Pair | None = None) -> Column:
    """The stable permutation, 0-based, that sorts a list by `less`, by default in rising order."""
    less = less or (lambda a, b: a < b)
    placed = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    both = lambda a, b: F.when(less(a["x"], b["x"]), -1).when(less(b["x"], a["x"]), 1).otherwise(a["i"] - b["i"])
    return F.transform(F.array_sort(placed, both), lambda p: p["i"])


def sort_list(items: Column, less: Pair | None = None) -> Column:
    return F.transform(order_list(items, less), lambda i: F.get(items, i))


def _alike(items: Column, kind: str | None) -> Column:
    """The items so that equal ones are identical: 0.0 for -0.0, keys for cells of mixed kinds."""
    if kind is not None and kind == f"array<{cells.VARIANT}>":
        return F.transform(items, cells.key)
    return F.transform(items, lambda x: F.when(x == 0, x * 0 + 0).otherwise(x)) if kind in ("array<double>", "array<float>") else items


def unique_list(items: Column, kind: str | None = None) -> Column:
    """First occurrences in order; the list's type is needed for floats, whose two zeros are one value, and mixed cells."""
    if kind not in ("array<double>", "array<float>", f"array<{cells.VARIANT}>"):
        return F.array_distinct(items)
    alike = _alike(items, kind)
    return F.filter(items, lambda x, i: F.array_position(alike, F.get(alike, i)) == i + 1)


def duplicated_list(items: Column, kind: str | None = None) -> Column:
    """Per item, whether it occurs before; the list's type as for `unique_list`."""
    alike = _alike(items, kind)
    return F.transform(alike, lambda x, i: F.coalesce(F.array_position(alike, x) <= i, F.lit(False)))


def traced(f: Traced, *kinds: str) -> tuple[Callable[..., Column], str]:
    """A Python function of items of these kinds, as a function of columns, and the kind of its result."""
    run = lambda *items: expression(f(*(Expr.given(x, k) for x, k in zip(items, kinds, strict=True))))
    return lambda *items: run(*items).column, run(*(F.lit(None).cast(k) for k in kinds)).kind


def filter_list(items: Column, keep: Traced, kind: str) -> Column:
    """The items, of that kind, for which the function's result is true, zero and empty being false; order kept."""
    test, result = traced(keep, kind)
    return F.filter(items, lambda x: truthy(test(x), result))


def map_list(items: Column, step: Traced, kind: str) -> Column:
    """The function's result for every item, in order."""
    run, _ = traced(step, kind)
    return F.transform(items, lambda x: run(x))


def sort_list_by(items: Column, less: Traced, kind: str) -> Column:
    """Stable sort by a function of two items that says whether the first comes before."""
    run, result = traced(less, kind, kind)
    return sort_list(items, lambda a, b: truthy(run(a, b), result))


def reduce_list_by(items: Column, step: Traced, kind: str) -> Column:
    """Left fold by a function of two items, which must give their kind again."""
    run, result = traced(step, kind, kind)
    if result != kind:
        raise GridError("E106", f"the fold of {kind} gives {result}")
    return reduce_list(items, lambda a, x: run(a, x), kind)


def as_list(c: Column, kind: str) -> Column:
    """A list as it is, a single value as a list of one."""
    if kind.startswith("map"):
        raise GridError("E106", "a map is no list")
    return c if kind.startswith("array") else F.array(c)


def join_lists(*lists: Column) -> Column:
    """The items of all lists, one list after the other."""
    return F.concat(*lists)


def repeat_list(items: Column, times: Column, kind: str) -> Column:
    """A list of that kind, several times over; a negative number, or a result of over 2^20 items, is an error when the rows are read."""
    bad = (times < 0) | (F.size(items).cast("long") * times > MOST_ITEMS)
    failed = F.raise_error(F.lit("E106: a list can't be repeated so often")).cast(kind)
    return F.when(bad, failed).otherwise(F.flatten(F.array_repeat(items, times.cast("int"))))


def each(items: Column, step: Callable[[Column], Column]) -> Column:
    """An operator on one operand for every item, in order."""
    return F.transform(items, step)


def reverse(items: Column) -> Column:
    return F.reverse(items)


def item(items: Column, at: Column | int, kind: str) -> Column:
    """One item, 0-based, from the end if negative; out of range is an error when the rows are read."""
    at = (F.lit(at) if isinstance(at, int) else at).cast("int")
    n = F.size(items)
    bad = F.raise_error(F.lit("E106: index out of range")).cast(kind)
    return F.when((at >= n) | (at < -n), bad).otherwise(F.get(items, F.when(at < 0, at + n).otherwise(at)))


def items_at(items: Column, at: Column, kind: str) -> Column:
    """The items at a list of indexes, repeats and order kept."""
    return F.transform(at, lambda i: item(items, i, kind))


def entry(entries: Column, key: Column, kind: str) -> Column:
    """A map's value; a missing key is an error when the rows are read."""
    bad = F.raise_error(F.concat(F.lit("E106: no key "), key.cast("string"))).cast(kind)
    return F.when(F.map_contains_key(entries, key), F.try_element_at(entries, key)).otherwise(bad)


def entry_or(entries: Column, key: Column, default: Column) -> Column:
    """A map's value, even if that is null, or the default where the key is missing."""
    return F.when(F.map_contains_key(entries, key), F.try_element_at(entries, key)).otherwise(default)


def update(left: Column, right: Column) -> Column:
    """Both maps' entries; the right one's values win, keys stay where they first stood."""
    kept = F.map_zip_with(left, left, lambda k, a, b: F.when(F.map_contains_key(right, k), F.try_element_at(right, k)).otherwise(a))
    return F.map_concat(kept, F.map_filter(right, lambda k, v: ~F.map_contains_key(left, k)))
