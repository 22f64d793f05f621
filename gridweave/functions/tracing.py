"""Python functions of a row or an item, traced into typed column expressions.

`lambda r: r.a * r.b > 0` is called once, with a proxy; what it does to the proxy becomes a tree whose nodes know the
kind of their value, so that each picks the semantics of its operands: whole numbers wrap, comparisons go by kinds, truth
by emptiness, lists element by element with the shorter one repeated. The result is a column expression; no Python runs
per row. A function that needs the value itself (`if`, `and`, `in`, a loop) can't be traced and is refused; `choose`,
`&`, `|` and `~` stand for conditional, `and`, `or` and `not`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .cells import VARIANT, from_literals, literal, of
from .values import GridError

_WIDE = {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "float": "double"}


def any_of(flags: list[Column | None]) -> Column:
    """Whether any of the conditions holds."""
    return reduce(lambda a, b: a | b, [f for f in flags if f is not None] or [F.lit(False)])


@dataclass(frozen=True, eq=False)
class Expr:
    """A node: its operator and operands, the value as a column, its kind, and whether a whole number in it wrapped."""

    op: str
    args: tuple[Expr, ...]
    column: Column
    kind: str
    wrapped: Column | None = None

    @staticmethod
    def given(column: Column, kind: str, op: str = "column") -> Expr:
        """A leaf of that type; narrow numbers are widened."""
        inner = kind[6:-1] if kind.startswith("array<") else kind
        wide = kind.replace(inner, _WIDE.get(inner, inner))
        return Expr(op, (), column if wide == kind else column.cast(wide), wide)

    # Operators ---------------------------------------------------------------------------------------------------

    def __add__(self, other: Any) -> Expr:
        return _arithmetic("+", self, other)

    def __radd__(self, other: Any) -> Expr:
        return _arithmetic("+", other, self)

    def __sub__(self, other: Any) -> Expr:
        return _arithmetic("-", self, other)

    def __rsub__(self, other: Any) -> Expr:
        return _arithmetic("-", other, self)

    def __mul__(self, other: Any) -> Expr:
        return _arithmetic("*", self, other)

    def __rmul__(self, other: Any) -> Expr:
        return _arithmetic("*", other, self)

    def __truediv__(self, other: Any) -> Expr:
        return _pairwise("/", self, other, _divided)

    def __rtruediv__(self, other: Any) -> Expr:
        return _pairwise("/", other, self, _divided)

    def __mod__(self, other: Any) -> Expr:
        return _pairwise("%", self, other, _rest)

    def __rmod__(self, other: Any) -> Expr:
        return _pairwise("%", other, self, _rest)

    def __neg__(self) -> Expr:
        return _arithmetic("-", 0, self) if self.kind in ("bigint", VARIANT) or "bigint" in self.kind else _arithmetic("*", -1.0, self)

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return _pairwise("==", self, other, _equal)

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return ~(self == other)

    def __lt__(self, other: Any) -> Expr:
        return _pairwise("<", self, other, _compared("<"))

    def __le__(self, other: Any) -> Expr:
        return _pairwise("<=", self, other, _compared("<="))

    def __gt__(self, other: Any) -> Expr:
        return _pairwise(">", self, other, _compared(">"))

    def __ge__(self, other: Any) -> Expr:
        return _pairwise(">=", self, other, _compared(">="))

    def __and__(self, other: Any) -> Expr:
        return _pairwise("and", self, other, _logic("and"))

    def __rand__(self, other: Any) -> Expr:
        return _pairwise("and", other, self, _logic("and"))

    def __or__(self, other: Any) -> Expr:
        return _pairwise("or", self, other, _logic("or"))

    def __ror__(self, other: Any) -> Expr:
        return _pairwise("or", other, self, _logic("or"))

    def __invert__(self) -> Expr:
        if self.kind.startswith("array<"):
            inner = self.kind[6:-1]
            return Expr("not", (self,), F.transform(self.column, lambda x: ~V.truthy(x, inner)), "array<boolean>", self.wrapped)
        return Expr("not", (self,), ~self.truth(), "boolean", self.wrapped)

    def __getitem__(self, at: Any) -> Expr:
        """An item of a list by whole number, a value of a map by key; a missing one is an error when rows are read."""
        from . import folds

        key = expression(at)
        if self.kind.startswith("array<"):
            return Expr("item", (self, key), folds.item(self.column, key.column, self.kind[6:-1]), self.kind[6:-1], any_wrapped(self, key))
        if self.kind.startswith("map<string,"):
            return Expr.given(folds.entry(self.column, key.column, self.kind[11:-1]), self.kind[11:-1], "entry")
        raise GridError("E106", f"{self.kind} has no items")

    def __bool__(self) -> bool:
        raise TypeError("a traced value is known only when rows are read: use choose(), &, | and ~ instead of if, and, or and not")

    __hash__ = None  # type: ignore[assignment]
    __iter__ = None  # an item count isn't known while tracing

    # Conversions -------------------------------------------------------------------------------------------------

    def truth(self) -> Column:
        return F.lit(False) if self.kind == "void" else V.truthy(self.column, self.kind)

    def bool(self) -> Expr:
        return Expr("bool", (self,), self.truth(), "boolean", self.wrapped)

    def int(self) -> Expr:
        return Expr("int", (self,), V.to_int(self.column, self.kind), "bigint", self.wrapped)

    def float(self) -> Expr:
        return Expr("float", (self,), V.to_float(self.column, self.kind), "double", self.wrapped)

    def str(self) -> Expr:
        return Expr("str", (self,), V.text_of(self.column, "string" if self.kind == "void" else self.kind), "string", self.wrapped)

    def len(self) -> Expr:
        return Expr("len", (self,), V.length(self.column, self.kind), "bigint", self.wrapped)

    def wraps(self) -> Column:
        """Whether a whole number in the expression left 64 bits and wrapped."""
        return F.lit(False) if self.wrapped is None else self.wrapped

    def tree(self) -> Any:
        """The operators as nested tuples, leaves by their kinds."""
        return (self.op, *(a.tree() for a in self.args)) if self.args else self.kind


class Row:
    """Stands for a row while a function is traced; columns by attribute or key."""

    def __init__(self, kinds: dict[str, str]) -> None:
        self.__dict__["_kinds"] = kinds

    def __getattr__(self, name: str) -> Expr:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]

    def __getitem__(self, name: str) -> Expr:
        if name not in self._kinds:
            raise GridError("E106", f"unknown column {name}")
        return Expr.given(F.col(f"`{name}`"), self._kinds[name])


def expression(value: Any) -> Expr:
    """A traced value as it is, a Python value as a literal."""
    if isinstance(value, Expr):
        return value
    if value is None:
        return Expr("literal", (), F.lit(None), "void")
    if isinstance(value, (list, tuple)):
        items = [expression(x) for x in value]
        kinds = {x.kind for x in items}
        kind = kinds.pop() if len(kinds) == 1 else VARIANT
        return Expr("literal", tuple(items), F.array(*(of(x.column, x.kind) if kind == VARIANT else x.column for x in items)), f"array<{kind}>", any_wrapped(*items))
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        raise GridError("E106", f"{value} doesn't fit into 64 bits")
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    if type(value) in kinds:
        return Expr("literal", (), F.lit(value).cast(kinds[type(value)]), kinds[type(value)])
    if isinstance(value, dict):
        return Expr("literal", (), from_literals(F.lit(literal(value))), VARIANT)
    raise GridError("E106", f"{type(value).__name__} is no value")


def any_wrapped(*parts: Expr) -> Column | None:
    flags = [p.wrapped for p in parts if p.wrapped is not None]
    return any_of(flags) if flags else None


def choose(condition: Any, yes: Any, no: Any) -> Expr:
    """`yes if condition else no`: by truth, only the chosen side is evaluated; sides of two kinds give a cell of either."""
    c, y, n = map(expression, (condition, yes, no))
    kind = y.kind if y.kind == n.kind or n.kind == "void" else n.kind if y.kind == "void" else VARIANT
    sides = [x.column if x.kind in (kind, "void") else of(x.column, x.kind) for x in (y, n)]
    flags = [c.wrapped, *(None if x.wrapped is None else x.wrapped & (c.truth() if k == 0 else ~c.truth()) for k, x in enumerate((y, n)))]
    wrapped = any_of(flags) if any(f is not None for f in flags) else None
    return Expr("choose", (c, y, n), F.when(c.truth(), sides[0]).otherwise(sides[1]), kind, wrapped)


# Operators of two cells: (column, kind, whether it wrapped) of two columns of known kinds --------------------------

Two = Callable[[Column, Column, str, str], tuple[Column, str, Column | None]]


def _sum_kind(op: str, a: str, b: str) -> str:
    if VARIANT in (a, b):
        return VARIANT
    if (op == "+" and "string" in (a, b)) or (op == "*" and sorted((a, b)) == ["bigint", "string"]):
        return "string"
    return "bigint" if (a, b) == ("bigint", "bigint") else "double"


def _arithmetic(op: str, left: Any, right: Any) -> Expr:
    def two(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str, Column | None]:
        flag = V.wrapped(op, a, b) if (ka, kb) == ("bigint", "bigint") else None
        if VARIANT in (ka, kb):
            whole = [F.try_variant_get(x, "$", "bigint") for x in (of(a, ka), of(b, kb))]
            ints = [F.schema_of_variant(x) == "BIGINT" for x in (of(a, ka), of(b, kb))]
            flag = F.coalesce(ints[0] & ints[1], F.lit(False)) & V.wrapped(op, *whole)
        return V.arithmetic(op, a, b, (ka, kb)), _sum_kind(op, ka, kb), flag

    return _pairwise(op, left, right, two)


def _divided(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str, None]:
    numbers = [V.to_float(x, k) if k == VARIANT else x for x, k in ((a, ka), (b, kb))]
    if not {ka, kb} <= {*V.NUMBERS, VARIANT}:
        raise GridError("E105", f"/ isn't defined on {ka} and {kb}")
    return V.divide(*numbers), "double", None


def _rest(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str, None]:
    if (ka, kb) != ("bigint", "bigint"):
        raise GridError("E108", f"% needs whole numbers, not {ka} and {kb}")
    return V.remainder(a, b), "bigint", None


def _equal(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str, None]:
    if "void" in (ka, kb):
        return a.isNull() & b.isNull(), "boolean", None
    return V.equals(a, b, (ka, kb)), "boolean", None


def _compared(op: str) -> Two:
    return lambda a, b, ka, kb: (V.compare(op, a, b, (ka, kb)), "boolean", None)


def _logic(op: str) -> Two:
    def two(a: Column, b: Column, ka: str, kb: str) -> tuple[Column, str, None]:
        x, y = (F.lit(False) if k == "void" else V.truthy(c, k) for c, k in ((a, ka), (b, kb)))
        return x & y if op == "and" else x | y, "boolean", None

    return two


def _pairwise(op: str, left: Any, right: Any, two: Two) -> Expr:
    """Two cells, or cell by cell if one is a list; then the shorter repeats and an empty one empties the result."""
    a, b = expression(left), expression(right)
    lists = [x.kind.startswith("array<") for x in (a, b)]
    if not any(lists):
        column, kind, flag = two(a.column, b.column, a.kind, b.kind)
        flags = [f for f in (a.wrapped, b.wrapped, flag) if f is not None]
        return Expr(op, (a, b), column, kind, any_of(flags) if flags else None)
    inner = [x.kind[6:-1] if many else x.kind for x, many in zip((a, b), lists, strict=True)]
    items = [x.column if many else F.array(x.column) for x, many in zip((a, b), lists, strict=True)]
    kind, flagged = two(F.lit(None), F.lit(None), *inner)[1:]
    column = V.cyclic(*items, lambda x, y: two(x, y, *inner)[0])
    own = F.exists(V.cyclic(*items, lambda x, y: two(x, y, *inner)[2]), lambda x: x) if flagged is not None else None
    flags = [f for f in (a.wrapped, b.wrapped, own) if f is not None]
    return Expr(op, (a, b), column, f"array<{kind}>", any_of(flags) if flags else None)
