"""Grids: ordered tables whose cells know the row of the source that they came from.

A grid is a DataFrame with its visible columns, a position (`__pos`, unique and increasing in row order) and for each
visible column a key (`__pk_<column>`: source and row of the source). Projection keeps the first row for each distinct
tuple of keys, not of values: two equal values from different source rows stay apart, one source row that a product
repeated becomes one row again. Grids whose keys are the same for all columns and never repeat (`row_keyed`) need no
key columns, and their projection is a plain select.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce as fold_left
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.draws import Seeds, draws
from ..functions.positions import POS, densify, position_by
from ..functions.tracing import Expr, Row, any_of, expression
from ..functions.values import GridError, check_names, equals
from ..functions.watch import Watch

_SOURCES = count(1)
#: Rows of a side that may be broadcast in a positional merge.
MERGE_BROADCAST = 200_000
#: Rows of a literal table in a partition.
LITERAL_ROWS = 4096
#: Types that grouping refuses or changes, as it does -0.0.
_NOT_GROUPED = ("double", "float", "map<", cells.VARIANT)


def _pk(column: str) -> str:
    return f"__pk_{column}"


def _key(source: Column | int, index: Column) -> Column:
    source = F.lit(source) if isinstance(source, int) else source
    return F.struct(source.cast("long").alias("src"), index.cast("long").alias("idx"))


@dataclass(frozen=True)
class Grid:
    df: DataFrame
    columns: tuple[str, ...]
    #: The source number of a row-keyed grid, whose keys are (source, position).
    row_keyed: int | None = None
    #: Positions are 0..n-1.
    dense: bool = False
    warnings: tuple[str, ...] = ()
    #: Came from a scalar or a list, not from a table: its one column goes by its name alone.
    bare: bool = False
    #: What is known of the rows: their number, or how to find it out, and the factors of a product; a changed grid knows nothing.
    _known: dict[str, Any] = field(init=False, default_factory=dict, compare=False, repr=False)

    # Sources -----------------------------------------------------------------------------------------------------

    @property
    def names(self) -> tuple[str, ...]:
        return self.columns

    @staticmethod
    def scan(df: DataFrame, position: str | Column) -> Grid:
        """A table with a dense 0-based `position`; one source row per row."""
        at = F.col(position) if isinstance(position, str) else position
        columns = check_names([c for c in df.columns if c != POS])
        return Grid(df.select(*columns, at.cast("long").alias(POS)), columns, next(_SOURCES), True)

    @staticmethod
    def ordered(df: DataFrame, *keys: str) -> Grid:
        """A table numbered in the order of `keys`, which are unique together."""
        first = df.withColumn(POS, F.xxhash64(*keys))
        placed = position_by(first, [F.col(k) for k in keys])
        return Grid(placed, check_names(df.columns), next(_SOURCES), True)._rows(df.count)

    @staticmethod
    def table(spark: SparkSession, **columns: Any) -> Grid:
        """Literal columns, each a source of its own; shorter ones repeat cyclically, an empty one needs all empty."""
        lists = {name: v if isinstance(v, cells.Mixed) else list(v) if isinstance(v, (list, tuple, range)) else [v] for name, v in columns.items()}
        check_names(list(lists))
        longest, warnings = max(map(len, lists.values()), default=0), ()
        if longest and any(not v for v in lists.values()):
            raise GridError("E106", "an empty column can't be combined with others")
        if any(v and longest % len(v) for v in lists.values()):
            warnings = ("W101",)
        sources = {name: next(_SOURCES) for name in lists}
        types = {name: _literal_type(values) for name, values in lists.items()}
        held = {name: _held(values, types[name]) for name, values in lists.items()}
        rows = [
            (i, *(v for name, values in held.items() for v in (values[i % len(values)], (sources[name], i % len(values)))))
            for i in range(longest)
        ]
        schema = f"`{POS}` long" + "".join(f", `{n}` {_held_type(types[n])}, `{_pk(n)}` struct<src: bigint, idx: bigint>" for n in lists)
        out = Grid(_given(spark.createDataFrame(rows, schema), types, longest), tuple(lists), None, True, warnings)._rows(longest)
        return out._factors((out,)) if all(len(v) == longest for v in lists.values()) else out

    @staticmethod
    def from_rows(spark: SparkSession, rows: Sequence[dict[str, Any]]) -> Grid:
        """Row dictionaries with one set of keys; all columns share one source."""
        if not rows:
            return Grid(spark.createDataFrame([], f"`{POS}` long"), (), next(_SOURCES), True)
        names = list(rows[0])
        if any(set(r) != set(names) for r in rows):
            raise GridError("E106", "rows must have the same keys")
        check_names(names)
        types = {n: _literal_type([r[n] for r in rows]) for n in names}
        schema = f"`{POS}` long" + "".join(f", `{n}` {_held_type(types[n])}" for n in names)
        columns = [_held([r[n] for r in rows], types[n]) for n in names]
        return Grid(_given(spark.createDataFrame([(i, *r) for i, r in enumerate(zip(*columns, strict=True))], schema), types, len(rows)), tuple(names), next(_SOURCES), True)._rows(len(rows))

    # Keys --------------------------------------------------------------------------------------------------------

    def keyed(self) -> DataFrame:
        """The DataFrame with all key columns."""
        if self.row_keyed is None:
            return self.df
        return self.df.select(POS, *(x for c in self.columns for x in (F.col(c), _key(self.row_keyed, F.col(POS)).alias(_pk(c)))))

    def densified(self) -> Grid:
        if self.dense:
            return self
        # Keys hold old positions, so they are written down first.
        return replace(self, df=densify(self.keyed()), row_keyed=None, dense=True)._rows(self.length)

    def length(self) -> int:
        """Rows, counted at most once, and not at all where they follow from the operands'."""
        known = self._known.get("rows", self.df.count)
        if callable(known):
            known = self._known["rows"] = known()
        return known

    def _rows(self, known: int | Callable[[], int]) -> Grid:
        self._known["rows"] = known
        return self

    @property
    def factors(self) -> tuple[Grid, ...] | None:
        """Dense grids whose full product, left-major, this one is, if that is known; each column's keys tell all rows of its factor apart."""
        return (self,) if self.row_keyed is not None and self.dense else self._known.get("factors")

    def _factors(self, known: tuple[Grid, ...] | None) -> Grid:
        self._known["factors"] = known
        return self

    # Algebra -----------------------------------------------------------------------------------------------------

    def product(self, other: Grid) -> Grid:
        """Every row with every row, left-major; a shared column must be equal everywhere, else reading raises E042."""
        right = other.densified()
        a, b, shared = _sides(self.keyed(), right.keyed(), self.columns, right.columns)
        joined, size = a.crossJoin(b), right._known.get("rows")  # the operation is the Cartesian product
        if not isinstance(size, int):  # counted with the rows, not before
            joined = joined.crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("__n"))))
        times = F.lit(size) if isinstance(size, int) else F.col("__n")
        out = self._merged(joined, right, shared, F.col("__l_pos") * times + F.col("__r_pos"), self.dense)
        if shared:
            return out
        parts = (*self.factors, *right.factors) if self.factors and right.factors else None
        return out._rows(lambda: self.length() * right.length())._factors(parts)

    def merge(self, other: Grid) -> Grid:
        """Row i of the longer with row i of the shorter, which repeats cyclically; an empty side empties the result."""
        left, right = self.densified(), other.densified()
        m, n = left.length(), right.length()
        longest = max(m, n) if m and n else 0
        a, b, shared = _sides(left.keyed(), right.keyed(), left.columns, right.columns)
        steps = left.df.sparkSession.range(longest).withColumnRenamed("id", "__i")
        hint = lambda side, size: F.broadcast(side) if size <= MERGE_BROADCAST and _narrow(side) else side
        if m == n:
            joined = hint(a, m).join(b, F.col("__l_pos") == F.col("__r_pos")).withColumn("__i", F.col("__l_pos"))
        else:
            joined = steps.join(hint(a, m), F.col("__i") % max(m, 1) == F.col("__l_pos")).join(hint(b, n), F.col("__i") % max(n, 1) == F.col("__r_pos"))
        uneven = ("W101",) if longest and longest % min(m, n) else ()
        merged = left._merged(joined, right, shared, F.col("__i"), True)
        out = replace(merged, warnings=(*merged.warnings, *uneven))
        return out if shared else out._rows(longest)

    def _merged(self, joined: DataFrame, right: Grid, shared: list[str], position: Column, dense: bool) -> Grid:
        mine, theirs = self.kinds, right.kinds
        for c in shared:  # as a filter the guard survives column pruning
            pair, sides = (mine[c], theirs[c]), (F.col(f"__l_{c}"), F.col(f"__r_{c}"))
            equal = equals(*sides, pair) if cells.VARIANT in pair else sides[0].eqNullSafe(sides[1])
            joined = joined.where(F.when(equal, True).otherwise(F.raise_error(F.lit(f"E042: column {c} differs between the operands")).cast("boolean")))
        own = [(c, "l") for c in self.columns] + [(c, "r") for c in right.columns if c not in self.columns]
        shown = [x for c, side in own for x in (F.col(f"__{side}_{c}").alias(c), F.col(f"__{side}_pk_{c}").alias(_pk(c)))]
        return Grid(joined.select(position.cast("long").alias(POS), *shown), tuple(c for c, _ in own), None, dense, (*self.warnings, *right.warnings))

    @staticmethod
    def rbind(*grids: Grid) -> Grid:
        """Rows of all grids in argument order; the same grid twice counts as two sources."""
        first = grids[0]
        if any(set(g.columns) != set(first.columns) for g in grids):
            raise GridError("E106", "all tables must have the same columns")
        parts, offset = [], 0
        for g in grids:
            name = next(_SOURCES)  # a namespace of its own for each argument
            dense = g.densified()
            shown = [x for c in first.columns for x in (F.col(c), _key(F.xxhash64(F.col(f"`{_pk(c)}`.src"), F.lit(name)), F.col(f"`{_pk(c)}`.idx")).alias(_pk(c)))]
            parts.append(dense.keyed().select((F.col(POS) + offset).alias(POS), *shown))
            offset += dense.length() if g is not grids[-1] else 0
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        return Grid(df, first.columns, None, True, tuple(w for g in grids for w in g.warnings))._rows(lambda: sum(g.length() for g in grids))

    # Columns and rows --------------------------------------------------------------------------------------------

    def project(self, *names: str) -> Grid:
        """The named columns; of rows with the same source rows in them, the first."""
        wanted = tuple(dict.fromkeys(names))
        if unknown := [n for n in wanted if n not in self.columns]:
            raise GridError("E106", f"unknown columns {unknown}")
        if self.row_keyed is not None:
            return replace(self, df=self.df.select(*wanted, POS), columns=wanted)._rows(self.length)
        shown = [x for c in wanted for x in (c, _pk(c))]
        if not any(mark in self.kinds[c] for c in wanted for mark in _NOT_GROUPED):
            # A key's value is one and the same, so a hash aggregate over both finds the first positions where rows lie.
            return Grid(self.df.groupBy(*shown).agg(F.min(POS).alias(POS)), wanted, None, False, self.warnings)
        first = F.row_number().over(Window.partitionBy(*(_pk(c) for c in wanted)).orderBy(POS))
        df = self.df.select(POS, *shown).withColumn("__rn", first).where("__rn = 1").drop("__rn")
        return Grid(df, wanted, None, False, self.warnings)

    def rename(self, **new: str) -> Grid:
        """old=new, all at once, so names can be swapped."""
        if missing := [c for c in new if c not in self.columns]:
            raise GridError("E106", f"unknown columns {missing}")
        columns = check_names([new.get(c, c) for c in self.columns])
        shown = [x for c, d in zip(self.columns, columns, strict=True) for x in ([F.col(c).alias(d)] if self.row_keyed is not None else [F.col(c).alias(d), F.col(_pk(c)).alias(_pk(d))])]
        out, parts = replace(self, df=self.df.select(POS, *shown), columns=columns)._rows(self.length), self._known.get("factors")
        if parts is None:
            return out
        return out._factors((out,) if parts == (self,) else tuple(p.rename(**{c: new[c] for c in p.columns if c in new}) for p in parts))

    @property
    def kinds(self) -> dict[str, str]:
        """Types of the visible columns."""
        return dict(self.df.select(*self.columns).dtypes)

    def trace(self, f: Callable[[Row], Any]) -> Expr:
        """What a Python function of a row gives, as a typed expression: `lambda r: r.a * r.b`."""
        return expression(f(Row(self.kinds)))

    def filter(self, keep: Column | Callable[[Row], Any]) -> Grid:
        """Rows where the predicate is true; null counts as false. Keys and order stay.

        A Python function of a row is traced into an expression with the values' own semantics: whole numbers wrap, zero
        and empty are false, which a result of another kind than a truth value is warned of (W101).
        """
        warned = ()
        if not isinstance(keep, Column):
            traced = self.trace(keep)
            keep, warned = traced.truth(), () if traced.kind in ("boolean", cells.VARIANT) else ("W101",)
        return replace(self, df=self.keyed().where(F.coalesce(keep, F.lit(False))), row_keyed=None, dense=False, warnings=(*self.warnings, *warned))

    def compute(self, watch: Watch | None = None, **columns: Callable[[Row], Any]) -> Grid:
        """A column more per function of a row, each a source of its own; `watch` counts W102, whole numbers that wrapped."""
        taken = check_names([*self.columns, *columns])
        traced = {name: self.trace(f) for name, f in columns.items()}
        df = self.keyed() if watch is None else watch.observed(self.keyed(), {"W102": any_of([e.wraps() for e in traced.values()])})
        added = [x for name, e in traced.items() for x in (e.column.alias(name), _key(next(_SOURCES), F.col(POS)).alias(_pk(name)))]
        return replace(self, df=df.select(*df.columns, *added), columns=taken, row_keyed=None)._rows(self.length)

    def gather(self, indexes: Sequence[int]) -> Grid:
        """Rows by 0-based index, repeats and order kept."""
        rows = self.densified()
        if any(i < 0 for i in indexes):
            raise GridError("E106", "row indexes can't be negative")
        if indexes and max(indexes) >= rows.length():
            raise GridError("E106", "row index out of range")
        picks = self.df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(indexes)], "__new long, __at long")
        joined = rows.keyed().join(F.broadcast(picks), F.col(POS) == F.col("__at"))  # a literal list
        df = joined.drop(POS, "__at").withColumnRenamed("__new", POS)
        return replace(rows, df=df, row_keyed=None, dense=True)

    def mask(self, flags: Sequence[bool]) -> Grid:
        """Rows at true flags, which repeat cyclically; no flags keep no rows."""
        rows = self.densified()
        if not flags:
            return replace(rows, df=rows.keyed().where(F.lit(False)), row_keyed=None)
        uneven = ("W101",) if rows.length() % len(flags) else ()
        kept = rows.keyed().where(F.element_at(F.array(*map(F.lit, flags)), (F.col(POS) % len(flags) + 1).cast("int")))
        return replace(rows, df=kept, row_keyed=None, dense=False, warnings=(*self.warnings, *uneven))

    def head(self, n: int = 5) -> Grid:
        if self.dense:
            return replace(self, df=self.df.where(F.col(POS) < n))
        return replace(self, df=self.keyed().orderBy(POS).limit(n), row_keyed=None)

    def tail(self, n: int = 5) -> Grid:
        """The last n rows."""
        if self.dense:
            kept = self.keyed().where(F.col(POS) >= max(0, self.length() - n))
        else:
            kept = self.keyed().orderBy(F.desc(POS)).limit(n)
        return replace(self, df=kept, row_keyed=None, dense=False)

    def order(self, *keys: str | Column, descending: bool = False) -> Grid:
        """Stable sort by the keys, of any type that has an order; ties keep their order in both directions."""
        columns = [F.col(k) if isinstance(k, str) else k for k in keys]
        if not descending:
            return replace(self, df=position_by(self.keyed(), columns), row_keyed=None, dense=True)._rows(self.length)
        # Rising order with ties turned round, read from the end.
        turned = position_by(self.keyed().withColumn(POS, -F.col(POS)), columns)
        return replace(self, df=turned.withColumn(POS, F.lit(self.length() - 1) - F.col(POS)), row_keyed=None, dense=True)

    def _values(self) -> list[Column]:
        # -0.0 and 0.0 are one value.
        zero = lambda c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c))
        return [cells.key(F.col(c)) if t == cells.VARIANT else zero(c) if t in ("double", "float") else F.col(c) for c, t in self.kinds.items()]

    def unique(self) -> Grid:
        """First row of each distinct tuple of visible values."""
        if self.row_keyed is not None and not {"double", "float", cells.VARIANT} & set(self.kinds.values()):
            # The values are all that a row holds, so a hash aggregate finds the first position without a sort.
            return replace(self, df=self.df.groupBy(*self.columns).agg(F.min(POS).alias(POS)), dense=False)
        first = F.row_number().over(Window.partitionBy(*self._values()).orderBy(POS))
        df = self.keyed().withColumn("__rn", first).where("__rn = 1").drop("__rn")
        return replace(self, df=df, row_keyed=None, dense=False)

    def duplicated(self) -> DataFrame:
        """Visible columns, position and whether an earlier row has the same values.

        First positions are found where the rows lie and joined back, so a popular value meets in no single task: the
        join is one that adaptive execution splits.
        """
        named = [v.alias(f"__v{i}") for i, v in enumerate(self._values())]
        firsts = self.df.select(POS, *named).groupBy(*(f"__v{i}" for i in range(len(named)))).agg(F.min(POS).alias("__first"))
        same = F.lit(True)
        for i, v in enumerate(self._values()):
            same = same & v.eqNullSafe(F.col(f"__v{i}"))
        return self.df.join(firsts, same).select(POS, *self.columns, (F.col(POS) > F.col("__first")).alias("duplicated"))

    def sample(self, size: int | None = None, replace_rows: bool = False, seed: int | Seeds = 0) -> Grid:
        """`size` rows in random order, by default as many as there are; the same for the same seed.

        Without replacement there are at most as many as rows. With it, each output row draws a position by its own number
        and meets the row there by a join; rows that are drawn become a source of their own. `Seeds` gives each call the next.
        """
        n, seed = self.length(), seed.next() if isinstance(seed, Seeds) else seed
        size = n if size is None else size
        if size < 0 or (size > n and (not replace_rows or not n)):
            raise GridError("E106", f"{size} rows can't be drawn from {n}")
        if replace_rows and size:
            picks = draws(self.df.sparkSession, size, n, seed)
            picked = self.densified().df.select(POS, *self.columns).join(picks, F.col(POS) == F.col("__at"))
            return Grid(picked.select(F.col("__new").alias(POS), *self.columns), self.columns, next(_SOURCES), True, self.warnings)
        drawn = self.keyed().withColumn("__draw", F.xxhash64(POS, F.lit(seed)))
        if size <= MERGE_BROADCAST:
            drawn = drawn.orderBy("__draw", POS).limit(size)
        placed = position_by(drawn, [F.col("__draw")]).drop("__draw")
        return replace(self, df=placed.where(F.col(POS) < size), row_keyed=None, dense=True)

    # Results -----------------------------------------------------------------------------------------------------

    def visible(self) -> DataFrame:
        """The visible columns, unordered."""
        return self.df.select(*self.columns)

    def positioned(self) -> DataFrame:
        """Visible columns and `pos`, 0..n-1."""
        return self.densified().df.select(F.col(POS).alias("pos"), *self.columns)

    def rows(self) -> list[dict[str, Any]]:
        """Row dictionaries in order; for small grids."""
        return [r.asDict() for r in self.df.orderBy(POS).select(*self.columns).collect()]

    def column(self, name: str) -> list[Any]:
        """One column's values in order, repeats included; for small grids."""
        return [r[0] for r in self.df.orderBy(POS).select(name).collect()]

    def value(self, name: str) -> Any:
        """As `column`; a single row gives its value alone."""
        found = self.column(name)
        return found[0] if len(found) == 1 else found

    def lists(self) -> DataFrame:
        """One row that holds each column as a list in row order; for grids whose columns fit into a row."""
        held = F.sort_array(F.collect_list(F.struct(POS, *self.columns)))
        return self.df.agg(held.alias("__rows")).select(*(F.col(f"__rows.{c}").alias(c) for c in self.columns))

    # Folds of grids ----------------------------------------------------------------------------------------------

    @staticmethod
    def reduce(step: Callable[[Grid, Grid], Grid], grids: Sequence[Grid]) -> Grid:
        """Left fold whose first grid is the start."""
        if not grids:
            raise GridError("E106", "nothing to start from")
        return fold_left(step, grids)

    @staticmethod
    def sum(*grids: Grid) -> Grid:
        """Chained merges."""
        return Grid.reduce(Grid.merge, grids)

    @staticmethod
    def prod(*grids: Grid) -> Grid:
        """Chained products."""
        return Grid.reduce(Grid.product, grids)


def _sides(a: DataFrame, b: DataFrame, left: tuple[str, ...], right: tuple[str, ...]) -> tuple[DataFrame, DataFrame, list[str]]:
    named = lambda df, side, columns: df.select(F.col(POS).alias(f"__{side}_pos"), *(x for c in columns for x in (F.col(c).alias(f"__{side}_{c}"), F.col(_pk(c)).alias(f"__{side}_pk_{c}"))))
    return named(a, "l", left), named(b, "r", right), [c for c in left if c in right]


def _narrow(df: DataFrame) -> bool:
    """Whether a row's columns have a fixed width; sides with texts or lists are left to the optimiser's own bound of bytes."""
    return all(t in ("bigint", "int", "double", "float", "boolean", "date", "timestamp") or t.startswith("struct<src:bigint") for _, t in df.dtypes)


def _literal_type(values: Sequence[Any]) -> str:
    """One kind gives its type, numbers of both kinds floats, all else cells of mixed kinds."""
    kinds = {type(v) for v in values if v is not None}
    known = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    if not isinstance(values, cells.Mixed):
        if kinds == {int, float}:
            return "double"
        if len(kinds) <= 1 and kinds <= set(known):
            return known[kinds.pop()] if kinds else "string"
    if bad := [k.__name__ for k in kinds if k not in (*known, list, tuple, dict)]:
        raise GridError("E106", f"values of {bad} can't be cells")
    return cells.VARIANT


def _held(values: Sequence[Any], kind: str) -> Sequence[Any]:
    return [cells.literal(v) for v in values] if kind == cells.VARIANT else [float(v) if v is not None else v for v in values] if kind == "double" else values


def _held_type(kind: str) -> str:
    return "string" if kind == cells.VARIANT else kind


def _given(df: DataFrame, types: dict[str, str], rows: int) -> DataFrame:
    """A literal table: cells of mixed kinds, which come as text, as such, and few partitions, since products multiply them."""
    df = df.coalesce(max(1, rows // LITERAL_ROWS))
    return df.select(*(cells.from_literals(F.col(c)).alias(c) if types.get(c) == cells.VARIANT else F.col(c) for c in df.columns))
