"""Workplans: a DAG of steps whose rows are parents' rows times the rows of imported grids.

A step's state is a DataFrame with `row` (dense), its visible columns, and for each source grid it has drawn from the
number of the set of that grid's positions it still may use (`__set_<source>`). When a step imports a source that its
parents have used, states are joined with the choices that their set shares a position with, never by a filtered product.

What a projection of a product leaves are boxes: all positions with certain rows of some factors. A box is a number, its
first position; boxes meet where the rows of the factors that both fix are the same, so no table of positions is made.
Sets of other grids lie apart from the states that share them, in rows of fixed size: 64 positions as the bits of a word,
and meet the choices' sets word by word. Parents whose positions have nothing in common still meet; only a later import
finds no row then.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cache, cached_property, partial, reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.positions import POS, densify
from ..functions.shared import settled
from ..functions.values import GridError, check_names, text, text_of
from ..operators.grid import Grid, _pk

#: Rows and bytes of a product's right side that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Numbers of sets stay below this; pairs of sets that would go beyond it are numbered anew.
MOST_SETS = 1 << 62
#: Positions in a word.
WORD = 64


@dataclass(frozen=True)
class Import:
    """Columns of a named grid; all of them (None) or a projection. An alias shows a single column under another name."""

    source: str
    grid: Grid
    columns: tuple[str, ...] | None = None
    alias: str | None = None

    def shown(self) -> dict[str, str]:
        """The grid's columns by the names they show."""
        names = list(dict.fromkeys(self.columns or self.grid.columns))
        if unknown := [c for c in names if c not in self.grid.columns]:
            raise GridError("E021", f"{self.source} has no columns {unknown}")
        if self.alias is None:
            return {c: c for c in names}
        if len(names) != 1:
            raise GridError("E023", f"the alias {self.alias} stands for one column, not for {len(names)}")
        return {check_names([self.alias])[0]: names[0]}


@dataclass(frozen=True)
class Step:
    name: str
    imports: tuple[Import, ...] = ()
    after: tuple[str, ...] = ()
    #: How many of its rows a caller may run at a time, 0 for any number; a plan only checks it.
    nproc: int = 0


def as_grid(spark: SparkSession, value: object, name: str = "value") -> Grid:
    """What a step can import: a grid as it is, a dictionary as columns, a list as rows of one column, a scalar as one row.

    Items that are no scalars enter as their text (W314). Anything else is an error.
    """
    if isinstance(value, Grid):
        return value
    if isinstance(value, dict):
        return Grid.table(spark, **value)
    if value is None or callable(value):
        raise GridError("E420", f"{name} can't be imported")
    if isinstance(value, (list, tuple, range)):
        entered = Grid.table(spark, **{name: [x if isinstance(x, (bool, int, float, str)) else text(x) for x in value]})
        odd = {type(x) for x in value if not isinstance(x, (bool, int, float, str))}
        return replace(entered, warnings=(*entered.warnings, *("W314" for _ in odd)), bare=True)
    return replace(Grid.table(spark, **{name: value}), bare=True)


@dataclass(frozen=True)
class Sets:
    """Sets of a source's positions: (set, word, bits), a row for each 64 positions of which the set has some."""

    made: Callable[[], DataFrame]
    #: All numbers are below it.
    span: Callable[[], int]

    @cached_property
    def words(self) -> DataFrame:
        return self.made()

    def met(self, other: Sets) -> Sets:
        """The intersection of each set with each of `other`, numbered by both; empty ones have no words."""
        return Sets(lambda: self._met(other), lambda: self.span() * other.span())

    def _met(self, other: Sets) -> DataFrame:
        theirs = other.words.select(F.col("set").alias("__other"), "word", F.col("bits").alias("__bits"))
        both = self.words.join(theirs, "word").withColumn("bits", F.col("bits").bitwiseAND(F.col("__bits"))).where("bits <> 0")
        return both.select((F.col("set") * other.span() + F.col("__other")).alias("set"), "word", "bits")

    def pair(self, mine: Column, theirs: Column, other: Sets) -> Column:
        """The number of the intersection of two sets."""
        return mine * other.span() + theirs

    def of_choice(self, choice: Column) -> Column:
        """The number of a choice's set."""
        return choice

    def sized(self, rows: DataFrame, column: str) -> DataFrame:
        """`rows` with `positions`: how many the set has whose number the column holds, which goes."""
        sizes = self.words.groupBy(F.col("set").alias("__size_of")).agg(F.sum(F.bit_count("bits").cast("long")).alias("positions"))
        joined = rows.join(sizes, F.col(column) == F.col("__size_of"), "left").drop("__size_of", column)
        return joined.withColumn("positions", F.coalesce("positions", F.lit(0)))


@dataclass(frozen=True)
class Boxes(Sets):
    """Sets of a product's positions that hold one row of each factor in `fixed` and all rows of the others.

    A position's digits are the rows of the factors. A set's number is its first position, whose other digits are zero;
    the number of all positions stands for the empty set. Only where boxes meet sets of another kind are words made.
    """

    grid: Grid
    fixed: frozenset[int]
    #: Some sets may be empty.
    hollow: bool = False

    @staticmethod
    def of(grid: Grid, fixed: frozenset[int], hollow: bool = False) -> Boxes:
        made = lambda: _words(grid.df.select(out.digits(F.col(POS), fixed).alias("set"), POS))
        out = Boxes(made, lambda: grid.length() + 1, grid, fixed, hollow)
        return out

    def alike(self, other: Sets) -> bool:
        return isinstance(other, Boxes) and other.grid is self.grid

    def size(self, factors: frozenset[int]) -> int:
        return prod(self.grid.factors[i].length() for i in factors)

    def stride(self, i: int) -> int:
        """Positions that a factor's row takes up."""
        return max(1, prod(f.length() for f in self.grid.factors[i + 1 :]))

    def digits(self, at: Column, factors: frozenset[int]) -> Column:
        """The position with these factors' rows and the first rows of the others."""
        out = F.lit(0).cast("long")
        for i in sorted(factors):
            out = out + self.digit(at, i) * self.stride(i)
        return out

    def digit(self, at: Column, i: int) -> Column:
        return _div(at, self.stride(i)) % max(1, self.grid.factors[i].length())

    def rank(self, at: Column, factors: frozenset[int]) -> Column:
        """The number of a set among those that differ in these factors' rows, in the order of their positions."""
        out = F.lit(0).cast("long")
        for i in sorted(factors):
            out = out * self.grid.factors[i].length() + self.digit(at, i)
        return out

    def of_choice(self, choice: Column) -> Column:
        out, below = F.lit(0).cast("long"), 1
        for i in sorted(self.fixed, reverse=True):
            n = max(1, self.grid.factors[i].length())
            out, below = out + _div(choice, below) % n * self.stride(i), below * n
        return out

    def choices(self, cells: Mapping[str, str]) -> DataFrame:
        """(choice, cells) of each set; cells are given as name and column."""
        out = at = None
        for i in sorted(self.fixed):
            factor = self.grid.factors[i]
            part = factor.df.select(F.col(POS).alias(f"__at{i}"), *(F.col(c).alias(name) for name, c in cells.items() if c in factor.columns))
            if out is None:
                out, at = part, F.col(f"__at{i}")
            else:
                out = out.crossJoin(_hinted(part, _measured(part)) if factor.length() <= BROADCAST_ROWS else part)
                at = at * factor.length() + F.col(f"__at{i}")
        return out.select(at.alias("__choice"), *cells)

    def met(self, other: Sets) -> Sets:
        if not self.alike(other):
            return super().met(other)
        return Boxes.of(self.grid, self.fixed | other.fixed, self.hollow or other.hollow or bool(self.fixed & other.fixed))

    def pair(self, mine: Column, theirs: Column, other: Sets) -> Column:
        if not self.alike(other):
            return super().pair(mine, theirs, other)
        common, n = self.fixed & other.fixed, self.grid.length()
        met = (mine < n) & (theirs < n) & (self.digits(mine, common) == self.digits(theirs, common))
        return F.when(met, mine + self.digits(theirs, other.fixed - self.fixed)).otherwise(F.lit(n).cast("long"))

    def sized(self, rows: DataFrame, column: str) -> DataFrame:
        n = F.lit(self.size(frozenset(range(len(self.grid.factors))) - self.fixed)).cast("long")
        return rows.withColumn("positions", F.when(F.col(column) < self.grid.length(), n).otherwise(F.lit(0).cast("long")) if self.hollow else n).drop(column)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


@dataclass
class Plan:
    steps: dict[str, Step]
    order: list[str]
    states: dict[str, DataFrame] = field(default_factory=dict)
    columns: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)  # visible column -> source and its column
    sets: dict[str, dict[str, Sets]] = field(default_factory=dict)  # step -> source -> sets of positions that its rows name
    bare: set[str] = field(default_factory=set)  # sources that are a scalar or a list under its own name
    analyses: dict[str, str] = field(default_factory=dict)  # analysis -> the step it reads
    sizes: dict[str, Callable[[], int]] = field(default_factory=dict)  # rows of a step, counted once where they are needed


def topological(steps: Sequence[Step]) -> list[str]:
    """Parents first, else in the order given."""
    known = {s.name: s for s in steps}
    if len(known) < len(steps):
        raise GridError("E211", "duplicate step")
    if missing := [d for s in steps for d in s.after if d not in known]:
        raise GridError("E212", f"unknown dependency {missing}")
    if negative := [s.name for s in steps if s.nproc < 0]:
        raise GridError("E219", f"negative nproc in {negative}")
    done: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise GridError("E213", f"cycle {' -> '.join((*path, name))}")
        if name not in done:
            for d in known[name].after:
                visit(d, (*path, name))
            done.append(name)

    for s in steps:
        visit(s.name, ())
    return done


def _choices(imported: Import, inherited: set[str]) -> tuple[DataFrame, list[str], DataFrame | Boxes]:
    """(choice, columns) and the choices' positions, as boxes or words: one choice per row of a full import, or per
    distinct source rows of a projection.
    """
    grid, shown = imported.grid.densified(), imported.shown()
    fresh = {name: c for name, c in shown.items() if name not in inherited}
    projected = imported.columns is not None or len(fresh) < len(shown)
    fixed = frozenset(i for i, f in enumerate(grid.factors or ()) if not projected or set(fresh.values()) & set(f.columns))
    if fixed:
        boxes = Boxes.of(grid, fixed)
        return boxes.choices(fresh), list(fresh), boxes
    if not projected or imported.grid.row_keyed is not None:
        cells = (F.col(c).alias(name) for name, c in fresh.items())
        return grid.df.select(F.col(POS).alias("__choice"), *cells), list(fresh), _words(grid.df.select(F.col(POS).alias("set"), POS))
    keys = [_pk(c) for c in fresh.values()]
    firsts = grid.df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c).alias(name) for name, c in fresh.items())), POS).alias("__first"), F.min(POS).alias(POS))
    chosen = settled(densify(firsts))  # read for the choices, for their positions and by each import that follows
    named = chosen.select(F.col(POS).alias("__choice"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    drawn = grid.df.select(POS, *keys).join(named, same).select(F.col("__choice").alias("set"), POS)
    return chosen.select(F.col(POS).alias("__choice"), *(F.col(f"__first.{name}").alias(name) for name in fresh)), list(fresh), _words(drawn)


def _words(drawn: DataFrame) -> DataFrame:
    """(set, word, bits) of rows of a set's number and a position; a set's words are made where the rows lie and united."""
    bit = F.expr(f"shiftleft(1L, cast({POS} % {WORD} as int))")
    return drawn.groupBy("set", F.floor(F.col(POS) / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _origins(imported: Import) -> dict[str, tuple[str, str]]:
    return {name: (imported.source, c) for name, c in imported.shown().items()}


def _agreed(step: Step, columns: dict[str, tuple[str, str]], more: dict[str, tuple[str, str]]) -> set[str]:
    """The names that both hold; each must stand for the same column of the same source."""
    if clash := [c for c in more if columns.get(c, more[c]) != more[c]]:
        raise GridError("E214", f"{clash} of {step.name} come from different sources")
    return set(columns) & set(more)


def _measured(df: DataFrame, rows: int | None = None) -> tuple[int, int]:
    """Rows and bytes, the latter by the lengths of texts and lists; known to be too many rows, they aren't read."""
    if rows is not None and rows > BROADCAST_ROWS:
        return rows, 0
    width = F.lit(0)
    for c, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else 8 * F.size(c) if kind.startswith("array") else F.lit(8))
    return tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width.cast("long")), F.lit(0))).first())


def _crossed(state: DataFrame, rows: int | None, choices: DataFrame, measure: tuple[int, int]) -> DataFrame:
    """Their product; where the choices are too many, states of a known number are broadcast within the same bounds."""
    if measure[0] > BROADCAST_ROWS and rows is not None and rows <= BROADCAST_ROWS:
        return _hinted(state, _measured(state)).crossJoin(choices)
    return state.crossJoin(_hinted(choices, measure))


def _hinted(df: DataFrame, measure: tuple[int, int]) -> DataFrame:
    """Broadcast within the bounds, so that the other side keeps its partitions; beyond them it is left to the optimiser."""
    n, size = measure
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _set(source: str) -> str:
    """Column of the set of the source's positions that a row may use."""
    return f"__set_{source}"


def _from(parent: str) -> str:
    """Column of the parent's row that a row comes from."""
    return f"__from_{parent}"


def _inherit(plan: Plan, step: Step) -> tuple[DataFrame | None, dict[str, tuple[str, str]], dict[str, Sets]]:
    """Product of the parents' states; columns that they share must agree, or reading raises; sets of positions intersect."""
    state, columns, sets = None, {}, {}
    for parent in dict.fromkeys(step.after):
        own, drawn = plan.columns[parent], plan.sets[parent]
        mine = plan.states[parent].select(F.col("row").alias("__row"), F.col("row").alias(_from(parent)), *own, *map(_set, drawn))
        if state is None:
            state, columns, sets = mine, dict(own), dict(drawn)
            continue
        _agreed(step, columns, own)
        renamed = mine.select(*(F.col(c).alias(f"__r_{c}") for c in mine.columns))
        small = plan.sizes[parent]() <= BROADCAST_ROWS
        joined = state.crossJoin(_hinted(renamed, _measured(mine)) if small else renamed)  # a product by definition
        shared = [c for c in state.columns if c in mine.columns and c != "__row"]
        both = {_set(source): source for source in drawn if source in sets}
        agree = F.lit(True)
        for c in shared:
            if c not in both:
                agree = agree & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        # One condition, so that no part of it can hide a difference.
        failed = F.raise_error(F.lit(f"E500: parents of {step.name} differ in what they share")).cast("boolean")
        joined = joined.where(F.when(agree, True).otherwise(failed))
        for source in both.values():
            joined, sets[source] = _compact(joined, _set(source), sets[source], drawn[source])
        merged = [sets[both[c]].pair(F.col(c), F.col(f"__r_{c}"), drawn[both[c]]).alias(c) if c in both else F.col(c) for c in state.columns if c != "__row"]
        extra = [F.col(f"__r_{c}").alias(c) for c in mine.columns if c != "__row" and c not in state.columns]
        state = joined.select((F.col("__row") * plan.sizes[parent]() + F.col("__r___row")).alias("__row"), *merged, *extra)
        columns |= own
        sets |= {source: sets[source].met(found) if source in sets else found for source, found in drawn.items()}
    return state, columns, sets


def _compact(state: DataFrame, column: str, sets: Sets, other: Sets) -> tuple[DataFrame, Sets]:
    """State and sets as they are, or with sets numbered anew where pairs with `other` sets would run out of numbers.

    All empty sets become one then, whose number no word has.
    """
    if isinstance(sets, Boxes) and sets.alike(other) or sets.span() * other.span() < MOST_SETS:
        return state, sets
    numbers = settled(densify(sets.words.select("set").distinct().select(F.col("set").alias("__old"), F.col("set").alias(POS))))
    n = numbers.count()
    words = sets.words.join(numbers, F.col("set") == F.col("__old")).select(F.col(POS).alias("set"), "word", "bits")
    renamed = state.join(numbers.withColumnRenamed(POS, "__new"), F.col(column) == F.col("__old"), "left")
    return renamed.withColumn(column, F.coalesce("__new", F.lit(n).cast("long"))).drop("__old", "__new"), Sets(cache(partial(settled, words)), lambda: n + 1)


def build(spark_grids: Sequence[Step], analyses: Mapping[str, str] | None = None) -> Plan:
    """Expand all steps. `analyses` name the steps that they read.

    Rows of products are numbered by arithmetic: a state holds its parents' plans once, however long the chain, and
    only imported choices are counted. A step that imports a source anew has gaps to close, unless its sets are boxes of
    which none is empty, so its rows are computed here, once, and written as a table; all else is computed when a state is
    read.
    """
    plan = Plan({s.name: s for s in spark_grids}, topological(spark_grids), analyses=dict(analyses or {}))
    if unknown := [a for a, step in plan.analyses.items() if step not in plan.steps]:
        raise GridError("E410", f"{unknown} analyse unknown steps")
    for name in plan.order:
        step = plan.steps[name]
        state, columns, sets = _inherit(plan, step)
        position = ["__row"] if state is not None else []
        sizes = [plan.sizes[p] for p in dict.fromkeys(step.after)]
        counts: dict[str, Callable[[], int]] = {}
        gaps = False
        # Only what parents have drawn binds an import; imports of one step meet freely.
        bound = set(sets)
        for k, imported in enumerate(step.imports):
            origins = _origins(imported)
            if imported.grid.bare and imported.grid.columns == (imported.source.rsplit(".", 1)[-1],):
                plan.bare.add(imported.source)
            choices, fresh, found = _choices(imported, _agreed(step, columns, origins))
            boxes = isinstance(found, Boxes)
            choice = f"__c{k}"
            choices = choices.withColumnRenamed("__choice", choice)
            measure = cache(partial(_measured, choices, found.size(found.fixed) if boxes else None))
            rows = None if gaps else _product(*sizes, *counts.values())
            counts[choice] = lambda measure=measure: measure()[0]
            source, held, offered = imported.source, _set(imported.source), found if boxes else Sets(lambda words=found: words, counts[choice])
            if state is None:
                state, sets[source] = choices.withColumn(held, offered.of_choice(F.col(choice))), offered
            elif source in bound:
                state, known = _compact(state, held, sets[source], offered)
                if boxes and found.alike(known):
                    more = found.fixed - known.fixed
                    state, sets[source] = _boxed(state, rows and rows(), choices, known, found, held, choice, measure()), Boxes.of(found.grid, known.fixed | found.fixed)
                    counts[choice], gaps = lambda boxes=found, more=more: boxes.size(more), gaps or known.hollow
                else:
                    state, sets[source], gaps = *_lineage(state, choices, known, offered, held, choice, measure()), True
            elif source in sets:
                state, known = _compact(state, held, sets[source], offered)
                state = _crossed(state, rows and rows(), choices, measure()).withColumn(held, known.pair(F.col(held), offered.of_choice(F.col(choice)), offered))
                sets[source] = known.met(offered)
            else:
                state, sets[source] = _crossed(state, rows and rows(), choices, measure()).withColumn(held, offered.of_choice(F.col(choice))), offered
            position.append(f"__c{k}")
            columns |= {c: origins[c] for c in fresh}
        if state is None:
            raise GridError("E420", f"step {name} has neither imports nor parents")
        state = settled(state) if gaps else state
        placed = _numbered(state, position, counts)
        plan.states[name] = (densify(placed) if gaps else placed).withColumnRenamed(POS, "row")
        plan.sizes[name] = cache(state.count) if gaps else _product(*sizes, *counts.values())
        plan.columns[name], plan.sets[name] = columns, sets
    return plan


def _lineage(state: DataFrame, choices: DataFrame, known: Sets, offered: Sets, name: str, choice: str, measure: tuple[int, int]) -> tuple[DataFrame, Sets]:
    """Join each state with the choices that its set shares a position with. Sets meet choices, not states positions."""
    met = known.met(offered)
    words = settled(met.words)
    n = offered.span()
    pairs = words.select("set").distinct().select(F.floor(F.col("set") / n).alias("__old"), (F.col("set") % n).alias("__pick"), F.col("set").alias("__met"))
    offers = pairs.join(_hinted(choices, measure), F.col("__pick") == F.col(choice))
    joined = state.join(offers, F.col(name) == F.col("__old")).withColumn(name, F.col("__met"))
    return joined.drop("__old", "__pick", "__met"), Sets(lambda: words, met.span)


def _boxed(state: DataFrame, rows: int | None, choices: DataFrame, known: Boxes, offered: Boxes, name: str, choice: str, measure: tuple[int, int]) -> DataFrame:
    """As `_lineage`, for boxes of one grid: a join on the rows of the factors that both fix, a product where none is.

    A choice is numbered among those that its state meets, of which each has as many.
    """
    common, more = known.fixed & offered.fixed, offered.fixed - known.fixed
    state = state.where(F.col(name) < known.grid.length()) if known.hollow else state
    offers = choices.withColumn("__pick", offered.of_choice(F.col(choice)))
    if common:
        offers = offers.withColumn("__common", offered.digits(F.col("__pick"), common))
        joined = state.join(_hinted(offers, measure), known.digits(F.col(name), common) == F.col("__common")).drop("__common")
    else:
        joined = _crossed(state, rows, offers, measure)
    pick = F.col("__pick")
    return joined.withColumn(name, F.col(name) + offered.digits(pick, more)).withColumn(choice, offered.rank(pick, more)).drop("__pick")


def with_drawn(plan: Plan, step: str, source: str) -> DataFrame:
    """A step's state with the column `positions` of `drawn`."""
    held = plan.states[step].withColumn("__held", F.col(_set(source)))
    return plan.sets[step][source].sized(held, "__held")


def drawn(plan: Plan, step: str, source: str) -> DataFrame:
    """(row, positions) of a step: how many positions of the source each of its rows may still use."""
    return with_drawn(plan, step, source).select("row", "positions")


def _numbered(state: DataFrame, position: list[str], counts: Mapping[str, Callable[[], int]]) -> DataFrame:
    """Positions in the order of parents and choices; they have gaps only where choices were left out."""
    at = F.col(position[0])
    for p in position[1:]:
        at = at * counts[p]() + F.col(p)
    return state.withColumn(POS, at.cast("long")).drop(*position)


def _product(*sizes: Callable[[], int]) -> Callable[[], int]:
    return cache(lambda: prod(size() for size in sizes))


def ancestors(plan: Plan, targets: Sequence[str]) -> set[str]:
    """The targets and all they depend on; "*" stands for every step."""
    if "*" in targets:
        return set(plan.order)
    found, todo = set(), list(targets)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo += plan.steps[name].after
    return found


def selected(plan: Plan, targets: Sequence[str] = ("*",)) -> tuple[list[str], list[str]]:
    """The steps, in order, and analyses that a run of the targets needs.

    "*" stands for all of both; a step brings what it depends on, an analysis, which must be named, also its step.
    """
    if "*" in targets:
        return list(plan.order), list(plan.analyses)
    if unknown := [t for t in targets if t not in plan.steps and t not in plan.analyses]:
        raise GridError("E212", f"unknown targets {unknown}")
    named = [a for a in plan.analyses if a in targets]
    needed = ancestors(plan, [*(t for t in targets if t in plan.steps), *(plan.analyses[a] for a in named)])
    return [n for n in plan.order if n in needed], named


def limit_targets(plan: Plan) -> list[str]:
    """The steps that a limit counts: those that are analysed, or else the terminal ones."""
    read = set(plan.analyses.values())
    return [n for n in plan.order if n in read] or terminal(plan)


def terminal(plan: Plan) -> list[str]:
    used = {d for s in plan.steps.values() for d in s.after}
    return [n for n in plan.order if n not in used]


def limited(plan: Plan, step: str, n: int) -> DataFrame:
    """The first n rows of a target step."""
    return plan.states[step].where(F.col("row") < n)


def limited_parents(plan: Plan, step: str, n: int) -> dict[str, DataFrame]:
    """For a limited step and each of its ancestors, the rows that the kept rows come from; numbers keep their gaps."""
    kept, chosen = {step: limited(plan, step, n)}, ancestors(plan, [step])
    for name in reversed([x for x in plan.order if x in chosen]):
        for parent in dict.fromkeys(plan.steps[name].after):
            used = kept[name].select(F.col(_from(parent)).alias("row")).distinct()
            needed = plan.states[parent].join(used, "row", "left_semi")
            kept[parent] = kept[parent].union(needed).dropDuplicates(["row"]) if parent in kept else needed
    return kept


def parameters(plan: Plan, steps: Sequence[str] = ("*",), benchmark: str | None = None) -> DataFrame:
    """One row per workpackage: its values as text, `row` and the step, and the benchmark's name if one is given.

    A value's column is `source.column`, whatever its alias, and the bare source for a scalar or list that is imported
    under its own name. Columns that no workpackage has, since their steps have no rows, are left out.
    """
    chosen = ancestors(plan, steps)
    filled = [n for n in plan.order if n in chosen and plan.sizes[n]()]
    frames = []
    for n in filled or [n for n in plan.order if n in chosen]:
        kinds = dict(plan.states[n].dtypes)
        titled = {source if source in plan.bare else f"{source}.{c}": name for name, (source, c) in plan.columns[n].items()} if filled else {}
        cells = (text_of(F.col(name), _shown(kinds[name])).alias(title) for title, name in titled.items())
        frames.append(plan.states[n].select(*cells, "row", F.lit(n).alias("step")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    named = [] if benchmark is None else [F.lit(benchmark).alias("benchmark")]
    return out.select(*named, *(F.col(f"`{c}`") for c in out.columns if c not in ("row", "step")), "row", "step")


def parameters_of(plans: Mapping[str, Plan], steps: Sequence[str] = ("*",)) -> DataFrame:
    """The parameter tables of several benchmarks, one below the other."""
    frames = [parameters(plan, steps, name) for name, plan in plans.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select("benchmark", *(F.col(f"`{c}`") for c in out.columns if c not in ("benchmark", "row", "step")), "row", "step")


def _shown(kind: str) -> str:
    return {"float": "double"}.get(kind, kind)
