"""Types of workpackages' values, found in the data: from maps of texts, or of cells, to a typed table per step.

One aggregate finds the keys of each step and the kinds of their values; whole numbers and floats of one key meet in
float, all other mixtures in text. What is collected is a row per step and key, which the program's names bound, not its
rows. Keys come in the order of their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import values as V
from ..functions.values import FLOAT, INT, GridError, check_names
from ..functions.positions import POS
from ..operators.extract import merged_type
from ..operators.grid import Grid

#: Keys of one step, which become columns.
MOST_KEYS = 10_000
_OF_CELLS = {"int": "bigint", "float": "double", "bool": "boolean"}


def value_kind(c: Column, kind: str = "string") -> Column:
    """bigint, double, boolean or string: of a cell its kind, of a text what it reads as; a missing value is text."""
    if kind == cells.VARIANT:
        found = cells.kind_of(c)
        return F.coalesce(*(F.when(found == name, given) for name, given in _OF_CELLS.items()), F.lit("string"))
    whole = c.rlike(INT) & c.try_cast("bigint").isNotNull()
    number = c.rlike(FLOAT) & (F.abs(c.try_cast("double")) < float("inf"))
    return F.when(whole, "bigint").when(number, "double").when(c.isin("true", "false"), "boolean").otherwise("string")


def value_kinds(work: DataFrame, values: str = "values", by: str = "step") -> DataFrame:
    """(by, key, kind, n): each key's type over all of its values, and how many those are."""
    kind = dict(work.dtypes)[values]
    inner = kind.removeprefix("map<string,").removesuffix(">")
    if not kind.startswith("map<string,") or inner not in ("string", cells.VARIANT):
        raise GridError("E106", f"values must be a map of texts or cells, not {kind}")
    entries = work.select(by, F.explode(values).alias("key", "value"))
    found = entries.groupBy(by, "key").agg(F.collect_set(value_kind(F.col("value"), inner)).alias("kinds"), F.count(F.lit(1)).alias("n"))
    return found.select(by, "key", merged_kind(F.col("kinds")).alias("kind"), "n")


def merged_kind(kinds: Column) -> Column:
    """As `merged_type`, of a list in a column."""
    numbers = F.forall(kinds, lambda k: k.isin("bigint", "double"))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).when(numbers, "double").otherwise("string")


def typed(work: DataFrame, types: Sequence[tuple[str, str]], keep: Sequence[str] = ("run_id", "row"), values: str = "values") -> DataFrame:
    """The columns `keep` and one of its type per key; a key that a row lacks is missing there."""
    titles = [*keep, *(k for k, _ in types)]
    if len(set(titles)) < len(titles):
        raise GridError("E413", f"columns named twice: {sorted({t for t in titles if titles.count(t) > 1})}")
    inner = dict(work.dtypes)[values].removeprefix("map<string,").removesuffix(">")
    return work.select(*keep, *(_parsed(F.try_element_at(values, F.lit(key)), inner, kind).alias(key) for key, kind in types))


def _parsed(c: Column, inner: str, kind: str) -> Column:
    if kind == "string":
        return F.when(c.isNotNull(), V.text_of(c, inner)) if inner == cells.VARIANT else c
    if kind == "boolean":
        return cells.as_bool(c) if inner == cells.VARIANT else c == "true"
    if inner == cells.VARIANT:
        return cells.as_int(c) if kind == "bigint" else cells.as_float(c)
    return V.to_int(c, "string") if kind == "bigint" else V.to_float(c, "string")


def typed_steps(work: DataFrame, keep: Sequence[str] = ("run_id", "row"), values: str = "values", by: str = "step") -> dict[str, DataFrame]:
    """A typed table per step; one pass over the work finds all types, the tables are read when they are used."""
    types: dict[str, list[tuple[str, str]]] = {}
    for r in value_kinds(work, values, by).orderBy(by, "key").collect():
        types.setdefault(r[by], []).append((r["key"], r["kind"]))
    if wide := [step for step, found in types.items() if len(found) > MOST_KEYS]:
        raise GridError("E106", f"{wide} have more than {MOST_KEYS} values a workpackage")
    return {step: typed(work.where(F.col(by).eqNullSafe(F.lit(step))), found, keep, values) for step, found in types.items()}


def grid_of_maps(rows: DataFrame, position: str, values: str = "values") -> Grid:
    """Row dictionaries, a map in each row, as a grid whose columns share one source, in the first row's order.

    One aggregate finds keys and types; no row reaches the driver but the first one's keys. `position` is 0..n-1. Rows whose
    keys differ, a missing map among them, are an error, as are more than MOST_KEYS; no rows give a grid without columns.
    """
    held = rows.select(F.col(position).cast("long").alias(POS), F.col(values).alias("__values"), F.lit("").alias("__by"))
    kinds = {r["key"]: r for r in value_kinds(held, "__values", "__by").limit(MOST_KEYS + 1).collect()}
    n = held.count()
    if any(r["n"] != n for r in kinds.values()):
        raise GridError("E106", "rows must have the same keys")
    if len(kinds) > MOST_KEYS:
        raise GridError("E106", f"more than {MOST_KEYS} columns")
    first = held.where(F.col(POS) == 0).select(F.map_keys("__values")).first() if kinds else None
    names = check_names(list(first[0]) if first else [])
    return Grid.scan(typed(held, [(k, kinds[k]["kind"]) for k in names], (POS,), "__values"), POS)._rows(n)


def type_over_steps(kinds: DataFrame, key: str) -> str:
    """One type of a key in all steps of `value_kinds`."""
    return merged_type([r["kind"] for r in kinds.where(F.col("key") == key).select("kind").distinct().collect()])
