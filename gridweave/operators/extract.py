"""Typed extraction: run patterns over texts, lay their matches side by side, one typed row per match."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import TYPES, Pattern, compile_pattern, translate
from ..functions.spans import substitute_spans
from ..functions.values import GridError

FINISHED = "FINISHED"


def matches(text: Column, pattern: Pattern, group: int) -> Column:
    """All values of one group, typed, in order of match; a group that took no part is missing unless it is text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern.regex), F.lit(group))
    kind, shape = TYPES[pattern.kinds[group - 1]]
    if shape is None:
        return found
    bad = lambda x: F.raise_error(F.concat(F.lit(f"not a {kind}: "), x)).cast(kind)
    # A float that overflows is as little a number as a whole one that does.
    fits = lambda x: F.when(F.abs(x) < float("inf"), x) if kind == "double" else x
    return F.transform(found, lambda x: F.when(x == "", F.lit(None).cast(kind)).otherwise(F.coalesce(fits(x.try_cast(kind)), bad(x))))


def titles(name: str, pattern: Pattern) -> list[str]:
    return [name] if len(pattern.kinds) == 1 else [f"{name}.{i}" for i in range(len(pattern.kinds))]


def extract(df: DataFrame, patterns: Mapping[str, str | tuple[str, str]], keep: Sequence[str] = (), text: str = "text") -> DataFrame:
    """Rows of `keep` columns and one column per group of each pattern.

    A pattern is its source, or a pair of text column and source. Without patterns each input row is one row; otherwise
    an input has as many rows as its most frequent pattern has matches, none if there are none; shorter columns are
    missing at the end. A pattern with several groups gives `name.0`, `name.1` and so on. The column `match_ix` counts
    an input's rows.
    """
    compiled = {n: (text, compile_pattern(p)) if isinstance(p, str) else (p[0], compile_pattern(p[1])) for n, p in patterns.items()}
    names = [t for n, (_, p) in compiled.items() for t in titles(n, p)]
    if doubled := {n for n in names if names.count(n) > 1 or n in keep}:
        raise GridError("E413", f"columns named twice: {sorted(doubled)}")
    kept = [F.col(f"`{c}`") for c in keep]
    if not compiled:
        return df.select(*kept, F.lit(0).alias("match_ix"))
    arrays = [matches(F.col(column), p, g + 1).alias(f"__{i}_{g}") for i, (column, p) in enumerate(compiled.values()) for g in range(len(p.kinds))]
    flat = [f"__{i}_{g}" for i, (_, p) in enumerate(compiled.values()) for g in range(len(p.kinds))]
    zipped = df.select(*kept, *arrays).select(*kept, F.posexplode(F.arrays_zip(*flat)).alias("match_ix", "__row"))
    return zipped.select(*kept, "match_ix", *(F.col(f"__row.{c}").alias(n) for c, n in zip(flat, names, strict=True)))


def extract_weak(work: DataFrame, patterns: Mapping[str, str], key: str, keep: Sequence[str] = (), text: str = "text", status: str = "status", title: str = "run_status") -> DataFrame:
    """As `extract`, with the status as column `title`: unfinished work gives one row in which all but the key is missing.

    Finished work without matches gives no row.
    """
    if title in keep or title in patterns:
        raise GridError("E413", f"the column {title} is taken")
    finished = F.coalesce(F.col(status) == FINISHED, F.lit(False))
    rows = extract(work.where(finished), patterns, [key, *keep], text).withColumn(title, F.lit(FINISHED))
    open_work = work.where(~finished).select(F.col(key), F.lit(0).alias("match_ix"), F.col(status).alias(title))
    return rows.unionByName(open_work, allowMissingColumns=True)


def extract_strict(work: DataFrame, patterns: Mapping[str, str], key: str, keep: Sequence[str] = (), text: str = "text", status: str = "status") -> DataFrame:
    """As `extract`; any unfinished work is an error when the rows are read."""
    finished = F.when(F.col(status).eqNullSafe(FINISHED), True).otherwise(F.raise_error(F.concat(F.lit("unfinished work: "), F.col(key).cast("string"))).cast("boolean"))
    return extract(work.where(finished), patterns, [key, *keep], text)


def analyse(
    work: DataFrame, helpers: Sequence[tuple[str, str | tuple[str, str]]], columns: Sequence[str], values: Sequence[str] = (), key: str = "run_id", text: str = "text"
) -> DataFrame:
    """The key and `columns` in their order, each the name of a helper pattern or of a value of the work.

    Patterns that no column names aren't run. Of two helpers with one name (E414), a helper with a value's name (E413), a
    column that is neither (E415) or is named twice (E413) the plan is refused.
    """
    names = [n for n, _ in helpers]
    if doubled := sorted({n for n in names if names.count(n) > 1}):
        raise GridError("E414", f"helpers named twice: {doubled}")
    if taken := [n for n in names if n in values or n == key]:
        raise GridError("E413", f"helpers named as values: {taken}")
    if unknown := [c for c in columns if c not in names and c not in values]:
        raise GridError("E415", f"unknown columns {unknown}")
    if doubled := sorted({c for c in columns if columns.count(c) > 1}):
        raise GridError("E413", f"columns named twice: {doubled}")
    used = {n: p for n, p in helpers if n in columns}
    rows = extract(work, used, [key, *(c for c in columns if c in values)], text)
    shown = [t for c in columns for t in (titles(c, compile_pattern(used[c] if isinstance(used[c], str) else used[c][1])) if c in used else [c])]
    return rows.select(key, "match_ix", *(F.col(f"`{t}`") for t in shown))


def summary(outputs: Mapping[str, DataFrame]) -> DataFrame:
    """(output, n_rows, n_columns) of each named result."""
    rows = [df.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")) for name, df in outputs.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def inline(*sources: str) -> dict[str, str]:
    """Patterns without names: each has its own text as title."""
    return {s: s for s in sources}


def merged_type(kinds: Sequence[str]) -> str:
    """One type for a column over all steps: whole and floating numbers meet in float, all else in text."""
    found = set(kinds)
    return found.pop() if len(found) == 1 else "double" if found <= {"bigint", "double", "int"} else "string"


def substitute(text: Column, pattern: str, *values: Column) -> Column:
    """Replace in every match the whole, if the pattern has no groups, or each group by its value, taken literally.

    No match, or a null text, is an error when the rows are read. There must be as many values as groups, or one without
    groups. Groups that stand side by side are replaced by built-in functions; where one lies in another, is optional,
    repeated or one of several choices, texts go by Arrow batches to a matcher that knows the groups' places, and a match
    in which groups overlap, or one takes no part, is an error when the rows are read.
    """
    compiled = translate(pattern)
    if len(values) != max(1, len(compiled.kinds)):
        raise GridError("E402", f"{max(1, len(compiled.kinds))} values are needed, not {len(values)}")
    hit = F.when(text.rlike(compiled.regex), text).otherwise(F.raise_error(F.lit(f"no match of {pattern}")).cast("string"))
    quoted = [F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), r"\$", r"\\\$") for v in values]
    if not compiled.kinds:
        return F.regexp_replace(hit, F.lit(compiled.regex), quoted[0])
    if compiled.pieces is None:
        return substitute_spans(text, compiled, pattern, values)
    # What lies between the groups is captured instead of them, under names that a digit in a value can't run into.
    names = iter(range(len(quoted) + 1))
    between = "(?d)" + "".join(f"(?:{piece[1:-1]})" if group else f"(?<g{next(names)}>{piece})" for piece, group in compiled.pieces)
    parts = [x for i, v in enumerate(quoted) for x in (F.lit(f"${{g{i}}}"), v)]
    return F.regexp_replace(hit, F.lit(between), F.concat(*parts, F.lit(f"${{g{len(quoted)}}}")))


def substitution_count(text: Column, pattern: str) -> Column:
    """Matches of a substitution's pattern; more than one deserves a warning."""
    return F.regexp_count(text, F.lit(translate(pattern).regex)).cast("bigint")


def substitute_all(text: Column, rules: Sequence[tuple[str, Sequence[Column]]]) -> Column:
    """The rules one after the other, each on what the last one left."""
    for pattern, values in rules:
        text = substitute(text, pattern, *values)
    return text
