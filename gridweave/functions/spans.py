"""Substitution by the spans of groups, for patterns whose groups nest, may be missing or repeat.

Spark's own functions know what a group matched but not where. Where that is needed, texts go through Arrow batches to a
matcher that says so; every other pattern stays with `substitute`'s built-in functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import Pattern
from .values import GridError


def portable(pattern: Pattern, source: str) -> str:
    """The pattern for the matcher; case that changes within it, and negated POSIX classes inside others, are refused."""
    body = pattern.regex.removeprefix("(?d)")
    start = "(?i)" if body.startswith("(?iu)") else ""
    body = body.removeprefix("(?iu)")
    if "(?iu)" in body or "(?-iu)" in body or "[:^" in source:
        raise GridError("E402", "groups can't be replaced by span where case folding changes within the pattern")
    return start + body.replace("\\z", "\\Z")


def replaced(text: str, pattern: object, values: list[str]) -> str:
    """Each group of each match replaced by its value; a group that took no part, or overlaps an earlier one, is an error."""
    out, last, found = [], 0, False
    for match in pattern.finditer(text):
        found, cursor = True, match.start()
        out.append(text[last:cursor])
        for group, value in enumerate(values, 1):
            start, end = match.span(group)
            if start < 0:
                raise GridError("E402", f"a match without group {group}")
            if start < cursor:
                raise GridError("E402", "groups overlap")
            out += [text[cursor:start], value]
            cursor = end
        out.append(text[cursor : match.end()])
        last = match.end()
    if not found:
        raise GridError("E402", "no match")
    return "".join([*out, text[last:]])


def substitute_spans(text: Column, pattern: Pattern, source: str, values: tuple[Column, ...]) -> Column:
    """`text` with its groups replaced; no match, or a null text or value, is an error when the rows are read."""
    matcher = portable(pattern, source)

    @F.arrow_udf("string")
    def run(texts: pa.Array, given: pa.Array) -> pa.Array:
        import regex

        compiled = regex.compile(matcher)
        columns = [given.field(i).to_pylist() for i in range(given.type.num_fields)]
        out = []
        for i, t in enumerate(texts.to_pylist()):
            parts = [c[i] for c in columns]
            if t is None or None in parts:
                raise GridError("E402", "no match, or no value, of a missing text")
            out.append(replaced(t, compiled, parts))
        return pa.array(out, pa.string())

    return run(text, F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
