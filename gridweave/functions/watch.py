"""Warnings as results: counted in the pass that computes the rows, by Spark's observed metrics.

W101 is known when a plan is made and stands in a grid's `warnings`, as does W314, a value that entered as its text. W102,
whole numbers that wrapped, depends on the rows: a `Watch` counts the rows that meet it while some action reads them. It
counts rows as they are computed: a row that is computed twice, as when a global sort samples its input first or a lost
executor's work is redone, counts twice, and `shares` stays the same.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


_ROWS = "rows"


class Watch:
    """Counts warnings of all frames it has observed."""

    def __init__(self) -> None:
        self._seen: list[Observation] = []

    def observed(self, df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
        """`df`, whose first action also counts, per code, the rows that meet the condition."""
        seen = Observation()
        self._seen.append(seen)
        return df.observe(seen, F.count(F.lit(1)).alias(_ROWS), *(F.count_if(F.coalesce(c, F.lit(False))).alias(code) for code, c in conditions.items()))

    def counts(self) -> dict[str, int]:
        """Rows per code; waits for the first action on each observed frame, which must have been started."""
        total: Counter[str] = Counter()
        for seen in self._seen:
            total.update(seen.get)
        return {code: n for code, n in total.items() if n and code != _ROWS}

    def shares(self) -> dict[str, float]:
        """As `counts`, over the rows computed."""
        rows = sum(seen.get[_ROWS] for seen in self._seen)
        return {code: n / rows for code, n in self.counts().items()}
