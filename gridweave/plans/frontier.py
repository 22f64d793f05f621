"""Blocked and ready workpackages, from status records and the rows that each row comes from.

A workpackage whose step failed blocks all that come from it, directly or through others; one that isn't done is ready
when all that it comes from are finished. Blocking spreads along the rows of the plan's steps, parents first: each step is
one round, in which the rows that meet a blocked or failed parent are found by a join, settled in the shared folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import settled
from .workplan import Plan, _from

#: Statuses that block what comes after, and those that blocking leaves as they are.
FAILED, FIXED, OPEN = ("ERROR", "BLOCKED"), ("FINISHED", "RUNNING", "ERROR", "BLOCKED"), ("NOTSTARTED", "INTERRUPTED")


def edges(plan: Plan, steps: Sequence[str] | None = None) -> dict[str, dict[str, DataFrame]]:
    """step -> parent -> (row, parent_row): the row of each parent that a row comes from."""
    chosen = plan.order if steps is None else [s for s in plan.order if s in steps]
    return {s: {p: plan.states[s].select("row", F.col(_from(p)).alias("parent_row")) for p in dict.fromkeys(plan.steps[s].after)} for s in chosen}


def _of(records: DataFrame, step: str) -> DataFrame:
    return records.where(F.col("step") == step).select("row", "status")


def resolved(records: DataFrame, after: Mapping[str, Mapping[str, DataFrame]]) -> DataFrame:
    """(step, row, status, ready) of all records, one a workpackage: what blocking makes of them, and which may start.

    `after` gives, parents before children, each step's parents with the rows that its rows come from. A failed or blocked
    parent blocks rows that are open; rows without a record, and records of steps that aren't named, stay out. A parent
    row without a record isn't finished.
    """
    done: dict[str, DataFrame] = {}
    for step, parents in after.items():
        own = _of(records, step).withColumn("__bad", F.lit(False)).withColumn("__waits", F.lit(False))
        for parent, pairs in parents.items():
            theirs = done[parent].select(F.col("row").alias("__parent"), F.col("status").alias("__theirs"))
            met = pairs.join(theirs, F.col("parent_row") == F.col("__parent"), "left")
            # A row may come from several rows of a parent, so what they say is summed up first.
            said = met.groupBy(F.col("row").alias("__row")).agg(
                F.bool_or(F.coalesce(F.col("__theirs").isin(*FAILED), F.lit(False))).alias("__any_bad"),
                F.bool_and(F.coalesce(F.col("__theirs") == "FINISHED", F.lit(False))).alias("__all_done"),
            )
            own = own.join(said, F.col("row") == F.col("__row"), "left").select(
                "row", "status", (F.col("__bad") | F.coalesce("__any_bad", F.lit(False))).alias("__bad"), (F.col("__waits") | ~F.coalesce("__all_done", F.lit(True))).alias("__waits")
            )
        done[step] = settled(own.select("row", F.when(F.col("status").isin(*OPEN) & F.col("__bad"), "BLOCKED").otherwise(F.col("status")).alias("status"), _ready().alias("ready")))
    frames = [df.select(F.lit(step).alias("step"), "row", "status", "ready") for step, df in done.items()]
    return reduce(DataFrame.unionByName, frames)


def _ready() -> Column:
    return F.col("status").isin(*OPEN) & ~F.col("__bad") & ~F.col("__waits")
