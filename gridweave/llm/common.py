"""Pieces that several training-data operators share; all DataFrame-only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import shared_folder

#: A side with at most so many rows of a few longs (tens of MB) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Text that a broadcast side may carry in all, in bytes.
BROADCAST_BYTES = 32 << 20

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\\x20\\x09-\\x0D]+"


#: Subfolders of the blocks of `passing_tables` that are open.
_OPEN: list[str] = []


def checkpoint(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it again; `lasting` ones outlive `passing_tables`.

    Unlike a checkpointed plan, whose estimated size is that of all joins it came from, a table has the size of its
    files; in loops the estimates would otherwise multiply.
    """
    path = "/".join([shared_folder(df.sparkSession), *([] if lasting else _OPEN), uuid.uuid4().hex])
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that `checkpoint` writes within the block are deleted at its end; write what is to last before."""
    _OPEN.append(uuid.uuid4().hex)
    try:
        yield
    finally:
        folder = "/".join([shared_folder(spark), *_OPEN])
        _OPEN.pop()
        _delete(spark, folder)


def clear_tables(spark: SparkSession) -> None:
    """Delete what `checkpoint` has written in this application; frames that still read it must be done."""
    _delete(spark, shared_folder(spark))


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether `df`, already checkpointed, has few enough rows to be broadcast."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """`df`, already checkpointed, with a broadcast hint if its counted rows stay within the bound.

    `small` is the answer of `within`, where a loop has counted as many rows before.
    """
    return F.broadcast(df) if (within(df, rows) if small is None else small) else df


def sized_text(df: DataFrame, text: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """As `sized`, for a side that carries texts: the bound is on their bytes, 64 more counted a row."""
    total = df.agg(F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df


def word_count(text: str | Column) -> Column:
    """Number of runs of other than ASCII white space; null counts as no text."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))
    return bare.cast("long")


def valid_text(name: str = "text") -> Column:
    """The column with U+FFFD for bytes that aren't UTF-8, which Parquet may hold and Python can't read."""
    return F.make_valid_utf8(F.col(name)).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEY_BITS, DIGIT_BITS = 48, 12
#: Digit of a sum that nothing crosses.
BEYOND = 1 << 62


def crossing(sums: Column, target: Column) -> Column:
    """(digit, below) of `sums`, an array of (digit, w) in order: the first digit up to which more than `target` adds up.

    `below` is the weight before it; without such a digit, BEYOND and all the weight.
    """

    def step(state: Column, x: Column) -> Column:
        crosses = (state["digit"] == BEYOND) & (state["below"] + x["w"] > target)
        digit = F.when(crosses, x["digit"]).otherwise(state["digit"])
        return F.struct(digit.alias("digit"), (state["below"] + F.when(digit == BEYOND, x["w"]).otherwise(0)).alias("below"))

    return F.aggregate(sums, F.struct(F.lit(BEYOND).alias("digit"), F.lit(0).cast("long").alias("below")), step)


def radix_cut(rows: DataFrame, part: str, key: str, weight: str, targets: DataFrame, target: str, bits: int = KEY_BITS, small: bool | None = None) -> DataFrame:
    """Per part, the largest `cut` such that the weights of the keys below it add up to `target` at most.

    Keys are longs in [0, 2**bits). Every round of 12 bits sums the weights by (part, digit), so a hot part is
    pre-aggregated where its rows lie, and no part has more than 4096 sums. Returns (part, cut, below), `below` being
    the weight under the cut; a key that straddles the target stays above. Parts without rows, and those whose keys all
    stay below, get the cut 2**bits.
    """
    state = targets.select(
        F.col(part).alias("__part"), F.col(target).cast("double").alias("__target"),
        F.lit(0).cast("long").alias("__prefix"), F.lit(0).cast("long").alias("__below"),
    )
    small = within(targets) if small is None else small
    for shift in range(bits - DIGIT_BITS, -1, -DIGIT_BITS):
        state = checkpoint(_radix_round(rows, part, key, weight, state, shift, shift + DIGIT_BITS == bits, small))
    return state.select(F.col("__part").alias(part), F.col("__prefix").alias("cut"), F.col("__below").alias("below"))


def _radix_round(rows: DataFrame, part: str, key: str, weight: str, state: DataFrame, shift: int, first: bool, small: bool) -> DataFrame:
    prefixes = sized(state.select(F.col("__part").alias("__p"), F.col("__prefix").alias("__in"), (F.col("__target") - F.col("__below")).alias("__left")), small=small)
    inside = F.col(part).eqNullSafe(F.col("__p")) & (F.shiftright(F.col(key), shift + DIGIT_BITS) == F.col("__in"))
    digits = (
        rows.join(prefixes, inside)
        .groupBy("__p", "__left", F.shiftright(F.col(key), shift).alias("digit"))
        .agg(F.sum(F.col(weight).cast("long")).alias("w"))
    )
    sums = digits.groupBy("__p", "__left").agg(F.sort_array(F.collect_list(F.struct("digit", "w"))).alias("sums"))
    step = sums.select("__p", crossing(F.col("sums"), F.col("__left")).alias("at"))
    # Without a crossing, which only the first round can meet, the cut lies beyond every key.
    beyond = F.shiftleft(F.col("__prefix") + (1 if first else 0), DIGIT_BITS)
    return state.join(sized(step, small=small), F.col("__p").eqNullSafe(F.col("__part")), "left").select(
        "__part", "__target",
        F.coalesce(F.when(F.col("at.digit") < BEYOND, F.col("at.digit")), beyond).alias("__prefix"),
        (F.col("__below") + F.coalesce(F.col("at.below"), F.lit(0))).alias("__below"),
    )


#: What tells rows that share a doc_id apart: hash and bytes of the text, -1 for null.
TEXT_KEY = ("__hash", "__bytes")


def with_text_key(df: DataFrame) -> DataFrame:
    """`df` with the columns of TEXT_KEY for its text."""
    found = F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long")
    return df.select("*", *(c.alias(name) for c, name in zip(found, TEXT_KEY, strict=True)))


def join_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Join `docs`, given their text key, with `rows` on doc_id (null counts) and text key; `rows` go to the right."""
    names = ["doc_id", *TEXT_KEY]
    right = rows.select(*(F.col(c).alias(f"__of_{c}") for c in names), *(c for c in rows.columns if c not in names))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names))
    return docs.join(sized(checkpoint(right)), same, how)


def drop_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id and text key aren't in `rows`; of those that share both, one stays.

    What is dropped is the smaller side as a rule, and joins by broadcast within the bound. Texts move besides only for
    ids that several rows share, which a light count finds first.
    """
    held = join_rows(with_text_key(docs), rows.select("doc_id", *TEXT_KEY).distinct(), "left_anti")
    shared = checkpoint(docs.groupBy(F.col("doc_id").alias("__id")).count().filter("count > 1").select("__id"))
    if shared.isEmpty():
        return held.drop(*TEXT_KEY)
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    once = held.join(sized(shared), same, "left_semi").dropDuplicates(["doc_id", *TEXT_KEY])
    return held.join(sized(shared), same, "left_anti").unionByName(once).drop(*TEXT_KEY)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
