"""Dense row positions without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POS = "__pos"
#: Rows that one task ranks.
BLOCK = 1 << 20
#: Rows that a block of sorted rows is to hold, and the most blocks; each has about 16 rows of the sample that cuts them.
BLOCK_ROWS, BLOCKS, SAMPLED = 1 << 16, 4096, 16


def _offsets(blocks: DataFrame) -> DataFrame:
    """Rows before each block; one row per block, so the running sum is small."""
    before = Window.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.groupBy("__block").count().select("__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))


def _ranked(df: DataFrame, order: list[Column]) -> DataFrame:
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(*order)) - 1
    # Every block has its row; a left join spares the filter on null blocks that an inner one infers.
    joined = df.withColumn("__inside", inside).join(_offsets(df), "__block", "left")
    return joined.withColumn(POS, (F.col("__before") + F.col("__inside")).cast("long")).drop("__block", "__before", "__inside")


def densify(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Renumber unique, possibly sparse positions 0..n-1 in the same order."""
    return _ranked(df.withColumn("__block", F.floor(F.col(POS) / block)), [F.col(POS)])


def position_by(df: DataFrame, keys: list[Column], rows: int = BLOCK_ROWS) -> DataFrame:
    """Number rows 0..n-1 in the order of `keys`, ties by the position they have.

    Blocks of about `rows` rows are cut at keys of a sample, the old position included, so equal keys don't share a
    block; a row finds its block by bisection in a literal of at most BLOCKS cuts. The sample only decides how even the
    blocks are, never the order.
    """
    key = F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col(POS).alias("at"))
    keyed, n, blocks, cuts = df.select(key.alias("k")), df.count(), 1, []
    while blocks < BLOCKS and n > blocks * rows:
        blocks *= 2
    if blocks > 1:
        picked = keyed.where(F.pmod(F.xxhash64("k.at"), F.lit(max(1, n // (blocks * SAMPLED)))) == 0)
        cuts = picked.agg(F.sort_array(F.collect_list("k")).alias("k")).first()["k"][SAMPLED - 1 :: SAMPLED]
    if not cuts:
        return _ranked(df.withColumn("__block", F.lit(0).cast("long")), [*keys, F.col(POS)])
    kinds = keyed.schema["k"].dataType.fields
    literals = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(c, kinds, strict=True))) for c in cuts))
    step = 1 << len(cuts).bit_length() >> 1
    steps = [F.lit(step >> i) for i in range(step.bit_length())]
    # The number of cuts up to the key; past the end of the cuts get() is null, and so is the comparison.
    upto = F.aggregate(F.array(*steps), F.lit(0), lambda n, s: F.when(F.get(literals, n + s - 1) <= key, n + s).otherwise(n))
    return _ranked(df.withColumn("__block", upto.cast("long")), [*keys, F.col(POS)])
