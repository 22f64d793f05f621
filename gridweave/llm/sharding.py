"""Sharding by a k-d tree over metadata, split at distributed weighted medians until leaves reach the target bytes.

Points are groups of equal texts, weighted by their bytes. Dimensions are the size, source, language and a hash of the
text; each coordinate holds the value in its high bits and the text's hash below, so equal texts never part while a
popular value can still be split. A round splits all nodes at once: one pass sums the bytes by node, dimension and
value, which gives every dimension's width and the value at the weighted median; a second resolves the hash bits below
that value on the widest dimension. What a round learns, two numbers a node, is part of the next round's expressions.

Groups of over 1/64 of a leaf, 64 a leaf at most, are placed before: the largest first into the leaf with most room,
and the tree fills what they leave, at fractions that follow the room on either side. A group that no leaf has room for
is cut into pieces by doc_id, which the tree places like other points, for else the bytes can't be near equal.

Defined cases: a null text is empty and, as any other, counts one byte for its end; null metadata count as empty;
repeated rows are placed each; an empty table gives an empty result; other columns are ignored by the assignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BEYOND, checkpoint, crossing, sized

SHARDS = 8
LAW = "bytes"
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_text")
#: Groups of over a leaf's bytes / HEAVY are placed one by one; others are points of the tree.
HEAVY = 64
#: What a leaf may exceed its share by for a group to stay whole.
SLACK = 0.01
#: Rows that one task numbers.
SLOT_ROWS = 20_000
KEY = ("hash", "crc", "size")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, size, crc, hash, spread): a few dozen bytes for each document; `spread` deals rows to tasks."""
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    return docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), (F.octet_length(_text()).cast("long") + 1).alias("size"),
        F.crc32(_text().cast("binary")).alias("crc"), F.xxhash64(_text()).alias("hash"), spread.alias("spread"),
    )


def heavy_groups(rows: DataFrame, leaf: float, shards: int) -> tuple[list[tuple], list[float]]:
    """(key, shard or None, pieces) of every group over leaf / HEAVY, and the room that each leaf has left.

    They weigh more than 1/64 of a leaf each, so there are at most 64 a leaf.
    """
    found = rows.groupBy(*KEY).agg(F.sum("size").alias("weight")).filter(F.col("weight") > leaf / HEAVY).collect()
    room, placed = [leaf] * shards, []
    for *key, weight in sorted(map(tuple, found), key=lambda g: (-g[-1], g)):
        most = max(range(shards), key=lambda s: (room[s], -s))
        if fits := weight <= room[most] + SLACK * leaf:
            room[most] -= weight
        placed.append((*key, most if fits else None, 1 if fits else int(weight * HEAVY / leaf) + 1))
    return placed, [max(r, 0.0) for r in room]


def _points(rows: DataFrame) -> DataFrame:
    """Groups of rows by key and piece with weight and coordinates of 48 bits: 16 of a value, 32 of the hash."""
    groups = rows.groupBy(*KEY, "piece").agg(F.sum("size").alias("weight"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    low = F.shiftrightunsigned(F.xxhash64("hash", "crc", "piece"), 32)
    at = lambda high: F.shiftleft(F.least(F.greatest(high, F.lit(0)), F.lit(65535)).cast("long"), 32).bitwiseOR(low)
    name = lambda c: F.shiftrightunsigned(F.crc32(F.col(c).cast("binary")).cast("long"), 16)
    return groups.select(*KEY, "piece", "weight", at(F.log2("size") * 2048).alias("d_size"), at(name("source")).alias("d_source"), at(name("lang")).alias("d_lang"), at(F.shiftrightunsigned("hash", 48)).alias("d_text"))


def _by_node(values: dict[int, float | int], node: str = "node") -> Column:
    """The node's value, null for nodes without one."""
    return F.get(F.array(*(F.lit(values.get(n)) for n in range(max(values, default=0) + 1))), F.col(node).cast("int"))


def _sums(digits: DataFrame, *by: str) -> DataFrame:
    """`by` with `sums`, the array of (digit, w) in order: at most 2**16 entries, pre-aggregated where the points lie."""
    return digits.groupBy(*by, "digit").agg(F.sum("weight").alias("w")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("digit", "w"))).alias("sums"))


def _cuts(points: DataFrame, shares: dict[int, float]) -> dict[int, tuple[int, int]]:
    """(dimension, cut) of every node in `shares` that has points: the widest one, cut where that share of the bytes lies below."""
    open_nodes = points.withColumn("__share", _by_node(shares)).filter("__share IS NOT NULL")
    every = F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.shiftright(F.col(d), 32).alias("digit")) for i, d in enumerate(DIMENSIONS))))
    sums = _sums(open_nodes.select("node", "weight", every.alias("x")).select("node", "weight", "x.*"), "node", "dim")
    total = F.expr("aggregate(sums, 0L, (a, x) -> a + x.w)")
    first = sums.select("node", "dim", F.expr("element_at(sums, -1).digit - sums[0].digit").alias("span"), (total * _by_node(shares)).alias("target"), "sums")
    first = first.select("node", "dim", "span", "target", crossing(F.col("sums"), F.col("target")).alias("at")).collect()  # four rows a node
    widest = {n: max((r for r in first if r["node"] == n), key=lambda r: (r["span"], -r["dim"])) for n in {r["node"] for r in first}}
    inner = {n: r for n, r in widest.items() if r["at"]["digit"] < BEYOND}
    found = {n: (r["dim"], 1 << 48) for n, r in widest.items()}
    if inner:
        along = F.get(F.array(*DIMENSIONS), _by_node({n: r["dim"] for n, r in inner.items()}))
        digit = _by_node({n: r["at"]["digit"] for n, r in inner.items()})
        inside = points.withColumn("__key", along).filter(F.shiftright("__key", 32) == digit)
        low = _sums(inside.select("node", "weight", (F.shiftright("__key", 16) % (1 << 16)).alias("digit")), "node")
        left = {n: float(r["target"] - r["at"]["below"]) for n, r in inner.items()}
        for n, at in low.select("node", crossing(F.col("sums"), _by_node(left)).alias("at")).collect():
            high = inner[n]["at"]["digit"] << 32
            found[n] = (inner[n]["dim"], high + (min(at["digit"], 1 << 16) << 16))
    return found


def tree(points: DataFrame, room: list[float]) -> DataFrame:
    """`points`, a table of its own, with their leaf, `shard`; leaf i gets a share of the bytes by room[i]."""
    spans = {1: (0, len(room))}  # the leaves below a node
    placed = points.withColumn("node", F.lit(1).cast("long"))
    while any(b - a > 1 for a, b in spans.values()):
        middle = {n: (a + b) // 2 for n, (a, b) in spans.items() if b - a > 1}
        shares = {n: sum(room[spans[n][0] : m]) / max(sum(room[slice(*spans[n])]), 1e-9) for n, m in middle.items()}
        cuts = _cuts(placed, shares)
        key = F.get(F.array(*DIMENSIONS), _by_node({n: d for n, (d, _) in cuts.items()}))
        right = F.coalesce((key >= _by_node({n: c for n, (_, c) in cuts.items()})).cast("int"), F.lit(0))
        placed = placed.withColumn("node", F.col("node") * 2 + right)
        spans = {2 * n + s: (a, middle.get(n, b)) if s == 0 else (middle[n], b) for n, (a, b) in spans.items() for s in (0, 1) if s == 0 or n in middle}
    return placed.withColumn("shard", _by_node({n: a for n, (a, _) in spans.items()}).cast("int")).drop("node")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row: doc_id, size, crc, shard and slot, its number within the shard in the order of blocks of ids."""
    rows = checkpoint(sizes(docs))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    heavy, room = heavy_groups(rows, max(total, 1) / shards, shards)
    known = rows.sparkSession.createDataFrame(heavy, "hash long, crc long, size long, fixed int, pieces int")
    rows = rows.join(F.broadcast(known), list(KEY), "left")  # at most 64 rows a shard
    rows = rows.withColumn("piece", F.coalesce(F.pmod("spread", F.col("pieces")), F.lit(0)).cast("int"))
    light = rows.filter("fixed IS NULL")
    where = tree(checkpoint(_points(light)), room).select(*KEY, "piece", "shard")
    fields = ["doc_id", "size", "crc", "spread", "shard"]
    rows = light.join(where, [*KEY, "piece"]).select(*fields).unionByName(rows.filter("fixed IS NOT NULL").withColumn("shard", F.col("fixed")).select(*fields))
    blocks = n // SLOT_ROWS // shards + 1
    rows = checkpoint(rows.withColumn("block", F.pmod("spread", F.lit(blocks))))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "block").count().select("shard", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "crc", "size")) - 1
    return rows.withColumn("inside", inside).join(sized(checkpoint(starts)), ["shard", "block"]).select("doc_id", "size", "crc", "shard", (F.col("start") + F.col("inside")).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write `docs`, all columns, as Parquet with one folder per shard."""
    where = assign(docs, shards).groupBy(F.col("doc_id").alias("__id"), F.col("crc").alias("__crc"), F.col("size").alias("__size")).agg(F.min("shard").alias("shard"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.crc32(_text().cast("binary")) == F.col("__crc")) & (F.octet_length(_text()) + 1 == F.col("__size"))
    docs.join(where, same).drop("__id", "__crc", "__size").repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("shard").parquet(path)
