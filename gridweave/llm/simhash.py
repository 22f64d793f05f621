"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 of a text's word shingles. To find all pairs within `distance` bits,
the bits are grouped into parts (correlated bits together) and every part gets its own threshold, -1 for "not probed";
if the thresholds add up to `distance` - parts + 1, a pair within the distance agrees in some part within that part's
threshold. The grouping and the thresholds come from a dynamic program over estimated probes and candidates, fed by
statistics of all fingerprints. Index rows hold a part's value; probes also try its variants within the threshold; what
meets is verified by the bit count of the whole. A part value that more than `BUCKET` fingerprints share isn't paired
off: its probes look up, one by one, the fingerprints that can still be within the distance. Only distinct fingerprints
take part, so copies never meet each other, and links are reduced to components without ever being gathered.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null texts count as empty; texts without words have fingerprint zero and are linked like others; texts
shorter than a shingle are one shingle; equal fingerprints are one class; repeated rows each get their row; an empty
table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXT_KEY, checkpoint, drop_rows, valid_text, with_text_key
from .components import components

BITS, SEED, SHINGLE, DISTANCE = 64, 42, 3, 2
#: Fingerprints that may be paired off within one part value; larger ones are searched by exact look-ups.
BUCKET = 128
#: Numbers of parts that the plan may choose from.
PARTS = (2, 3, 4)
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is 1 if it is set in over half of the shingles' hashes; whole text, repeats included."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, ASCII white space alone separates
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    lengths = np.fromiter(map(len, words), "i8", len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), "u8", len(words) - shingle + 1)
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), _CHUNK):
        octets = hashes[at : at + _CHUNK].astype(">u8").view("u1").reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(axis=0, dtype="i8")
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns `carry`, fp long) for every row of `docs`."""
    fields = ["doc_id", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle) for x in batch.column("text")], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(found, pa.int64())], [*fields, "fp"])

    kinds = ", ".join(f"`{f}` {docs.schema[f].dataType.simpleString()}" for f in fields)
    return docs.select(*fields, valid_text()).mapInArrow(run, f"{kinds}, fp long")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of pairs of bits that are both set (the diagonal: set bits)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), "i8"), 0
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view("u8")
            for at in range(0, len(values), _CHUNK):
                part = values[at : at + _CHUNK]
                bits = ((part[:, None] >> np.arange(BITS, dtype="u8")) & np.uint64(1)).astype("f4")
                both += (bits.T @ bits).astype("i8")
            n += len(values)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(BITS * BITS), -1]), pa.array(np.r_[both.ravel(), n])], ["cell", "n"])

    cells = dict(prints.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect())
    both = np.array([cells.get(i, 0) for i in range(BITS * BITS)], "f8").reshape(BITS, BITS)
    return cells.get(-1, 0), both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal width; each is grown from a seed by the bit that correlates most with it."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        width = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(left, key=lambda b: (tie[b, sorted(left)].sum(), -b))]
        left.discard(group[0])
        while len(group) < width:
            nearest = max(left, key=lambda b: (tie[b, group].sum(), -b))
            group.append(nearest)
            left.discard(nearest)
        groups.append(sorted(group))
    return groups


def _masked(group: list[int]) -> int:
    """The part's bits as a signed mask."""
    value = sum(1 << b for b in group)
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: list[int], most: int) -> list[tuple[int, int]]:
    """(number of flips, signed XOR mask) for all sets of at most `most` of these bits."""
    return [(k, _masked(list(c))) for k in range(most + 1) for c in combinations(bits, k)]


def candidate_cost(n: int, both: np.ndarray, group: list[int], pairs: float, threshold: int, crowded: float = 0.0, distance: int = DISTANCE) -> float:
    """Estimated index rows, probes, candidates and look-ups of one part.

    `pairs`: measured ordered pairs of equal value that are paired off; `crowded`: fingerprints with a value that too
    many share. Mismatches follow the bits' own rates; the measured pairs correct for how the part's bits hang together.
    """
    if threshold < 0:
        return 0.0
    p = both.diagonal()[group] / max(n, 1)
    differ = np.clip(2 * p * (1 - p), 1e-9, 1)
    near = np.zeros(threshold + 1)
    near[0] = 1.0
    for d in differ:  # distribution of the number of differing bits
        near[1:] = near[1:] * (1 - d) + near[:-1] * d
        near[0] *= 1 - d
    lift = pairs / max(near[0] * n * n, 1e-300)
    probes = sum(math.comb(len(group), k) for k in range(threshold + 1))
    others = BITS - len(group)
    moves = sum(math.comb(len(group), used) * math.comb(others, k) for used in range(threshold + 1) for k in range(distance - used + 1))
    return n * (1.0 + probes) + min(float(n) * n, lift * near.sum() * n * n) + crowded * moves


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least summed cost that add up to `total`: a dynamic program over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for threshold, more in options.items():
                if used + threshold not in step or cost + more < step[used + threshold][0]:
                    step[used + threshold] = (cost + more, [*chosen, threshold])
        best = step
    return best[total]


def plan_parts(prints: DataFrame, distance: int = DISTANCE, parts: tuple[int, ...] = PARTS, bucket: int = BUCKET) -> list[tuple[list[int], int]]:
    """The probed parts as (bits, threshold), by least estimated cost over all numbers of parts."""
    n, both = bit_statistics(prints)
    options = {m: group_bits(n, both, m) for m in parts}
    masks = [(m, k, _masked(g)) for m, groups in options.items() for k, g in enumerate(groups)]
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(mask).alias("value")) for i, (_, _, mask) in enumerate(masks))))
    equal = prints.select(values.alias("x")).groupBy("x.part", "x.value").count()
    quiet = F.sum(F.when(F.col("count") <= bucket, F.col("count").cast("double") * F.col("count")).otherwise(0.0))
    shared = F.sum(F.when(F.col("count") > bucket, F.col("count")).otherwise(0))
    sums = {part: (float(x), float(y)) for part, x, y in equal.groupBy("part").agg(quiet, shared).collect()}  # a row a part
    found = []
    for m, groups in options.items():
        measured = [sums.get(i, (0.0, 0.0)) for i, (mm, _, _) in enumerate(masks) if mm == m]
        costs = [{t: candidate_cost(n, both, g, x, t, y, distance) for t in range(-1, distance + 1)} for g, (x, y) in zip(groups, measured, strict=True)]
        found.append((*allocate(costs, distance - m + 1), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(g, t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]


def close_pairs(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """All pairs (a, b), a <> b, of distinct fingerprints in `prints` (fp long, distinct) within the distance.

    A pair may come in either or both orders. Nothing is left out: a value shared by more than `bucket` fingerprints is
    searched by looking up each member's possible neighbours in the table of fingerprints, at most 2,081 of them.
    """
    plan = plan_parts(prints, distance, parts, bucket)
    part = lambda k, value: F.struct(F.lit(k).alias("part"), value.alias("value"))
    index = prints.select("fp", F.explode(F.array(*(part(k, F.col("fp").bitwiseAND(_masked(g))) for k, (g, _) in enumerate(plan)))).alias("x"))
    index = index.select("x.part", "x.value", "fp")
    crowded = checkpoint(index.groupBy("part", "value").count().filter(F.col("count") > bucket).select("part", "value", F.lit(True).alias("crowded")))
    variants = [(k, used, flip) for k, (g, t) in enumerate(plan) for used, flip in _flips(g, t)]
    probe = F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.lit(used).alias("used"), F.lit(flip).alias("flip")) for k, used, flip in variants)))
    masks = F.expr("CASE x.part " + " ".join(f"WHEN {k} THEN {_masked(g)}L" for k, (g, _) in enumerate(plan)) + " END")
    probes = prints.select("fp", probe.alias("x")).select("fp", "x.*", F.col("fp").bitwiseXOR(F.col("x.flip")).bitwiseAND(masks).alias("value"))
    probes = probes.join(crowded, ["part", "value"], "left")
    within: Column = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    quiet = index.join(crowded, ["part", "value"], "left_anti").withColumnRenamed("fp", "b")
    paired = probes.filter("crowded IS NULL").withColumnRenamed("fp", "a").join(quiet, ["part", "value"]).filter("a < b").filter(within).select("a", "b")
    # Crowded values: what is left of the distance is spent on the other bits, and the result looked up.
    rest = [(k, used, flip) for k, (g, t) in enumerate(plan) for used in range(t + 1) for _, flip in _flips(sorted(set(range(BITS)) - set(g)), distance - used)]
    moves = prints.sparkSession.createDataFrame(rest, "part int, used int, other long")
    reach = probes.filter("crowded").join(F.broadcast(moves), ["part", "used"])  # at most some thousand moves
    sought = reach.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).bitwiseXOR(F.col("other")).alias("b")).filter("a < b")
    return paired.unionByName(sought.join(prints.withColumnRenamed("fp", "b"), "b", "left_semi").select("a", "b"))


def _placed(docs: DataFrame, distance: int, shingle: int, bucket: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns `carry`, fp, root of its component) for every row of `docs`."""
    rows = checkpoint(fingerprints(docs, shingle, carry))
    prints = checkpoint(rows.select("fp").distinct())
    roots = components(close_pairs(prints, distance, bucket))
    return rows.join(roots, rows["fp"] == roots["node"], "left").select("doc_id", *carry, "fp", F.coalesce("root", "fp").alias("root"))


def near_groups(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id (least doc_id of its component)."""
    placed = _placed(docs, distance, shingle, bucket)
    # As a table of its own, so that the join can split a root that many rows share.
    least = checkpoint(placed.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return placed.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each component one row, all columns: that of its least doc_id (null last) and then of the least text hash."""
    placed = _placed(with_text_key(docs), DISTANCE, SHINGLE, BUCKET, TEXT_KEY)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *TEXT_KEY)
    best = checkpoint(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("best")).filter("n > 1"))
    return drop_rows(docs, placed.join(best, "root").filter(~row.eqNullSafe(F.col("best"))).select("doc_id", *TEXT_KEY))
