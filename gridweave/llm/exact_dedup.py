"""Exact deduplication: counting quotient filters find repeated fingerprints, bytes decide.

Each partition packs the 64-bit fingerprints of its texts into a counting quotient filter: the high bits (quotient)
name a block, the low bits (remainders) lie in it sorted, in slots of just the bytes that they need, and only
remainders that occur more than once take up a counter. Blocks of one quotient from all partitions are merged by their
sorted remainders, without loss, since the whole fingerprint is kept. Fingerprints with a count
above one route their documents to verification, which groups them by the text itself; all other documents are
unique by construction and never move their text.

Defined cases: a null text counts as empty; texts that are empty after normalisation are equal to each other; of equal
texts the row with most code points stays, then the smallest doc_id (a null doc_id comes last); rows that repeat both
doc_id and text share one verdict; an empty table gives an empty result; columns other than doc_id and text are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, SPACE, TEXT_KEY, checkpoint, drop_rows, sized, with_text_key

#: Fingerprints that a merged block holds on average: a few megabytes in a task, and few enough blocks that those of a
#: single partition hold several slots each.
BLOCK_ENTRIES = 1 << 20
BLOCKS = "quotient long, slots binary, counters binary"
#: A counter: the slot it belongs to, and the count.
COUNTER = np.dtype([("at", "<u4"), ("n", "<u8")])


def normalised(text: str = "text") -> F.Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, "")


def quotient_bits(rows: int, entries: int = BLOCK_ENTRIES) -> int:
    return max(4, min(40, (max(rows, 1) // entries).bit_length()))


def pack(remainders: np.ndarray, counts: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Slots and counters of a block of sorted remainders of 64 - `bits` bits."""
    width = (64 - bits + 7) // 8
    slots = remainders.astype("<u8").view("u1").reshape(-1, 8)[:, :width].tobytes()
    more = np.flatnonzero(counts > 1)
    counters = np.empty(len(more), COUNTER)
    counters["at"], counters["n"] = more, counts[more]
    return slots, counters.tobytes()


def unpack(slots: bytes, counters: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The remainders and counts of a block."""
    width = (64 - bits + 7) // 8
    octets = np.zeros((len(slots) // width, 8), "u1")
    octets[:, :width] = np.frombuffer(slots, "u1").reshape(-1, width)
    counts, more = np.ones(len(octets), "i8"), np.frombuffer(counters, COUNTER)
    counts[more["at"]] = more["n"]
    return octets.view("<u8").ravel(), counts


def _merge(remainders: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Merge sorted runs of remainders; equal ones add their counts."""
    keys, number = np.concatenate(remainders), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")  # a merge of sorted runs
    keys, number = keys[order], number[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(number, first)


def quotient_filters(prints: DataFrame, bits: int) -> DataFrame:
    """One counting quotient filter per partition of `prints` (fp long), as one row per block."""
    low = np.uint64(64 - bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.empty(0, "u8")], [np.empty(0, "i8")]
        for batch in batches:
            fresh = batch.column(0).to_numpy(zero_copy_only=False).view("u8")
            found, number = np.unique(fresh, return_counts=True)
            keys.append(found)
            counts.append(number)
            if sum(map(len, keys[1:])) > 2 * len(keys[0]) + 65536:
                merged = _merge(keys, counts)
                keys, counts = [merged[0]], [merged[1]]
        if not any(map(len, keys)):
            return
        held, number = _merge(keys, counts)
        quotients = held >> low
        starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]])
        ends = np.r_[starts[1:], len(held)]
        rest = held & ((np.uint64(1) << low) - np.uint64(1))
        packed = [pack(rest[a:b], number[a:b], bits) for a, b in zip(starts, ends, strict=True)]
        binaries = [pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(quotients[starts].astype("i8")), *binaries], ["quotient", "slots", "counters"])

    return prints.select("fp").mapInArrow(build, BLOCKS)


def merge_filters(filters: DataFrame, bits: int) -> DataFrame:
    """The fingerprints that the merged filters count more than once: (fp long, n long)."""
    low = np.uint64(64 - bits)

    def merge(block: pd.DataFrame) -> pd.DataFrame:
        runs = [unpack(slots, counters, bits) for slots, counters in zip(block["slots"], block["counters"], strict=True)]
        keys, number = _merge([r[0] for r in runs], [r[1] for r in runs])
        more = number > 1
        whole = keys[more] | (np.uint64(block["quotient"].iloc[0]) << low)
        return pd.DataFrame({"fp": whole.view("i8"), "n": number[more]})

    return filters.groupBy("quotient").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, broadcast_rows: int = BROADCAST_ROWS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns `carry`, keep_id, group_size, kept and the SHA-256 of its normalised text."""
    texts = docs.select("doc_id", *carry, normalised().alias("bare"), F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    prints = checkpoint(texts.select("doc_id", *carry, "n_chars", F.xxhash64("bare").alias("fp"), F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256")))
    bits = quotient_bits(prints.count())
    repeated = checkpoint(merge_filters(quotient_filters(prints, bits), bits).select("fp"))
    groups = (
        texts.withColumn("fp", F.xxhash64("bare"))
        .join(sized(repeated, broadcast_rows), "fp", "left_semi")
        .groupBy("fp", "bare")
        .agg(
            F.count(F.lit(1)).alias("group_size"),
            F.max(F.struct("n_chars", F.coalesce(-F.col("doc_id"), F.lit(-(1 << 63))).alias("least"), "doc_id")).alias("best"),
        )
        .select("fp", F.sha2(F.col("bare").cast("binary"), 256).alias("text_sha256"), "group_size", "best")
    )
    return prints.join(groups, ["fp", "text_sha256"], "left").select(
        "doc_id", *carry,
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n_chars") == F.col("best.n_chars")))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns; of rows that repeat both doc_id and text, one."""
    dropped = exact_groups(with_text_key(docs), carry=TEXT_KEY).filter("NOT kept").select("doc_id", *TEXT_KEY)
    return drop_rows(docs, dropped)
