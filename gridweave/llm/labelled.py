"""What the classifiers share: the split, the bounded sample of labelled rows and words as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, valid_text

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def fold(parts: int) -> Column:
    """crc32 of the doc_id as text, modulo `parts`; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, most: int) -> DataFrame:
    """(doc_id, text, y): at most `most` labelled documents outside the held-out fold, least hash of the id first."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("y IS NOT NULL").filter(fold(parts) != held)
    chosen = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = checkpoint(chosen.withColumnRenamed("doc_id", "__id"))
    # `most` rows of two numbers: the bound of the sample bounds the broadcast.
    found = docs.select("doc_id", valid_text()).join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    # Of rows that share an id the least label and the text of least hash count, so that reruns agree.
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.coalesce(F.octet_length("text"), F.lit(-1))))
    return checkpoint(found.groupBy("doc_id", "y").agg(least.alias("text")).select("doc_id", "text", "y"))


def words(data: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text in bytes: start and end of each word and its 64-bit hash; `breaks` marks the bytes between words."""
    octets = np.frombuffer(data, "u1")
    edges = np.diff(np.r_[True, breaks[octets], True].astype("i1"))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return starts, ends, np.empty(0, "u8")
    sums = np.zeros(len(octets) + 1, "u8")
    np.cumsum((octets.astype("u8") + np.uint64(1)) * powers(len(octets)), out=sums[1:])
    return starts, ends, scramble((sums[ends] - sums[starts]) * powers(len(octets), back=True)[starts])


_POWERS: dict[bool, np.ndarray] = {}


def powers(n: int, back: bool = False) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse, modulo 2**64."""
    held = _POWERS.get(back)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 17), _INVERSE if back else _ODD, "u8")
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= 1 << 20:  # what longer texts need isn't kept
            _POWERS[back] = held
    return held[:n]


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))
