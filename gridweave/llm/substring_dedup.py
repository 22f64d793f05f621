"""Substring deduplication by level-wise doubling of repeated word windows.

Lengths double from level to level up to the wanted one. Of every window of the wanted length, a level below looks only
at the shorter window of least hash in it, an anchor that equal windows share wherever they stand, so a few hundredths
of all positions are shuffled where documents differ. Windows whose anchor occurs in one document alone cannot repeat
and are dropped; those that are left go on to twice the length, until none are left or the wanted length is reached.
There the windows' 128-bit hashes (two polynomials over 128-bit digests of the words) are grouped, and the first document
of each is found. Longer levels would add nothing to what is covered. Last, each document removes the words under windows
that start in an earlier one.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null texts have no words; texts shorter than a window lose nothing; a window that repeats within one
document only is kept; no row is smaller than another of the same doc_id, but each loses only words of its own text;
rows without a doc_id come after all others, by the hash of their text, so only equal texts among them are kept side by
side; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpoint, valid_text

#: Anchors of a level that a broadcast filter may mark, and its bits for each (64 MB at most).
MARKED_ANCHORS, ANCHOR_BITS = 1 << 24, 32

WINDOW = 50
#: Length of the first level, or up to twice that.
FIRST = 25
#: Odd multipliers of the two rolling hashes, and their inverses modulo 2**64.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_INVERSE = tuple(pow(x, -1, 1 << 64) for x in _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, "u8")
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), "u8").reshape(-1, 2)


def window_hashes(hashes: np.ndarray, length: int, base: int, inverse: int) -> np.ndarray:
    """Rolling polynomial hashes modulo 2**64 of all windows of that many words."""
    n = len(hashes)
    if n < length:
        return np.empty(0, "u8")
    sums = np.zeros(n + 1, "u8")
    np.cumsum(hashes * _powers(base, n), out=sums[1:])
    mixed = (sums[length:] - sums[:-length]) * _powers(inverse, n - length + 1)
    mixed ^= mixed >> np.uint64(32)  # the high bits of a product are the good ones
    mixed *= np.uint64(_ODD[0])
    return mixed ^ (mixed >> np.uint64(29))


def levels(window: int, first: int = FIRST) -> list[int]:
    """Lengths of the levels: halves down to `first` words, at least one half."""
    lengths = [window]
    while lengths[0] > 1 and (len(lengths) == 1 or lengths[0] >= 2 * first):
        lengths.insert(0, lengths[0] // 2)
    return lengths


def anchors(hashes: np.ndarray, window: int, length: int) -> np.ndarray:
    """For each window, the least hash of the windows of `length` words in it."""
    parts = window_hashes(hashes, length, _ODD[0], _INVERSE[0])
    span = window - length + 1
    width, least = 1, parts
    while 2 * width <= span:  # minima over twice the width
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[: len(parts) - span + 1], least[span - width :]) if len(parts) >= span else np.empty(0, "u8")


#: Bits of an anchor, by shift, that give its places in a filter; the highest are no good, since anchors are minima.
_MARKS = (0, 20)


def anchor_filter(anchors: DataFrame, n: int) -> np.ndarray:
    """Bytes that mark the n anchors, two bits each; built where the rows lie, 4 KB a row reach the driver."""
    size = 1 << max(15, (ANCHOR_BITS * n - 1).bit_length())
    place = F.explode(F.array(*(F.shiftrightunsigned("anchor", s).bitwiseAND(size - 1) for s in _MARKS)))
    parts = anchors.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << 15) - 1)).alias("bits"))
    marks = np.zeros((size >> 15, 4096), "u1")
    for row in parts.toLocalIterator():
        marks[row.part] = np.frombuffer(row.bits, "u1")
    return marks.ravel()


def _marked(marks: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    places = [(anchors >> np.uint64(s)) & np.uint64(8 * len(marks) - 1) for s in _MARKS]
    return np.logical_and.reduce([marks[p >> np.uint64(3)] >> (p & np.uint64(7)).astype("u1") & 1 for p in places])


def _listed(held: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return held[np.minimum(np.searchsorted(held, anchors), len(held) - 1)] == anchors if len(held) else np.zeros(len(anchors), bool)


#: Length of a level, and whether an anchor lives there; false ones are let through, and only cost.
Level = tuple[int, Callable[[np.ndarray], np.ndarray]]


def _candidates(hashes: np.ndarray, window: int, alive: list[Level]) -> np.ndarray:
    """Starts of the windows whose anchors are alive on all of these levels."""
    left = np.ones(max(len(hashes) - window + 1, 0), bool)
    for length, lives in alive:
        left &= lives(anchors(hashes, window, length))
    return np.flatnonzero(left)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


#: Hash of the text; it tells rows apart that share a doc_id or have none.
KEY = "__text"


def told_apart(docs: DataFrame) -> DataFrame:
    """(text, doc_id), and KEY unless a light count finds that the doc_id alone tells all rows apart."""
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return docs.select("text", "doc_id", *([] if unique else [F.xxhash64("text").alias(KEY)]))


def _named(docs: DataFrame) -> list[str]:
    return ["doc_id", KEY] if KEY in docs.columns else ["doc_id"]


def _kinds(docs: DataFrame) -> str:
    return ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in _named(docs))


def _joined(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """`docs` with the other columns of `rows`, by the columns that tell rows apart."""
    names = _named(docs)
    right = rows.select(*(F.col(c).alias(f"__of_{c}") for c in names), *(c for c in rows.columns if c not in names))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in names))
    return docs.join(_small(right) if "first" in rows.columns else right, same, "left").drop(*(f"__of_{c}" for c in names))


class Alive:
    """Anchors that are alive by level: filters that are broadcast, or lists that the rows carry in columns."""

    def __init__(self) -> None:
        self.filters: list[tuple[int, Broadcast]] = []
        self.columns: list[tuple[int, str]] = []

    def of(self, batch: pa.RecordBatch, i: int) -> list[Level]:
        mine = [(length, batch.column(c)[i].as_py() or ()) for length, c in self.columns]
        return [(n, partial(_marked, marks.value)) for n, marks in self.filters] + [(n, partial(_listed, np.sort(np.array(x, "i8").view("u8")))) for n, x in mine]


def anchor_rows(docs: DataFrame, window: int, length: int, alive: Alive) -> DataFrame:
    """(anchor long, doc_id, KEY if `docs` has it): the anchors of each document's candidates at that length, each once."""
    names = _named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in enumerate(batch.column("text")):
                words = _words(text.as_py())
                if len(words) >= window:
                    hashes = _word_hashes(words)[:, 0]
                    found.append(np.unique(anchors(hashes, window, length)[_candidates(hashes, window, alive.of(batch, i))]))
                    ids.append(np.full(len(found[-1]), i))
            if found:
                at = pa.array(np.concatenate(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("i8")), *(batch.column(c).take(at) for c in names)], ["anchor", *names])

    return docs.select("text", *names, *(c for _, c in alive.columns)).mapInArrow(run, f"anchor long, {_kinds(docs)}")


def whole_windows(docs: DataFrame, window: int, alive: Alive) -> DataFrame:
    """(h1, h2, at, doc_id, KEY if `docs` has it): the windows that are candidates on all levels below."""
    names = _named(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for i, text in enumerate(batch.column("text")):
                words = _words(text.as_py())
                if len(words) < window:
                    continue
                hashes = _word_hashes(words)
                at = _candidates(hashes[:, 0], window, alive.of(batch, i))
                if len(at):
                    pair = [window_hashes(hashes[:, k], window, _ODD[k], _INVERSE[k])[at] for k in (0, 1)]
                    out.append((*pair, np.full(len(at), i), at))
            if out:
                h1, h2, ids, at = (np.concatenate(x) for x in zip(*out, strict=True))
                named = [batch.column(c).take(pa.array(ids)) for c in names]
                yield pa.RecordBatch.from_arrays([pa.array(h1.view("i8")), pa.array(h2.view("i8")), pa.array(at, pa.int32()), *named], ["h1", "h2", "at", *names])

    return docs.select("text", *names, *(c for _, c in alive.columns)).mapInArrow(run, f"h1 long, h2 long, at int, {_kinds(docs)}")


def repeated_windows(docs: DataFrame, window: int = WINDOW, marked: int = MARKED_ANCHORS) -> DataFrame:
    """(doc_id, KEY if `docs` has it, first, last: array<int>): runs of windows, by start word, that also start in a document before.

    `docs` come from `told_apart`.
    """
    names, alive, left = _named(docs), Alive(), docs
    for length in levels(window)[:-1]:
        rows = anchor_rows(left, window, length, alive)
        survivors = checkpoint(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"))
        n = survivors.count()
        if n <= marked:
            alive.filters.append((length, docs.sparkSession.sparkContext.broadcast(anchor_filter(survivors, n))))
        else:
            name = f"alive_{length}"
            mine = rows.join(survivors, "anchor", "left_semi").groupBy(*names).agg(F.collect_list("anchor").alias(name))
            left = _joined(left, mine)
            alive.columns.append((length, name))
        if not n:
            break
    windows = whole_windows(left, window, alive)
    ends = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("open")]
    repeats, after = "(first < last OR first IS NOT NULL AND open)", "(doc_id > first OR doc_id IS NULL AND first IS NOT NULL)"
    if KEY in names:  # rows without a doc_id, among themselves
        ends += [F.min(F.when(F.col("doc_id").isNull(), F.col(KEY))).alias("least"), F.max(F.when(F.col("doc_id").isNull(), F.col(KEY))).alias("most")]
        repeats, after = f"{repeats} OR first IS NULL AND least < most", f"{after} OR doc_id IS NULL AND first IS NULL AND {KEY} > least"
    firsts = windows.groupBy("h1", "h2").agg(*ends).filter(repeats).drop("last", "open", "most")
    firsts = checkpoint(firsts)  # as a table of its own, so that the join can split a window that many documents share
    later = windows.join(firsts, ["h1", "h2"]).filter(after)
    found = later.groupBy(*names).agg(F.sort_array(F.collect_set("at")).alias("at"))
    # Neighbouring starts become runs: most documents have a few.
    lows = F.expr("filter(at, (x, i) -> i = 0 OR at[greatest(i - 1, 0)] <> x - 1)")
    highs = F.expr("filter(at, (x, i) -> i = size(at) - 1 OR at[least(i + 1, size(at) - 1)] <> x + 1)")
    return found.select(*names, lows.alias("first"), highs.alias("last"))


def covered(n: int, first: list[int], last: list[int], window: int) -> np.ndarray:
    """Which of n words lie under windows that start from `first` to `last`, run by run."""
    edge = np.zeros(n + 1, "i8")
    for a, b in zip(first, last, strict=True):
        if (b := min(b, n - window)) >= a:
            edge[a] += 1
            edge[b + window] -= 1
    return np.cumsum(edge)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, marked: int = MARKED_ANCHORS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the kept words, joined by one space.

    Texts shorter than a window can't lose words; rows that share a doc_id lose what repeats in their own text.
    """
    docs = told_apart(docs.withColumn("text", valid_text()))
    marked = _joined(docs, checkpoint(repeated_windows(docs, window, marked))).select("doc_id", "text", "first", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, first, last in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                words = _words(text.as_py())
                total.append(len(words))
                if first.is_valid:
                    drop = covered(len(words), first.as_py(), last.as_py(), window)
                    words = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, text string")


def _small(runs: DataFrame, most: int = 2 * BROADCAST_ROWS) -> DataFrame:
    """Broadcast while the runs are within the bound; else the join shuffles."""
    total = runs.agg(F.coalesce(F.sum(F.size("first").cast("long") + 8), F.lit(0))).first()[0]
    return F.broadcast(runs) if total <= most else runs
