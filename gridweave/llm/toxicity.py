"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are a document's words, their leading bytes (so that a stem counts under any ending), word pairs and pairs
with one word between, hashed into 2**BITS coordinates and weighted by their share of the document. Training follows
the FTRL-proximal rule with its own rate for each coordinate; L1 keeps most weights at exactly zero. Every round, the
shards of the sample start from the common state and go over their rows in a fixed order; the states are averaged.
The weights that aren't zero are broadcast, at most 2**BITS of them, and a score is one pass over a document's words.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null and empty texts have no features and score by the intercept alone; without labelled rows all
scores are 0.5; rows that repeat a doc_id score by their own text; one label of a doc_id that has several counts;
columns other than doc_id and text, and labels outside the training folds, are never read for a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import valid_text
from .labelled import fold, scramble, training_rows, words

BITS = 18
#: Bound of the sample of labelled rows, its shards, and passes over it.
SAMPLE, SHARDS, ROUNDS = 9_000, 3, 6
FOLDS, HELD_OUT = 3, 1
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.5, 0.001
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7, 8)
#: Weight of each kind of feature, in the order in which `feature_ids` gives them; pairs are many, rare and easily learnt by heart.
KINDS = (1.0, 0.1, 0.1, *(1.0 for _ in PREFIXES))
SCALE, SMOOTH = 50.0, 20.0
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_PIECE = 1 << 16


def feature_ids(data: bytes) -> Iterator[np.ndarray]:
    """Coordinates of all features of a lower-cased text, repeats included, in pieces of bounded length."""
    starts, ends, h = words(data, BREAKS)
    shift = np.uint64(64 - BITS)
    octets = np.r_[np.frombuffer(data, "u1"), np.zeros(8, "u1")]
    for a in range(0, len(h), _PIECE):
        part = h[a : a + _PIECE]
        yield (scramble(part) >> shift).astype("i4")
        for gap, odd in ((1, 0xFF51AFD7ED558CCD), (2, 0xC4CEB9FE1A85EC53)):
            second = h[a + gap : a + gap + len(part)]
            yield (scramble(part[: len(second)] * np.uint64(odd) + second) >> shift).astype("i4")
        s, long = starts[a : a + _PIECE], ends[a : a + _PIECE] - starts[a : a + _PIECE]
        head = np.zeros(len(s), "u8")
        for k in range(max(PREFIXES)):
            head |= octets[s + k].astype("u8") << np.uint64(8 * k)
            if k + 1 in PREFIXES:
                yield (scramble((head * np.uint64(0x9FB21C651E98DF25) + np.uint64(k)) * np.uint64(3))[long > k + 1] >> shift).astype("i4")


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0, w)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass; rows of (coordinates, values, label). The last coordinate is the intercept."""
    for ids, x, y in rows:
        zi, ni = z[ids], n[ids]
        w = weights_of(zi, ni)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
        z[ids] = zi + g - sigma * w
        n[ids] = ni + g * g


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of a text, the intercept last."""
    pieces = list(feature_ids((text or "").lower().encode()))
    if not pieces:
        return np.array([1 << BITS]), np.ones(1)
    n_words = sum(map(len, pieces[:: len(KINDS)]))
    each = np.repeat([KINDS[k % len(KINDS)] for k in range(len(pieces))], list(map(len, pieces)))
    ids, where = np.unique(np.concatenate(pieces), return_inverse=True)
    x = np.bincount(where, each, minlength=len(ids)) * (SCALE / (n_words + SMOOTH))
    return np.r_[ids, 1 << BITS], np.r_[x, 1.0]


def _pass(start: Broadcast, step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One pass over a shard in the order of this step, from the common state."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.astype("f8") for x in start.value)
        rows = rows.sort_values("doc_id").sample(frac=1, random_state=step)
        ftrl([(*sparse(t), y) for t, y in zip(rows["text"], rows["y"], strict=True)], z, n)
        return pd.DataFrame({"z": [z.astype("f4").tobytes()], "n": [n.astype("f4").tobytes()]})

    return run


def train(sample: DataFrame) -> np.ndarray:
    """Weights, the intercept last, from (doc_id, text, y)."""
    spark = sample.sparkSession
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(SHARDS)).cast("int"))
    for step in range(ROUNDS):
        start = spark.sparkContext.broadcast((z.astype("f4"), n.astype("f4")))  # of fixed size
        # A shard is a third of the bounded sample; a state has fixed size.
        states = dealt.groupBy("shard").applyInPandas(_pass(start, step), "z binary, n binary").collect()
        start.destroy()
        if states:
            z, n = (np.mean([np.frombuffer(s[c], "f4").astype("f8") for s in states], axis=0) for c in ("z", "n"))
    return weights_of(z, n)


def scorer(spark: SparkSession, weights: np.ndarray) -> Callable[[], Callable[[Iterable[str | None]], np.ndarray]]:
    """To be called once a task: the function from texts to scores."""
    at = np.flatnonzero(weights)
    compact = spark.sparkContext.broadcast((at.astype("i4"), weights[at].astype("f4")))

    def start() -> Callable[[Iterable[str | None]], np.ndarray]:
        where, values = compact.value
        w = np.zeros((1 << BITS) + 1, "f4")
        w[where] = values

        def score(texts: Iterable[str | None]) -> np.ndarray:
            out = []
            for text in texts:
                total, n_words = 0.0, 0
                for k, ids in enumerate(feature_ids((text or "").lower().encode())):
                    total += KINDS[k % len(KINDS)] * float(w[ids].sum(dtype="f8"))
                    n_words += len(ids) if k % len(KINDS) == 0 else 0
                out.append(float(w[-1]) + total * SCALE / (n_words + SMOOTH))
            return 1 / (1 + np.exp(-np.clip(np.array(out, "f8"), -35, 35)))

        return score

    return start


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every row."""
    start = scorer(docs.sparkSession, weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(x.as_py() for x in batch.column(1)))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", valid_text()).mapInArrow(run, f"doc_id {kind}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (likelihood of the label 1), predicted (1 from THRESHOLD on)."""
    found = scores(docs, train(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, sample)))
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose own text isn't predicted toxic, all columns; doc_ids play no part in it."""
    start = scorer(docs.sparkSession, train(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE)))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = start()
        for texts in batches:
            yield pd.Series(score(texts))

    return docs.filter(run(F.coalesce("text", F.lit(""))) < THRESHOLD)
