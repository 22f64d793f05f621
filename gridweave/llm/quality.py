"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are the words of the text, lower-cased and hashed into 2**BITS coordinates, and, as further terms, its form:
trigrams of character classes and counts of words, of words that repeat their predecessor or the one before it, and of
distinct words. Both kinds carry log-entropy weights, the logarithm of a term's count times one less its normalised
entropy over the labelled sample, and each kind has unit length. By a truncated SVD of the centred term-document matrix
of that sample, each document becomes a short unit vector. The labelled vectors are broadcast (a bounded sample);
every document's cosines with all of them are exact products, block by block, and its nearest neighbours vote with
their similarity.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null and empty texts are the zero vector, similar to nothing, and score the sample's share of label 1;
so does every row if nothing is labelled (0.5); ties among neighbours go to the lower position in the sample; rows
that repeat a doc_id score by their own text; other columns, and labels outside the training folds, are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import valid_text
from .labelled import fold, training_rows, words

#: Bound of the labelled sample, latent dimensions, and voters.
SAMPLE, RANK, NEIGHBOURS = 4_000, 32, 15
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
SHARPNESS = 8
BLOCK = 256
KINDS = 9


def _class(c: int) -> int:
    if c >= 128:
        return 0
    x = chr(c)
    if x.isalpha():
        return int(x.isupper())
    return 2 if x.isdigit() else 3 if x == " " else 4 if x in "\t\n\x0b\x0c\r" else 5 if x in ".,;:'\"-()" else 6 if x in "!?" else 7 if x in "|/\\_<>=+~^{}[]`" else 8


CLASSES = np.array([_class(c) for c in range(256)], "i2")
BLANK = np.array([c in b"\t\n\x0b\x0c\r " for c in range(256)])
BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
EXTRA = 4
#: Words have 2**BITS coordinates; the SVD iterates so often on so many spare dimensions.
BITS, STEPS, SPARE = 14, 8, 8
TERMS = (1 << BITS) + KINDS**3 + EXTRA


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates, ascending, and counts of the terms in a text: hashed words below 2**BITS, form from there on."""
    whole = text or ""
    data = whole.encode()
    kinds = CLASSES[np.frombuffer(data, "u1")]
    form = np.zeros(KINDS**3 + EXTRA)
    if len(kinds) > 2:
        form[: KINDS**3] = np.bincount((kinds[:-2] * KINDS + kinds[1:-1]) * KINDS + kinds[2:], minlength=KINDS**3)
    h = words(data, BLANK)[2]
    form[KINDS**3 :] = len(h), (h[1:] == h[:-1]).sum(), (h[2:] == h[:-2]).sum(), len(np.unique(h))
    at, counts = np.unique((words(whole.lower().encode(), BREAKS)[2] >> np.uint64(64 - BITS)).astype("i4"), return_counts=True)
    used = np.flatnonzero(form).astype("i4")
    return np.r_[at, used + (1 << BITS)].astype("i4"), np.r_[counts, form[used]].astype("f4")


def entropy_weights(rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Per term 1 + sum(p log p) / log(n), p being its share in each of the n rows; 0 for terms that none has."""
    total, log = np.zeros(TERMS), np.zeros(TERMS)
    for at, counts in rows:
        total[at] += counts
    for at, counts in rows:
        p = counts / total[at]
        log[at] += p * np.log(p)
    return np.where(total > 0, np.clip(1 + log / np.log(max(len(rows), 2)), 0, 1), 0).astype("f4")


def weighted(row: tuple[np.ndarray, np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Values at a row's coordinates; its words and its form each have unit length."""
    at, counts = row
    values = np.log1p(counts) * weight[at]
    split = np.searchsorted(at, 1 << BITS)
    for part in (values[:split], values[split:]):
        part /= max(np.linalg.norm(part), 1e-12)
    return values


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 1e-12)


def _counted(rows: DataFrame, fields: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py()) for x in batch.column("text")]
            packed = [pa.array([part[k].tobytes() for part in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), *packed], [*fields, "at", "counts"])

    kinds = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in fields)
    return rows.select(*fields, valid_text()).mapInArrow(run, f"{kinds}, at binary, counts binary")


def truncated_svd(blocks: Callable[[], Iterator[np.ndarray]], centre: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the centred rows, by subspace iteration; `blocks` gives the rows anew each time."""
    basis = np.random.default_rng(0).normal(size=(len(centre), rank + SPARE)).astype("f4")
    for _ in range(STEPS):
        basis, _ = np.linalg.qr(basis)
        basis = sum(((m := block - centre).T @ (m @ basis) for block in blocks()), np.zeros_like(basis))
    basis, _ = np.linalg.qr(basis)
    inner = sum(((m := (block - centre) @ basis).T @ m for block in blocks()), np.zeros((rank + SPARE,) * 2, "f4"))
    return basis @ np.linalg.eigh(inner)[1][:, ::-1][:, :rank]


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Term weights, projection, labelled unit vectors and labels, from (doc_id, text, y).

    The sample's distinct terms, a few KB a row, are gathered; its bound is a parameter.
    """
    found = sorted(_counted(sample, ["doc_id", "y"]).collect(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in found], "f4")
    rows = [(np.frombuffer(r["at"], "i4"), np.frombuffer(r["counts"], "f4")) for r in found]
    weight = entropy_weights(rows)
    values = [weighted(r, weight) for r in rows]

    def blocks() -> Iterator[np.ndarray]:
        for a in range(0, len(rows), BLOCK):
            block = np.zeros((min(BLOCK, len(rows) - a), TERMS), "f4")
            for k, ((at, _), v) in enumerate(zip(rows[a : a + BLOCK], values[a : a + BLOCK], strict=True)):
                block[k, at] = v
            yield block

    centre = (sum((b.sum(axis=0) for b in blocks()), np.zeros(TERMS)) / max(len(rows), 1)).astype("f4")
    basis = truncated_svd(blocks, centre, RANK).astype("f4") if rows else np.zeros((TERMS, RANK), "f4")
    project = np.r_[basis, -(centre @ basis)[None, :]]
    return weight, project, unit(_latent(rows, weight, project)), y


def _latent(rows: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, project: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), project.shape[1]), "f4")
    for k, row in enumerate(rows):
        if len(row[0]):
            out[k] = weighted(row, weight) @ project[row[0]] + project[-1]
    return out


def vote(cosines: np.ndarray, y: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Share of label 1 among the nearest, weighted by similarity; the overall share where nothing is similar."""
    k = min(neighbours, len(y))
    least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    above, ties = cosines > least, cosines == least
    # Of the ties for the last places, those of lower position.
    near = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    row, at = np.nonzero(near)
    weight = np.maximum(cosines[row, at].astype("f8"), 0.0) ** SHARPNESS
    total = np.bincount(row, weight, len(cosines))
    voted = np.bincount(row, weight * y[at], len(cosines))
    return np.divide(voted, total, out=np.full(len(total), float(y.mean())), where=total > 1e-12)


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Callable[[list[str | None]], np.ndarray]:
    """The function from texts to scores, for use in tasks."""
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, "quality", FOLDS, HELD_OUT, sample)))

    def score(texts: list[str | None]) -> np.ndarray:
        weight, project, held, y = model.value
        if not len(y):
            return np.full(len(texts), 0.5)
        out = [np.empty(0)]
        for a in range(0, len(texts), BLOCK):
            rows = [terms(x) for x in texts[a : a + BLOCK]]
            out.append(vote(unit(_latent(rows, weight, project)) @ held.T, y))
        return np.clip(np.concatenate(out).astype("f8"), 0, 1)

    return score


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, held_out, score (likelihood of the label 1), predicted (1 from THRESHOLD on)."""
    score = scorer(docs, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score([x.as_py() for x in batch.column(1)]))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", valid_text()).mapInArrow(run, f"doc_id {kind}, score double")
    return found.select("doc_id", (fold(FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` whose own text is predicted good, all columns; doc_ids play no part in it."""
    score = scorer(docs, labels)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(list(texts)))

    return docs.filter(run(F.coalesce("text", F.lit(""))) >= THRESHOLD)
