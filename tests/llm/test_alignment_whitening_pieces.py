"""Alignment, whitening and SentencePiece coding against brute force, NumPy and the library."""

import hashlib
import random
from bisect import bisect
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridweave.llm import alignment, piece_encoding, queries, whitening

DIR = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "   ", "a", "a b", "  lead", "trail  ", "a\n b\t\tc \n\n d", "x" * 3000, "▁mark", "a ▁ b", "naïve 東京 😀 𝔘", "it's <|endoftext|> they'll", "\x00\x1f \x1f  y",
    "1234 5678", " " * 50 + "z", "é ​ ﻿  w", "\xa0 　  q", "<s> </s> <unk> <0x41>",
]


def pairs(rows):
    return sorted(rows, key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# SentencePiece ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_encoding.VOCABULARY)


@pytest.fixture(scope="module")
def model():
    with open(piece_encoding.VOCABULARY, "rb") as file:
        return piece_encoding.read_model(file.read())


def test_prefix_table_gives_the_librarys_ids(library, model):
    draw, pieces = random.Random(5), list(model.ids)
    texts = [x for x in ODD if x] + ["a" + " " * k + "b" for k in range(80)] + [" " * k for k in range(80)]
    for _ in range(1500):
        kind = draw.randrange(4)
        if kind == 0:
            texts.append("".join(draw.choice(pieces) for _ in range(draw.randrange(1, 10))))
        elif kind == 1:
            texts.append("".join(draw.choice("abehinorst  ") for _ in range(draw.randrange(1, 60))))
        elif kind == 2:
            texts.append("".join(draw.choice("  aab=-") for _ in range(draw.randrange(1, 60))))
        else:
            texts.append("".join(chr(draw.choice([draw.randrange(1, 600), draw.randrange(600, 0xD800), draw.randrange(0xE000, 0x110000)])) for _ in range(draw.randrange(1, 20))))
    found = piece_encoding.Encoder(model)(texts)
    assert [x.tolist() for x in found] == library.encode(texts)


def test_pairs_are_compatible_exactly_if_merging_leaves_them(library, model):
    draw, pieces = random.Random(9), [p for p in model.ids if not p.startswith("▁")]
    for _ in range(3000):
        left, right = draw.choice(pieces), draw.choice(pieces)
        ids = [i for i in library.encode("\n" + left + right) if i != 13][1:]  # behind the space and the line end
        expected = [library.id_to_piece(i) for i in ids] == [left, right]
        assert piece_encoding.compatible(left, right, model.scores, model.halves) == expected, (left, right)


def test_units_outlive_bounds_of_what_is_kept(library, model, monkeypatch):
    monkeypatch.setattr(piece_encoding, "HELD_CHARS", 10)
    monkeypatch.setattr(piece_encoding, "HELD_PAIRS", 3)
    encoder = piece_encoding.Encoder(model)
    texts = ["the cat sat", "on the mat", "the cat sat on the mat"]
    assert [encoder([t])[0].tolist() for t in texts] == library.encode(texts)


def test_sentencepiece_query_over_the_table(spark, library):
    rows = queries.op13_sentencepiece(spark, DIR).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_sentencepiece_of_odd_tables(spark, library):
    docs = spark.createDataFrame([(i % 5 or None, t, "x") for i, t in enumerate([*ODD, *ODD])], "doc_id long, text string, ids string")
    found = pairs((r.doc_id, tuple(r.ids), r.text) for r in piece_encoding.recode(docs).collect())
    assert found == pairs((i % 5 or None, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t in enumerate([*ODD, *ODD]))
    again = pairs((r.doc_id, r.text) for r in piece_encoding.decode(piece_encoding.encode(docs)).collect())
    assert again == pairs((d, t) for d, _, t in found)
    assert piece_encoding.recode(docs.limit(0)).count() == 0
    broken = docs.limit(1).select("doc_id", F.expr("cast(x'41ff42' as string)").alias("text"))
    assert piece_encoding.recode(broken).first().text == "A�B"


# Alignment --------------------------------------------------------------------------------------------------------


def brute_alignment(texts):
    level = Tokenizer.from_file(alignment.BYTE_LEVEL)
    level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    bytes_a, bytes_b = alignment.byte_level_bytes(level), alignment.piece_bytes(pieces)
    docs, count = [], Counter()
    for text in texts:
        a = level.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        data = (" " + text).encode() if text else b""
        if b"".join(bytes_a[i] for i in a) != data or b"".join(bytes_b[i] for i in b) != data:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(bytes_a[i]) for i in a]).tolist(), np.cumsum([len(bytes_b[i]) for i in b]).tolist()
        links = []
        for i, e in enumerate(ends_a):
            s = ends_a[i - 1] if i else 0
            near = range(max(0, bisect(ends_b, s) - 1), min(len(b), bisect(ends_b, e) + 1))
            links += [(a[i], b[j]) for j in near if s < ends_b[j] and (ends_b[j - 1] if j else 0) < e]
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            sides = [",".join(map(str, ids[bisect(ends, low) : bisect(ends, cut)])) for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(sides))
            low = cut
        docs.append((len(a), len(b), cuts, links, sha(";".join(groups)) if a else ""))
        count.update(links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    return [(n_a, n_b, len(cuts), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest) for n_a, n_b, cuts, links, digest in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(docs):
    return pairs((r.doc_id, *(r[c] for c in COLUMNS)) for r in alignment.align(docs).collect())


def test_encoders_agree_on_every_character():
    """Units and the faster encoder give what both libraries give for whole texts, whatever the characters."""
    with open(alignment.BYTE_LEVEL, encoding="utf-8") as level, open(alignment.PIECES, "rb") as pieces:
        mine = alignment.Encoder(level.read(), pieces.read())
    assert mine.fast is not None
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for pattern in ("a{0}1 {0} {0}{0}b", "{0}  {0}\n {0}x"):
        texts = ["".join(pattern.format(c) for c in points[i : i + 50]) for i in range(0, len(points), 50)]
        found = mine(texts)
        left, right = mine.a.encode_batch([" " + t for t in texts], add_special_tokens=False), mine.b.encode(texts)
        bad = [t for t, f, a, b in zip(texts, found, left, right, strict=True) if f is not None and (np.frombuffer(f[0], "u4").tolist() != a.ids or np.frombuffer(f[1], "u4").tolist() != b)]
        assert not bad and sum(f is None for f in found) < 5


def test_alignment_of_odd_tables(spark):
    texts = [*ODD, *ODD[4:9], "the end of the text"]
    docs = spark.createDataFrame([(i % 7 or None, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_a int")
    assert aligned(docs) == pairs((i % 7 or None, *row) for i, row in enumerate(brute_alignment(texts)))
    assert alignment.align(docs.limit(0)).count() == 0
    broken = docs.limit(1).select("doc_id", F.expr("cast(x'41ff42' as string)").alias("text"))
    assert [alignment.align(broken).first()[c] for c in COLUMNS] == [0, 0, 0, 0, 0, 0, ""]


def test_alignment_query_over_the_table(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").orderBy("doc_id").collect()
    expected = brute_alignment([r.text for r in rows])
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op11_alignment(spark, DIR).collect()}
    assert found == {r.doc_id: e for r, e in zip(rows, expected, strict=True)}


def test_alignment_in_short_runs_and_by_shuffle(spark, monkeypatch):
    """Documents far longer than a run are swept in stretches; beyond the bound, pairs are joined by frequency."""
    draw = random.Random(3)
    words = ["straße", "naïve", "internationalisation", "the", "of", "東京都", "x1y2", "....", "\n\n", "a  b"]
    texts = [" ".join(draw.choice(words) for _ in range(n)) for n in (1, 30, 400, 1500)] + ["   " * 300, "y" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    expected = pairs((i, *row) for i, row in enumerate(brute_alignment(texts)))
    assert aligned(docs) == expected
    level = Tokenizer.from_file(alignment.BYTE_LEVEL)
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECES)
    sizes = tuple([len(b) for b in x] for x in (alignment.byte_level_bytes(level), alignment.piece_bytes(pieces)))
    monkeypatch.setattr(alignment, "RUN", 40)
    state = alignment._Sweep(sizes)
    for i, text in enumerate(texts):
        a, b = np.array(level.encode(" " + text).ids, "i8"), np.array(pieces.encode(text), "i8")
        runs = [(int(sum(sizes[s][t] for t in ids[:k])), s, k + 40 >= len(ids), ids[k : k + 40]) for s, ids in ((0, a), (1, b)) for k in range(0, len(ids), 40)]
        for _, s, last, ids in sorted(runs, key=lambda r: r[:2]):
            state.take(i, i, s, last, ids)
            assert sum(len(x) for h in state.held for x in h) < 200 or len(set(text)) < 3  # no more than the open group and two runs
    import pyarrow as pa

    table = state.flush(pa.int64()).to_pylist()
    assert max(Counter(r["key"] for r in table).values()) > 10
    for i, row in enumerate(brute_alignment(texts)):
        mine = [r for r in table if r["key"] == i]
        assert tuple(sum(r[c] for r in mine) for c in COLUMNS[:4]) == row[:4]
        assert [r["groups_sha256"] for r in mine if r["groups_sha256"]] == [row[-1]]
    monkeypatch.setattr(alignment, "within", lambda df: False)
    monkeypatch.setattr(alignment, "FREQUENT", 0.01)
    assert aligned(docs) == expected


# Whitening --------------------------------------------------------------------------------------------------------


def exact(vectors):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    c = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(x))
    return x, c, values[::-1], axes[:, ::-1]


def test_whitening_query_over_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    x, c, values, axes = exact([r.embedding for r in rows])
    n, sums = len(x), x.sum(axis=0)
    found = {(r.vec_id, r.component): r for r in queries.op12_whitening(spark, "/root/testdata/sf0.01").collect()}
    assert len(found) == 8 * n
    white = np.array([[found[r.vec_id, k].whitened for k in range(1, 9)] for r in rows])
    expected = c @ axes[:, :8] / np.sqrt(values[:8])
    white *= np.sign((white * expected).sum(axis=0))
    assert np.abs(white - expected).max() < 1e-8
    some = found[rows[3].vec_id, 2]
    assert some.n == n and some.deviation == sum(int(n * a - s) ** 2 for a, s in zip(x[3], sums, strict=True))
    assert abs(some.explained - values[1] / values.sum()) < 1e-12 and some.identity_error < 1e-9


def test_lobpcg_certifies_close_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((300, 300)))[0]
    values = np.r_[50.0, 20.0 + 1e-4 * np.arange(6), np.linspace(19, 0, 293)]
    v = (q * values) @ q.T
    axes, found, residuals, _ = whitening.lobpcg(lambda u: v @ u, 300, 8)
    assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-9 and residuals.max() <= whitening.TOLERANCE
    assert np.abs(np.linalg.norm(axes, axis=0) - 1).max() < 1e-12


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.1 * i, 0.5, -0.02 * i * i] for i in range(20)]
    rows = [(i, v, 9) for i, v in enumerate(good)] + [(50, None, 9), (51, [1.0, None, 2.0], 9), (52, [nan, 1.0, 1.0], 9), (53, [1.0, inf, 1.0], 9), (54, [1.0], 9), (None, good[0], 9), (0, good[0], 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int")
    found = whitening.components(table).collect()
    x, c, values, axes = exact([*good, good[0], good[0]])
    assert len(found) == 2 * 22  # the second dimension is constant
    assert sum(r.vec_id is None for r in found) == 2 and sum(r.vec_id == 0 for r in found) == 4
    assert abs(found[0].explained - values[found[0].component - 1] / values.sum()) < 1e-12
    first = sorted(r.whitened for r in found if r.component == 1)
    expected = np.sort(c @ axes[:, 0] / np.sqrt(values[0]))
    assert min(np.abs(np.array(first) - e).max() for e in (expected, np.sort(-expected))) < 1e-8
    assert whitening.components(table.where("vec_id = 7")).count() == 0  # no variance, no component
    assert whitening.components(table.limit(0)).count() == 0
    assert whitening.components(table.where("vec_id between 50 and 53")).count() == 0


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[100000 + (1 << 40), 3], [5, 100000]], "i8")
    n, sums = 1 << 20, [7 << 30, 11]
    assert [int(v) for v in whitening._deviations(x, n, sums).to_pylist()] == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
