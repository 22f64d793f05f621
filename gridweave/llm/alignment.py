"""Alignment of two tokenizers' tokens by a sweep over their end events.

Each text is encoded by both tokenizers, A on a space and the text, B on the text, to which it adds that space itself.
A token's end, its byte offset, is an event of its side. Events travel in runs: one row holds up to `RUN` consecutive
tokens of one side, their ids packed; lengths, and so offsets, follow from the vocabulary. The runs of both sides are
united, repartitioned by document and sorted by offset within partitions, and then a sweep reads them in a stream: it
keeps what lies behind the last offset at which tokens of both sides end, the open group, and nothing else. Each distinct
offset closes one link, the overlap of one A and one B token; each common offset closes a group.

How often a pair of ids is linked in all documents is summed from per-run counts; only such counts, one row per distinct
pair, are joined back to a document's own. The table of pairs is broadcast within a bound. Beyond it the frequent pairs,
whose number a share of all links bounds, are broadcast and the rest joined by shuffle, so no key is hot.

Both encoders work on units that no token of either crosses: a text is cut before each space that follows a character
other than white space. Units met before in a task are looked up, within a bound.

`docs` must give the same rows in the same partitions when it is read again, as a table does: rows are known by number.

Defined cases: texts that are null or empty, or whose joined token bytes differ from the space and the text (such as
those that hold U+2581), have no tokens: all counts are 0 and the groups an empty text; bytes that aren't UTF-8 differ
too; rows that repeat, or share a doc_id, each count; texts of any length are read whole, in runs; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, within

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: A space after what no tokenizer takes for white space.
CUT = re.compile("(?<=[^\\s᠎​﻿])(?= )")
#: Fixed value: the pattern by which byte-level vocabularies split texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of the longest unit that the faster encoder takes.
SHORT = 4096
#: Tokens of one side in a row, of both that are swept together; characters of texts whose units are looked up together,
#: of units encoded as one text, and of units kept.
RUN, SWEPT, GROUP_CHARS, CHUNK, HELD_CHARS = 1 << 14, 1 << 18, 1 << 20, 1 << 15, 1 << 21
#: Stretches swept together; with two ids of 21 bits their numbers stay within 63 bits.
MOST_STRETCHES = 1 << 14
#: A pair with at least this share of all links is frequent; there are fewer than its inverse.
FREQUENT = 1e-5

EVENTS = "side tinyint, at bigint, last boolean, ids binary"
SWEEP = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, counts array<int>"


def byte_level_bytes(tokenizer: object) -> list[bytes]:
    """Bytes of every token of a byte-level vocabulary, whose 256 characters stand for bytes."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 0xAD and not chr(b).isspace() and b not in range(0x7F, 0xA1)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(chars.get(c, 0) for c in t) for t in tokens]


def piece_bytes(model: object) -> list[bytes]:
    """Bytes of every piece: the mark as a space, byte pieces as their byte."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


def ranked(level: str, tokens: list[bytes]) -> bool:
    """Whether a byte-level vocabulary merges by the order of its ids and splits by the usual pattern, as rank encoders do."""
    spec = json.loads(level)
    pre, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    in_order = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    return plain and in_order and not model.get("dropout") and len(set(tokens[:256])) == 256 and all(len(t) == 1 for t in tokens[:256])


class Encoder:
    """Packed ids of both sides per text, or None where they don't give the text back.

    A's vocabulary, if its merges go by rank, is read by a faster encoder of the same kind; long units, on which that one
    is slow, and other vocabularies by the library of its file.
    """

    def __init__(self, level: str, pieces: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(level), sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = byte_level_bytes(self.a), piece_bytes(self.b)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in tokens], "i8") for tokens in (self.bytes_a, self.bytes_b))
        self.units, self.chars, self.fast = {}, 0, None
        if ranked(level, self.bytes_a):
            import tiktoken

            own = {t: i for i, t in enumerate(self.bytes_a[: 256 + len(json.loads(level)["model"]["merges"])])}
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})

    def __call__(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        found = [CUT.split(" " + text) if text else [] for text in texts]
        if self.chars > HELD_CHARS:
            self.units, self.chars = {}, 0
        fresh = list(set().union(*found).difference(self.units))
        self.chars += sum(map(len, fresh))
        begin, size = 0, 0
        for i, unit in enumerate(fresh, 1):
            size += len(unit)
            if size >= CHUNK or i == len(fresh) or len(fresh[i]) > SHORT or len(unit) > SHORT:
                self._learn(fresh[begin:i])
                begin, size = i, 0
        return [self._joined([self.units[u] for u in units]) for units in found]

    def _learn(self, units: list[str]) -> None:
        """Encode units, laid end to end, as one text, whose tokens end where the units do; if not, one by one."""
        text = "".join(units)
        data = text.encode()
        ends = np.cumsum([len(u.encode()) for u in units])
        short = self.fast is not None and max(map(len, units)) <= SHORT
        left = self.fast.encode_ordinary(text) if short else self.a.encode(text, add_special_tokens=False).ids
        sides = []
        for ids, sizes, tokens in ((left, self.sizes_a, self.bytes_a), (self.b.encode(text[1:]), self.sizes_b, self.bytes_b)):
            at = np.cumsum(sizes[ids])
            upto = np.searchsorted(at, ends) + 1
            if upto[-1] > len(ids) or (at[upto - 1] != ends).any() or b"".join([tokens[i] for i in ids]) != data:
                break
            sides.append((np.array(ids, "<u4").tobytes(), (4 * upto).tolist()))
        if len(sides) == 2:
            (a, upto_a), (b, upto_b) = sides
            i = j = 0
            for unit, k, m in zip(units, upto_a, upto_b, strict=True):
                self.units[unit] = a[i:k], b[j:m]
                i, j = k, m
        elif len(units) > 1:
            half = len(units) // 2
            self._learn(units[:half])
            self._learn(units[half:])
        else:
            self.units[text] = None

    @staticmethod
    def _joined(parts: list[tuple[bytes, bytes] | None]) -> tuple[bytes, bytes] | None:
        if not parts or None in parts:
            return None
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])


def _packed(ids: np.ndarray, pack: object) -> bytes:
    return pack.compress(ids.astype("<u2" if int(ids.max(initial=0)) < 1 << 16 else "<u4").tobytes() + (b"2" if int(ids.max(initial=0)) < 1 << 16 else b"4"))


def _unpacked(data: bytes, unpack: object) -> np.ndarray:
    raw = unpack.decompress(data)
    return np.frombuffer(raw[:-1], "<u2" if raw[-1:] == b"2" else "<u4").astype("i8")


def events(docs: DataFrame, level: str = BYTE_LEVEL, pieces: str = PIECES) -> tuple[DataFrame, tuple[list[int], list[int]]]:
    """Runs of end events of both sides, (key, doc_id, side, at, last, ids), and each side's token lengths.

    `at` is the offset at which the run starts. A document without tokens has one row with null ids.
    """
    import sentencepiece
    from tokenizers import Tokenizer

    with open(level, encoding="utf-8") as file:
        level = file.read()
    with open(pieces, "rb") as file:
        model = file.read()
    lengths = tuple(
        [len(b) for b in found]
        for found in (byte_level_bytes(Tokenizer.from_str(level)), piece_bytes(sentencepiece.SentencePieceProcessor(model_proto=model)))
    )
    shared = docs.sparkSession.sparkContext.broadcast((level, model, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        level, model, lengths = shared.value
        encoder, sizes, pack = Encoder(level, model), [np.array(x, "i8") for x in lengths], zstandard.ZstdCompressor(level=3)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size = [], 0
                while begin + len(texts) < batch.num_rows and size < GROUP_CHARS:
                    text = batch.column(2)[begin + len(texts)].as_py() or b""
                    try:
                        texts.append(text.decode())
                    except UnicodeDecodeError:
                        texts.append("")
                    size += len(text)
                row, side, at, last, ids = [], [], [], [], []
                for k, both in enumerate(encoder(texts), begin):
                    for s, packed in enumerate(both or (b"",)):
                        found = np.frombuffer(packed, "<u4")
                        starts = range(0, max(1, len(found)), RUN)
                        offset = 0
                        for i in starts:
                            part = found[i : i + RUN]
                            row.append(k)
                            side.append(s)
                            at.append(offset)
                            last.append(i + RUN >= len(found))
                            ids.append(_packed(part, pack) if both else None)
                            offset += int(sizes[s][part].sum()) if len(starts) > 1 else 0
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(side, pa.int8()), pa.array(at, pa.int64()), pa.array(last), pa.array(ids, pa.binary())],
                    ["key", "doc_id", "side", "at", "last", "ids"],
                )
                begin += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key bigint, doc_id {kind}, {EVENTS}"), lengths


class _Sweep:
    """Takes runs in order and hands out finished stretches; between them it holds one document's open group."""

    def __init__(self, lengths: tuple[list[int], list[int]]) -> None:
        self.sizes = [np.array(x, "i8") for x in lengths]
        # What a token adds to the text of the groups, by whether it ends its side of a group: A's with a bar, B's with a semicolon.
        self.shown = [np.array([f"{i}{end}".encode() for i in range(len(x)) for end in ends], object) for x, ends in zip(lengths, (",|", ",;"), strict=True)]
        self.key, self.held, self.sides_done, self.digest = None, ([], []), 0, None
        self.stretches, self.tokens = [], 0

    def take(self, key: int, doc: object, side: int, last: bool, ids: np.ndarray | None) -> None:
        if key != self.key:
            self.key, self.held, self.sides_done, self.digest = key, ([], []), 0, hashlib.sha256()
        if ids is None:
            self.stretches.append((key, doc, np.empty(0, "i8"), np.empty(0, "i8"), None, True))
            return
        self.held[side].append(ids)
        self.sides_done += last
        a, b = (np.concatenate(x) if len(x) != 1 else x[0] for x in (h or [np.empty(0, "i8")] for h in self.held))
        if self.sides_done == 2:
            self._hand_out(doc, a, b, True)
        elif len(a) and len(b) and len(a) + len(b) > RUN:
            # A long document: all up to the last common end is done.
            both = np.intersect1d(np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b]), assume_unique=True)
            if len(both):
                i, j = (int(np.searchsorted(np.cumsum(s[x]), both[-1])) + 1 for s, x in zip(self.sizes, (a, b), strict=True))
                self.held = ([a[i:]], [b[j:]])
                self._hand_out(doc, a[:i], b[:j], False)

    def _hand_out(self, doc: object, a: np.ndarray, b: np.ndarray, final: bool) -> None:
        self.stretches.append((self.key, doc, a, b, self.digest, final))
        self.tokens += len(a) + len(b)

    def flush(self, kind: pa.DataType) -> pa.RecordBatch:
        """One row per stretch, all stretches at once: laid end to end they are one text, since each ends in a common end."""
        done, self.stretches, self.tokens = self.stretches, [], 0
        n_a, n_b = (np.array([len(s[k]) for s in done]) for k in (2, 3))
        a, b = (np.concatenate([s[k] for s in done]) for k in (2, 3))
        groups = links = np.zeros(len(done), "i8")
        digests, pairs, counts, places = [""] * len(done), np.empty(0, "i8"), np.empty(0, "i4"), np.zeros(len(done) + 1, "i4")
        if len(a):
            groups, links, pieces, (of, pairs, counts) = self._cut(a, b, n_a, n_b)
            np.cumsum(np.bincount(of, minlength=len(done)), out=places[1:])
            ends = np.cumsum(n_a + n_b)
            for k, (_, _, x, _, digest, final) in enumerate(done):
                if len(x):
                    text = b"".join(pieces[ends[k] - n_a[k] - n_b[k] : ends[k]])
                    digest.update(text[:-1] if final else text)
                    digests[k] = digest.hexdigest() if final else None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s[0] for s in done], pa.int64()), pa.array([s[1] for s in done], kind), pa.array(n_a), pa.array(n_b), pa.array(groups), pa.array(links),
                pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(places), pa.array(pairs)), pa.ListArray.from_arrays(pa.array(places), pa.array(counts)),
            ],
            ["key", "doc_id", *(c.split()[0] for c in SWEEP.split(", "))],
        )

    def _cut(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups and links per stretch, the groups' text in pieces, and the distinct pairs of each with their counts."""
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        total = int(end_a[-1]) + 1
        at_a, at_b = np.zeros(total, bool), np.zeros(total, bool)
        at_a[end_a], at_b[end_b] = True, True
        ends = np.flatnonzero(at_a | at_b)
        # The token that covers what lies before an end is the first of its side to end there or later.
        of_a, of_b = (np.cumsum(at[ends]) - at[ends] for at in (at_a, at_b))
        closes = np.zeros(total, bool)
        closes[end_a[np.cumsum(n_a)[n_a > 0] - 1]] = True
        closes = closes[ends]
        stretch = np.flatnonzero(n_a > 0)[np.cumsum(closes) - closes]
        both = at_a[ends] & at_b[ends]
        links, groups = np.bincount(stretch, minlength=len(n_a)), np.bincount(stretch[both], minlength=len(n_a))
        # Groups follow each other, each with its A tokens and then its B tokens.
        shut_a, shut_b = at_b[end_a], at_a[end_b]
        upto_a, upto_b = np.flatnonzero(shut_a) + 1, np.flatnonzero(shut_b) + 1
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + np.r_[0, upto_b][group_a]] = self.shown[0][2 * a + shut_a]
        text[np.arange(len(b)) + upto_a[group_b]] = self.shown[1][2 * b + shut_b]
        # One number for stretch, A's and B's id, which sorts faster than three.
        ids_a, ids_b = (len(x) for x in self.sizes)
        code = np.sort((stretch * ids_a + a[of_a]) * ids_b + b[of_b])
        new = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        counts = np.diff(np.r_[new, len(code)]).astype("i4")
        rest, right = np.divmod(code[new], ids_b)
        of, left = np.divmod(rest, ids_a)
        return groups, links, text.tolist(), (of, left << 32 | right, counts)


def sweep(found: DataFrame, lengths: tuple[list[int], list[int]]) -> DataFrame:
    """Per stretch of a document that ends in a common end: counts, distinct pairs of ids (A's above 32 bits of B's) with theirs.

    The document's last stretch has the hash of its groups' text.
    """
    shared = found.sparkSession.sparkContext.broadcast(lengths)
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, state = zstandard.ZstdDecompressor(), _Sweep(shared.value)
        for batch in batches:
            docs = batch.column(1)
            for key, doc, side, last, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                state.take(key, doc, side, last, None if ids is None else _unpacked(ids, unpack))
                if state.tokens >= SWEPT or len(state.stretches) >= MOST_STRETCHES:
                    yield state.flush(docs.type)
            if state.stretches:
                yield state.flush(docs.type)

    ordered = found.repartition("key").sortWithinPartitions("key", "at", "side")
    return ordered.mapInArrow(run, f"key bigint, doc_id {kind}, {SWEEP}")


def _with_counts(links: DataFrame, known: DataFrame, total: int) -> DataFrame:
    """`links` with count and best of their pair, from `known`, already checkpointed."""
    if within(known):
        return links.join(F.broadcast(known), "pair")
    # Frequent pairs are bounded by their share of all links; of the others none is hot.
    frequent = F.col("count") >= max(2, int(total * FREQUENT))
    met = links.join(F.broadcast(known.where(frequent)), "pair", "left")
    rest = met.where(F.col("count").isNull()).select(*links.columns)
    return met.where(F.col("count").isNotNull()).unionByName(rest.join(known.where(~frequent), "pair"))


def align(docs: DataFrame, level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    swept = checkpoint(sweep(*events(docs, level, pieces)))
    links = swept.select("key", F.explode(F.arrays_zip("pairs", "counts")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.counts").cast("long").alias("links"))
    counted = checkpoint(links.groupBy("pair").agg(F.sum("links").alias("count")))
    best = counted.groupBy(F.col("pair").bitwiseAND((1 << 32) - 1).alias("b")).agg(F.max("count").alias("top"))
    known = counted.join(best, F.col("pair").bitwiseAND((1 << 32) - 1) == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    known = checkpoint(known)
    total = known.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    own = swept.select("key", "doc_id", "groups_sha256", *sums[:4], *(F.lit(0).cast("long").alias(c) for c in sums[4:]))
    scored = _with_counts(links, known, total).select(
        "key", *(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("doc_id", "groups_sha256")), *(F.lit(0).cast("long").alias(c) for c in sums[:4]),
        F.when(F.col("best"), F.col("links")).otherwise(0).alias("n_best"), (F.col("links") * F.col("count")).alias("count_sum"),
    )
    both = own.unionByName(scored).groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("groups_sha256").alias("groups_sha256"), *(F.sum(c).alias(c) for c in sums))
    return both.select("doc_id", *sums, "groups_sha256")
