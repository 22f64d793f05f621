"""SentencePiece encoding by a merge-type prefix table, and decoding.

Merging always the best-scored adjacent pair gives every prefix of a text a last token that depends on that prefix
alone, and a sequence of tokens is what merging makes of a text exactly if each two neighbours are what merging makes of
their own characters. So the table holds one token per prefix: of the pieces that an automaton finds to end there, the
one that is compatible with the last token of the prefix before it. Ids are recovered backwards from the whole text's
last token. Compatibility of a pair is tested by undoing merges, the last one first: at no time may the two symbols at
the seam be a piece that merging would have preferred.

No piece runs across a mark U+2581 that follows another character, so a text falls into units, each a run of marks and
what follows. The distinct units of a group of documents are walked in sorted order, and units that share a prefix share
its rows of the table.

Only models that merge pairs, fall back on bytes and leave texts as they are but for a leading space are taken; others
are refused when the plan is made. Decoding is the library's own.

Defined cases: null and empty texts have no ids and decode to empty text; bytes that aren't UTF-8 count as U+FFFD, as
Python's decoder replaces them; U+2581 in a text is a space, as for the library; units of any length are encoded whole;
rows that repeat each get their row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of texts that are encoded together; characters of units, and pairs, that a task keeps for later groups.
GROUP_CHARS, HELD_CHARS, HELD_PAIRS = 4 << 20, 6 << 20, 1 << 20


@dataclass
class Merges:
    """A model's pieces: ids, scores, the pair that a piece is merged from last, and an automaton over those that merging reaches."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    halves: dict[str, tuple[str, str]] = field(default_factory=dict)
    steps: list[dict[str, int]] = field(default_factory=list)
    fails: list[int] = field(default_factory=list)
    ends: list[tuple[tuple[str, int], ...]] = field(default_factory=list)
    first: dict[str, bool] = field(default_factory=dict)


def read_model(model: bytes) -> Merges:
    """The pieces of a model file's content; a model that merging alone doesn't describe is an error."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    spec = proto.ModelProto.FromString(model)
    norm = spec.normalizer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or not plain:
        raise ValueError("the model must merge pairs, fall back on bytes and normalise nothing but a leading space")
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = pieces.get_piece_size()
    ordinary = [i for i in range(n) if spec.pieces[i].type == 1]
    if any(spec.pieces[i].type in (4, 5) for i in range(n)):
        raise ValueError("user-defined and unused pieces aren't supported")
    ids = {pieces.id_to_piece(i): i for i in ordinary}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece runs across the start of a word")
    found = Merges(ids, {p: pieces.get_score(i) for p, i in ids.items()}, [pieces.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
    reached = [p for p in ids if len(p) == 1 or _last_merge(p, found)]
    _automaton(found, reached)
    return found


def _last_merge(piece: str, model: Merges) -> bool:
    """Note the pair that merging the piece's characters joins last; false if they end in more than one token."""
    parts, scores = list(piece), model.scores
    while len(parts) > 1:
        best, at = max(((scores.get(parts[i] + parts[i + 1], float("-inf")), -i) for i in range(len(parts) - 1)))
        if best == float("-inf"):
            return False
        left, right = parts[-at], parts[1 - at]
        if any(len(x) > 1 and scores[x] < best for x in (left, right)):
            raise ValueError(f"{left + right!r} is preferred to one of its parts")
        if len(parts) == 2:
            model.halves[piece] = left, right
        parts[-at : 2 - at] = [left + right]
    return True


def _automaton(model: Merges, pieces: list[str]) -> None:
    """Per state, which is a prefix of a piece: steps by character, the longest suffix that is a state, and the pieces that end
    here, the longest first, each with the place of the prefix before it, counted from the end of the table.
    """
    steps: list[dict[str, int]] = [{}]
    own: dict[int, tuple[str, int]] = {}
    for piece in pieces:
        state = 0
        for char in piece:
            if char not in steps[state]:
                steps[state][char] = len(steps)
                steps.append({})
            state = steps[state][char]
        own[state] = piece, -len(piece)
    fails, ends = [0] * len(steps), [()] * len(steps)
    todo = deque(steps[0].values())
    for state in steps[0].values():
        ends[state] = (own[state],) if state in own else ()
    while todo:
        state = todo.popleft()
        for char, child in steps[state].items():
            back = fails[state]
            while back and char not in steps[back]:
                back = fails[back]
            fails[child] = steps[back].get(char, 0)
            ends[child] = ((own[child],) if child in own else ()) + ends[fails[child]]
            todo.append(child)
    model.steps, model.fails, model.ends, model.first = steps, fails, ends, dict.fromkeys(pieces, True)


def compatible(left: str, right: str, scores: dict[str, float], halves: dict[str, tuple[str, str]]) -> bool:
    """Whether merging the characters of both tokens ends in just these two.

    Merges fall in score, ties from left to right, so of two tokens' last merges the one with the lower score came
    later, and the right one's of equal ones. Before it was made, the symbols at the seam must not have been a piece
    that comes before it in that order.
    """
    if left + right in scores:
        return False
    while True:
        a, b = halves.get(left), halves.get(right)
        if a is None and b is None:
            return True
        if a is None or (b is not None and scores[right] <= scores[left]):
            undone, right = scores[right], b[0]
            seam = scores.get(left + right)
            if seam is not None and seam >= undone:
                return False
        else:
            undone, left = scores[left], a[1]
            seam = scores.get(left + right)
            if seam is not None and seam > undone:
                return False


def encode_units(units: list[str], model: Merges, known: dict[str, dict[str, bool]]) -> dict[str, list[int]]:
    """Ids of each of the sorted, distinct units; `known` keeps tested pairs, by left token."""
    steps, fails, ends, scores, halves = model.steps, model.fails, model.ends, model.scores, model.halves
    # Per prefix: the automaton's state, the last token, and which tokens may follow that; any may be the first.
    states, table, follow, out, before = [0], [""], [model.first], {}, ""
    for unit in units:
        shared, most = 0, min(len(before), len(unit))
        while shared < most and before[shared] == unit[shared]:
            shared += 1
        del states[shared + 1 :], table[shared + 1 :], follow[shared + 1 :]
        state = states[-1]
        for i in range(shared, len(unit)):
            char = unit[i]
            after = steps[state].get(char)
            while after is None and state:
                state = fails[state]
                after = steps[state].get(char)
            state, token = after or 0, char  # what no piece covers stands alone and falls back on bytes
            for piece, size in ends[state]:
                tests = follow[size]
                fits = tests.get(piece)
                if fits is None:
                    fits = tests[piece] = compatible(table[size], piece, scores, halves)
                if fits:
                    token = piece
                    break
            states.append(state)
            table.append(token)
            tested = known.get(token)
            if tested is None:
                tested = known[token] = {}
            follow.append(tested)
        out[unit] = _ids(table, len(unit), model)
        before = unit
    return out


def _ids(table: list[str], end: int, model: Merges) -> list[int]:
    """The tokens from the last one back, then turned round."""
    found = []
    while end:
        token = table[end]
        end -= len(token)
        at = model.ids.get(token)
        if at is None:
            found.extend(model.bytes_[b] for b in reversed(token.encode("utf-8")))
        else:
            found.append(at)
    found.reverse()
    return found


class Encoder:
    """Encodes groups of texts; units and pairs met before are kept within their bounds, which changes no result."""

    def __init__(self, model: Merges) -> None:
        self.model, self.units, self.chars, self.pairs = model, {}, 0, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        found = [UNIT.findall(MARK + text.replace(" ", MARK)) if text else [] for text in texts]
        if self.chars > HELD_CHARS:
            self.units, self.chars = {}, 0
        if sum(map(len, self.pairs.values())) > HELD_PAIRS:
            self.pairs = {}
        fresh = sorted(set().union(*found).difference(self.units))
        self.chars += sum(map(len, fresh))
        self.units.update((unit, array("i", ids).tobytes()) for unit, ids in encode_units(fresh, self.model, self.pairs).items())
        return [np.frombuffer(b"".join(map(self.units.__getitem__, units)), "i4") for units in found]


_LOADED: dict[bytes, Merges] = {}


def _loaded(model: bytes) -> Merges:
    """The model's tables, built once in a Python worker."""
    if model not in _LOADED:
        _LOADED.clear()
        _LOADED[model] = read_model(model)
    return _LOADED[model]


def recode(docs: DataFrame, vocabulary: str = VOCABULARY, decoded: bool = True) -> DataFrame:
    """Per row: doc_id, ids and, if wanted, what the ids decode to as `text`. The vocabulary file, read on the driver, is broadcast."""
    with open(vocabulary, "rb") as file:
        content = file.read()
    read_model(content)  # a model that isn't supported is refused now
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        encoder = Encoder(_loaded(shared.value))
        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                texts, size = [], 0
                while begin + len(texts) < batch.num_rows and size < GROUP_CHARS:
                    texts.append((batch.column(1)[begin + len(texts)].as_py() or b"").decode("utf-8", "replace"))
                    size += len(texts[-1])
                ids = encoder(texts)
                places = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                columns = [batch.column(0).slice(begin, len(texts)), pa.ListArray.from_arrays(places, pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([library.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "text"][: len(columns)])
                begin += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", text string" * decoded)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id and ids."""
    return recode(docs, vocabulary, decoded=False)


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of doc_id and ids: doc_id and text; null ids give empty text."""
    with open(vocabulary, "rb") as file:
        shared = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value)
        for batch in batches:
            texts = [library.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
