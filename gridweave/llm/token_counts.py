"""Token counts of a unigram tokenizer by dynamic programming over a trie of pre-tokens.

A text's pre-tokens are its words, each behind the mark U+2581. A word's best segmentation maximises the sum of its
pieces' scores; the score of a prefix depends on that prefix alone, so the distinct pre-tokens of a group of documents
form a trie and each node's best score and token count are computed once, however many pre-tokens share it. A terminal
keeps its count for later groups of the task; beyond a bound they are computed anew, which changes no result.

The vocabulary is a public one; its order stands in for frequencies: log p falls with the log of a piece's rank. A
character that no piece covers costs its UTF-8 bytes, each one token. Of equal scores the fewer tokens count.

Defined cases: bytes that aren't UTF-8 count as U+FFFD; null and empty texts have no tokens; words of any length are segmented whole; rows that repeat each get
their row; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import valid_text

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose documents are segmented together, and terminals that a task keeps.
GROUP_WORDS, HELD = 500_000, 500_000
BYTE_SCORE = -16.0


def piece_scores(path: str = VOCABULARY) -> dict[str, float]:
    """Scores of all ordinary pieces of a vocabulary file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(rank + 2) - 2.0 for rank, p in enumerate(pieces)}


def endings(scores: dict[str, float]) -> dict[str, list[int]]:
    """By last character, the lengths of the pieces that end in it."""
    lengths: dict[str, set[int]] = {}
    for piece in scores:
        lengths.setdefault(piece[-1], set()).add(len(piece))
    return {char: sorted(found) for char, found in lengths.items()}


def trie_counts(tokens: list[str], scores: dict[str, float], ends_in: dict[str, list[int]]) -> dict[str, int]:
    """Tokens of the best segmentation of each of the sorted, distinct pre-tokens.

    In sorted order the pre-tokens are the terminals of a depth-first walk over their trie: `best` and `count` hold the
    nodes from the root to the present one, and a step goes back to the longest prefix shared with the last terminal.
    """
    best, count, out, last = [0.0], [0], {}, ""
    get = scores.get
    for token in tokens:
        shared, most = 0, min(len(last), len(token))
        while shared < most and last[shared] == token[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for i in range(shared + 1, len(token) + 1):
            char = token[i - 1]
            size = 1 if char < "\x80" else len(char.encode("utf-8", "surrogatepass"))
            top, n = best[i - 1] + BYTE_SCORE * size, count[i - 1] + size
            for length in ends_in.get(char, ()):
                if length > i:
                    break
                score = get(token[i - length : i])
                if score is not None:
                    total = best[i - length] + score
                    if total > top or (total == top and count[i - length] + 1 < n):
                        top, n = total, count[i - length] + 1
            best.append(top)
            count.append(n)
        out[token] = count[-1]
        last = token
    return out


def token_counts(docs: DataFrame, scores: dict[str, float] | None = None, held: int = HELD) -> DataFrame:
    """Per row: doc_id, n_pretokens, n_tokens. The vocabulary, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(piece_scores() if scores is None else scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, ends = shared.value, {}
        ends_in = endings(scores)
        for batch in batches:
            n_words, n_tokens, found, size = [], [], [], 0
            for k, text in enumerate(batch.column(1), 1):
                words = (text.as_py() or "").split()
                found.append(Counter(words))
                n_words.append(len(words))
                size += len(words)
                if size < GROUP_WORDS and k < batch.num_rows:
                    continue
                if len(ends) > held:
                    ends.clear()
                fresh = set().union(*found).difference(ends)
                counted = trie_counts(sorted(MARK + w for w in fresh), scores, ends_in)
                ends.update((token[1:], n) for token, n in counted.items())
                n_tokens += (sum(n * ends[w] for w, n in x.items()) for x in found)
                found, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", valid_text()).mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long")
