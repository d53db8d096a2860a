"""Token counts under a unigram piece model by dynamic programming over a shared trie.

The vocabulary of a SentencePiece file is used as a unigram model: a piece's log probability falls with its rank
(Zipf's law over the file's order), byte pieces serve characters that no piece covers. A pre-token is a word with
the word-start mark before it; its count is the number of pieces of the best segmentation (the highest sum; among
equals the fewest pieces).

A worker collects the distinct pre-tokens of a batch that it does not know yet, walks them in sorted order, which
is the depth-first order of their trie, and keeps the forward scores (best score and count for every position) of
the current path: a shared prefix is scored once. Counts at the ends of pre-tokens are stored by hash and reused
by later batches. Nothing is shuffled; each text is read once and whole.

Defined cases: null and blank texts have 0 tokens; repeated rows each come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_buffer, word_spans
from .token_output import Pretokens

MARK = "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[dict[str, float], float, int]:
    """Log probability of each ordinary piece, that of a byte, and the longest piece's length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (k + 2) for k in range(len(own))))
    scores = {model.id_to_piece(i): -math.log(k + 2) - total for k, i in enumerate(own)}
    return scores, -math.log(len(own) + 2) - total - 5.0, max(map(len, scores), default=1)


def forward(words: list[str], scores: dict[str, float], byte: float, longest: int) -> list[int]:
    """Pieces in the best segmentation of each of the sorted words, with the forward columns of shared prefixes kept."""
    out: list[int] = []
    best, count, last = [0.0], [0], ""
    for word in words:
        shared, limit = 0, min(len(last), len(word))
        while shared < limit and last[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            score, n = best[end - 1] + byte * size, count[end - 1] + size
            for start in range(max(0, end - longest), end):
                own = scores.get(word[start:end])
                if own is not None:
                    s = best[start] + own
                    if s > score or (s == score and count[start] < n):
                        score, n = s, count[start] + 1
            best.append(score)
            count.append(n)
        out.append(count[-1])
        last = word
    return out


@lru_cache(maxsize=2)
def _known(path: str) -> Pretokens:
    scores, byte, longest = pieces(path)

    def count(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = codes.tobytes()
        words = [MARK + raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        order = sorted(range(len(words)), key=words.__getitem__)
        out = np.zeros((len(words), 1), np.uint32)
        out[order, 0] = forward([words[i] for i in order], scores, byte, longest)
        return out

    return Pretokens(count)


def token_counts(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` with n_pretokens and n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(model_path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(len(keep)))
            words, tokens = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
            for a, b in slices(offsets, 4_000_000):
                own = offsets[a : b + 1] - offsets[a]
                codes = data[offsets[a] : offsets[b]]
                starts, ends, at = word_spans(codes, own)
                words[a:b] = np.diff(at)
                if len(starts):
                    place, _ = known.look_up(codes, starts, ends)
                    run_ = np.concatenate(([0], np.cumsum(known.ids[place], dtype=np.int64)))
                    tokens[a:b] = run_[at[1:]] - run_[at[:-1]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(words), pa.array(tokens)], names=[*keep, "n_pretokens", "n_tokens"])

    kept = docs.select(*keep).schema.add("n_pretokens", "long").add("n_tokens", "long")
    return docs.select(*keep, docs[text_col].alias("_text")).mapInArrow(run, kept)
