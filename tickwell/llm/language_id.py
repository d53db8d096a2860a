"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a context tree of up to `order` bytes is learnt from labelled text. An unseen byte escapes to
the next shorter context; escape probabilities follow method C (distinct continuations against their count plus
distinct ones), and below the empty context all 256 bytes are equally likely. With frozen statistics the code
length of a byte depends on its last `order` bytes alone, so a text is a bag of sequences of order + 1 bytes: each
distinct one of a slice of texts is looked up once in each language's tree.

Training reads at most about `sample` documents of each language (drawn by a hash of their ids, whole texts) and
keeps every language and every sequence of those. A tree is sparse: only the contexts and continuations that were
seen, as sorted arrays; Spark counts them. So the model grows with the sampled text, never with the alphabet.

Results: the language with the shortest code; its score is the posterior 1 / sum(2**(L_best - L_i)) under equal
priors. Null text, text without any letter, and every text where nothing could be learnt give `und` with score 0.
Ties go to the language first in code-point order. Rows are never dropped; repeated rows each come back. Columns
of docs that clash with the result's names are the caller's to rename: `lang_as` and `score_as` name the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import fresh, slices, text_buffer, trim

ORDER = 3


def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> counts of all 4-grams of bytes; each text is preceded by three zero bytes."""
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(names)):
            data, offsets = text_buffer(batch.column(1).filter(pa.array(names == lang)))
            for a, b in slices(offsets, 2_000_000):
                padded, _ = _padded(data, offsets, a, b)
                gram = _codes(padded)
                found, counts = np.unique(gram[_real(padded, offsets, a, b)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def _padded(data, offsets, a, b):
    """Bytes of rows a..b with ORDER zero bytes before each, and the rows' starts in them."""
    own = offsets[a : b + 1] - offsets[a]
    rows = np.arange(b - a)
    out = np.zeros(int(own[-1]) + ORDER * (b - a), np.uint8)
    starts = own[:-1] + ORDER * (rows + 1)
    place = np.arange(int(own[-1])) + ORDER * (np.repeat(rows, np.diff(own)) + 1)
    out[place] = data[offsets[a] : offsets[b]]
    return out, starts


def _codes(padded):
    x = padded.astype(np.uint32)
    out = x.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= x[:-k] << np.uint32(8 * k)
    return out


def _real(padded, offsets, a, b):
    mask = np.ones(len(padded), bool)
    own = offsets[a:b] - offsets[a] + ORDER * np.arange(b - a)
    for k in range(ORDER):
        mask[own + k] = False
    return mask


class Tree:
    """One language's context tree as code lengths in bits. Sequences and contexts are little numbers with the last
    byte lowest: `long` and `middle` are the sequences of 4 and 3 bytes that were seen, `escape` what leaving a
    context costs, and `short` has every sequence of 2 bytes, whose escapes are worked in."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.long, self.long_bits, self.context, self.escape = self._order(gram.astype(np.uint32), count)
        self.middle, self.middle_bits, at, cost = self._order(gram.astype(np.uint32) & np.uint32(0xFFFFFF), count)
        self.middle_escape = np.zeros(1 << 16, np.float32)
        self.middle_escape[at] = cost
        one, one_bits, _, cost = self._order(gram.astype(np.uint32) & np.uint32(0xFF), count)
        base = np.full(256, 8.0) + cost[0]
        base[one] = one_bits
        two, two_bits, at, cost = self._order(gram.astype(np.uint32) & np.uint32(0xFFFF), count)
        self.short = np.tile(base, (256, 1))
        self.short[at] += cost[:, None]
        self.short = self.short.ravel().astype(np.float32)
        self.short[two] = two_bits

    @staticmethod
    def _order(gram: np.ndarray, count: np.ndarray):
        """Distinct sequences with their bits, and distinct contexts with the bits of an escape."""
        found, back = np.unique(gram, return_inverse=True)
        n = np.bincount(back, count)
        context, first = np.unique(found >> np.uint32(8), return_index=True)
        total, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(found)))
        own = np.repeat(total + kinds, kinds)
        return found, -np.log2(n / own).astype(np.float32), context, -np.log2(kinds / (total + kinds)).astype(np.float32)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each sequence after the three before it."""
        three = gram & np.uint32(0xFFFFFF)
        out = self.short[gram & np.uint32(0xFFFF)] + self.middle_escape[three >> np.uint32(8)]
        at, seen = _find(self.middle, three)
        out[seen] = self.middle_bits[at[seen]]
        at, seen = _find(self.context, gram >> np.uint32(8))
        out[seen] += self.escape[at[seen]]
        at, seen = _find(self.long, gram)
        out[seen] = self.long_bits[at[seen]]
        return out


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class Model:
    """The trees of all languages, in code-point order of their names."""

    def __init__(self, trees: dict[str, Tree]):
        self.langs = sorted(trees)
        self.trees = [trees[x] for x in self.langs]

    def lengths(self, padded: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each row (starts are where the rows' own bytes begin) in each language."""
        out = np.zeros((len(starts), len(self.langs)))
        sizes = np.diff(np.append(starts, len(padded) + ORDER)) - ORDER
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        gram, own = _codes(padded), np.ones(len(padded), bool)
        for k in range(1, ORDER + 1):
            own[starts - k] = False
        found, back = np.unique(gram[own], return_inverse=True)
        cuts = np.concatenate(([0], np.cumsum(sizes)[:-1]))[some]
        for i, tree in enumerate(self.trees):
            out[some, i] = np.add.reduceat(tree.bits(found)[back], cuts, dtype=np.float64)
        return out


def learn(docs: DataFrame, learnable: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample: int = 1500) -> Model | None:
    """Model from rows where `learnable` holds and lang is not null: about `sample` documents of every language.
    None if there are no such rows."""
    rows = docs.filter(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)).alias("spot"))
    share = rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share"))
    drawn = rows.join(F.broadcast(share), "lang").filter("spot < share * 1000000").select("lang", "text")
    counts = drawn.mapInArrow(grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).toArrow()
    trees = {}
    for row in range(found.num_rows):
        gram, n = (found[name].chunk(0) if found[name].num_chunks == 1 else found[name].combine_chunks() for name in ("gram", "n"))
        trees[found["lang"][row].as_py()] = Tree(gram[row].values.to_numpy(zero_copy_only=False), n[row].values.to_numpy(zero_copy_only=False).astype(np.float64))
    return Model(trees) if trees else None


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """docs' columns `keep` (all by default) with the predicted language and its score."""
    keep = docs.columns if keep is None else keep
    at = keep.index(text_col) if text_col in keep and docs.schema[text_col].dataType == StringType() else None
    text = [F.col(text_col).alias(fresh(keep, "_text"))] if at is None else []  # a text that is kept is sent once
    source, flag = len(keep) if at is None else at, len(keep) + len(text)
    letters = docs.select(*keep, *text, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(fresh(keep, "_letters")))
    if model is None:
        return letters.select(*keep, F.lit("und").alias(lang_as), F.lit(0.0).alias(score_as))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, "und"], object)
        for batch in batches:
            data, offsets = text_buffer(batch.column(source))
            letters = np.array(batch.column(flag).to_pylist(), bool)
            best, score = np.full(len(letters), len(own.langs)), np.zeros(len(letters))
            for a, b in slices(offsets, 250_000):
                bits = own.lengths(*_padded(data, offsets, a, b))
                low = bits.min(1, keepdims=True)
                best[a:b] = bits.argmin(1)
                score[a:b] = 1 / np.exp2(np.maximum(low - bits, -1000.0)).sum(1)
            best[~letters], score[~letters] = len(own.langs), 0.0
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*keep, lang_as, score_as])
        trim()

    kept = letters.select(*keep).schema.add(lang_as, "string").add(score_as, "double")
    return letters.mapInArrow(run, kept)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2
