"""Periodic runs of words by Crochemore's partition refinement, and texts with their repetitions collapsed.

E_l is the partition of a text's positions by the l words that start there. E_{l+1} follows from E_l: two positions
stay together if they and their right neighbours are together in E_l. Where two neighbouring members of a class of
E_l are l apart, the l words stand twice in a row: a square whose root is primitive, since a shorter period would
put a member in between. Squares of one period at consecutive positions are one run: the longest stretch with that
smallest period.

The first `DENSE` partitions are refined for all texts of a batch together, on arrays: nearly all positions of
ordinary prose are alone in their class after a few words and leave. Positions whose class spans fewer than l words
leave too, as no square of a period of l or more can start in it. What is left goes on text by text with the
smaller-half strategy: only classes that split off in the last step, and never the largest part of a split, are used
to split others, so each position is touched at most log n times and a text of n words costs O(n log n), whatever
its repetitions. Classes are linked lists in order of position; distances of new neighbours are filed by length and
looked up when the partition of that length is reached.

Spark deals the rows; a task holds one slice of a batch, and the state of one text at a time. Words are compared by
64-bit hashes.

Defined cases: null, empty and blank texts have no words, no runs and the empty collapsed text; every row comes
back, repeated ones and rows without id too; extra columns may have any names; a text of any length is handled
whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import WORD, mix, slices, text_buffer, trim, word_hashes, words

#: Partitions that are refined on arrays for all texts of a slice.
DENSE = 8
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


def dense_squares(codes: np.ndarray, at: np.ndarray, levels: int = DENSE):
    """Squares (level, flat start) with roots of up to `levels` words, and the classes left in E_levels.

    codes: word hashes, text after text; at: first word of each text and the end. The classes come as a number for
    each position, -1 for positions that left."""
    n = len(codes)
    lengths = np.diff(at)
    ends = np.repeat(at[1:], lengths)
    cls = np.full(n + 1, -1, np.int64)
    pos = np.arange(n)
    key = mix(codes ^ mix(np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)))
    found: list[tuple[int, np.ndarray]] = []
    for level in range(1, levels + 1):
        order = np.argsort(key, kind="stable")
        key, own = key[order], pos[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
        last = np.append(first[1:], len(key)) - 1
        near = own[1:][(np.diff(own) == level) & (key[1:] == key[:-1])] - level
        found.append((level, near))
        wide = own[last] - own[first] >= level if len(own) else np.zeros(0, bool)
        group = np.repeat(np.where(wide, np.arange(len(first)), -1), last - first + 1)
        cls[:] = -1
        cls[own] = group
        if level == levels:
            break
        pos = np.flatnonzero(cls >= 0)
        pos = pos[(pos + level < ends[pos]) & (cls[pos + 1] >= 0)]
        key = cls[pos] * np.int64(len(first) + 1) + cls[pos + 1]
    return found, cls[:n]


def sparse_squares(cls: list[int], level: int) -> list[tuple[int, int]]:
    """Squares (period, start) of one text with periods above `level`, from its classes of E_level (-1: alone)."""
    n = len(cls)
    cls.append(-1)
    before, after = [-1] * n, [-1] * n
    members: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(cls):
        if c >= 0:
            members[c].append(i)
    filed: dict[int, list[int]] = defaultdict(list)
    head, size = {}, {}
    name = max(members, default=0)

    def link(c: int, own: list[int], least: int) -> None:
        head[c], size[c] = own[0], len(own)
        last = -1
        for i in own:
            cls[i], before[i] = c, last
            if last >= 0:
                after[last] = i
                if i - last >= least:
                    filed[i - last].append(last)
            last = i
        after[last] = -1

    for c, own in members.items():
        link(c, own, level + 1)
    # at first every class splits others, and so does what has left
    splitters = [*members.values(), *([i + 1] for own in members.values() for i in own if cls[i + 1] < 0)]
    squares = []
    while splitters and 2 * (level + 1) <= n:
        pieces: dict[int, list[list[int]]] = {}
        for splitter in splitters:
            touched: dict[int, list[int]] = {}
            for i in splitter:
                c = cls[i - 1]  # of position 0: the end's, which is -1
                if c >= 0:
                    touched.setdefault(c, []).append(i - 1)
            for c, own in touched.items():
                pieces.setdefault(c, []).append(own)
        level += 1
        splitters = []
        for c, parts in pieces.items():
            rest = size[c] - sum(map(len, parts))
            if rest == 0:  # the largest part stays
                largest = len(parts.pop(max(range(len(parts)), key=lambda k: len(parts[k]))))
                if not parts:
                    continue
            else:
                largest = rest
            for own in parts:
                for i in own:
                    p, s = before[i], after[i]
                    if p >= 0:
                        after[p] = s
                    else:
                        head[c] = s
                    if s >= 0:
                        before[s] = p
                        if p >= 0 and s - p >= level:
                            filed[s - p].append(p)
            size[c] = largest
            most = max(parts, key=len)
            if len(most) <= largest:
                most = None
            else:  # what stays is smaller than a part: it splits others in that part's place
                i, stays = head[c], []
                while i >= 0:
                    stays.append(i)
                    i = after[i]
                splitters.append(stays)
            for own in parts:
                if own is not most:
                    splitters.append(own)
                if len(own) > 1:
                    name += 1
                    link(name, own, level)
                else:
                    cls[own[0]] = after[own[0]] = -1
            if size[c] == 1:
                cls[head[c]] = -1
        # a pair may have been parted and joined again, so it may be filed twice
        squares += [(level, i) for i in set(filed.pop(level, ())) if after[i] == i + level]
    return squares


def find_runs(codes: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of at least max(least, 2 * period) words, in that order."""
    dense, cls = dense_squares(codes, at)
    flat = [np.stack((np.searchsorted(at, i, "right") - 1, np.full(len(i), level), i), 1) for level, i in dense]
    for text in np.unique(np.searchsorted(at, np.flatnonzero(cls >= 0), "right") - 1):
        a, b = int(at[text]), int(at[text + 1])
        if longer := sparse_squares(cls[a:b].tolist(), DENSE):
            own = np.array(longer, np.int64)
            flat.append(np.stack((np.full(len(own), text), own[:, 0], own[:, 1] + a), 1))
    squares = np.concatenate(flat).astype(np.int64)
    if len(squares) == 0:
        return np.zeros((0, 4), np.int64)
    squares = squares[np.lexsort((squares[:, 2], squares[:, 1], squares[:, 0]))]
    begins = np.flatnonzero(np.concatenate(([True], (np.diff(squares[:, :2], axis=0) != 0).any(1) | (np.diff(squares[:, 2]) != 1))))
    text, period, start = squares[begins].T
    length = np.diff(np.append(begins, len(squares))) - 1 + 2 * period
    runs = np.stack((text, start - at[text], length, period), 1)[length >= np.maximum(least, 2 * period)]
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def collapse(text: str | None, runs: np.ndarray) -> str:
    """The words of text, joined by one space, without those that a run holds after its first period."""
    # bytes.split parts at ASCII white space only
    own = (text or "").encode("utf-8", "surrogatepass").split()
    if len(runs):
        step = np.zeros(len(own) + 1, np.int64)
        np.add.at(step, runs[:, 0] + runs[:, 2], 1)
        np.add.at(step, runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(step[:-1]) == 0
        own = [w for w, k in zip(own, keep.tolist(), strict=True) if k]
    return b" ".join(own).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, keep: list[str], text: Column | str = "text", least: int = 12, runs_as: str = "runs", collapsed_as: str = "collapsed") -> DataFrame:
    """Columns `keep` with `runs_as` (array of start, length, period by start, then period; words count from 0) and
    `collapsed_as`, the text without repetitions. A run has at least max(least, 2 * period) words."""
    own = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    struct = pa.struct([(f.name, pa.int64()) for f in RUN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            _, sizes = text_buffer(column)
            for a, b in slices(sizes, 1 << 21):
                part = column.slice(a, b - a)
                codes, at = word_hashes(*text_buffer(part), lower=False)
                found = find_runs(codes, at, least)
                cuts = np.searchsorted(found[:, 0], np.arange(b - a + 1))
                texts = [collapse(t, found[cuts[i] : cuts[i + 1], 1:]) for i, t in enumerate(part.to_pylist())]
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], fields=list(struct)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), lists, pa.array(texts, pa.string())], names=[*keep, runs_as, collapsed_as])
        trim()

    schema = StructType([*own.select(*keep).schema, StructField(runs_as, ArrayType(RUN)), StructField(collapsed_as, StringType())])
    return own.mapInArrow(run, schema)


def looped(id_col: Column, text: Column) -> Column:
    """The contract's texts: those of every tenth crc32 of the id loop from word a on with period p, others stay."""
    w, h = words(text), F.crc32(id_col.cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.greatest(F.size(w), F.lit(1))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    chosen = (h % 10 == 0) & text.rlike(WORD)
    return F.when(chosen, F.array_join(F.concat(F.slice(w, 1, a), F.slice(again, 1, n - a)), " ")).otherwise(text)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of the result of periodic_runs."""
    best = F.expr("array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.withColumn("_best", best)
    return out.select(
        id_col, F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) DIV (-_best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
