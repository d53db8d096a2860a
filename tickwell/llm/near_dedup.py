"""MinHash near-duplicate detection with tensored banding.

Documents are sets of distinct 5-word shingles. Two small collections of `t` half keys (each of `width`
min-hashes) are computed; table (i, j) of the t*t hash tables is keyed by half keys u_i and v_j together, so
2*t*width min-hashes serve t*t tables of 2*width rows each.

Scale. Equal sets are one class from the start (grouped with map-side combine), so copies never meet in a table;
a class is known by its set fingerprint, not by an id, so null and repeated ids are judged like all others. A
bucket is searched by a star: its most central member (the one that shares most buckets with others) against the
rest, never member against member. The links found are merged into components. Members of buckets that still hold
several components are then searched exactly, without looking at buckets member by member: their shingles are
ordered from rare to common, and a pair that can reach `similarity` must share one of its first few shingles; how
few follows from both set sizes, so sizes are banded and each class files only what its own band and the other
need. Text that a crowd of documents shares is common and so stands last, outside of that prefix. Only pairs
across components are made. Pairs whose min-hash rows agree in fewer than half of the places are left out before
texts are read (a pair at 0.75 fails that with probability 2e-5), and every link is confirmed on full shingle
sets. Nothing is capped.

Defined cases: null or blank text has an empty set, is linked with nothing and kept; fewer than five words are
one shingle; repeated doc_id rows each come back, with the component of their own text; a null doc_id takes the
component of its text, which is null if no linked document has an id; columns other than id and text don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rounds, discard, materialise, mix, slices, text_buffer, trim, word_hashes

SHINGLE = 5
_PLACE = mix(np.arange(11, 11 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_CHUNK = 1_000_000  # bytes of text whose hashes are held at once; a longer text stands alone


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, concatenated, and the rows' offsets in them."""
    hashes, at = word_hashes(data, offsets)
    counts = np.diff(at)
    full = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for j in range(SHINGLE):
        full += mix(hashes[j : j + len(full)]) * _PLACE[j]
    full = mix(full)
    out: list[np.ndarray] = []
    for row, n in enumerate(counts):
        a = at[row]
        if n >= SHINGLE:
            out.append(np.unique(full[a : a + n - SHINGLE + 1]))
        elif n:
            short = np.add.reduce(mix(hashes[a : a + n]) * _PLACE[:n]) + np.uint64(n)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(hashes[:0])
    sizes = np.array([len(x) for x in out], np.int64)
    return (np.concatenate(out) if out else hashes[:0]), np.concatenate(([0], np.cumsum(sizes)))


def _signatures(t: int, width: int, seed: int):
    """Arrow function: (doc_id, th, text) -> set size, set fingerprint and the two collections of half keys."""
    n_hashes = 2 * t * width
    draw = np.random.default_rng(seed)
    masks = draw.integers(0, 2**64, n_hashes, dtype=np.uint64)
    factors = draw.integers(0, 2**64, n_hashes, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in slices(offsets, _CHUNK):
                own = offsets[a : b + 1] - offsets[a]
                shingles, at = shingle_sets(data[offsets[a] : offsets[b]], own)
                sizes = np.diff(at)
                rows, some = b - a, np.flatnonzero(sizes)
                first, second = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                halves = np.zeros((rows, 2 * t), np.uint64)
                marks = np.zeros((rows, n_hashes), np.int16)
                if len(some):
                    cuts = at[some]
                    first[some] = np.add.reduceat(mix(shingles), cuts)
                    second[some] = np.add.reduceat(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)), cuts)
                    for k in range(2 * t):
                        key = np.full(len(some), np.uint64(k + 1))
                        for j in range(k * width, (k + 1) * width):
                            least = mix(np.minimum.reduceat((shingles ^ masks[j]) * factors[j], cuts))
                            marks[some, j] = least.astype(np.uint16).view(np.int16)
                            key = mix(key * np.uint64(31) + least)
                        halves[some, k] = key
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * 2 * t, pa.int32()), pa.array(halves.ravel().view(np.int64)))
                rowwise = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * n_hashes, pa.int32()), pa.array(marks.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), batch.column(1).slice(a, rows), pa.array(sizes), pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), lists, rowwise],
                    names=["doc_id", "th", "n_shingles", "set_a", "set_b", "halves", "marks"],
                )
        trim()

    return run


def _verified(threshold: int):
    """Arrow function: pairs with both texts -> the pairs with 100 * intersection >= threshold * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            names = {n: k for k, n in enumerate(batch.schema.names)}
            a_ids, b_ids = (batch.column(names[x]).to_numpy(zero_copy_only=False) for x in ("a", "b"))
            keep = np.zeros(len(a_ids), bool)
            data, offsets = text_buffer(batch.column(names["text_a"]))
            centres, c_offsets = text_buffer(batch.column(names["text_b"]))
            for lo, hi in slices(offsets, _CHUNK):
                sets, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for row in range(lo, hi):
                    if last[0] != b_ids[row]:
                        own = centres[c_offsets[row] : c_offsets[row + 1]]
                        last = (b_ids[row], shingle_sets(own, np.array([0, len(own)]))[0])
                    x, y = sets[at[row - lo] : at[row - lo + 1]], last[1]
                    if not len(x) or not len(y):
                        continue
                    spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    both = int(np.count_nonzero(y[spot] == x))
                    keep[row] = 100 * both >= threshold * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a_ids[keep], pa.int64()), pa.array(b_ids[keep], pa.int64())], names=["a", "b"])
        trim()

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) -> the set of each row, as one array."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for a, b in slices(offsets, _CHUNK):
            sets, at = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=["rep", "s"])


def components(links: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable over links (a, b). Rounds of neighbour minima and
    pointer jumping; each round is a written table that replaces the one before, and only whether anything moved
    comes to the driver."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    edges = materialise(both, "edges")
    rounds = Rounds("labels")
    labels = rounds.next(edges.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = edges.join(labels.select(F.col("vertex").alias("b"), "component"), "b").groupBy(F.col("a").alias("vertex")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "vertex").select("vertex", "component", F.least("component", "near").alias("low"))
        jump = labels.select(F.col("vertex").alias("low"), F.col("component").alias("lower"))
        moved = F.least("low", "lower")
        step = rounds.next(lower.join(jump, "low").select("vertex", moved.alias("component"), (moved < F.col("component")).alias("moved")))
        labels = step.select("vertex", "component")
        if step.filter("moved").isEmpty():
            discard(edges)
            return labels


def prefix_pairs(sets: DataFrame, similarity: int, growth: float = 1.05) -> DataFrame:
    """(a, b) candidates across components from sets(rep, n, component, s): every pair of sets that reaches
    `similarity` percent is among them.

    Two sets of x and y shingles that do share at least c = ceil(similarity / (100 + similarity) * (x + y)), so in
    any common order one of the first x - c + 1 of the one is among the first y - c + 1 of the other. The order is
    by frequency, rarest first; a shingle in one set only is counted but never filed. Sizes are banded by `growth`,
    and a set is filed once for each band that a partner may have, with the prefix that the band's smallest needs."""
    share = similarity / (100 + similarity)
    told = sets.select("rep", "n", "component", F.explode("s").alias("s"))
    common = told.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = told.join(common, "s").groupBy("rep", "n", "component").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("c"))
    step = math.log(growth)
    band = lambda x: F.floor(F.log(x) / step + 1e-9).cast("int")
    low, high = F.ceil(F.col("n") * similarity / 100), F.floor(F.col("n") * 100 / similarity)
    bands = ranked.select("rep", "n", "component", "c", band(F.col("n")).alias("own"), low.alias("low"), F.explode(F.sequence(band(low), band(high))).alias("other"))
    least = F.greatest(F.col("low"), F.floor(F.exp(F.col("other") * step) - 1e-6))
    length = F.col("n") - F.ceil(share * (F.col("n") + least) - 1e-9) + 1
    # shingles of this set alone come first in its order
    take = F.greatest(F.lit(0), length - (F.col("n") - F.size("c"))).cast("int")
    filed = bands.select("rep", "n", "component", "own", "other", (F.col("n") - F.size("c")).alias("alone"), F.posexplode(F.slice("c", F.lit(1), take)).alias("at", "e"))
    # rest: shingles from this one on, which is what the pair can share if it is their first one in common
    filed = filed.select("own", "other", F.col("e.s").alias("s"), F.struct("rep", "n", "component", (F.col("n") - F.col("alone") - F.col("at")).alias("rest")).alias("x"))
    x = filed.filter("own <= other").select("s", F.col("own").alias("p"), F.col("other").alias("q"), "x")
    y = filed.filter("own >= other").select("s", F.col("other").alias("p"), F.col("own").alias("q"), F.col("x").alias("y"))
    fit = "x.component <> y.component AND (p < q OR x.rep < y.rep)"
    fit += f" AND {100 + similarity} * least(x.rest, y.rest) >= {similarity} * (x.n + y.n)"
    met = x.join(y, ["s", "p", "q"]).filter(fit)
    return met.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def _buckets(classes: DataFrame, t: int) -> DataFrame:
    """(key, rep, n, members): the buckets of the t*t tables that hold several classes.

    Such a bucket needs both of its half keys in several classes, so those are counted first, 2*t a class; a class
    then makes keys only of its shared half keys, which is far fewer than t*t where most texts have no copy."""
    halves = classes.select("rep", "n", F.posexplode("halves").alias("k", "half"))
    twice = halves.groupBy("k", "half").agg(F.count("*").alias("members")).filter("members > 1").select("k", "half")
    own = halves.join(twice.hint("merge"), ["k", "half"]).groupBy("rep", "n").agg(F.collect_list(F.struct("k", "half")).alias("own"))
    sides = own.select("rep", "n", F.expr(f"filter(own, x -> x.k < {t})").alias("u"), F.expr(f"filter(own, x -> x.k >= {t})").alias("v"))
    tables = F.expr("explode(flatten(transform(u, x -> transform(v, y -> xxhash64(x.k, y.k, x.half, y.half)))))")
    keyed = materialise(sides.select(tables.alias("key"), "rep", "n"), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = materialise(keyed.join(shared.hint("merge"), "key"), "buckets")
    discard(keyed)
    return buckets


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 75, t: int = 10, width: int = 3, seed: int = 7
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs. `similarity` is a percentage; a pair at 75 is
    found in one of the t*t tables with probability 0.992 by default, one at 0.8 with 0.998."""
    return classified(docs, id_col, text_col, similarity, t, width, seed).select("doc_id", "n_shingles", "component_id", "kept")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = 75, t: int = 10, width: int = 3, seed: int = 7) -> DataFrame:
    """near_duplicates with th, the hash of the row's text, and kept_th, that of the text which stands for the row's
    component: the one of its smallest id, the smallest hash where that id has several or none has an id."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    signed = materialise(
        source.mapInArrow(_signatures(t, width, seed), "doc_id long, th long, n_shingles long, set_a long, set_b long, halves array<long>, marks array<smallint>"), "signatures"
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    classes = signed.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(first, F.first("halves").alias("halves"), F.first("marks").alias("marks"))
    classes = materialise(classes.select(F.col("set_a").alias("rep"), "set_b", F.col("n_shingles").alias("n"), "first", "halves", "marks"), "classes")
    buckets = _buckets(classes, t)
    met = materialise(buckets.groupBy("rep").agg(F.sum("members").alias("central")), "met")
    wanted = classes.join(met, "rep").select("rep", "first.th")
    # copies are merged before their text is dealt by its hash, and the join needs no other dealing
    one = source.select("th", "text").dropDuplicates(["th"])
    texts = materialise(one.join(wanted.hint("merge"), "th").select("rep", "text"), "texts")
    marks = classes.select("rep", "marks")

    def verify(pairs: DataFrame) -> DataFrame:
        """Links among distinct pairs (a, b): by agreeing min-hashes first, then on full sets."""
        alike = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e)) >= t * width
        near = pairs.join(marks.select(F.col("rep").alias("a"), F.col("marks").alias("x")), "a")
        other = marks.select(F.col("rep").alias("rep_b"), F.col("marks").alias("y"))
        near = near.join(other, (F.col("b") == F.col("rep_b")) & alike).select("a", "b")
        told = near.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").join(
            texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b"
        )
        return materialise(told.mapInArrow(_verified(similarity), "a long, b long"), "links")

    members = buckets.join(met, "rep")
    centre = members.groupBy("key").agg(F.max(F.struct("central", "rep", "n")).alias("c")).select("key", F.col("c.rep").alias("b"), F.col("c.n").alias("m"))
    stars = buckets.select("key", F.col("rep").alias("a"), "n").join(centre, "key").filter("a <> b")
    links = verify(stars.filter(f"100 * least(n, m) >= {similarity} * greatest(n, m)").select("a", "b").distinct())
    joined = components(links).withColumnRenamed("vertex", "rep")
    told = buckets.join(joined, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = told.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_ = materialise(told.join(mixed.select("key"), "key").select("rep", "component").distinct(), "open")
    discard(buckets)
    discard(met)
    sets = texts.join(open_.select("rep"), "rep").mapInArrow(_shingles, "rep long, s array<long>").join(open_, "rep").withColumn("n", F.size("s"))
    sets = materialise(sets, "sets")
    across = verify(prefix_pairs(sets, similarity))
    for table in (sets, open_, texts):
        discard(table)
    joined = components(links.union(across)).withColumnRenamed("vertex", "rep")

    known = materialise(classes.select("rep", "set_b", "first").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "known")
    for table in (links, across, classes):
        discard(table)
    least = known.groupBy("component").agg(F.min("first").alias("least"))
    labels = known.join(least, "component").select(F.col("rep").alias("set_a"), "set_b", "least")
    out = signed.select("doc_id", "th", "n_shingles", "set_a", "set_b").join(labels, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("least.doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "th", F.when(F.col("n_shingles") > 0, F.col("least.th")).alias("kept_th"))
    return out.withColumn("kept", F.expr("doc_id <=> component_id"))
