"""Approximate nearest neighbours: inverted file with product-quantised residuals and exact reranking.

Fitting: coarse centroids and residual codebooks by k-means in numpy on at most `sample` vectors (those with the
smallest hashes of their ids). Indexing: every vector gets its coarse list and one byte for each sub-space of its
residual; lists are packed into blocks of about `block` vectors by a hash of the id, one row each, so that a list
with a third of all rows is many rows and tasks. Searching takes two passes over probed lists, in each of which
queries travel in chunks of about `chunk`, chunks meet the blocks of their lists in a join, and a task streams over
the meetings; asymmetric distance tables rank a block's codes for all queries of a chunk at once.

1. The `first` lists with the largest centroid products: the best codes are reranked exactly, and the k-th best
   product of a query is the least that its neighbours must reach.
2. The `probes` lists with the largest centroid products: only codes whose approximate product comes within `margin`
   of that least one are reranked, by exact double-precision products on the original vectors, and those that reach
   it leave the block, k at most for each query.

`probes` and `margin` are calibrated on the sample: probed lists hold `recall` of true neighbours, and all but 0.005
of exact products exceed the approximate one by less than the margin. A query with fewer than k results then visits
every list. Vectors without any structure need a large share of lists for a given recall.

Nearness is the largest inner product; ties go to the smaller vec_id. Vectors of each dimension are searched among
themselves. Vectors that are null, empty, zero, or hold null or non-finite components take no part. Rows that repeat
a vec_id and vector count once. An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, IntegerType

from .common import materialise


def kmeans(x: np.ndarray, k: int, seed: int, steps: int = 12) -> np.ndarray:
    draw = np.random.default_rng(seed)
    x = x.astype(np.float64)
    k = min(k, len(x))
    centres = x[draw.choice(len(x), k, replace=False)]
    for _ in range(steps):
        own = nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[draw.integers(0, len(x), k)])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    norms = (centres**2).sum(1)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norms - 2 * x[a : a + 4096] @ centres.T).argmin(1)
    return out


@dataclass
class Index:
    centres: np.ndarray  # lists x dimensions
    books: np.ndarray  # sub-spaces x codes x dimensions of a sub-space (padded with zeros)
    width: int

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, subspaces: int, seed: int = 5) -> Index:
        centres = kmeans(x, lists, seed)
        rest = x - centres[nearest(x, centres)]
        width = -(-x.shape[1] // subspaces)
        rest = np.pad(rest, ((0, 0), (0, width * subspaces - x.shape[1])))
        books = np.stack([np.pad(b := kmeans(rest[:, s * width : (s + 1) * width], 256, seed + s), ((0, 256 - len(b)), (0, 0)), constant_values=1e6) for s in range(subspaces)])
        return cls(centres, books, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(x, self.centres)
        rest = x - self.centres[own]
        rest = np.pad(rest, ((0, 0), (0, self.width * len(self.books) - x.shape[1])))
        codes = [nearest(rest[:, s * self.width : (s + 1) * self.width], book) for s, book in enumerate(self.books)]
        return own, np.stack(codes, 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Asymmetric tables: query x sub-space x code -> part of the inner product with the residual."""
        padded = np.pad(q, ((0, 0), (0, self.width * len(self.books) - q.shape[1]))).reshape(len(q), len(self.books), self.width)
        return np.einsum("qsw,scw->qsc", padded, self.books).astype(np.float32)

    def rough(self, q: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Approximate products of queries with the coded vectors of one list."""
        tables = self.tables(q)
        out = np.repeat((q @ self.centres[own]).astype(np.float32)[:, None], len(codes), axis=1)
        for s in range(codes.shape[1]):
            out += np.take(tables[:, s], codes[:, s], axis=1)
        return out

    def margin(self, x: np.ndarray, quantile: float = 0.995, queries: int = 64) -> float:
        """By how much exact products exceed approximate ones at the quantile, among the sample."""
        own, codes = self.encode(x)
        q = x[:queries]
        over = np.concatenate([(q @ x[own == k].T - self.rough(q, k, codes[own == k])).ravel() for k in np.unique(own)])
        return max(0.0, float(np.quantile(over, quantile)))


def calibrated_probes(index: Index, x: np.ndarray, k: int, recall: float, queries: int = 256) -> int:
    """Lists to probe so that they hold `recall` of the true neighbours, measured by brute force within the sample."""
    if len(x) < 2:
        return len(index.centres)
    q = x[:queries]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    top = np.argpartition(-scores, min(k, len(x) - 2), axis=1)[:, : min(k, len(x) - 1)]
    place = np.argsort(np.argsort(-(q @ index.centres.T), axis=1), axis=1)
    needed = np.take_along_axis(place, nearest(x, index.centres)[top], axis=1)
    return min(len(index.centres), int(np.quantile(needed, recall)) + 2)


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    v = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)))


SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """SCHEMA rows: the k nearest rows of every row where `is_query` holds, itself left out. Options: see search_alike."""
    kind = vectors.schema[vector_col].dataType
    plain = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vector_col) if plain else F.col(vector_col).cast("array<double>")
    rows = usable(vectors, vector_col).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).filter("vec_id IS NOT NULL")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [search_alike(rows.filter(F.size("v") == r["d"]), r["count"], k, **options) for r in sizes]
    return reduce(DataFrame.union, found) if found else vectors.sparkSession.createDataFrame([], SCHEMA)


def search_alike(
    rows: DataFrame, n: int, k: int, lists: int | None = None, probes: int | None = None, first: int = 8, subspaces: int = 16,
    sample: int = 16_384, block: int = 2048, chunk: int = 1024, recall: float = 0.94,
) -> DataFrame:
    """The search among the n rows(vec_id, v, q) of one dimension."""
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("v").toArrow()["v"].combine_chunks()
    x = _matrix(drawn)
    fitted = Index.fit(x, lists or max(1, min(4096, round(n**0.5))), max(1, min(subspaces, x.shape[1])))
    lists = len(fitted.centres)
    probes = probes or calibrated_probes(fitted, x, k, recall)
    margin, index = fitted.margin(x), spark.sparkContext.broadcast(fitted)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, codes = index.value.encode(_matrix(b.column(1)))
                columns = [*b.columns, pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "q", "list", "code"])

    table = materialise(rows.mapInArrow(coded, rows.select("*").schema.add("list", IntegerType()).add("code", BinaryType())), "vectors")
    # one row for each list, so never more than the lists
    sizes = F.broadcast(table.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1)).cast("int").alias("blocks")))
    member = F.struct("vec_id", "code", "v")
    packed = table.join(sizes, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), member.alias("m"))
    packed = materialise(packed.groupBy("list", "block").agg(F.collect_list("m").alias("members")), "blocks")

    def probing(most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, 1024):
                    part = b.slice(a, 1024)
                    near = np.argsort(-(_matrix(part.column(1)) @ index.value.centres.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                    probed = pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*part.columns, probed], names=["query_id", "qv", "least", "lists"])

        return run

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(list, members, queries) -> the products that reach a query's least one, k at most for each query and block."""
        for b in batches:
            for own, members, queries in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                yield _visit(index.value, own, members.values, queries.values, k, margin)

    def found(queries: DataFrame, most: int) -> DataFrame:
        """Rows (query_id, vec_id, score) from the `most` best lists of queries(query_id, qv, least)."""
        probed = queries.mapInArrow(probing(most), queries.select("*").schema.add("lists", ArrayType(IntegerType())))
        asked = probed.select(F.explode("lists").alias("list"), F.struct("query_id", "qv", "least").alias("q"))
        parts = asked.groupBy("list").agg(F.greatest(F.ceil(F.count("*") / chunk), F.lit(1)).cast("int").alias("parts"))
        dealt = asked.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("q.query_id", F.lit(9)), F.col("parts")))
        dealt = dealt.groupBy("list", "part").agg(F.collect_list("q").alias("queries")).join(sizes, "list")
        dealt = dealt.select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "queries")
        return dealt.hint("merge").join(packed, ["list", "block"]).select("list", "members", "queries").mapInArrow(visits, "query_id long, vec_id long, score double")

    best = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    queries = table.filter("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).distinct()
    none = F.lit(float("-inf"))
    early = materialise(found(queries.withColumn("least", none), min(first, probes)).distinct().withColumn("rank", F.expr(best)).filter(F.col("rank") <= k).drop("rank"), "early")
    least = early.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(none).alias("least"))
    late = found(queries.join(least, "query_id", "left").withColumn("least", F.coalesce("least", none)), probes)

    def ranked(rows: DataFrame) -> DataFrame:
        return rows.distinct().withColumn("rank", F.expr(best).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    results = materialise(ranked(early.union(late)), "found")
    enough = results.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select("query_id")
    short = queries.join(enough, "query_id", "left_anti")
    if probes >= lists or short.isEmpty():
        return results
    return results.join(enough, "query_id", "left_semi").union(ranked(found(short.withColumn("least", none), lists)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _visit(index: Index, own: int, members: pa.StructArray, queries: pa.StructArray, k: int, margin: float, at_once: int = 32) -> pa.RecordBatch:
    ids, v = members.field("vec_id").to_numpy(zero_copy_only=False), _matrix(members.field("v"))
    codes = np.frombuffer(b"".join(members.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
    asks, q, least = queries.field("query_id").to_numpy(zero_copy_only=False), _matrix(queries.field("qv")), queries.field("least").to_numpy(zero_copy_only=False)
    out = []
    for a in range(0, len(asks), at_once):
        some, low = slice(a, a + at_once), least[a : a + at_once]
        rough = index.rough(q[some], own, codes)
        rough[asks[some][:, None] == ids[None, :]] = -np.inf
        if len(ids) > 4 * k and np.isneginf(low).any():  # nothing to reach as yet: the best codes
            bar = np.partition(rough, len(ids) - 4 * k, axis=1)[:, len(ids) - 4 * k]
            bar = np.where(np.isneginf(low), bar, low - margin)
        else:
            bar = low - margin
        at, row = np.nonzero((rough >= bar[:, None]) & (rough > -np.inf))
        exact = np.einsum("ij,ij->i", v[row], q[some][at])
        good = exact >= low[at]
        at, row, exact = at[good], row[good], exact[good]
        order = np.lexsort((ids[row], -exact, at))
        at, row, exact = at[order], row[order], exact[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        out.append((asks[some][at[top]], ids[row[top]], exact[top]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])
