"""Codes of vectors in four bytes, with codebooks found by partial-distance search.

Each component x becomes the integer floor(1024 * x). A vector is cut into `PARTS` equal consecutive parts, each of
which is coded by the nearest entry (squared Euclidean distance, ties to the lower index) of its part's codebook.
Codebooks start as the vectors of the smallest ids; each round assigns all parts and puts each entry at the
componentwise floor of its parts' mean; entries without parts stay.

The nearest entry is searched by partial distances: dimensions are visited in descending variance of the codebook,
the integer distances of all entries grow dimension by dimension, and an entry is dropped by a vectorised mask as
soon as its accumulated distance strictly exceeds the best complete distance known so far. That one is found early,
by completing the most promising entry after the first dimensions, and is bettered as the search goes on. Everything
is integer, so results don't depend on how rows are dealt.

Each round is one pass of Spark over the rows: a task sends its sums for each entry, which Spark adds up; the driver
gets one row for each entry (at most 1,024), never a vector of the table besides the first 256. Labels of any
skew are summed map-side.

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped. Vectors of another
length than the smallest id's, or whose length isn't a multiple of four, come back with null code and error and
take no part. An id that repeats gives one first entry (its smallest vector) and a result row for each row; null ids
are first entries only when ids run out. Fewer ids than entries make smaller codebooks; an empty table gives no
rows. Components of 262,144 or more would make errors outgrow a long, and raise an error. Extra columns may have
any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import fresh, materialise, trim

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows searched at once: 256 entries each.
CHUNK = 2048
#: Scaled components stay below this, so that sums of squared differences fit a long.
MOST = 1 << 28


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that are kept, their integer components one after the other, their lengths)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    there = np.asarray(column.is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
    ends = np.cumsum(lengths)
    kept = there & (bad[ends] == bad[ends - lengths])
    x = np.floor(x[np.repeat(kept, lengths)] * SCALE)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"components of {MOST // SCALE} or more can't be coded: errors would outgrow a long")
    return np.flatnonzero(kept), x.astype(np.int64), lengths[kept]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the index of its nearest entry of book, and the squared distance."""
    n, width = rows.shape
    # entries * squares - square of sums: the variance in integers, whatever the scale
    spread = len(book) * (book.astype(object) ** 2).sum(0) - book.astype(object).sum(0) ** 2
    order = np.array(sorted(range(width), key=lambda d: (-spread[d], d)), np.int64)
    rows, book = rows[:, order], book[:, order]
    blocks = np.array_split(np.arange(width), max(1, width // 4))
    partial = np.zeros((n, len(book)), np.int64)
    for d in blocks[0]:
        partial += (rows[:, d, None] - book[None, :, d]) ** 2
    hopeful = partial.argmin(1)
    best = ((rows - book[hopeful]) ** 2).sum(1)
    row, entry = np.nonzero(partial <= best[:, None])
    partial = partial[row, entry]
    for block in blocks[1:]:
        for d in block:
            partial = partial + (rows[row, d] - book[entry, d]) ** 2
            stays = partial <= best[row]
            row, entry, partial = row[stays], entry[stays], partial[stays]
        # complete the most promising entry that is left of each row
        first = np.flatnonzero(np.diff(row, prepend=-1))
        least = np.minimum.reduceat(partial, first)
        at = np.flatnonzero(partial == least[row])
        at = at[np.flatnonzero(np.diff(row[at], prepend=-1))]
        best = np.minimum(best, ((rows - book[entry[at]]) ** 2).sum(1))
    done = np.flatnonzero(partial == best[row])
    done = done[np.flatnonzero(np.diff(row[done], prepend=-1))]  # entries ascend in a row: the lowest of equals
    return entry[done], best


def _coded(rows: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(n x PARTS entry numbers, n x PARTS squared distances)."""
    width = rows.shape[1] // PARTS
    codes, errors = np.zeros((len(rows), PARTS), np.int64), np.zeros((len(rows), PARTS), np.int64)
    for a in range(0, len(rows), CHUNK):
        for part in range(PARTS):
            if width:
                codes[a : a + CHUNK, part], errors[a : a + CHUNK, part] = nearest(rows[a : a + CHUNK, part * width : (part + 1) * width], books[part])
    return codes, errors


def first_books(vectors: DataFrame, id_col: str, vec_col: str, entries: int = ENTRIES) -> list[np.ndarray]:
    """The codebooks' first entries: the parts of the `entries` smallest ids' vectors. No codebooks for no rows."""
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.filter(F.col(vec_col).isNotNull() & usable).select(F.col(id_col).alias("i"), F.col(vec_col).alias("v"))
    lead = kept.orderBy(F.col("i").asc_nulls_last(), "v").limit(1).collect()
    if not lead:
        return []
    same = kept.filter(F.size("v") == len(lead[0]["v"])).groupBy("i").agg(F.min("v").alias("v"))
    few = same.orderBy(F.col("i").asc_nulls_last()).limit(entries).select("v").toArrow()["v"]
    _, flat, lengths = scaled(few)
    rows = flat.reshape(len(lengths), -1)
    if rows.shape[1] % PARTS:
        return []
    return np.split(rows, PARTS, axis=1)


def fit(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks, one array (entries x width) for each part."""
    books = first_books(vectors, id_col, vec_col, entries)
    if not books:
        return books
    size = sum(b.shape[1] for b in books)
    own = vectors.select(vec_col)
    schema = StructType([StructField("part", LongType()), StructField("entry", LongType()), StructField("n", LongType()), StructField("sums", ArrayType(LongType()))])
    width = size // PARTS
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(books)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            count = np.zeros((PARTS, len(now[0])), np.int64)
            sums = np.zeros((PARTS, len(now[0]), width), np.int64)
            for batch in batches:
                _, flat, lengths = scaled(batch.column(0))
                rows = flat[np.repeat(lengths == size, lengths)].reshape(int((lengths == size).sum()), size)
                codes, _ = _coded(rows, now)
                for part in range(PARTS):
                    count[part] += np.bincount(codes[:, part], minlength=len(now[0]))
                    np.add.at(sums[part], codes[:, part], rows[:, part * width : (part + 1) * width])
            part, entry = np.nonzero(count)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(sums[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), lists], names=schema.names)
            trim()

        added = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.lit(0)) if not width else F.array(*[F.sum(F.col("sums")[k]) for k in range(width)])
        told = own.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("sums")).collect()
        books = [b.copy() for b in books]
        for r in told:
            books[r["part"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        shared.unpersist()
    return books


def encode(vectors: DataFrame, books: list[np.ndarray], keep: list[str], vec_col: str = "embedding", code_as: str = "code", error_as: str = "error") -> DataFrame:
    """Columns `keep` of every kept row with its code (two hex digits for each part) and error."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    size = sum(b.shape[1] for b in books) if books else -1
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, flat, lengths = scaled(batch.column(len(keep)))
            fits = lengths == size
            code, error = np.full(len(at), None, object), np.zeros(len(at), np.int64)
            if fits.any():
                codes, errors = _coded(flat[np.repeat(fits, lengths)].reshape(int(fits.sum()), size), shared.value)
                text = digits[codes[:, 0]]
                for part in range(1, PARTS):
                    text = np.char.add(text, digits[codes[:, part]])
                code[fits], error[fits] = text, errors.sum(1)
            rest = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(len(keep))), pa.array(code, pa.string()), pa.array(error, mask=~fits)], names=[*keep, code_as, error_as])
        trim()

    own = vectors.select(*keep, F.col(vec_col).alias("_vec"))
    return own.mapInArrow(run, StructType([*vectors.select(*keep).schema, StructField(code_as, StringType()), StructField(error_as, LongType())]))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every kept row."""
    books = fit(vectors, id_col, vec_col, entries, rounds)
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    told = materialise(encode(own, books, ["id", "label"], "vec"), "codes")
    sums = told.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "key")
    name = fresh([id_col], "code")
    joined = told.join(sums, F.col("label").eqNullSafe(F.col("key")), "left")
    return joined.select(F.col("id").alias(id_col), F.col("code").alias(name), "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
