"""Token-ID output: documents as one concatenated id array with Elias-Fano coded boundaries.

Documents are range-partitioned and sorted by doc_id; every task encodes its rows and packs them into segments
of bounded size, one binary value each, which Spark writes as rows of a Parquet table (so any store that Spark
writes to will do, and a lost task is simply run again). A segment is

    magic 'TWEF', u8 version, u8 low bits l, u8 id width (2 or 4), u8 0,
    u32 documents n, u32 rows with null ids (they come first), u64 ids u,
    n x i64 doc_id, ceil(n*l/8) bytes of low bits, u32 length of the high bits in bytes, high bits,
    u32 number of select samples, samples (u32 bit place of every 64th one), u x id.

Boundary k (the end of document k) is (high << l) | low: its high part is select1(k) - k in the unary coded
bit vector. Within a segment no table of 64-bit offsets exists; between partitions only one total for each
partition goes to the driver.

Encoding. Byte-level BPE works on pre-tokens independently of each other, so pre-tokens are cut by array
operations, and the tokenizers library encodes each distinct one once per worker, or again after the table of known
ones was full and emptied. A text that contains a special
token's string is encoded by the library as a whole, as are files with other pre-tokenizers.

Defined cases: null text is the empty text (only the end id); null doc_ids come first, repeated ids in order of
their text; no rows give no rows.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, slices, span_hashes, trim

MAGIC = b"TWEF"
_SAMPLE = 64
#: Code points that are encoded at a time; their arrays are a hundred times as large in bytes.
SLICE = 250_000
#: Distinct pre-tokens that a worker knows at most.
KNOWN = 500_000
_SEP = 4
#: White_Space of Unicode.
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The contractions of the byte-level pattern.
_SHORT = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: 0 white space, 1 letter, 2 number, 3 other."""
    kinds = {"L": 1, "N": 2}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x110000)], np.uint8)
    table[_SPACES] = 0
    return table


def pretoken_spans(codes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the byte-level pre-tokens; `breaks` are the places of separators between texts."""
    kind = _classes()[codes]
    kind[breaks] = _SEP
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = kind[1:] != kind[:-1]
    word = np.zeros(len(codes), bool)
    word[:-1] = (kind[1:] >= 1) & (kind[1:] <= 3)
    last = (kind == 0) & word
    cut[:-1][last] = True
    held = np.flatnonzero(last & (codes == 32))
    cut[held + 1] = False
    marks = np.flatnonzero((codes == 39) & cut[:-1] & (kind == 3))
    for tail in _SHORT:
        spots = marks[marks + len(tail) < len(codes)]
        for j, c in enumerate(tail):
            spots = spots[codes[spots + 1 + j] == ord(c)]
        cut[spots + 1] = False
        cut[spots + 1 + len(tail)] = True
        marks = np.setdiff1d(marks, spots, assume_unique=True)
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts] != _SEP
    return starts[real], ends[real]


class Pretokens:
    """Known pre-tokens by hash, with their ids (or any small array); kept by a worker between tasks."""

    def __init__(self, encode, most: int = 4_000_000, dtype=np.uint32):
        self.encode, self.most, self.dtype = encode, most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def look_up(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each span, in self.ids."""
        keys, first, back = np.unique(span_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        spot = np.searchsorted(self.keys, keys)
        missing = np.ones(len(keys), bool)
        inside = spot < len(self.keys)
        missing[inside] = self.keys[spot[inside]] != keys[inside]
        if missing.any():
            spans = first[missing]
            found = self.encode(codes, starts[spans], ends[spans])
            sizes = np.array([len(x) for x in found], np.int64)
            base = len(self.ids)
            self.ids = np.concatenate([self.ids, *(np.asarray(x, self.dtype) for x in found)])
            where = spot[missing]
            self.at = np.insert(self.at, where, base + np.concatenate(([0], np.cumsum(sizes)[:-1])))
            self.size = np.insert(self.size, where, sizes)
            self.keys = np.insert(self.keys, where, keys[missing])
            spot = np.searchsorted(self.keys, keys)
        return self.at[spot][back], self.size[spot][back]


def ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices at[0], at[0]+1, ... for size[0], then those of the next, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - size), size)


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts with a separator after each, and the separators' places."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([len(x) + 1 for x in texts]) - 1


@lru_cache(maxsize=2)
def _encoder(path: str):
    """texts -> (ids of all, ids in each) with the file's tokenizer."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
    special = [x["content"] for x in told.get("added_tokens", [])]

    def of_spans(codes, starts, ends):
        text = codes.tobytes()
        pieces = [text[4 * a : 4 * b].decode("utf-32-le", "surrogatepass") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return [x.ids for x in known.encode_batch_fast(pieces, add_special_tokens=False)]

    cache = Pretokens(of_spans, KNOWN)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [i for i, x in enumerate(texts) if not plain or any(s in x for s in special)]
        apart = {i: np.array(known.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in whole}
        codes, breaks = joined_codes(["" if i in apart else x for i, x in enumerate(texts)])
        starts, ends = pretoken_spans(codes, breaks)
        at, size = cache.look_up(codes, starts, ends) if len(starts) else (np.zeros(0, np.int64),) * 2
        ids = cache.ids[ragged(at, size)]
        row = np.searchsorted(breaks, starts)
        counts = np.bincount(row, size, len(texts)).astype(np.int64)
        for i, own in apart.items():
            ids = np.insert(ids, counts[:i].sum(), own)
            counts[i] = len(own)
        return ids, counts

    return encode


def pack(ids: np.ndarray, ends: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """One segment: `ends` are the ends of the documents in `ids`, ascending; null doc_ids come first."""
    n, u = len(ends), len(ids)
    low_bits = max(0, (u // max(n, 1)).bit_length() - 1)
    high = (ends >> low_bits) + np.arange(n)
    unary = np.zeros((int(high[-1]) if n else 0) + 1, np.uint8)
    unary[high] = 1
    low = ((ends[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
    high_bytes, low_bytes = np.packbits(unary, bitorder="little").tobytes(), np.packbits(low.ravel(), bitorder="little").tobytes()
    samples = high[::_SAMPLE].astype("<u4")
    width = 2 if u == 0 or int(ids.max()) < 1 << 16 else 4
    nulls = sum(x is None for x in doc_ids)
    head = struct.pack("<4sBBBBIIQ", MAGIC, 1, low_bits, width, 0, n, nulls, u)
    return b"".join([
        head, np.array([x or 0 for x in doc_ids], "<i8").tobytes(), low_bytes, struct.pack("<I", len(high_bytes)), high_bytes,
        struct.pack("<I", len(samples)), samples.tobytes(), ids.astype(f"<u{width}").tobytes(),
    ])


class Segment:
    """A segment read back; documents are found by select on the boundary bits."""

    def __init__(self, blob: bytes):
        magic, version, self.low_bits, width, _, self.n, self.nulls, u = struct.unpack_from("<4sBBBBIIQ", blob)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token segment")
        at = struct.calcsize("<4sBBBBIIQ")
        self.doc_ids = np.frombuffer(blob, "<i8", self.n, at)
        at += 8 * self.n
        size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(blob, np.uint8, size, at)
        (high,) = struct.unpack_from("<I", blob, at := at + size)
        self.high = np.frombuffer(blob, np.uint8, high, at + 4)
        (count,) = struct.unpack_from("<I", blob, at := at + 4 + high)
        self.samples = np.frombuffer(blob, "<u4", count, at + 4)
        self.ids = np.frombuffer(blob, f"<u{width}", u, at + 4 + 4 * count)

    def _low(self, first: int, last: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(last - first, np.int64)
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(-1, self.low_bits)
        return bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def end(self, k: int) -> int:
        """End of document k: select1(k) from the nearest sample on, then the low bits."""
        place = int(self.samples[k // _SAMPLE])
        bits = np.unpackbits(self.high[place // 8 :], bitorder="little")[place % 8 :] if k % _SAMPLE else None
        if bits is not None:
            place += int(np.flatnonzero(bits)[k % _SAMPLE])
        return ((place - k) << self.low_bits) | int(self._low(k, k + 1)[0])

    def ends(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.end(k - 1) if k else 0 : self.end(k)]


SEGMENTS = "part int, segment int, first long, n_docs long, n_ids long, blob binary"


def write_segments(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, segment_ids: int = 250_000, partitions: int | None = None) -> DataFrame:
    """Rows of SEGMENTS, not yet written: part and segment order is doc_id order; `first` counts the ids of the
    part's earlier segments. A segment closes at `segment_ids` ids or 8192 documents; a longer document stands alone."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = source.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer_path)
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        kept: list[tuple[np.ndarray, np.ndarray, list]] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sizes = np.concatenate(([0], np.cumsum([len(x) for x in texts])))
            for a, b in slices(sizes, SLICE):
                got, counts = encode(texts[a:b])
                ends = np.cumsum(counts + 1)
                full = np.full(int(ends[-1]), end_id, np.uint32)
                inner = np.ones(len(full), bool)
                inner[ends - 1] = False
                full[inner] = got
                kept.append((full, ends, ids[a:b]))
                if sum(len(x[0]) for x in kept) >= segment_ids or sum(len(x[1]) for x in kept) >= 8192:
                    row, first = _row(part, segment, first, kept)
                    yield row
                    segment, kept = segment + 1, []
        if kept:
            yield _row(part, segment, first, kept)[0]
        trim()

    return ordered.mapInArrow(run, SEGMENTS)


def _row(part: int, segment: int, first: int, kept: list) -> tuple[pa.RecordBatch, int]:
    ids = np.concatenate([x[0] for x in kept])
    shift = np.cumsum([0, *(len(x[0]) for x in kept)])
    ends = np.concatenate([x[1] + s for x, s in zip(kept, shift, strict=False)])
    blob = pack(ids, ends, [d for x in kept for d in x[2]])
    columns = [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([first]), pa.array([len(ends)]), pa.array([len(ids)]), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "segment", "first", "n_docs", "n_ids", "blob"]), first + len(ids)


def read_segments(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from written segments."""
    spark = segments.sparkSession
    totals = sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    base = spark.createDataFrame(bases, "part int, base long") if bases else spark.createDataFrame([], "part int, base long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Segment(blob)
                ends = s.ends()
                starts = np.concatenate(([0], ends[:-1]))
                raw = memoryview(s.ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids, mask=np.arange(s.n) < s.nulls), pa.array(starts + start), pa.array(ends - starts), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )
        trim()

    found = segments.join(F.broadcast(base), "part").select((F.col("first") + F.col("base")).alias("start"), "blob")
    return found.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write docs as segments in the shared folder, read them back and describe each document."""
    return read_segments(materialise(write_segments(docs, tokenizer_path, **options), "segments"))
