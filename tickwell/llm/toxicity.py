"""Toxicity by compression distance: two zstandard dictionaries, one from ordinary and one from toxic text.

The ordinary dictionary holds what zstandard's trainer picks from windows of ordinary documents. The toxic one
has the same content and, behind it, the wording of toxic documents: every word that starts or reads like nothing
in ordinary text does. Words and word beginnings of 4 to 6 letters count by the distinct neighbourhoods they stand
in, so that copies of one document count once, and are significant if their log-likelihood ratio against ordinary
text exceeds what chance gives among so many; all words with a significant part are taken. (zstandard's trainer
alone finds passages that documents share and everyday words, not this wording; the README has figures.) Both
dictionaries have the same length, the ordinary one filled up with blanks, so match offsets cost alike and the
difference of the two compressed lengths of a window is what the toxic wording saves. Windows of `WINDOW` words
run over the whole text. A logistic model of (total gain, largest gain, share of gaining windows), fitted on the
learning rows and corrected for the sampling of the classes, turns the differences into a score; the gain from
which a window counts is the one of `THRESHOLDS` that explains the learning rows best.

Learning reads at most about `sample` labelled documents of each class (drawn by a hash of their ids, whole
texts); counting words is a Spark job, and the driver gets only the chosen words, a bounded set of ordinary
windows and a few features a document. Nothing depends on the language.

Defined cases: null and blank texts have no windows and score as a text without gains; repeated rows each come
back; without labels of both classes every score is the share of the one class seen, or 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import discard, lower_ascii, materialise, words

WINDOW = 16
THRESHOLDS = (2, 3, 4, 5, 6, 8)
_EDGES = r"^[\p{Punct}]+|[\p{Punct}]+$"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    threshold: int = THRESHOLDS[0]
    weights: np.ndarray = field(default_factory=lambda: np.array([-50.0, 0, 0, 0]))  # intercept, then one for each feature


def _gains(ordinary: bytes, toxic: bytes, thresholds: tuple[int, ...]):
    """text -> for each threshold: total gain, largest gain and share of windows that gain so much, of the toxic over
    the ordinary dictionary."""
    import zstandard as z

    def length(content: bytes):
        settings = z.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=3, strategy=z.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        return z.ZstdCompressor(dict_data=held, compression_params=settings).compress

    plain, other = length(ordinary), length(toxic)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

    def gains(text: str | None) -> list[float]:
        w = (text or "").encode("utf-8", "replace").translate(lower).split()
        pieces = (b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW))
        found = np.array([len(plain(x)) - len(other(x)) for x in pieces])
        out: list[float] = []
        for t in thresholds:
            high = found[found >= t]
            out += [math.log1p(high.sum()), float(high.max(initial=0)), len(high) / max(len(found), 1)]
        return out

    return gains


def _drawn(rows: DataFrame, id_col: str, sample: int) -> tuple[DataFrame, dict[int, float]]:
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    share = {k: min(1.0, sample / n) for k, n in counts.items()}
    spot = F.pmod(F.xxhash64(F.col(id_col), F.lit(29)), F.lit(1_000_000))
    limit = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(v * 1_000_000)) for k, v in share.items()], F.lit(0.0))
    return rows.filter(spot < limit), share


def _toxic_words(rows: DataFrame) -> list[str]:
    """Words with a part that is far commoner in toxic rows, least frequent first."""
    own = F.transform(words(lower_ascii(F.col("text"))), lambda w: F.regexp_replace(w, _EDGES, ""))
    at = rows.select("toxic", own.alias("w")).select("toxic", F.explode(F.expr("transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS near))")).alias("s"))
    seen = at.filter("length(s.word) > 1").groupBy("s.word", "s.near").agg(F.max("toxic").alias("a"), F.max(1 - F.col("toxic")).alias("b"))
    counts = seen.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    parts = F.expr("concat(array(concat(word, ' ')), transform(filter(array(4, 5, 6), k -> length(word) >= k), k -> left(word, k)))")
    parts = materialise(counts.select("word", "a", "b", F.explode(parts).alias("part")), "parts")
    told = parts.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = told.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    if not total["n"] or not total["a"] or not total["b"]:
        return []
    share = total["a"] / (total["a"] + total["b"])
    a, b = F.col("a"), F.col("b")
    n = a + b
    ratio = 2 * (a * F.log(a / (n * share)) + F.when(b > 0, b * F.log(b / (n * (1 - share)))).otherwise(0.0))
    strong = told.filter((a >= 4) & (a * (1 - share) > 6 * b * share)).filter(ratio > 2 * math.log(10 * total["n"]))
    chosen = parts.join(strong.select("part"), "part", "left_semi").filter("a > 1 AND a > b").groupBy("word").agg(F.max("a").alias("a"))
    out = [r["word"] for r in chosen.orderBy("a", "word").collect()]
    discard(parts)
    return out


def learn(docs: DataFrame, labels: DataFrame, learnable: Callable[[str], Column], id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, dictionary: int = 16_384, windows: int = 20_000) -> Model:
    """Dictionaries and calibration from the labelled documents whose id column meets learnable(its name). The trainer
    of the ordinary dictionary gets `windows` distinct windows of the drawn documents."""
    import zstandard as z

    marks = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").groupBy("_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    few, share = _drawn(marks.filter(learnable("_id")), "_id", sample)
    # two classes of about `sample` ids each, whatever the size of the tables
    rows = materialise(texts.join(F.broadcast(few), "_id"), "drawn")
    chosen = _toxic_words(rows)
    cut = F.expr(f"transform(sequence(0, size(w) - 1, {WINDOW}), i -> array_join(slice(w, i + 1, {WINDOW}), ' '))")
    pieces = rows.filter("toxic = 0").select(words(lower_ascii(F.col("text"))).alias("w")).filter("size(w) > 0").select(F.explode(cut).alias("x")).distinct()
    ordinary = [r["x"].encode("utf-8", "replace") for r in pieces.orderBy(F.xxhash64("x"), "x").limit(windows).collect()]
    try:
        core = z.train_dictionary(dictionary, ordinary).as_bytes()[-dictionary * 3 // 4 :] if len(ordinary) > 50 else b" ".join(ordinary)
    except z.ZstdError:  # the trainer refuses very small or very uniform samples
        core = b" ".join(ordinary)[-dictionary:]
    wording = b" " + b" ".join(w.encode("utf-8", "replace") for w in chosen) + b" "
    model = Model(core + b" " * len(wording), core + wording)
    found = _features(rows.select("_id", "toxic", "text"), model, ["toxic"], "text", THRESHOLDS).select("toxic", "x").toArrow()
    discard(rows)
    toxic, x = found["toxic"].to_numpy().astype(float), np.array(found["x"].to_pylist(), float).reshape(-1, len(THRESHOLDS), 3)
    fits = [_logistic(x[:, k], toxic, share) for k in range(len(THRESHOLDS))]
    best = min(range(len(fits)), key=lambda k: fits[k][1])
    model.threshold, model.weights = THRESHOLDS[best], fits[best][0]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def _logistic(x: np.ndarray, y: np.ndarray, share: dict[int, float]) -> tuple[np.ndarray, float]:
    """Weights of a ridge logistic regression by Newton steps, and its loss; classes drawn by unlike shares are
    weighted back."""
    if len(y) == 0 or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return np.array([50.0 if rate == 1 else -50.0, 0, 0, 0]), 0.0
    scale = np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    weight = np.where(y == 1, 1 / share.get(1, 1.0), 1 / share.get(0, 1.0))
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * w
        w -= np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-2 * np.eye(len(w)), grad)
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -float((weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum())
    return np.concatenate((w[:1], w[1:] / scale)), loss


def _features(docs: DataFrame, model: Model, keep: list[str], text_col: str, thresholds: tuple[int, ...]) -> DataFrame:
    """Columns `keep` with x, the features of each threshold one after the other."""
    shared = docs.sparkSession.sparkContext.broadcast((model.ordinary, model.toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _gains(*shared.value, thresholds)
        for batch in batches:
            x = pa.array([own(t.as_py()) for t in batch.column(len(keep))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), x], names=[*keep, "x"])

    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, docs.select(*keep).schema.add("x", ArrayType(DoubleType())))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Columns `keep` with score and predicted (1 from the threshold on)."""
    w = [float(v) for v in model.weights]
    told = F.lit(w[0]) + F.col("x")[0] * w[1] + F.col("x")[1] * w[2] + F.col("x")[2] * w[3]
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), told))))
    scored = _features(docs, model, keep, text_col, (model.threshold,)).withColumn("score", chance)
    return scored.select(*keep, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
