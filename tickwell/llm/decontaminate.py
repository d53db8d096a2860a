"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks. DataFrame operations only.

Documents and benchmark items are lower-cased word sequences with 5-word shingles (an item of fewer words is one
shingle of all its words). A window of a document has the size of an item. Its similarity to an item is the weighted
Jaccard similarity of the shingle multisets, a shingle of the item weighing log(1 + items / items that hold it), any
other the largest weight; a leak has a window of at least `similarity`.

One pass over the texts joins their shingles to the benchmark's and cuts a window wherever a shared shingle aligns
text and item; windows that share nothing have similarity 0 and are never built. Every window and item gets a 64-bit
SimHash of its shingles, weighted by multiplicity. Four blocks of 16 bits are indexed; items are filed under every
block value within `radius // 4` bits of their own, so that every pair within `radius` bits in all meets in a block
(pigeonhole). Pairs of text and item that meet so are verified first. What fingerprints can't promise, since words
may be put in or left out and windows lie beyond the radius, is left to an exact way: texts that hold one of an
item's rarest shingles, taken until they carry more than 1 - `similarity` of its weight, for without one of them no
window can reach `similarity`.

Verification tries every window that can be a pair's best. A window whose first shingle isn't the item's can move
right without losing, since it gives up a foreign shingle, which weighs the most; so the best window begins at one of
the item's shingles or ends with the text. Each such window's similarity follows from the places of the item's
shingles alone, so texts are never shuffled, only their shared shingles.

The benchmark's shingles are broadcast up to `broadcast_shingles` rows and joined by a shuffle beyond that. Hits
stay spread by text; a passage that many documents share adds rows in proportion to those documents.

Defined cases: texts are judged by themselves, so null and repeated ids make no difference, and a document without
an id has its rows under a null doc_id; columns other than id and text don't matter; null and blank texts match
nothing; an empty benchmark or empty table gives an empty result; repeated rows count once; documents shorter than an
item are compared whole. Of equally similar windows the first that begins at a shared shingle is told, with the
least distance of fingerprints that text and item met with (null if the exact way found them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialise, words

SHINGLE = 5
SCHEMA = "doc_id long, item_id long, start int, n_words int, similarity double, hamming int"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once: a lambda variable can't be inlined into the loops inside."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _runs(width: int):
    def hashed(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, width)]))

    return hashed


def _with_shingles(table: DataFrame, text: Column, width: Column | int) -> DataFrame:
    """Adds h: shingle hashes of `width` (at most SHINGLE) words each, in order."""
    own = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))
    if isinstance(width, int):
        return table.withColumn("h", _bound(own, _runs(width)))
    return table.withColumn("h", F.coalesce(*[F.when(width == k, _bound(own, _runs(k))) for k in range(1, SHINGLE + 1)]))


def simhash(hashes: str) -> Column:
    """64-bit SimHash of an array column of 64-bit hashes."""

    def bits(h: Column) -> Column:
        def bit(acc: Column, b: Column) -> Column:
            votes = F.aggregate(h, F.lit(0), lambda a, x: a + F.when(F.call_function("shiftright", x, b).bitwiseAND(1) == 1, 1).otherwise(-1))
            return acc.bitwiseOR(F.when(votes > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), bit)

    return _bound(F.col(hashes), bits)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.75, radius: int = 15, broadcast_shingles: int = 1_000_000
) -> DataFrame:
    """SCHEMA rows: for each document and item, the most similar window that reaches `similarity`."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th")).distinct()
    found = own.join(leaking_texts(docs, benchmark, text_col, similarity, radius, broadcast_shingles), "th")
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n_words", (-F.col("hamming")).alias("d"))).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).cast("int").alias("start"), "b.n_words", "b.similarity", (-F.col("b.d")).cast("int").alias("hamming"))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", similarity: float = 0.75, radius: int = 15, broadcast_shingles: int = 1_000_000) -> DataFrame:
    """SCHEMA rows by th, the text's hash, in place of doc_id: equal texts are searched once, and ids don't matter."""
    spark = docs.sparkSession
    n_words = F.size(words(F.lower(F.col("text"))))
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates().withColumn("n", n_words).filter("n > 0")
    items = _with_shingles(own.withColumn("width", F.least("n", F.lit(SHINGLE))), F.col("text"), F.col("width")).drop("text")
    items = materialise(items.withColumn("k", F.size("h")).withColumn("fp", simhash("h")).withColumn("no", F.xxhash64("item_id", "h")), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    if not widths:
        return spark.createDataFrame([], SCHEMA.replace("doc_id", "th"))
    n_items = items.count()
    places = items.select("no", "width", "k", F.posexplode("h").alias("place", "s"))
    rarity = places.groupBy("s").agg(F.log(1 + n_items / F.count_distinct("no")).alias("weight"))
    largest = F.lit(math.log(1 + n_items))
    weighed = materialise(places.groupBy("no", "s").agg(F.count("*").alias("tf")).join(rarity, "s"), "weighed")
    small = places.count() <= broadcast_shingles
    # an item's rarest shingles, as many as carry more than 1 - similarity of its weight: the others alone can't reach it
    mass = F.col("tf") * F.col("weight")
    all_, before = Window.partitionBy("no"), Window.partitionBy("no").orderBy(F.desc("weight"), "s").rowsBetween(Window.unboundedPreceding, -1)
    rare = weighed.withColumn("total", F.sum(mass).over(all_)).withColumn("before", F.coalesce(F.sum(mass).over(before), F.lit(0.0)))
    rare = rare.filter(F.col("before") <= (1 - similarity + 1e-9) * F.col("total")).select("no", "s", F.col("no").alias("rare"))
    vocabularies = materialise(
        places.join(rare, ["no", "s"], "left").groupBy("width", "s", "k", F.col("place").alias("item_place")).agg(F.collect_set("rare").alias("nos")), "vocabularies"
    )

    source = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").withColumn("th", F.xxhash64("text"))
    found: DataFrame | None = None
    for width in widths:
        vocabulary = vocabularies.filter(F.col("width") == width).drop("width")
        hits = _with_shingles(source, F.col("text"), width).select("th", "h", F.size("h").alias("m"), F.posexplode("h").alias("place", "s"))
        hits = hits.join(F.broadcast(vocabulary) if small else vocabulary, "s")
        start = F.greatest(F.lit(0), F.least(F.col("place") - F.col("item_place"), F.col("m") - F.col("k")))
        laid = hits.withColumn("start", start).withColumn("win", F.slice("h", F.col("start") + 1, F.col("k")))
        laid = laid.select("th", F.lit(width).alias("width"), "m", "k", "place", "s", "nos", "start", "win")
        found = laid if found is None else found.union(laid)
    # a window is cut once for all shingles that align it, before anything is shuffled; so is a shared place
    cut = found.groupBy("th", "width", "k", "start").agg(F.first("win").alias("win"), F.collect_set(F.struct("m", "place", "s", "nos")).alias("hits"))
    cut = materialise(cut.withColumn("fp", simhash("win")).drop("win"), "cut")
    hits = cut.select("th", "width", "k", F.explode("hits").alias("t")).select("th", "width", "k", "t.*")
    places_of = materialise(hits.groupBy("th", "width", "s", "place").agg(F.first("m").alias("m")), "places")

    def blocks(fp: str) -> Column:
        return F.expr(f"transform(sequence(0, 3), j -> struct(j AS j, CAST(shiftrightunsigned({fp}, 16 * j) & 65535L AS int) AS v))")

    near = F.lit([m for m in range(1 << 16) if m.bit_count() <= radius // 4])
    filed = items.select("no", "k", "width", F.col("fp").alias("item_fp"), F.explode(blocks("fp")).alias("b")).distinct()
    filed = filed.select("no", "k", "width", "item_fp", "b.j", "b.v", F.explode(near).alias("x")).select("no", "k", "width", "item_fp", "j", F.expr("v ^ x").alias("v"))
    asked = cut.select("th", "k", "width", "fp", F.explode(blocks("fp")).alias("b")).select("th", "k", "width", "fp", "b.j", "b.v")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    # always a shuffle join: filed items may outgrow a broadcast, and the cost should not jump when they do
    met = asked.join(filed.hint("merge"), ["k", "width", "j", "v"]).withColumn("hamming", distance).filter(F.col("hamming") <= radius)
    met = met.groupBy("th", "no").agg(F.min("hamming").alias("hamming"))

    held = weighed.groupBy("no").agg(F.collect_list(F.struct("s", "tf", "weight")).alias("bag")).join(items.select("no", "item_id", "n", "k", "width").distinct(), "no")

    def verified(pairs: DataFrame) -> DataFrame:
        """(th, no, item_id, n, start, similarity) of pairs (th, no): the best window of each, if it is good enough."""
        wanted = pairs.join(held, "no").select("th", "no", "item_id", "n", "k", "width", F.explode("bag").alias("e")).select("*", "e.s", "e.tf", "e.weight").drop("e")
        own = wanted.join(places_of, ["th", "width", "s"], "left")
        marks = own.groupBy("th", "no", "item_id", "n", "k", "s", "tf", "weight").agg(F.array_sort(F.collect_list("place")).alias("at"), F.max("m").alias("m"))
        mass = F.sum(F.col("tf") * F.col("weight"))
        marks = marks.groupBy("th", "no", "item_id", "n", "k").agg(F.max("m").alias("m"), mass.alias("mass"), F.collect_list(F.when(F.size("at") > 0, F.struct("s", "tf", "weight", "at"))).alias("e"))
        size = F.least("k", "m")
        starts = F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda e: F.transform(e["at"], lambda p: F.least(p, F.col("m") - size))))))
        ready = marks.withColumn("size", size).withColumn("starts", starts)
        # of each window: occurrences of every shingle of the item within it, then the three sums over them
        counted = F.transform("e", lambda e: F.struct(e["weight"].alias("w"), e["tf"].alias("tf"), F.size(F.filter(e["at"], lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("size")))).alias("n")))
        each = ready.select("th", "no", "item_id", "n", "size", "mass", "e", F.explode("starts").alias("first")).withColumn("c", counted)
        both = F.aggregate("c", F.lit(0.0), lambda a, c: a + c["w"] * F.least(c["tf"], c["n"]))
        known = F.aggregate("c", F.lit(0.0), lambda a, c: a + c["w"] * c["n"])
        foreign = (F.col("size") - F.aggregate("c", F.lit(0), lambda a, c: a + c["n"])) * largest
        scored = each.select("th", "no", "item_id", "n", "first", both.alias("both"), (F.col("mass") + known + foreign).alias("every"))
        scored = scored.withColumn("similarity", F.col("both") / (F.col("every") - F.col("both"))).filter(F.col("similarity") >= similarity)
        best = scored.groupBy("th", "no", "item_id", "n").agg(F.max(F.struct("similarity", (-F.col("first")).alias("s"))).alias("b"))
        return best.select("th", "no", "item_id", "n", (-F.col("b.s")).cast("int").alias("start"), "b.similarity")

    met = materialise(met, "met")
    sure = materialise(verified(met.select("th", "no")), "sure")
    beyond = hits.select("th", F.explode("nos").alias("no")).distinct().join(met.select("th", "no"), ["th", "no"], "left_anti")
    told = sure.join(met, ["th", "no"]).union(verified(beyond).withColumn("hamming", F.lit(None).cast("int")))
    best = told.groupBy("th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), F.col("n"), (-F.col("hamming")).alias("d"))).alias("b"))
    return best.select("th", "item_id", (-F.col("b.s")).cast("int").alias("start"), F.col("b.n").cast("int").alias("n_words"), F.col("b.similarity").alias("similarity"), (-F.col("b.d")).cast("int").alias("hamming"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without the documents whose text holds a benchmark passage."""
    leaks = leaking_texts(docs, benchmark, text_col, **options).select(F.col("th").alias(_own := fresh(docs.columns, "_leak"))).distinct()
    return docs.join(leaks, F.xxhash64(docs[text_col]) == F.col(_own), "left_anti")
