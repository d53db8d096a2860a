"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Rates r_d of documents minimise the sum of r log r - r + 1 subject to 0 <= r <= cap and, for every source, the sum
of r_d * size_d = target: the solution tilts exponentially, r = min(cap, exp(lambda_s * size / mean_s)). The dual
is convex and has one multiplier for each source; all are found together by safeguarded Newton steps, each of
which is a distributed sum over the histogram (source, size, documents). The histogram is built with map-side
combine, so a source with a third of all rows is as small as any other afterwards.

Rates become copies class by class (documents of one source and size). Classes in the middle are rounded along the
running sum of copies in order of size, whose error stays below one document; then the `largest` and the
`smallest` classes of each source are settled one after the other, each taking the copies that bring the words
taken so far closest to what they should be. Copies of a class are dealt to its documents in hash order within
buckets of bounded size. Nothing is random: reruns agree.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; each gets its share of all words, but
at most cap times its own, the rest going to the others by weight. That is the water level t with
sum(min(cap * size_s, weight_s * t)) = total, found from the sources sorted by cap * size / weight.

Defined cases: null text has size 0; documents of size 0 take nothing; a source of size 0 has target 0; rows with
repeated ids are documents of their own; an empty table gives an empty result; kept columns may have any names
(`prefix` tells them from the result's).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

WEIGHTS = (5, 2, 1)
BUCKET = 8192


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cap: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """sources(source, source_size) with weight and target; one row for each source."""
    order = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order % len(weights) + 1).cast("int"))
    table = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total, spent = F.sum("source_size").over(every), F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    table = table.withColumn("water", (total - spent) / left).withColumn("full", F.col("limit") / F.col("weight") <= F.col("water"))
    level_now = F.coalesce(F.first(F.when(~F.col("full"), F.col("water")), ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return table.withColumn("target", F.least("limit", F.col("weight") * level_now)).select("source", "source_size", "weight", "target")


def balance(histogram: DataFrame, sources: DataFrame, cap: int = 3, steps: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """sources with lambda and mean, from Newton steps kept inside a shrinking bracket."""
    state = materialise(
        sources.withColumn("mean", F.col("source_size") / F.greatest(F.col("n"), F.lit(1)))
        .withColumn("lam", F.lit(0.0)).withColumn("low", F.lit(-60.0)).withColumn("high", F.lit(60.0)), "multipliers"
    )
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(40.0))))
        sums = (
            histogram.join(state.filter("source_size > 0"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("s")
            .agg(F.sum(F.col("docs") * F.col("size") * rate).alias("f"), F.sum(F.when(rate < cap, F.col("docs") * F.col("size") * x * rate).otherwise(0.0)).alias("df"))
            .withColumnRenamed("s", "k")
        )
        low = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("low"))
        high = F.when(F.col("f") >= F.col("target"), F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - (F.col("f") - F.col("target")) / F.when(F.col("df") > 0, F.col("df"))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        off = F.coalesce(F.abs(F.col("f") - F.col("target")) / F.greatest("target", F.lit(1.0)), F.lit(0.0))
        state = materialise(
            state.join(sums, F.col("s").eqNullSafe(F.col("k")) & (F.col("source_size") > 0), "left").select(
                "s", "n", "source_size", "target", "mean",
                F.when((off <= tolerance) | F.col("f").isNull(), F.col("lam")).otherwise(step).alias("lam"),
                low.alias("low"), high.alias("high"), F.when(high - low > 1e-12, off).otherwise(0.0).alias("off"),
            ), "multipliers",
        )
        if (state.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
        state = state.drop("off")
    return state


def class_copies(rated: DataFrame, cap: int, largest: int, smallest: int) -> DataFrame:
    """(source, size, docs, copies) from (s, size, docs, rate, target): copies for all documents of a class together."""
    down, up = Window.partitionBy("s").orderBy(F.desc("size")), Window.partitionBy("s").orderBy("size")
    run = F.sum(F.col("rate") * F.col("docs")).over(Window.partitionBy("s", "middle").orderBy(F.desc("size")))
    placed = (
        rated.withColumn("head", F.row_number().over(down) <= largest).withColumn("tail", F.row_number().over(up) <= smallest)
        .withColumn("middle", ~F.col("head") & ~F.col("tail")).withColumn("run", run)
        .withColumn("copies", F.when(F.col("middle"), F.round("run") - F.round(F.col("run") - F.col("rate") * F.col("docs"))))
        .withColumn("copies", F.least("copies", F.col("docs") * cap).cast("long"))
    )
    ends = F.filter(F.sort_array(F.collect_list(F.when(~F.col("middle"), F.struct("size", "docs", "rate"))), asc=False), lambda c: c.size.isNotNull())
    per_source = placed.groupBy("s").agg(
        ends.alias("ends"), F.first("target").alias("target"), F.coalesce(F.sum(F.when(F.col("middle"), F.col("copies") * F.col("size"))), F.lit(0)).alias("done")
    )
    settle = F.expr(f"""
      aggregate(ends,
        struct(target - done AS due, aggregate(ends, 0D, (a, c) -> a + c.rate * c.docs * c.size) AS expected, CAST(array() AS array<bigint>) AS got),
        (acc, c) -> struct(
          acc.due - c.size * greatest(0L, least({cap} * c.docs, CAST(round((acc.due - (acc.expected - c.rate * c.docs * c.size)) / c.size) AS bigint))) AS due,
          acc.expected - c.rate * c.docs * c.size AS expected,
          concat(acc.got, array(greatest(0L, least({cap} * c.docs, CAST(round((acc.due - (acc.expected - c.rate * c.docs * c.size)) / c.size) AS bigint))))) AS got)).got""")
    ended = per_source.select("s", F.explode(F.arrays_zip(F.col("ends"), settle.alias("copies"))).alias("z"))
    ended = ended.select(F.col("s").alias("k"), F.col("z.ends.size").alias("z"), F.col("z.copies").alias("settled"))
    both = placed.join(ended, F.col("s").eqNullSafe(F.col("k")) & (F.col("size") == F.col("z")), "left")
    return both.select("s", "size", "docs", F.coalesce("settled", "copies").alias("copies"))


def mix(docs: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", cap: int = 3, weights: tuple = WEIGHTS, largest: int = 64, smallest: int = 64, keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Columns `keep` (all by default) with size, source_size, target, copies and taken, whose names start with `prefix`."""
    keep = docs.columns if keep is None else keep
    sized = docs.select(F.struct(*[F.col(c) for c in keep]).alias("_keep"), F.col(source_col).alias("_source"), size_of(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_spot"), F.col(id_col).alias("_id"))
    if set(keep) <= {id_col}:
        sized = materialise(sized, "sizes")  # the texts are read once only
    counted = sized.groupBy("_source", "size").agg(F.count("*").alias("docs"))
    histogram = materialise(counted.select(F.col("_source").alias("source"), "size", "docs"), "histogram")
    sources = histogram.groupBy("source").agg(F.sum("docs").alias("n"), F.sum(F.col("docs") * F.col("size")).alias("source_size"))
    told = targets(sources, cap, weights).join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select("s", "n", "source_size", "target")
    solved = balance(histogram, told, cap)
    x = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(40.0))))
    rated = histogram.filter("size > 0").join(solved, F.col("source").eqNullSafe(F.col("s"))).select("s", "size", "docs", rate.alias("rate"), "target")
    copies = class_copies(materialise(rated, "rates"), cap, largest, smallest)
    # deal a class's copies over buckets of bounded size, then over the documents of a bucket
    bucket = F.pmod(F.hash("_spot"), F.ceil(F.col("docs") / BUCKET).cast("int"))
    plan = materialise(copies.join(told.select(F.col("s").alias("k"), "source_size", "target"), F.col("s").eqNullSafe(F.col("k"))).select("s", F.col("size").alias("z"), "docs", "copies", "source_size", "target"), "copies")
    big = plan.filter(F.col("docs") > BUCKET).select("s", "z", "docs", "copies")
    fill = (
        sized.join(big, F.col("_source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).groupBy("s", "z", bucket.alias("b")).agg(F.count("*").alias("m"), F.first("docs").alias("docs"), F.first("copies").alias("copies"))
    )
    upto = F.sum("m").over(Window.partitionBy("s", "z").orderBy("b"))
    share = F.floor(F.col("copies") * upto / F.col("docs")) - F.floor(F.col("copies") * (upto - F.col("m")) / F.col("docs"))
    dealt = fill.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("b").alias("b2"), "m", share.alias("share"))
    own = sized.join(plan, F.col("_source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").withColumn("b", F.coalesce(bucket, F.lit(0)))
    own = own.join(dealt, F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("b") == F.col("b2")), "left")
    rank = F.row_number().over(Window.partitionBy("_source", "size", "b").orderBy("_spot", "_id"))
    n, c = F.coalesce("m", "docs"), F.coalesce("share", "copies")
    taken = F.floor(c / n) + F.when(rank <= c % n, 1).otherwise(0)
    out = own.withColumn("copies_", F.when(F.col("size") > 0, F.least(taken, F.lit(cap))).otherwise(0).cast("long"))
    totals = told.select(F.col("s").alias("t"), F.col("source_size").alias("source_size_"), F.col("target").alias("target_"))
    out = out.join(totals, F.col("_source").eqNullSafe(F.col("t")), "left")
    told_columns = {"size": F.col("size"), "source_size": F.col("source_size_"), "target": F.col("target_"), "copies": F.col("copies_"), "taken": F.col("copies_") * F.col("size")}
    return out.select("_keep.*", *[c.alias(prefix + name) for name, c in told_columns.items()])
