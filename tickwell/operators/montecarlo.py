"""Block-bootstrap forecasts (M1 to M12): paths are rows, made and reduced in parallel.

Block starts come from md5 of seed, path and block, so that results depend neither on partitions nor on the engine.
The pool of returns is one array of bounded length (a ticker's history), broadcast with the paths' plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def seed_of(ticker: str, date: str) -> int:
    """M10"""
    from zlib import crc32

    return crc32(f"{ticker}:{date}".encode())


def pool(rets: DataFrame, mode: str = "history") -> DataFrame:
    """(k, ret): numbered returns; `current` rescales each by its own EWMA deviation to the latest one."""
    known = rets.filter("ret IS NOT NULL")
    value = F.col("ret")
    if mode == "current":
        last = known.filter("sigma_adjusted > 1e-8").agg(F.max_by("sigma_adjusted", "date").alias("last_sigma"))
        known = known.filter("sigma_adjusted > 1e-8").join(F.broadcast(last))
        value = F.col("ret") / F.col("sigma_adjusted") * F.col("last_sigma")
    return known.select((F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("k"), value.alias("ret"))


def paths(spark: SparkSession, returns: DataFrame, horizon: int = 21, n_paths: int = 2000, block: int = 5, seed: int = 1) -> DataFrame:
    """M2: (path, day, growth) with growth 1 on day 0."""
    n = returns.count()
    if n < 30:
        raise ValueError("at least 30 returns are needed")
    block = max(1, min(block, n))
    blocks = -(-horizon // block)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("path").cast("string"), F.lit(":"), F.col("b").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / 2.0**48
    starts = spark.range(n_paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    steps = starts.withColumn("start", F.floor(drawn * n)).select("path", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    steps = steps.select("path", (F.col("b") * block + F.col("o") + 1).alias("day"), ((F.col("start") + F.col("o")) % n).alias("k")).filter(F.col("day") <= horizon)
    run = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    moved = steps.join(F.broadcast(returns) if n <= 1_000_000 else returns, "k")
    grown = moved.select("path", "day", F.product(1 + F.col("ret")).over(run).alias("growth"))
    return grown.union(spark.range(n_paths).select(F.col("id").alias("path"), F.lit(0).alias("day"), F.lit(1.0).alias("growth")))


def fan_bands(p: DataFrame, last_price: float = 1.0) -> DataFrame:
    """M3"""
    q = F.percentile("growth", F.lit([0.05, 0.25, 0.5, 0.75, 0.95]))
    return p.groupBy("day").agg(q.alias("q")).select("day", *[(F.col("q")[i] * last_price).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))])


def summarize(p: DataFrame, horizon: int) -> DataFrame:
    """M4"""
    g = F.col("growth")
    return p.filter(F.col("day") == horizon).agg(F.avg((g > 1).cast("double")).alias("prob_up"), (F.avg(g) - 1).alias("mean"), *[(F.percentile("growth", F.lit(q)) - 1).alias(f"p{int(q * 100):02d}") for q in (0.05, 0.5, 0.95)])


def dip_probabilities(p: DataFrame, dips: list[float]) -> DataFrame:
    """M5: share of paths that ever fall to 1 - dip."""
    low = p.groupBy("path").agg(F.min("growth").alias("low")).select("low", F.explode(F.lit(dips)).alias("dip"))
    return low.groupBy("dip").agg(F.avg((F.col("low") <= 1 - F.col("dip")).cast("double")).alias("prob"))


def lows(p: DataFrame) -> DataFrame:
    """(path, day, low): the first day of each path's lowest growth after day 0."""
    best = F.min(F.struct("growth", "day")).alias("m")
    return p.filter("day > 0").groupBy("path").agg(best).select("path", F.col("m.day").alias("day"), F.col("m.growth").alias("low"))


def best_entry(p: DataFrame) -> DataFrame:
    """M6: low and day statistics over the paths; days cut to whole numbers."""
    return lows(p).agg(
        F.percentile("low", F.lit(0.5)).alias("median_low"), F.percentile("low", F.lit(0.25)).alias("p25_low"),
        F.percentile("day", F.lit(0.5)).cast("int").alias("median_day"), F.percentile("day", F.lit(0.75)).cast("int").alias("p75_day"),
    )


def sample_stats(rets: DataFrame, span: int = 21) -> DataFrame:
    """For each ticker of (ticker, date, ret) the number of returns, current and historical volatility of a year,
    their ratio, drift, skew and excess kurtosis. The current deviation is exponentially weighted by age, so it is a
    plain weighted aggregate: with w = q^age and S0 = sum w, S1 = sum w x, S2 = sum w x^2, S00 = sum w^2 its variance is
    (S2 / S0 - (S1 / S0)^2) * S0^2 / (S0^2 - S00). Null where fewer than ten returns are known."""
    keep = 1 - 2 / (span + 1)
    known = rets.filter("ret IS NOT NULL").withColumn("age", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date"))) - 1)
    w, r, n = F.pow(F.lit(keep), F.col("age")), F.col("ret"), F.col("n")
    sums = known.groupBy("ticker").agg(
        F.count("*").alias("n"), F.sum(w).alias("s0"), F.sum(w * r).alias("s1"), F.sum(w * r * r).alias("s2"), F.sum(w * w).alias("s00"), F.stddev_samp(r).alias("sd"), F.avg(r).alias("m"),
        F.skewness(r).alias("g1"), F.kurtosis(r).alias("g2"),
    )
    square = F.col("s0") * F.col("s0")
    spread = F.greatest(F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), F.lit(2)), F.lit(0.0)) * F.try_divide(square, square - F.col("s00"))
    out = sums.withColumn("now", F.when(n >= 10, F.sqrt(spread)))
    year = 252**0.5
    return out.select(
        "ticker", n.alias("n_days"), (F.col("now") * year).alias("vol_current"), (F.col("sd") * year).alias("vol_history"), F.when(F.col("sd") > 0, F.col("now") / F.col("sd")).alias("vol_ratio"),
        (F.col("m") * 252).alias("drift"), F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)).alias("kurt"),
    )


def entry_histogram(p: DataFrame, horizon: int) -> DataFrame:
    """M6: on how many paths each session holds the lowest price."""
    days = p.sparkSession.range(1, horizon + 1).select(F.col("id").cast("int").alias("day"))
    return days.join(lows(p).groupBy("day").agg(F.count("*").alias("n")), "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def exit_returns(p: DataFrame, entry: DataFrame, target: float, stop: float) -> DataFrame:
    """M8: from entry(path, fill_day, price): the first session at target or stop after the fill, target first."""
    r = F.col("growth") / F.col("price") - 1
    after = p.join(entry, "path").filter(F.col("day") > F.col("fill_day")).withColumn("r", r)
    hit = after.groupBy("path").agg(F.min(F.when(F.col("r") >= target, F.col("day"))).alias("up"), F.min(F.when(F.col("r") <= -stop, F.col("day"))).alias("down"), F.max_by("r", "day").alias("end"))
    won = F.col("up").isNotNull() & (F.col("down").isNull() | (F.col("up") <= F.col("down")))
    value = F.when(won, F.lit(target)).when(F.col("down").isNotNull(), F.lit(-stop)).otherwise(F.col("end"))
    return entry.join(hit, "path", "left").select("path", "fill_day", F.coalesce(value, F.lit(0.0)).alias("ret"))


def dip_buy(p: DataFrame, dip: float, target: float, stop: float) -> DataFrame:
    """M9: waiting for a dip against buying now."""
    n = p.select("path").distinct().count()
    filled = p.filter((F.col("day") > 0) & (F.col("growth") <= 1 - dip)).groupBy("path").agg(F.min("day").alias("fill_day")).withColumn("price", F.lit(1 - dip))
    waited = exit_returns(p, filled, target, stop).agg(
        (F.count("*") / n).alias("fill_rate"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("avg_filled"),
        (F.coalesce(F.sum("ret"), F.lit(0.0)) / n).alias("avg_overall"), F.percentile("fill_day", F.lit(0.5)).cast("int").alias("median_fill_day"),
    )
    now = p.select("path").distinct().select("path", F.lit(0).alias("fill_day"), F.lit(1.0).alias("price"))
    bought = exit_returns(p, now, target, stop).agg(F.avg("ret").alias("now_avg"), F.avg((F.col("ret") > 0).cast("double")).alias("now_win"))
    return waited.join(F.broadcast(bought))


def equity_confidence(p: DataFrame, horizon: int, capital: float = 100.0, bench_total: float | None = None) -> DataFrame:
    """M7"""
    peak = F.max("growth").over(Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    per = p.withColumn("dd", F.col("growth") / peak - 1).groupBy("path").agg(F.max_by("growth", "day").alias("g"), F.min("dd").alias("dd"))
    q = [(F.percentile("g", F.lit(x)) * capital).alias(f"p{int(x * 100):02d}") for x in (0.05, 0.25, 0.5, 0.75, 0.95)]
    beat = F.lit(None).cast("double") if bench_total is None else F.avg((F.col("g") - 1 > bench_total).cast("double"))
    return per.agg(*q, F.avg((F.col("g") < 1).cast("double")).alias("prob_loss"), F.percentile("dd", F.lit(0.5)).alias("dd_median"), F.percentile("dd", F.lit(0.05)).alias("dd_worst5"), beat.alias("prob_beat"))


def business_days(start: Column, n: int) -> Column:
    """The n weekdays after a date."""
    days = F.sequence(F.date_add(start, 1), F.date_add(start, 2 * n + 7))
    return F.slice(F.filter(days, lambda d: F.weekday(d) < 5), 1, n)


def busday_count(start: Column, end: Column) -> Column:
    """Weekdays from start on and before end; null where end is."""
    days = F.sequence(start, F.date_sub(end, 1))
    return F.when(end > start, F.size(F.filter(days, lambda d: F.weekday(d) < 5))).when(end.isNotNull(), 0)


def limit_order(p: DataFrame, last: float) -> DataFrame:
    """The price that half of the paths reach, the share of paths that get there, and when."""
    best = best_entry(p)
    reached = lows_from_start(p).join(F.broadcast(best.select("median_low"))).agg(F.avg((F.col("low") <= F.col("median_low")).cast("double")).alias("fill_prob"))
    return best.join(F.broadcast(reached)).select((F.col("median_low") * last).alias("limit_price"), "fill_prob", "median_day", "p75_day")


def lows_from_start(p: DataFrame) -> DataFrame:
    """(path, low): the lowest growth of each path, day 0 included."""
    return p.groupBy("path").agg(F.min("growth").alias("low"))
