"""Significant moves and what explains them (V1 to V6), on each ticker's own bars."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.indicators import by_ticker, full, lag
from ..functions.interpret import signed

VOL_SPAN, HISTORY, FLOOR, MARKET_Z = 21, 20, 1e-6, 1.5

# Coefficients of the Chebyshev fit to erfc (relative error below 1.2e-7), by rising power.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, as one native expression."""
    t = 1 / (1 + 0.5 * x)
    power = F.lit(ERFC[-1])
    for k in reversed(ERFC[:-1]):
        power = F.lit(k) + t * power
    return t * F.exp(-x * x + power)


def two_sided_pvalue(z: Column | str) -> Column:
    """V1: the chance of a normal score of at least |z|."""
    return erfc(F.abs(F.col(z) if isinstance(z, str) else z) / 2**0.5)


def significance(bars: DataFrame) -> DataFrame:
    """(ticker, date, i, ret, rvol, z): each bar's return, its score against the deviation known the day before (no score
    while that is next to nothing or younger than 20 returns) and its volume against the 20 bars before."""
    base = bars.select(
        "ticker", "date", (F.row_number().over(by_ticker()) - 1).alias("i"), (F.try_divide("close", lag("close")) - 1).alias("ret"), "volume",
        full(F.avg("volume"), "volume", 20).alias("_mean"),
    )
    base = base.select("ticker", "date", "i", "ret", F.try_divide("volume", lag("_mean")).alias("rvol"))

    def deviations(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("i", kind="stable")
        d["sigma"] = d["ret"].ewm(span=VOL_SPAN, min_periods=HISTORY).std().shift(1)
        return d

    out = base.groupBy("ticker").applyInPandas(deviations, StructType([*base.schema, StructField("sigma", DoubleType())]))
    known = {c: F.when(~F.isnan(c), F.col(c)) for c in ("ret", "rvol", "sigma")}
    return out.withColumns(known).select("ticker", "date", "i", "ret", "rvol", F.when(F.col("sigma") > FLOOR, F.col("ret") / F.col("sigma")).alias("z"))


def moves(scored: DataFrame, z: float = 2.5, least: float = 0.01) -> DataFrame:
    """V2: bars whose score is `z` at least and whose return is `least` at least, either way."""
    found = scored.filter((F.abs("z") >= z) & (F.abs("ret") >= least))
    return found.withColumn("pvalue", two_sided_pvalue("z")).withColumn("direction", F.when(F.col("ret") > 0, "up").otherwise("down"))


def market_scores(bars: DataFrame, benchmark: str = "MKT") -> DataFrame:
    """V3: (date, bench_ret, bench_z), one row for each session."""
    return significance(bars.filter(F.col("ticker") == benchmark)).select("date", F.col("ret").alias("bench_ret"), F.col("z").alias("bench_z"))


MARKS = "ticker string, date date, kind string, dividend double, split double, title string"


def attribute(events: DataFrame, bars: DataFrame, marks: DataFrame, market: DataFrame) -> DataFrame:
    """V5: the catalyst of each event by priority earnings, split, dividend, news, market, unknown, with market_move,
    bench_ret, earnings_date and the headlines, which come along whatever the catalyst is.

    marks (MARKS) holds all catalysts: kinds earnings, action and news. An earnings date counts for the ticker's first
    bar on or after it and for the one after that; the earliest wins. Headlines count within a calendar day, the three
    newest. Each kind is given the bars or days it touches, so all joins are on equal keys."""
    dates = bars.select("ticker", "date", F.lit("bar").alias("kind"))
    both = dates.unionByName(marks.filter("kind = 'earnings'").select("ticker", "date", "kind"))
    # bars before an earnings date; on one day the date comes before the bar
    before = Window.partitionBy("ticker").orderBy("date", (F.col("kind") == "bar").cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("i", F.count(F.when(F.col("kind") == "bar", 1)).over(before)).filter("kind = 'earnings'")
    earned = placed.select("ticker", F.col("date").alias("earnings_date"), F.explode(F.array(F.col("i"), F.col("i") + 1)).alias("i")).groupBy("ticker", "i").agg(F.min("earnings_date").alias("earnings_date"))
    days = F.when(F.col("kind") == "news", F.array(F.date_sub("date", 1), F.col("date"), F.date_add("date", 1))).otherwise(F.array("date"))
    touched = marks.filter("kind <> 'earnings'").withColumn("day", F.explode(days))
    heads = F.slice(F.sort_array(F.collect_list(F.when(F.col("kind") == "news", F.struct(F.col("date").alias("news_date"), "title"))), asc=False), 1, 3)
    flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0.0)) != 0) & (F.col("kind") == "action"))
    near = touched.groupBy("ticker", F.col("day").alias("date")).agg(heads.alias("headlines"), flag("split").alias("_split"), flag("dividend").alias("_dividend"))
    joined = events.join(earned, ["ticker", "i"], "left").join(near, ["ticker", "date"], "left").join(market, "date", "left")
    moved = F.coalesce((F.signum("bench_z") == F.signum("z")) & (F.abs("bench_z") >= MARKET_Z), F.lit(False))
    catalyst = (
        F.when(F.col("earnings_date").isNotNull(), "earnings").when(F.col("_split"), "split").when(F.col("_dividend"), "dividend")
        .when(F.size("headlines") > 0, "news").when(moved, "market").otherwise("unknown")
    )
    none = F.array().cast("array<struct<news_date:date,title:string>>")
    out = joined.withColumn("market_move", moved).withColumn("catalyst", catalyst).withColumn("headlines", F.coalesce("headlines", none))
    return out.drop("i", "_split", "_dividend", "bench_z")


def api_events(events: DataFrame) -> DataFrame:
    """V6: newest first, with the chart's markers: where and how each event is drawn."""
    up = F.col("direction") == "up"
    text = F.concat(signed(F.col("ret") * 100), F.lit("%"))
    marker = F.struct(F.when(up, "belowBar").otherwise("aboveBar").alias("position"), F.when(up, "arrowUp").otherwise("arrowDown").alias("shape"), text.alias("text"))
    return events.withColumn("marker", marker).orderBy(F.desc("date"), "ticker")


def next_earnings(earnings: DataFrame, last: DataFrame) -> DataFrame:
    """The first earnings date after each ticker's last bar."""
    return last.join(earnings.withColumnRenamed("date", "e"), "ticker", "left").groupBy("ticker").agg(F.min(F.when(F.col("e") > F.col("date"), F.col("e"))).alias("next_earnings"))


def oracle_ctes(z: float = 2.5, least: float = 0.01) -> str:
    """V1 to V5 in SQL on the CTEs bars, earnings, actions and news: scored, market and events. Deviations come from
    running weighted sums, S0 = sum w, S1 = sum w x, S2 = sum w x^2 and S00 = sum w^2."""
    w = "PARTITION BY ticker ORDER BY date"
    keep = f"(1 - 2e0 / {VOL_SPAN + 1})"
    power = repr(ERFC[-1])
    for k in reversed(ERFC[:-1]):
        power = f"({k!r} + t * {power})"
    return f"""v0 AS (
  SELECT ticker, date, CAST(row_number() OVER ({w}) - 1 AS BIGINT) AS i, close / lag(close) OVER ({w}) - 1 AS ret, volume,
    CASE WHEN count(volume) OVER ({w} ROWS 19 PRECEDING) >= 20 THEN avg(volume) OVER ({w} ROWS 19 PRECEDING) END AS m20, lag(date, 2) OVER ({w}) AS two_before FROM bars),
v1 AS (SELECT *, volume / lag(m20) OVER ({w}) AS rvol FROM v0),
sg AS (
  SELECT ticker, i, 0e0 AS s0, 0e0 AS s1, 0e0 AS s2, 0e0 AS s00 FROM v1 WHERE i = 0
  UNION ALL
  SELECT v.ticker, v.i, {keep} * s0 + 1, {keep} * s1 + v.ret, {keep} * s2 + v.ret * v.ret, {keep} * {keep} * s00 + 1 FROM sg JOIN v1 v ON v.ticker = sg.ticker AND v.i = sg.i + 1),
sd AS (SELECT ticker, i + 1 AS i, CASE WHEN i >= {HISTORY} THEN sqrt(greatest(s2 / s0 - power(s1 / s0, 2), 0) * s0 * s0 / (s0 * s0 - s00)) END AS sigma FROM sg),
scored AS (SELECT v1.*, CASE WHEN sigma > {FLOOR!r} THEN ret / sigma END AS z FROM v1 LEFT JOIN sd USING (ticker, i)),
market AS (SELECT date, ret AS bench_ret, z AS bench_z FROM scored WHERE ticker = 'MKT'),
found AS (
  SELECT *, 1 / (1 + 5e-1 * abs(z) / sqrt(2e0)) AS t, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS direction
  FROM scored WHERE ticker <> 'MKT' AND abs(z) >= {z} AND abs(ret) >= {least}),
told AS (
  SELECT f.*, t * exp(-z * z / 2 + {power}) AS pvalue, m.bench_ret, coalesce(sign(bench_z) = sign(z) AND abs(bench_z) >= {MARKET_Z}, false) AS market_move,
    (SELECT min(e.date) FROM earnings e WHERE e.ticker = f.ticker AND e.date <= f.date AND (f.two_before IS NULL OR e.date > f.two_before)) AS earnings_date,
    (SELECT max(split) FROM actions a WHERE a.ticker = f.ticker AND a.date = f.date) AS split, (SELECT max(dividend) FROM actions a WHERE a.ticker = f.ticker AND a.date = f.date) AS dividend,
    coalesce((SELECT list({{'news_date': n.date, 'title': n.title}} ORDER BY n.date DESC, n.title DESC)[:3] FROM news n WHERE n.ticker = f.ticker AND n.date BETWEEN f.date - 1 AND f.date + 1), []) AS headlines
  FROM found f LEFT JOIN market m USING (date)),
events AS (
  SELECT *, CASE WHEN earnings_date IS NOT NULL THEN 'earnings' WHEN coalesce(split, 0) <> 0 THEN 'split' WHEN coalesce(dividend, 0) <> 0 THEN 'dividend'
    WHEN len(headlines) > 0 THEN 'news' WHEN market_move THEN 'market' ELSE 'unknown' END AS catalyst FROM told)"""
