"""Indicators over finite windows, as columns of one frame; windows share one partitioning by ticker.

The frame is that of a panel: densified, it has a row for each ticker and session, and a session without a bar counts
as a row of nulls; one ticker's own bars are such a panel without gaps. A full window is needed: one that is short or
holds a null gives null. Changes over n sessions carry the last close over gaps; running sums and maxima skip rows
without a value and are null there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_ticker():
    """Sessions of each ticker in order."""
    return Window.partitionBy("ticker").orderBy("date")


def so_far():
    return by_ticker().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int):
    return by_ticker().rowsBetween(-(n - 1), 0)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_ticker())


def full(agg: Column, x: Column | str, n: int, least: int | None = None) -> Column:
    return F.when(F.count(x).over(last_rows(n)) >= (least or n), agg.over(last_rows(n)))


def crosses_above(a: str, b: str) -> Column:
    """W21"""
    return F.coalesce((F.col(a) > F.col(b)) & (lag(a) <= lag(b)), F.lit(False))


def crosses_below(a: str, b: str) -> Column:
    return F.coalesce((F.col(a) < F.col(b)) & (lag(a) >= lag(b)), F.lit(False))


def fresh(flag: str) -> Column:
    """The first session of a run of true."""
    return F.coalesce(F.col(flag), F.lit(False)) & ~F.coalesce(lag(flag), F.lit(False))


def finite_frame(bars: DataFrame) -> DataFrame:
    """bars with the finite-window indicators; unused ones are pruned from the plan."""
    c, h, low, v = F.col("close"), F.col("high"), F.col("low"), F.col("volume")
    prior = lag("close")
    padded = bars.withColumn("padded", F.last("close", ignorenulls=True).over(so_far()))
    base = padded.withColumns({
        "ret": F.try_divide("padded", lag("padded")) - 1,
        "true_range": F.greatest(h - low, F.abs(h - prior), F.abs(low - prior)),
        "tpv": (h + low + c) / 3 * v,
        "signed_volume": F.coalesce(F.signum(F.round(c - prior, 9)), F.lit(0.0)) * v,
        "lagged_high": lag("high"),
    })
    mean20, sd20 = full(F.avg("close"), "close", 20), full(F.stddev_samp("close"), "close", 20)
    hh, ll = full(F.max("high"), "high", 14), full(F.min("low"), "low", 14)
    out = base.withColumns({
        **{f"roc{n}": (F.try_divide("padded", lag("padded", n)) - 1) * 100 for n in (1, 5, 10, 20)},
        "bb_mid": mean20, "bb_up": mean20 + 2 * sd20, "bb_low": mean20 - 2 * sd20,
        "pctb": F.try_divide(c - (mean20 - 2 * sd20), 4 * sd20),
        "rvol": F.try_divide(v, full(F.avg("volume"), "volume", 20)),
        "volume_ma20": full(F.avg("volume"), "volume", 20),
        "dollar_volume": full(F.avg(c * v), c * v, 20),
        "vwap": F.try_divide(full(F.sum("tpv"), "tpv", 20), F.nullif(full(F.sum("volume"), "volume", 20), F.lit(0.0))),
        "stoch_k": 100 * F.try_divide(c - ll, F.nullif(hh - ll, F.lit(0.0))),
        "obv": F.when(F.col("signed_volume").isNotNull(), F.sum("signed_volume").over(so_far())),
        "tenkan": (full(F.max("high"), "high", 9) + full(F.min("low"), "low", 9)) / 2,
        "kijun": (full(F.max("high"), "high", 26) + full(F.min("low"), "low", 26)) / 2,
        "senkou_b": (full(F.max("high"), "high", 52) + full(F.min("low"), "low", 52)) / 2,
        "off_high": c / F.max("close").over(last_rows(20)) - 1,
        "high52": full(F.max("close"), "close", 252, 60),
        "donchian": F.when(F.count("lagged_high").over(last_rows(20)) == 20, F.max("lagged_high").over(last_rows(20))),
        "underwater": c / F.max("close").over(so_far()) - 1,
        "growth": F.when(F.col("ret").isNotNull(), F.exp(F.sum(F.log1p("ret")).over(so_far()))),
    })
    return out.withColumns({
        "stoch_d": full(F.avg("stoch_k"), "stoch_k", 3),
        "senkou_a": (F.col("tenkan") + F.col("kijun")) / 2,
        "rvol_lagged": F.try_divide(v, lag("volume_ma20")),
    }).drop("padded")


#: Inventory id and name -> the columns that answer it, on the session grid.
FINITE = {
    "w4_true_range": ["true_range"], "w6_bollinger_pct_b": ["pctb"], "w7_roc": ["roc1", "roc5", "roc10", "roc20"], "w9_relative_volume": ["rvol"],
    "w10_vwap": ["vwap"], "w11_stochastic": ["stoch_k", "stoch_d"],
    "w15_ichimoku": ["tenkan", "kijun", "senkou_a", "senkou_b"], "w17_volume_averages": ["volume_ma20", "dollar_volume"],
    "w19_high52": ["high52"], "w20_donchian": ["donchian"],
}
#: The same on each ticker's own bars, as pages for a single ticker have them.
OWN = {"w9b_lagged_rvol": ["rvol_lagged"], "w16_bollinger_bands": ["bb_mid", "bb_up", "bb_low"], "w18_off_high": ["off_high"]}


def oracle_ctes(source: str = "grid") -> str:
    """The same frame in SQL, on a CTE grid or bars: steps f0, f1, frame. `gap` is the distance to the last row with a
    bar before, `step_gap` that to the last one with a change of close."""
    w = "PARTITION BY ticker ORDER BY date"
    before = f"OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def roll(fn: str, x: str, n: int, least: int | None = None) -> str:
        over = f"OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return f"CASE WHEN count({x}) {over} >= {least or n} THEN {fn}({x}) {over} END"

    def running(fn: str, x: str, of: str) -> str:
        return f"CASE WHEN {of} IS NOT NULL THEN {fn.format(f'({x}) OVER ({w} ROWS UNBOUNDED PRECEDING)')} END"

    m, s = roll("avg", "close", 20), roll("stddev_samp", "close", 20)
    hh, ll = roll("max", "high", 14), roll("min", "low", 14)
    mid = {n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2" for n in (9, 26, 52)}
    rocs = ", ".join(f"(padded / lag(padded, {n}) OVER ({w}) - 1) * 100 AS roc{n}" for n in (1, 5, 10, 20))
    return f"""f0 AS (
  SELECT *, row_number() OVER ({w}) AS i, lag(close) OVER ({w}) AS pc, lag(high) OVER ({w}) AS lagged_high, lag(low) OVER ({w}) AS lagged_low,
    last_value(close IGNORE NULLS) OVER ({w} ROWS UNBOUNDED PRECEDING) AS padded FROM {source}),
f1 AS (
  SELECT *, padded / lag(padded) OVER ({w}) - 1 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS true_range, (high + low + close) / 3 * volume AS tpv,
    coalesce(sign(round(close - pc, 9)), 0) * volume AS sv, i - max(CASE WHEN close IS NOT NULL THEN i END) {before} AS gap,
    i - max(CASE WHEN close - pc IS NOT NULL THEN i END) {before} AS step_gap, count(close) OVER ({w} ROWS UNBOUNDED PRECEDING) AS n_bars,
    count(close - pc) OVER ({w} ROWS UNBOUNDED PRECEDING) AS n_steps FROM f0),
f2 AS (SELECT *, {rocs}, {m} AS bb_mid, ({m}) + 2 * ({s}) AS bb_up, ({m}) - 2 * ({s}) AS bb_low, (close - (({m}) - 2 * ({s}))) / nullif(4 * ({s}), 0) AS pctb,
  volume / nullif({roll('avg', 'volume', 20)}, 0) AS rvol, {roll('avg', 'volume', 20)} AS volume_ma20, {roll('avg', 'close * volume', 20)} AS dollar_volume,
  ({roll('sum', 'tpv', 20)}) / nullif({roll('sum', 'volume', 20)}, 0) AS vwap, 100 * (close - ({ll})) / nullif(({hh}) - ({ll}), 0) AS stoch_k,
  {running('sum{}', 'sv', 'sv')} AS obv, {mid[9]} AS tenkan, {mid[26]} AS kijun, {mid[52]} AS senkou_b,
  close / max(close) OVER ({w} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) - 1 AS off_high, {roll('max', 'close', 252, 60)} AS high52,
  {roll('max', 'lagged_high', 20)} AS donchian, close / max(close) OVER ({w} ROWS UNBOUNDED PRECEDING) - 1 AS underwater,
  {running('exp(sum{})', 'ln(1 + ret)', 'ret')} AS growth FROM f1),
frame AS (SELECT *, {roll('avg', 'stoch_k', 3)} AS stoch_d, (tenkan + kijun) / 2 AS senkou_a, volume / nullif(lag(volume_ma20) OVER ({w}), 0) AS rvol_lagged FROM f2)"""
