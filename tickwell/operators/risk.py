"""Risk statistics of returns (R1 to R13, B6 to B8, F2, F3, F6, O1, O2): hash aggregates by ticker."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spans

YEAR = 252
Z05 = NormalDist().inv_cdf(0.05)


def with_benchmark(rets: DataFrame, benchmark: str = "MKT") -> DataFrame:
    """Returns next to the benchmark's on the same date; one row for each session is broadcast by size."""
    bench = rets.filter(F.col("ticker") == benchmark).select("date", F.col("ret").alias("bench"))
    return rets.join(bench, "date")


def summary(rets: DataFrame, least: int = 60, rf: float = 0.0, by: str = "ticker") -> DataFrame:
    """R1 to R10 for each ticker with `least` returns at least, from (ticker, date, ret, bench). Growth and deepest fall
    are merged from spans of time."""
    r, b, day = F.col("ret"), F.col("bench"), rf / YEAR
    grown = spans.path_ends(rets, spans.log_step(), by)
    low = F.when(b < 0, r), F.when(b < 0, b)
    cut = F.percentile("ret", F.lit(0.05))
    base = grown.groupBy(by).agg(
        F.count("*").alias("n"), (F.stddev_pop(r) * YEAR**0.5).alias("vol"), F.try_divide(F.avg(r) - day, F.nullif(F.stddev_pop(r), F.lit(0.0))).alias("_sharpe"),
        F.try_divide(F.avg(r) - day, F.nullif(F.stddev_pop(F.when(r < day, r)), F.lit(0.0))).alias("_sortino"), F.count(F.when(r < day, 1)).alias("_below"),
        cut.alias("_cut"), F.skewness(r).alias("_s"), F.kurtosis(r).alias("_k"), F.avg(r).alias("_m"), F.stddev_pop(r).alias("_sd"),
        F.try_divide(F.covar_samp(*low), F.nullif(F.var_pop(F.when(b < 0, b)), F.lit(0.0))).alias("_dbeta"), F.count(F.when(b < 0, 1)).alias("_nlow"),
        F.try_divide(F.covar_samp(r, b), F.nullif(F.var_samp(b), F.lit(0.0))).alias("_beta"), F.avg(b).alias("_bm"),
        F.collect_list("_path").alias("_states"),
        F.sum(F.greatest(r - day, F.lit(0.0))).alias("_gains"), F.sum(F.greatest(day - r, F.lit(0.0))).alias("_losses"),
    )
    tail = rets.join(base.select(by, "_cut"), by).filter("ret <= _cut").groupBy(by).agg((-F.avg("ret")).alias("cvar"))
    z, s, k = Z05, F.col("_s"), F.col("_k")
    zcf = z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36
    out = base.join(tail, by).filter(F.col("n") >= least).withColumn("_end", spans.merged_path(F.col("_states")))
    out = out.withColumn("max_dd", F.col("_end.worst")).withColumn("_growth", F.col("_end.growth"))
    years = F.col("n") / YEAR
    return out.select(
        by, "n", "vol", (F.col("_sharpe") * YEAR**0.5).alias("sharpe"), F.when(F.col("_below") >= 2, F.col("_sortino") * YEAR**0.5).alias("sortino"),
        (-F.col("_cut")).alias("var95"), "cvar", (-(F.col("_m") + zcf * F.col("_sd"))).alias("cf_var"),
        F.when(F.col("_nlow") >= 20, F.col("_dbeta")).alias("downside_beta"), F.col("_beta").alias("beta"),
        (((F.col("_m") - day) - F.col("_beta") * (F.col("_bm") - day)) * YEAR).alias("alpha"), "max_dd",
        F.try_divide(F.pow("_growth", 1 / years) - 1, F.nullif(F.abs("max_dd"), F.lit(0.0))).alias("calmar"),
        F.try_divide("_gains", F.nullif(F.col("_losses"), F.lit(0.0))).alias("omega"),
    )


def rolling_beta(rets: DataFrame, window: int = 63) -> DataFrame:
    """Sample covariance over population variance, as the definition to match has it."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(window - 1), 0)
    beta = F.try_divide(F.covar_samp("ret", "bench").over(w), F.nullif(F.var_pop("bench").over(w), F.lit(0.0)))
    return rets.withColumn("beta", F.when(F.count("ret").over(w) == window, beta)).filter("beta IS NOT NULL").select("ticker", "date", "beta")


def complete_dates(rets: DataFrame, k: int) -> DataFrame:
    """The rows of dates on which all k tickers have one."""
    return rets.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(F.col("_n") == k).drop("_n")


#: Tickers of a block, and days of a part of time: what one group of pair_sums holds at most, twice.
BLOCK, PART = 256, 180


def pair_sums(centred: DataFrame, k: int) -> DataFrame:
    """(ticker, other, s, q, n) for ticker <= other: sums of x * y and its square over dates, from (date, ticker, x)
    of k tickers on complete dates.

    Tickers are dealt to blocks and dates to parts; each pair of blocks multiplies its matrices part by part, so a row
    is sent once for each block instead of once for each ticker, and no join makes pairs."""
    blocks = -(-k // BLOCK)
    at = centred.select("date", "ticker", "x", F.floor(F.unix_date("date") / PART).alias("part"), F.pmod(F.xxhash64("ticker"), F.lit(blocks)).cast("int").alias("b"))
    met = at.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("date", "ticker", "x", "part", "b", F.least("b", "c").alias("low"), F.greatest("b", "c").alias("high"))

    def multiply(d: pd.DataFrame) -> pd.DataFrame:
        one, two = (d[d["b"] == d[side].iloc[0]].pivot_table(index="date", columns="ticker", values="x") for side in ("low", "high"))
        x, y = one.to_numpy(), two.reindex(one.index).to_numpy()
        if x.size == 0 or y.size == 0:
            return pd.DataFrame(columns=["ticker", "other", "s", "q", "n"])
        s, q = x.T @ y, (x * x).T @ (y * y)
        i, j = np.indices(s.shape).reshape(2, -1)
        names, others = one.columns.to_numpy()[i], two.columns.to_numpy()[j]
        keep = names <= others if d["low"].iloc[0] == d["high"].iloc[0] else np.ones(len(names), bool)
        first, last = np.where(names <= others, names, others), np.where(names <= others, others, names)
        return pd.DataFrame({"ticker": first, "other": last, "s": s.ravel(), "q": q.ravel(), "n": len(x)})[keep]

    parts = met.groupBy("low", "high", "part").applyInPandas(multiply, "ticker string, other string, s double, q double, n long")
    return parts.groupBy("ticker", "other").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))


def _centred(rets: DataFrame) -> DataFrame:
    return rets.withColumn("x", F.col("ret") - F.avg("ret").over(Window.partitionBy("ticker"))).select("date", "ticker", "x")


def correlation(rets: DataFrame) -> DataFrame:
    """Correlations of all pairs over the dates on which every ticker has a return."""
    k = rets.select("ticker").distinct().count()
    sums = pair_sums(_centred(complete_dates(rets, k)), k)
    own = sums.filter("ticker = other").select(F.col("ticker").alias("t"), F.col("s").alias("v"))
    joined = sums.join(own.select(F.col("t").alias("ticker"), F.col("v").alias("v1")), "ticker").join(own.select(F.col("t").alias("other"), F.col("v").alias("v2")), "other")
    return joined.select("ticker", "other", F.try_divide("s", F.nullif(F.sqrt(F.col("v1") * F.col("v2")), F.lit(0.0))).alias("corr"), F.try_divide("s", F.col("n") - 1).alias("cov"))


def portfolio_returns(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """The weighted sum for each date, weights scaled to the tickers there are; missing returns count 0."""
    known = weights.join(rets.select("ticker").distinct(), "ticker", "left_semi")
    scaled = known.withColumn("w", F.col("weight") / F.sum("weight").over(Window.partitionBy()))
    joined = rets.join(scaled.select("ticker", "w"), "ticker", "left")
    return joined.groupBy("date").agg(F.coalesce(F.sum(F.col("ret") * F.col("w")), F.lit(0.0)).alias("ret"), F.first("bench").alias("bench"))


def concentration(weights: DataFrame) -> DataFrame:
    """Herfindahl index."""
    return weights.agg((F.sum(F.col("weight") * F.col("weight")) / F.pow(F.sum("weight"), F.lit(2))).alias("hhi"))


def sector_allocation(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """shares of positive weights by sector; null or missing sectors are Unknown."""
    joined = weights.filter("weight > 0").join(sectors, "ticker", "left")
    total = F.sum(F.sum("weight")).over(Window.partitionBy())
    return joined.groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.bround(F.sum("weight") / total, 4).alias("share"))


def _triangle(table: np.ndarray) -> np.ndarray:
    """R of a table's QR decomposition, which stands for all its rows in any least-squares question."""
    return np.linalg.qr(table, mode="r")


def factor_exposures(rets: DataFrame, factors: list[str], least: int = 60) -> DataFrame:
    """least squares with intercept of each ticker on the factor columns, of smallest norm where factors are
    collinear. Rows (1, factors, return) are reduced to triangles by ticker and year, those are put on top of each
    other and reduced again by ticker, so no group holds more than a year's rows or a triangle a year, and nearly equal
    factors keep the precision that sums of their products would lose."""
    names = ["ret", *factors]
    width = len(factors) + 2
    complete = rets.na.drop(subset=names).select("ticker", F.year("date").alias("part"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])

    def reduce(d: pd.DataFrame) -> pd.DataFrame:
        x = d[[f"x{i}" for i in range(len(names))]].to_numpy()
        r = _triangle(np.column_stack([np.ones(len(x)), x[:, 1:], x[:, 0]]))
        return pd.DataFrame({"ticker": d["ticker"].iloc[0], "n": [len(x)] + [0] * (len(r) - 1), "row": list(r)})

    triangles = complete.groupBy("ticker", "part").applyInPandas(reduce, "ticker string, n long, row array<double>")

    def solve(d: pd.DataFrame) -> pd.DataFrame:
        n, out = int(d["n"].sum()), ["ticker", "n", "alpha", *[f"beta_{f}" for f in factors], "r2"]
        if n < least:
            return pd.DataFrame(columns=out)
        r = _triangle(np.vstack(d["row"].to_list()))
        r = np.vstack([r, np.zeros((max(0, width - len(r)), width))])
        beta = np.linalg.lstsq(r[:, :-1], r[:, -1], rcond=None)[0]
        rest, total = float(((r[:, -1] - r[:, :-1] @ beta) ** 2).sum()), float((r[1:, -1] ** 2).sum())
        return pd.DataFrame([[d["ticker"].iloc[0], n, beta[0] * YEAR, *beta[1:], 1 - rest / total if total > 0 else None]], columns=out)

    return triangles.groupBy("ticker").applyInPandas(solve, "ticker string, n long, alpha double, " + ", ".join(f"beta_{f} double" for f in factors) + ", r2 double")


def factor_returns(rets: DataFrame, spec: dict[str, tuple[str, str | None]]) -> DataFrame:
    """one column a factor, long minus short leg; dates on which all are known. A factor whose long leg has no
    returns at all is left out, one whose short leg has none is the long leg outright."""
    legs = sorted({t for pair in spec.values() for t in pair if t})
    there = {r["ticker"] for r in rets.filter(F.col("ticker").isin(legs)).select("ticker").distinct().collect()}  # as many as the spec names
    wide = rets.filter(F.col("ticker").isin(legs)).groupBy("date").agg(*[F.max(F.when(F.col("ticker") == t, F.col("ret"))).alias(f"leg_{i}") for i, t in enumerate(legs)])
    of = {t: F.col(f"leg_{i}") for i, t in enumerate(legs)}
    return wide.select("date", *[(of[a] - of[b] if b in there else of[a]).alias(f) for f, (a, b) in spec.items() if a in there]).na.drop()


def portfolio_metrics(rets: DataFrame, weights: DataFrame) -> DataFrame:
    """One row with the risk table of the weighted portfolio, from (ticker, date, ret, bench) and (ticker, weight)."""
    return summary(portfolio_returns(rets, weights).filter("bench IS NOT NULL").withColumn("ticker", F.lit("portfolio")), least=1)


def portfolio_exposures(rets: DataFrame, weights: DataFrame, facs: DataFrame) -> DataFrame:
    """the blended return series on the factors."""
    names = [c for c in facs.columns if c != "date"]
    blended = portfolio_returns(rets, weights).select(F.lit("portfolio").alias("ticker"), "date", "ret")
    return factor_exposures(blended.join(F.broadcast(facs), "date"), names)


def expected_returns(rets: DataFrame, halflife: int = 63) -> DataFrame:
    """O1: exponentially weighted mean, a year's worth; ages are sessions before the panel's last one."""
    last = rets.agg(F.max("session_i").alias("last"))
    w = F.pow(F.lit(0.5), (F.col("last") - F.col("session_i")) / halflife)
    return rets.join(F.broadcast(last)).groupBy("ticker").agg((F.sum(F.col("ret") * w) / F.sum(w) * YEAR).alias("mu"))


def shrunk_covariance(rets: DataFrame, complete: bool = False) -> DataFrame:
    """O2: Ledoit-Wolf (2004) shrinkage towards the scaled identity, from complete dates; long (ticker, other, cov).
    What the shrinkage needs of all pairs is one row of sums. `complete` says that rets holds complete dates only."""
    k = rets.select("ticker").distinct().count()
    own = _centred(rets if complete else complete_dates(rets, k))
    half = pair_sums(own, k).select("ticker", "other", (F.col("s") / F.col("n")).alias("s"), (F.col("q") / F.col("n")).alias("q"), "n")
    both = F.when(F.col("ticker") == F.col("other"), F.array(F.struct("ticker", "other"))).otherwise(F.array(F.struct("ticker", "other"), F.struct(F.col("other").alias("ticker"), F.col("ticker").alias("other"))))
    sums = half.select(F.explode(both).alias("p"), "s", "q", "n").select("p.ticker", "p.other", "s", "q", "n")
    same = F.col("ticker") == F.col("other")
    p, mu, square = F.sum(same.cast("double")), F.sum(F.when(same, F.col("s"))), F.sum(F.col("s") * F.col("s"))
    total = sums.agg(p.alias("p"), (mu / p).alias("mu"), square.alias("square"), ((F.sum("q") - square) / (p * F.max("n"))).alias("beta"))
    delta = (F.col("square") - F.col("p") * F.col("mu") * F.col("mu")) / F.col("p")
    total = total.select("mu", F.when(F.col("beta") == 0, 0.0).otherwise(F.least(F.col("beta"), delta) / delta).alias("shrinkage"))
    shrink = F.col("shrinkage")
    cov = (1 - shrink) * F.col("s") + F.when(same, shrink * F.col("mu")).otherwise(0.0)
    return sums.join(F.broadcast(total)).select("ticker", "other", (cov * YEAR).alias("cov"), "shrinkage", "n")


def trade_stats(trades: DataFrame, by: str = "run_id") -> DataFrame:
    """Number, share of wins, money won for each 1 lost and average result of trades(by, pnl)."""
    won, lost = F.sum(F.greatest("pnl", F.lit(0.0))), F.sum(F.greatest(-F.col("pnl"), F.lit(0.0)))
    factor = F.when(lost > 0, won / lost).when(won > 0, float("inf"))
    return trades.groupBy(by).agg(F.count("*").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), factor.alias("profit_factor"), F.avg("pnl").alias("avg_pnl"))


def perf_stats(equity: DataFrame, by: str = "run_id") -> DataFrame:
    """B7; trade_stats has the columns of trades, summary beta and alpha: total, CAGR, volatility, Sharpe, Sortino and
    drawdown of equity curves."""
    e, zero = spans.curve_stats(equity, by), F.lit(0.0)
    total = F.try_divide("last", "first") - 1
    sharpe, sortino = (F.try_divide("mean", F.nullif(F.col(c), zero)) * YEAR**0.5 for c in ("sd", "sd_low"))
    return e.select(
        by, total.alias("total"), F.when(total > -1, F.pow(total + 1, F.try_divide(F.lit(float(YEAR)), "n")) - 1).alias("cagr"), (F.col("sd") * YEAR**0.5).alias("vol"),
        sharpe.alias("sharpe"), sortino.alias("sortino"), F.col("worst").alias("max_dd"), F.col("n").alias("n_days"),
    )
