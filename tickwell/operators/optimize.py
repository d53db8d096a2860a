"""Portfolio optimisation on a handful of tickers (O3 to O14). Statistics are Spark aggregates; the k x k system of one
universe goes to one grouped-map row.

Long-only, fully invested portfolios with a cap on each weight are solved by the critical line: as the price of return
falls, efficient weights move on straight lines between corner portfolios, each corner being a ticker that reaches or
leaves a bound. From the corners every target return, the minimum variance and the best ratio follow exactly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def critical_line(mu: np.ndarray, cov: np.ndarray, cap: float = 0.4) -> np.ndarray:
    """Corner portfolios (rows of weights) from the greatest return to the minimum variance.

    They minimise w'Cw / 2 - price * mu'w with sum 1 and 0 <= w <= cap, for prices from infinity down to 0. Equal
    returns are told apart by their place; if all are equal there is one corner. A cap that is too small for so many tickers leaves equal weights."""
    n = len(mu)
    if n * cap <= 1 + 1e-12:
        return np.full((1, n), 1 / n)
    # a shift of all returns changes nothing; where all are equal any order leads to the minimum variance
    mu = np.asarray(mu, float) - np.mean(mu)
    level = np.ptp(mu) <= 1e-12
    mu = np.linspace(1, 0, n) if level else mu
    order = np.argsort(-mu, kind="stable")
    gap = np.ptp(mu) * 1e-8
    for a, b in zip(order[:-1], order[1:], strict=True):
        mu[b] = min(mu[b], mu[a] - gap)
    w, left, free = np.zeros(n), 1.0, []
    for i in order:
        w[i] = min(cap, left)
        left -= w[i]
        if left <= 1e-12:
            free = [int(i)]  # the last one filled carries what is left
            break
    corners, price, moved = [w.copy()], np.inf, -1
    for _ in range(8 * n * n + 64):
        held = np.array([i for i in range(n) if i not in free], int)
        f = np.array(free, int)
        inverse = np.linalg.pinv(cov[np.ix_(f, f)])
        one, gain = inverse.sum(1), inverse @ mu[f]
        pull = inverse @ (cov[np.ix_(f, held)] @ w[held])
        base = (1 - w[held].sum() + pull.sum()) / one.sum()
        tilt = gain.sum() / one.sum()
        at, slope = base * one - pull, gain - tilt * one  # free weights: at + price * slope
        events = []
        for k, i in enumerate(free):
            bound = 0.0 if slope[k] > 0 else cap
            if len(free) > 1 and abs(slope[k]) > 1e-14 and not (i == moved and abs(w[i] - bound) < 1e-12):
                events.append(((bound - at[k]) / slope[k], int(i), bound))
        for i in held:
            # the slack of the bound: steady + price * lean; the ticker comes free where it crosses 0
            steady = cov[i, f] @ at + cov[i, held] @ w[held] - base
            lean = cov[i, f] @ slope - mu[i] + tilt
            if i != moved and ((w[i] <= cap / 2 and lean > 1e-14) or (w[i] > cap / 2 and lean < -1e-14)):
                events.append((-steady / lean, int(i), None))
        # several may fall on one price: those already due happen now
        nearest = max(events, default=(0.0, -1, None), key=lambda e: e[0])
        price = max(min(nearest[0], price), 0.0)
        moved = nearest[1]
        w[f] = at + price * slope
        corners.append(w.copy())
        if price <= 0 or nearest[1] < 0:
            break
        if nearest[2] is None:
            free = sorted([*free, nearest[1]])
        else:
            w[nearest[1]] = nearest[2]
            free = [i for i in free if i != nearest[1]]
    out = np.clip(np.array(corners[-1:] if level else corners), 0, cap)
    out /= out.sum(1, keepdims=True)
    keep = np.concatenate(([True], np.abs(np.diff(out, axis=0)).max(1) > 1e-12))
    return out[keep]


def at_return(corners: np.ndarray, mu: np.ndarray, target: float) -> np.ndarray:
    """Least variance for a target return, between two corners. A target beyond the greatest return has no
    portfolio and leaves equal weights; one below the minimum variance's is that one."""
    gain = corners @ mu
    if target > gain[0] + 1e-9 * max(1.0, abs(gain[0])):
        return np.full(len(mu), 1 / len(mu))
    k = int(np.argmax(gain <= target + 1e-15)) if (gain <= target + 1e-15).any() else len(gain)
    if k == 0 or k == len(gain):
        return corners[min(k, len(gain) - 1)]
    t = (gain[k - 1] - target) / (gain[k - 1] - gain[k])
    return corners[k - 1] + t * (corners[k] - corners[k - 1])


def min_variance(cov: np.ndarray, cap: float = 0.4) -> np.ndarray:
    """O4"""
    return critical_line(np.zeros(len(cov)), cov, cap)[-1]


def max_sharpe(mu: np.ndarray, cov: np.ndarray, cap: float = 0.4, rf: float = 0.0) -> tuple[np.ndarray, bool]:
    """The best ratio, exactly, on the segments between corners; minimum variance if nothing beats rf."""
    corners = critical_line(mu, cov, cap)
    if (mu <= rf).all():
        return corners[-1], True

    def ratio(w: np.ndarray) -> float:
        return float((w @ mu - rf) / max(w @ cov @ w, 1e-12) ** 0.5)

    tried = list(corners)
    for a, b in zip(corners[:-1], corners[1:], strict=True):
        step = b - a
        p, q = a @ mu - rf, step @ mu
        u, v, x = a @ cov @ a, a @ cov @ step, step @ cov @ step
        # (p + q t) / sqrt(u + 2 v t + x t^2) is steady where q (u + v t) = p (v + x t)
        if abs(q * v - p * x) > 1e-18 and 0 < (t := (p * v - q * u) / (q * v - p * x)) < 1:
            tried.append(a + t * step)
    return max(tried, key=ratio), False


def greedy_cap(mu: DataFrame, cap: float) -> DataFrame:
    """The most return under the cap: fill from the largest mu on."""
    rank = F.row_number().over(Window.orderBy(F.desc("mu"), "ticker"))
    return mu.withColumn("weight", F.least(F.lit(cap), F.greatest(F.lit(0.0), 1 - (rank - 1) * cap)))


def implied_returns(cov: DataFrame, weights: DataFrame, delta: float = 2.5) -> DataFrame:
    """Delta times covariance times market weights."""
    return cov.join(weights.withColumnRenamed("ticker", "other"), "other").groupBy("ticker").agg((delta * F.sum(F.col("cov") * F.col("weight"))).alias("implied"))


def black_litterman(cov: np.ndarray, prior: np.ndarray, views: np.ndarray, tau: float = 0.05, confidence: float = 1.0) -> np.ndarray:
    """One absolute view for each ticker, uncertainty diag(tau cov) / confidence."""
    a, b = np.linalg.pinv(tau * cov), np.linalg.pinv(np.diag(np.diag(tau * cov)) / confidence)
    return np.linalg.pinv(a + b) @ (a @ prior + b @ views)


def posterior(mu: DataFrame, cov: DataFrame, delta: float, tau: float = 0.05, confidence: float = 1.0) -> DataFrame:
    """(ticker, mu) of Black and Litterman, from the prior that equal weights imply and views (ticker, mu); a ticker
    without a view keeps its prior. The k x k table of one universe is one group."""
    n = F.count("*").over(Window.partitionBy("ticker"))
    prior = cov.withColumn("weight", 1.0 / n).groupBy("ticker").agg((delta * F.sum(F.col("cov") * F.col("weight"))).alias("prior"))
    table = cov.join(prior, "ticker").join(mu, "ticker", "left").select("ticker", "other", "cov", "prior", F.coalesce("mu", "prior").alias("view"), F.lit(1).alias("universe"))

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names = sorted(d["ticker"].unique())
        s = d.pivot(index="ticker", columns="other", values="cov").loc[names, names].to_numpy()
        own = d.drop_duplicates("ticker").set_index("ticker").loc[names]
        return pd.DataFrame({"ticker": names, "mu": black_litterman(s, own["prior"].to_numpy(), own["view"].to_numpy(), tau, confidence)})

    return table.groupBy("universe").applyInPandas(run, "ticker string, mu double")


def portfolio_stats(weights: DataFrame, mu: DataFrame, cov: DataFrame, rf: float = 0.0) -> DataFrame:
    """Return, volatility and Sharpe ratio of (ticker, weight)."""
    other = weights.select(F.col("ticker").alias("other"), F.col("weight").alias("v"))
    risk = cov.join(weights, "ticker").join(other, "other").agg(F.sqrt(F.sum(F.col("cov") * F.col("weight") * F.col("v"))).alias("vol"))
    gain = weights.join(mu, "ticker").agg(F.sum(F.col("weight") * F.col("mu")).alias("ret"))
    return gain.join(F.broadcast(risk)).withColumn("sharpe", F.try_divide(F.col("ret") - rf, "vol"))


def dollars(weights: DataFrame, capital: float = 100.0, least: float = 1.0) -> DataFrame:
    """Money by weight; below `least` goes and the rest is scaled up."""
    first = weights.withColumn("d", F.bround(F.col("weight") * capital, 2)).filter(F.col("d") >= least)
    return first.withColumn("dollars", F.bround(F.col("d") / F.sum("d").over(Window.partitionBy()) * capital, 2)).select("ticker", "dollars").orderBy(F.desc("dollars"), "ticker")


def _universe(mu: DataFrame, cov: DataFrame, *more: DataFrame) -> DataFrame:
    """The k x k table with returns, and rows of one line each beside it, as one group."""
    table = cov.select("ticker", "other", "cov", *[c for c in ("n",) if c in cov.columns]).join(mu, "ticker")
    for one in more:
        table = table.join(F.broadcast(one))
    return table.withColumn("universe", F.lit(1)).groupBy("universe")


def _arrays(d: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    names = sorted(d["ticker"].unique())
    c = d.pivot(index="ticker", columns="other", values="cov").loc[names, names].to_numpy()
    return names, d.drop_duplicates("ticker").set_index("ticker")["mu"].loc[names].to_numpy(), c


def frontier_targets(corners: np.ndarray, mu: np.ndarray, points: int) -> np.ndarray:
    """Returns from the minimum variance's to the greatest there is."""
    low, high = float(corners[-1] @ mu), float(corners[0] @ mu)
    return np.linspace(low, high if high > low else low + abs(low) * 0.5 + 1e-3, points)


def solve(mu: DataFrame, cov: DataFrame, cap: float = 0.4, rf: float = 0.0, points: int = 25) -> DataFrame:
    """O5, O4, O12 and O8 for one universe: (profile, point, ticker, weight), all from one run along the line."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, m, c = _arrays(d)
        corners = critical_line(m, c, cap)
        bold = max_sharpe(m, c, cap, rf)[0]
        found = [("max_sharpe", 0, bold), ("min_variance", 0, corners[-1]), ("balanced", 0, at_return(corners, m, float((bold + corners[-1]) @ m) / 2))]
        found += [("frontier", k, at_return(corners, m, t)) for k, t in enumerate(frontier_targets(corners, m, points))]
        return pd.concat([pd.DataFrame({"profile": p, "point": k, "ticker": names, "weight": w}) for p, k, w in found])

    return _universe(mu, cov).applyInPandas(run, "profile string, point int, ticker string, weight double")


def corners(mu: DataFrame, cov: DataFrame, cap: float = 0.4) -> DataFrame:
    """(corner, ret, vol, ticker, weight) of the corner portfolios, greatest return first."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, m, c = _arrays(d)
        return pd.concat([pd.DataFrame({"corner": k, "ret": w @ m, "vol": (w @ c @ w) ** 0.5, "ticker": names, "weight": w}) for k, w in enumerate(critical_line(m, c, cap))])

    return _universe(mu, cov).applyInPandas(run, "corner int, ret double, vol double, ticker string, weight double")


def profiles(mu: DataFrame, cov: DataFrame, delta: DataFrame, cap: float = 0.4, rf: float = 0.0, least: int = 60) -> DataFrame:
    """The profiles min_variance, balanced, max_sharpe and anchored (best ratio on the posterior of Black and
    Litterman from equal weights) with (ret, vol, sharpe, fell_back). delta is one row; cov carries its sessions n."""

    def run(d: pd.DataFrame) -> pd.DataFrame:
        names, m, c = _arrays(d)
        if len(names) < 2:
            raise ValueError("at least two tickers with data are needed")
        if d["n"].max() < least:
            raise ValueError(f"at least {least} sessions on which all tickers have a return are needed")
        line = critical_line(m, c, cap)
        bold, fell_back = max_sharpe(m, c, cap, rf)
        prior = float(d["delta"].iloc[0]) * c @ np.full(len(m), 1 / len(m))
        late = black_litterman(c, prior, m)
        anchored, late_fell = max_sharpe(late, c, cap, rf)
        found = [("min_variance", line[-1], m, False), ("balanced", at_return(line, m, float((bold + line[-1]) @ m) / 2), m, False), ("max_sharpe", bold, m, fell_back), ("anchored", anchored, late, late_fell)]
        rows = []
        for name, w, gain, fell in found:
            ret, vol = float(w @ gain), float(w @ c @ w) ** 0.5
            rows.append(pd.DataFrame({"profile": name, "ticker": names, "weight": w, "ret": ret, "vol": vol, "sharpe": (ret - rf) / vol if vol > 0 else None, "fell_back": fell, "delta": d["delta"].iloc[0]}))
        return pd.concat(rows)

    return _universe(mu, cov, delta).applyInPandas(run, "profile string, ticker string, weight double, ret double, vol double, sharpe double, fell_back boolean, delta double")
