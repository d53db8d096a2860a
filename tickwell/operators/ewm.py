"""Recursive (exponentially weighted) indicators: one Arrow grouped map for each ticker computes all of them.

Recursion over sessions is the one thing that windows can't express; a group is the bars of one ticker.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.indicators import finite_frame

OUT = ["ema10", "ema20", "ema50", "ema20_run", "ema50_run", "rsi2", "rsi14", "macd", "macd_signal", "macd_hist", "atr10", "atr14", "adx", "keltner_up", "keltner_low", "atr_stop", "sigma", "sigma_adjusted"]


def _recursive(d: pd.DataFrame) -> pd.DataFrame:
    d = d.sort_values("date", kind="stable").reset_index(drop=True)
    c = d["close"]

    def ema(x, span, least=0):
        return x.ewm(span=span, adjust=False, min_periods=least).mean()

    def wilder(x, n):
        return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()

    def rsi(n):
        step = c.diff()
        up, down = wilder(step.clip(lower=0), n), wilder(-step.clip(upper=0), n)
        out = 100 - 100 / (1 + up / down.where(down != 0))
        return out.where(down.isna() | (down != 0), np.where(up > 0, 100.0, 50.0))

    for n in (10, 20, 50):
        d[f"ema{n}"] = ema(c, n, n)
    d["ema20_run"], d["ema50_run"] = ema(c, 20), ema(c, 50)
    d["rsi2"], d["rsi14"] = rsi(2), rsi(14)
    d["macd"] = ema(c, 12) - ema(c, 26)
    d["macd_signal"] = ema(d["macd"], 9)
    d["macd_hist"] = d["macd"] - d["macd_signal"]
    d["atr10"], d["atr14"] = wilder(d["true_range"], 10), wilder(d["true_range"], 14)
    up, down = d["high"].diff(), -d["low"].diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    p, m = 100 * wilder(plus, 14) / d["atr14"], 100 * wilder(minus, 14) / d["atr14"]
    d["adx"] = wilder(100 * (p - m).abs() / (p + m).where(p + m != 0), 14)
    d["keltner_up"], d["keltner_low"] = d["ema20"] + 2 * d["atr10"], d["ema20"] - 2 * d["atr10"]
    d["atr_stop"] = (c - 3 * d["atr14"]).cummax()
    spread = d["ret"].ewm(span=21, min_periods=20).std()
    d["sigma"] = spread.shift(1)
    d["sigma_adjusted"] = d["ret"].ewm(span=21, min_periods=10).std()
    return d


def indicator_frame(bars: DataFrame) -> DataFrame:
    """The finite-window frame with all recursive indicators."""
    base = finite_frame(bars)
    kept = StructType([*base.schema.fields, *(StructField(n, DoubleType()) for n in OUT)])
    names = kept.names

    def run(d: pd.DataFrame) -> pd.DataFrame:
        return _recursive(d).replace({np.inf: np.nan, -np.inf: np.nan})[names]

    out = base.groupBy("ticker").applyInPandas(run, kept)
    return out.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in OUT})


RECURSIVE = {
    "w1_ema": ["ema20", "ema50"], "w2_rsi": ["rsi14", "rsi2"], "w3_macd": ["macd", "macd_signal", "macd_hist"], "w5_atr": ["atr14"], "w8_adx": ["adx"],
    "w13_keltner": ["ema20", "keltner_up", "keltner_low"], "w14_atr_stop": ["atr_stop"],
}


def oracle_ctes() -> str:
    """The same recursions as one recursive CTE over `frame`, ending in `rec` (needs WITH RECURSIVE). By definition,
    y = ((1 - a)^g * y + a * x) / ((1 - a)^g + a) with g the rows since the last x; a row without x keeps y."""

    def ew(x: str, y: str, a: str, g: str = "g.gap") -> str:
        kept = f"power(1 - {a}, {g})"
        return f"CASE WHEN ({x}) IS NULL THEN e.{y} WHEN e.{y} IS NULL THEN {x} ELSE ({kept} * e.{y} + {a} * ({x})) / ({kept} + {a}) END"

    up, down = "(g.high - g.lagged_high)", "(g.lagged_low - g.low)"
    plus = f"CASE WHEN {up} > {down} AND {up} > 0 THEN {up} ELSE 0 END"
    minus = f"CASE WHEN {down} > {up} AND {down} > 0 THEN {down} ELSE 0 END"
    gain, loss = (f"CASE WHEN g.close - g.pc IS NOT NULL THEN greatest({x}, 0) END" for x in ("g.close - g.pc", "g.pc - g.close"))
    w14 = "(1e0 / 14)"
    a = {n: f"(2e0 / {n + 1})" for n in (9, 10, 12, 20, 26, 50)}
    p, m = ew(plus, "pdm", w14, "1"), ew(minus, "mdm", w14, "1")
    atr = ew("g.true_range", "a14", w14)
    # rows of the panel count for the directional moves, bars for the range below them
    dx = f"(CASE WHEN g.i >= 14 AND g.n_bars >= 14 AND ({atr}) <> 0 THEN 100 * abs(({p}) - ({m})) / nullif(({p}) + ({m}), 0) END)"
    line = f"(({ew('g.close', 'e12', a[12])}) - ({ew('g.close', 'e26', a[26])}))"
    columns = ["y10", "y20", "y50", "e12", "e26", "sig", "g2", "l2", "g14", "l14", "a10", "a14", "pdm", "mdm", "adx", "dx_kept", "n_dx"]
    seed = ["close"] * 5 + ["close - close"] + ["CAST(NULL AS DOUBLE)"] * 4 + ["true_range"] * 2 + ["0e0", "0e0", "CAST(NULL AS DOUBLE)", "1e0", "0"]
    step = [
        ew("g.close", "y10", a[10]), ew("g.close", "y20", a[20]), ew("g.close", "y50", a[50]), ew("g.close", "e12", a[12]), ew("g.close", "e26", a[26]), ew(line, "sig", a[9], "1"),
        ew(gain, "g2", "5e-1", "g.step_gap"), ew(loss, "l2", "5e-1", "g.step_gap"), ew(gain, "g14", w14, "g.step_gap"), ew(loss, "l14", w14, "g.step_gap"),
        ew("g.true_range", "a10", "1e-1"), atr, p, m,
        f"CASE WHEN {dx} IS NULL THEN e.adx WHEN e.adx IS NULL THEN {dx} ELSE (e.dx_kept * e.adx + {w14} * {dx}) / (e.dx_kept + {w14}) END",
        f"CASE WHEN {dx} IS NULL AND e.adx IS NOT NULL THEN e.dx_kept ELSE 1 END * (1 - {w14})",
        f"e.n_dx + CASE WHEN {dx} IS NULL THEN 0 ELSE 1 END",
    ]
    rsi = {n: f"CASE WHEN n_steps >= {n} THEN CASE WHEN l{n} <> 0 THEN 100 - 100 / (1 + g{n} / l{n}) WHEN g{n} > 0 THEN 100 ELSE 50 END END AS rsi{n}" for n in (2, 14)}
    return f"""e AS (
  SELECT ticker, i, {", ".join(f"{x} AS {c}" for x, c in zip(seed, columns, strict=True))} FROM frame WHERE i = 1
  UNION ALL
  SELECT g.ticker, g.i, {", ".join(step)}
  FROM e JOIN frame g ON g.ticker = e.ticker AND g.i = e.i + 1),
rec0 AS (
  SELECT f.*, CASE WHEN n_bars >= 10 THEN y10 END AS ema10, CASE WHEN n_bars >= 20 THEN y20 END AS ema20, CASE WHEN n_bars >= 50 THEN y50 END AS ema50, y20 AS ema20_run, y50 AS ema50_run,
    {rsi[2]}, {rsi[14]}, e12 - e26 AS macd, sig AS macd_signal, e12 - e26 - sig AS macd_hist,
    CASE WHEN n_bars >= 10 THEN a10 END AS atr10, CASE WHEN n_bars >= 14 THEN a14 END AS atr14, CASE WHEN n_dx >= 14 THEN adx END AS adx
  FROM frame f JOIN e USING (ticker, i)),
rec AS (
  SELECT *, ema20 + 2 * atr10 AS keltner_up, ema20 - 2 * atr10 AS keltner_low,
    CASE WHEN close - atr14 IS NOT NULL THEN max(close - 3 * atr14) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) END AS atr_stop FROM rec0)"""
