"""Backtest engines: periodic top-N rebalancing (B1) and next-open signal trading."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import by_ticker
from . import spans


@dataclass(frozen=True)
class TradeConfig:
    capital: float = 100.0
    max_positions: int = 5
    max_hold: int = 7
    stop_atr: float = 1.5
    slippage_bps: float = 5.0
    spread_bps: float = 2.0
    commission_bps: float = 1.0

    def __post_init__(self):
        if self.max_positions < 1:
            raise ValueError("max_positions must be at least 1")
        if self.max_hold < 1:
            raise ValueError("max_hold must be at least 1")
        if min(self.slippage_bps, self.spread_bps, self.commission_bps) < 0:
            raise ValueError("costs must not be negative")


def rebalance(bars: DataFrame, lookback: int = 20, top_n: int = 5, hold: int = 5, cost_bps: float = 7.0, capital: float = 100.0) -> DataFrame:
    """B1: equity of holding the `top_n` by `lookback`-session change, chosen anew every `hold` sessions.
    Weights stay as set until the next choice; the return of a session belongs to the weights of the one before.
    Bars are densified and carry session_i; changes carry the last close over gaps. The result has one row a session;
    only such rows meet in the last, global window, where two passes by spans would make this whole plan twice."""
    padded = bars.withColumn("_c", F.last("close", ignorenulls=True).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0)))
    score = F.try_divide("_c", F.lag("_c", lookback).over(by_ticker())) - 1
    ret = F.coalesce(F.try_divide("_c", F.lag("_c").over(by_ticker())) - 1, F.lit(0.0))
    base = padded.select("ticker", "date", "session_i", score.alias("score"), ret.alias("ret"))
    start = lookback + 1
    chosen = base.filter((F.col("session_i") > start) & ((F.col("session_i") - 1 - start) % hold == 0) & F.col("score").isNotNull())
    rank = F.row_number().over(Window.partitionBy("session_i").orderBy(F.desc("score"), "ticker"))
    picked = chosen.withColumn("rank", rank).filter(F.col("rank") <= top_n)
    picked = picked.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("session_i"))).select(((F.col("session_i") - 1 - start) / hold).cast("int").alias("round"), "ticker", "weight")
    live = base.filter(F.col("session_i") > start).withColumn("held", F.floor((F.col("session_i") - 2 - start) / hold).cast("int"))
    held = live.join(picked.withColumnRenamed("round", "held"), ["held", "ticker"], "left")
    gained = held.groupBy("session_i").agg(F.max("date").alias("date"), F.sum(F.col("weight") * F.col("ret")).alias("gross"))
    before = picked.select((F.col("round") + 1).alias("round"), "ticker", F.col("weight").alias("old"))
    turned = picked.join(before, ["round", "ticker"], "full").groupBy("round").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("turnover"))
    turned = turned.select((F.col("round") * hold + start + 1).alias("session_i"), "turnover")
    net = gained.join(turned, "session_i", "left").select(
        "date", "session_i", (F.coalesce("gross", F.lit(0.0)) - F.coalesce("turnover", F.lit(0.0)) * cost_bps / 1e4).alias("ret")
    )
    so_far = Window.orderBy("session_i").rowsBetween(Window.unboundedPreceding, 0)
    return net.withColumn("equity", capital * F.exp(F.sum(spans.log_step()).over(so_far))).select("date", "ret", "equity")


TRADES = (
    "run_id string, kind string, ticker string, signal_date date, entry_date date, exit_date date, entry double, exit double, pnl double, "
    "return_pct double, costs double, reason string, days int, date date, equity double"
)


def signal_inputs(frame: DataFrame, entry: str, exit_: str, run_id: str) -> DataFrame:
    """What a run of the event loop reads: flags and ATR of the session before beside each session's prices."""
    flag = lambda c: F.coalesce(F.lag(c).over(by_ticker()), F.lit(False))
    return frame.select(
        F.lit(run_id).alias("run_id"), "ticker", "date", "open", "low", "close", F.lag("atr14").over(by_ticker()).alias("atr"),
        flag(entry).alias("enter"), flag(exit_).alias("leave"), F.lag("date").over(by_ticker()).alias("before"),
    )


def signal_runs(frame: DataFrame, keys: list[str]) -> DataFrame:
    """The inputs of several strategies from entry_<key> and exit_<key>; the frame is computed once."""
    flag = lambda c: F.coalesce(F.lag(c).over(by_ticker()), F.lit(False))
    runs = F.array(*[F.struct(F.lit(k).alias("run_id"), flag(f"entry_{k}").alias("enter"), flag(f"exit_{k}").alias("leave")) for k in keys])
    base = frame.select("ticker", "date", "open", "low", "close", F.lag("atr14").over(by_ticker()).alias("atr"), F.lag("date").over(by_ticker()).alias("before"), runs.alias("runs"))
    return base.select("ticker", "date", "open", "low", "close", "atr", "before", F.inline("runs"))


def signal_trades(inputs: DataFrame, cfg: TradeConfig | None = None) -> DataFrame:
    """Rows of TRADES with kind 'trade' or 'equity'. Cash and slots couple a run's tickers session by session, so a
    run is one group; strategies, parameters and universes run beside each other as groups of their own."""
    settings = asdict(cfg or TradeConfig())
    names = [f.split()[0] for f in TRADES.split(", ")]

    def loop(d: pd.DataFrame) -> pd.DataFrame:
        c = TradeConfig(**settings)
        market, fee = (c.slippage_bps + c.spread_bps / 2) / 1e4, c.commission_bps / 1e4
        cash, held, rows = c.capital, {}, []

        def close(ticker, raw, date, i, reason):
            nonlocal cash
            p = held.pop(ticker)
            net = p["shares"] * raw * (1 - market) * (1 - fee)
            cash += net
            pnl = net - p["cost"]
            rows.append({"kind": "trade", "ticker": ticker, "signal_date": p["signal"], "entry_date": p["date"], "exit_date": date, "entry": p["fill"], "exit": raw * (1 - market), "pnl": pnl, "return_pct": pnl / p["cost"], "costs": p["fees"] + p["shares"] * raw - net, "reason": reason, "days": i - p["i"]})

        for i, (date, day) in enumerate(d.sort_values(["date", "ticker"], kind="stable").groupby("date", sort=True)):
            bar = day.set_index("ticker").to_dict("index")
            for t in list(held):
                b, p = bar.get(t), held[t]
                if b is None or pd.isna(b["open"]):
                    continue
                if b["open"] <= p["stop"]:
                    close(t, b["open"], date, i, "stop")
                elif b["leave"]:
                    close(t, b["open"], date, i, "signal")
                elif i - p["i"] >= c.max_hold:
                    close(t, b["open"], date, i, "timeout")
            price = {t: bar[t]["open"] if t in bar and pd.notna(bar[t]["open"]) else held[t]["fill"] for t in held}
            mark = cash + sum(held[t]["shares"] * price[t] for t in held)
            for t, b in bar.items():
                if len(held) >= c.max_positions:
                    break
                if not b["enter"] or t in held or pd.isna(b["open"]) or pd.isna(b["atr"]) or b["open"] <= 0:
                    continue
                size = min(mark / c.max_positions, cash)
                if size <= 0:
                    continue
                fill = b["open"] * (1 + market)
                shares = size / (fill * (1 + fee))
                cash -= size
                held[t] = {"shares": shares, "fill": fill, "cost": size, "fees": size - shares * b["open"], "stop": b["open"] - c.stop_atr * b["atr"], "date": date, "signal": b["before"], "i": i}
            for t in list(held):
                b = bar.get(t)
                if b is not None and pd.notna(b["low"]) and b["low"] <= held[t]["stop"]:
                    close(t, held[t]["stop"], date, i, "stop")
            worth = cash + sum(p["shares"] * (bar[t]["close"] if t in bar else float("nan")) for t, p in held.items())
            if pd.notna(worth):
                rows.append({"kind": "equity", "date": date, "equity": worth})
        out = pd.DataFrame(rows).reindex(columns=names)
        out["run_id"] = d["run_id"].iloc[0]
        out["days"] = out["days"].astype("Int32")
        for name in ("signal_date", "entry_date", "exit_date", "date", "ticker", "reason", "kind"):  # a run may have no trades at all
            out[name] = out[name].astype(object).where(out[name].notna(), None)
        return out

    return inputs.groupBy("run_id").applyInPandas(loop, TRADES)
