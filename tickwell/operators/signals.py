"""Cross-sectional scores and trade ideas (X1 to X7) and strategy signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import series
from ..functions.indicators import crosses_above, crosses_below, fresh, lag

#: Weights of the four parts of the score.
WEIGHTS = {"momentum": 0.35, "trend": 0.25, "meanrev": 0.25, "volume": 0.15}
FEATURES = ["close", "roc1", "roc5", "roc10", "roc20", "rsi2", "rsi14", "pctb", "macd_hist", "ema20", "ema50", "adx", "atr14", "rvol"]


def zscore(x: Column, by=("date",)) -> Column:
    """Population z-score over `by`, 0 without spread, clipped to 3."""
    w = Window.partitionBy(*by)
    sd = F.stddev_pop(x).over(w)
    z = F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.when(x.isNotNull(), F.lit(0.0))).otherwise((x - F.avg(x).over(w)) / sd)
    return F.when(x.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z)))


def features(frame: DataFrame) -> DataFrame:
    """The last session of every ticker with what the score needs (rows without close, roc20 or ATR go)."""
    last = frame.withColumn("_last", F.max("date").over(Window.partitionBy("ticker"))).filter("date = _last")
    return last.select("ticker", "date", *FEATURES).na.drop(subset=["close", "roc20", "atr14"])


def edge_scores(feats: DataFrame, by=()) -> DataFrame:
    """The four parts, their weighted sum and its percentile rank (ties share the mean rank), over `by`."""
    keys = list(by)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    stack = flag(F.col("close") > F.col("ema20")) + flag(F.col("ema20") > F.col("ema50")) + flag(F.col("macd_hist") > 0)
    dip = ((50 - F.col("rsi2")) / 50 + (0.5 - F.col("pctb"))) / 2
    base = feats.withColumns({
        "_trend": stack * (1 + F.coalesce("adx", F.lit(0.0)) / 100),
        "_dip": F.when(F.col("close") > F.col("ema50"), dip).otherwise(F.lit(0.0)),
        "_rvol": F.coalesce("rvol", F.lit(1.0)),
    })
    zs = {n: zscore(F.col(c), keys) for n, c in (("z5", "roc5"), ("z10", "roc10"), ("z20", "roc20"), ("trend", "_trend"), ("meanrev", "_dip"), ("zv", "_rvol"))}
    out = base.withColumns(zs).withColumn("momentum", (F.col("z5") + F.col("z10") + F.col("z20")) / 3)
    out = out.withColumn("volume_score", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), F.col("zv"))))
    raw = WEIGHTS["momentum"] * F.col("momentum") + WEIGHTS["trend"] * F.col("trend") + WEIGHTS["meanrev"] * F.col("meanrev") + WEIGHTS["volume"] * F.col("volume_score")
    out = out.withColumn("edge_raw", F.round(raw, 9))
    order = Window.partitionBy(*keys).orderBy("edge_raw")
    ties = F.count("*").over(Window.partitionBy(*keys, "edge_raw"))
    every = F.count("edge_raw").over(Window.partitionBy(*keys))
    return out.withColumn("edge", (F.rank().over(order) + (ties - 1) / 2) / every * 100).drop("_trend", "_dip", "_rvol", "z5", "z10", "z20", "zv")


def cap_weights(df: DataFrame, weight: str, cap: float, by=(), rounds: int = 50) -> DataFrame:
    """Weights clipped at 0, normalised and water-filled to `cap` within `by`; equal if all are 0.
    The level is found in closed form: the largest weights are capped as long as the rest, scaled up, exceeds the cap."""
    w = Window.partitionBy(*by)
    x = F.greatest(F.col(weight), F.lit(0.0))
    total, n = F.sum(x).over(w), F.count("*").over(w)
    base = df.withColumn("_w", F.when(total > 0, x / total).otherwise(1.0 / n)).withColumn("_n", n)
    ahead = Window.partitionBy(*by).orderBy(F.desc("_w"), "ticker").rowsBetween(Window.unboundedPreceding, -1)
    k, taken = F.count("*").over(ahead), F.coalesce(F.sum("_w").over(ahead), F.lit(0.0))
    scale = (1 - k * cap) / F.nullif(1 - taken, F.lit(0.0))
    base = base.withColumn("_scale", scale).withColumn("_full", (F.col("_w") * F.col("_scale") > cap + 1e-12))
    last = F.max(F.when(F.col("_full"), F.col("_k"))).over(w)
    base = base.withColumn("_k", k).withColumn("_last", last)
    level = F.min(F.when((F.col("_k") == F.coalesce(F.col("_last") + 1, F.lit(0))), F.col("_scale"))).over(w)
    out = base.withColumn("_level", level)
    value = F.when(F.col("_n") * cap <= 1, 1.0 / F.col("_n")).when(F.col("_k") <= F.coalesce("_last", F.lit(-1)), F.lit(cap)).otherwise(F.col("_w") * F.col("_level"))
    return out.withColumn("weight", value).drop("_w", "_n", "_scale", "_full", "_k", "_last", "_level")


def trade_ideas(scored: DataFrame, capital: float = 100.0, n: int = 5, stop_atr: float = 1.5, reward: float = 2.0, cap: float = 0.25) -> DataFrame:
    """The n best with stop, target, holding time and dollars."""
    top = scored.orderBy(F.desc("edge_raw"), "ticker").limit(n)
    risk = stop_atr * F.col("atr14")
    every = Window.partitionBy()
    base = F.col("edge_raw") - F.min("edge_raw").over(every) + 0.25 * F.coalesce(F.stddev_pop("edge_raw").over(every), F.lit(0.0)) + 1e-9
    ideas = top.withColumns({
        "entry": F.col("close"), "stop": F.col("close") - risk, "target": F.col("close") + reward * risk, "risk_pct": risk / F.col("close") * 100,
        "hold": F.when(F.col("momentum") >= F.col("meanrev"), "5-7").otherwise("2-4"), "_base": base,
    })
    out = cap_weights(ideas, "_base", cap).withColumn("dollars", F.bround(F.col("weight") * capital, 2))
    return out.select("ticker", "edge", "entry", "stop", "target", "risk_pct", "hold", "weight", "dollars")


def top_per_date(scores: DataFrame, score: str, n: int) -> DataFrame:
    """The n best tickers of each date with equal weights."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(score), "ticker"))
    top = scores.filter(F.col(score).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= n)
    return top.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("date")))


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def strategy_signals(frame: DataFrame) -> DataFrame:
    """entry_<key> and exit_<key> columns on the indicator frame."""
    c = F.col("close")
    near_high = frame.withColumn("_near", _false(c >= 0.98 * F.col("high52"))).withColumn("_gap", (F.col("open") / lag("close") - 1) * 100)
    up, down = c > F.col("ema50"), c < F.col("ema20")
    signals = {
        "rsi2": ((F.col("rsi2") < 10) & up, F.col("rsi2") > 65),
        "macd": (crosses_above("macd", "macd_signal") & up & (F.col("macd_hist") > 0), crosses_below("macd", "macd_signal")),
        "bollinger": ((F.col("pctb") < 0.05) & up, F.col("pctb") > 0.5),
        "donchian": (c > F.col("donchian"), down),
        "golden": (crosses_above("ema20", "ema50"), crosses_below("ema20", "ema50")),
        "high52": (fresh("_near"), down),
        "gap": ((F.col("_gap") < -3) & (c > F.col("open")) & up, F.col("rsi2") > 65),
        "volume": ((F.col("rvol") > 2) & (F.col("roc1") > 2) & down.__invert__() & F.col("ema20").isNotNull() & (c > F.col("ema20")), c < F.col("ema10")),
    }
    return near_high.withColumns({f"{side}_{k}": _false(v[i]) for k, v in signals.items() for i, side in enumerate(("entry", "exit"))}).drop("_near", "_gap")


#: Keys with name and engine.
REGISTRY = [
    ("momentum", "Momentum rotation", "rebalance"), ("rsi2", "RSI(2) pullback", "signals"), ("macd", "MACD crossover", "signals"), ("bollinger", "Bollinger bounce", "signals"),
    ("donchian", "Donchian breakout", "signals"), ("golden", "Golden cross", "signals"), ("high52", "52-week high", "signals"), ("gap", "Gap reversal", "signals"), ("volume", "Volume surge", "signals"),
]
STRATEGIES = [k for k, _, engine in REGISTRY if engine == "signals"]


class StrategyError(ValueError):
    """What is wrong with a strategy of one's own, in words for its author."""


def run_strategy(panel: DataFrame, build, name: str = "strategy") -> DataFrame:
    """UD1: (ticker, date, entry, exit) of build(data, ind) -> (entries, exits) on a densified panel.

    data maps open, high, low, close and volume to series (array columns), ind is `functions.series`; the two results
    are series of booleans, null counting as false. Functions only: source text is not executed."""
    if not callable(build):
        raise StrategyError(f"{name} must be a function of (data, ind)")
    own = series.series(panel)
    try:
        out = build({f: F.col(f) for f in series.FIELDS}, series)
    except Exception as e:
        raise StrategyError(f"{name} failed: {type(e).__name__}: {e}") from e
    if not (isinstance(out, tuple) and len(out) == 2):
        raise StrategyError(f"{name} must return two things: (entries, exits)")
    for side, x in zip(("entries", "exits"), out, strict=True):
        if not isinstance(x, Column):
            raise StrategyError(f"{side} of {name} must be a series of true and false, not {type(x).__name__}")
        kind = own.select(x.alias("x")).dtypes[0][1]
        if kind != "array<boolean>":
            raise StrategyError(f"{side} of {name} must be a series of true and false, not {kind}")
    told = series.rows(own, entry=out[0], exit=out[1])
    return told.select("ticker", "date", _false(F.col("entry")).alias("entry"), _false(F.col("exit")).alias("exit"))


def align_signals(panel: DataFrame, signals: DataFrame, name: str = "strategy") -> DataFrame:
    """Signals (ticker, date, entry, exit) from anywhere, on the sessions of a densified panel: missing ones are
    false, others than the panel's go. Repeated rows count as one, true if any is."""
    missing = [c for c in ("ticker", "date", "entry", "exit") if c not in signals.columns]
    if missing:
        raise StrategyError(f"signals of {name} lack {', '.join(missing)}")
    one = signals.groupBy("ticker", "date").agg(F.max(_false(F.col("entry"))).alias("entry"), F.max(_false(F.col("exit"))).alias("exit"))
    joined = panel.select("ticker", "date").join(one, ["ticker", "date"], "left")
    return joined.select("ticker", "date", _false(F.col("entry")).alias("entry"), _false(F.col("exit")).alias("exit"))


def check_fires(signals: DataFrame, name: str = "strategy") -> DataFrame:
    """The signals, if any entry is true; found by one aggregate."""
    if not signals.agg(F.max("entry").alias("x")).first()["x"]:
        raise StrategyError(f"the entry rule of {name} never fires on these data: loosen its conditions")
    return signals
