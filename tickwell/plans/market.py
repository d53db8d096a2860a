"""Checked queries over the bars: each has the same answer in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import interpret as say
from ..functions.indicators import finite_frame
from ..operators import backtest, events, ewm, montecarlo, optimize, portfolio, risk, signals, spans
from ..sources import bars as src
from .registry import ORACLES, QUERIES, query, r6, rounded, with_bars

__all__ = ["ORACLES", "QUERIES"]
RETS = ", pad AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS padded FROM grid), rets AS (SELECT *, padded / lag(padded) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM pad), b AS (SELECT date, ret AS bench FROM rets WHERE ticker = 'MKT'), rb AS (SELECT r.ticker, r.date, round(r.ret, 12) AS ret, round(b.bench, 12) AS bench FROM rets r JOIN b USING (date) WHERE r.ret IS NOT NULL AND b.bench IS NOT NULL)"


def _grid(spark: SparkSession, sf: str, key: str = "p_brand") -> DataFrame:
    return src.densify(src.bars(spark, sf, key))


def _rets(spark: SparkSession, sf: str, key: str = "p_brand") -> DataFrame:
    """Returns on the session grid beside the benchmark's; a session without a bar has the return 0."""
    return risk.with_benchmark(src.returns(_grid(spark, sf, key))).filter("ret IS NOT NULL AND bench IS NOT NULL").select("ticker", "date", F.round("ret", 12).alias("ret"), F.round("bench", 12).alias("bench"))


def _frame(spark: SparkSession, sf: str, key: str = "p_type", own: bool = False) -> DataFrame:
    """The indicator frame on the session grid, or on each ticker's own bars."""
    return ewm.indicator_frame(src.bars(spark, sf, key) if own else _grid(spark, sf, key))


@query("s1_bars", with_bars(f" SELECT ticker, date, {r6('open', 'high', 'low', 'close', 'volume')} FROM bars"))
def s1(spark, sf):
    return rounded(src.bars(spark, sf))


@query("s2_latest_quotes", "SELECT event_type AS ticker, arg_max(value, (ts, event_id)) AS last, max(ts) AS as_of FROM events WHERE value IS NOT NULL GROUP BY 1")
def s2(spark, sf):
    return src.latest_quotes(spark.read.parquet(f"{sf}/events.parquet"))


@query("s3_daily_returns", with_bars(RETS + f" SELECT ticker, date, {r6('ret')} FROM rets WHERE ret IS NOT NULL"))
def s3(spark, sf):
    return rounded(src.returns(_grid(spark, sf)).select("ticker", "date", "ret"))


for _t, _cols in {"s5_earnings": "ticker, date", "s6_actions": "ticker, date, dividend, split", "s7_news": "ticker, date, title"}.items():
    query(_t, with_bars(f", {src.CATALYSTS} SELECT {_cols} FROM {_t[3:]}"))(lambda spark, sf, t=_t, c=_cols: src.catalysts(spark, sf, t[3:]).select(*c.split(", ")))


@query("d3_densify", with_bars(f" SELECT ticker, date, session_i, {r6('close')} FROM grid"))
def d3(spark, sf):
    return rounded(_grid(spark, sf).select("ticker", "date", "session_i", "close"))


@query("p9_sparkline", with_bars(" SELECT ticker, date, round(close, 6) + 0 AS close FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30"))
def p9(spark, sf):
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rounded(src.bars(spark, sf).withColumn("r", rank).filter("r <= 30").select("ticker", "date", "close"))


@query("p10_missing", with_bars(" SELECT DISTINCT p_name AS ticker FROM part WHERE p_name NOT IN (SELECT ticker FROM bars)"))
def p10(spark, sf):
    """Wanted tickers without bars, by an anti join."""
    wanted = spark.read.parquet(f"{sf}/part.parquet").filter("p_name IS NOT NULL").select(F.col("p_name").alias("ticker")).distinct()
    return wanted.join(src.bars(spark, sf).select("ticker").distinct(), "ticker", "left_anti")


def _running(column: str) -> str:
    return with_bars(f" SELECT ticker, date, {r6(column)} FROM frame", frame=True)


@query("w12_obv", _running("obv"))
def w12(spark, sf):
    return rounded(spans.obv(_grid(spark, sf)))


@query("w23_underwater", _running("underwater"))
def w23(spark, sf):
    return rounded(spans.underwater(_grid(spark, sf).select("ticker", "date", "close")).select("ticker", "date", "underwater"))


@query("w25_growth", _running("growth"))
def w25(spark, sf):
    return rounded(spans.growth(finite_frame(_grid(spark, sf)).select("ticker", "date", "ret")).select("ticker", "date", "growth"))


@query("w24_rolling_beta", with_bars(RETS + ", w AS (SELECT ticker, date, covar_samp(ret, bench) OVER k / nullif(var_pop(bench) OVER k, 0) AS beta, count(ret) OVER k AS n FROM rb WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)) SELECT ticker, date, round(beta, 6) + 0 AS beta FROM w WHERE n = 63 AND beta IS NOT NULL"))
def w24(spark, sf):
    return rounded(risk.rolling_beta(_rets(spark, sf)))


@query("w26_market_regime", with_bars(", l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS d FROM rec), x AS (SELECT avg(CASE WHEN ticker <> 'MKT' THEN CASE WHEN close > ema20_run THEN 1e0 ELSE 0e0 END END) AS breadth, max(CASE WHEN ticker = 'MKT' THEN CASE WHEN close > ema50_run THEN 1 ELSE 0 END END) = 1 AS up FROM l WHERE d = 1) SELECT round(breadth, 6) + 0 AS breadth, up, CASE WHEN up AND breadth >= 0.55 THEN 'Risk-on' WHEN NOT up AND breadth <= 0.45 THEN 'Risk-off' ELSE 'Mixed' END AS regime FROM x", "p_type", rec=True))
def w26(spark, sf):
    last = _frame(spark, sf).withColumn("d", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("d = 1")
    above = F.coalesce(F.col("close") > F.col("ema20_run"), F.lit(False)).cast("double")
    up = F.max(F.when(F.col("ticker") == "MKT", F.coalesce(F.col("close") > F.col("ema50_run"), F.lit(False))))
    x = last.agg(F.avg(F.when(F.col("ticker") != "MKT", above)).alias("breadth"), up.alias("up"))
    return rounded(x.withColumn("regime", say.regime(F.col("up"), F.col("breadth"))))


def _z(c: str, over: str = "") -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(stddev_pop({c}) OVER ({over}), 0) = 0 THEN CASE WHEN {c} IS NOT NULL THEN 0e0 END ELSE greatest(-3e0, least(3e0, ({c} - avg({c}) OVER ({over})) / nullif(stddev_pop({c}) OVER ({over}), 0))) END"


_SCORED = (
    ", l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS d FROM rec), f AS (SELECT *, "
    "((CASE WHEN close > ema20 THEN 1 ELSE 0 END) + (CASE WHEN ema20 > ema50 THEN 1 ELSE 0 END) + (CASE WHEN macd_hist > 0 THEN 1 ELSE 0 END)) * (1 + coalesce(adx, 0) / 100) AS tr, "
    "CASE WHEN close > ema50 THEN ((50 - rsi2) / 50 + (0.5 - pctb)) / 2 ELSE 0 END AS dip, coalesce(rvol, 1) AS rv FROM l WHERE d = 1 AND close IS NOT NULL AND roc20 IS NOT NULL AND atr14 IS NOT NULL), "
    f"z AS (SELECT *, ({_z('roc5')} + {_z('roc10')} + {_z('roc20')}) / 3 AS momentum, {_z('tr')} AS trend, {_z('dip')} AS meanrev, greatest(-2e0, least(2e0, {_z('rv')})) AS volume_score FROM f), "
    "sc0 AS (SELECT *, round(0.35e0 * momentum + 0.25e0 * trend + 0.25e0 * meanrev + 0.15e0 * volume_score, 9) AS edge_raw FROM z), "
    "sc AS (SELECT *, (rank() OVER (ORDER BY edge_raw) + (count(*) OVER (PARTITION BY edge_raw) - 1) / 2e0) / count(edge_raw) OVER () * 100 AS edge FROM sc0)"
)


@query("x2_features", with_bars(_SCORED + f" SELECT ticker, date, {r6(*signals.FEATURES)} FROM f", rec=True))
def x2(spark, sf):
    return rounded(signals.features(_frame(spark, sf, "p_brand")).select("ticker", "date", *signals.FEATURES))


@query("x3_edge_scores", with_bars(_SCORED + f" SELECT ticker, date, {r6('momentum', 'trend', 'meanrev', 'volume_score', 'edge_raw', 'edge')} FROM sc", rec=True))
def x3(spark, sf):
    return rounded(signals.edge_scores(signals.features(_frame(spark, sf, "p_brand"))).select("ticker", "date", "momentum", "trend", "meanrev", "volume_score", "edge_raw", "edge"))


@query("x1_zscore", with_bars(f", z AS (SELECT ticker, date, {_z('roc5', 'PARTITION BY date')} AS z FROM frame) SELECT ticker, date, round(z, 6) + 0 AS z FROM z WHERE z IS NOT NULL", frame=True))
def x1(spark, sf):
    return rounded(finite_frame(_grid(spark, sf)).select("ticker", "date", signals.zscore(F.col("roc5")).alias("z")).filter("z IS NOT NULL"))


@query("x5_trade_ideas")
def x5(spark, sf):
    return rounded(signals.trade_ideas(signals.edge_scores(signals.features(_frame(spark, sf, "p_brand")).filter("ticker <> 'MKT'"))))


@query("x6_top_per_date", with_bars(" SELECT ticker, date, CAST(rank AS INT) AS rank, round(1e0 / count(*) OVER (PARTITION BY date), 6) + 0 AS weight FROM (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY roc20 DESC, ticker) AS rank FROM frame WHERE roc20 IS NOT NULL) WHERE rank <= 5", frame=True))
def x6(spark, sf):
    return rounded(signals.top_per_date(finite_frame(_grid(spark, sf)), "roc20", 5).select("ticker", "date", "rank", "weight"))


@query("x7_top8", with_bars(_SCORED + " SELECT ticker, round(edge, 6) + 0 AS edge FROM sc ORDER BY edge_raw DESC, ticker LIMIT 8", rec=True))
def x7(spark, sf):
    return rounded(signals.edge_scores(signals.features(_frame(spark, sf, "p_brand"))).orderBy(F.desc("edge_raw"), "ticker").limit(8).select("ticker", "edge"))


_W = "OVER (PARTITION BY ticker ORDER BY date)"
_UP, _DOWN = "{0} > {1} AND lag({0}) " + _W + " <= lag({1}) " + _W, "{0} < {1} AND lag({0}) " + _W + " >= lag({1}) " + _W
_SIGNALS = {
    "rsi2": ("rsi2 < 10 AND close > ema50", "rsi2 > 65"), "macd": (_UP.format("macd", "macd_signal") + " AND close > ema50 AND macd_hist > 0", _DOWN.format("macd", "macd_signal")),
    "bollinger": ("pctb < 0.05 AND close > ema50", "pctb > 0.5"), "donchian": ("close > donchian", "close < ema20"), "golden": (_UP.format("ema20", "ema50"), _DOWN.format("ema20", "ema50")),
    "high52": (f"near AND NOT coalesce(lag(near) {_W}, false)", "close < ema20"), "gap": (f"(open / lag(close) {_W} - 1) * 100 < -3 AND close > open AND close > ema50", "rsi2 > 65"),
    "volume": ("rvol > 2 AND roc1 > 2 AND close > ema20", "close < ema10"),
}
for _i, (_k, (_in, _out)) in enumerate(_SIGNALS.items(), 2):
    query(f"g{_i}_{_k}", with_bars(f", q AS (SELECT *, coalesce(close >= 0.98e0 * high52, false) AS near FROM rec), s AS (SELECT ticker, date, coalesce({_in}, false) AS entry, coalesce({_out}, false) AS exit FROM q) SELECT * FROM s WHERE entry OR exit", rec=True))(
        lambda spark, sf, k=_k: signals.strategy_signals(_frame(spark, sf, "p_brand")).select("ticker", "date", F.col(f"entry_{k}").alias("entry"), F.col(f"exit_{k}").alias("exit")).filter("entry OR exit")
    )


#: What a strategy's signals look like on `z`, where its conditions are columns.
_FLAGS = ", ".join(f"coalesce({i}, false) AS in_{k}, coalesce({x}, false) AS out_{k}" for k, (i, x) in _SIGNALS.items())
_COUNTS = " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) FILTER (WHERE in_{k}) AS entries, count(*) FILTER (WHERE out_{k}) AS exits FROM z" for k in _SIGNALS)


@query("g10_registry", with_bars(", q AS (SELECT *, coalesce(close >= 0.98e0 * high52, false) AS near FROM rec), z AS (SELECT " + _FLAGS + " FROM q), n AS (" + _COUNTS + "), r AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{k}', '{n}', '{e}')" for k, n, e in signals.REGISTRY) + ") t(key, name, engine)) SELECT key, name, engine, entries, exits FROM r LEFT JOIN n USING (key)", rec=True))
def g10(spark, sf):
    """The registry, with how often each strategy's signals fire on the panel."""
    signal = signals.strategy_signals(_frame(spark, sf, "p_brand"))
    count = lambda side, k: F.count(F.when(F.col(f"{side}_{k}"), 1))
    counts = signal.agg(F.array(*[F.struct(F.lit(k).alias("key"), count("entry", k).alias("entries"), count("exit", k).alias("exits")) for k in signals.STRATEGIES]).alias("n"))
    names = spark.createDataFrame(signals.REGISTRY, "key string, name string, engine string")
    return names.join(counts.select(F.inline("n")), "key", "left")


def _rebalance(spark, sf):
    return backtest.rebalance(_grid(spark, sf, "p_type").filter("ticker <> 'MKT'"))


_REBALANCE = (
    ", pad AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS padded FROM grid WHERE ticker <> 'MKT'), "
    "s AS (SELECT *, session_i AS i, padded / lag(padded, 20) " + _W + " - 1 AS score, coalesce(padded / lag(padded) " + _W + " - 1, 0) AS ret FROM pad), "
    "p AS (SELECT ticker, (i - 22) // 5 AS rnd, row_number() OVER (PARTITION BY i ORDER BY score DESC, ticker) AS k FROM s WHERE i > 21 AND (i - 22) % 5 = 0 AND score IS NOT NULL), "
    "pw AS (SELECT ticker, rnd, 1e0 / count(*) OVER (PARTITION BY rnd) AS w FROM p WHERE k <= 5), "
    "g AS (SELECT s.i, sum(w * ret) AS gross FROM s JOIN pw ON pw.ticker = s.ticker AND pw.rnd = floor((s.i - 23) / 5e0) WHERE s.i > 21 GROUP BY s.i), "
    "t AS (SELECT coalesce(a.rnd, b.rnd + 1) AS rnd, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover FROM pw a FULL JOIN pw b ON a.ticker = b.ticker AND a.rnd = b.rnd + 1 GROUP BY 1), "
    "n AS (SELECT d.date, d.i, coalesce(gross, 0) - coalesce(turnover, 0) * 7e0 / 1e4 AS ret FROM (SELECT DISTINCT date, i FROM s WHERE i > 21) d LEFT JOIN g USING (i) LEFT JOIN t ON t.rnd * 5 + 22 = d.i), "
    "eq AS (SELECT date, ret, 100 * exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM n)"
)


@query("b1_rebalance", with_bars(_REBALANCE + f" SELECT date, {r6('ret', 'equity')} FROM eq", "p_type"))
def b1(spark, sf):
    return rounded(_rebalance(spark, sf))


@query("b3_signal_trades")
def b3(spark, sf):
    """Eight strategies side by side, one group each."""
    frame = signals.strategy_signals(_frame(spark, sf, "p_brand").filter("ticker <> 'MKT'"))
    runs = backtest.signal_runs(frame, signals.STRATEGIES)
    return rounded(backtest.signal_trades(runs).filter("kind = 'trade'").drop("date", "equity", "kind"))


@query("b7_perf_stats", with_bars(_REBALANCE + ", e AS (SELECT *, equity / lag(equity) OVER (ORDER BY date) - 1 AS r, equity / max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq), x AS (SELECT arg_max(equity, date) / arg_min(equity, date) - 1 AS total, count(r) AS n_days, stddev_pop(r) AS sd, avg(r) AS m, stddev_pop(r) FILTER (r < 0) AS low, min(dd) AS max_dd FROM e), y AS (SELECT 'momentum' AS run_id, total, power(1 + total, 252e0 / n_days) - 1 AS cagr, sd * sqrt(252e0) AS vol, m / nullif(sd, 0) * sqrt(252e0) AS sharpe, m / nullif(low, 0) * sqrt(252e0) AS sortino, max_dd, n_days FROM x) SELECT run_id, " + r6("total", "cagr", "vol", "sharpe", "sortino", "max_dd") + ", n_days FROM y", "p_type"))
def b7(spark, sf):
    return rounded(risk.perf_stats(_rebalance(spark, sf).withColumn("run_id", F.lit("momentum"))))


@query("b8_buy_hold", with_bars(" SELECT ticker, date, round(100 * close / first_value(close) OVER (PARTITION BY ticker ORDER BY date), 6) + 0 AS equity FROM bars"))
def b8(spark, sf):
    w = Window.partitionBy("ticker").orderBy("date")
    return rounded(src.bars(spark, sf).select("ticker", "date", (100 * F.col("close") / F.first("close").over(w)).alias("equity")))


_Z = repr(risk.Z05)
_SUMMARY = (
    RETS + ", gr AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS g FROM rb), gd AS (SELECT *, g / max(g) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM gr), "
    "cm AS (SELECT ticker, avg(ret) AS m0 FROM rb GROUP BY 1), ag AS (SELECT ticker, count(*) AS n, stddev_pop(ret) AS sd, avg(ret) AS m, stddev_pop(ret) FILTER (ret < 0) AS low, count(*) FILTER (ret < 0) AS below, quantile_cont(ret, 0.05) AS cut, "
    "avg(power(ret - m0, 3)) / nullif(power(stddev_pop(ret), 3), 0) AS sk, kurtosis_pop(ret) AS ku, covar_samp(ret, bench) FILTER (bench < 0) / nullif(var_pop(bench) FILTER (bench < 0), 0) AS db, count(*) FILTER (bench < 0) AS nlow, "
    "covar_samp(ret, bench) / nullif(var_samp(bench), 0) AS beta, avg(bench) AS bm, min(dd) AS max_dd, arg_max(g, date) AS growth, sum(greatest(ret, 0)) AS gains, sum(greatest(-ret, 0)) AS losses FROM gd JOIN cm USING (ticker) GROUP BY ticker), "
    "tl AS (SELECT rb.ticker, -avg(ret) AS cvar FROM rb JOIN ag USING (ticker) WHERE ret <= cut GROUP BY 1), "
    f"rs AS (SELECT ticker, n, sd * sqrt(252e0) AS vol, m / nullif(sd, 0) * sqrt(252e0) AS sharpe, CASE WHEN below >= 2 THEN m / nullif(low, 0) * sqrt(252e0) END AS sortino, -cut AS var95, cvar, "
    f"-(m + ({_Z} + ({_Z} * {_Z} - 1) * sk / 6 + (power({_Z}, 3) - 3 * {_Z}) * ku / 24 - (2 * power({_Z}, 3) - 5 * {_Z}) * sk * sk / 36) * sd) AS cf_var, CASE WHEN nlow >= 20 THEN db END AS downside_beta, beta, "
    "(m - beta * bm) * 252 AS alpha, max_dd, (power(growth, 252e0 / n) - 1) / nullif(abs(max_dd), 0) AS calmar, gains / nullif(losses, 0) AS omega FROM ag JOIN tl USING (ticker) WHERE n >= 60)"
)
_RISK = {
    "r1_annualized_vol": ["vol"], "r2_sharpe": ["sharpe"], "r3_sortino": ["sortino"], "r4_hist_var": ["var95"], "r5_cvar": ["cvar"], "r6_cornish_fisher_var": ["cf_var"], "r7_downside_beta": ["downside_beta"],
    "r8_calmar": ["calmar", "max_dd"], "r9_omega": ["omega"], "b6_beta_alpha": ["beta", "alpha"],
    "r10_summary": ["vol", "sharpe", "sortino", "var95", "cvar", "cf_var", "downside_beta", "beta", "alpha", "max_dd", "calmar", "omega"],
}
for _n, _c in _RISK.items():
    query(_n, with_bars(_SUMMARY + f" SELECT ticker, n, {r6(*_c)} FROM rs"))(lambda spark, sf, c=_c: rounded(risk.summary(_rets(spark, sf)).select("ticker", "n", *c)))


@query("r11_portfolio_returns", with_bars(RETS + ", w AS (SELECT ticker, 1e0 / count(*) OVER () AS w FROM (SELECT DISTINCT ticker FROM rb WHERE ticker <> 'MKT')) SELECT date, round(coalesce(sum(ret * w), 0), 6) + 0 AS ret FROM rb LEFT JOIN w USING (ticker) GROUP BY date"))
def r11(spark, sf):
    rets = _rets(spark, sf)
    weights = rets.filter("ticker <> 'MKT'").select("ticker").distinct().withColumn("weight", F.lit(1.0))
    return rounded(risk.portfolio_returns(rets, weights).select("date", "ret"))


@query("r12_correlation", with_bars(RETS + ", c AS (SELECT date FROM rb GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM rb)), k AS (SELECT rb.* FROM rb JOIN c USING (date)) SELECT a.ticker, b.ticker AS other, round(corr(a.ret, b.ret), 6) + 0 AS corr, round(covar_samp(a.ret, b.ret), 6) + 0 AS cov FROM k a JOIN k b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2", "p_type"))
def r12(spark, sf):
    return rounded(risk.correlation(_rets(spark, sf, "p_type")))


@query("r13_concentration", with_bars(", v AS (SELECT ticker, sum(volume) AS weight FROM bars GROUP BY 1) SELECT round(sum(weight * weight) / power(sum(weight), 2), 6) + 0 AS hhi FROM v"))
def r13(spark, sf):
    return rounded(risk.concentration(src.bars(spark, sf).groupBy("ticker").agg(F.sum("volume").alias("weight"))))


_STATS = ("vol_current", "vol_history", "vol_ratio", "drift", "skew", "kurt")


@query("r14_sample_stats", with_bars(f""", rt AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars),
    ag AS (SELECT *, power(1 - 2e0 / 22, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) - 1) AS w FROM rt WHERE ret IS NOT NULL),
    wm AS (SELECT ticker, sum(w * ret) / sum(w) AS m FROM ag GROUP BY 1),
    sd AS (SELECT ticker, sqrt(sum(w * power(ret - m, 2)) / sum(w) * power(sum(w), 2) / (power(sum(w), 2) - sum(w * w))) AS now FROM ag JOIN wm USING (ticker) GROUP BY 1),
    st AS (SELECT ticker, count(*) AS n_days, any_value(now) * sqrt(252e0) AS vol_current, stddev_samp(ret) * sqrt(252e0) AS vol_history, any_value(now) / stddev_samp(ret) AS vol_ratio, avg(ret) * 252 AS drift,
      skewness(ret) AS skew, kurtosis(ret) AS kurt FROM ag JOIN sd USING (ticker) GROUP BY 1)
    SELECT ticker, n_days, {r6(*_STATS)} FROM st"""))
def r14(spark, sf):
    """R14 on each ticker's own bars."""
    return rounded(montecarlo.sample_stats(src.returns(src.bars(spark, sf), "none").select("ticker", "date", "ret")))


#: Factor proxies on the fixture's tickers: long and short leg.
PROXIES = {"market": ("MKT", None), "size": ("SMALL", "LARGE"), "value": ("ECONOMY", "MKT"), "momentum": ("PROMO", "MKT"), "quality": ("STANDARD", "MKT"), "lowvol": ("MEDIUM", "MKT")}
_LEGS = ", ".join(f"max(ret) FILTER (ticker = '{a}')" + (f" - max(ret) FILTER (ticker = '{b}')" if b else "") + f" AS {f}" for f, (a, b) in PROXIES.items())


@query("f2_factor_returns", with_bars(RETS + f", f AS (SELECT date, {_LEGS} FROM rb GROUP BY date) SELECT date, {r6(*PROXIES)} FROM f WHERE {' AND '.join(f'{k} IS NOT NULL' for k in PROXIES)}", "p_type"))
def f2(spark, sf):
    return rounded(risk.factor_returns(_rets(spark, sf, "p_type"), PROXIES))


@query("f3_one_factor", with_bars(RETS + " SELECT ticker, count(*) AS n, round(regr_intercept(ret, bench) * 252, 6) + 0 AS alpha, round(regr_slope(ret, bench), 6) + 0 AS beta_bench, round(regr_r2(ret, bench), 6) + 0 AS r2 FROM rb GROUP BY 1 HAVING count(*) >= 60"))
def f3(spark, sf):
    return rounded(risk.factor_exposures(_rets(spark, sf), ["bench"]))


@query("f4_exposure_table")
def f4(spark, sf):
    facs = risk.factor_returns(_rets(spark, sf, "p_type"), PROXIES)
    return rounded(risk.factor_exposures(_rets(spark, sf).filter("ticker <> 'MKT'").join(F.broadcast(facs), "date"), list(PROXIES)).orderBy(F.desc(F.abs("beta_market"))))


@query("f6_sector_allocation", with_bars(", v AS (SELECT ticker, sum(volume) AS weight, row_number() OVER (ORDER BY ticker) AS k FROM bars GROUP BY 1) SELECT CASE WHEN k = 1 THEN 'Unknown' ELSE 'S' || CAST(k % 5 AS STRING) END AS sector, round_even(sum(weight) / sum(sum(weight)) OVER (), 4) AS share FROM v GROUP BY 1"))
def f6(spark, sf):
    v = src.bars(spark, sf).groupBy("ticker").agg(F.sum("volume").alias("weight"))
    k = F.row_number().over(Window.orderBy("ticker"))
    sectors = v.select("ticker", k.alias("k")).select("ticker", F.when(F.col("k") > 1, F.concat(F.lit("S"), (F.col("k") % 5).cast("string"))).alias("sector"))
    return risk.sector_allocation(v, sectors)


def _complete(rets: DataFrame) -> DataFrame:
    """Sessions on which every ticker has a return; what tells them is one row for each session."""
    width = rets.agg(F.count_distinct("ticker").alias("k"))
    full = rets.groupBy("date").agg(F.count("*").alias("n")).join(F.broadcast(width)).filter("n = k").select("date")
    return rets.join(full, "date", "left_semi")


def _mu(spark, sf):
    """O1 and O2 of all tickers: on complete sessions, ages in sessions."""
    rets = _complete(src.returns(_grid(spark, sf, "p_type")).filter("ticker <> 'MKT'"))
    return risk.expected_returns(rets), risk.shrunk_covariance(rets.select("ticker", "date", "ret"), complete=True)


_MU = (
    RETS + ", k0 AS (SELECT ticker, date, ret, session_i AS i FROM rets WHERE ret IS NOT NULL AND ticker <> 'MKT'), k AS (SELECT * FROM k0 WHERE date IN (SELECT date FROM k0 GROUP BY date HAVING count(*) = (SELECT count(DISTINCT ticker) FROM k0))), mu AS (SELECT ticker, sum(ret * power(0.5e0, (m - i) / 63e0)) / sum(power(0.5e0, (m - i) / 63e0)) * 252 AS mu FROM k, (SELECT max(i) AS m FROM k) GROUP BY 1), "
    "x AS (SELECT ticker, date, ret - avg(ret) OVER (PARTITION BY ticker) AS x FROM k), cs AS (SELECT a.ticker, b.ticker AS other, avg(a.x * b.x) AS s, avg(power(a.x * b.x, 2)) AS q, count(*) AS n FROM x a JOIN x b USING (date) GROUP BY 1, 2), "
    "pr AS (SELECT count(DISTINCT ticker)::DOUBLE AS p, sum(s) FILTER (ticker = other) / count(DISTINCT ticker) AS m, sum(s * s) AS sq, sum(q) AS qq, max(n) AS n FROM cs), "
    "sh AS (SELECT *, least((qq - sq) / (p * n), (sq - p * m * m) / p) / ((sq - p * m * m) / p) AS d FROM pr), cv AS (SELECT ticker, other, ((1 - d) * s + CASE WHEN ticker = other THEN d * m ELSE 0 END) * 252 AS cov FROM cs, sh)"
)


@query("o1_expected_returns", with_bars(_MU + " SELECT ticker, round(mu, 6) + 0 AS mu FROM mu", "p_type"))
def o1(spark, sf):
    return rounded(_mu(spark, sf)[0])


@query("o2_shrunk_covariance", with_bars(_MU + " SELECT ticker, other, round(cov, 6) + 0 AS cov FROM cv", "p_type"))
def o2(spark, sf):
    return rounded(_mu(spark, sf)[1].select("ticker", "other", "cov"))


@query("o6_portfolio_stats", with_bars(_MU + ", w AS (SELECT ticker, 1e0 / count(*) OVER () AS weight FROM mu), g AS (SELECT sum(weight * mu) AS ret FROM w JOIN mu USING (ticker)), r AS (SELECT sqrt(sum(cov * a.weight * b.weight)) AS vol FROM cv JOIN w a ON a.ticker = cv.ticker JOIN w b ON b.ticker = cv.other) SELECT round(ret, 6) + 0 AS ret, round(vol, 6) + 0 AS vol, round(ret / vol, 6) + 0 AS sharpe FROM g, r", "p_type"))
def o6(spark, sf):
    mu, cov = _mu(spark, sf)
    return rounded(optimize.portfolio_stats(mu.select("ticker", (1.0 / F.count("*").over(Window.partitionBy())).alias("weight")), mu, cov.select("ticker", "other", "cov")))


@query("o7_greedy_cap", with_bars(_MU + " SELECT ticker, round(least(0.4e0, greatest(0e0, 1 - (row_number() OVER (ORDER BY mu DESC, ticker) - 1) * 0.4e0)), 6) + 0 AS weight FROM mu", "p_type"))
def o7(spark, sf):
    return rounded(optimize.greedy_cap(_mu(spark, sf)[0], 0.4).select("ticker", "weight"))


@query("o9_implied_returns", with_bars(_MU + ", w AS (SELECT ticker, 1e0 / count(*) OVER () AS weight FROM mu) SELECT cv.ticker, round(2.5e0 * sum(cov * weight), 6) + 0 AS implied FROM cv JOIN w ON w.ticker = cv.other GROUP BY 1", "p_type"))
def o9(spark, sf):
    mu, cov = _mu(spark, sf)
    return rounded(optimize.implied_returns(cov, mu.select("ticker", (1.0 / F.count("*").over(Window.partitionBy())).alias("weight"))))


_POOL = RETS + ", pool AS (SELECT ret, row_number() OVER (ORDER BY date) - 1 AS k FROM rets WHERE ticker = 'MKT' AND ret IS NOT NULL), nn AS (SELECT count(*) AS n FROM pool), st AS (SELECT path, b, CAST(floor(('0x' || substr(md5('7:' || path || ':' || b), 1, 12))::BIGINT / 281474976710656e0 * n) AS BIGINT) AS s FROM range(2000) p(path), range(5) q(b), nn), sp AS (SELECT path, b * 5 + o + 1 AS day, (s + o) % n AS k FROM st, range(5) r(o), nn WHERE b * 5 + o + 1 <= 21), pa AS (SELECT path, day, product(1 + ret) OVER (PARTITION BY path ORDER BY day) AS growth FROM sp JOIN pool USING (k) UNION ALL SELECT path, 0, 1e0 FROM range(2000) p(path))"


def _paths(spark, sf):
    rets = src.returns(src.bars(spark, sf), "none").filter("ticker = 'MKT'")
    return montecarlo.paths(spark, montecarlo.pool(rets), 21, 2000, 5, 7)


@query("m3_fan_bands", with_bars(_POOL + " SELECT CAST(day AS INT) AS day, " + ", ".join(f"round(quantile_cont(growth, {q}), 6) + 0 AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM pa GROUP BY day"))
def m3(spark, sf):
    return rounded(montecarlo.fan_bands(_paths(spark, sf)).withColumn("day", F.col("day").cast("int")))


@query("m4_summarize", with_bars(_POOL + " SELECT round(avg(CASE WHEN growth > 1 THEN 1e0 ELSE 0e0 END), 6) + 0 AS prob_up, round(avg(growth) - 1, 6) + 0 AS mean, " + ", ".join(f"round(quantile_cont(growth, {q}) - 1, 6) + 0 AS p{int(q * 100):02d}" for q in (0.05, 0.5, 0.95)) + " FROM pa WHERE day = 21"))
def m4(spark, sf):
    return rounded(montecarlo.summarize(_paths(spark, sf), 21))


@query("m5_dip_probabilities", with_bars(_POOL + ", lo AS (SELECT path, min(growth) AS low FROM pa GROUP BY 1) SELECT dip, round(avg(CASE WHEN low <= 1 - dip THEN 1e0 ELSE 0e0 END), 6) + 0 AS prob FROM lo, (VALUES (0.02e0), (0.05e0), (0.1e0)) d(dip) GROUP BY 1"))
def m5(spark, sf):
    return rounded(montecarlo.dip_probabilities(_paths(spark, sf), [0.02, 0.05, 0.1]))


@query("m6_best_entry", with_bars(_POOL + ", lo AS (SELECT path, arg_min(day, (growth, day)) AS day, min(growth) AS low FROM pa WHERE day > 0 GROUP BY 1) SELECT round(quantile_cont(low, 0.5), 6) + 0 AS median_low, round(quantile_cont(low, 0.25), 6) + 0 AS p25_low, CAST(trunc(quantile_cont(day, 0.5)) AS INT) AS median_day, CAST(trunc(quantile_cont(day, 0.75)) AS INT) AS p75_day FROM lo"))
def m6(spark, sf):
    return rounded(montecarlo.best_entry(_paths(spark, sf)))


@query("m6_day_histogram", with_bars(_POOL + ", lo AS (SELECT path, arg_min(day, (growth, day)) AS day FROM pa WHERE day > 0 GROUP BY 1) SELECT CAST(d.day AS INT) AS day, count(lo.day) AS n FROM range(1, 22) d(day) LEFT JOIN lo ON lo.day = d.day GROUP BY 1"))
def m6_histogram(spark, sf):
    return montecarlo.entry_histogram(_paths(spark, sf), 21)


@query("m7_equity_confidence", with_bars(_POOL + ", pk AS (SELECT *, growth / max(growth) OVER (PARTITION BY path ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM pa), pp AS (SELECT path, arg_max(growth, day) AS g, min(dd) AS dd FROM pk GROUP BY 1) SELECT " + ", ".join(f"round(quantile_cont(g, {q}) * 100, 6) + 0 AS p{int(q * 100):02d}" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(avg(CASE WHEN g < 1 THEN 1e0 ELSE 0e0 END), 6) + 0 AS prob_loss, round(quantile_cont(dd, 0.5), 6) + 0 AS dd_median, round(quantile_cont(dd, 0.05), 6) + 0 AS dd_worst5, round(avg(CASE WHEN g - 1 > 0.01e0 THEN 1e0 ELSE 0e0 END), 6) + 0 AS prob_beat FROM pp"))
def m7(spark, sf):
    return rounded(montecarlo.equity_confidence(_paths(spark, sf), 21, 100.0, 0.01))


@query("m9_dip_buy", with_bars(_POOL + ", fl AS (SELECT path, min(day) AS f FROM pa WHERE day > 0 AND growth <= 0.98e0 GROUP BY 1), en AS (SELECT path, f, 0.98e0 AS price, 1 AS kind FROM fl UNION ALL SELECT path, 0, 1e0, 0 FROM range(2000) p(path)), af AS (SELECT e.path, e.kind, e.f, pa.day, growth / price - 1 AS r FROM en e LEFT JOIN pa ON pa.path = e.path AND pa.day > e.f), ht AS (SELECT path, kind, any_value(f) AS f, min(day) FILTER (r >= 0.03) AS up, min(day) FILTER (r <= -0.03) AS dn, arg_max(r, day) AS ende FROM af GROUP BY 1, 2), ex AS (SELECT *, CASE WHEN up IS NOT NULL AND (dn IS NULL OR up <= dn) THEN 0.03e0 WHEN dn IS NOT NULL THEN -0.03e0 ELSE coalesce(ende, 0) END AS ret FROM ht) SELECT round(count(*) FILTER (kind = 1) / 2000e0, 6) + 0 AS fill_rate, round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) FILTER (kind = 1), 6) + 0 AS win_rate, round(avg(ret) FILTER (kind = 1), 6) + 0 AS avg_filled, round(coalesce(sum(ret) FILTER (kind = 1), 0) / 2000, 6) + 0 AS avg_overall, CAST(trunc(quantile_cont(f, 0.5) FILTER (kind = 1)) AS INT) AS median_fill_day, round(avg(ret) FILTER (kind = 0), 6) + 0 AS now_avg, round(avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) FILTER (kind = 0), 6) + 0 AS now_win FROM ex"))
def m9(spark, sf):
    return rounded(montecarlo.dip_buy(_paths(spark, sf), 0.02, 0.03, 0.03))


@query("m7_equity_confidence_history")
def m7_whole(spark, sf):
    """M7 as the reference draws it: 1,000 paths as long as the series of returns."""
    pool = montecarlo.pool(src.returns(src.bars(spark, sf), "none").filter("ticker = 'MKT'"))
    n = pool.count()
    return rounded(montecarlo.equity_confidence(montecarlo.paths(spark, pool, n, 1000, 5, 7), n, 100.0, 0.01))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    bars = src.bars(spark, sf)
    own = bars.filter("ticker <> 'MKT'")
    return events.attribute(events.moves(events.significance(own)), own, src.catalyst_marks(spark, sf), events.market_scores(bars))


_EVENTS = f", {src.CATALYSTS}, {events.oracle_ctes()}"


@query("v2_move_significance", with_bars(_EVENTS + f" SELECT ticker, date, {r6('ret', 'z', 'pvalue', 'rvol')}, direction FROM events"))
def v2(spark, sf):
    """V1, V2: moves beyond 2.5 prior deviations and one percent, with their p-values."""
    found = events.moves(events.significance(src.bars(spark, sf).filter("ticker <> 'MKT'")))
    return rounded(found.select("ticker", "date", "ret", "z", "pvalue", "rvol", "direction"))


@query("v3_market_scores", with_bars(_EVENTS + f" SELECT date, {r6('bench_ret', 'bench_z')} FROM market"))
def v3(spark, sf):
    return rounded(events.market_scores(src.bars(spark, sf)).select("date", "bench_ret", "bench_z"))


@query("v5_attribute_events", with_bars(_EVENTS + f" SELECT ticker, date, {r6('ret', 'z', 'pvalue', 'rvol', 'bench_ret')}, direction, market_move, catalyst, earnings_date, CAST(to_json(headlines) AS VARCHAR) AS headlines FROM events"))
def v5(spark, sf):
    """V4, V5: the events with their catalysts."""
    told = _events(spark, sf)
    return rounded(told.select("ticker", "date", "ret", "z", "pvalue", "rvol", "bench_ret", "direction", "market_move", "catalyst", "earnings_date", F.to_json("headlines").alias("headlines")))


@query("q4_events", with_bars(_EVENTS + """ SELECT ticker, date, catalyst, CASE WHEN direction = 'up' THEN 'belowBar' ELSE 'aboveBar' END AS position, CASE WHEN direction = 'up' THEN 'arrowUp' ELSE 'arrowDown' END AS shape,
    CAST(row_number() OVER (ORDER BY date DESC, ticker) AS INT) AS place FROM events"""))
def q4(spark, sf):
    """V6, Q4: newest first, with how each is drawn; place is the row's place in that order (one row for each event)."""
    place = F.row_number().over(Window.orderBy(F.desc("date"), "ticker"))
    return events.api_events(_events(spark, sf)).select("ticker", "date", "catalyst", "marker.position", "marker.shape", place.alias("place"))


@query("q4_stories")
def q4_stories(spark, sf):
    """The events told in words, newest first."""
    told = events.api_events(_events(spark, sf))
    c = F.col
    story = say.event_story(c("ticker"), c("ret"), c("z"), c("catalyst"), c("pvalue"), c("rvol"), F.when(F.size("headlines") > 0, c("headlines")[0]["title"]), c("market_move"), c("bench_ret"))
    return told.select("ticker", "date", c("marker.text").alias("marker"), story["title"].alias("title"), story["label"].alias("label"), story["story"].alias("story"))


@query("n_risk_verdicts")
def verdicts(spark, sf):
    """Readings beside the risk table."""
    t = risk.summary(_rets(spark, sf))
    c = F.col
    own = {"sharpe": say.sharpe, "beta": say.beta, "alpha": say.alpha, "max_dd": say.drawdown, "cvar": say.cvar, "calmar": say.calmar, "downside_beta": say.downside_beta}
    return t.select("ticker", *[f(c(k)).alias(f"{k}_verdict") for k, f in own.items()], say.grade(c("sharpe"), c("alpha"), c("max_dd"), c("omega")).alias("grade"), say.var_sentence(c("var95"), 100.0).alias("var_sentence"))


@query("q1_market")
def q1(spark, sf):
    """Q1: the scored table of the last session with its readings."""
    s = signals.edge_scores(signals.features(_frame(spark, sf)))
    c = F.col
    return rounded(s.select("ticker", "close", "roc1", "roc20", "edge", say.rsi(c("rsi14")).label.alias("rsi"), say.percent_b(c("pctb")).label.alias("band"), say.volume(c("rvol")).label.alias("volume"), say.reason(c("momentum"), c("trend"), c("meanrev"), c("volume_score"), c("roc20"), c("rsi2"), c("rvol")).alias("reason")).orderBy(F.desc("edge"), "ticker"))


@query(
    "q14_portfolio",
    with_bars(
        """, l AS (SELECT ticker, arg_max(close, date) AS last FROM bars GROUP BY 1),
        p AS (SELECT 'MKT' AS ticker, 0.3e0 AS shares, (0.1e0 * 500 + 0.2e0 * 80) / 0.3e0 AS cost UNION ALL SELECT 'NOBODY', 1e0, 5e0),
        v AS (SELECT p.*, last AS price FROM p LEFT JOIN l USING (ticker))
        SELECT ticker, round(shares, 6) + 0 AS shares, round(cost, 6) + 0 AS cost, round(price, 6) + 0 AS price, round(shares * price, 6) + 0 AS value,
          round(shares * price - shares * cost, 6) + 0 AS pnl, round((price / cost - 1) * 100, 6) + 0 AS pnl_pct, round(shares * price / sum(shares * price) OVER (), 6) + 0 AS weight FROM v"""
    ),
)
def q14(spark, sf):
    """K3, Q14: two purchases averaged, valued at the last close, beside one whose price nobody knows."""
    state, cash = spark.createDataFrame([], portfolio.POSITIONS), portfolio.CASH
    for ticker, shares, price in (("mkt", 0.1, 500.0), ("mkt", 0.2, 80.0), ("nobody", 1.0, 5.0)):
        state, cash = portfolio.buy(state, cash, ticker, shares, price)
    last = src.bars(spark, sf).groupBy("ticker").agg(F.max_by("close", "date").alias("last"))
    return rounded(portfolio.valuation(state, last))
