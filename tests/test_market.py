"""Exact small fixtures and invariants; the registered queries themselves are held against SQL by their oracles."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tickwell.functions import interpret
from tickwell.operators import backtest, montecarlo, optimize, portfolio, signals
from tickwell.plans import market

SF = "/root/testdata/sf0.01"
DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]


def rows(df):
    return sorted((tuple(None if v != v else v for v in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", ["w6_bollinger_pct_b", "w2_rsi", "x3_edge_scores", "g5_donchian", "b1_rebalance", "r10_summary", "m9_dip_buy"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = market.QUERIES[name](spark, SF)
    order = sorted(df.columns)
    want = sorted(c.sql(f"SELECT {', '.join(chr(34) + k + chr(34) for k in order)} FROM ({market.ORACLES[name]})").fetchall(), key=str)
    got = rows(df.select(*order))
    assert len(got) == len(want) > 0
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-6) if all(isinstance(x, float) for x in g) else all(a == b or (isinstance(a, float) and abs(a - b) < 2e-6) for a, b in zip(g, w, strict=True))


def _run(spark, opens, entry_day, exit_day, cfg, close=100.0):
    data = [("r", "X", DAYS[i], o, min(o, close) - 1, close, 1.0, i - 1 == entry_day, i - 1 == exit_day, DAYS[i - 1] if i else None) for i, o in enumerate(opens)]
    schema = "run_id string, ticker string, date date, open double, low double, close double, atr double, enter boolean, leave boolean, before date"
    return backtest.signal_trades(spark.createDataFrame(data, schema), cfg).filter("kind = 'trade'").collect()


def test_next_open_execution(spark):
    opens = [100.0] * 25
    opens[16], opens[18] = 150.0, 175.0
    free = backtest.TradeConfig(slippage_bps=0, spread_bps=0, commission_bps=0, stop_atr=100, max_positions=1)
    (t,) = _run(spark, opens, 15, 17, free)
    assert (t.signal_date, t.entry_date, t.exit_date, t.entry, t.exit) == (DAYS[15], DAYS[16], DAYS[18], 150.0, 175.0)


def test_costs_on_flat_prices(spark):
    (t,) = _run(spark, [100.0] * 25, 15, 17, backtest.TradeConfig(slippage_bps=10, spread_bps=20, commission_bps=10, stop_atr=100, max_positions=1))
    assert t.pnl == pytest.approx(-t.costs) and t.return_pct < 0


def test_trade_config_refuses_nonsense():
    for bad in ({"max_positions": 0}, {"max_hold": 0}, {"spread_bps": -1}):
        with pytest.raises(ValueError):
            backtest.TradeConfig(**bad)


def test_dip_buy_exact(spark):
    paths = [[1, 0.94, 1, 1.1, 1.16, 1.16], [1, 0.94, 0.9, 0.85, 0.8, 0.8], [1, 1.02, 1.05, 1.08, 1.1, 1.12]]
    p = spark.createDataFrame([(i, d, float(g)) for i, own in enumerate(paths) for d, g in enumerate(own)], "path long, day int, growth double")
    r = montecarlo.dip_buy(p, 0.05, 0.15, 0.07).first()
    assert (r.fill_rate, r.win_rate, r.median_fill_day) == (pytest.approx(2 / 3), 0.5, 1)
    assert (r.avg_filled, r.avg_overall, r.now_avg, r.now_win) == pytest.approx((0.04, 0.08 / 3, (0.15 - 0.07 + 0.12) / 3, 2 / 3))


def test_cap_weights(spark):
    df = spark.createDataFrame([(t, w) for t, w in zip("ABCDE", [10.0, 1.0, 1.0, 1.0, 1.0], strict=True)], "ticker string, w double")
    got = {r.ticker: r.weight for r in signals.cap_weights(df, "w", 0.25).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got.values()) <= 0.25 + 1e-9
    three = spark.createDataFrame([(t, 1.0) for t in "ABC"], "ticker string, w double")
    assert {round(r.weight, 6) for r in signals.cap_weights(three, "w", 0.25).collect()} == {0.333333}


def test_black_litterman_views_equal_to_the_prior_change_nothing():
    x = np.random.default_rng(1).normal(size=(300, 6)) * np.linspace(0.5, 2, 6)
    c, mu = np.cov(x.T), np.linspace(0.01, 0.2, 6)
    assert optimize.black_litterman(c, mu, mu) == pytest.approx(mu, abs=1e-6)


def test_portfolio_round_trip(spark):
    state, cash = portfolio.buy(spark.createDataFrame([], portfolio.POSITIONS), 100.0, " x ", 0.1, 500.0)
    assert cash == 50.0
    prices = spark.createDataFrame([("X", 600.0)], "ticker string, last double")
    assert portfolio.valuation(state, prices).first().pnl == pytest.approx(10)
    state, cash = portfolio.sell(state, cash, "x", 600.0)
    assert cash == 110.0 and state.isEmpty()


def test_watchlist(spark, tmp_path):
    default = spark.createDataFrame([("SPY", 0)], "ticker string, pos int")
    assert rows(portfolio.load_watchlist(spark, str(tmp_path / "none"), default)) == [("SPY", 0)]
    own = portfolio.add_ticker(default, " qqq")
    portfolio.save_watchlist(own, str(tmp_path / "w"))
    assert {r[0] for r in rows(portfolio.load_watchlist(spark, str(tmp_path / "w"), default))} == {"SPY", "QQQ"}


def test_ladders(spark):
    df = spark.createDataFrame([(1.6,), (1.2,), (0.7,), (0.1,), (-1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(interpret.sharpe(F.col("x")).level).collect()] == ["great", "good", "ok", "weak", "bad", "ok"]
    r = spark.range(1).select(interpret.regime(F.lit(True), F.lit(0.6)), interpret.regime(F.lit(False), F.lit(0.4)), interpret.regime(F.lit(True), F.lit(0.4))).first()
    assert list(r) == ["Risk-on", "Risk-off", "Mixed"]


def test_paths_do_not_depend_on_partitions(spark):
    pool = spark.createDataFrame([(i, (i % 7 - 3) / 100) for i in range(60)], "k long, ret double")
    a = rows(montecarlo.paths(spark, pool, 10, 20, 5, 3))
    assert a == rows(montecarlo.paths(spark, pool.repartition(3), 10, 20, 5, 3)) and len(a) == 220
    with pytest.raises(ValueError):
        montecarlo.paths(spark, pool.limit(20))


def test_entry_imports_without_corpus_package():
    import __spark_entry__ as e

    assert len(e.queries()) >= 80 and set(e.oracle_sql()) <= set(e.queries())


def test_whole_history_and_all_parts(spark):
    from tickwell.sources import bars as src

    had = {r.ticker for r in src.bars(spark, SF).select("ticker").distinct().collect()}
    names = {r.p_name for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    assert {r.ticker for r in market.QUERIES["p10_missing"](spark, SF).collect()} == names - had
    ret = [r.ret for r in montecarlo.pool(src.returns(src.bars(spark, SF), "none").filter("ticker = 'MKT'")).orderBy("k").collect()]
    n, final = len(ret), []
    from hashlib import md5

    for p in range(1000):
        days = []
        for b in range(-(-n // 5)):
            at = int(int(md5(f"7:{p}:{b}".encode()).hexdigest()[:12], 16) / 2.0**48 * n)
            days += [ret[(at + o) % n] for o in range(5)]
        final.append(np.cumprod(1 + np.array(days[:n])))
    got = market.QUERIES["m7_equity_confidence_history"](spark, SF).first()
    down = [min(0, (g / np.maximum.accumulate(np.maximum(g, 1)) - 1).min()) for g in final]
    last = [g[-1] for g in final]
    assert got.p50 == pytest.approx(np.percentile(last, 50) * 100, abs=1e-4) and got.dd_median == pytest.approx(np.percentile(down, 50), abs=1e-5)
    assert got.prob_loss == pytest.approx(np.mean(np.array(last) < 1), abs=2e-6)


def _days(spark, days, cfg, entries):
    """Trades on given (open, low, close) days of one ticker; entry flags on the days named."""
    data = [("r", "X", DAYS[i], float(o), float(lo), float(cl), 1.0, i - 1 in entries, False, DAYS[i - 1] if i else None) for i, (o, lo, cl) in enumerate(days)]
    schema = "run_id string, ticker string, date date, open double, low double, close double, atr double, enter boolean, leave boolean, before date"
    return backtest.signal_trades(spark.createDataFrame(data, schema), cfg).filter("kind = 'trade'").collect()


FREE = {"slippage_bps": 0, "spread_bps": 0, "commission_bps": 0}


def test_stop_gap_stop_and_timeout(spark):
    flat = [(100, 99.5, 100)] * 20
    stop = [*flat[:5], (100, 97, 98), *flat[6:]]  # entered at 100, stop at 98.5 within the day
    (t,) = _days(spark, [*flat[:4], *stop[4:]], backtest.TradeConfig(**FREE, max_positions=1), {2})
    assert (t.entry, t.exit, t.exit_date) == (100.0, 98.5, DAYS[5]) and t.pnl < 0
    gap = [*flat[:5], (95, 94, 96), *flat[6:]]  # opens below the stop: sold at the open
    (t,) = _days(spark, gap, backtest.TradeConfig(**FREE, max_positions=1), {2})
    assert (t.exit, t.exit_date) == (95.0, DAYS[5])
    (t,) = _days(spark, flat, backtest.TradeConfig(**FREE, max_positions=1, stop_atr=50, max_hold=3), {2})
    assert t.entry_date == DAYS[3] and (t.exit_date - t.entry_date).days in (3, 4)


def test_slots_are_never_exceeded(spark):
    data = [("r", t, DAYS[i], 100.0, 99.5, 100.0, 1.0, i == 3, False, DAYS[i - 1] if i else None) for t in "ABCD" for i in range(15)]
    schema = "run_id string, ticker string, date date, open double, low double, close double, atr double, enter boolean, leave boolean, before date"
    got = backtest.signal_trades(spark.createDataFrame(data, schema), backtest.TradeConfig(**FREE, max_positions=2, stop_atr=50)).filter("kind = 'trade'").collect()
    assert len(got) == 2 and len({t.ticker for t in got}) == 2


def test_trade_statistics(spark):
    from tickwell.operators import risk

    t = spark.createDataFrame([("a", 3.0), ("a", -1.0), ("a", -0.5), ("b", 2.0), ("c", 0.0)], "run_id string, pnl double")
    got = {r.run_id: r for r in risk.trade_stats(t).collect()}
    assert (got["a"].n_trades, got["a"].win_rate, got["a"].profit_factor, got["a"].avg_pnl) == (3, pytest.approx(1 / 3), 2.0, 0.5)
    assert got["b"].profit_factor == float("inf") and got["c"].profit_factor is None


def test_two_sided_pvalues(spark):
    from math import erfc

    from tickwell.operators import events

    df = spark.createDataFrame([(z / 4,) for z in range(-16, 33)], "z double").withColumn("p", events.two_sided_pvalue("z"))
    for r in df.collect():
        assert r.p == pytest.approx(erfc(abs(r.z) / 2**0.5), rel=1e-5, abs=1e-9)


def test_optimiser_posterior_keeps_the_prior_without_views(spark):
    cov = spark.createDataFrame([("A", "A", 0.04), ("A", "B", 0.01), ("B", "A", 0.01), ("B", "B", 0.09)], "ticker string, other string, cov double")
    none = spark.createDataFrame([], "ticker string, mu double")
    got = {r.ticker: r.mu for r in optimize.posterior(none, cov, 2.5).collect()}
    assert got == pytest.approx({"A": 2.5 * 0.025, "B": 2.5 * 0.05}, abs=1e-9)
    one = spark.createDataFrame([("A", 0.5)], "ticker string, mu double")
    assert optimize.posterior(one, cov, 2.5).filter("ticker = 'A'").first().mu > got["A"]


def test_portfolio_state(spark, tmp_path):
    state, cash = portfolio.buy(spark.createDataFrame([], portfolio.POSITIONS), 100.0, "x", 0.5, 20.0)
    portfolio.save_portfolio(state, cash, str(tmp_path / "p"))
    again, left = portfolio.load_portfolio(spark, str(tmp_path / "p"))
    assert rows(again) == [("X", 0.5, 20.0)] and left == 90.0
    empty, start = portfolio.load_portfolio(spark, str(tmp_path / "none"))
    assert empty.isEmpty() and start == portfolio.CASH
    unknown = portfolio.valuation(state, spark.createDataFrame([], "ticker string, last double")).first()
    assert unknown.price is None and unknown.value is None and unknown.weight is None


def test_factor_legs(spark):
    from tickwell.operators import risk

    r = spark.createDataFrame([("A", DAYS[i], float(i), 0.0) for i in range(3)] + [("B", DAYS[i], 1.0, 0.0) for i in range(3)], "ticker string, date date, ret double, bench double")
    f = risk.factor_returns(r, {"market": ("A", None), "size": ("B", "GONE"), "value": ("GONE", "A"), "momentum": ("A", "B")})
    assert f.columns == ["date", "market", "size", "momentum"]
    assert [tuple(x)[1:] for x in f.orderBy("date").collect()] == [(0.0, 1.0, -1.0), (1.0, 1.0, 0.0), (2.0, 1.0, 1.0)]


def test_readings(spark):
    lit = lambda x: F.lit(x).cast("double")
    one = lambda *c: spark.range(1).select(*c).first()
    assert list(one(*[interpret.beta(lit(x)).level for x in (0.4, 0.5, 1.2, 2.0, 2.1, None, float("nan"))])) == ["good", "ok", "ok", "weak", "bad", "ok", "ok"]
    assert list(one(*[interpret.drawdown(lit(x)).level for x in (-0.1, -0.2, -0.35, -0.36)])) == ["great", "good", "weak", "bad"]
    assert list(one(*[interpret.rsi(lit(x)).level for x in (20, 30, 31, 70, 80)])) == ["good", "good", "ok", "weak", "bad"]
    assert list(one(*[interpret.percent_b(lit(x)).level for x in (-0.1, 0.1, 0.2, 0.85, 0.9, 1.0, 1.1)])) == ["weak", "good", "ok", "ok", "weak", "weak", "bad"]
    assert list(one(*[interpret.macd(lit(a), lit(b)).level for a, b in ((1, 0), (1, 2), (-1, -2), (-1, 0), (1, None), (None, 1))])) == ["good", "ok", "ok", "weak", "ok", "ok"]
    assert list(one(*[interpret.grade(*map(lit, x)) for x in ((2, 0.1, -0.1, 2), (None, None, None, None), (-1, -0.1, -0.5, 0.5), (1.2, 0.01, -0.2, 1.4))])) == ["A+", "D-", "F", "B"]
    assert "40.0%" in one(interpret.drawdown(lit(-0.4)).detail)[0] and "0.80" in one(interpret.beta(lit(0.8)).detail)[0]
    assert one(interpret.var_sentence(lit(None), 100.0))[0].startswith("Too few")
    sheet = one(interpret.facts_sheet({n: lit(None) if n != "beta" else lit(1.1) for n in ("market_cap", "trailing_pe", "dividend_yield", "last", "year_high", "year_low", "atr_pct", "dollar_vol", "beta")} | {"sector": F.lit(None).cast("string"), "industry": F.lit(None).cast("string")}))[0]
    assert [(r.label, r.note) for r in sheet] == [("Beta", "Market-like")]
    assert one(interpret.factor_summary({"market": lit(1.0), "size": lit(0.04), "value": lit(-0.3), "momentum": lit(0.2)}, lit(0.5)))[0] == "1.00 of the market, away from value, towards momentum; 50% explained"


def test_limit_order_and_weekdays(spark):
    p = spark.createDataFrame([(i, d, g) for i, own in enumerate([[1.0, 0.9], [1.0, 0.95], [1.0, 1.1]]) for d, g in enumerate(own)], "path long, day int, growth double")
    r = montecarlo.limit_order(p, 200.0).first()
    assert r.limit_price == pytest.approx(190.0) and r.fill_prob == pytest.approx(2 / 3)
    friday = F.lit(dt.date(2024, 1, 5))
    got = spark.range(1).select(montecarlo.busday_count(friday, F.date_add(friday, 4)), montecarlo.busday_count(friday, friday), montecarlo.business_days(friday, 2)).first()
    assert list(got) == [2, 0, [dt.date(2024, 1, 8), dt.date(2024, 1, 9)]]
    assert montecarlo.seed_of("X", "2024-01-05") == montecarlo.seed_of("X", "2024-01-05") != montecarlo.seed_of("Y", "2024-01-05")


@pytest.mark.parametrize("name", ["p3_live_prices", "q1_rows", "n2_to_n8_levels", "x5_idea_geometry", "r11_portfolio_metrics", "q12_risk_detail"])
def test_composite_equals_sql(spark, name):
    from tickwell.plans import composite

    assert name in composite.QUERIES
    test_query_equals_sql(spark, name)
