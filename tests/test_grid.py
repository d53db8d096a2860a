"""The session grid, functions of series, events and portfolios against definitions computed in pandas and by brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwell.functions import series
from tickwell.functions.indicators import finite_frame
from tickwell.operators import backtest, events, ewm, optimize, risk, signals
from tickwell.sources import bars as src

DAYS = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(130)]
SCHEMA = "ticker string, date date, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def wide():
    """Fields -> days x tickers: A is whole, B has gaps, C starts late, D ends early, E has one bar."""
    r = np.random.default_rng(8)
    close = pd.DataFrame(100 * np.exp(np.cumsum(r.normal(0, 0.02, (130, 5)), 0)), index=DAYS, columns=list("ABCDE"))
    close.iloc[[7, 8, 40, 77, 78, 79, 129], 1] = np.nan
    close.iloc[:35, 2] = np.nan
    close.iloc[110:, 3] = np.nan
    close.iloc[1:, 4] = np.nan
    close.iloc[60:64, 0] = close.iloc[59, 0]
    out = {"close": close, "open": close * (1 + r.normal(0, 0.005, close.shape))}
    out["high"] = np.maximum(close, out["open"]) * (1 + r.uniform(0, 0.01, close.shape))
    out["low"] = np.minimum(close, out["open"]) * (1 - r.uniform(0, 0.01, close.shape))
    out["volume"] = pd.DataFrame(r.integers(50, 500, close.shape).astype(float), index=DAYS, columns=close.columns).where(close.notna())
    return out


@pytest.fixture(scope="module")
def panel(spark, wide):
    rows = [(t, d, *(float(wide[f].loc[d, t]) for f in ("open", "high", "low", "close", "volume"))) for t in "ABCDE" for d in DAYS if wide["close"].notna().loc[d, t]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def grid(panel):
    return src.densify(panel).persist()


def as_wide(df, column):
    return df.select("ticker", "date", column).toPandas().pivot(index="date", columns="ticker", values=column).reindex(index=DAYS, columns=list("ABCDE")).astype(float)


def same(got, want):
    np.testing.assert_allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


def wilder(x, n):
    return x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()


def definitions(w, short=5, long=9):
    """Every indicator with two parameters, in pandas on the wide frames."""
    c, h, lo, v = (w[k] for k in ("close", "high", "low", "volume"))
    before = c.shift(1)
    tr = pd.DataFrame(np.fmax(np.fmax(h - lo, (h - before).abs()), (lo - before).abs()), index=c.index, columns=c.columns)
    step, padded = c.diff(), c.ffill()
    up, down = h.diff(), -lo.diff()
    plus, minus = up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)
    out = {}
    for n in (short, long):
        gain, loss = wilder(step.clip(lower=0), n), wilder((-step).clip(lower=0), n)
        rsi = 100 - 100 / (1 + gain / loss.where(loss != 0))
        out[f"rsi{n}"] = rsi.where(loss.isna() | (loss != 0), pd.DataFrame(np.where(gain > 0, 100.0, 50.0), index=c.index, columns=c.columns))
        out[f"ema{n}"] = c.ewm(span=n, adjust=False, min_periods=n).mean()
        line = c.ewm(span=n, adjust=False).mean() - c.ewm(span=2 * n, adjust=False).mean()
        out[f"macd_hist{n}"] = line - line.ewm(span=n - 1, adjust=False).mean()
        out[f"atr{n}"] = wilder(tr, n)
        out[f"roc{n}"] = (padded / padded.shift(n) - 1) * 100
        mid, sd = c.rolling(n).mean(), c.rolling(n).std()
        out[f"pctb{n}"] = (c - (mid - 1.5 * sd)) / (3 * sd)
        p, m = wilder(plus, n), wilder(minus, n)
        out[f"adx{n}"] = wilder((100 * (p - m).abs() / (p + m).where(p + m != 0)).where(out[f"atr{n}"].notna()), n)
        out[f"rvol{n}"] = v / v.rolling(n).mean()
        out[f"vwap{n}"] = ((h + lo + c) / 3 * v).rolling(n).sum() / v.rolling(n).sum()
        low, high = lo.rolling(n).min(), h.rolling(n).max()
        out[f"stoch_d{n}"] = (100 * (c - low) / (high - low)).rolling(4).mean()
        out[f"keltner_up{n}"] = out[f"ema{n}"] + 1.5 * wilder(tr, n + 1)
        out[f"stop{n}"] = (c - 2 * out[f"atr{n}"]).cummax()
        out[f"span_a{n}"] = ((high + low) / 2 + (h.rolling(2 * n).max() + lo.rolling(2 * n).min()) / 2) / 2
    out["obv"] = (np.sign(step).fillna(0) * v).cumsum()
    return out


def test_series_functions_equal_pandas_on_a_panel_with_gaps(grid, wide):
    h, lo, x, v = (F.col(k) for k in ("high", "low", "close", "volume"))
    mine = {"obv": series.obv(x, v)}
    for n in (5, 9):
        mine |= {
            f"rsi{n}": series.rsi(x, n), f"ema{n}": series.ema(x, n), f"macd_hist{n}": series.macd(x, n, 2 * n, n - 1)[2], f"atr{n}": series.atr(h, lo, x, n), f"roc{n}": series.roc(x, n),
            f"pctb{n}": series.bollinger_percent_b(x, n, 1.5), f"adx{n}": series.adx(h, lo, x, n), f"rvol{n}": series.relative_volume(v, n), f"vwap{n}": series.vwap(h, lo, x, v, n),
            f"stoch_d{n}": series.stochastic(h, lo, x, n, 4)[1], f"keltner_up{n}": series.keltner_channels(h, lo, x, n, 1.5, n + 1)[1], f"stop{n}": series.atr_trailing_stop(h, lo, x, n, 2.0),
            f"span_a{n}": series.ichimoku(h, lo, x, n, 2 * n, 3 * n)[2],
        }
    got = series.rows(series.series(grid), **mine).toPandas()
    want = definitions(wide)
    assert set(mine) == set(want)
    for name, frame in want.items():
        same(got.pivot(index="date", columns="ticker", values=name).reindex(index=DAYS, columns=list("ABCDE")).astype(float), frame)


def test_frame_equals_pandas_on_a_panel_with_gaps(grid, wide):
    frame = ewm.indicator_frame(grid).persist()
    c, h, v = wide["close"], wide["high"], wide["volume"]
    own = definitions(wide, 14, 20)
    for name in ("rsi14", "atr14", "adx14", "ema20"):
        same(as_wide(frame, {"adx14": "adx"}.get(name, name)), own[name])
    same(as_wide(frame, "high52"), c.rolling(252, min_periods=60).max())
    same(as_wide(frame, "donchian"), h.rolling(20).max().shift(1))
    same(as_wide(frame, "dollar_volume"), (c * v).rolling(20).mean())
    same(as_wide(frame, "obv"), own["obv"])
    same(as_wide(frame, "underwater"), c / c.cummax() - 1)
    padded = c.ffill()
    same(as_wide(frame, "growth"), (1 + (padded / padded.shift(1) - 1)).cumprod())
    frame.unpersist()


def test_grid_and_returns(panel, grid, wide):
    assert grid.count() == 5 * 130 and grid.filter("close IS NULL").count() == int(wide["close"].isna().sum().sum())
    same(as_wide(grid, "close"), wide["close"])
    assert [r.session_i for r in grid.filter("ticker = 'B'").orderBy("date").collect()] == list(range(1, 131))
    rets = src.returns(grid)
    same(as_wide(rets, "ret"), wide["close"].ffill().pipe(lambda p: p / p.shift(1) - 1))
    gaps = src.returns(grid, "none")
    same(as_wide(gaps, "ret"), wide["close"] / wide["close"].shift(1) - 1)
    assert src.densify(panel.limit(0)).count() == 0
    with pytest.raises(ValueError):
        src.returns(grid, "drop")


def test_features_are_those_of_the_panels_last_session(grid):
    """B has no bar on the last session, D none for weeks, E too few: none of them is scored."""
    frame = ewm.indicator_frame(grid)
    assert {(r.ticker, r.date) for r in signals.features(frame).select("ticker", "date").collect()} == {("A", DAYS[-1]), ("C", DAYS[-1])}


def test_rebalance_carries_prices_over_gaps(grid, wide):
    got = [r.ret for r in backtest.rebalance(grid, lookback=10, top_n=2, hold=5, cost_bps=7.0).orderBy("date").collect()]
    p = wide["close"].ffill()
    ret, score = (p / p.shift(1) - 1).fillna(0), p / p.shift(10) - 1
    weights = pd.DataFrame(0.0, index=p.index, columns=p.columns)
    for i in range(11, len(p)):
        if (i - 11) % 5 == 0:
            best = score.iloc[i].dropna().nlargest(2).index
        weights.iloc[i] = [1 / len(best) if t in best else 0.0 for t in p.columns]
    want = (weights.shift(1) * ret).sum(axis=1) - weights.diff().abs().sum(axis=1) * 7e-4
    assert got == pytest.approx(want.iloc[11:].tolist(), abs=1e-12)


# ---------------------------------------------------------------- strategies of one's own


def test_strategies_and_their_errors(spark, grid):
    def build(data, ind):
        return ind.each(lambda c, m: c > m, data["close"], ind.ema(data["close"], 10)), ind.each(lambda c, m: c < m, data["close"], ind.ema(data["close"], 10))

    told = signals.run_strategy(grid, build)
    assert told.columns == ["ticker", "date", "entry", "exit"] and told.count() == 650
    assert told.filter("entry IS NULL OR exit IS NULL").count() == 0 and signals.check_fires(told) is told
    never = signals.run_strategy(grid, lambda data, ind: (F.transform(data["close"], lambda v: v < 0), F.transform(data["close"], lambda v: v > 0)))
    with pytest.raises(signals.StrategyError, match="never fires"):
        signals.check_fires(never)
    for bad, words in (
        (lambda data, ind: data["close"], "two things"), (lambda data, ind: (data["close"], data["close"]), "array<double>"), (lambda data, ind: (1, 2), "not int"), (lambda data, ind: 1 / 0, "ZeroDivisionError"),
        (lambda data, ind: (data["price"], 1), "KeyError"), ("def strategy", "must be a function"),
    ):
        with pytest.raises(signals.StrategyError, match=words):
            signals.run_strategy(grid, bad)


def test_outside_signals_are_aligned_to_the_grid(spark, grid):
    given = spark.createDataFrame([("A", DAYS[3], True, None), ("A", DAYS[3], False, False), ("B", DAYS[7], None, True), ("Z", DAYS[3], True, True), ("A", dt.date(2030, 1, 1), True, True)], "ticker string, date date, entry boolean, exit boolean")
    got = signals.align_signals(grid, given)
    assert got.count() == 650
    assert {(r.ticker, r.date, r.entry, r.exit) for r in got.filter("entry OR exit").collect()} == {("A", DAYS[3], True, False), ("B", DAYS[7], False, True)}
    with pytest.raises(signals.StrategyError, match="lack exit"):
        signals.align_signals(grid, given.drop("exit"))


# ---------------------------------------------------------------- events


def _bars(spark, closes, volumes=None, ticker="X", days=DAYS):
    rows = [(ticker, days[i], x, x, x, x, float((volumes or {}).get(i, 100))) for i, x in enumerate(closes) if x is not None]
    return spark.createDataFrame(rows, SCHEMA)


def _quiet(jumps, n=60, seed=5):
    """Closes with small steps and a jump (fraction) on the days named."""
    r = np.random.default_rng(seed)
    steps = r.normal(0, 0.004, n)
    for i, x in jumps.items():
        steps[i] = x
    return (100 * np.cumprod(1 + steps)).tolist()


def test_native_erfc(spark):
    z = [k / 8 for k in range(-40, 61)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(events.two_sided_pvalue("z")).collect()]
    assert all(g == pytest.approx(math.erfc(abs(x) / 2**0.5), rel=1.3e-7) for g, x in zip(got, z, strict=True))


def test_moves_are_scored_by_the_deviation_before_them(spark):
    closes = _quiet({30: 0.08, 45: -0.06})
    closes[20] = None  # a bar that is missing: returns run from bar to bar
    found = events.moves(events.significance(_bars(spark, closes, {30: 350}))).orderBy("date").collect()
    own = pd.Series([x for x in closes if x is not None], index=[d for d, x in zip(DAYS, closes, strict=False) if x is not None])
    ret = own / own.shift(1) - 1
    z = ret / ret.ewm(span=21, min_periods=20).std().shift(1)
    assert [r.date for r in found] == [DAYS[30], DAYS[45]] and [r.direction for r in found] == ["up", "down"]
    for r in found:
        assert r.z == pytest.approx(z[r.date]) and r.ret == pytest.approx(ret[r.date]) and r.pvalue == pytest.approx(math.erfc(abs(r.z) / 2**0.5), rel=1e-5)
    assert found[0].rvol == pytest.approx(3.5)
    flat = _bars(spark, [100.0] * 50 + [103.0])
    assert events.moves(events.significance(flat)).count() == 0  # no deviation to hold a move against


def test_catalysts_by_priority_day_and_market(spark):
    closes = _quiet({30: 0.08, 45: -0.09, 60: 0.1, 75: -0.1, 90: 0.1, 105: 0.1, 120: -0.12}, 130)
    x = _bars(spark, closes)
    market = _bars(spark, _quiet({90: 0.05, 105: 0.06, 120: 0.05}, 130, seed=6), ticker="MKT")
    marks = [
        ("X", DAYS[30], "earnings", None, None, None), ("X", DAYS[30], "action", 0.5, 2.0, None), ("X", DAYS[31], "news", None, None, "n30"),  # the same day wins over split and news
        ("X", DAYS[44], "earnings", None, None, None),  # the day before
        ("X", DAYS[58], "earnings", None, None, None), ("X", DAYS[60], "action", 0.5, 3.0, None),  # two sessions before: too old, the split counts
        ("X", DAYS[75], "action", 0.25, 0.0, None), ("X", DAYS[76], "action", 0.0, 9.0, None),
        *[("X", DAYS[89 + k], "news", None, None, f"n{k}") for k in (-1, 0, 1, 2)], ("X", DAYS[90], "news", None, None, "tie"),
        ("Y", DAYS[105], "earnings", None, None, None),
    ]
    found = events.moves(events.significance(x))
    got = {r.date: r for r in events.attribute(found, x, spark.createDataFrame(marks, events.MARKS), events.market_scores(x.union(market))).collect()}
    told = {DAYS.index(d): r.catalyst for d, r in got.items()}
    assert told == {30: "earnings", 45: "earnings", 60: "split", 75: "dividend", 90: "news", 105: "market", 120: "unknown"}
    assert got[DAYS[30]].earnings_date == DAYS[30] and got[DAYS[45]].earnings_date == DAYS[44] and got[DAYS[60]].earnings_date is None
    assert [h.title for h in got[DAYS[30]].headlines] == ["n30"]
    assert [h.title for h in got[DAYS[90]].headlines] == ["n2", "tie", "n1"]
    assert got[DAYS[90]].market_move and got[DAYS[105]].market_move and not got[DAYS[120]].market_move
    assert got[DAYS[120]].bench_ret == pytest.approx(0.05) and got[DAYS[120]].headlines == []
    order = [r.date for r in events.api_events(events.attribute(found, x, spark.createDataFrame([], events.MARKS), events.market_scores(market))).collect()]
    assert order == sorted(order, reverse=True)


def test_earnings_between_bars_count_for_the_next_two(spark):
    """Bars on every third day: a date between two bars belongs to the later one and to the one after it."""
    days = [DAYS[0] + dt.timedelta(days=3 * i) for i in range(60)]
    x = _bars(spark, _quiet({30: 0.08, 31: -0.08, 32: 0.09}), days=days)
    marks = spark.createDataFrame([("X", days[29] + dt.timedelta(days=1), "earnings", None, None, None)], events.MARKS)
    got = {days.index(r.date): r.catalyst for r in events.attribute(events.moves(events.significance(x)), x, marks, events.market_scores(x)).collect()}
    assert (got[30], got[31], got.get(32, "unknown")) == ("earnings", "earnings", "unknown")


# ---------------------------------------------------------------- portfolios


def projected(cov, gain, cap, steps=4000):
    """argmin w'Cw/2 - gain'w on the capped simplex by projected gradient: slow, and independent of the critical line."""

    def nearest(w):
        low, high = w.min() - 1, w.max()
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if np.clip(w - mid, 0, cap).sum() > 1 else (low, mid)
        return np.clip(w - (low + high) / 2, 0, cap)

    rate = 1 / np.linalg.eigvalsh(cov)[-1]
    w = y = nearest(np.full(len(cov), 1 / len(cov)))
    t = 1.0
    for _ in range(steps):
        new, s = nearest(y - rate * (cov @ y - gain)), (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, moved = new + (t - 1) / s * (new - w), np.abs(new - w).max()
        w, t = new, s
        if moved < 1e-12:
            break
    return w


@pytest.mark.parametrize("seed", range(12))
def test_critical_line_equals_projected_gradient(seed):
    r = np.random.default_rng(seed)
    n, cap = [2, 3, 4, 6, 8, 8, 9, 12, 5, 4, 8, 7][seed], [1.0, 0.4, 0.25, 0.4, 0.4, 0.25, 0.5, 0.15, 0.4, 0.4, 0.4, 1 / 3][seed]
    x = r.normal(size=(150, n)) * r.uniform(0.3, 2, n) + r.normal(size=(150, 1))
    cov, mu = np.cov(x.T), r.normal(0.05, 0.1, n)
    if seed == 10:
        mu = np.round(mu, 1)  # equal returns
    line = optimize.critical_line(mu, cov, cap)
    assert np.allclose(line.sum(1), 1) and line.min() >= 0 and line.max() <= cap + 1e-7
    gain = line @ mu
    assert (np.diff(gain) <= 1e-9).all() and (np.diff(np.einsum("ki,ij,kj->k", line, cov, line)) <= 1e-9).all()
    best = projected(cov, np.zeros(n), cap)
    assert line[-1] @ cov @ line[-1] == pytest.approx(best @ cov @ best, abs=1e-9)
    assert gain[0] == pytest.approx(sum(v * min(cap, max(0, 1 - k * cap)) for k, v in enumerate(sorted(mu, reverse=True))), abs=1e-8)
    for price in (0.2, 1.0):
        w = projected(cov, price * mu, cap)
        v = optimize.at_return(line, mu, float(w @ mu))
        assert v @ mu == pytest.approx(w @ mu, abs=1e-9) and v @ cov @ v <= w @ cov @ w + 1e-9
    if (mu > 0).any():
        bold, fell = optimize.max_sharpe(mu, cov, cap)
        ratio = lambda w: (w @ mu) / (w @ cov @ w) ** 0.5
        assert not fell and all(ratio(bold) >= ratio(projected(cov, k * mu, cap, 800)) - 1e-9 for k in np.exp(np.linspace(-4, 3, 8)))


def test_critical_line_odd_cases():
    cov = np.diag([1.0, 2.0, 4.0])
    assert optimize.critical_line(np.array([0.1, 0.2, 0.3]), cov, 0.3).tolist() == [[1 / 3] * 3]  # a cap that can't be met
    assert optimize.critical_line(np.array([0.1]), cov[:1, :1], 1.0).tolist() == [[1.0]]
    level = optimize.critical_line(np.full(3, 0.1), cov, 1.0)
    assert len(level) == 1 and level[0] == pytest.approx(np.array([4, 2, 1]) / 7)
    assert optimize.max_sharpe(np.array([-0.1, 0.0, 0.01]), cov, 1.0, rf=0.02)[1]
    line = optimize.critical_line(np.array([0.1, 0.2, 0.3]), cov, 0.5)
    assert optimize.at_return(line, np.array([0.1, 0.2, 0.3]), 9.0).tolist() == [1 / 3] * 3
    twin = np.array([[1.0, 1.0, 0.2], [1.0, 1.0, 0.2], [0.2, 0.2, 1.0]])  # two tickers alike: the matrix has no inverse
    assert np.allclose(optimize.critical_line(np.array([0.1, 0.1, 0.2]), twin, 0.6).sum(1), 1)


def test_profiles_and_frontier(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 6)) * np.linspace(0.5, 2, 6)
    cov, mu = np.cov(x.T), np.linspace(0.02, 0.3, 6)
    names = list("ABCDEF")
    mus = spark.createDataFrame(list(zip(names, mu.tolist(), strict=True)), "ticker string, mu double")
    covs = spark.createDataFrame([(a, b, float(cov[i, j]), 200) for i, a in enumerate(names) for j, b in enumerate(names)], "ticker string, other string, cov double, n long")
    w = optimize.solve(mus, covs).toPandas().pivot(index=["profile", "point"], columns="ticker", values="weight")
    gain = w @ mu
    assert w.sum(axis=1).to_numpy() == pytest.approx(1) and w.to_numpy().max() <= 0.4 + 1e-9 and w.to_numpy().min() >= 0
    assert gain["balanced", 0] == pytest.approx((gain["min_variance", 0] + gain["max_sharpe", 0]) / 2)
    edge = gain["frontier"].to_numpy()
    vol = np.array([v @ cov @ v for v in w.loc["frontier"].to_numpy()]) ** 0.5
    assert len(edge) == 25 and np.allclose(np.diff(edge), np.diff(edge)[0]) and (np.diff(vol) > -1e-12).all()
    assert edge[0] == pytest.approx(gain["min_variance", 0]) and edge[-1] == pytest.approx(0.4 * mu[5] + 0.4 * mu[4] + 0.2 * mu[3])
    corner = optimize.corners(mus, covs).toPandas().drop_duplicates("corner").sort_values("ret")
    on = np.interp(corner["ret"], edge, vol)
    assert (corner["vol"].to_numpy() <= on + 1e-9).all()  # between two points the frontier is convex: corners lie on or below the chord
    delta = spark.createDataFrame([(2.5,)], "delta double")
    told = optimize.profiles(mus, covs, delta, rf=0.01).toPandas()
    assert set(told["profile"]) == {"min_variance", "balanced", "max_sharpe", "anchored"}
    by = told.drop_duplicates("profile").set_index("profile")
    assert by["vol"]["min_variance"] <= by["vol"]["balanced"] <= by["vol"]["max_sharpe"] + 1e-12
    assert by["sharpe"]["max_sharpe"] >= max(by["sharpe"][["min_variance", "balanced"]]) - 1e-12
    with pytest.raises(Exception, match="at least 300 sessions"):
        optimize.profiles(mus, covs, delta, least=300).collect()


def test_covariance_of_complete_dates_needs_no_second_look(spark):
    r = np.random.default_rng(1)
    rows = [(t, DAYS[i], float(x)) for i, row in enumerate(r.normal(size=(40, 3))) for t, x in zip("ABC", row, strict=True)]
    rets = spark.createDataFrame(rows, "ticker string, date date, ret double")
    a, b = (sorted(map(tuple, risk.shrunk_covariance(rets, k).collect())) for k in (False, True))
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-12)


def test_finite_frame_of_own_bars_is_a_panel_without_gaps(spark, panel, wide):
    own = finite_frame(panel.filter("ticker = 'B'"))
    c = wide["close"]["B"].dropna()
    got = {r.date: r.roc5 for r in own.select("date", "roc5").collect()}
    want = (c / c.shift(5) - 1) * 100
    assert all((got[d] is None and np.isnan(x)) or got[d] == pytest.approx(x) for d, x in want.items())


def test_exposures_equal_least_squares_on_the_rows(spark):
    """Two years of rows, two nearly equal factors, two collinear ones, a short ticker and rows without a value."""
    r = np.random.default_rng(2)
    days = [dt.date(2023, 9, 1) + dt.timedelta(days=i) for i in range(200)]
    f = r.normal(0, 0.01, (200, 2))
    facs = np.column_stack([f, f[:, 0] + 1e-9 * r.normal(size=200)])
    y = 0.0004 + f @ [1.2, -0.5] + r.normal(0, 0.003, 200)
    rows = [("A", days[i], float(y[i]), *map(float, facs[i]), float(2 * f[i, 0])) for i in range(200)] + [("B", days[i], float(y[i]), *map(float, facs[i]), 0.0) for i in range(30)]
    rets = spark.createDataFrame([*rows, ("A", dt.date(2025, 1, 1), None, 1.0, 1.0, 1.0, 1.0)], "ticker string, date date, ret double, a double, b double, near double, twice double")
    for names in (["a", "b"], ["a", "b", "near"], ["a", "b", "twice"]):
        (got,) = risk.factor_exposures(rets, names).collect()
        x = np.column_stack([np.ones(200), *[facs[:, ["a", "b", "near"].index(n)] if n != "twice" else 2 * f[:, 0] for n in names]])
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        assert (got.ticker, got.n) == ("A", 200)
        assert got.r2 == pytest.approx(1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)
        tight = 1e-4 if "near" in names else 1e-8  # a condition number of 1e9 leaves that much in either way
        assert [got[f"beta_{n}"] for n in names] == pytest.approx(beta[1:].tolist(), rel=tight, abs=tight) and got.alpha == pytest.approx(beta[0] * 252, abs=1e-6)


def test_pairs_by_blocks_equal_numpy(spark, monkeypatch):
    """Many tickers in blocks of three over several parts of time."""
    monkeypatch.setattr(risk, "BLOCK", 3)
    monkeypatch.setattr(risk, "PART", 40)
    r = np.random.default_rng(4)
    x = r.normal(0, 0.01, (130, 10)) + r.normal(0, 0.01, (130, 1))
    names = [f"T{i}" for i in range(10)]
    rows = [(t, DAYS[i], float(x[i, j])) for i in range(130) for j, t in enumerate(names) if (i, j) != (50, 3)]
    rets = spark.createDataFrame(rows, "ticker string, date date, ret double")
    whole = np.delete(x, 50, 0)
    got = {(r.ticker, r.other): (r.corr, r.cov) for r in risk.correlation(rets).collect()}
    corr, cov = np.corrcoef(whole.T), np.cov(whole.T)
    assert len(got) == 55
    for (a, b), v in got.items():
        i, j = names.index(a), names.index(b)
        assert a <= b and v == pytest.approx((corr[i, j], cov[i, j]), abs=1e-12)
    shrunk = {(r.ticker, r.other): r.cov for r in risk.shrunk_covariance(rets).collect()}
    c = whole - whole.mean(0)
    s, n, p = c.T @ c / 129, 129, 10
    mu = np.trace(s) / p
    d = ((s**2).sum() - p * mu * mu) / p
    beta = (((c**2).T @ (c**2) / n).sum() - (s**2).sum()) / (p * n)
    k = min(beta, d) / d
    want = ((1 - k) * s + k * mu * np.eye(p)) * 252
    assert len(shrunk) == 100 and all(v == pytest.approx(want[names.index(a), names.index(b)], abs=1e-12) for (a, b), v in shrunk.items())
