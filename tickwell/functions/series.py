"""UD3: indicators as functions of series with any parameters, for strategies of one's own.

A series is an array column: one row holds one ticker's values on all sessions of the panel, null where there is no bar.
Functions take array columns and parameters and give array columns of the same length, so they can be put into each
other; recursive filters are folds inside the JVM. `series` makes such rows from a panel and `rows` unfolds them again.
A ticker's history is one row: a fold copies its result once for each session, which suits histories of some thousand
sessions; the windows of `functions.indicators` have no such bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")
NAMES = ("rsi", "ema", "macd", "atr", "roc", "bollinger_percent_b", "adx", "relative_volume", "vwap", "stochastic", "obv", "keltner_channels", "atr_trailing_stop", "ichimoku")


def series(panel: DataFrame) -> DataFrame:
    """One row for each ticker of a densified panel: ticker, date and the fields as arrays in order of sessions."""
    one = panel.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", *FIELDS))).alias("_s"))
    return one.select("ticker", *[F.col(f"_s.{c}").alias(c) for c in ("date", *FIELDS)])


def rows(own: DataFrame, **columns: Column) -> DataFrame:
    """(ticker, date, columns): one row for each session of each ticker, from rows of series."""
    named = own.select("ticker", "date", *[x.alias(k) for k, x in columns.items()])
    return named.select("ticker", F.inline(F.arrays_zip("date", *columns)))


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def each(f: Callable[..., Column], *xs: Column) -> Column:
    """f of the values of several series on each session."""

    def bind(left: tuple[Column, ...], held: tuple[Column, ...]) -> Column:
        if left:
            return let(left[0], lambda x: bind(left[1:], (*held, x)))
        return F.transform(held[0], lambda v, i: f(v, *[F.get(x, i) for x in held[1:]]))

    return bind(xs, ())


def lag(x: Column, n: int = 1) -> Column:
    return let(x, lambda h: F.transform(h, lambda _, i: F.get(h, i - n)))


def _scan(x: Column, start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], out: str) -> Column:
    """Values of `out` along the series; start and step give the state."""
    first = F.struct(*[v.alias(k) for k, v in start.items()], F.array().cast("array<double>").alias("_out"))

    def merge(s: Column, v: Column) -> Column:
        new = step(s, v)
        # the new state is bound before its value is put behind the ones before
        return let(F.struct(*[w.alias(k) for k, w in new.items()]), lambda t: F.struct(*[t[k].alias(k) for k in start], F.concat(s["_out"], F.array(t[out])).alias("_out")))

    return F.aggregate(x, first, merge, lambda s: s["_out"])


def pad(x: Column) -> Column:
    """The last value known on each session."""
    return _scan(x, {"y": F.lit(None).cast("double")}, lambda s, v: {"y": F.coalesce(v, s["y"])}, "y")


def ewm(x: Column, alpha: float, least: int = 0) -> Column:
    """y = ((1 - a)^g * y + a * x) / ((1 - a)^g + a), with g the sessions since the last value; sessions without
    a value keep y. Null until `least` values are known."""

    def step(s: Column, v: Column) -> dict[str, Column]:
        kept = F.pow(F.lit(1 - alpha), s["g"] + 1)
        y = F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise((kept * s["y"] + alpha * v) / (kept + alpha))
        n = s["n"] + v.isNotNull().cast("int")
        return {"y": y, "g": F.when(v.isNull(), s["g"] + 1).otherwise(0), "n": n, "told": F.when(n >= least, y)}

    return _scan(x, {"y": F.lit(None).cast("double"), "g": F.lit(0), "n": F.lit(0)}, step, "told")


def running(x: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of the value so far and each value there is (a running sum or maximum); null where there is none."""
    return _scan(x, {"y": F.lit(None).cast("double")}, lambda s, v: {"y": F.when(v.isNull(), s["y"]).when(s["y"].isNull(), v).otherwise(f(s["y"], v)), "told": F.when(v.isNotNull(), F.when(s["y"].isNull(), v).otherwise(f(s["y"], v)))}, "told")


def rolling(x: Column, n: int, f: Callable[[Column], Column]) -> Column:
    """f of each window of n sessions that is full and holds no null."""

    def one(h: Column) -> Column:
        window = lambda i: F.slice(h, i - (n - 2), F.lit(n))
        whole = lambda w: F.when(~F.exists(w, lambda v: v.isNull()), f(w))
        return F.transform(h, lambda _, i: F.when(i >= n - 1, let(window(i), whole)))

    return let(x, one)


def _sum(w: Column) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column, n: int) -> Column:
    return rolling(x, n, lambda w: _sum(w) / n)


def deviation(x: Column, n: int) -> Column:
    """Sample deviation."""
    return rolling(x, n, lambda w: let(_sum(w) / n, lambda m: F.sqrt(F.aggregate(w, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - 1))))


def ema(x: Column, span: int) -> Column:
    """W1"""
    return ewm(x, 2 / (span + 1), span)


def rsi(x: Column, period: int = 14) -> Column:
    """W2"""
    steps = each(lambda now, before: now - before, x, lag(x))
    strength = lambda up, down: F.when(down != 0, 100 - 100 / (1 + up / down)).when(down == 0, F.when(up > 0, 100.0).otherwise(50.0))
    side = lambda s, sign: ewm(F.transform(s, lambda v: F.when(v.isNotNull(), F.greatest(sign * v, F.lit(0.0)))), 1 / period, period)
    return let(steps, lambda s: each(strength, side(s, 1.0), side(s, -1.0)))


def macd(x: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[Column, Column, Column]:
    """Line, signal and their distance."""
    line = each(lambda a, b: a - b, ewm(x, 2 / (fast + 1)), ewm(x, 2 / (slow + 1)))
    smooth = ewm(line, 2 / (signal + 1))
    return line, smooth, each(lambda a, b: a - b, line, smooth)


def true_range(high: Column, low: Column, close: Column) -> Column:
    """W4"""
    return each(lambda h, lo, p: F.greatest(h - lo, F.abs(h - p), F.abs(lo - p)), high, low, lag(close))


def atr(high: Column, low: Column, close: Column, period: int = 14) -> Column:
    """W5"""
    return ewm(true_range(high, low, close), 1 / period, period)


def roc(x: Column, n: int) -> Column:
    """Percent over n sessions; the last value is carried over gaps."""
    return let(pad(x), lambda p: each(lambda now, before: (F.try_divide(now, before) - 1) * 100, p, lag(p, n)))


def bollinger_percent_b(x: Column, window: int = 20, num_std: float = 2.0) -> Column:
    """W6"""
    return each(lambda v, m, s: F.try_divide(v - (m - num_std * s), 2 * num_std * s), x, mean(x, window), deviation(x, window))


def adx(high: Column, low: Column, close: Column, period: int = 14) -> Column:
    """W8; sessions without a bar count as ones without a directional move."""
    up, down = each(lambda a, b: a - b, high, lag(high)), each(lambda a, b: b - a, low, lag(low))
    move = lambda a, b: F.when((a > b) & (a > 0), a).otherwise(0.0)
    plus, minus = each(move, up, down), each(move, down, up)
    index = lambda p, m, r: F.when(r != 0, F.try_divide(100 * F.abs(p - m), F.nullif(p + m, F.lit(0.0))))
    smooth = lambda x: ewm(x, 1 / period, period)
    return smooth(each(index, smooth(plus), smooth(minus), atr(high, low, close, period)))


def relative_volume(volume: Column, window: int = 20) -> Column:
    """W9"""
    return each(lambda v, m: F.try_divide(v, m), volume, mean(volume, window))


def vwap(high: Column, low: Column, close: Column, volume: Column, window: int = 20) -> Column:
    """W10"""
    paid = each(lambda h, lo, c, v: (h + lo + c) / 3 * v, high, low, close, volume)
    return each(lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0))), rolling(paid, window, _sum), rolling(volume, window, _sum))


def stochastic(high: Column, low: Column, close: Column, k: int = 14, d: int = 3) -> tuple[Column, Column]:
    """%K and %D."""
    percent = each(lambda c, lo, hi: 100 * F.try_divide(c - lo, F.nullif(hi - lo, F.lit(0.0))), close, rolling(low, k, F.array_min), rolling(high, k, F.array_max))
    return percent, mean(percent, d)


def obv(close: Column, volume: Column) -> Column:
    """W12; changes below 1e-9 are none."""
    signed = each(lambda c, p, v: F.coalesce(F.signum(F.round(c - p, 9)), F.lit(0.0)) * v, close, lag(close), volume)
    return running(signed, lambda a, v: a + v)


def keltner_channels(high: Column, low: Column, close: Column, window: int = 20, mult: float = 2.0, atr_period: int = 10) -> tuple[Column, Column, Column]:
    """Middle, upper and lower line."""
    mid, reach = ema(close, window), atr(high, low, close, atr_period)
    return mid, each(lambda m, r: m + mult * r, mid, reach), each(lambda m, r: m - mult * r, mid, reach)


def atr_trailing_stop(high: Column, low: Column, close: Column, period: int = 14, mult: float = 3.0) -> Column:
    """W14"""
    return running(each(lambda c, r: c - mult * r, close, atr(high, low, close, period)), lambda a, v: F.greatest(a, v))


def ichimoku(high: Column, low: Column, close: Column, conversion: int = 9, base: int = 26, span_b: int = 52) -> tuple[Column, Column, Column, Column]:
    """Conversion line, base line and the two spans."""
    middle = lambda n: each(lambda a, b: (a + b) / 2, rolling(high, n, F.array_max), rolling(low, n, F.array_min))
    tenkan, kijun = middle(conversion), middle(base)
    return tenkan, kijun, each(lambda a, b: (a + b) / 2, tenkan, kijun), middle(span_b)


def crosses_above(a: Column, b: Column) -> Column:
    """W21 on series."""
    return each(lambda x, y, p, q: F.coalesce((x > y) & (p <= q), F.lit(False)), a, b, lag(a), lag(b))
