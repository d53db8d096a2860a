"""Plain-language readings of numbers as columns: struct(level, label, detail) by threshold ladders, and sentences
put together from several numbers (N1 to N23). Levels and bounds are fixed values; the wording is our own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def verdict(level: Column | str, label: Column | str, detail: Column | str) -> Column:
    """N1"""
    own = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(own(level).alias("level"), own(label).alias("label"), own(detail).alias("detail"))


_REACHES = {">=": lambda x, b: x >= b, ">": lambda x, b: x > b, "<=": lambda x, b: x <= b, "<": lambda x, b: x < b}


def ladder(x: Column, steps: list[tuple[str, float, str, str]], last: tuple[str, str], pattern: str, unknown: str = "not enough data") -> Column:
    """The first step (comparison, bound, level, label) that x meets, else `last`; `pattern` formats x into the detail."""
    x = finite(x.cast("double"))
    out = F.when(x.isNull(), verdict("ok", "n/a", unknown))
    text = F.format_string(pattern, x)
    for how, bound, level, label in steps:
        out = out.when(_REACHES[how](x, bound), verdict(level, label, text))
    return out.otherwise(verdict(last[0], last[1], text))


# ---- bounds and levels of the ladders: fixed values


def sharpe(x: Column) -> Column:
    """N2"""
    steps = [(">=", 1.5, "great", "Excellent"), (">=", 1.0, "good", "Good"), (">=", 0.5, "ok", "Fair"), (">=", 0.0, "weak", "Weak")]
    return ladder(x, steps, ("bad", "Losing"), "%.2f of return for each unit of risk")


def beta(x: Column) -> Column:
    """N3"""
    steps = [("<", 0.5, "good", "Calm"), ("<=", 1.2, "ok", "Market-like"), ("<=", 2.0, "weak", "Lively")]
    return ladder(x, steps, ("bad", "Wild"), "%.2f of each market move is passed on")


def alpha(x: Column) -> Column:
    """N4"""
    steps = [(">=", 10.0, "great", "Strong"), (">=", 2.0, "good", "Positive"), (">=", -2.0, "ok", "Neutral")]
    return ladder(x * 100, steps, ("bad", "Negative"), "%+.1f%% a year beyond the market's part")


def drawdown(x: Column) -> Column:
    """N5"""
    steps = [("<=", 10.0, "great", "Shallow"), ("<=", 20.0, "good", "Moderate"), ("<=", 35.0, "weak", "Deep")]
    return ladder(F.abs(x) * 100, steps, ("bad", "Severe"), "%.1f%% below the peak at worst")


def var_sentence(var: Column, capital: Column | float) -> Column:
    """N6"""
    c = F.lit(float(capital)) if isinstance(capital, (int, float)) else capital
    told = F.format_string("On a bad day (1 in 20) $%.2f or more of $%.0f is lost (%.1f%%).", var * c, c, var * 100)
    return F.when(finite(var).isNull(), "Too few days for a daily worst case.").otherwise(told)


def profit_factor(x: Column) -> Column:
    """N7"""
    steps = [(">=", 2.0, "great", "Strong"), (">=", 1.3, "good", "Profitable"), (">=", 1.0, "ok", "Marginal")]
    return ladder(x, steps, ("bad", "Losing"), "%.2f won for each 1 lost", "no closed trades")


def grade(sharpe_: Column, alpha_: Column, dd: Column, pf: Column) -> Column:
    """Points for four measures, as a letter; an unknown measure gives none."""
    s, a, d, p = (finite(x.cast("double")) for x in (sharpe_, alpha_, dd, pf))
    none = F.lit(0)
    points = (
        F.when(s.isNull(), none).when(s >= 1.5, 3).when(s >= 1, 2).when(s >= 0.5, 1).when(s >= 0, 0).otherwise(-2)
        + F.when(a.isNull(), none).when(a >= 0.05, 2).when(a > 0, 1).otherwise(-1)
        + F.when(d.isNull(), none).when(d >= -0.15, 1).when(d >= -0.3, 0).otherwise(-1)
        + F.when(p >= 1.3, 1).otherwise(0)
    )
    letters = F.array(*[F.lit(x) for x in ("D-", "D", "C", "C+", "B", "B+", "A", "A+")])
    return F.when(points < 0, "F").otherwise(F.element_at(letters, points + 1))


def backtest_summary(total: Column, capital: float, bench_total: Column, dd: Column, win_rate: Column) -> Column:
    """What became of the capital, against holding the benchmark, with the worst fall and the share of wins."""
    lead = (total - bench_total) * 100
    parts = [
        F.format_string("$%.0f became $%.2f (%+.1f%%).", F.lit(capital), capital * (1 + total), total * 100),
        F.when(finite(bench_total).isNotNull(), F.concat(
            F.format_string("The benchmark alone made %+.1f%%, ", bench_total * 100),
            F.when(lead > 0, F.format_string("%.1f points less.", lead)).otherwise(F.format_string("%.1f points more.", F.abs(lead))),
        )),
        F.when(finite(dd).isNotNull(), F.format_string("At worst it stood %.0f%% below a peak.", F.abs(dd) * 100)),
        F.when(finite(win_rate).isNotNull(), F.format_string("%.0f%% of trades won.", win_rate * 100)),
    ]
    return F.concat_ws(" ", *parts)


def signed(x: Column, digits: int = 1) -> Column:
    """A number with its sign and so many decimals, halves to even."""
    r = F.bround(x, digits)
    return F.concat(F.when(r >= 0, "+").otherwise("-"), F.format_string(f"%.{digits}f", F.abs(r)))


def reason(momentum: Column, trend: Column, meanrev: Column, vol: Column, roc20: Column, rsi2: Column, rvol: Column) -> Column:
    """What speaks for a ticker, each with its figure."""
    whole = lambda x: F.format_string("%.0f", F.bround(x, 0))
    parts = [
        F.when(momentum > 0.5, F.concat(F.lit("rising faster than its peers ("), signed(roc20, 0), F.lit("% in 20 sessions)"))),
        F.when(trend > 0.3, "in an uptrend above its averages"),
        F.when(meanrev > 0.5, F.concat(F.lit("dipped within an uptrend (two-session strength "), whole(rsi2), F.lit(")"))),
        F.when(vol > 0.5, F.concat(F.lit("on unusual volume ("), F.format_string("%.1f", F.bround(rvol, 1)), F.lit(" times the average)"))),
    ]
    text = F.concat_ws("; ", *parts)
    return F.when(text == "", "balanced on all measures").otherwise(text)


def regime(up: Column, breadth: Column) -> Column:
    """N11"""
    return F.when(up & (breadth >= 0.55), "Risk-on").when(~up & (breadth <= 0.45), "Risk-off").otherwise("Mixed")


def optimizer_summary(ret: Column, vol: Column, sharpe_: Column, top: Column, top_dollars: Column, fell_back: Column) -> Column:
    """N12"""
    told = F.format_string("Aims at %+.0f%% a year with swings of %.0f%% (Sharpe %.2f).", ret * 100, vol * 100, sharpe_)
    largest = F.when(top.isNotNull(), F.format_string(" Largest: $%.2f in %s.", top_dollars, top)).otherwise("")
    return F.concat(F.when(fell_back, "No ticker beats cash here, so this is the calmest mix. ").otherwise(""), told, largest)


def odds(p: Column) -> Column:
    """How often chance alone gives such a day."""
    days = F.try_divide(F.lit(1.0), F.when(p > 0, p))
    years = days / 252
    whole = lambda x: F.bround(x, 0).cast("long").cast("string")
    return (
        F.when(days.isNull(), "never by chance alone")
        .when(days < 40, F.concat(F.lit("about one trading day in "), whole(days)))
        .when(years < 1.5, F.concat(F.lit("about once a year, one trading day in "), whole(days)))
        .when(years < 1000, F.concat(F.lit("about once in "), whole(years), F.lit(" years")))
        .otherwise("less than once in 1000 years")
    )


#: What a catalyst is called.
CATALYSTS = {"earnings": "an earnings report", "split": "a share split", "dividend": "a dividend", "news": "news of the day", "market": "a move of the whole market", "unknown": "no known cause"}


def event_story(ticker: Column, ret: Column, z: Column, catalyst: Column, p: Column, rvol: Column, headline: Column, market_move: Column, bench_ret: Column) -> Column:
    """(title, label, story) of a significant move. The story tells its size and odds, the catalyst (the newest
    headline where news is the reason, the benchmark's own move where the market is), the volume and, for other
    reasons, a market that moved along."""
    label = F.coalesce(*[F.when(catalyst == k, F.lit(v)) for k, v in CATALYSTS.items()], F.lit(CATALYSTS["unknown"]))
    percent, size = F.concat(signed(ret * 100), F.lit("%")), F.format_string("%.1f", F.bround(F.abs(z), 1))
    why = (
        F.when((catalyst == "news") & headline.isNotNull(), F.concat(F.lit(': "'), headline, F.lit('"')))
        .when((catalyst == "market") & bench_ret.isNotNull(), F.concat(F.lit(", which moved "), signed(bench_ret * 100), F.lit("% itself")))
        .otherwise("")
    )
    times = F.format_string("%.1f", F.bround(rvol, 1))
    heavy = F.when(rvol >= 2, F.concat(F.lit(" Volume was "), times, F.lit(" times the usual."))).when(rvol < 0.8, F.concat(F.lit(" Volume was thin, "), times, F.lit(" times the usual."))).otherwise("")
    along = F.when(market_move & (catalyst != "market"), " The market moved the same way.").otherwise("")
    story = F.concat(
        ticker, F.when(ret > 0, " rose ").otherwise(" fell "), percent, F.lit(", "), size, F.lit(" usual deviations: "), label, why, F.lit(". By chance "), odds(p), F.lit("."), heavy, along
    )
    return F.struct(F.concat(percent, F.lit(", "), size, F.lit(" deviations")).alias("title"), label.alias("label"), story.alias("story"))


def entry(rsi_: Column, pctb: Column, off_high: Column, above: Column, earnings_in: Column) -> Column:
    """earnings_in is the number of sessions until earnings, or null."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = yes(finite(rsi_) < 35) | yes(finite(pctb) < 0.15) | yes(finite(off_high) < -0.07)
    high = yes(finite(rsi_) > 70) | yes(finite(pctb) > 0.9)
    warn = F.when(earnings_in.isNotNull(), F.format_string(" Earnings come in about %d sessions.", earnings_in.cast("int"))).otherwise("")
    told = lambda level, label, text: verdict(level, label, F.concat(F.lit(text), warn))
    return (
        F.when(low & yes(above), told("good", "Buy zone", "A dip in an uptrend.")).when(low, told("weak", "Falling knife", "Weak and below its trend."))
        .when(high, told("weak", "Chasing", "Stretched above its range.")).otherwise(told("ok", "No rush", "Neither cheap nor stretched."))
    )


def forecast_narrative(ticker: Column, horizon: int, n_paths: int, x: dict[str, Column], dip: float) -> Column:
    """N16 from prob_up, p50, p05, median_day, median_low, fill_rate, avg_overall and now_avg."""
    head = F.format_string(
        f"%s, replayed {n_paths} times over {horizon} sessions, ends higher in %.0f%% of them (median %+.1f%%, one in twenty below %+.1f%%). The usual low is %.1f%% at session %d. ",
        ticker, x["prob_up"] * 100, x["p50"] * 100, x["p05"] * 100, (x["median_low"] - 1) * 100, x["median_day"],
    )
    both = [x["avg_overall"] * 100, x["now_avg"] * 100]
    wait = (
        F.when(x["fill_rate"] == 0, f"An order {dip:.0f}% lower was never filled.")
        .when(x["avg_overall"] > x["now_avg"], F.format_string(f"Waiting for a dip of {dip:.0f}%% did better than buying now (%+.1f%% against %+.1f%%).", *both))
        .otherwise(F.format_string(f"Buying now did better than waiting for a dip of {dip:.0f}%% (%+.1f%% against %+.1f%%).", both[1], both[0]))
    )
    return F.concat(head, wait)


def rsi(x: Column) -> Column:
    """N17"""
    steps = [(">=", 80.0, "bad", "Very overbought"), (">=", 70.0, "weak", "Overbought"), ("<=", 20.0, "good", "Very oversold"), ("<=", 30.0, "good", "Oversold")]
    return ladder(x, steps, ("ok", "Neutral"), "RSI at %.0f")


def macd(hist: Column, before: Column) -> Column:
    """The histogram and the one of the session before."""
    h, rising = finite(hist), F.coalesce(finite(hist) > finite(before), F.lit(False))
    text = F.format_string("histogram at %.3f", h)
    return (
        F.when(h.isNull(), verdict("ok", "n/a", "not enough data")).when((h > 0) & rising, verdict("good", "Bullish and rising", text)).when(h > 0, verdict("ok", "Bullish, fading", text))
        .when(rising, verdict("ok", "Bearish, easing", text)).otherwise(verdict("weak", "Bearish", text))
    )


def percent_b(x: Column) -> Column:
    """N17"""
    steps = [(">", 1.0, "bad", "Above the band"), (">", 0.85, "weak", "Near the top"), ("<", 0.0, "weak", "Below the band"), ("<", 0.2, "good", "Near the bottom")]
    return ladder(x, steps, ("ok", "Inside"), "%%B at %.2f")


def volume(x: Column) -> Column:
    """N17"""
    steps = [(">=", 2.0, "good", "Surging"), (">=", 1.3, "ok", "Busy"), ("<=", 0.6, "ok", "Quiet")]
    return ladder(x, steps, ("ok", "Normal"), "%.1f times the usual volume")


def vol_regime(ratio: Column, current: Column) -> Column:
    """Current volatility against the sample's."""
    known = finite(ratio).isNotNull() & finite(current).isNotNull()
    told = (
        F.when(ratio >= 1.4, F.format_string("Swings are %.1f times the usual (%.0f%% a year).", ratio, current * 100))
        .when(ratio <= 0.7, F.format_string("Calm: %.1f times the usual swings (%.0f%% a year).", ratio, current * 100))
        .otherwise(F.format_string("Swings of %.0f%% a year are about the usual.", current * 100))
    )
    return F.when(known, told).otherwise("")


def cap_note(cap: Column) -> tuple[Column, Column]:
    """The size of a company and what it is called."""
    note = F.when(cap >= 200e9, "giant").when(cap >= 10e9, "large").when(cap >= 2e9, "middle-sized").otherwise("small")
    money = F.when(cap >= 1e12, F.format_string("$%.2fT, ", cap / 1e12)).when(cap >= 10e9, F.format_string("$%.0fB, ", cap / 1e9))
    return money.when(cap >= 2e9, F.format_string("$%.1fB, ", cap / 1e9)).otherwise(F.format_string("$%.0fM, ", cap / 1e6)), note


def facts_sheet(f: dict[str, Column]) -> Column:
    """Array of (label, value, note) of what is known, from sector, industry, market_cap, trailing_pe,
    dividend_yield, last, year_high, year_low, atr_pct, dollar_vol and beta."""
    row = lambda ok, label, value, note: F.when(ok, F.struct(F.lit(label).alias("label"), value.alias("value"), note.alias("note")))
    value, size = cap_note(f["market_cap"])
    pe, last, high, low = f["trailing_pe"], f["last"], f["year_high"], f["year_low"]
    spot = (last - low) / (high - low) * 100
    place = F.when(spot > 85, "near the high").when(spot < 15, "near the low").otherwise(F.format_string("%.0f%% below the high", F.abs(last / high - 1) * 100))
    cost = F.when(pe > 60, "very dear").when(pe > 30, "dear").when(pe > 15, "about the average").otherwise("cheap")
    rows = [
        row(f["sector"].isNotNull(), "Business", F.coalesce(f["industry"], f["sector"]), f["sector"]),
        row(f["market_cap"] > 0, "Size", F.concat(value, size), size),
        row(pe > 0, "Price to earnings", F.format_string("%.0f", pe), cost),
        row(f["dividend_yield"] > 0, "Dividend", F.format_string("%.1f%% a year", f["dividend_yield"]), F.lit("paid for holding")),
        row(high > low, "Year's range", F.format_string("$%.2f to $%.2f", low, high), place),
        row(finite(f["atr_pct"]).isNotNull(), "Usual day", F.format_string("%.1f%% ($%.2f)", f["atr_pct"], last * f["atr_pct"] / 100), F.lit("average true range")),
        row(f["dollar_vol"] > 0, "Traded a day", F.format_string("$%.0f", f["dollar_vol"]), F.when(f["dollar_vol"] > 50e6, "plenty").otherwise("thin")),
        row(finite(f["beta"]).isNotNull(), "Beta", F.format_string("%.2f", f["beta"]), beta(f["beta"])["label"]),
    ]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def robustness(n_paths: int, x: dict[str, Column]) -> Column:
    """N20 from p05, p50, p95, prob_loss and prob_beat."""
    head = F.format_string(f"Of {n_paths} reorderings the middle one ends at $%.2f, nine in ten between $%.2f and $%.2f; %.0f%% lose.", x["p50"], x["p05"], x["p95"], x["prob_loss"] * 100)
    pb = x["prob_beat"] * 100
    how = F.when(pb >= 65, "robust").when(pb >= 50, "a little better than chance").otherwise("fragile")
    return F.concat(head, F.when(x["prob_beat"].isNotNull(), F.concat(F.format_string(" %.0f%% beat the benchmark: ", pb), how, F.lit("."))).otherwise(""))


def cvar(x: Column) -> Column:
    """N21"""
    steps = [("<", 3.0, "great", "Contained"), ("<", 5.0, "good", "Moderate"), ("<", 8.0, "weak", "High")]
    return ladder(x * 100, steps, ("bad", "Extreme"), "%.1f%% lost on an average bad day")


def calmar(x: Column) -> Column:
    """N21"""
    steps = [(">=", 1.0, "great", "Good"), (">=", 0.5, "good", "Fair"), (">=", 0.0, "weak", "Weak")]
    return ladder(x, steps, ("bad", "Losing"), "%.2f of yearly return for each unit of drawdown")


def downside_beta(x: Column) -> Column:
    """N21"""
    steps = [("<", 0.8, "good", "Defensive"), ("<=", 1.15, "ok", "Market-like")]
    return ladder(x, steps, ("bad", "Falls harder"), "%.2f on days when the market falls")


def factor_summary(betas: dict[str, Column], r2: Column) -> Column:
    """The market's part and the two strongest tilts of 0.05 or more."""
    tilts = F.array_sort(F.filter(F.array(*[F.struct((-F.abs(b)).alias("k"), F.lit(f).alias("f"), b.alias("b")) for f, b in betas.items() if f != "market"]), lambda t: t.b.isNotNull()))
    strong = F.filter(F.slice(tilts, 1, 2), lambda t: F.abs(t.b) >= 0.05)
    told = F.transform(strong, lambda t: F.concat(F.when(t.b > 0, "towards ").otherwise("away from "), t.f))
    market = F.format_string("%.2f of the market", betas["market"]) if "market" in betas else F.lit(None).cast("string")
    text = F.concat_ws(", ", F.array_compact(F.concat(F.array(market), told)))
    return F.concat(F.when(text == "", "no strong tilts").otherwise(text), F.when(finite(r2).isNotNull(), F.format_string("; %.0f%% explained", r2 * 100)).otherwise(""))


def sector_summary(top: Column, share: Column, n: Column) -> Column:
    """N22"""
    spread = F.when((n == 1) | (share > 0.6), " A heavy bet on one sector.").when(n >= 4, F.format_string(" Spread over %d sectors.", n.cast("int"))).otherwise("")
    return F.when(top.isNull(), "No sectors known.").otherwise(F.concat(F.format_string("Most is in %s (%.0f%%).", top, share * 100), spread))


#: What the anchored profile of the optimiser is.
ANCHORED = "Starts from the returns that equal market weights imply and moves towards the expected ones."

#: What a measure means.
METRICS = {
    "sharpe": "return for each unit of risk", "sortino": "return for each unit of downside risk", "down_beta": "beta on days when the market falls", "calmar": "yearly return over the worst fall",
    "cvar_95": "average loss on the worst days, 1 in 20", "cf_var_95": "value at risk with skew and fat tails", "omega": "gains over losses", "r2": "share of moves that factors explain",
    "beta": "share of market moves passed on", "alpha": "yearly return beyond the market's part", "max_drawdown": "worst fall from a peak", "var_95": "loss on the worst days, 1 in 20, at least",
    "volatility": "swings in a year", "win_rate": "share of trades that won", "profit_factor": "money won for each 1 lost", "cagr": "yearly growth rate", "edge": "rank from 0 to 100 among the watchlist",
    "rsi2": "two-day strength index", "atr": "average true range",
}
