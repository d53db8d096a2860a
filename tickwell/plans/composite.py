"""Composite queries: the tables behind each page of the inventory's API (Q1 to Q15, U1 to U5) and the readings of N,
put together from the operators. Each has its SQL unless it holds a step that SQL can't express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import interpret as say
from ..functions import series
from ..operators import backtest, montecarlo, optimize, portfolio, risk, signals
from ..sources import bars as src
from .market import _MU, _SCORED, _SUMMARY, _UP, _DOWN, PROXIES, RETS, _complete, _frame, _grid, _mu, _rets
from .registry import ORACLES, QUERIES, query, r6, rounded, with_bars

__all__ = ["ORACLES", "QUERIES"]

c = F.col
LAST = ", l AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS d FROM {0})"
#: The ticker that pages for a single one show.
ONE = "PROMO"


def _last(frame: DataFrame) -> DataFrame:
    return frame.withColumn("d", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("d = 1").drop("d")


def _case(x: str, steps: list[tuple[str, str]], last: str) -> str:
    """CASE of conditions on x and results; unknown is ok."""
    return f"CASE WHEN {x} IS NULL THEN 'ok' " + " ".join(f"WHEN {x} {cond} THEN '{out}'" for cond, out in steps) + f" ELSE '{last}' END"


# ---------------------------------------------------------------- sources, panels, parameters

#: Which ticker a quote stream of the fixture belongs to.
STREAMS = {"purchase": "PROMO", "error": "ECONOMY", "view": "LARGE", "click": "SMALL", "signup": "NOBODY"}
_STREAM_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in STREAMS.items()) + ") s(event_type, ticker)"


@query(
    "p3_live_prices",
    with_bars(
        f""", q AS (SELECT ticker, arg_max(value, (ts, event_id)) AS last, max(ts) AS quoted FROM events JOIN {_STREAM_SQL} USING (event_type) WHERE value IS NOT NULL GROUP BY 1),
        b AS (SELECT ticker, max(date) AS date, arg_max(close, date) AS close FROM bars GROUP BY 1)
        SELECT ticker, round(coalesce(last, close), 6) + 0 AS price, greatest(date, coalesce(CAST(quoted AS DATE), date)) AS as_of FROM b LEFT JOIN q USING (ticker)""",
        "p_type",
    ),
)
def p3_live(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes joined by ticker; a ticker without a quote keeps its last close and date."""
    names = spark.createDataFrame(list(STREAMS.items()), "event_type string, ticker string")
    stream = spark.read.parquet(f"{sf}/events.parquet").join(F.broadcast(names), "event_type")
    quotes = src.latest_quotes(stream, "ticker").withColumnRenamed("as_of", "quoted")
    last = src.bars(spark, sf, "p_type").groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
    as_of = F.greatest("date", F.coalesce(c("quoted").cast("date"), c("date")))
    return rounded(last.join(quotes, "ticker", "left").select("ticker", F.coalesce("last", "close").alias("price"), as_of.alias("as_of")))


_WATCH = ["SMALL", "NOBODY", "PROMO", "LARGE"]
_WATCH_SQL = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(_WATCH)) + ") w(ticker, pos)"


def _watchlist(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i) for i, t in enumerate(_WATCH)], "ticker string, pos int")


@query("p1_watch_only", with_bars(f" SELECT ticker, CAST(pos AS INT) AS pos, date, round(close, 6) + 0 AS close FROM bars JOIN {_WATCH_SQL} USING (ticker)", "p_type"))
def p1(spark, sf):
    """The panel's rows of the watchlist, with its order."""
    return rounded(src.bars(spark, sf, "p_type").join(F.broadcast(_watchlist(spark)), "ticker").select("ticker", "pos", "date", "close"))


@query("p2_panel", with_bars(f" SELECT ticker, date, round(close, 6) + 0 AS close FROM bars WHERE ticker IN (SELECT ticker FROM {_WATCH_SQL} UNION SELECT 'MKT')", "p_type"))
def p2(spark, sf):
    """The watchlist and the indices."""
    wanted = _watchlist(spark).select("ticker").union(spark.createDataFrame([(src.BENCHMARK,)], "ticker string")).distinct()
    return rounded(src.bars(spark, sf, "p_type").join(F.broadcast(wanted), "ticker", "left_semi").select("ticker", "date", "close"))


#: Parameter -> lowest and highest value.
CLAMPS = {"z": (1.5, 5.0), "horizon": (5.0, 126.0), "paths": (200.0, 10_000.0), "dip": (0.5, 30.0), "target": (0.5, 30.0), "stop": (0.5, 30.0)}


def clamped(name: str, value: float) -> float:
    """P8"""
    low, high = CLAMPS[name]
    return max(low, min(value, high))


@query(
    "p8_clamps",
    "SELECT name, asked, greatest(low, least(asked, high)) AS used FROM (VALUES "
    + ", ".join(f"('{n}', {a}e0, {b}e0)" for n, (a, b) in CLAMPS.items())
    + ") t(name, low, high), (SELECT DISTINCT CAST(l_quantity AS DOUBLE) AS asked FROM lineitem)",
)
def p8(spark, sf):
    asked = spark.read.parquet(f"{sf}/lineitem.parquet").select(c("l_quantity").cast("double").alias("asked")).distinct()
    bounds = spark.createDataFrame([(n, *b) for n, b in CLAMPS.items()], "name string, low double, high double")
    return asked.join(F.broadcast(bounds)).select("name", "asked", F.greatest("low", F.least("asked", "high")).alias("used"))


def profiles(part: DataFrame) -> DataFrame:
    """Profile facts; a dividend yield below 0.2 is a fraction and becomes a percentage."""
    dy = c("p_size") / 100.0
    return part.select(
        c("p_name").alias("name"), c("p_brand").alias("sector"), c("p_type").alias("industry"), (c("p_retailprice") * 1e7).alias("market_cap"), (c("p_size") * 1.5).alias("trailing_pe"),
        (c("p_size") * 1.25).alias("forward_pe"), F.when(dy < 0.2, dy * 100).otherwise(dy).alias("dividend_yield"), (c("p_retailprice") / 1000).alias("beta"), (c("p_partkey") * 100.0).alias("avg_volume"),
    )


@query(
    "s4_ticker_profile",
    """SELECT p_name AS name, p_brand AS sector, p_type AS industry, round(p_retailprice * 1e7, 6) + 0 AS market_cap, round(p_size * 1.5e0, 6) + 0 AS trailing_pe, round(p_size * 1.25e0, 6) + 0 AS forward_pe,
    round(CASE WHEN p_size / 1e2 < 2e-1 THEN p_size / 1e2 * 100 ELSE p_size / 1e2 END, 6) + 0 AS dividend_yield, round(p_retailprice / 1e3, 6) + 0 AS beta, round(p_partkey * 1e2, 6) + 0 AS avg_volume FROM part""",
)
def s4(spark, sf):
    return rounded(profiles(spark.read.parquet(f"{sf}/part.parquet")))


def search_symbols(symbols: DataFrame, text: str, kinds: tuple = ("EQUITY", "ETF", "INDEX", "CRYPTOCURRENCY"), most: int = 8) -> DataFrame:
    """The first `most` symbols of the wanted kinds whose symbol or name holds the text."""
    q = text.strip().lower()
    hit = F.contains(F.lower("symbol"), F.lit(q)) | F.contains(F.lower("name"), F.lit(q))
    return symbols.filter(c("kind").isin(*kinds) & hit).orderBy("symbol").limit(most)


# shapes of news: flat with epoch seconds or a time, nested, and rows that tell nothing
_NEWS_JSON = """CASE o_orderkey % 8
  WHEN 0 THEN concat('{"title": "Order ', CAST(o_orderkey AS VARCHAR(20)), '", "providerPublishTime": ', CAST(1000000000 + o_orderkey * 3600 AS VARCHAR(20)), ', "publisher": "Desk", "link": "l', CAST(o_orderkey AS VARCHAR(20)), '"}')
  WHEN 1 THEN concat('{"content": {"title": "Order ', CAST(o_orderkey AS VARCHAR(20)), '", "pubDate": "', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T10:30:00Z", "provider": {"displayName": "Wire"}, "canonicalUrl": {"url": "u', CAST(o_orderkey AS VARCHAR(20)), '"}}, "link": "not this"}')
  WHEN 2 THEN concat('{"title": "Flat ', CAST(o_orderkey AS VARCHAR(20)), '", "pubDate": "', substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10), 'T00:00:00Z"}')
  WHEN 3 THEN '{"title": "no time"}' WHEN 4 THEN '{"content": {"pubDate": "2001-01-01T00:00:00Z"}, "title": "outside"}' WHEN 5 THEN '{"title": "cut off' WHEN 6 THEN '{"title": "bad time", "pubDate": "yesterday"}' ELSE NULL END"""


@query(
    "s7_news_json",
    f"""WITH r AS (SELECT o_orderkey, {_NEWS_JSON} AS json FROM orders), v AS (SELECT o_orderkey, CASE WHEN json_valid(json) THEN CAST(json AS JSON) END AS j FROM r),
    c AS (SELECT o_orderkey, j, coalesce(json_extract(j, '$.content'), j) AS c FROM v WHERE j IS NOT NULL),
    p AS (SELECT o_orderkey, json_extract_string(c, '$.title') AS title, coalesce(try_strptime(json_extract_string(c, '$.pubDate'), '%Y-%m-%dT%H:%M:%SZ'), make_timestamp(CAST(json_extract_string(j, '$.providerPublishTime') AS BIGINT) * 1000000)) AS "when",
      coalesce(json_extract_string(c, '$.provider.displayName'), json_extract_string(j, '$.publisher'), '') AS publisher, coalesce(json_extract_string(c, '$.canonicalUrl.url'), json_extract_string(j, '$.link')) AS url FROM c)
    SELECT o_orderkey, title, CAST("when" AS DATE) AS day, epoch("when") AS seconds, publisher, url FROM p WHERE title IS NOT NULL AND "when" IS NOT NULL""",
)
def s7_json(spark, sf):
    """Headlines from JSON text of both shapes; malformed rows and rows without title or time go."""
    raw = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.expr(_NEWS_JSON).alias("json"))
    return src.news_items(raw).select("o_orderkey", "title", c("when").cast("date").alias("day"), F.unix_timestamp("when").cast("double").alias("seconds"), "publisher", "url")


@query(
    "s8_symbol_search",
    """SELECT 'P' || p_partkey AS symbol, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'EQUITY' WHEN 1 THEN 'ETF' ELSE 'FUTURE' END AS kind FROM part
    WHERE p_size % 3 < 2 AND (contains(lower('P' || p_partkey), 'red') OR contains(lower(p_name), 'red')) ORDER BY symbol LIMIT 8""",
)
def s8(spark, sf):
    kind = F.when(c("p_size") % 3 == 0, "EQUITY").when(c("p_size") % 3 == 1, "ETF").otherwise("FUTURE")
    return search_symbols(spark.read.parquet(f"{sf}/part.parquet").select(F.concat(F.lit("P"), c("p_partkey").cast("string")).alias("symbol"), c("p_name").alias("name"), kind.alias("kind")), " Red")


@query(
    "s9_group_of",
    f"""SELECT ticker, CAST(pos AS INT) AS pos, coalesce((SELECT min(p_type) FROM part WHERE p_brand = ticker), 'My additions') AS "group" FROM
    (SELECT DISTINCT p_brand AS ticker, 0 AS pos FROM part UNION ALL SELECT ticker, pos FROM {_WATCH_SQL})""",
)
def s9(spark, sf):
    """The first group of a ticker in the universe; others are the user's own additions."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    universe = part.select(c("p_brand").alias("ticker"), c("p_type").alias("group"), c("p_type").alias("pos")).distinct()
    tickers = part.select(c("p_brand").alias("ticker"), F.lit(0).alias("pos")).distinct().union(_watchlist(spark))
    return portfolio.group_of(tickers, universe).select("ticker", "pos", "group")


# ---------------------------------------------------------------- readings

_LEVELS = {
    "sharpe": ("sharpe", [(">= 1.5", "great"), (">= 1", "good"), (">= 0.5", "ok"), (">= 0", "weak")], "bad", say.sharpe),
    "beta": ("beta", [("< 0.5", "good"), ("<= 1.2", "ok"), ("<= 2", "weak")], "bad", say.beta),
    "alpha": ("alpha", [("* 100 >= 10", "great"), ("* 100 >= 2", "good"), ("* 100 >= -2", "ok")], "bad", say.alpha),
    "drawdown": ("max_dd", [(">= -0.1", "great"), (">= -0.2", "good"), (">= -0.35", "weak")], "bad", say.drawdown),
    "cvar": ("cvar", [("< 0.03", "great"), ("< 0.05", "good"), ("< 0.08", "weak")], "bad", say.cvar),
    "calmar": ("calmar", [(">= 1", "great"), (">= 0.5", "good"), (">= 0", "weak")], "bad", say.calmar),
    "downside": ("downside_beta", [("< 0.8", "good"), ("<= 1.15", "ok")], "bad", say.downside_beta),
    "factor": ("omega", [(">= 2", "great"), (">= 1.3", "good"), (">= 1", "ok")], "bad", say.profit_factor),
}
_GRADE = (
    "CASE WHEN sharpe IS NULL THEN 0 WHEN sharpe >= 1.5 THEN 3 WHEN sharpe >= 1 THEN 2 WHEN sharpe >= 0.5 THEN 1 WHEN sharpe >= 0 THEN 0 ELSE -2 END"
    " + CASE WHEN alpha IS NULL THEN 0 WHEN alpha >= 0.05 THEN 2 WHEN alpha > 0 THEN 1 ELSE -1 END"
    " + CASE WHEN max_dd IS NULL THEN 0 WHEN max_dd >= -0.15 THEN 1 WHEN max_dd >= -0.3 THEN 0 ELSE -1 END + CASE WHEN omega >= 1.3 THEN 1 ELSE 0 END"
)


@query(
    "n2_to_n8_levels",
    with_bars(
        _SUMMARY + f", pt AS (SELECT *, {_GRADE} AS points FROM rs) SELECT ticker, " + ", ".join(f"{_case(x, steps, last)} AS {k}" for k, (x, steps, last, _) in _LEVELS.items())
        + ", CASE WHEN points < 0 THEN 'F' ELSE ['D-', 'D', 'C', 'C+', 'B', 'B+', 'A', 'A+'][points + 1] END AS grade FROM pt"
    ),
)
def n_levels(spark, sf):
    """Levels of the risk table (omega stands in for the profit factor)."""
    t = risk.summary(_rets(spark, sf))
    return t.select("ticker", *[f(c(x))["level"].alias(k) for k, (x, _, _, f) in _LEVELS.items()], say.grade(c("sharpe"), c("alpha"), c("max_dd"), c("omega")).alias("grade"))


_READ = {
    "rsi": _case("rsi14", [(">= 80", "bad"), (">= 70", "weak"), ("<= 30", "good")], "ok"),
    "band": _case("pctb", [("> 1", "bad"), ("> 0.85", "weak"), ("< 0", "weak"), ("< 0.2", "good")], "ok"),
    "vol": _case("rvol", [(">= 2", "good")], "ok"),
    "macd": "CASE WHEN macd_hist IS NULL THEN 'ok' WHEN macd_hist > 0 THEN CASE WHEN macd_hist > before THEN 'good' ELSE 'ok' END WHEN macd_hist > before THEN 'ok' ELSE 'weak' END",
}


@query("n17_readouts", with_bars(", h AS (SELECT *, lag(macd_hist) OVER (PARTITION BY ticker ORDER BY date) AS before FROM rec) SELECT ticker, date, " + ", ".join(f"{v} AS {k}" for k, v in _READ.items()) + " FROM h", "p_type", rec=True, own=True))
def n17(spark, sf):
    """N17 on every bar of every ticker."""
    f = _frame(spark, sf, own=True).withColumn("before", F.lag("macd_hist").over(Window.partitionBy("ticker").orderBy("date")))
    read = {"rsi": say.rsi(c("rsi14")), "band": say.percent_b(c("pctb")), "vol": say.volume(c("rvol")), "macd": say.macd(c("macd_hist"), c("before"))}
    return f.select("ticker", "date", *[v["level"].alias(k) for k, v in read.items()])


@query(
    "n13_odds",
    """WITH d AS (SELECT DISTINCT CAST(p_partkey AS DOUBLE) * p_size AS days FROM part WHERE p_partkey > 0 AND p_size > 0), p AS (SELECT 1 / days AS pvalue, 1e0 / (1 / days) AS n FROM d)
    SELECT pvalue, CASE WHEN n < 40 THEN 'about one trading day in ' || CAST(round_even(n, 0) AS BIGINT) WHEN n / 252 < 1.5 THEN 'about once a year, one trading day in ' || CAST(round_even(n, 0) AS BIGINT)
    WHEN n / 252 < 1000 THEN 'about once in ' || CAST(round_even(n / 252, 0) AS BIGINT) || ' years' ELSE 'less than once in 1000 years' END AS odds FROM p""",
)
def n13(spark, sf):
    days = spark.read.parquet(f"{sf}/part.parquet").filter("p_partkey > 0 AND p_size > 0").select((c("p_partkey").cast("double") * c("p_size")).alias("days")).distinct()
    return days.select((1.0 / c("days")).alias("pvalue")).select("pvalue", say.odds(c("pvalue")).alias("odds"))


_LOW, _HIGH = "(coalesce(rsi14 < 35, false) OR coalesce(pctb < 0.15, false) OR coalesce(off_high < -0.07, false))", "(coalesce(rsi14 > 70, false) OR coalesce(pctb > 0.9, false))"


@query(
    "n15_entry",
    with_bars(
        f""" SELECT ticker, date, CASE WHEN {_LOW} AND close > ema50_run THEN 'good' WHEN {_LOW} OR {_HIGH} THEN 'weak' ELSE 'ok' END AS level,
        CASE WHEN {_LOW} AND close > ema50_run THEN 'Buy zone' WHEN {_LOW} THEN 'Falling knife' WHEN {_HIGH} THEN 'Chasing' ELSE 'No rush' END AS label FROM rec""",
        "p_type", rec=True, own=True,
    ),
)
def n15(spark, sf):
    v = say.entry(c("rsi14"), c("pctb"), c("off_high"), c("close") > c("ema50_run"), F.lit(None).cast("int"))
    return _frame(spark, sf, own=True).select("ticker", "date", v["level"].alias("level"), v["label"].alias("label"))


#: Metrics of the risk table and the names they are explained under.
_EXPLAINED = {"sharpe": "sharpe", "sortino": "sortino", "downside_beta": "down_beta", "calmar": "calmar", "cvar": "cvar_95", "cf_var": "cf_var_95", "omega": "omega", "beta": "beta", "alpha": "alpha", "max_dd": "max_drawdown", "var95": "var_95", "vol": "volatility"}
_MEANINGS = ", ".join("('{}', '{}')".format(m, say.METRICS[m].replace("'", "''")) for m in _EXPLAINED.values())


@query(
    "n23_metric_info",
    with_bars(
        _SUMMARY + ", mt AS (" + " UNION ALL ".join(f"SELECT ticker, '{m}' AS metric, {x} AS value FROM rs" for x, m in _EXPLAINED.items())
        + f") SELECT ticker, metric, meaning, {r6('value')} FROM mt JOIN (VALUES {_MEANINGS}) t(metric, meaning) USING (metric)"
    ),
)
def n23(spark, sf):
    """Every figure of the risk table with what it means."""
    told = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(say.METRICS[m]).alias("meaning"), c(x).alias("value")) for x, m in _EXPLAINED.items()])
    return rounded(risk.summary(_rets(spark, sf)).select("ticker", F.inline(told)))


# ---------------------------------------------------------------- market, ideas, chart


def _market(spark: SparkSession, sf: str) -> DataFrame:
    """Q1's table: the panel's last session with changes, readings and score. The last price is the last one known; a
    ticker that is not scored (no bar on the last session, or too few) has its price and one-session change only."""
    frame = _frame(spark, sf, "p_brand").withColumn("prev", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
    scores = signals.edge_scores(signals.features(frame)).select("ticker", "edge", "roc5", "roc20", "rsi14", "rvol")
    known = frame.groupBy("ticker").agg(F.max_by("close", F.when(c("close").isNotNull(), c("date"))).alias("last"))
    now = _last(frame).select("ticker", "prev", c("dollar_volume").alias("dollar_vol")).join(known, "ticker").join(scores, "ticker", "left")
    return now.select("ticker", "last", ((c("last") / c("prev") - 1) * 100).alias("chg1"), c("roc5").alias("chg5"), c("roc20").alias("chg20"), "rsi14", "rvol", "edge", "dollar_vol")


_MARKET = _SCORED + (
    ", pv AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM rec), kn AS (SELECT ticker, arg_max(close, date) AS last FROM bars GROUP BY 1), "
    "m AS (SELECT l.ticker, kn.last, (kn.last / pv.prev - 1) * 100 AS chg1, sc.roc5 AS chg5, sc.roc20 AS chg20, sc.rsi14, sc.rvol, sc.edge, l.dollar_volume AS dollar_vol "
    "FROM l JOIN kn USING (ticker) JOIN pv ON pv.ticker = l.ticker AND pv.date = l.date LEFT JOIN sc ON sc.ticker = l.ticker WHERE l.d = 1)"
)
_MARKET_COLUMNS = ("last", "chg1", "chg5", "chg20", "rsi14", "rvol", "edge", "dollar_vol")


@query("q1_rows", with_bars(_MARKET + f" SELECT ticker, {r6(*_MARKET_COLUMNS)} FROM m", rec=True))
def q1_rows(spark, sf):
    return rounded(_market(spark, sf))


@query("u1_top_movers", with_bars(_MARKET + " SELECT ticker, round(chg1, 6) + 0 AS chg1 FROM m ORDER BY abs(chg1) DESC NULLS LAST, ticker LIMIT 4", rec=True))
def u1(spark, sf):
    return rounded(_market(spark, sf).orderBy(F.abs("chg1").desc_nulls_last(), "ticker").limit(4).select("ticker", "chg1"))


@query("u2_breadth", with_bars(_MARKET + " SELECT round(avg(edge), 6) + 0 AS score, round(avg(CASE WHEN chg20 > 0 THEN 1e0 ELSE 0e0 END), 6) + 0 AS breadth, count(*) FILTER (edge >= 80) AS leaders FROM m", rec=True))
def u2(spark, sf):
    up = F.coalesce(c("chg20") > 0, F.lit(False)).cast("double")
    return rounded(_market(spark, sf).agg(F.avg("edge").alias("score"), F.avg(up).alias("breadth"), F.count(F.when(c("edge") >= 80, 1)).alias("leaders")))


def sorted_table(rows: DataFrame, column: str, descending: bool = True, most: int = 500) -> DataFrame:
    """The first `most` rows by a column, nulls last in both directions; ties by ticker."""
    order = c(column).desc_nulls_last() if descending else c(column).asc_nulls_last()
    return rows.orderBy(order, "ticker").limit(most)


@query("u3_sorted_table", with_bars(_MARKET + " SELECT ticker, round(rvol, 6) + 0 AS rvol, CAST(row_number() OVER (ORDER BY rvol ASC NULLS LAST, ticker) AS INT) AS place FROM m ORDER BY rvol ASC NULLS LAST, ticker LIMIT 500", rec=True))
def u3(spark, sf):
    place = F.row_number().over(Window.orderBy(c("rvol").asc_nulls_last(), "ticker"))
    return rounded(sorted_table(_market(spark, sf), "rvol", False).select("ticker", "rvol", place.alias("place")))


@query(
    "x5_idea_geometry",
    with_bars(
        _SCORED + """, sc5 AS (SELECT * FROM sc WHERE edge_raw IS NOT NULL ORDER BY edge_raw DESC, ticker LIMIT 5)
        SELECT ticker, round(edge, 6) + 0 AS edge, round(close, 6) + 0 AS entry, round(close - 1.5e0 * atr14, 6) + 0 AS stop, round(close + 3e0 * atr14, 6) + 0 AS target,
        round(150e0 * atr14 / close, 6) + 0 AS risk_pct, CASE WHEN momentum >= meanrev THEN '5-7' ELSE '2-4' END AS hold FROM sc5""",
        rec=True,
    ),
)
def x5_geometry(spark, sf):
    return rounded(signals.trade_ideas(signals.edge_scores(signals.features(_frame(spark, sf, "p_brand")))).drop("weight", "dollars"))


@query("q2_ideas")
def q2(spark, sf):
    """Q2: trade ideas priced anew at the live quote, with reason and the last 30 closes."""
    frame = _frame(spark, sf)
    scored = signals.edge_scores(signals.features(frame))
    ideas = signals.trade_ideas(scored).select("ticker", "edge", c("entry").alias("close"), (c("entry") - c("stop")).alias("risk"), "hold", "weight", "dollars")
    told = scored.select("ticker", say.reason(c("momentum"), c("trend"), c("meanrev"), c("volume_score"), c("roc20"), c("rsi2"), c("rvol")).alias("reason"))
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    spark30 = frame.withColumn("r", rank).filter("r <= 30").groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("spark"))
    live = p3_live(spark, sf).select("ticker", "price")
    entry = F.coalesce("price", "close")
    out = ideas.join(told, "ticker").join(spark30, "ticker").join(live, "ticker", "left")
    return rounded(out.select("ticker", "edge", entry.alias("entry"), (entry - c("risk")).alias("stop"), (entry + 2 * c("risk")).alias("target"), (100 * c("risk") / entry).alias("risk_pct"), "hold", "weight", "dollars", "reason", F.to_json("spark").alias("spark")))


_CHART = ("open", "high", "low", "close", "volume", "ema20_run", "ema50_run", "bb_up", "bb_low", "bb_mid", "rsi14", "macd", "macd_signal", "macd_hist", "volume_ma20", "rvol_lagged")


@query("q3_chart", with_bars(f" SELECT date, {r6(*_CHART)} FROM rec WHERE ticker = '{ONE}'", "p_type", rec=True, own=True))
def q3(spark, sf):
    """Q3: candles and indicator lines of one ticker on its own bars; the filter on the ticker reaches the bars."""
    return rounded(_frame(spark, sf, own=True).filter(c("ticker") == ONE).select("date", *_CHART))


@query("q3_readouts", with_bars(", h AS (SELECT *, lag(macd_hist) OVER (PARTITION BY ticker ORDER BY date) AS before, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS d FROM rec) SELECT ticker, date, " + ", ".join(f"{v.replace('rvol', 'rvol_lagged')} AS {k}" for k, v in _READ.items()) + " FROM h WHERE d = 1", rec=True, own=True))
def q3_readouts(spark, sf):
    """Q3: the four readings of every ticker's last bar; volume is held against the days before it."""
    f = _frame(spark, sf, "p_brand", own=True).withColumn("before", F.lag("macd_hist").over(Window.partitionBy("ticker").orderBy("date")))
    read = {"rsi": say.rsi(c("rsi14")), "band": say.percent_b(c("pctb")), "vol": say.volume(c("rvol_lagged")), "macd": say.macd(c("macd_hist"), c("before"))}
    return _last(f).select("ticker", "date", *[v["level"].alias(k) for k, v in read.items()])


@query(
    "q3_metrics",
    with_bars(
        _SUMMARY.replace("WHERE n >= 60", "WHERE n >= 20") + f""", tp AS (SELECT ticker, arg_max(close, date) / arg_min(close, date) * 100 - 100 AS total_period FROM bars GROUP BY 1)
        SELECT ticker, {r6("beta", "alpha", "sharpe", "vol", "var95", "max_dd", "total_period")} FROM rs JOIN tp USING (ticker)"""
    ),
)
def q3_metrics(spark, sf):
    """The chart page's measures of every ticker with 20 returns."""
    total = src.bars(spark, sf).groupBy("ticker").agg((F.max_by("close", "date") / F.min_by("close", "date") * 100 - 100).alias("total_period"))
    return rounded(risk.summary(_rets(spark, sf), 20).join(total, "ticker").select("ticker", "beta", "alpha", "sharpe", "vol", "var95", "max_dd", "total_period"))


# ---------------------------------------------------------------- facts, forecast


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and returns of each ticker's own bars; ATR and traded money at the panel's last session."""
    bars = src.bars(spark, sf, "p_type")
    span = bars.groupBy("ticker").agg(F.max("close").alias("year_high"), F.min("close").alias("year_low"), F.max_by("close", "date").alias("last"))
    rets = risk.with_benchmark(src.returns(bars, "none")).select("ticker", "date", F.round("ret", 12).alias("ret"), F.round("bench", 12).alias("bench"))
    beta = risk.summary(rets, 20).select("ticker", "beta")
    now = _last(_frame(spark, sf)).select("ticker", "atr14", c("dollar_volume").alias("dollar_vol"))
    return now.join(span, "ticker").join(beta, "ticker", "left").withColumn("atr_pct", c("atr14") / c("last") * 100).drop("atr14")


@query(
    "q6_facts",
    with_bars(
        LAST.format("rec") + """, sp AS (SELECT ticker, max(close) AS year_high, min(close) AS year_low, arg_max(close, date) AS last FROM bars GROUP BY 1), rt AS (SELECT ticker, date, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM bars),
        be AS (SELECT a.ticker, covar_samp(round(a.ret, 12), round(b.ret, 12)) / var_samp(round(b.ret, 12)) AS beta FROM rt a JOIN rt b ON b.ticker = 'MKT' AND a.date = b.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
        fx AS (SELECT ticker, last, atr14 / last * 100 AS atr_pct, dollar_volume AS dollar_vol, year_high, year_low, beta FROM l JOIN sp USING (ticker) LEFT JOIN be USING (ticker) WHERE d = 1) """
        + f"SELECT ticker, {r6('last', 'atr_pct', 'dollar_vol', 'year_high', 'year_low', 'beta')} FROM fx",
        "p_type", rec=True,
    ),
)
def q6(spark, sf):
    return rounded(_facts(spark, sf))


@query("q6_facts_sheet")
def q6_sheet(spark, sf):
    """The sheet's rows as text; profiles are those of the first part of each type."""
    p = profiles(spark.read.parquet(f"{sf}/part.parquet")).groupBy("industry").agg(F.min_by(F.struct("sector", "market_cap", "trailing_pe", "dividend_yield"), "name").alias("p"))
    f = _facts(spark, sf).join(p, c("ticker") == c("industry"), "left").select("*", "p.*")
    names = ("sector", "industry", "market_cap", "trailing_pe", "dividend_yield", "last", "year_high", "year_low", "atr_pct", "dollar_vol", "beta")
    return f.select("ticker", F.explode(say.facts_sheet({n: c(n) for n in names})).alias("r")).select("ticker", "r.label", "r.value", "r.note")


@query(
    "m11_busday_count",
    """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, day + 40 AS until,
    (SELECT count(*) FROM range(40) r(k) WHERE isodow(day + CAST(k AS INTEGER)) <= 5) AS sessions FROM d""",
)
def m11(spark, sf):
    days = spark.read.parquet(f"{sf}/orders.parquet").select(c("o_orderdate").cast("date").alias("day")).distinct().withColumn("until", F.date_add("day", 40))
    return days.select("day", "until", montecarlo.busday_count(c("day"), c("until")).cast("long").alias("sessions"))


def forecast(spark: SparkSession, frame: DataFrame, earnings: DataFrame, ticker: str, horizon: int = 21, n_paths: int = 2000, dip: float = 5.0, target: float = 10.0, stop: float = 7.0, mode: str = "current") -> DataFrame:
    """Q5: one row with odds, best entry, dip strategy, limit order, timing and narrative for a ticker of the frame."""
    horizon, n_paths = int(clamped("horizon", horizon)), int(clamped("paths", n_paths))
    d, t, s = (clamped(k, v) / 100 for k, v in (("dip", dip), ("target", target), ("stop", stop)))
    own = frame.filter(c("ticker") == ticker).persist()  # one ticker's history
    now = _last(own).select("date", "close", "rsi14", "pctb", "off_high", "ema50_run").first()
    if now is None:
        own.unpersist()
        raise ValueError(f"no data for {ticker}")
    p = montecarlo.paths(spark, montecarlo.pool(own, mode), horizon, n_paths, 5, montecarlo.seed_of(ticker, str(now["date"]))).persist()
    parts = [montecarlo.summarize(p, horizon), montecarlo.best_entry(p), montecarlo.dip_buy(p, d, t, s), montecarlo.limit_order(p, now["close"]).select("limit_price", "fill_prob")]
    row = parts[0]
    for x in parts[1:]:
        row = row.join(F.broadcast(x))
    upcoming = earnings.filter((c("ticker") == ticker) & (c("date") > now["date"])).agg(F.min("date").alias("next_earnings"))
    row = row.join(F.broadcast(upcoming)).withColumn("earnings_in", montecarlo.busday_count(F.lit(now["date"]), c("next_earnings")))
    soon = F.when(c("earnings_in") <= horizon, c("earnings_in"))
    lit = lambda k: F.lit(now[k]).cast("double")
    above = F.lit(now["close"] > now["ema50_run"]) if now["ema50_run"] is not None else F.lit(None).cast("boolean")
    timing = say.entry(lit("rsi14"), lit("pctb"), lit("off_high"), above, soon)
    names = ("prob_up", "p50", "p05", "median_day", "median_low", "fill_rate", "avg_overall", "now_avg")
    vols = own.agg((F.stddev_samp("ret") * 252**0.5).alias("hist_vol"), (F.max_by("sigma_adjusted", "date") * 252**0.5).alias("now_vol"))
    row = row.join(F.broadcast(vols))
    page = row.select(
        F.lit(ticker).alias("ticker"), F.lit(now["close"]).alias("last"), F.lit(horizon).alias("horizon"), F.lit(n_paths).alias("n_paths"), *[x for q in parts for x in q.columns], "next_earnings", "earnings_in",
        timing.alias("verdict"), say.forecast_narrative(F.lit(ticker), horizon, n_paths, {k: c(k) for k in names}, d * 100).alias("narrative"),
        say.vol_regime(c("now_vol") / c("hist_vol"), c("now_vol")).alias("vol_line"),
    )
    told = page.collect()  # one row
    own.unpersist()
    p.unpersist()
    return spark.createDataFrame(told, page.schema)


@query("q5_forecast")
def q5(spark, sf):
    """Q5 with M12, N15, N16 and N18; its parts m3 to m12 have SQL of their own."""
    return rounded(forecast(spark, _frame(spark, sf, own=True), src.catalysts(spark, sf, "earnings", "p_type"), ONE))


@query("q5_history", with_bars(" SELECT ticker, date, round(close, 6) + 0 AS close FROM bars WHERE close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60", "p_type"))
def q5_history(spark, sf):
    """The last 60 closes, which a forecast is drawn behind, of every ticker."""
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))
    return rounded(src.bars(spark, sf, "p_type").filter("close IS NOT NULL").withColumn("r", rank).filter("r <= 60").select("ticker", "date", "close"))


@query("q5_fan")
def q5_fan(spark, sf):
    """Q5: the fan of prices on the coming business days, with the chance of each dip, from returns at today's deviation."""
    own = _frame(spark, sf, own=True).filter(c("ticker") == ONE)
    now = _last(own).select("date", "close").first()  # one row
    p = montecarlo.paths(spark, montecarlo.pool(own, "current"), 21, 2000, 5, montecarlo.seed_of(ONE, str(now["date"])))
    days = F.concat(F.array(F.lit(now["date"])), montecarlo.business_days(F.lit(now["date"]), 21))
    fan = montecarlo.fan_bands(p, now["close"]).withColumn("date", F.get(days, c("day").cast("int")))
    dips = montecarlo.dip_probabilities(p, [0.02, 0.03, 0.05, 0.08, 0.10]).agg(F.sort_array(F.collect_list(F.struct("dip", "prob"))).alias("dips"))
    return rounded(fan.join(F.broadcast(dips)).select(c("day").cast("int").alias("day"), "date", "p05", "p25", "p50", "p75", "p95", F.to_json("dips").alias("dip_odds")))


# ---------------------------------------------------------------- backtests


def _oversold(data, ind):
    """UD2: the template."""
    entry = ind.each(lambda r, x, m: (r < 30) & (x > m), ind.rsi(data["close"], 14), data["close"], ind.ema(data["close"], 50))
    return entry, ind.each(lambda r: r > 60, ind.rsi(data["close"], 14))


def _average_cross(data, ind):
    fast, slow = ind.ema(data["close"], 10), ind.ema(data["close"], 30)
    return ind.crosses_above(fast, slow), ind.each(lambda a, b, p, q: (a < b) & (p >= q), fast, slow, ind.lag(fast), ind.lag(slow))


def _snapback(data, ind):
    entry = ind.each(lambda r, x, m: (r < -4) & (x > m), ind.roc(data["close"], 1), data["close"], ind.ema(data["close"], 50))
    return entry, ind.each(lambda r: r > 70, ind.rsi(data["close"], 2))


EXAMPLES = {"oversold_rsi": _oversold, "average_cross": _average_cross, "snapback": _snapback}
# the second average's span is not among the frame's: its recursion is put beside the frame
_AVERAGE30 = (
    ", y30 AS (SELECT ticker, i, close AS y FROM frame WHERE i = 1 UNION ALL SELECT g.ticker, g.i, CASE WHEN g.close IS NULL THEN y WHEN y IS NULL THEN g.close "
    "ELSE (power(1 - 2e0 / 31, g.gap) * y + 2e0 / 31 * g.close) / (power(1 - 2e0 / 31, g.gap) + 2e0 / 31) END FROM y30 JOIN frame g ON g.ticker = y30.ticker AND g.i = y30.i + 1), "
    "r30 AS (SELECT rec.*, CASE WHEN n_bars >= 30 THEN y END AS ema30 FROM rec JOIN y30 USING (ticker, i))"
)
_EXAMPLES = {
    "oversold_rsi": ("rsi14 < 30 AND close > ema50", "rsi14 > 60"), "average_cross": (_UP.format("ema10", "ema30"), _DOWN.format("ema10", "ema30")),
    "snapback": ("roc1 < -4 AND close > ema50", "rsi2 > 70"),
}
for _name, (_in, _out) in _EXAMPLES.items():
    query(f"ud2_{_name}", with_bars(f"{_AVERAGE30}, s AS (SELECT ticker, date, coalesce({_in}, false) AS entry, coalesce({_out}, false) AS exit FROM r30) SELECT * FROM s WHERE entry OR exit", rec=True))(
        lambda spark, sf, k=_name: signals.run_strategy(_grid(spark, sf), EXAMPLES[k], k).filter("entry OR exit")
    )

_SERIES = (
    "rsi2", "rsi14", "ema20", "ema50", "macd", "macd_signal", "macd_hist", "atr14", "roc5", "pctb", "adx", "rvol", "vwap", "stoch_k", "stoch_d", "obv", "keltner_up", "keltner_low", "atr_stop",
    "tenkan", "kijun", "senkou_a", "senkou_b",
)


@query("ud3_series_functions", with_bars(f" SELECT ticker, date, {r6(*_SERIES)} FROM rec", rec=True))
def ud3(spark, sf):
    """UD3: the 14 functions of series, with the parameters that the frame has too."""
    o, h, lo, x, v = (c(f) for f in series.FIELDS)  # noqa: F841
    line, smooth, hist = series.macd(x)
    k, d = series.stochastic(h, lo, x)
    _, up, low = series.keltner_channels(h, lo, x)
    tenkan, kijun, span_a, span_b = series.ichimoku(h, lo, x)
    told = series.rows(
        series.series(_grid(spark, sf)), rsi2=series.rsi(x, 2), rsi14=series.rsi(x), ema20=series.ema(x, 20), ema50=series.ema(x, 50), macd=line, macd_signal=smooth, macd_hist=hist, atr14=series.atr(h, lo, x),
        roc5=series.roc(x, 5), pctb=series.bollinger_percent_b(x), adx=series.adx(h, lo, x), rvol=series.relative_volume(v), vwap=series.vwap(h, lo, x, v), stoch_k=k, stoch_d=d, obv=series.obv(x, v),
        keltner_up=up, keltner_low=low, atr_stop=series.atr_trailing_stop(h, lo, x), tenkan=tenkan, kijun=kijun, senkou_a=span_a, senkou_b=span_b,
    )
    return rounded(told)


def backtest_report(equity: DataFrame, bench: DataFrame, trades: DataFrame | None = None, capital: float = 100.0) -> DataFrame:
    """One row for each run of equity(run_id, date, equity), against bench(date, close) over its own dates."""
    own = equity.join(bench, "date").withColumn("ticker", c("run_id"))
    w = Window.partitionBy("run_id").orderBy("date")
    rets = own.select("ticker", "date", (c("equity") / F.lag("equity").over(w) - 1).alias("ret"), (c("close") / F.lag("close").over(w) - 1).alias("bench")).filter("ret IS NOT NULL AND bench IS NOT NULL")
    against = risk.summary(rets, 20).select(c("ticker").alias("run_id"), "beta", "alpha")
    total = own.groupBy("run_id").agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("bench_total"))
    out = risk.perf_stats(equity).join(against, "run_id", "left").join(total, "run_id", "left")
    if trades is None:
        unknown = F.lit(None).cast("double")
        out = out.withColumns({"n_trades": F.lit(None).cast("long"), "win_rate": unknown, "profit_factor": unknown, "avg_pnl": unknown})
    else:
        out = out.join(risk.trade_stats(trades), "run_id", "left")
    text = say.backtest_summary(c("total"), capital, c("bench_total"), c("max_dd"), c("win_rate"))
    read = {"sharpe": say.sharpe(c("sharpe")), "alpha": say.alpha(c("alpha")), "beta": say.beta(c("beta")), "drawdown": say.drawdown(c("max_dd")), "profit_factor": say.profit_factor(c("profit_factor"))}
    out = out.withColumns({f"{k}_verdict": v["level"] for k, v in read.items()})
    return out.withColumn("grade", say.grade(c("sharpe"), c("alpha"), c("max_dd"), c("profit_factor"))).withColumn("narrative", text)


@query("q8_backtest")
def q8(spark, sf):
    """Q8: every signal strategy with trades and the momentum rotation, as rows of one report: one row for each run."""
    frame = _frame(spark, sf)
    bench = src.bars(spark, sf, "p_type").filter(c("ticker") == src.BENCHMARK).select("date", "close")
    rows = backtest.signal_trades(backtest.signal_runs(signals.strategy_signals(frame.filter(c("ticker") != src.BENCHMARK)), signals.STRATEGIES)).persist()
    runs = backtest_report(rows.filter("kind <> 'trade'").select("run_id", "date", "equity"), bench, rows.filter("kind = 'trade'").select("run_id", "pnl"))
    rotation = backtest.rebalance(_grid(spark, sf, "p_type").filter(c("ticker") != src.BENCHMARK)).select(F.lit("momentum").alias("run_id"), "date", "equity")
    report = rounded(runs.unionByName(backtest_report(rotation, bench)))
    told = report.collect()
    rows.unpersist()
    return spark.createDataFrame(told, report.schema)


@query("q8_robustness")
def q8_robustness(spark, sf):
    """1,000 reorderings of the rotation's own returns, if it has 40."""
    curve = backtest.rebalance(_grid(spark, sf, "p_type").filter(c("ticker") != src.BENCHMARK)).select("date", "ret")
    pool = montecarlo.pool(curve)
    n = pool.count()
    if n < 40:
        return spark.createDataFrame([], "p05 double, p25 double, p50 double, p75 double, p95 double, prob_loss double, dd_median double, dd_worst5 double, prob_beat double, narrative string")
    # the benchmark held over the same dates: one row
    held = src.bars(spark, sf, "p_type").filter(c("ticker") == src.BENCHMARK).join(curve.select("date"), "date", "left_semi")
    total = held.agg((F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total")).first()["total"]
    seed = montecarlo.seed_of("Momentum rotation:all", f"all:{n}")
    x = montecarlo.equity_confidence(montecarlo.paths(spark, pool, n, 1000, 5, seed), n, 100.0, total)
    return rounded(x.withColumn("narrative", say.robustness(1000, {k: c(k) for k in ("p05", "p50", "p95", "prob_loss", "prob_beat")})))


# ---------------------------------------------------------------- portfolios

_BLEND = RETS.replace(", rb AS (", ", rb0 AS (") + (
    ", wt AS (SELECT ticker, 1e0 / count(*) OVER () AS w FROM (SELECT DISTINCT ticker FROM rb0 WHERE ticker <> 'MKT')), "
    "rb AS (SELECT 'portfolio' AS ticker, date, coalesce(sum(ret * w), 0) AS ret, any_value(bench) AS bench FROM rb0 LEFT JOIN wt USING (ticker) GROUP BY date)"
)


def _equal(rets: DataFrame) -> DataFrame:
    return rets.filter(c("ticker") != src.BENCHMARK).select("ticker").distinct().withColumn("weight", F.lit(1.0))


_METRICS = ["beta", "downside_beta", "alpha", "sharpe", "sortino", "calmar", "omega", "vol", "var95", "cvar", "cf_var", "max_dd"]


@query("r11_portfolio_metrics", with_bars(_SUMMARY.replace(RETS, _BLEND) + f" SELECT n, {r6(*_METRICS)} FROM rs"))
def r11_metrics(spark, sf):
    rets = _rets(spark, sf)
    return rounded(risk.portfolio_metrics(rets, _equal(rets)).select("n", *_METRICS))


@query("f5_market_exposure", with_bars(_BLEND + " SELECT count(*) AS n, round(regr_intercept(ret, bench) * 252, 6) + 0 AS alpha, round(regr_slope(ret, bench), 6) + 0 AS beta_market, round(regr_r2(ret, bench), 6) + 0 AS r2 FROM rb"))
def f5_market(spark, sf):
    """F5 with the market as its one factor, which SQL can regress on."""
    rets = _rets(spark, sf)
    facs = rets.filter(c("ticker") == src.BENCHMARK).select("date", c("ret").alias("market"))
    return rounded(risk.portfolio_exposures(rets, _equal(rets), facs).select("n", "alpha", "beta_market", "r2"))


@query("q13_factors")
def q13(spark, sf):
    """Six-factor exposures of each ticker and of the equal mix, strongest market beta first."""
    facs = risk.factor_returns(_rets(spark, sf, "p_type"), PROXIES)
    rets, names = _rets(spark, sf), [n for n in facs.columns if n != "date"]
    each = risk.factor_exposures(rets.filter(c("ticker") != src.BENCHMARK).join(F.broadcast(facs), "date"), names)
    every = each.unionByName(risk.portfolio_exposures(rets, _equal(rets), facs))
    told = say.factor_summary({n: c(f"beta_{n}") for n in names}, c("r2"))
    return rounded(every.withColumn("summary", told).orderBy((c("ticker") == "portfolio").desc(), F.abs("beta_market").desc(), "ticker"))


@query("n22_sector_summary", with_bars(""", v AS (SELECT ticker, sum(volume) AS weight FROM bars GROUP BY 1), s AS (SELECT substr(ticker, 1, 7) AS sector, sum(weight) / sum(sum(weight)) OVER () AS share FROM v GROUP BY 1),
    t AS (SELECT arg_max(sector, (share, sector)) AS top, round_even(max(share), 4) AS share, count(*) AS n FROM s)
    SELECT top, share, n, CASE WHEN n = 1 OR share > 0.6 THEN 'heavy' WHEN n >= 4 THEN 'spread' ELSE '' END AS how FROM t"""))
def n22(spark, sf):
    v = src.bars(spark, sf).groupBy("ticker").agg(F.sum("volume").alias("weight"))
    alloc = risk.sector_allocation(v, v.select("ticker", F.substring("ticker", 1, 7).alias("sector")))
    t = alloc.agg(F.max_by("sector", F.struct("share", "sector")).alias("top"), F.max("share").alias("share"), F.count("*").alias("n"))
    text = say.sector_summary(c("top"), c("share"), c("n"))
    return t.select("top", "share", "n", F.when(text.contains("heavy"), "heavy").when(text.contains("Spread"), "spread").otherwise("").alias("how"))


@query(
    "o13_delta",
    with_bars(RETS + """, m AS (SELECT avg(ret) * 252 AS mu, var_pop(ret) * 252 AS v FROM rets WHERE ticker = 'MKT' AND ret IS NOT NULL)
    SELECT round(CASE WHEN v > 0 THEN greatest(1.5e0, least(5e0, (mu - 4e-2) / v)) ELSE 2.5e0 END, 6) + 0 AS delta FROM m""", "p_type"),
)
def o13(spark, sf):
    return rounded(_delta(src.returns(src.bars(spark, sf, "p_type")).filter(c("ticker") == src.BENCHMARK)))


def _delta(bench: DataFrame, rf: float = 0.04) -> DataFrame:
    """Risk aversion from the benchmark's own returns, between 1.5 and 5."""
    mu, v = F.avg("ret") * 252, F.var_pop("ret") * 252
    return bench.agg(F.when(v > 0, F.greatest(F.lit(1.5), F.least(F.lit(5.0), (mu - rf) / v))).otherwise(2.5).alias("delta"))


@query("o11_dollars", with_bars(_MU + """, w AS (SELECT ticker, least(0.4e0, greatest(0e0, 1 - (row_number() OVER (ORDER BY mu DESC, ticker) - 1) * 0.4e0)) AS weight FROM mu), d AS (SELECT ticker, round_even(weight * 100, 2) AS d FROM w WHERE round_even(weight * 100, 2) >= 1)
    SELECT ticker, round_even(d / sum(d) OVER () * 100, 2) AS dollars FROM d""", "p_type"))
def o11(spark, sf):
    return optimize.dollars(optimize.greedy_cap(_mu(spark, sf)[0], 0.4))


def _chosen(spark: SparkSession, sf: str, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """O14's universe: the n tickers of the best scores (n names go to the driver), with mean returns and covariance of
    the sessions on which all of them have a return."""
    scored = signals.edge_scores(signals.features(_frame(spark, sf, "p_brand")).filter(c("ticker") != src.BENCHMARK))
    names = [r["ticker"] for r in scored.orderBy(c("edge_raw").desc(), "ticker").limit(n).select("ticker").collect()]
    rets = src.returns(_grid(spark, sf)).filter(c("ticker").isin(names)).select("ticker", "date", "session_i", "ret")
    rets = rets.withColumn("_n", F.count("*").over(Window.partitionBy("date"))).filter(c("_n") == len(names)).drop("_n")
    return risk.expected_returns(rets), risk.shrunk_covariance(rets, complete=True)


@query("o8_frontier")
def o8(spark, sf):
    """Profiles and 25 frontier points of the eight best tickers."""
    return rounded(optimize.solve(*_chosen(spark, sf)), 6)


@query("o8_corner_portfolios")
def o8_corners(spark, sf):
    """The exact corners between which every efficient portfolio lies."""
    return rounded(optimize.corners(*_chosen(spark, sf)), 6)


@query("q9_optimize")
def q9(spark, sf):
    """Four profiles of the eight best tickers with weights above 0.005, dollars, statistics and summary; two
    tickers and 60 complete sessions are asked for, else the query fails with a message."""
    mu, cov = _chosen(spark, sf)
    delta = _delta(src.returns(_grid(spark, sf)).filter(c("ticker") == src.BENCHMARK))
    told = optimize.profiles(mu, cov, delta, rf=0.04, least=60)
    money = told.withColumn("d", F.bround(c("weight") * 100, 2)).filter("d >= 1")
    money = money.select("profile", "ticker", F.bround(c("d") / F.sum("d").over(Window.partitionBy("profile")) * 100, 2).alias("dollars"))
    out = told.join(money, ["profile", "ticker"], "left")
    every = Window.partitionBy("profile")
    top = F.max(F.struct("dollars", "ticker")).over(every)
    out = out.withColumn("summary", say.optimizer_summary(c("ret"), c("vol"), c("sharpe"), top["ticker"], top["dollars"], c("fell_back")))
    return rounded(out.filter("weight > 0.005").select("profile", "ticker", "weight", "dollars", "ret", "vol", "sharpe", "delta", "summary"), 4)


@query("q10_risk", with_bars(_SUMMARY + f" SELECT ticker, {r6('vol', 'sharpe', 'beta', 'max_dd')}, " + ", ".join(f"{_case(_LEVELS[k][0], *_LEVELS[k][1:3])} AS {k}_level" for k in ("beta", "sharpe")) + " FROM rs ORDER BY sharpe DESC NULLS LAST, ticker"))
def q10(spark, sf):
    t = risk.summary(_rets(spark, sf)).orderBy(c("sharpe").desc_nulls_last(), "ticker")
    return rounded(t.select("ticker", "vol", "sharpe", "beta", "max_dd", say.beta(c("beta"))["level"].alias("beta_level"), say.sharpe(c("sharpe"))["level"].alias("sharpe_level")))


@query(
    "q11_first_twelve",
    with_bars(RETS + """, t AS (SELECT DISTINCT ticker FROM rb WHERE ticker <> 'MKT' ORDER BY ticker LIMIT 12), r AS (SELECT rb.* FROM rb JOIN t USING (ticker)), c AS (SELECT date FROM r GROUP BY date HAVING count(*) = (SELECT count(*) FROM t)), k AS (SELECT r.* FROM r JOIN c USING (date))
    SELECT a.ticker, b.ticker AS other, round(corr(a.ret, b.ret), 6) + 0 AS corr FROM k a JOIN k b ON a.date = b.date AND a.ticker <= b.ticker GROUP BY 1, 2"""),
)
def q11(spark, sf):
    """Q11: the first twelve tickers where none are asked for."""
    rets = _rets(spark, sf)
    first = rets.filter(c("ticker") != src.BENCHMARK).select("ticker").distinct().orderBy("ticker").limit(12)
    return rounded(risk.correlation(rets.join(F.broadcast(first), "ticker", "left_semi")).select("ticker", "other", "corr"))


@query(
    "q12_risk_detail",
    with_bars(RETS + f""", w AS (SELECT ticker, date, ret, covar_samp(ret, bench) OVER k / nullif(var_pop(bench) OVER k, 0) AS beta, count(ret) OVER k AS n FROM rb WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
    g AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS e FROM w WHERE ticker = '{ONE}')
    SELECT date, round(CASE WHEN n = 63 THEN beta END, 6) + 0 AS beta, round(e / max(e) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0 AS dd FROM g""", "p_type"),
)
def q12(spark, sf):
    """Q12: rolling beta and distance from the peak of one ticker."""
    own = _rets(spark, sf, "p_type").filter(c("ticker") == ONE)
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = own.withColumn("e", F.exp(F.sum(F.log1p("ret")).over(w)))
    under = grown.select("date", (c("e") / F.max("e").over(w) - 1).alias("dd"))
    return rounded(under.join(risk.rolling_beta(own).select("date", "beta"), "date", "left").select("date", "beta", "dd"))


@query(
    "u5_buy_ideas",
    with_bars(""", lp AS (SELECT ticker, arg_max(close, date) AS last FROM bars GROUP BY 1), p AS (SELECT ticker, 20e0 / last AS shares, last AS cost, last FROM lp WHERE ticker <> 'MKT' ORDER BY ticker LIMIT 4)
    SELECT round(100 - 80 + sum(shares * last * 1.1e0), 6) + 0 AS total, round(sum(shares * last * 1.1e0) - 80, 6) + 0 AS pnl FROM p""", "p_type"),
)
def u5(spark, sf):
    """20 dollars in each of four tickers, valued a tenth higher: total and its distance from the start."""
    last = src.bars(spark, sf, "p_type").groupBy("ticker").agg(F.max_by("close", "date").alias("last"))
    state, cash = spark.createDataFrame([], portfolio.POSITIONS), portfolio.CASH
    for r in last.filter(c("ticker") != src.BENCHMARK).orderBy("ticker").limit(4).collect():
        state, cash = portfolio.buy(state, cash, r["ticker"], 20.0 / r["last"], r["last"])
    held = portfolio.valuation(state, last.select("ticker", (c("last") * 1.1).alias("last"))).agg(F.sum("value").alias("v"))
    return rounded(held.select((F.lit(cash) + c("v")).alias("total"), (F.lit(cash - portfolio.CASH) + c("v")).alias("pnl")))
