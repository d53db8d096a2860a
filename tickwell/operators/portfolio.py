"""Paper portfolio and watchlist state (S10, S11, K1 to K4, Q14, Q15): small JSON tables read and written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

CASH = 100.0
POSITIONS = "ticker string, shares double, cost double"


def load_watchlist(spark: SparkSession, path: str, default: DataFrame) -> DataFrame:
    """(ticker, pos), upper-cased; an empty, missing or corrupt list falls back to the default universe."""
    try:
        read = spark.read.schema("tickers array<string>").json(path)
        own = read.select(F.posexplode("tickers").alias("pos", "ticker")).select(F.upper(F.trim("ticker")).alias("ticker"), "pos").filter("ticker IS NOT NULL AND ticker <> ''")
        return default if own.isEmpty() else own
    except AnalysisException:
        return default


def save_watchlist(tickers: DataFrame, path: str) -> None:
    """K1: the state is one small row by its meaning (a user's list)."""
    tickers.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ticker"))), lambda x: x.ticker).alias("tickers")).coalesce(1).write.mode("overwrite").json(path)


def add_ticker(tickers: DataFrame, ticker: str) -> DataFrame:
    new = tickers.sparkSession.createDataFrame([(ticker.strip().upper(), 1 << 30)], "ticker string, pos int")
    every = tickers.union(new).groupBy("ticker").agg(F.min("pos").alias("pos"))
    return every.select("ticker", (F.row_number().over(Window.orderBy("pos", "ticker")) - 1).alias("pos"))


def remove_ticker(tickers: DataFrame, ticker: str) -> DataFrame:
    return tickers.filter(F.col("ticker") != ticker.strip().upper())


def group_of(tickers: DataFrame, universe: DataFrame, other: str = "My additions") -> DataFrame:
    """The first group that holds a ticker."""
    first = universe.groupBy("ticker").agg(F.min_by("group", "pos").alias("group"))
    return tickers.join(first, "ticker", "left").withColumn("group", F.coalesce("group", F.lit(other)))


def buy(positions: DataFrame, cash: float, ticker: str, shares: float, price: float) -> tuple[DataFrame, float]:
    """K3: averages into the cost; cash is rounded to cents and may fall below 0."""
    new = positions.sparkSession.createDataFrame([(ticker.strip().upper(), float(shares), float(price))], POSITIONS)
    merged = positions.union(new).groupBy("ticker").agg(F.sum("shares").alias("shares"), (F.sum(F.col("shares") * F.col("cost")) / F.sum("shares")).alias("cost"))
    return merged, round(cash - shares * price, 2)


def sell(positions: DataFrame, cash: float, ticker: str, price: float) -> tuple[DataFrame, float]:
    """K4: sells the whole position."""
    name = ticker.strip().upper()
    held = positions.filter(F.col("ticker") == name).agg(F.sum("shares")).first()[0]
    return positions.filter(F.col("ticker") != name), cash if held is None else round(cash + held * price, 2)


def valuation(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Q14: value and result of each position at (ticker, last); unknown where no price is known."""
    p, value, basis = positions.join(prices, "ticker", "left"), F.col("shares") * F.col("last"), F.col("shares") * F.col("cost")
    total = p.agg(F.sum(value).alias("total"))
    percent = F.when(F.col("cost") != 0, (F.col("last") / F.col("cost") - 1) * 100)
    out = p.join(F.broadcast(total)).select("ticker", "shares", "cost", F.col("last").alias("price"), value.alias("value"), (value - basis).alias("pnl"), percent.alias("pnl_pct"), "total")
    return out.withColumn("weight", F.when(F.col("total") > 0, F.col("value") / F.col("total"))).drop("total")


def save_portfolio(positions: DataFrame, cash: float, path: str) -> None:
    """K2: cash and positions as one JSON row, which is a user's state and small by its meaning."""
    state = positions.agg(F.sort_array(F.collect_list(F.struct("ticker", "shares", "cost"))).alias("positions")).select(F.lit(cash).alias("cash"), "positions")
    state.coalesce(1).write.mode("overwrite").json(path)


def load_portfolio(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """The saved state, or the starting one where nothing readable is saved."""
    try:
        state = spark.read.schema("cash double, positions array<struct<ticker: string, shares: double, cost: double>>").json(path)
        row = state.filter("cash IS NOT NULL").select("cash").first()
    except AnalysisException:
        row = None
    if row is None:
        return spark.createDataFrame([], POSITIONS), CASH
    return state.select(F.inline("positions")), row["cash"]


def reset_watchlist(tickers: DataFrame, default: DataFrame) -> DataFrame:
    """K1, Q15: back to the default list."""
    return default.select(*tickers.columns)
