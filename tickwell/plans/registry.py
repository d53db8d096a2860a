"""Every query with its oracle SQL: modules register through `query`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indicators
from ..operators import ewm
from ..sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits compare equal."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) + 0 AS {c}" for c in columns)


def with_bars(rest: str, key: str = "p_brand", *, frame: bool = False, rec: bool = False, own: bool = False) -> str:
    """A statement on the CTEs bars, sessions and grid, and frame or rec where asked for: those of the session grid, or
    of each ticker's own bars."""
    steps = [src.bars_ctes(key), src.GRID]
    if frame or rec:
        steps.append(indicators.oracle_ctes("bars" if own else "grid"))
    if rec:
        steps.append(ewm.oracle_ctes())
    return f"WITH RECURSIVE {', '.join(steps)}{rest}"


def _frame(cols: list[str], build, key: str, own: bool = False) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        bars = src.bars(spark, sf, key)
        return rounded(build(bars if own else src.densify(bars)).select("ticker", "date", *cols))

    return run


for _names, _own in ((indicators.FINITE, False), (indicators.OWN, True)):
    for _name, _cols in _names.items():
        query(_name, with_bars(f" SELECT ticker, date, {r6(*_cols)} FROM frame", frame=True, own=_own))(_frame(_cols, indicators.finite_frame, "p_brand", _own))
for _name, _cols in ewm.RECURSIVE.items():
    query(_name, with_bars(f" SELECT ticker, date, {r6(*_cols)} FROM rec", rec=True))(_frame(_cols, ewm.indicator_frame, "p_brand"))
