"""Running values and falls by spans of time against pandas over the whole series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickwell.operators import risk, spans
from tickwell.sources import bars as src


@pytest.fixture(scope="module")
def series(spark):
    """Two tickers with gaps and a third without any value; dates are whole days over three years."""
    r = np.random.default_rng(3)
    out = []
    for t, n in (("A", 700), ("B", 300), ("N", 40)):
        days = sorted(r.choice(1100, n, replace=False))
        x = r.normal(0.0004, 0.02, n)
        x[r.random(n) < 0.1] = np.nan
        if t == "N":
            x[:] = np.nan
        out.append(pd.DataFrame({"ticker": t, "date": [dt.date(2021, 1, 1) + dt.timedelta(days=int(d)) for d in days], "ret": x}))
    wide = pd.concat(out, ignore_index=True)
    frame = spark.createDataFrame(wide.astype(object).where(wide.notna(), None), "ticker string, date date, ret double")
    return wide, frame.persist()


def told(df, column):
    return df.select("ticker", "date", column).toPandas().sort_values(["ticker", "date"], ignore_index=True)[column].astype(float).to_numpy()


@pytest.mark.parametrize("days", [1, 7, 360, 5000])
def test_running_values_equal_the_whole_series(series, days):
    wide, frame = series
    got = spans.running(frame, {"total": ("sum", F.col("ret")), "top": ("max", F.col("ret")), "known": ("last", F.col("ret"))}, days=days)
    by = wide.sort_values(["ticker", "date"]).groupby("ticker")["ret"]
    np.testing.assert_allclose(told(got, "total"), by.cumsum().groupby(wide["ticker"]).ffill(), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(told(got, "top"), by.cummax().groupby(wide["ticker"]).ffill(), rtol=1e-9)
    np.testing.assert_allclose(told(got, "known"), by.ffill(), rtol=1e-9)
    assert got.columns == [*frame.columns, "total", "top", "known"]


def test_one_series_is_many_tasks(spark, series):
    _, frame = series
    one = frame.filter("ticker = 'A'")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = spans.running(one, {"total": ("sum", F.col("ret"))}, by=None, days=30)
        assert out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_null_series_keeps_its_rows(spark):
    day = dt.date(2024, 1, 1)
    rows = [(None, day + dt.timedelta(days=i), float(i)) for i in range(5)]
    got = spans.running(spark.createDataFrame(rows, "ticker string, date date, x double"), {"s": ("sum", F.col("x"))}, days=2)
    assert sorted(r["s"] for r in got.collect()) == [0.0, 1.0, 3.0, 6.0, 10.0]
    assert spans.running(got.limit(0).drop("s"), {"s": ("sum", F.col("x"))}).count() == 0


def test_growth_and_underwater(series):
    wide, frame = series
    by = wide.sort_values(["ticker", "date"], ignore_index=True)
    grown = (1 + by["ret"]).groupby(by["ticker"]).cumprod()
    np.testing.assert_allclose(told(spans.growth(frame, days=50), "growth"), grown, rtol=1e-9)
    levels = frame.withColumn("close", 100 + 10 * F.col("ret"))
    close = 100 + 10 * by["ret"]
    np.testing.assert_allclose(told(spans.underwater(levels, days=50), "underwater"), close / close.groupby(by["ticker"]).cummax() - 1, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [3, 10, 256])
def test_volume_on_a_grid_with_gaps(spark, size):
    r = np.random.default_rng(4)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    close = pd.DataFrame(np.round(100 + np.cumsum(r.integers(-1, 2, (60, 3)), 0), 2).astype(float), days, list("ABC"))
    volume = pd.DataFrame(r.integers(1, 50, (60, 3)).astype(float), days, list("ABC"))
    for t, holes in (("B", [0, 1, 9, 10, 11, 29, 30]), ("C", range(45, 60))):
        close.loc[[days[i] for i in holes], t] = volume.loc[[days[i] for i in holes], t] = np.nan
    rows = [(t, d, float(close.loc[d, t]), float(volume.loc[d, t])) for t in "ABC" for d in days if pd.notna(close.loc[d, t])]
    grid = src.densify(spark.createDataFrame(rows, "ticker string, date date, close double, volume double"))
    got = spans.obv(grid, size).toPandas().pivot(index="date", columns="ticker", values="obv").astype(float)
    want = (np.sign(close.diff()).fillna(0.0) * volume).cumsum()
    np.testing.assert_allclose(got.to_numpy(), want.to_numpy())


def falls(x):
    grown = np.cumprod(1 + x)
    return grown[-1], (grown / np.maximum.accumulate(grown)).min() - 1


@pytest.mark.parametrize("days", [1, 13, 360, 5000])
def test_paths_merge_to_the_deepest_fall(series, days):
    wide, frame = series
    known = frame.filter("ret IS NOT NULL")
    ends = spans.path_ends(known, spans.log_step(), "ticker", days=days).groupBy("ticker").agg(F.collect_list("_path").alias("s"))
    got = {r["ticker"]: (r["e"]["growth"], r["e"]["worst"]) for r in ends.select("ticker", spans.merged_path(F.col("s")).alias("e")).collect()}
    for t in "AB":
        x = wide[(wide["ticker"] == t) & wide["ret"].notna()].sort_values("date")["ret"].to_numpy()
        np.testing.assert_allclose(got[t], falls(x), rtol=1e-9)


def test_a_path_that_ends_at_nothing(spark):
    day = dt.date(2024, 1, 1)
    rows = [("A", day + dt.timedelta(days=i), x) for i, x in enumerate([0.1, -1.0, 0.5, 0.2])]
    for days in (1, 2, 100):
        ends = spans.path_ends(spark.createDataFrame(rows, "ticker string, date date, ret double"), spans.log_step(), "ticker", days=days)
        end = ends.agg(F.collect_list("_path").alias("s")).select(spans.merged_path(F.col("s")).alias("e")).first()["e"]
        assert (end["growth"], end["worst"]) == (0.0, -1.0)


@pytest.mark.parametrize("days", [1, 9, 360])
def test_curves_merge_to_the_statistics_of_the_whole(spark, series, days):
    wide, _ = series
    rows, want = [], {}
    for t, capital in (("A", 100.0), ("B", 250.0)):
        own = wide[(wide["ticker"] == t) & wide["ret"].notna()].sort_values("date")
        level = capital * np.cumprod(1 + own["ret"].to_numpy())
        rows += [(t, d, float(v)) for d, v in zip(own["date"], level, strict=True)]
        r = level[1:] / level[:-1] - 1
        want[t] = [level[0], level[-1], (level / np.maximum.accumulate(level)).min() - 1, len(r), r.mean(), r.std(), r[r < 0].std()]
    rows += [("one", dt.date(2024, 1, 1), 5.0), ("none", dt.date(2024, 1, 1), None)]
    got = {r["run_id"]: list(r)[1:] for r in spans.curve_stats(spark.createDataFrame(rows, "run_id string, date date, equity double"), days=days).collect()}
    for t, w in want.items():
        np.testing.assert_allclose(got[t], w, rtol=1e-9)
    assert got["one"] == [5.0, 5.0, 0.0, 0, None, None, None] and "none" not in got


def test_no_window_runs_over_a_whole_history(series):
    _, frame = series
    both = frame.filter("ret IS NOT NULL").withColumn("bench", F.col("ret"))
    equity = both.select(F.col("ticker").alias("run_id"), "date", (1 + F.col("ret")).alias("equity"))
    for df in (risk.summary(both), risk.perf_stats(equity)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window")]
        assert windows and all("_span" in line for line in windows)
