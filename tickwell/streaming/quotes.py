"""Streaming bars: tumbling windows with a watermark over a stream of quotes (an extension; the batch quotes are S2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(events: DataFrame, width: str = "1 day", late: str = "1 day", ticker: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """Open, high, low, close and count for each ticker and window; the state is bounded by the watermark."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(ticker).alias("ticker"))
    return grouped.agg(
        F.min_by(value, ts).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, ts).alias("close"), F.count("*").alias("n")
    ).select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "n")
