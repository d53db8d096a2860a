"""Bars and the tables around them, derived from the star-schema tables; the same SQL runs in Spark and elsewhere.

Bars are long: (ticker, date, open, high, low, close, volume), one row for each ticker and session. Integers are
summed before any division, so that results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BENCHMARK = "MKT"


def bars_ctes(key: str = "p_brand", grain: str = "week", lineitem: str = "lineitem", part: str = "part") -> str:
    """Common table expressions agg and bars, without WITH and without a trailing comma."""
    return f"""li AS (
  SELECT {key} AS ticker, CAST(date_trunc('{grain}', l_shipdate) AS DATE) AS date,
         CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS q
  FROM {lineitem} JOIN {part} ON l_partkey = p_partkey),
one AS (
  SELECT ticker, date, CAST(count(*) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS disc, CAST(sum(x) AS BIGINT) AS tax, CAST(sum(q) AS BIGINT) AS qty
  FROM li GROUP BY ticker, date),
agg AS (
  SELECT * FROM one UNION ALL
  SELECT '{BENCHMARK}' AS ticker, date, CAST(sum(n) AS BIGINT), CAST(sum(disc) AS BIGINT), CAST(sum(tax) AS BIGINT), CAST(sum(qty) AS BIGINT) FROM one GROUP BY date),
px AS (
  SELECT *, 1e2 * exp(sum(5e-1 * (CAST(disc AS DOUBLE) / 1e2 - 5e-2 * n) / sqrt(CAST(n AS DOUBLE)))
                      OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM agg),
oc AS (
  SELECT *, coalesce(lag(close) OVER (PARTITION BY ticker ORDER BY date)
                     * exp(6e-1 * (CAST(tax AS DOUBLE) / 1e2 - 4e-2 * n) / sqrt(CAST(n AS DOUBLE))), close) AS open FROM px),
bars AS (
  SELECT ticker, date, open, greatest(open, close) * (1e0 + CAST(tax AS DOUBLE) / n / 8e2) AS high,
         least(open, close) * (1e0 - CAST(tax AS DOUBLE) / n / 8e2) AS low, close, CAST(qty AS DOUBLE) AS volume FROM oc)"""


CATALYSTS = f"""earnings AS (SELECT ticker, date FROM agg WHERE ticker <> '{BENCHMARK}' AND disc % 13 = 0),
actions AS (
  SELECT ticker, date, CASE WHEN tax % 17 = 0 THEN 25e-2 ELSE 0e0 END AS dividend, CASE WHEN tax % 29 = 0 THEN 2e0 ELSE 0e0 END AS split
  FROM agg WHERE ticker <> '{BENCHMARK}' AND (tax % 17 = 0 OR tax % 29 = 0)),
news AS (
  SELECT ticker, date, concat('Headline ', CAST(qty AS STRING)) AS title FROM agg WHERE ticker <> '{BENCHMARK}' AND qty % 11 = 0)"""


def _read(spark: SparkSession, sf_dir: str, ctes: str, result: str) -> DataFrame:
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "part")}
    return spark.sql(f"WITH {ctes} SELECT * FROM {result}", **tables)


def bars(spark: SparkSession, sf_dir: str, key: str = "p_brand", grain: str = "week") -> DataFrame:
    """The price panel, one row for each ticker and session."""
    return _read(spark, sf_dir, bars_ctes(key, grain, "{lineitem}", "{part}"), "bars")


def catalysts(spark: SparkSession, sf_dir: str, table: str, key: str = "p_brand", grain: str = "week") -> DataFrame:
    """`earnings`, `actions` or `news`."""
    return _read(spark, sf_dir, bars_ctes(key, grain, "{lineitem}", "{part}") + ",\n" + CATALYSTS, table)


def catalyst_marks(spark: SparkSession, sf_dir: str, key: str = "p_brand", grain: str = "week") -> DataFrame:
    """S5 to S7 in one table and one pass: (ticker, date, kind, dividend, split, title) with kind earnings, action or
    news."""
    agg = _read(spark, sf_dir, bars_ctes(key, grain, "{lineitem}", "{part}"), "agg").filter(F.col("ticker") != BENCHMARK)
    dividend, split = F.when(F.col("tax") % 17 == 0, 0.25).otherwise(0.0), F.when(F.col("tax") % 29 == 0, 2.0).otherwise(0.0)
    none, zero = F.lit(None).cast("string"), F.lit(0.0)
    mark = lambda kind, d, s, t: F.struct(F.lit(kind).alias("kind"), d.alias("dividend"), s.alias("split"), t.alias("title"))
    found = F.array(
        F.when(F.col("disc") % 13 == 0, mark("earnings", zero, zero, none)),
        F.when((dividend != 0) | (split != 0), mark("action", dividend, split, none)),
        F.when(F.col("qty") % 11 == 0, mark("news", zero, zero, F.concat(F.lit("Headline "), F.col("qty").cast("string")))),
    )
    return agg.select("ticker", "date", F.inline(F.filter(found, lambda x: x.isNotNull())))


def densify(panel: DataFrame) -> DataFrame:
    """D3: every ticker on every session of the union calendar, with session_i; missing bars are null.

    The calendar is one array of all sessions and is broadcast; each bar also makes the missing rows up to the ticker's
    next one, so the grid needs no join by ticker and date, and stays partitioned by ticker for the windows to come."""
    calendar = panel.agg(F.sort_array(F.collect_set("date")).alias("_days"))
    at = panel.join(F.broadcast(calendar)).withColumn("_at", F.array_position("_days", F.col("date")).cast("int"))
    w = Window.partitionBy("ticker").orderBy("date")
    begin = F.when(F.lag("_at").over(w).isNull(), F.lit(1)).otherwise(F.col("_at"))
    end = F.coalesce(F.lead("_at").over(w) - 1, F.size("_days"))
    rows = at.withColumn("_begin", begin).withColumn("_end", end).withColumn("session_i", F.explode(F.sequence("_begin", "_end")))
    there = F.col("session_i") == F.col("_at")
    values = [F.when(there, F.col(c)).alias(c) for c in panel.columns if c not in ("ticker", "date")]
    return rows.select("ticker", F.get("_days", F.col("session_i") - 1).alias("date"), "session_i", *values)


#: The grid in SQL, on a CTE bars.
GRID = """sessions AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) AS session_i FROM (SELECT DISTINCT date FROM bars)),
grid AS (
  SELECT t.ticker, s.date, s.session_i, b.open, b.high, b.low, b.close, b.volume
  FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN sessions s LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = s.date)"""


def returns(panel: DataFrame, fill: str = "pad") -> DataFrame:
    """S3: returns from session to session; fill='pad' carries the last close over the gaps of a densified panel,
    fill='none' leaves them out."""
    if fill not in ("pad", "none"):
        raise ValueError(f"fill is 'pad' or 'none', not {fill!r}")
    w = Window.partitionBy("ticker").orderBy("date")
    close = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if fill == "pad" else F.col("close")
    padded = panel.withColumn("_c", close)
    return padded.withColumn("ret", F.try_divide("_c", F.lag("_c").over(w)) - 1).drop("_c").filter("ret IS NOT NULL")


def latest_quotes(events: DataFrame, ticker: str = "event_type", value: str = "value", ts: str = "ts") -> DataFrame:
    """The last known value of each ticker and its time."""
    known = events.filter(F.col(value).isNotNull())
    return known.groupBy(F.col(ticker).alias("ticker")).agg(F.max_by(value, F.struct(ts, "event_id")).alias("last"), F.max(ts).alias("as_of"))


def news_items(raw: DataFrame, column: str = "json") -> DataFrame:
    """Headlines from flat or `content`-nested JSON, epoch seconds or ISO times, newest first. Title and time are
    those of the content where there is one; rows without either, or that aren't JSON, go."""
    story = "title: STRING, pubDate: STRING, provider: STRUCT<displayName: STRING>, canonicalUrl: STRUCT<url: STRING>"
    j = F.from_json(column, f"STRUCT<{story}, providerPublishTime: BIGINT, publisher: STRING, link: STRING, content: STRUCT<{story}>>")
    row = raw.withColumn("_j", j)
    inner = lambda c: F.when(F.col("_j.content").isNotNull(), F.col(f"_j.content.{c}")).otherwise(F.col(f"_j.{c}"))
    out = row.select(
        *[c for c in raw.columns if c != column],
        inner("title").alias("title"),
        F.coalesce(F.try_to_timestamp(inner("pubDate")), F.timestamp_seconds("_j.providerPublishTime")).alias("when"),
        F.coalesce(inner("provider.displayName"), F.col("_j.publisher"), F.lit("")).alias("publisher"),
        F.coalesce(inner("canonicalUrl.url"), F.col("_j.link")).alias("url"),
    )
    return out.filter("title IS NOT NULL AND when IS NOT NULL").orderBy(F.desc("when"))
