"""Running values and falls of long series by spans of time, so that one series isn't one task.

A span holds the rows of one series within a stretch of days. Running values take two passes: spans are reduced to one
row each, those are summed up in order of time, and what came before a span is joined to its rows. Statistics of a path
are one row a span, merged in order of time; the merge is associative, so spans of any length give the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a span, where dates make them; rows of one, where sessions do.
DAYS, ROWS = 360, 256
INF = float("inf")


def span_of(order: str = "date", days: int = DAYS) -> Column:
    return F.floor(F.unix_date(order) / days)


def _sum(before: Column, own: Column) -> Column:
    return F.coalesce(before + own, before, own)


#: Kind -> the value of a span's rows, how spans before are put together, how both meet.
_KINDS = {
    "sum": (lambda x, at: F.sum(x), F.sum, _sum),
    "max": (lambda x, at: F.max(x), F.max, lambda before, own: F.greatest(before, own)),
    "last": (lambda x, at: F.max_by(x, F.when(x.isNotNull(), at)), lambda x: F.last(x, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def running(frame: DataFrame, wanted: dict[str, tuple[str, Column]], by: str | None = "ticker", order: str = "date", days: int = DAYS, span: str | None = None) -> DataFrame:
    """frame with, for each name, the `sum`, `max` or `last` known value of a column over all rows of its series so far.

    Rows without a value add nothing and hold the value so far, null before the first. One series (by=None) or a few
    are spread over as many tasks as they have spans. Dates are distinct within a series, and not null; `span` names a
    column of spans in place of `days`."""
    keys = [by] if by else []
    names = list(wanted)
    at = frame.withColumn("_span", F.col(span) if span else span_of(order, days)).withColumns({f"_x{i}": wanted[n][1] for i, n in enumerate(names)})
    kinds = [_KINDS[wanted[n][0]] for n in names]
    ends = at.groupBy(*keys, "_span").agg(*[reduce(F.col(f"_x{i}"), F.col(order)).alias(f"_e{i}") for i, (reduce, _, _) in enumerate(kinds)])
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias("_key") for k in keys], F.col("_span").alias("_at"), *[gather(f"_e{i}").over(earlier).alias(f"_c{i}") for i, (_, gather, _) in enumerate(kinds)])
    same = F.col("_span") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col("_key"))
    within = Window.partitionBy(*keys, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(carried, same)
    values = [meet(F.col(f"_c{i}"), gather(F.col(f"_x{i}")).over(within)).alias(n) for i, (n, (_, gather, meet)) in enumerate(zip(names, kinds, strict=True))]
    return out.select(*[c for c in frame.columns if c not in names], *values)


def obv(grid: DataFrame, size: int = ROWS) -> DataFrame:
    """W12 on a session grid (ticker, date, session_i, close, volume): running volume, signed by the change of close;
    the first bar and one after a session without bar have sign 0, sessions without volume are null.

    Spans are `size` sessions; the last row of each is sent to the next one too, as the close before its first row."""
    of = F.floor((F.col("session_i") - 1) / size)
    sent = grid.select("ticker", "date", "session_i", "close", "volume", F.explode(F.array_distinct(F.array(of, F.floor(F.col("session_i") / size)))).alias("_part"))
    prior = F.lag("close").over(Window.partitionBy("ticker", "_part").orderBy("session_i"))
    signed = F.coalesce(F.signum(F.round(F.col("close") - prior, 9)), F.lit(0.0)) * F.col("volume")
    rows = sent.withColumn("_signed", signed).filter(F.col("_part") == of)
    out = running(rows, {"obv": ("sum", F.col("_signed"))}, order="session_i", span="_part")
    return out.select("ticker", "date", F.when(F.col("_signed").isNotNull(), F.col("obv")).alias("obv"))


def log_step(ret: str = "ret") -> Column:
    """Log growth of a return; one of -1 or less ends the path at nothing."""
    return F.when(F.col(ret) <= -1, F.lit(-INF)).otherwise(F.log1p(ret))


def growth(rets: DataFrame, by: str | None = "ticker", days: int = DAYS) -> DataFrame:
    """What 1 has grown to after each return; null where there is none."""
    out = running(rets, {"_log": ("sum", log_step())}, by, days=days)
    return out.withColumn("growth", F.when(F.col("ret").isNotNull(), F.exp("_log"))).drop("_log")


def underwater(levels: DataFrame, level: str = "close", by: str | None = "ticker", days: int = DAYS) -> DataFrame:
    """Each level against the highest so far, less 1."""
    out = running(levels, {"_top": ("max", F.col(level))}, by, days=days)
    return out.withColumn("underwater", F.try_divide(F.col(level), F.col("_top")) - 1).drop("_top")


def _ordered(by: str, order: str):
    return Window.partitionBy(by, "_span").orderBy(order)


def path_ends(frame: DataFrame, step: Column, by: str, order: str = "date", days: int = DAYS) -> DataFrame:
    """frame with `_path`, null but on the last row of each span, where it is the span's state: its own log growth, the
    highest and lowest point of its path, and its deepest fall, all in logs."""
    w = _ordered(by, order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    path = frame.withColumn("_span", span_of(order, days)).withColumn("_log", F.sum(step).over(so_far))
    path = path.withColumn("_top", F.max("_log").over(so_far))
    state = F.struct(
        F.col("_span").alias("span"), F.coalesce("_log", F.lit(0.0)).alias("growth"), F.coalesce("_top", F.lit(-INF)).alias("peak"),
        F.coalesce(F.min("_log").over(so_far), F.lit(INF)).alias("trough"), F.coalesce(F.min(F.col("_log") - F.col("_top")).over(so_far), F.lit(0.0)).alias("worst"),
    )
    return path.withColumn("_path", F.when(F.lead(order).over(w).isNull(), state)).drop("_span", "_log", "_top")


def merged_path(states: Column) -> Column:
    """(growth, worst): what 1 has grown to at the end and the deepest fall, from a series' collected `_path`. One part
    followed by another falls as deep as either, or from the first one's peak to the second one's trough."""

    def merge(a: Column, s: Column) -> Column:
        return F.struct(
            (a["growth"] + s["growth"]).alias("growth"), F.greatest(a["peak"], a["growth"] + s["peak"]).alias("peak"),
            F.least(a["worst"], s["worst"], a["growth"] + s["trough"] - a["peak"]).alias("worst"),
        )

    start = F.struct(F.lit(0.0).alias("growth"), F.lit(-INF).alias("peak"), F.lit(0.0).alias("worst"))
    return F.aggregate(F.array_sort(states), start, merge, lambda a: F.struct(F.exp(a["growth"]).alias("growth"), (F.exp(a["worst"]) - 1).alias("worst")))


_MOMENTS = ("n", "mean", "square", "n_low", "mean_low", "square_low")


def _add(a: Column, n: Column, mean: Column, square: Column, suffix: str = "") -> list[Column]:
    """Count, mean and sum of squared distances of two sets together."""
    own, total = a["n" + suffix], a["n" + suffix] + n
    gap = mean - a["mean" + suffix]
    share = F.coalesce(F.try_divide(n, total), F.lit(0.0))
    return [total.alias("n" + suffix), (a["mean" + suffix] + gap * share).alias("mean" + suffix), (a["square" + suffix] + square + gap * gap * own * share).alias("square" + suffix)]


def curve_stats(equity: DataFrame, by: str = "run_id", days: int = DAYS) -> DataFrame:
    """(by, first, last, worst, n, mean, sd, sd_low) of equity(by, date, equity): levels at both ends, the deepest fall,
    and count, mean and standard deviation of the changes and of those below 0.

    A span's row holds the moments of its own changes; merging two adds theirs, and the change from the last level of
    the one to the first of the other. So nothing is sorted but the rows of a span and the spans of a curve. Rows without
    a level are left out."""
    w = _ordered(by, "date")
    top = F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = equity.filter("equity IS NOT NULL").withColumn("_span", span_of("date", days))
    rows = rows.withColumn("_r", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("_fall", F.try_divide(F.col("equity"), top) - 1)
    r, low = F.col("_r"), F.when(F.col("_r") < 0, F.col("_r"))
    zero = F.lit(0.0)
    moments = [c.alias(n) for x, s in ((r, ""), (low, "_low")) for c, n in ((F.count(x).cast("double"), "n" + s), (F.coalesce(F.avg(x), zero), "mean" + s), (F.coalesce(F.var_pop(x) * F.count(x), zero), "square" + s))]
    ends = rows.groupBy(by, "_span").agg(
        F.min_by("equity", "date").alias("first"), F.max_by("equity", "date").alias("last"), F.max("equity").alias("peak"), F.min("equity").alias("trough"),
        F.coalesce(F.min("_fall"), zero).alias("worst"), *moments,
    )
    states = ends.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("_span").alias("span"), "first", "last", "peak", "trough", "worst", *_MOMENTS))).alias("s"))

    def merge(a: Column, s: Column) -> Column:
        change = F.try_divide(s["first"], a["last"]) - 1
        there, below = F.when(change.isNotNull(), 1.0).otherwise(0.0), F.when(change < 0, 1.0).otherwise(0.0)
        one = F.struct(*_add(a, s["n"], s["mean"], s["square"]), *_add(a, s["n_low"], s["mean_low"], s["square_low"], "_low"))
        change = F.coalesce(change, zero)
        both = F.struct(*_add(one, there, F.when(there > 0, change).otherwise(one["mean"]), zero), *_add(one, below, F.when(below > 0, change).otherwise(one["mean_low"]), zero, "_low"))
        return F.struct(
            a["first"].alias("first"), s["last"].alias("last"), F.greatest(a["peak"], s["peak"]).alias("peak"),
            F.least(a["worst"], s["worst"], F.coalesce(F.try_divide(s["trough"], a["peak"]) - 1, zero)).alias("worst"), *[both[m].alias(m) for m in _MOMENTS],
        )

    head = F.element_at("s", 1)
    start = F.struct(*[head[c].alias(c) for c in ("first", "last", "peak", "worst", *_MOMENTS)])
    total = states.select(by, F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), start, merge).alias("t"))
    sd = lambda s: F.when(F.col("t.n" + s) > 0, F.sqrt(F.col("t.square" + s) / F.col("t.n" + s)))
    return total.select(by, "t.first", "t.last", "t.worst", F.col("t.n").cast("long").alias("n"), F.when(F.col("t.n") > 0, F.col("t.mean")).alias("mean"), sd("").alias("sd"), sd("_low").alias("sd_low"))
