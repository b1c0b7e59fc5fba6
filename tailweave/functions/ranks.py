"""Empirical distribution functions by average rank.

Many series are ranked by window functions over one shuffle by series.  Where some of many series are long (``ecdf_by_ranges``,
``group_percentiles``), those are cut into ranges of values too.  One series of any length (``placed_values`` and what
builds on it) is ranked over its distinct values with their counts, cut into ranges of values whose totals carry the prefix
sums: no task sorts the whole series, and a value that most rows share is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .heavy import met


def known(value: str) -> Column:
    """The value, NULL where it is NaN."""
    return F.when(~F.isnan(F.col(value).cast("double")), F.col(value))


def average_rank(value: str, by: Sequence[str]) -> Column:
    """1-based rank; ties share their mean rank.  NULL and NaN have no rank and take none from the others."""
    own = Window.partitionBy(*by).orderBy(known(value).asc_nulls_last())
    tied = Window.partitionBy(*by, value)
    return F.when(known(value).isNotNull(), F.rank().over(own) + (F.count(F.lit(1)).over(tied) - 1) / 2.0)


def ecdf_column(value: str, by: Sequence[str]) -> Column:
    return average_rank(value, by) / (F.count(known(value)).over(Window.partitionBy(*by)) + 1)


def ecdf(cube: DataFrame, value: str = "value", by: Sequence[str] = ("cell",)) -> DataFrame:
    """ecdf(t, *by, u): ranks run over the full series, so cut windows only afterwards."""
    return cube.select("t", *by, ecdf_column(value, by).alias("u"))


def zero_based_rank(value: str, by: Sequence[str]) -> Column:
    return average_rank(value, by) - 1


#: Ranges of values that one long series is cut into.
RANGES = 1024


def placed_values(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, n, below): each distinct value that is known, its rows (or their summed ``weight``), and the rows below it."""
    from pyspark.ml.feature import Bucketizer

    known = df.select(F.col(value).cast("double").alias("value"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("n")).where("value is not null and not isnan(value)")
    counts = known.groupBy("value").agg(F.sum("n").alias("n"))
    shares = [k / RANGES for k in range(1, RANGES)]
    found = counts.agg(F.percentile_approx("value", shares, 4 * RANGES)).first()[0] if shares else None  # at most RANGES numbers
    inner = sorted({c for c in found or [] if abs(c) != float("inf")})
    if inner:
        counts = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="value", outputCol="range").transform(counts)
    else:
        counts = counts.withColumn("range", F.lit(0.0))
    totals = counts.groupBy("range").agg(F.sum("n").alias("words"))
    base = totals.select("range", (F.sum("words").over(Window.orderBy("range")) - F.col("words")).alias("base"))  # at most RANGES rows
    inside = F.sum("n").over(Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counts.withColumn("inside", inside).join(F.broadcast(base), "range").select("value", "n", (F.col("base") + F.col("inside")).alias("below"))


#: A series with more distinct values than LONG is cut into SERIES_RANGES ranges of them.
LONG, SERIES_RANGES = 1_000_000, 64


def placed_by_series(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(*by, value, n, below, total): ``placed_values`` of every series; no task holds a long one.

    Long series have splits of their own, approximate percentiles of their distinct values; at most a row for each LONG of all values.
    """
    by = list(by)
    counts = stored(df.where(known(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")), "values")
    shares = [k / SERIES_RANGES for k in range(1, SERIES_RANGES)]
    sizes = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > LONG).select(*by)
    splits = counts.join(F.broadcast(sizes), by, "left_semi").groupBy(*by).agg(F.array_distinct(F.percentile_approx("value", shares, 16 * SERIES_RANGES)).alias("splits"))
    cut = counts.join(F.broadcast(splits), by, "left").withColumn("range", F.coalesce(F.size(F.filter("splits", lambda s: s < F.col("value"))), F.lit(0))).drop("splits")
    inside = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    totals = cut.groupBy(*by, "range").agg(F.sum("n").alias("words"))
    series = Window.partitionBy(*by)  # SERIES_RANGES rows at most
    base = totals.select(*by, "range", (F.sum("words").over(series.orderBy("range")) - F.col("words")).alias("base"), F.sum("words").over(series).alias("total"))
    return cut.withColumn("inside", inside).join(base, [*by, "range"]).select(*by, "value", "n", (F.col("base") + F.col("inside")).alias("below"), "total")


def ecdf_by_ranges(cube: DataFrame, value: str = "value", by: Sequence[str] = ("cell",)) -> DataFrame:
    """As ``ecdf``, where some series are too long for one task: values meet their place, the most frequent ones by a broadcast."""
    by = list(by)
    placed = stored(placed_by_series(cube, value, by), "placed")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = cube.select("t", *by, F.col(value).cast("double").alias("value"))
    there = rows.where("value is not null and not isnan(value)")
    found = met(there, placed, [*by, "value"], "n", total).select("t", *by, ((F.col("below") + (F.col("n") + 1) / 2.0) / (F.col("total") + 1)).alias("u"))
    return found.unionByName(rows.where("value is null or isnan(value)").select("t", *by, F.lit(None).cast("double").alias("u")))


def group_percentiles(df: DataFrame, value: str, by: Sequence[str], share: float) -> DataFrame:
    """(*by, n, limit): each group's exact percentile, linear between neighbours, and its known rows; no task holds a long group."""
    at = F.lit(float(share)) * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
    placed = placed_by_series(df, value, by).where(holds(low) | holds(high))
    found = placed.groupBy(*by, "total").agg(F.max(F.when(holds(low), F.col("value"))).alias("l"), F.max(F.when(holds(high), F.col("value"))).alias("h"))
    mixed = (high - at) * F.col("l") + (at - low) * F.col("h")
    return found.select(*by, F.col("total").alias("n"), F.when((low == high) | (F.col("l") == F.col("h")), F.col("l")).otherwise(mixed).alias("limit"))


def joint_ranks(df: DataFrame, x: str, y: str) -> DataFrame:
    """(rx, ry, n, total): average ranks of the distinct pairs of two columns known on both sides, and how many rows each has."""
    both = df.where(known(x).isNotNull() & known(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.col("below") + (F.col("m") + 1) / 2.0
    rx = placed_values(both, "x", "n").withColumnRenamed("n", "m").select(F.col("value").alias("x"), rank.alias("rx"))
    ry = placed_values(both, "y", "n").withColumnRenamed("n", "m").select(F.col("value").alias("y"), rank.alias("ry"))
    total = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return both.join(rx, "x").join(ry, "y").crossJoin(F.broadcast(total)).select("rx", "ry", "n", "total")  # one row


def percentiles(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """One row (p0, p1, ...): exact percentiles of one series, linear between neighbours; NULL for an empty one."""
    placed = placed_values(df, value)
    total = F.broadcast(placed.agg(F.sum("n").alias("total")))  # one row
    rows = placed.crossJoin(total)
    out = []
    for k, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("n"))
        out += [F.max(F.when(holds(low), F.col("value"))).alias(f"l{k}"), F.max(F.when(holds(high), F.col("value"))).alias(f"h{k}")]
    found = rows.agg(F.max("total").alias("total"), *out)
    result = []
    for k, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        mixed = (high - at) * F.col(f"l{k}") + (at - low) * F.col(f"h{k}")
        result.append(F.when((low == high) | (F.col(f"l{k}") == F.col(f"h{k}")), F.col(f"l{k}")).otherwise(mixed).alias(f"p{k}"))
    return found.select(*result)
