"""Training tables: lag-aligned values of each cell's chain, for several lag lists side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import window_length


def feature_block(paths: DataFrame, cube: DataFrame, lags: Sequence[int], start: int, end: int, value: str = "value") -> DataFrame:
    """(t, cell, m, x): value of node m of the cell's path, sum(lags[:m]) steps before t; node 0 is the target.

    paths: origin, path.  t runs over [start + sum of lags, end): node 0 is the latest.
    """
    d = len(lags) + 1
    window_length(start, end, sum(lags))
    nodes = paths.where(F.size("path") == d).select(F.col("origin").alias("cell"), F.posexplode("path").alias("m", "node"))
    back = F.get(F.array(*[F.lit(sum(lags[:m])) for m in range(d)]), F.col("m"))
    values = cube.where((F.col("t") >= start) & (F.col("t") < end)).select(F.col("cell").alias("node"), F.col("t").alias("at"), F.col(value).alias("x"))
    out = nodes.join(values, "node").withColumn("t", F.col("at") + back)
    return out.where((F.col("t") >= start + sum(lags)) & (F.col("t") < end)).select("t", "cell", "m", "x")


def joint_blocks(paths: dict[str, DataFrame], cube: DataFrame, lag_lists: dict[str, Sequence[int]], start: int, end: int, value: str = "value") -> DataFrame:
    """(key, t, cell, m, x) over all lag lists."""
    out = None
    for key, lags in lag_lists.items():
        own = feature_block(paths[key], cube, lags, start, end, value).select(F.lit(key).alias("key"), "t", "cell", "m", "x")
        out = own if out is None else out.unionByName(own)
    return out


def common_dates(blocks: DataFrame, keys: int) -> DataFrame:
    """Steps that every lag list has."""
    return blocks.select("key", "t").distinct().groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == keys).select("t")


def puzzle(blocks: DataFrame, lag_lists: dict[str, Sequence[int]], cells: DataFrame | None = None) -> DataFrame:
    """puzzle(t, cell, x, y): channels in order of lag list and node; y from the first list; common steps only.

    One grouped pass: a step is common when all channels are there.  With ``cells``, cells without a path get zeros.
    """
    order = {k: n for n, k in enumerate(lag_lists)}
    rank = F.get(F.array(*[F.lit(order[k]) for k in lag_lists]), F.array_position(F.array(*map(F.lit, lag_lists)), F.col("key")).cast("int") - 1)
    channels = sum(len(lags) for lags in lag_lists.values())
    rows = blocks.withColumn("rank", rank).groupBy("t", "cell").agg(
        F.array_sort(F.collect_list(F.when(F.col("m") > 0, F.struct("rank", "m", "x")))).alias("c"), F.max(F.when((F.col("m") == 0) & (F.col("rank") == 0), F.col("x"))).alias("y")
    )
    rows = rows.where(F.size("c") == channels).select("t", "cell", F.col("c.x").alias("x"), "y")
    if cells is None:
        return rows
    every = rows.select("t").distinct().crossJoin(cells.select("cell"))  # the dense result has this size
    return every.join(rows, ["t", "cell"], "left").select("t", "cell", F.coalesce("x", F.array_repeat(F.lit(0.0), channels)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


def persistence(paths: DataFrame, cube: DataFrame, lag: int, value: str = "value") -> DataFrame:
    """forecast(cell, t, y_true, y_pred): the value of the first node after the station, ``lag`` steps before."""
    upstream = paths.select(F.col("origin").alias("cell"), F.col("path")[1].alias("node"))
    shifted = cube.select(F.col("cell").alias("node"), (F.col("t") + lag).alias("t"), F.col(value).alias("y_pred"))
    truth = cube.select("cell", "t", F.col(value).alias("y_true"))
    return truth.join(upstream, "cell").join(shifted, ["node", "t"]).select("cell", "t", "y_true", "y_pred")


def resampled(forecast: DataFrame, every: int) -> DataFrame:
    """Means of y_true and y_pred over runs of ``every`` steps."""
    return forecast.groupBy("cell", F.expr(f"t div {every}").alias("period")).agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"))
