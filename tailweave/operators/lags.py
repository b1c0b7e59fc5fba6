"""Lag alignment: which steps of which node belong together."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import check_lag, window_length


def offsets(lags: Sequence[int], d: int, orientation: str = "leading") -> list[tuple[int, int]]:
    """For each of d nodes (steps added to the start, steps taken from the end) of the window.

    leading: node 0, the station, is the earliest.  trailing: node 0 is the latest.
    """
    before = [0, *accumulate(lags[: d - 1])]
    total = before[-1]
    if orientation == "leading":
        return [(x, total - x) for x in before]
    if orientation == "trailing":
        return [(total - x, x) for x in before]
    raise ValueError("orientation is 'leading' or 'trailing'")


def windows(lags: Sequence[int], d: int, start: int, end: int, orientation: str = "leading") -> list[tuple[int, int]]:
    """Half-open window of each node inside [start, end); all have one length."""
    out = [(start + a, end - b) for a, b in offsets(lags, d, orientation)]
    window_length(start, end, sum(lags[: d - 1]))
    return out


def lag_pairs(ecdf: DataFrame, lag: int, start: int, end: int) -> DataFrame:
    """(tau, cell, u_late, u_early): each series against itself ``lag`` steps before, on [start, end)."""
    check_lag(lag)
    window_length(start, end, lag)
    early = F.lag("u", lag).over(Window.partitionBy("cell").orderBy("t"))
    return ecdf.withColumn("u_early", early).where((F.col("t") >= start + lag) & (F.col("t") < end)).select((F.col("t") - lag).alias("tau"), "cell", F.col("u").alias("u_late"), "u_early")


def sequence_pairs(cube: DataFrame, length: int, value: str = "value") -> DataFrame:
    """(t, cell, x array of the length values before t, y): only where all of them are there."""
    w = Window.partitionBy("cell").orderBy("t").rowsBetween(-length, -1)
    x = F.collect_list(value).over(w)
    return cube.select("t", "cell", x.alias("x"), F.col(value).alias("y")).where(F.size("x") == length)
