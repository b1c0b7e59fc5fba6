"""Streams of observations against frozen thresholds: joint counts are additive, so the graph can grow with the stream.

Ranks need the whole series; thresholds of a finished model do not.  Counts of late and early exceedances meet in a
stream-stream join bounded by watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frozen_thresholds(cube: DataFrame, p: float = 0.95, value: str = "value") -> DataFrame:
    """(cell, threshold): the least value whose rank reaches p; NULL (no row) where ties keep all below."""
    from ..functions.ranks import ecdf_column
    from ..operators.tail import exceeds

    ranked = cube.select("cell", value, ecdf_column(value, ["cell"]).alias("u"))
    return ranked.where(exceeds("u", p)).groupBy("cell").agg(F.min(value).alias("threshold"))


def stream_exceedances(stream: DataFrame, thresholds: DataFrame, delay: str = "2 hours", value: str = "value") -> DataFrame:
    """(ts, cell) of the observations at or above their threshold; thresholds is a table of one row a cell."""
    return stream.withWatermark("ts", delay).join(thresholds, "cell").where(F.col(value) >= F.col("threshold")).select("ts", "cell")


def stream_window_counts(exceeding: DataFrame, length: str = "1 day") -> DataFrame:
    """(start, cell, n): exceedances in tumbling windows, emitted when the watermark has passed them."""
    return exceeding.groupBy(F.window("ts", length), "cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "cell", "n")


def stream_joint(exceeding_late: DataFrame, exceeding_early: DataFrame, lag: str) -> DataFrame:
    """(ts, i, j): i exceeds ``lag`` after j, on one time grid.  Both sides carry watermarks; the time bounds limit the state to ``lag``."""
    late = exceeding_late.select(F.col("ts").alias("late_ts"), (F.col("ts") - F.expr(f"interval {lag}")).alias("tau"), F.col("cell").alias("i"))
    early = exceeding_early.select(F.col("ts").alias("early_ts"), F.col("cell").alias("j"))
    same = F.expr(f"tau = early_ts and late_ts >= early_ts and late_ts <= early_ts + interval {lag}")
    return late.join(early, same).select(F.col("late_ts").alias("ts"), "i", "j")


def add_counts(batch: DataFrame, folder: str, batch_id: int) -> None:
    """foreachBatch sink: this batch's joint counts as a partition of its own, so that a repeated batch replaces itself."""
    batch.groupBy("i", "j").agg(F.count(F.lit(1)).alias("hits")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
