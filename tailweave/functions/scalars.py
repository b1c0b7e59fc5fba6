"""Scalar expressions and small aggregates: coordinates, ranges, frames, names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles


def to_flat(i: Column, j: Column, width: int) -> Column:
    return i * width + j


def to_row(cell: Column, width: int) -> Column:
    return F.floor(cell / width)


def to_column(cell: Column, width: int) -> Column:
    return cell % width


def coordinate_key(i: Column, j: Column) -> Column:
    return F.struct(i.cast("bigint").alias("i"), j.cast("bigint").alias("j"))


def key_text(i: Column, j: Column) -> Column:
    """The bracketed text form of a coordinate, for exports."""
    return F.concat(F.lit("["), i.cast("string"), F.lit(" "), j.cast("string"), F.lit("]"))


def run_name(lags: Sequence[int], cell: Column) -> Column:
    """Name of a run: all its lags and its cell."""
    return F.concat(F.lit("lags_" + "_".join(map(str, lags)) + "_cell_"), cell.cast("string"))


def finite(x: Column) -> Column:
    """x, with NaN and infinities NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def safe_double(x: Column) -> Column:
    """x as a number; NULL where it is none."""
    return x.try_cast("double")


def finite_pairs(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Rows whose pair is finite on both sides."""
    return df.withColumn(y, finite(F.col(y))).withColumn(p, finite(F.col(p))).where(F.col(y).isNotNull() & F.col(p).isNotNull())


def zero_for_missing(x: Column) -> Column:
    return F.coalesce(finite(x), F.lit(0.0))


def finite_vectors(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has only finite elements."""
    return df.where(F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))


def value_range(df: DataFrame, value: str = "value", robust: bool = False, q: tuple[float, float] = (2, 98)) -> DataFrame:
    """One row (vmin, vmax): finite extremes, or the q percentiles."""
    x = df.select(finite(F.col(value)).alias("x"))
    if robust:
        return percentiles(x, "x", [q[0] / 100, q[1] / 100]).select(F.col("p0").alias("vmin"), F.col("p1").alias("vmax"))
    return x.agg(F.min("x").alias("vmin"), F.max("x").alias("vmax"))


def checked_range(df: DataFrame, **options) -> tuple[float, float]:
    vmin, vmax = value_range(df, **options).first()
    if vmin is None or vmax is None or vmin == vmax:
        raise ValueError("the values have no range")
    return vmin, vmax


def to_byte(x: Column, vmin: Column, vmax: Column) -> Column:
    """Clipped to the range and scaled to 0..255, truncated; NaN and NULL give 0, infinities the ends."""
    clipped = F.least(F.greatest(x, vmin), vmax)
    scaled = F.when(x.isNull() | F.isnan(x), 0.0).otherwise((clipped - vmin) / (vmax - vmin))
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def frames(cube: DataFrame, robust: bool = False) -> DataFrame:
    """(t, cell, pixel): the cube as 8-bit frames over its common range."""
    limits = value_range(cube, robust=robust)
    return cube.crossJoin(F.broadcast(limits)).select("t", "cell", to_byte(F.col("value"), F.col("vmin"), F.col("vmax")).alias("pixel"))  # one row


def extent(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min("lon").alias("west"), F.max("lon").alias("east"), F.min("lat").alias("south"), F.max("lat").alias("north"))


def frame_title(t: Column, stamp: Column | None = None, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), stamp if stamp is not None else F.concat(F.lit("t="), t.cast("string")))
