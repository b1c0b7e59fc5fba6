"""Pooling: every value is sent to the windows that cover it, then grouped.  Partial windows at the edges are dropped."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Functions that may be taken along rows and then along columns.
SEPARABLE = (F.max, F.min, F.sum)


def _covering(x: str, size: int, pool: int, stride: int) -> Column:
    """Ids of the windows over position x of an axis of ``size``."""
    out = (size - pool) // stride + 1
    first = F.greatest(F.ceil((F.col(x) - pool + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col(x) / stride), F.lit(out - 1))
    return F.when(first <= last, F.sequence(first, last))


def pool_2d(cube: DataFrame, height: int, width: int, pool: int, stride: int, func: Callable[[str], Column] = F.max, by: Sequence[str] = ("t",), value: str = "value") -> DataFrame:
    """(*by, oi, oj, value): func over each pool x pool window; ``by`` keeps images apart."""
    if pool > min(height, width) or stride < 1:
        raise ValueError("the pool is larger than the image, or the stride is below 1")
    at = cube.select(*by, F.expr(f"cell div {width}").alias("i"), (F.col("cell") % width).alias("j"), F.col(value).alias("value"))
    if func in SEPARABLE:
        # rows first, then columns: each value is copied 2 * pool / stride times, not its square
        rows = at.withColumn("oj", F.explode(_covering("j", width, pool, stride))).groupBy(*by, "i", "oj").agg(func("value").alias("value"))
        return rows.withColumn("oi", F.explode(_covering("i", height, pool, stride))).groupBy(*by, "oi", "oj").agg(func("value").alias("value")).select(*by, "oi", "oj", "value")
    spread = at.withColumn("oi", F.explode(_covering("i", height, pool, stride))).withColumn("oj", F.explode(_covering("j", width, pool, stride)))
    return spread.groupBy(*by, "oi", "oj").agg(func("value").alias("value"))


def pool_means(cube: DataFrame, height: int, width: int, pool: int, stride: int, by: Sequence[str] = ("t",), value: str = "value") -> DataFrame:
    """(*by, oi, oj, value): means over each window from integral images, so the work does not depend on the size of the pool.

    Running sums along rows, then along columns, are read at the four corners of a window.  Absent and NULL values don't count; a window
    without a value gives none.  Sums of large numbers lose what doubles lose; whole numbers below 2^53 in all are exact.
    """
    if pool > min(height, width) or stride < 1:
        raise ValueError("the pool is larger than the image, or the stride is below 1")
    keys, along = list(by), (Window.unboundedPreceding, Window.currentRow)
    known = cube.select(*by, F.expr(f"cell div {width}").alias("i"), (F.col("cell") % width).alias("j"), F.col(value).cast("double").alias("v")).where("v is not null")
    spine = known.select(*by).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1)).cast("array<bigint>"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)).cast("array<bigint>")))
    full = spine.join(known, [*keys, "i", "j"], "left").withColumn("n", F.when(F.col("v").isNotNull(), 1).otherwise(0))
    wide = Window.partitionBy(*keys, "i").orderBy("j").rowsBetween(*along)
    tall = Window.partitionBy(*keys, "j").orderBy("i").rowsBetween(*along)
    across = full.select(*by, "i", "j", F.sum(F.coalesce("v", F.lit(0.0))).over(wide).alias("s"), F.sum("n").over(wide).alias("n"))
    table = across.select(*by, "i", "j", F.sum("s").over(tall).alias("s"), F.sum("n").over(tall).alias("n"))

    def corner(name: str, size: int, ends: bool) -> Column:
        """The window that position x ends (its last row), or begins after (the row before its first), or null."""
        x = F.col(name) - (pool - 1) if ends else F.col(name) + 1
        return F.when((x >= 0) & (x % stride == 0) & (x <= size - pool), (x / stride).cast("long"))

    parts = F.array(*[
        F.struct(corner("i", height, a).alias("oi"), corner("j", width, b).alias("oj"), F.lit(1.0 if a == b else -1.0).alias("sign")) for a in (True, False) for b in (True, False)
    ])
    read = table.withColumn("c", F.explode(F.filter(parts, lambda c: c["oi"].isNotNull() & c["oj"].isNotNull())))
    sums = read.groupBy(*by, F.col("c.oi").alias("oi"), F.col("c.oj").alias("oj")).agg(F.sum(F.col("c.sign") * F.col("s")).alias("s"), F.sum(F.col("c.sign") * F.col("n")).alias("n"))
    return sums.where("n > 0").select(*by, "oi", "oj", (F.col("s") / F.col("n")).alias("value"))


def pool_1d(series: DataFrame, length: int, pool: int, stride: int, func: Callable[[str], Column] = F.max, by: Sequence[str] = ("cell",), at: str = "t", value: str = "value") -> DataFrame:
    """(*by, o, value): func over each window of ``pool`` steps."""
    if pool > length or stride < 1:
        raise ValueError("the pool is longer than the series, or the stride is below 1")
    return series.withColumn("o", F.explode(_covering(at, length, pool, stride))).groupBy(*by, "o").agg(func(value).alias("value"))


def pool_cube_py(cube: DataFrame, height: int, width: int, pool: int, stride: int, func: Callable) -> DataFrame:
    """pool_2d for a Python function of a list of values, where no aggregate expression exists (one window a group)."""
    at = cube.select("t", F.expr(f"cell div {width}").alias("i"), (F.col("cell") % width).alias("j"), "value")
    spread = at.withColumn("oi", F.explode(_covering("i", height, pool, stride))).withColumn("oj", F.explode(_covering("j", width, pool, stride)))

    @F.pandas_udf("double")
    def apply(v: pd.Series) -> float:
        return float(func(v.to_numpy()))

    return spread.groupBy("t", "oi", "oj").agg(apply("value").alias("value"))
