"""Joins by step that survive storms: steps at which very many cells exceed at once.

A join on the step puts all rows of a step in one task.  Only steps of very many exceedances are dealt out, as a grid: one side's rows go
to one of a rows of the grid and to all its columns, the other's to one of its columns and to all rows.  All other steps
are joined as they are, and rows without a storm are neither copied nor moved by this.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Exceedances of a step that stay together; at most MOST_STORMS steps are storms (those above a MOST_STORMS-th of all rows).
TOGETHER, MOST_STORMS = 20_000, 100_000


def storms(over: DataFrame, together: int | None = None) -> DataFrame | None:
    """(t, parts) of the steps with more exceedances than stay together; None if there are none."""
    together = TOGETHER if together is None else together
    counts = over.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    limit = max(together, total[0] // MOST_STORMS)
    if total[1] <= limit:
        return None
    return counts.where(F.col("n") > limit).select("t", F.ceil(F.col("n") / together).cast("int").alias("parts"))


def placed(found: DataFrame | None, offsets: Sequence[int]) -> DataFrame | None:
    """(tau, parts): the largest number of parts among the steps tau + offset."""
    if found is None:
        return None
    every = reduce(DataFrame.unionAll, [found.select((F.col("t") - o).alias("tau"), "parts") for o in offsets])
    return every.groupBy("tau").agg(F.max("parts").alias("parts"))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], left_parts: DataFrame | None, right_parts: DataFrame | None, left_by: Column, right_by: Column) -> DataFrame:
    """The inner join of left and right on keys (tau is one), storms dealt out by hashes of left_by and right_by.

    left_parts, right_parts: (tau, parts) of either side's storms, MOST_STORMS rows for each offset at most.
    """
    if left_parts is None and right_parts is None:
        return left.join(right, list(keys))
    none = (left_parts if left_parts is not None else right_parts).limit(0)
    a, b = (none if x is None else x for x in (left_parts, right_parts))
    grid = a.withColumnRenamed("parts", "__a").join(b.withColumnRenamed("parts", "__b"), "tau", "full")
    grid = F.broadcast(grid.select("tau", F.coalesce("__a", F.lit(1)).alias("__a"), F.coalesce("__b", F.lit(1)).alias("__b")))  # storms only

    def dealt(df: DataFrame, own: str, by: Column, other: str) -> DataFrame:
        tagged = df.join(grid, "tau", "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"__{other}"), F.lit(1)) - 1))
        return tagged.withColumn(f"__{own}_", F.pmod(F.xxhash64(by), F.coalesce(F.col(f"__{own}"), F.lit(1))).cast("int")).withColumn(f"__{other}_", copies).drop("__a", "__b")

    return dealt(left, "a", left_by, "b").join(dealt(right, "b", right_by, "a"), [*keys, "__a_", "__b_"]).drop("__a_", "__b_")
