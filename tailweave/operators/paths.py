"""Strongest links: percentile selection and flow vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.heavy import met
from ..functions.ranks import group_percentiles
from ..schema import check_percent, check_share
from ..storage import stored


def limited_by_ranges(rows: DataFrame, value: str, by: list[str], share: float) -> DataFrame:
    """rows with __limit, their group's percentile, where a group may be too long for one task."""
    limits = stored(group_percentiles(rows, value, by, share), "limits")
    total = limits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return met(rows, limits.withColumnRenamed("n", "__n").withColumnRenamed("limit", "__limit"), by, "__n", total).drop("__n")


def top_neighbors(edges: DataFrame, q: float = 0.99, strict: bool = False, value: str = "chi", by_ranges: bool = False) -> DataFrame:
    """(i, j, chi) with chi >= the row's q-percentile (linear interpolation); strict: above it.

    One shuffle by i: threshold and selection share it; by_ranges: no task holds a whole row of the graph.  A zero threshold keeps the
    whole row unless strict.
    """
    check_share(q)
    if by_ranges:
        limited = limited_by_ranges(edges, value, ["i"], q)
        return limited.where(F.col(value) > F.col("__limit") if strict else F.col(value) >= F.col("__limit")).select("i", "j", F.col(value).alias("chi"))
    limit = F.percentile(value, F.lit(q)).over(Window.partitionBy("i"))
    keep = F.col(value) > F.col("__limit") if strict else F.col(value) >= F.col("__limit")
    return edges.withColumn("__limit", limit).where(keep).select("i", "j", F.col(value).alias("chi"))


def image_selection(image: DataFrame, percent: float, value: str = "chi_mean", by: list[str] | None = None, by_ranges: bool = False) -> DataFrame:
    """Rows whose value lies above the image's percentile (0-100 scale: 0.99 is the 0.99th, not the 99th).

    ``by``: one image for each value of these columns; by_ranges: no task holds a whole image.  NULL values neither count nor stay.
    """
    check_percent(percent)
    known = image.where(F.col(value).isNotNull())
    if by and by_ranges:
        return limited_by_ranges(known, value, by, percent / 100).where(F.col(value) > F.col("__limit")).drop("__limit")
    limit = F.percentile(value, F.lit(percent / 100))
    if by:
        limited = known.withColumn("__limit", limit.over(Window.partitionBy(*by)))  # one shuffle by image
    else:
        limited = known.crossJoin(F.broadcast(known.agg(limit.alias("__limit"))))  # one row
    return limited.where(F.col(value) > F.col("__limit")).drop("__limit")


def percent(share: float) -> float:
    """A share as a sampling percentile: percent(0.99) is the 99th."""
    return share * 100


def _grid_of(edges: DataFrame, width: int) -> tuple[Column, Column, Column, Column]:
    return F.expr(f"i div {width}"), F.col("i") % width, F.expr(f"j div {width}"), F.col("j") % width


def flow_vectors(selected: DataFrame, width: int, by: Sequence[str] = ()) -> DataFrame:
    """path(i, i_c, j_c, u, v, max_chi) over the selected links of each cell.

    The centre is the mean position weighted by chi; the vector points from it to the cell, rows counted
    upwards.  A row whose weights sum to 0 has NULL everywhere.  ``by`` keeps graphs apart.
    """
    _, _, row, col = _grid_of(selected, width)
    agg = selected.withColumn("r", row).withColumn("c", col).groupBy(*by, "i").agg(
        F.nullif(F.sum("chi"), F.lit(0.0)).alias("w"), F.sum(F.col("r") * F.col("chi")).alias("wr"), F.sum(F.col("c") * F.col("chi")).alias("wc"), F.avg("chi").alias("m"), F.max("chi").alias("x")
    )
    i_c, j_c = F.col("wr") / F.col("w"), F.col("wc") / F.col("w")
    known = F.col("w").isNotNull()
    return agg.select(
        *by, "i", i_c.alias("i_c"), j_c.alias("j_c"), ((F.col("i") % width - j_c) * F.col("m")).alias("u"),
        ((i_c - F.expr(f"i div {width}")) * F.col("m")).alias("v"), F.when(known, F.col("x")).alias("max_chi"),
    )


def neighbor_map(selected: DataFrame) -> DataFrame:
    """(i, neighbors): the selected cells of each cell in ascending order."""
    return selected.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("neighbors"))
