"""Tail dependence of columns: joint exceedance shares and madogram coefficients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ecdf_column, joint_ranks, known, percentiles
from ..schema import check_share


def exceeds(u: str | Column, p: float) -> Column:
    """u >= p, false for NULL and NaN."""
    u = F.col(u) if isinstance(u, str) else u
    return F.coalesce((u >= p) & ~F.isnan(u.cast("double")), F.lit(False))


def joint_chi(columns: Sequence[str], p: float) -> Column:
    """Aggregate: share of rows in which all columns reach p, divided by 1 - p.  All rows count."""
    check_share(p)
    hit = F.lit(True)
    for c in columns:
        hit = hit & exceeds(c, p)
    return F.count_if(hit) / F.nullif(F.count(F.lit(1)), F.lit(0)) / (1 - p)


def chi_of_raw(df: DataFrame, columns: Sequence[str], p: float, least: float | None = None) -> DataFrame:
    """One row (hits, n, chi): thresholds are the columns' own p-percentiles.

    Rows with a NULL or NaN in a column are left out.  With ``least`` only rows count as hits whose values all
    reach it, and thresholds come from those rows; n stays the number of rows before that.
    """
    check_share(p)
    full = df
    for c in columns:
        full = full.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    kept = full
    if least is not None:
        for c in columns:
            kept = kept.where(F.col(c) >= least)
    limits = None
    for k, c in enumerate(columns):
        own = percentiles(kept, c, [p]).select(F.col("p0").alias(f"__{k}"))
        limits = own if limits is None else limits.crossJoin(own)  # single rows
    hit = F.lit(True)
    for k, c in enumerate(columns):
        hit = hit & (F.col(c) >= F.col(f"__{k}"))
    hits = kept.crossJoin(F.broadcast(limits)).agg(F.count_if(hit).alias("hits"))  # limits: one row
    n = full.agg(F.count(F.lit(1)).alias("n"))
    return hits.crossJoin(F.broadcast(n)).select("hits", "n", (F.col("hits") / F.nullif("n", F.lit(0)) / (1 - p)).alias("chi"))


def theta(mean_difference: Column) -> Column:
    """F-madogram coefficient from the mean absolute difference of distribution values."""
    nu = 0.5 * mean_difference
    return (1 + 2 * nu) / F.nullif(1 - 2 * nu, F.lit(0.0))


def madogram(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """theta of two raw columns over the rows where both are known (neither NULL nor NaN), which alone are ranked; ``by``: one for each group, ranked by itself."""
    if not by:
        pairs = joint_ranks(df, x, y)
        apart = F.sum(F.abs(F.col("rx") - F.col("ry")) * F.col("n")) / F.max("total") / (F.max("total") + 1)
        return pairs.agg(theta(apart).alias("theta"))
    both = df.where(known(x).isNotNull() & known(y).isNotNull()).select(*by, F.col(x).alias("x"), F.col(y).alias("y"))
    ranked = both.select(*by, ecdf_column("x", by).alias("fx"), ecdf_column("y", by).alias("fy"))
    return ranked.groupBy(*by).agg(theta(F.avg(F.abs(F.col("fx") - F.col("fy")))).alias("theta"))
