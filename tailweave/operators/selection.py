"""Sampling, splitting, batching and sets: each with a stated order, so that reruns agree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import placed_values
from ..storage import stored


def hash_prefix(df: DataFrame, rate: float, key: Sequence[str] = ("cell",), by: Sequence[str] = (), seed: int = 0, order: Column | None = None) -> DataFrame:
    """The first floor(n * rate) rows of each group in a hashed order: larger rates keep what smaller ones took.

    ``order`` replaces the hash.  Rates of 1 and more keep all rows without a shuffle.
    """
    if rate < 0:
        raise ValueError("a sampling rate is not negative")
    if rate >= 1:
        return df
    first = order if order is not None else F.xxhash64(*key, F.lit(seed))
    if not by:
        return df.orderBy(first, *key).limit(int(df.count() * rate))
    w = Window.partitionBy(*by)
    return df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy(first, *key))).where(F.col("__k") <= F.floor(F.col("__n") * rate)).drop("__n", "__k")


def positional_split(df: DataFrame, share: float, order: str) -> DataFrame:
    """df with ``part``: 'train' where ``order`` is among the first floor(n * share) of its n distinct values, else 'validation'.

    The distinct values (dates) are few; the rows themselves are not sorted.
    """
    steps = df.select(order).distinct()
    k, n = F.row_number().over(Window.orderBy(order)), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    cut = steps.select(order, k.alias("__k"), n.alias("__n")).where(F.col("__k") <= F.floor(F.col("__n") * share)).agg(F.max(order).alias("__cut"))
    out = df.crossJoin(F.broadcast(cut))  # one row
    return out.withColumn("part", F.when(F.col(order) <= F.col("__cut"), "train").otherwise("validation")).drop("__cut")


def batched(df: DataFrame, size: int, order: str, by: Sequence[str] = ()) -> DataFrame:
    """df with ``batch``: consecutive runs of ``size`` rows in order (a number); without ``by`` rows are numbered within ranges of it, null last.

    Rows of equal order come in any order.
    """
    if not by:
        return in_batches(df, size, order)
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def in_batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """``batched`` of one long series: a value's rows are numbered among themselves, on from the rows below it."""
    placed = stored(placed_values(df, order), "placed")
    total, ranges = df.count(), Window.partitionBy("__part").orderBy("__value")
    known = df.withColumn("__value", F.col(order).cast("double"))
    least, most = placed.agg(F.min("value"), F.max("value")).first()
    shares = [k / 256 for k in range(1, 256)]
    cuts = placed.agg(F.percentile_approx("value", shares, 4096)).first()[0] if least is not None and least < most else None  # 255 numbers
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts or []))]).cast("array<double>"), lambda c: c < F.col("__value")))
    there = known.where("__value is not null and not isnan(__value)").withColumn("__part", part)
    sizes = placed.select("n", F.col("value").alias("__value")).withColumn("__part", part).groupBy("__part").agg(F.sum("n").alias("__n"))
    base = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # at most 256 rows
    rows = there.join(F.broadcast(base), "__part").withColumn("__row", F.col("__base") + F.row_number().over(ranges) - 1)
    unknown = known.where("__value is null or isnan(__value)")
    if unknown.take(1):
        n = total - (placed.agg(F.sum("n")).first()[0] or 0)
        rest = numbered(unknown, F.xxhash64(*df.columns), [])
        rows = rows.select(*df.columns, "__row").unionByName(rest.select(*df.columns, (F.col("__row") + (total - n)).alias("__row")))
    return rows.select(*df.columns, F.floor(F.col("__row") / size).alias("batch"))


def numbered(df: DataFrame, order: Column, key: Sequence[str], bits: int = 10) -> DataFrame:
    """df with ``__row``: 0, 1, ... by ``order`` (bigint, spread over its ``bits`` high bits, as hashes are), then ``key``.

    Rows are numbered within ranges of the order, whose totals (2 ** bits rows) carry the numbers before.
    """
    cut = df.withColumn("__order", order.cast("bigint")).withColumn("__range", F.shiftright("__order", 64 - bits))
    totals = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    base = totals.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__base"))  # 2 ** bits rows
    inside = F.row_number().over(Window.partitionBy("__range").orderBy("__order", *key)) - 1
    return cut.withColumn("__k", inside).join(F.broadcast(base), "__range").withColumn("__row", F.col("__base") + F.col("__k")).drop("__order", "__range", "__k", "__base")


def shuffled_batches(df: DataFrame, size: int, key: Sequence[str], seed: int = 7, order: Column | None = None) -> DataFrame:
    """df with ``batch``: runs of ``size`` rows in a hashed order (or ``order``) that reruns keep."""
    rows = numbered(df, order if order is not None else F.xxhash64(F.lit(seed), *key), key)
    return rows.withColumn("batch", F.floor(F.col("__row") / size)).drop("__row")


def dataset(df: DataFrame, training: bool, size: int = 32, seed: int = 7):
    """Iterator of row batches, shuffled by a hash for training; the driver holds two partitions at most."""
    rows = df.orderBy(F.xxhash64(F.lit(seed), *df.columns)) if training else df
    batch = []
    for row in rows.toLocalIterator(prefetchPartitions=True):
        batch.append(row)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch


def common_keys(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Values of ``key`` that every table has: one grouped count instead of a chain of joins."""
    tagged = reduce(DataFrame.unionAll, [t.select(key).distinct() for t in tables])
    return tagged.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(tables)).select(key)


def unseen(candidates: DataFrame, seen: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct candidates that have not been evaluated yet."""
    return candidates.dropDuplicates(list(key)).join(seen.select(*key), list(key), "left_anti")


def stacked(**runs: DataFrame) -> DataFrame:
    """Union of tables of one schema, tagged by run."""
    return reduce(DataFrame.unionByName, [df.withColumn("run", F.lit(name)) for name, df in runs.items()])


def nearest_cell(stations: DataFrame, grid: DataFrame) -> DataFrame:
    """stations(name, lat, lon) with the grid row and column nearest by latitude and longitude apart; ties go to the first."""
    axes_i = grid.groupBy("i").agg(F.min("lat").alias("g"))
    axes_j = grid.groupBy("j").agg(F.min("lon").alias("g"))

    def nearest(axis: DataFrame, index: str, coordinate: str) -> DataFrame:
        near = stations.select("name", F.col(coordinate).alias("x")).crossJoin(F.broadcast(axis))  # an axis has as many rows as the grid is high or wide
        return near.groupBy("name").agg(F.min_by(index, F.struct(F.pow(F.col("x") - F.col("g"), 2), F.col(index))).alias(index))

    return stations.join(nearest(axes_i, "i", "lat"), "name").join(nearest(axes_j, "j", "lon"), "name")


def on_land(stations: DataFrame, grid: DataFrame) -> DataFrame:
    """Stations whose nearest cell is land; the others are left out."""
    return stations.join(grid.where("is_land").select("i", "j", "cell"), ["i", "j"])
