"""Forecast verification: every metric is an aggregate expression over (y_true, y_pred).

``bundle(df)`` gives one row, ``bundle(df, by=[...])`` one a group, in one pass over one shuffle.  Divisions by
zero and correlations of constants give NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored
from .ranks import average_rank, joint_ranks, percentiles
from .scalars import finite_pairs


def _y() -> Column:
    return F.col("y_true")


def _p() -> Column:
    return F.col("y_pred")


def _over(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _varies(x: Column) -> Column:
    return F.min(x) < F.max(x)


def correlation(x: Column, y: Column) -> Column:
    r = _over(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
    return F.when(_varies(x) & _varies(y), r)


def rmse() -> Column:
    return F.sqrt(F.avg(F.pow(_p() - _y(), F.lit(2))))


def mae() -> Column:
    return F.avg(F.abs(_p() - _y()))


def mse() -> Column:
    return F.avg(F.pow(_p() - _y(), F.lit(2)))


def bias() -> Column:
    return F.avg(_p() - _y())


def pearson() -> Column:
    return correlation(_y(), _p())


def nse() -> Column:
    return F.when(_varies(_y()), 1 - _over(F.sum(F.pow(_y() - _p(), F.lit(2))), F.count(F.lit(1)) * F.var_pop(_y())))


r2 = nse


def explained_variance() -> Column:
    return F.when(_varies(_y()), 1 - _over(F.var_pop(_y() - _p()), F.var_pop(_y())))


def mape(eps: float = 1e-8) -> Column:
    return F.avg(F.abs((_p() - _y()) / F.greatest(F.abs(_y()), F.lit(eps)))) * 100


def smape(eps: float = 1e-8) -> Column:
    return F.avg(F.abs(_p() - _y()) / F.greatest((F.abs(_y()) + F.abs(_p())) / 2, F.lit(eps))) * 100


def kge() -> Column:
    spread = _over(F.sqrt(F.var_pop(_p())), F.sqrt(F.var_pop(_y())))
    level = _over(F.avg(_p()), F.avg(_y()))
    two = F.lit(2)
    return 1 - F.sqrt(F.pow(pearson() - 1, two) + F.pow(spread - 1, two) + F.pow(level - 1, two))


def event_counts(threshold: float) -> dict[str, Column]:
    o, f = _y() >= threshold, _p() >= threshold
    return {"tp": F.count_if(o & f), "fp": F.count_if(~o & f), "fn": F.count_if(o & ~f), "tn": F.count_if(~o & ~f)}


def event_scores(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn, pod, far, csi, bias_score at values >= threshold; NULL where there is nothing to divide by."""
    counts = finite_pairs(df).groupBy(*by).agg(*[c.alias(n) for n, c in event_counts(threshold).items()])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0)
    return counts.select(
        *by, "tp", "fp", "fn", "tn", (tp / F.nullif(tp + fn, zero)).alias("pod"), (fp / F.nullif(tp + fp, zero)).alias("far"),
        (tp / F.nullif(tp + fp + fn, zero)).alias("csi"), ((tp + fp) / F.nullif(tp + fn, zero)).alias("bias_score"),
    )


SIMPLE: dict[str, Callable[[], Column]] = {
    "rmse": rmse, "mae": mae, "mse": mse, "mbe": bias, "pearson": pearson, "nse": nse, "r2": r2, "explained_variance": explained_variance, "mape": mape, "smape": smape, "kge": kge,
}


def metric_map(df: DataFrame, metrics: dict[str, Callable[[], Column]] | None = None, by: Sequence[str] = ("cell",)) -> DataFrame:
    """One row a group with each metric; a metric is a function that gives an aggregate over y_true and y_pred."""
    return finite_pairs(df).groupBy(*by).agg(*[m().alias(n) for n, m in (metrics or SIMPLE).items()])


def metric_reduce(df: DataFrame, metric: Callable[[], Column], reduce: str = "mean", by: Sequence[str] = ("cell",)) -> DataFrame:
    """The metric's map, or its mean or median over the map."""
    own = metric_map(df, {"value": metric}, by)
    if reduce == "map":
        return own
    if reduce not in ("mean", "median"):
        raise ValueError("reduce is 'mean', 'median' or 'map'")
    return own.agg((F.avg("value") if reduce == "mean" else F.median("value")).alias("value"))


def spearman(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks, ranked within each group."""
    own = finite_pairs(df)
    if by:
        ranked = own.select(*by, average_rank("y_true", by).alias("ry"), average_rank("y_pred", by).alias("rp"))
        return ranked.groupBy(*by).agg(correlation(F.col("ry"), F.col("rp")).alias("spearman"))
    middle = (F.col("total") + 1) / 2.0  # the mean of average ranks
    x, y, n = F.col("rx") - middle, F.col("ry") - middle, F.col("n")
    sums = joint_ranks(own, "y_true", "y_pred").agg(F.sum(x * y * n).alias("xy"), F.sum(x * x * n).alias("xx"), F.sum(y * y * n).alias("yy"))
    return sums.select((F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("spearman"))


def quantile_mae(df: DataFrame, q: float = 0.95, by: Sequence[str] = ()) -> DataFrame:
    """MAE over the pairs whose truth reaches its q-quantile."""
    own = finite_pairs(df)
    if by:
        limited = own.withColumn("__limit", F.percentile("y_true", F.lit(q)).over(Window.partitionBy(*by)))
    else:
        limited = own.crossJoin(F.broadcast(percentiles(own, "y_true", [q]).select(F.col("p0").alias("__limit"))))  # one row
    return limited.where(F.col("y_true") >= F.col("__limit")).groupBy(*by).agg(mae().alias("quantile_mae"))


def bivariate_chi(df: DataFrame, p: float, by: Sequence[str] = ()) -> DataFrame:
    """Share of pairs above both own p-percentiles, divided by 1 - p."""
    own = finite_pairs(df)
    if by:
        limits = own.groupBy(*by).agg(F.percentile("y_true", F.lit(p)).alias("__y"), F.percentile("y_pred", F.lit(p)).alias("__p"), F.count(F.lit(1)).alias("__n"))
        limited = own.join(limits, list(by))
    else:
        limits = percentiles(own, "y_true", [p]).select(F.col("p0").alias("__y")).crossJoin(percentiles(own, "y_pred", [p]).select(F.col("p0").alias("__p")))
        limited = own.crossJoin(F.broadcast(limits.crossJoin(own.agg(F.count(F.lit(1)).alias("__n")))))  # one row
    hit = (F.col("y_true") >= F.col("__y")) & (F.col("y_pred") >= F.col("__p"))
    counted = limited.groupBy(*by, "__n").agg(F.count_if(hit).alias("hits"))
    return counted.select(*by, (F.col("hits") / F.col("__n") / (1 - p)).alias("chi"))


def bundle(df: DataFrame) -> DataFrame:
    """One row: RMSE, MAE, MBE, Pearson, Spearman, NSE, KGE and chi at 90, 95 and 99 %."""
    out = finite_pairs(df).agg(*[SIMPLE[n]().alias(n) for n in ("rmse", "mae", "mbe", "pearson", "nse", "kge")]).crossJoin(spearman(df))
    for p in (0.90, 0.95, 0.99):
        out = out.crossJoin(bivariate_chi(df, p).withColumnRenamed("chi", f"chi{round(p * 100)}"))  # single rows
    return out


def kendall(df: DataFrame, by: Sequence[str] = ("cell",)) -> DataFrame:
    """Kendall's tau-b of each group by merge counting in O(n log n); NULL if a side is constant."""
    import numpy as np
    import pandas as pd

    def swaps(x: np.ndarray) -> int:
        """Pairs out of order, by stable merges of ever longer runs."""
        n, width, total = len(x), 1, 0
        while width < n:
            for a in range(0, n, 2 * width):
                left, right = x[a : a + width], x[a + width : a + 2 * width]
                total += int((len(left) - np.searchsorted(left, right, "right")).sum())
                x[a : a + 2 * width] = np.sort(x[a : a + 2 * width], kind="stable")
            width *= 2
        return total

    def tied(*columns: np.ndarray) -> int:
        n = pd.DataFrame({k: c for k, c in enumerate(columns)}).value_counts().to_numpy()
        return int((n * (n - 1) // 2).sum())

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        y, p = pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy()
        n, out = len(y), None
        both = n * (n - 1) // 2
        ty, tp = tied(y), tied(p)
        if both > ty and both > tp:
            order = np.lexsort((p, y))
            against = swaps(p[order].copy())
            with_ = both - ty - tp + tied(y, p) - against
            out = (with_ - against) / (((both - ty) * (both - tp)) ** 0.5)
        return pdf[list(by)].iloc[:1].assign(kendall=out)

    own = finite_pairs(df)
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in by)
    return own.groupBy(*by).applyInPandas(tau, f"{kinds}, kendall double")


#: Ranges of either column that one long series is cut into: one for each RANGE_PAIRS distinct pairs, MOST_RANGES at most.
RANGE_PAIRS, MOST_RANGES = 500_000, 1024


def ordered_pairs(x, y, n) -> int:
    """Sum of n_a * n_b over the pairs of rows that x and y order alike, minus those they order against each other.

    x, y: numpy arrays of distinct pairs, n their weights.  Runs of 64 rows are compared at once, longer ones merged.
    """
    import numpy as np

    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    wide = int(n.sum()) >= 1 << 31
    n = n[order].astype(object if wide else np.int64)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    sums, squares = np.add.reduceat(n, first), np.add.reduceat(n * n, first)
    total = -int(((sums * sums - squares) // 2).sum())  # rows of one x, counted below as if ordered alike
    width, rows = 64, len(x)
    for a in range(0, rows, width):
        v, w = y[a : a + width], n[a : a + width]
        total += int((np.triu(np.sign(v[None, :] - v[:, None]), 1) * w[:, None] * w[None, :]).sum())
        inside = np.argsort(v, kind="stable")
        y[a : a + width], n[a : a + width] = v[inside], w[inside]
    while width < rows:
        for a in range(0, rows - width, 2 * width):
            left, right = slice(a, a + width), slice(a + width, a + 2 * width)
            below = np.concatenate(([0], np.cumsum(n[left])))
            less, more = below[np.searchsorted(y[left], y[right], "left")], below[-1] - below[np.searchsorted(y[left], y[right], "right")]
            total += int((n[right] * (less - more)).sum())
            both = slice(a, a + 2 * width)
            inside = np.argsort(y[both], kind="stable")
            y[both], n[both] = y[both][inside], n[both][inside]
        width *= 2
    return total


def kendall_by_ranges(df: DataFrame) -> DataFrame:
    """One row (kendall): tau-b of one series of any length; NULL if a side is constant.

    Both columns are cut into ranges.  Pairs apart in both are counted from the totals of a grid of ranges (MOST_RANGES ** 2 numbers at most);
    pairs within a range of the one, of the other, and of both (taken off again) are counted by tasks that hold one
    range each.  A value of very many rows is a range of its own and needs no counting: its pairs are tied.
    """
    import numpy as np
    import pandas as pd
    from pyspark.ml.feature import Bucketizer

    own = finite_pairs(df).groupBy(F.col("y_true").cast("double").alias("x"), F.col("y_pred").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    own = stored(own, "pairs")
    parts = min(MOST_RANGES, 1 + own.count() // RANGE_PAIRS)
    shares = [k / parts for k in range(1, parts)] or [0.5]
    cuts = own.agg(*[F.percentile_approx(c, shares, 16 * parts) for c in "xy"]).first()
    for c, found in zip("xy", cuts, strict=True):
        often = {v for v in found or [] if found.count(v) > 1}
        splits = sorted({*(found or [0.0]), *(float(np.nextafter(v, np.inf)) for v in often)})
        own = Bucketizer(splits=[-np.inf, *splits, np.inf], inputCol=c, outputCol=f"r{c}").transform(own)
    own = stored(own, "ranges")
    grid = own.groupBy("rx", "ry").agg(F.sum("n").alias("n")).collect()  # at most MOST_RANGES ** 2 rows, by the number of ranges
    counts = np.zeros((1 + max((int(r["rx"]) for r in grid), default=0), 1 + max((int(r["ry"]) for r in grid), default=0)), object)
    for r in grid:
        counts[int(r["rx"]), int(r["ry"])] = r["n"]
    before = np.cumsum(counts, axis=0) - counts  # of smaller x
    upto = np.cumsum(before, axis=1)
    total = int((counts * ((upto - before) - (upto[:, -1:] - upto))).sum())

    def within(*ranges: str) -> int:
        spans = own.groupBy(*ranges).agg(*[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (("a", F.min), ("b", F.max))]).where("ax < bx and ay < by").select(*ranges)
        some = own.join(F.broadcast(spans), list(ranges), "left_semi")  # as many rows as ranges

        def counted(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"s": [str(ordered_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

        return int(some.groupBy(*ranges).applyInPandas(counted, "s string").agg(F.coalesce(F.sum(F.col("s").cast("decimal(38,0)")), F.lit(0))).first()[0])

    total += within("rx") + within("ry") - within("rx", "ry")
    weight = F.sum("n").cast("decimal(18,0)")
    pairs = lambda rows: int(rows.agg(F.coalesce(F.sum(F.col("w") * (F.col("w") - 1)), F.lit(0))).first()[0]) // 2
    every = int(own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    both, tx, ty = every * (every - 1) // 2, *(pairs(own.groupBy(c).agg(weight.alias("w"))) for c in "xy")
    tau = total / ((both - tx) * (both - ty)) ** 0.5 if both > tx and both > ty else None
    return own.sparkSession.createDataFrame([(tau,)], "kendall double")



def psnr(df: DataFrame, by: Sequence[str] = ("t",), peak: float | None = None) -> DataFrame:
    """20 log10(peak) - 10 log10(MSE) of each image; peak: largest |y_true| of the image plus 1e-6."""
    top = F.lit(peak) if peak is not None else F.max(F.abs(_y())) + 1e-6
    error = F.nullif(mse(), F.lit(0.0))
    return finite_pairs(df).groupBy(*by).agg((20 * F.log10(top) - 10 * F.log10(error)).alias("psnr"))


def gaussian(size: int, sigma: float = 1.5) -> list[float]:
    import math

    w = [math.exp(-((k - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for k in range(size)]
    return [x / sum(w) for x in w]


def ssim(df: DataFrame, height: int, width: int, peak: float = 1.0, size: int = 11, sigma: float = 1.5, by: Sequence[str] = ("t",)) -> DataFrame:
    """Mean structural similarity of each image over all full Gaussian windows.

    Images smaller than the window use the largest odd window that fits.  Pixels are dealt to the windows
    over them, so no image is handed to Python.
    """
    size = min(size, height - (height + 1) % 2, width - (width + 1) % 2)
    w = F.array(*map(F.lit, gaussian(size, sigma)))
    at = df.select(*by, F.expr(f"cell div {width}").alias("i"), (F.col("cell") % width).alias("j"), "y_true", "y_pred")
    rows = F.sequence(F.greatest(F.col("i") - size + 1, F.lit(0)), F.least(F.col("i"), F.lit(height - size)))
    columns = F.sequence(F.greatest(F.col("j") - size + 1, F.lit(0)), F.least(F.col("j"), F.lit(width - size)))
    spread = at.withColumn("oi", F.explode(rows)).withColumn("oj", F.explode(columns))
    weight = F.get(w, (F.col("i") - F.col("oi")).cast("int")) * F.get(w, (F.col("j") - F.col("oj")).cast("int"))
    a, b = _y(), _p()
    local = spread.withColumn("w", weight).groupBy(*by, "oi", "oj").agg(
        F.sum(F.col("w") * a).alias("ma"), F.sum(F.col("w") * b).alias("mb"), F.sum(F.col("w") * a * a).alias("aa"), F.sum(F.col("w") * b * b).alias("bb"), F.sum(F.col("w") * a * b).alias("ab")
    )
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = F.col("ma"), F.col("mb")
    light = (2 * ma * mb + c1) / (ma * ma + mb * mb + c1)
    shape = (2 * (F.col("ab") - ma * mb) + c2) / (F.col("aa") - ma * ma + F.col("bb") - mb * mb + c2)
    return local.groupBy(*by).agg(F.avg(light * shape).alias("ssim"))


def combined_loss(df: DataFrame, height: int, width: int, peak: float = 1.0, by: Sequence[str] = ("t",), **window) -> DataFrame:
    """0.4 MSE + 0.4 MAE + 0.2 (1 - SSIM) of each image."""
    simple = df.groupBy(*by).agg(mse().alias("mse"), mae().alias("mae"))
    both = simple.join(ssim(df, height, width, peak, by=by, **window), list(by))
    return both.select(*by, (0.4 * F.col("mse") + 0.4 * F.col("mae") + 0.2 * (1 - F.col("ssim"))).alias("loss"))


def group_metric_py(df: DataFrame, func: Callable, by: Sequence[str] = ("cell",)) -> DataFrame:
    """A metric given as a Python function of two arrays, group by group: only where no expression exists."""
    import pandas as pd

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[list(by)].iloc[:1].assign(value=float(func(pdf["y_true"].to_numpy(), pdf["y_pred"].to_numpy())))

    own = finite_pairs(df)
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in by)
    return own.groupBy(*by).applyInPandas(apply, f"{kinds}, value double")


def compared(**runs: DataFrame) -> DataFrame:
    """(metric, one column a run): metric rows of several runs side by side."""
    out = None
    for name, row in runs.items():
        own = row.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, row.columns)), F.array(*[F.col(c).cast("double") for c in row.columns]))).alias("metric", name))
        out = own if out is None else out.join(own, "metric")
    return out
