"""Lagged dependence graphs: sparse joint exceedance counts for every ordered pair of cells.

Only rows at or above the threshold are compared, so the work follows (cells * (1 - p))^2 per step instead of
cells^2.  Pairs are counted where two blocks of cells meet; storms, steps with very many simultaneous extremes, are dealt out by that too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import check_lag, check_share, window_length
from .tail import exceeds, theta


def exceedances(ecdf: DataFrame, p: float) -> DataFrame:
    check_share(p)
    return ecdf.where(exceeds("u", p)).select("t", "cell")


#: Cells of a block of the earlier side (nearly always below 256, so that a written result takes a byte for j), and of the later side at most; exceedances in either's lists at most, steps counted at once.
HIT_CELLS, LATE_CELLS, LIST_STEPS, HIT_STEPS = 224, 65_536, 4_194_304, 16_384
#: Hits, and pairs, that a task counts at once.
SLAB = 262_144


def joint_hits(ecdf: DataFrame, lag: int, start: int, end: int, p: float, rows: DataFrame | None = None, salt: int = 1) -> DataFrame:
    """(i, j, hits) of the pairs with a hit: i exceeds at tau + lag, j at tau, tau in [start, end - lag).

    Cells become lists of their exceedances, and lists blocks (``salt`` at least on the earlier side), each one row.  Every block of one side meets every block of the other in a
    cross join, which reads what was shuffled again and writes nothing: lists are shuffled once, whatever the number of blocks, and no row of a pair and step is ever made.
    Only where the window has more than HIT_STEPS steps are counts of pairs summed up by a shuffle.
    """
    check_lag(lag)
    n = window_length(start, end, lag)
    over = exceedances(ecdf, p)
    late = over.where((F.col("t") >= start + lag) & (F.col("t") < end)).select((F.col("t") - lag - start).alias("x"), "cell")
    if rows is not None:
        late = late.join(rows.select("cell"), "cell", "left_semi")
    early = over.where((F.col("t") >= start) & (F.col("t") < end - lag)).select((F.col("t") - start).alias("x"), "cell")
    cells, together, spans = ecdf.select("cell").distinct().count(), max(1, int(LIST_STEPS / (n * (1 - p)))), -(-n // HIT_STEPS)
    kind = ecdf.schema["cell"].dataType.simpleString()

    def dealt(part: DataFrame, blocks: int, side: str) -> DataFrame:
        by_cell = part.groupBy("cell", F.expr(f"x div {HIT_STEPS}").alias("span")).agg(F.array_sort(F.collect_list(F.expr(f"cast(x % {HIT_STEPS} as int)"))).alias("x"))
        lists = by_cell.select("cell", "span", "x", F.xxhash64("x").alias("like"), F.pmod(F.xxhash64("cell"), F.lit(blocks)).cast("int").alias("block"))
        packed = lists.repartitionById(blocks, "block").groupBy("block", "span").applyInArrow(_block, f"span long, cells array<{kind}>, sizes binary, x binary")
        return packed.toDF(*[f"{side}_{c}" for c in packed.columns])

    a = dealt(late, max(1, -(-cells // min(LATE_CELLS, together))), "late")
    b = dealt(early, max(1, salt, -(-cells // min(HIT_CELLS, together))), "early")
    met = a.hint("shuffle_replicate_nl").join(b, F.col("late_span") == F.col("early_span"))
    counts = met.mapInArrow(_hits_of_blocks, f"i {kind}, j {kind}, hits long")
    return counts if spans == 1 else counts.groupBy("i", "j").agg(F.sum("hits").alias("hits"))


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a block's lists, equal ones beside each other: a written result repeats itself there."""
    import numpy as np

    rows = pa.Table.from_batches(batches)
    rows = rows.take(pa.array(np.argsort(rows["like"].to_numpy(), kind="stable")))
    sizes = pc.list_value_length(rows["x"]).to_numpy().astype(np.int32)
    x = pc.list_flatten(rows["x"]).to_numpy().astype(np.int32)
    cells = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays(rows["cell"].chunks))
    yield pa.RecordBatch.from_arrays([rows["span"].slice(0, 1).combine_chunks(), cells, pa.array([sizes.tobytes()]), pa.array([x.tobytes()])], names=["span", "cells", "sizes", "x"])


def _hits_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, hits) between the cells of two blocks; a cell's row counts as often as it is there.  Rows of as many hits stand together, within them those of a cell i."""
    import numpy as np

    for batch in batches:
        for row in range(len(batch)):
            (late, late_sizes, late_x), (early, early_sizes, early_x) = (
                (batch[f"{side}_cells"][row].values, *(np.frombuffer(batch[f"{side}_{c}"][row].as_buffer(), np.int32) for c in ("sizes", "x"))) for side in ("late", "early")
            )
            place = np.repeat(np.arange(len(early)), early_sizes)[np.argsort(early_x, kind="stable")]  # by step
            at = np.bincount(early_x, minlength=late_x.max() + 1)
            n, first = at[late_x], (np.cumsum(at) - at)[late_x]  # of each later exceedance: the earlier ones it meets
            done = np.concatenate([[0], np.cumsum(n)])
            own = np.concatenate([[0], np.cumsum(late_sizes)])
            before, bits, k = done[own], (len(early) - 1).bit_length(), 0
            while k < len(late):
                to = max(k + 1, min(k + (SLAB >> bits), np.searchsorted(before, before[k] + SLAB, "right") - 1))
                u, v = own[k], own[to]
                i = np.repeat(np.repeat(np.arange(to - k), late_sizes[k:to]), n[u:v])
                j = place[np.arange(before[k], before[to]) + np.repeat(first[u:v] - done[u:v], n[u:v])]
                counts = np.bincount((i << bits) + j)
                found = np.flatnonzero(counts)
                if len(found):
                    hits = counts[found]
                    order = np.argsort(hits.astype(np.uint16) if hits.max() < 1 << 16 else hits, kind="stable")
                    i, j = found[order] >> bits, found[order] & ((1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays([late.take(pa.array(i + k)), early.take(pa.array(j)), pa.array(hits[order])], names=["i", "j", "hits"])
                k = to


def pair_domain(cells: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Every (row cell, cell): the dense output the graph is defined on."""
    rows = cells if rows is None else rows
    return rows.select(F.col("cell").alias("i")).crossJoin(cells.select(F.col("cell").alias("j")))


def lag_graph(ecdf: DataFrame, cells: DataFrame, lag: int, start: int, end: int, p: float = 0.95, rows: DataFrame | None = None, prune_below: float | None = None, full: bool = True, salt: int = 1, domain: DataFrame | None = None, steps: Column | None = None) -> DataFrame:
    """edge(i, j, hits, n, chi).  domain: the pairs of the dense graph, where they are not all; steps: n by i, where it differs.  rows: the land cells (default all).  full=False leaves out pairs without a hit.

    prune_below sets smaller chi to 0.  Non-land rows are not part of the result (they are zero by definition).
    """
    n = window_length(start, end, lag) if steps is None else steps
    hits = joint_hits(ecdf, lag, start, end, p, rows, salt)
    out = (pair_domain(cells, rows) if domain is None else domain).join(hits, ["i", "j"], "left") if full else hits
    hits_ = F.coalesce("hits", F.lit(0))
    chi = hits_ / F.lit(n) / (1 - p)
    if prune_below is not None:
        chi = F.when(chi < prune_below, 0.0).otherwise(chi)
    return out.select("i", "j", hits_.cast("bigint").alias("hits"), F.lit(n).cast("bigint").alias("n"), chi.alias("chi"))


#: Cells of a block of the dense graph: two blocks of series are compared in one task.
BLOCK_CELLS = 128


def madogram_graph(ecdf: DataFrame, lag: int, start: int, end: int, rows: DataFrame | None = None) -> DataFrame:
    """(i, j, theta, chi = 2 - min(theta, 2)): the dense counterpart, over all aligned steps known on both sides.

    Series become arrays, dealt to blocks of BLOCK_CELLS cells; a task holds two blocks, and no row of a pair and step is ever made.
    """
    import numpy as np
    import pandas as pd

    check_lag(lag)
    n = window_length(start, end, lag)
    late = ecdf.where((F.col("t") >= start + lag) & (F.col("t") < end)).select((F.col("t") - lag - start).alias("x"), "cell", "u")
    if rows is not None:
        late = late.join(rows.select("cell"), "cell", "left_semi")
    early = ecdf.where((F.col("t") >= start) & (F.col("t") < end - lag)).select((F.col("t") - start).alias("x"), "cell", "u")

    def series(part: DataFrame, own: str, other: str, blocks: int) -> DataFrame:
        known = part.where("u is not null").groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("x", "u"))).alias("s"))
        dealt = known.select("cell", F.col("s.x").alias("x"), F.col("s.u").alias("u"), F.pmod(F.xxhash64("cell"), F.lit(blocks)).alias(own))
        return dealt.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    cells = ecdf.select("cell").distinct().count()
    blocks = -(-cells // BLOCK_CELLS) or 1

    def matrix(pdf: pd.DataFrame) -> np.ndarray:
        out = np.full((len(pdf), n), np.nan)
        for k, (x, u) in enumerate(zip(pdf["x"], pdf["u"], strict=True)):
            out[k, np.asarray(x, np.int64)] = u
        return out

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        left, right, out = matrix(a), matrix(b), [pd.DataFrame({"i": [], "j": [], "m": []})]
        for k, i in enumerate(a["cell"]):
            apart = np.abs(right - left[k])
            there = np.isfinite(apart)
            count = there.sum(axis=1)
            out.append(pd.DataFrame({"i": i, "j": b["cell"].to_numpy(), "m": np.where(there, apart, 0).sum(axis=1) / np.maximum(count, 1)})[count > 0])
        return pd.concat(out)

    both = series(late, "p", "q", blocks).withColumn("side", F.lit(0)).unionByName(series(early, "q", "p", blocks).withColumn("side", F.lit(1)))
    pairs = both.groupBy("p", "q").applyInPandas(compared, "i long, j long, m double")
    return pairs.select("i", "j", theta(F.col("m")).alias("theta")).withColumn("chi", 2 - F.least("theta", F.lit(2.0)))


def bitset_hits(ecdf: DataFrame, paths: DataFrame, node_offsets: list[int], start: int, end: int, p: float) -> DataFrame:
    """(path, hits) for given tuples by packed exceedance times: for many nodes, where joins would fan out.

    node k reads [start + offset_k, ...); end is the end of tau.
    """
    over = exceedances(ecdf, p)
    words = (end - start + 62) // 63
    series = {}
    for k, o in enumerate(node_offsets):
        tau = over.where((F.col("t") >= start + o) & (F.col("t") < end + o)).select("cell", (F.col("t") - o - start).alias("x"))
        packed = tau.groupBy("cell", F.expr("x div 63").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 63 as int))")).alias("b"))
        full = packed.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("w", "b"))).alias("m"))
        bits = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.coalesce(F.try_element_at("m", w.cast("bigint")), F.lit(0).cast("bigint")))
        series[k] = full.select(F.col("cell").alias(f"n{k}"), bits.alias(f"b{k}"))
    out = paths.select("path", *[F.col("path")[k].alias(f"n{k}") for k in range(len(node_offsets))])
    for k, s in series.items():
        out = out.join(s, f"n{k}", "left")
    none = F.array_repeat(F.lit(0).cast("bigint"), words)
    joint = F.coalesce("b0", none)
    for k in range(1, len(node_offsets)):
        joint = F.zip_with(joint, F.coalesce(f"b{k}", none), lambda a, b: a.bitwiseAND(b))
    return out.select("path", F.aggregate(joint, F.lit(0).cast("bigint"), lambda acc, x: acc + F.bit_count(x)).alias("hits"))
