"""Chains of d nodes: which cells exceed one after the other, station by station or region by region.

All stations run in one plan, keyed by ``origin``.  For each d the sampled node lists are chained by equi-joins on
the aligned step tau, so only steps at which the whole prefix exceeds go on; the last node is any cell.  Only tuples that
meet are ever rows: how many there are in all is a product of list sizes, and the others have 0 hits.  Hits are
integers until the very end, so images, thresholds and ties are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import check_lags, check_percent, window_length
from ..storage import discard, stored
from . import storms
from .graph import exceedances
from .lags import offsets
from .paths import image_selection


@dataclass
class Cubes:
    """Several cubes in one plan: cube k has the cells from k * cells_each on, its steps are moved by k * steps_each, and its window is [0, ends[k])."""

    cells_each: int
    steps_each: int
    ends: list[int]

    def of(self, cell: str) -> Column:
        return F.expr(f"{cell} div {self.cells_each}").cast("int")

    def windowed(self, table: DataFrame) -> DataFrame:
        """The rows (t, cell) of each cube's own window: what starts and ends in it needs no other limits."""
        end = F.element_at(F.array(*map(F.lit, self.ends)), self.of("cell") + 1)
        return table.where(F.col("t") - self.of("cell") * F.lit(self.steps_each) < end)

    def steps(self, cell: str, total: int) -> Column:
        """Aligned steps of a cell's cube."""
        for end in self.ends:
            window_length(0, end, total)
        return F.element_at(F.array(*[F.lit(end - total) for end in self.ends]), self.of(cell) + 1)


def beside(rows: DataFrame, cells: DataFrame, cubes: Cubes | None = None) -> DataFrame:
    """Every row with every cell (of its own cube): dense results have this size by definition."""
    if cubes is None:
        return rows.crossJoin(cells.select("cell"))
    return rows.withColumn("__cube", cubes.of("origin")).join(cells.select("cell", cubes.of("cell").alias("__cube")), "__cube").drop("__cube")


@dataclass
class Step:
    """What one d found."""

    d: int
    n: int | Column
    p: float
    lists: list[DataFrame]  # (origin, cell) of each node but the last
    cells: DataFrame
    hits: DataFrame  # origin, path, hits: the tuples that meet
    image: DataFrame  # origin, cell, count, chi_mean, chi_var
    best: DataFrame  # origin, path, hits, chi
    cubes: Cubes | None = None

    @property
    def combos(self) -> DataFrame:
        """(origin, path, hits, chi) of every tuple, those that never meet too: the product of the lists and all cells."""
        every = beside(tuples(self.lists), self.cells, self.cubes).select("origin", F.array_append("path", F.col("cell")).alias("path"))
        out = every.join(self.hits, ["origin", "path"], "left").select("origin", "path", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
        return out.withColumn("chi", chi_of(F.col("hits"), self.n, self.p))


@dataclass
class Exploration:
    steps: dict[int, Step] = field(default_factory=dict)
    history: list[tuple[int, int, int, float]] = field(default_factory=list)  # d, iteration, clusters that took part, the largest error
    rounds: list[DataFrame] = field(default_factory=list)  # origin, d, iteration, rates, error

    def history_table(self, spark: SparkSession) -> DataFrame:
        """(origin, d, iteration, rates, error): one row for each round that a cluster took part in; its first round of a d has no error."""
        if not self.rounds:
            return spark.createDataFrame([], "origin long, d int, iteration int, rates array<double>, error double")
        return reduce(DataFrame.unionByName, self.rounds)


def joint_steps(over: DataFrame, lists: Sequence[DataFrame], lags: Sequence[int], start: int, end: int, stormy: DataFrame | None = None) -> DataFrame:
    """(origin, path, tau, old) at which all nodes of a prefix exceed.  lists: one (origin, cell, old) table for each node; a prefix is old if all its nodes are.

    stormy: the steps that ``storms`` found.
    """
    d = len(lists) + 1
    placed = offsets(lags, d)
    total = placed[-1][0]
    out = None
    for k, (nodes, (o, _)) in enumerate(zip(lists, placed, strict=False)):
        own = over.select((F.col("t") - o).alias("tau"), "cell").where((F.col("tau") >= start) & (F.col("tau") < end - total))
        here = nodes.join(own, "cell").select("origin", "cell", "tau", F.col("old").alias("too"))
        if out is None:
            out = here.select("origin", F.array("cell").alias("path"), "tau", F.col("too").alias("old"))
        else:
            sides = storms.placed(stormy, [x for x, _ in placed[:k]]), storms.placed(stormy, [o])
            out = storms.joined(out, here, ["origin", "tau"], *sides, F.col("path"), F.col("cell")).select("origin", F.array_append("path", F.col("cell")).alias("path"), "tau", (F.col("old") & F.col("too")).alias("old"))
    return out


def tuples(lists: Sequence[DataFrame]) -> DataFrame:
    """(origin, path): the product of the node lists of each origin."""
    out = lists[0].select("origin", F.array("cell").alias("path"))
    for nodes in lists[1:]:
        out = out.join(nodes.select("origin", "cell"), "origin").select("origin", F.array_append("path", F.col("cell")).alias("path"))
    return out


def prefix_counts(lists: Sequence[DataFrame]) -> DataFrame:
    """(origin, count, first): the number of prefixes of each origin, and the first one; an origin without an entry in every list has none."""
    out = None
    for k, nodes in enumerate(lists):
        own = nodes.groupBy("origin").agg(F.count(F.lit(1)).alias(f"n{k}"), F.min("cell").alias(f"c{k}"))
        out = own if out is None else out.join(own, "origin")
    n = F.col("n0")
    for k in range(1, len(lists)):
        n = n * F.col(f"n{k}")
    return out.select("origin", n.alias("count"), F.array(*[f"c{k}" for k in range(len(lists))]).alias("first"))


def chi_of(hits, n: int, p: float):
    return hits / F.lit(n) / (1 - p)


def met(steps: DataFrame, over: DataFrame, lags: Sequence[int], d: int, stormy: DataFrame | None = None) -> DataFrame:
    """(origin, path of d nodes, hits): prefixes at their joint steps with every cell that exceeds as the last node."""
    placed = [x for x, _ in offsets(lags, d)]
    last = over.select((F.col("t") - placed[-1]).alias("tau"), F.col("cell").alias("last"))
    sides = storms.placed(stormy, placed[:-1]), storms.placed(stormy, placed[-1:])
    found = storms.joined(steps, last, ["tau"], *sides, F.struct("origin", "path"), F.col("last")).groupBy("origin", "path", "last").agg(F.count(F.lit(1)).alias("hits"))
    return found.select("origin", F.array_append("path", F.col("last")).alias("path"), "hits")


def evaluate(over: DataFrame, lists: Sequence[DataFrame], lags: Sequence[int], start: int, end: int, stormy: DataFrame | None = None) -> DataFrame:
    """(origin, path of d nodes, hits) of the tuples that meet, last nodes being all cells; prefixes that are old are passed over."""
    return met(joint_steps(over, lists, lags, start, end, stormy).where(~F.col("old")), over, lags, len(lists) + 1, stormy)


def sums_of(hits: DataFrame) -> DataFrame:
    """(origin, cell, s, q): sums of hits and of their squares by last cell."""
    return hits.groupBy("origin", F.element_at("path", -1).alias("cell")).agg(F.sum("hits").alias("s"), F.sum(F.col("hits") * F.col("hits")).alias("q"))


def image_of(sums: DataFrame, counts: DataFrame, cells: DataFrame, n: int | Column, p: float, cubes: Cubes | None = None) -> DataFrame:
    """Count, mean and population variance of chi by origin and last cell, from integer sums; tuples that never meet count with 0."""
    every = beside(counts.select("origin", "count"), cells, cubes)  # the image itself has this size
    full = every.join(sums, ["origin", "cell"], "left").select("origin", "cell", "count", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("s", "q")])
    mean = F.col("s") / F.col("count") / F.lit(n) / (1 - p)
    var = (F.col("count") * F.col("q") - F.col("s") * F.col("s")) / (F.col("count") * F.col("count")) / F.pow(F.lit(n) * (1 - p), F.lit(2))
    return full.select("origin", "cell", "count", "s", "q", mean.alias("chi_mean"), var.alias("chi_var"))


def best_of(hits: DataFrame, counts: DataFrame, cells: DataFrame, n: int | Column, p: float, cubes: Cubes | None = None) -> DataFrame:
    """The tuple with the most hits of each origin; ties, and origins whose tuples never meet, go to the first in product order."""
    most = hits.groupBy("origin").agg(F.min(F.struct((-F.col("hits")).alias("h"), "path")).alias("b")).select("origin", "b.path", (-F.col("b.h")).alias("hits"))
    first = cells.groupBy(*([cubes.of("cell").alias("c")] if cubes else [])).agg(F.min("cell").alias("cell")).select("cell")  # one row a cube
    none = beside(counts, F.broadcast(first), cubes)
    out = none.join(most, "origin", "left").select("origin", F.coalesce("path", F.array_append("first", F.col("cell"))).alias("path"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"))
    return out.withColumn("chi", chi_of(F.col("hits"), n, p))


def peak_cells(image: DataFrame) -> DataFrame:
    """The cell with the largest mean of each origin's image, the first on ties."""
    return image.where("chi_mean is not null").groupBy("origin").agg(F.min(F.struct((-F.col("chi_mean")).alias("m"), F.col("cell"))).alias("b")).select("origin", F.col("b.cell").alias("cell"))


def _sampled(nodes: DataFrame, rate: float, seed: int, before: float = 0.0, order: Column | None = None) -> DataFrame:
    """(origin, cell, old): the first floor(n * rate) nodes of each origin in a hashed order; old: among the first floor(n * before) too."""
    if rate < 0:
        raise ValueError("a sampling rate is not negative")
    if rate >= 1 and (before <= 0 or before >= 1):
        return nodes.select("origin", "cell", F.lit(before >= 1).alias("old"))
    w = Window.partitionBy("origin")
    first = order if order is not None else F.xxhash64("cell", F.lit(seed))
    placed = nodes.select("origin", "cell", F.count(F.lit(1)).over(w).alias("__n"), F.row_number().over(w.orderBy(first, "cell")).alias("__k"))
    among = lambda r: F.col("__k") <= F.floor(F.col("__n") * min(r, 1.0))
    return placed.where(among(rate)).select("origin", "cell", among(before).alias("old"))


def _sampled_by(nodes: DataFrame, rounds: DataFrame, k: int, rates: Sequence[Sequence[float]], seed: int, order: Column | None = None) -> DataFrame:
    """(origin, cell, old) as ``_sampled``, at each origin's own rate.  rounds: origin, now, before (numbers of rows of ``rates``, before null: nothing is old)."""
    own = F.array(*[F.lit(float(x[k])) for x in rates])
    told = nodes.join(rounds.select("origin", F.get(own, F.col("now")).alias("__rate"), F.coalesce(F.get(own, F.col("before")), F.lit(0.0)).alias("__had")), "origin")
    w = Window.partitionBy("origin")
    first = order if order is not None else F.xxhash64("cell", F.lit(seed))
    placed = told.select("origin", "cell", "__rate", "__had", F.count(F.lit(1)).over(w).alias("__n"), F.row_number().over(w.orderBy(first, "cell")).alias("__k"))
    among = lambda r: F.col("__k") <= F.floor(F.col("__n") * F.least(F.col(r), F.lit(1.0)))
    return placed.where(among("__rate")).select("origin", "cell", among("__had").alias("old"))


def prepare(ecdf: DataFrame, p: float = 0.95, keep: bool = True) -> tuple[DataFrame, DataFrame]:
    """(exceedances, cells), stored once for several explorations of one set of ranks."""
    hold = stored if keep else (lambda df, _: df)
    return hold(exceedances(ecdf, p), "exceedances"), hold(ecdf.select("cell").distinct(), "cells")


def first_lists(edges: DataFrame, stations: DataFrame, percent: float) -> list[DataFrame]:
    """(origin, cell) of the first two nodes: the station, and the cells whose chi with it lies above the percentile of its row."""
    first = edges.join(stations.select(F.col("cell").alias("i")), "i", "left_semi").select(F.col("i").alias("origin"), F.col("j").alias("cell"), "chi")
    return [stations.select(F.col("cell").alias("origin"), "cell"), image_selection(first, percent, "chi", ["origin"]).select("origin", "cell")]


def explore_stations(ecdf: DataFrame, edges: DataFrame, stations: DataFrame, d_max: int, lags: Sequence[int], start: int, end: int, p: float = 0.95, percent: float = 50.0, rates: Sequence[float] | None = None, seed: int = 7, keep: bool = True, prepared: tuple[DataFrame, DataFrame] | None = None, cubes: Cubes | None = None) -> Exploration:
    """Chains from every station at once.  stations: cell.  edges: i, j, chi of the lagged graph, with all cells as j.

    Node lists: the station; cells whose chi with it lies above the percentile (0-100 scale) of its row; for
    larger d the cells above the percentile of the image before.  ``rates[k]``: share of list k that is sampled (default 1).
    A list that comes out empty ends a station's search there.  cubes: ecdf holds several, each of which is searched by itself.
    """
    check_lags(list(lags), d_max)
    check_percent(percent)
    rates = list(rates or [1.0] * (d_max - 1))
    if len(rates) < d_max - 1:
        raise ValueError(f"{d_max} nodes need {d_max - 1} sampling rates")
    hold = stored if keep else (lambda df, _: df)
    over, cells = prepared or prepare(ecdf, p, keep)
    stormy = storms.storms(over)
    lists, out = first_lists(edges, stations, percent), Exploration()
    for d in range(3, d_max + 1):
        n = cubes.steps("origin", sum(lags[: d - 1])) if cubes else window_length(start, end, sum(lags[: d - 1]))
        own = [_sampled(x, rates[k], seed) for k, x in enumerate(lists)]
        counts = hold(prefix_counts(own), f"prefixes-{d}")
        hits = hold(evaluate(over, own, lags, start, end, stormy), f"hits-{d}")
        image = hold(image_of(sums_of(hits), counts, cells, n, p, cubes), f"image-{d}")
        out.steps[d] = Step(d, n, p, own, cells, hits, image, best_of(hits, counts, cells, n, p, cubes), cubes)
        lists.append(image_selection(image, percent, "chi_mean", ["origin"]).select("origin", "cell"))
    return out


def best_by_bound(over: DataFrame, lists: Sequence[DataFrame], cells: DataFrame, lags: Sequence[int], start: int, end: int, p: float, stormy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(best, steps): ``best_of`` all tuples without evaluating them all, and the rows (origin, path, tau) that met the last nodes.

    A prefix's joint steps bound the hits of every tuple that begins with it.  The prefix with the most steps of each origin, grown node by
    node, gives hits that the best tuple has at least; then, at every level, only prefixes with as many steps go on.
    """
    d = len(lists) + 1
    n, placed = window_length(start, end, sum(lags[: d - 1])), [x for x, _ in offsets(lags, d)]

    def extended(steps: DataFrame | None, k: int) -> DataFrame:
        own = over.select((F.col("t") - placed[k]).alias("tau"), "cell").where((F.col("tau") >= start) & (F.col("tau") < end - placed[-1]))
        here = lists[k].select("origin", "cell").join(own, "cell")
        if steps is None:
            return here.select("origin", F.array("cell").alias("path"), "tau")
        sides = storms.placed(stormy, placed[:k]), storms.placed(stormy, placed[k : k + 1])
        return storms.joined(steps, here, ["origin", "tau"], *sides, F.col("path"), F.col("cell")).select("origin", F.array_append("path", F.col("cell")).alias("path"), "tau")

    def counted(steps: DataFrame) -> DataFrame:
        return steps.groupBy("origin", "path").agg(F.count(F.lit(1)).alias("n"))

    steps = None
    for k in range(len(lists)):
        before, grown = steps, stored(extended(steps, k), "beam")
        first = counted(grown).groupBy("origin").agg(F.min(F.struct((-F.col("n")).alias("n"), "path")).alias("b")).select("origin", "b.path")
        steps = stored(grown.join(first, ["origin", "path"], "left_semi"), "beam")
        discard(before)
        discard(grown)
    bound = stored(met(steps, over, lags, d, stormy).groupBy("origin").agg(F.max("hits").alias("bound")), "bound")
    discard(steps)
    steps = None
    for k in range(len(lists)):
        before, grown = steps, stored(extended(steps, k), "steps")
        may = counted(grown).join(bound, "origin", "left").where(F.col("n") >= F.coalesce("bound", F.lit(0))).select("origin", "path")
        steps = stored(grown.join(may, ["origin", "path"], "left_semi"), "steps")
        discard(before)
        discard(grown)
    return best_of(met(steps, over, lags, d, stormy), prefix_counts(lists), cells, n, p), steps


def best_chains(ecdf: DataFrame, edges: DataFrame, stations: DataFrame, d_max: int, lags: Sequence[int], start: int, end: int, p: float = 0.95, percent: float = 50.0, rates: Sequence[float] | None = None, seed: int = 7) -> DataFrame:
    """(origin, path, hits, chi) as the best tuples of ``explore_stations`` at d_max, where its image is not needed: that d is searched by bounds."""
    prepared = prepare(ecdf, p)
    check_lags(list(lags), d_max)
    rates = list(rates or [1.0] * (d_max - 1))
    if d_max > 3:
        found = explore_stations(ecdf, edges, stations, d_max - 1, lags, start, end, p, percent, rates, seed, prepared=prepared)
        last = image_selection(found.steps[d_max - 1].image, percent, "chi_mean", ["origin"]).select("origin", "cell")
        lists = [*first_lists(edges, stations, percent), *(image_selection(s.image, percent, "chi_mean", ["origin"]).select("origin", "cell") for d, s in sorted(found.steps.items()) if d < d_max - 1), last]
    else:
        lists = first_lists(edges, stations, percent)
    own = [stored(_sampled(x, rates[k], seed), "nodes") for k, x in enumerate(lists)]
    return best_by_bound(prepared[0], own, prepared[1], lags, start, end, p, storms.storms(prepared[0]))[0]


def explore_regions(ecdf: DataFrame, members: DataFrame, centroids: DataFrame, d_max: int, lags: Sequence[int], start: int, end: int, rates: Sequence[float], p: float = 0.95, percent: float = 50.0, tolerance: float = 0.01, delta: float = 0.01, max_iter: int = 100, seed: int = 7, order: Column | None = None) -> Exploration:
    """Chains of clusters with growing samples; each cluster stops by itself once its mean image moves by at most ``tolerance``.

    members: origin (cluster), cell.  centroids: origin, cell, weight.  In each round of a d the lists of a cluster are sampled with
    rates that have grown by ``delta`` for each round it has taken part in, over all d, in one hashed order (or ``order``), so its samples grow and only
    tuples with a node that is new are joined; their hits are added to running integer sums.  A cluster leaves a d with its
    tolerance met, without a new tuple, with an empty list, or after ``max_iter`` rounds; those that have left are in no join of the later rounds.
    """
    check_lags(list(lags), d_max)
    check_percent(percent)
    if len(rates) < d_max - 1:
        raise ValueError(f"{d_max} nodes need {d_max - 1} sampling rates")
    over, cells = prepare(ecdf, p)
    stormy = storms.storms(over)
    lists = [members.select("origin", "cell"), image_selection(centroids, percent, "weight", ["origin"]).select("origin", "cell")]
    grown, out = [list(rates)], Exploration()  # rates after 0, 1, ... rounds
    taken = stored(members.select("origin").distinct().select("origin", F.lit(0).alias("taken")), "taken")
    for d in range(3, d_max + 1):
        n = window_length(start, end, sum(lags[: d - 1]))
        images, counts, found, kept = [], [], [], []
        active = taken.select("origin", F.col("taken").alias("now"), F.lit(None).cast("int").alias("before"), F.lit(0).cast("long").alias("had"))
        image = sums = went = None
        for k in range(max_iter):
            own = [_sampled_by(x, active, m, grown, seed, order) for m, x in enumerate(lists)]
            fresh = prefix_counts(own).join(active, "origin").where(F.col("count") > F.col("had"))
            fresh = stored(fresh.select("origin", "now", "before", "count", "first"), "prefixes")
            if image is not None:  # what is no longer new keeps its last image
                images.append(image.join(fresh, "origin", "left_anti"))
                counts.append(went.join(fresh, "origin", "left_anti"))
            if not fresh.take(1):
                image = None
                break
            own = [x.join(fresh.select("origin"), "origin", "left_semi") for x in own]
            found.append(stored(evaluate(over, own, lags, start, end, stormy), "hits"))
            added = sums_of(found[-1])
            both = added if sums is None else sums.join(fresh.select("origin"), "origin", "left_semi").unionByName(added)
            sums = stored(both.groupBy("origin", "cell").agg(*[F.sum(c).alias(c) for c in ("s", "q")]), "sums")
            was, image = image, stored(image_of(sums, fresh.select("origin", "count"), cells, n, p), "image")
            told = fresh.select("origin", "now", "count", "first")
            if was is None:
                told = told.withColumn("error", F.lit(None).cast("double"))
            else:
                moved = image.join(was.select("origin", "cell", F.col("chi_mean").alias("was")), ["origin", "cell"])
                told = told.join(moved.groupBy("origin").agg(F.avg(F.abs(F.col("chi_mean") - F.col("was"))).alias("error")), "origin", "left")
            went = stored(told, "rounds")
            kept += [image, sums, fresh]
            ran, worst = went.agg(F.count(F.lit(1)), F.max("error")).first()
            each = F.array(*[F.array(*[F.lit(float(r)) for r in x[: d - 1]]) for x in grown])
            out.rounds.append(went.select("origin", F.lit(d).alias("d"), F.lit(k).alias("iteration"), F.get(each, F.col("now")).alias("rates"), "error"))
            out.history.append((d, k, ran, float("inf") if worst is None else worst))
            grown.append([r + delta for r in grown[-1]])
            settled = F.coalesce(F.col("error") <= tolerance, F.lit(False))
            ended = went.where(settled).select("origin") if k + 1 < max_iter else went.select("origin")
            images.append(image.join(ended, "origin", "left_semi"))
            counts.append(went.join(ended, "origin", "left_semi"))
            going = went.join(ended, "origin", "left_anti")
            image, went = image.join(ended, "origin", "left_anti"), going
            active = going.select("origin", (F.col("now") + 1).alias("now"), F.col("now").alias("before"), F.col("count").alias("had"))
        if not found:
            break
        image = stored(reduce(DataFrame.unionByName, images), f"image-{d}")
        last = stored(reduce(DataFrame.unionByName, counts), f"counts-{d}")  # origin, now (rows of ``grown`` that its last round used), count, first
        ran = last.select("origin", "now", F.lit(None).cast("int").alias("before"))
        own = [_sampled_by(x, ran, m, grown, seed, order) for m, x in enumerate(lists)]
        hits = reduce(DataFrame.unionByName, found)
        out.steps[d] = Step(d, n, p, own, cells, hits, image, best_of(hits, last.select("origin", "count", "first"), cells, n, p))
        lists.append(image_selection(image, percent, "chi_mean", ["origin"]).select("origin", "cell"))
        before, taken = taken, stored(taken.join(last.select("origin", F.col("now").alias("__now")), "origin", "left").select("origin", F.coalesce(F.col("__now") + 1, "taken").alias("taken")), "taken")
        for df in [*kept, before]:
            discard(df)
    return out


def chain_nodes(found: Exploration) -> DataFrame:
    """(origin, nodes): the station and, for each d, the cell with the largest mean."""
    peaks = None
    for d, step in sorted(found.steps.items()):
        own = peak_cells(step.image).select("origin", F.lit(d).alias("d"), "cell")
        peaks = own if peaks is None else peaks.unionByName(own)
    tail = peaks.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("d", "cell"))).alias("x"))
    return tail.select("origin", F.concat(F.array("origin"), F.col("x.cell")).alias("nodes"))


def wkt_lines(nodes: DataFrame, grid: DataFrame, column: str = "nodes") -> DataFrame:
    """(origin, wkt): LINESTRING through the nodes, longitude first."""
    places = nodes.select("origin", F.posexplode(column).alias("k", "cell")).join(grid.select("cell", "lat", "lon"), "cell")
    point = F.struct("k", F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string")).alias("p"))
    return places.groupBy("origin").agg(F.array_sort(F.collect_list(point)).alias("x")).select("origin", F.concat(F.lit("LINESTRING("), F.array_join("x.p", ", "), F.lit(")")).alias("wkt"))


def wkt_points(nodes: DataFrame, grid: DataFrame, column: str = "nodes") -> DataFrame:
    places = nodes.select("origin", F.posexplode(column).alias("k", "cell")).join(grid.select("cell", "lat", "lon"), "cell")
    return places.select("origin", "k", F.concat(F.lit("POINT("), F.col("lon").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")).alias("wkt"))


def best_or_self(stations: DataFrame, best: DataFrame, d: int) -> DataFrame:
    """(origin, path): the best tuple; a station without one repeats itself d times."""
    own = stations.select(F.col("cell").alias("origin"))
    return own.join(best.select("origin", "path"), "origin", "left").select("origin", F.coalesce("path", F.array_repeat("origin", d)).alias("path"))
