"""Regionalisation: KMeans over dependence rows, and scores of a clustering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from operator import and_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_vectors
from ..storage import stored
from .selection import hash_prefix

#: Vectors of a block (fewer, if they are long or clusters many): two blocks are compared in one task, tile by tile.
BLOCK, BLOCK_NUMBERS, TILE = 8_192, 8_000_000, 384
#: Squares below this share of the vectors' own have lost too many digits; rows of sums given out at once; tasks that pairs of blocks are dealt to.
CANCELLED, ROWS, MOST_TASKS = 1e-6, 200_000, 4096
#: Numbers of all centres that are broadcast to the tasks of a step; beyond, restarts go one after the other.
MOST_NUMBERS = 16_000_000
PIECE = 1024


def squares(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def dependence_rows(edges: DataFrame) -> DataFrame:
    """(id, x): each cell's row of the graph as a vector, columns in cell order."""
    return edges.groupBy(F.col("i").alias("id")).agg(F.array_sort(F.collect_list(F.struct("j", "chi"))).alias("r")).select("id", F.col("r.chi").alias("x"))


def centroids(points: DataFrame) -> DataFrame:
    """(label, size, centre, k clusters): means by position of each label's vectors."""
    flat = points.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("size"))
    return flat.groupBy("label").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).select("label", "size", F.col("c.m").alias("centre"))


def cluster_scores(points: DataFrame, sample: int | None = None, seed: int = 7) -> DataFrame:
    """One row for points(id, x, label): inertia, sdw, sdb, calinski, davies, silhouette.

    All distances are Euclidean.  The silhouette compares all pairs of points, or with ``sample`` all pairs of so many
    points chosen by a hash of the id.  Centroids, one a cluster, are broadcast.
    """
    given, points = points, points.select("id", F.transform("x", lambda v: v.cast("double")).alias("x"), "label")
    centres = stored(centroids(points), "centres")  # four steps read them
    whole = centroids(points.withColumn("label", F.lit(0))).select(F.col("centre").alias("middle"))
    own = points.join(F.broadcast(centres), "label").select("label", "size", squares(F.col("x"), F.col("centre")).alias("d2"))
    within = own.agg(F.sum("d2").alias("inertia"), F.sum(F.sqrt("d2")).alias("sdw"), F.count(F.lit(1)).alias("n"))
    apart = centres.crossJoin(F.broadcast(whole)).select("label", "size", squares(F.col("centre"), F.col("middle")).alias("b2"))
    between = apart.agg(F.sum(F.col("size") * F.sqrt("b2")).alias("sdb"), F.sum(F.col("size") * F.col("b2")).alias("between"), F.count(F.lit(1)).alias("k"))
    spread = own.groupBy("label").agg(F.avg(F.sqrt("d2")).alias("s")).join(centres, "label").select("label", "s", "centre")
    a, b = spread.alias("a"), F.broadcast(spread).alias("b")
    worst = a.join(b, F.col("a.label") != F.col("b.label")).groupBy("a.label").agg(
        F.max((F.col("a.s") + F.col("b.s")) / F.nullif(F.sqrt(squares(F.col("a.centre"), F.col("b.centre"))), F.lit(0.0))).alias("r")
    )
    davies = worst.agg(F.avg("r").alias("davies"))
    out = within.crossJoin(between).crossJoin(davies).crossJoin(silhouette(given, sample, seed))  # single rows
    calinski = (F.col("between") / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("inertia") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return out.select("inertia", "sdw", "sdb", calinski.alias("calinski"), "davies", "silhouette")


def silhouette(points: DataFrame, sample: int | None = None, seed: int = 7) -> DataFrame:
    """One row: mean of (b - a) / max(a, b) over points; points alone in their cluster count 0, and so do all if there is one cluster.

    ``sample``: only so many points, against each other.
    """
    return silhouettes(points, {0: F.col("label")}, sample, seed).agg(F.max("silhouette").alias("silhouette"))  # one row


def silhouettes(points: DataFrame, labels: Mapping[int, Column], sample: int | None = None, seed: int = 7) -> DataFrame:
    """(k, silhouette) for each of several clusterings of the same points(id, x, ...), whose distances are measured once.

    Points are dealt to blocks; each task holds two blocks, compares them tile by tile for both sides at once and gives one row for a point and cluster,
    so neither a matrix of all pairs nor all points ever come together.  The work is that of all pairs, by its nature; what
    is shuffled is each point once for each block.
    """
    import numpy as np

    n, width = points.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if sample is not None and n > sample:
        points, n = stored(hash_prefix(points, sample / n, ["id"], seed=seed), "sample"), sample
    own, by = [f"l{m}" for m in range(len(labels))], [f"o{m}" for m in range(len(labels))]
    labelled = points.select("id", "x", *[c.alias(o) for c, o in zip(labels.values(), own, strict=True)])
    codes = stored(labelled.select(*own).distinct().select(F.expr(f"row_number() over (order by {', '.join(own)})").alias("code"), *own), "labels")  # a row for each cluster
    same = reduce(and_, [F.col(f"p.{o}").eqNullSafe(F.col(f"c.{o}")) for o in own])
    coded = labelled.alias("p").join(F.broadcast(codes.alias("c")), same).select("id", "x", "code")
    blocks = max(1, -(-n // max(1, min(BLOCK, BLOCK_NUMBERS // max(1, width or 1, codes.count())))))
    dealt = coded.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    met = met.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "x", "code")
    kind = points.schema["id"].dataType.simpleString()

    def compared(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        rows = rows.take(pc.sort_indices(rows, [("own", "ascending"), ("code", "ascending")]))
        x = pc.list_flatten(rows["x"]).to_numpy().astype(float).reshape(len(rows), -1)
        code, first = rows["code"].to_numpy(), np.searchsorted(rows["own"].to_numpy(), key[1].as_py())
        a, b = (slice(0, None),) * 2 if key[0] == key[1] else (slice(0, first), slice(first, None))
        if not (len(code[a]) and len(code[b])):
            return
        sides = [(rows["id"][s.start : s.stop].combine_chunks(), code[s], *np.unique(code[s], return_counts=True)) for s in (a, b)]
        sums = distance_sums(x[a], x[b] if key[0] != key[1] else None, sides[0][1], sides[1][1])
        counts = [np.tile(sides[1 - k][3], (len(sides[k][1]), 1)) for k in (0, 1)]
        if key[0] == key[1]:  # pairs within a block come from one side; those of one id don't count
            sides, sums, ids = sides[:1], sums[:1], sides[0][0].dictionary_encode().indices.fill_null(-1).to_numpy()
            place, order = np.searchsorted(sides[0][2], sides[0][1]), np.argsort(ids, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
                for i in group:
                    np.subtract.at(counts[0][i], place[group], 1)
                    if len(group) > 1:
                        np.subtract.at(sums[0][i], place[group], np.sqrt(((x[group] - x[i]) ** 2).sum(axis=1)))
        for k, (ids, codes_, *_) in enumerate(sides):
            others = (sides[1 - k] if len(sides) > 1 else sides[0])[2]
            step = max(1, ROWS // len(others))
            for at in range(0, len(codes_), step):
                d, c = sums[k][at : at + step], counts[k][at : at + step]
                each = np.repeat(np.arange(at, at + len(d)), len(others))
                columns = [ids.take(pa.array(each)), pa.array(codes_[each]), pa.array(np.tile(others, len(d))), pa.array(d.ravel()), pa.array(c.ravel().astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "code", "by", "d", "n"])

    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2)  # by number: little data, much work
    parts = met.repartition(tasks, "p", "q").groupBy("p", "q").applyInArrow(compared, f"id {kind}, code int, by int, d double, n long")
    sums = parts.repartition("id").groupBy("id", "code", "by").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    if len(labels) > 1:
        sums = stored(sums, "distances")
    told = sums.join(F.broadcast(codes), "code").join(F.broadcast(codes.select(F.col("code").alias("by"), *[F.col(o).alias(b) for o, b in zip(own, by, strict=True)])), "by")
    out = None
    for k, label, other in zip(labels, own, by, strict=True):
        means = told.groupBy("id", label, other).agg((F.sum("d") / F.nullif(F.sum("n"), F.lit(0))).alias("m"))
        per = means.groupBy("id", label).agg(F.max(F.when(F.col(other) == F.col(label), F.col("m"))).alias("a"), F.min(F.when(F.col(other) != F.col(label), F.col("m"))).alias("b"))
        s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)))
        one = per.agg(F.avg(F.coalesce(s, F.lit(0.0))).alias("silhouette")).select(F.lit(k).alias("k"), "silhouette")
        out = one if out is None else out.unionAll(one)
    return out


def distance_sums(x, y, own, other) -> tuple:
    """Sums of the distances of each row of x to the rows of y with one code, and of each row of y to those of x; own and other are sorted codes.

    Without y each pair of rows of x is measured once, and both sums are those of x.  Squares come from one product of two tiles, which adds the
    rows' own squares too; where they cancel, and where a number is not finite, the pair is measured by itself.
    """
    import numpy as np

    same, middle = y is None, x.mean(axis=0)
    middle = np.where(np.isfinite(middle), middle, 0)
    x = x - middle
    y = x if same else y - middle
    labels = [np.unique(c, return_inverse=True) for c in (own, other)]
    out = np.zeros((len(x), len(labels[1][0]))), np.zeros((len(y), len(labels[0][0])))
    places = [c[1] for c in labels]
    with np.errstate(invalid="ignore", over="ignore"):
        xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
        left = np.column_stack((-2 * x, xx, np.ones(len(x))))
        right = np.ascontiguousarray(np.column_stack((y, np.ones(len(y)), yy)).T)
        room = np.empty((TILE, TILE))
        for i in range(0, len(x), TILE):
            u, at = x[i : i + TILE], places[0][i : i + TILE]
            rows = np.flatnonzero(np.diff(at, prepend=-1))
            for j in range(i if same else 0, len(y), TILE):
                v, to = y[j : j + TILE], places[1][j : j + TILE]
                columns = np.flatnonzero(np.diff(to, prepend=-1))
                d = np.matmul(left[i : i + TILE], right[:, j : j + TILE], out=room[: len(u), : len(v)])
                if not d.min() > CANCELLED * (xx[i : i + TILE].max() + yy[j : j + TILE].max()):
                    near = np.nonzero(~(d > CANCELLED * (xx[i : i + TILE, None] + yy[None, j : j + TILE])))
                    for k in range(0, len(near[0]), TILE * TILE // 8):
                        r, c = (z[k : k + TILE * TILE // 8] for z in near)
                        d[r, c] = ((u[r] - v[c]) ** 2).sum(axis=1)
                np.sqrt(d, out=d)
                out[0][i : i + TILE, to[columns]] += np.add.reduceat(d, columns, axis=1)
                if not same or i != j:
                    for first, end in zip(rows, [*rows[1:], len(u)], strict=True):  # np.add.reduceat is slow along columns
                        out[1][j : j + TILE, at[first]] += d[first:end].sum(axis=0)
    return (out[0] + out[1],) * 2 if same else out


def _seeds(sample, k: int, restarts: int, seed: int):
    """(restarts, k, width): starting centres by squared-distance sampling among the sampled rows."""
    import numpy as np

    out = np.empty((restarts, k, sample.shape[1]))
    for r in range(restarts):
        rng = np.random.default_rng([seed, r])
        chosen = [int(rng.integers(len(sample)))]
        far = ((sample - sample[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            total = far.sum()
            chosen.append(int(rng.choice(len(sample), p=far / total)) if total > 0 else int(rng.integers(len(sample))))
            far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        out[r] = sample[chosen]
    return out


def kmeans(points: DataFrame, k: int, seed: int = 7, restarts: int = 20, rounds: int = 100, sample: int = 2000) -> DataFrame:
    """(id, x, label) of the restart with the least cost; labels are ordered by their smallest id.

    Vectors with an element that is not finite are left out.  All restarts go through the rows together, one pass a round, until
    no centre moves; only sums by restart and cluster leave the tasks.  Starting centres come from ``sample`` rows chosen by a hash (fewer,
    if rows are long).  Fewer points than clusters are an error.
    """
    import numpy as np
    import pandas as pd

    data = stored(finite_vectors(points, "x").select("id", F.transform("x", lambda v: v.cast("double")).alias("x")), "vectors")
    n, width = data.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if n < k:
        raise ValueError(f"{n} finite vectors can't make {k} clusters")
    room = max(k, min(sample, BLOCK_NUMBERS // max(1, width)))
    first = data.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(room).select("x").toArrow()  # at most BLOCK_NUMBERS numbers, or k rows
    rows = np.array(first["x"].to_pylist(), float).reshape(-1, width)
    together = max(1, min(restarts, MOST_NUMBERS // max(1, k * width)))
    spark, best = points.sparkSession, None

    def pass_(centres) -> tuple:
        """(sums, sizes, costs) of every restart's clusters around centres."""
        shared = spark.sparkContext.broadcast(centres)  # at most MOST_NUMBERS numbers, or one restart's centres

        def run(batches):
            c = shared.value
            sums, sizes, costs = np.zeros(c.shape), np.zeros(c.shape[:2], np.int64), np.zeros(c.shape[:2])
            for batch in batches:
                for a in range(0, len(batch), 256):
                    x = np.stack(batch["x"].iloc[a : a + 256].to_list())
                    for r in range(len(c)):
                        d = np.stack([((x - m) ** 2).sum(axis=1) for m in c[r]], axis=1)
                        own = d.argmin(axis=1)
                        np.add.at(sums[r], own, x)
                        sizes[r] += np.bincount(own, minlength=k)
                        costs[r] += np.bincount(own, weights=d[np.arange(len(x)), own], minlength=k)
            pieces = range(0, width, PIECE)
            yield pd.DataFrame([{"r": r, "k": j, "at": a, "n": int(sizes[r, j]), "cost": costs[r, j], "s": sums[r, j, a : a + PIECE]} for r in range(len(c)) for j in range(k) if sizes[r, j] for a in pieces], columns=["r", "k", "at", "n", "cost", "s"])

        parts = data.select("x").mapInPandas(run, "r int, k int, at int, n long, cost double, s array<double>")
        total = parts.groupBy("r", "k", "at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.collect_list("s").alias("s"))  # PIECE numbers a task
        total = total.select("r", "k", "at", "n", "cost", F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.col("s")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q)).alias("s"))
        sums, sizes, costs = np.zeros(centres.shape), np.zeros(centres.shape[:2], np.int64), np.zeros(centres.shape[:2])
        for row in total.toLocalIterator():
            r, j, a = row["r"], row["k"], row["at"]
            sums[r, j, a : a + PIECE], sizes[r, j], costs[r, j] = row["s"], row["n"], row["cost"]
        shared.destroy()
        return sums, sizes, costs

    for a in range(0, restarts, together):
        centres = _seeds(rows, k, min(together, restarts - a), seed + a)
        for _ in range(rounds):
            sums, sizes, costs = pass_(centres)
            moved = np.where(sizes[..., None] > 0, sums / np.maximum(sizes, 1)[..., None], centres)
            settled = np.abs(moved - centres).max() <= 1e-9 * max(1.0, np.abs(centres).max())
            if settled:
                break
            centres = moved
        # restarts with all clusters filled come first, then the least cost
        order = sorted(range(len(centres)), key=lambda r: ((sizes[r] == 0).sum(), round(costs[r].sum(), 9), r))
        key = ((sizes[order[0]] == 0).sum(), costs[order[0]].sum())
        if best is None or key < best[0]:
            best = (key, centres[order[0]].copy())
    shared = spark.sparkContext.broadcast(best[1])

    def assign(batches):
        for batch in batches:
            x = np.stack(batch["x"].to_list()) if len(batch) else np.zeros((0, width))
            yield batch.assign(prediction=np.stack([((x - m) ** 2).sum(axis=1) for m in shared.value], axis=1).argmin(axis=1).astype("int32"))

    found = data.mapInPandas(assign, f"id {data.schema['id'].dataType.simpleString()}, x array<double>, prediction int")
    least = found.groupBy("prediction").agg(F.min("id").alias("m"))
    order = least.select("prediction", F.expr("cast(row_number() over (order by m) - 1 as int)").alias("label"))  # k rows
    return found.join(F.broadcast(order), "prediction").select("id", "x", "label")


def sweep(points: DataFrame, ks: Iterable[int], seed: int = 7, restarts: int = 20, sample: int | None = None) -> DataFrame:
    """(k, scores...) for each number of clusters."""
    out = None
    for k in ks:
        own = cluster_scores(stored(kmeans(points, k, seed, restarts), "labelled"), sample, seed).withColumn("k", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the largest silhouette, the smallest on ties."""
    return scores.orderBy(F.desc("silhouette"), "k").limit(1).select("k", "silhouette")


def cluster_image(grid: DataFrame, labelled: DataFrame) -> DataFrame:
    """(cell, label): -99 where the cell has none."""
    return grid.join(labelled.select(F.col("id").alias("cell"), "label"), "cell", "left").select("cell", F.coalesce("label", F.lit(-99)).alias("label"))


def centroid_images(labelled: DataFrame, cells: DataFrame) -> DataFrame:
    """(origin, cell, weight): each cluster's mean row as an image; x is in the order of ``cells``."""
    means = labelled.select("label", F.posexplode("x").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("weight"))
    place = cells.select("cell", F.expr("cast(row_number() over (order by cell) - 1 as int)").alias("pos"))  # the axis of the matrix
    return means.join(place, "pos").select(F.col("label").alias("origin"), "cell", "weight")
