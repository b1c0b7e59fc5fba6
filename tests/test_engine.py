"""Goldens, properties, negatives and cross-implementation checks of the engine."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tailweave.functions import metrics, scalars
from tailweave.functions.ranks import ecdf, zero_based_rank
from tailweave.operators import cluster, explore, graph, paths, pooling, puzzle, selection, tail
from tailweave.operators.lags import offsets, sequence_pairs, windows
from tailweave.plans import pipelines
from tailweave.schema import require
from tailweave.sources import cubes, sinks

P = 0.9


def cube_of(spark, values):
    """values: array (t, cell)."""
    rows = [(t, c, None if v is None else float(v)) for t, row in enumerate(values) for c, v in enumerate(row)]
    return spark.createDataFrame(rows, "t long, cell long, value double")


def numpy_ecdf(x):
    order = np.sort(x)
    low, high = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
    return ((low + high + 1) / 2) / (len(x) + 1)


@pytest.fixture(scope="module")
def rain():
    rng = np.random.default_rng(3)
    x = np.round(np.maximum(rng.standard_normal((150, 6)) + 0.4 * rng.standard_normal((150, 1)), 0), 2)
    x[1:, 2] = x[:-1, 1]
    x[3:, 4] = np.round(0.5 * x[3:, 4] + x[:-3, 1], 2)
    return x


@pytest.fixture(scope="module")
def ranked(rain):
    return np.stack([numpy_ecdf(c) for c in rain.T], axis=1)


def chi(u, path, lags, s, e, p):
    place = [0, *itertools.accumulate(lags[: len(path) - 1])]
    n = e - s - place[-1]
    hit = np.ones(n, bool)
    for c, o in zip(path, place, strict=True):
        hit &= u[s + o : s + o + n, c] >= p
    return int(hit.sum()), hit.sum() / n / (1 - p)


@pytest.mark.parametrize("values,want", [([0, 0, 5, 9], [0.3, 0.3, 0.6, 0.8]), ([7, 7, 7], [0.5] * 3), ([4], [0.5])])
def test_ecdf_goldens(spark, values, want):
    got = [r["u"] for r in ecdf(cube_of(spark, [[v] for v in values])).orderBy("t").collect()]
    assert got == pytest.approx(want)


def test_nulls_have_no_rank(spark):
    got = [r["u"] for r in ecdf(cube_of(spark, [[3], [None], [1]])).orderBy("t").collect()]
    assert got == [pytest.approx(2 / 3), None, pytest.approx(1 / 3)]
    df = cube_of(spark, [[5], [5], [1]]).select(zero_based_rank("value", ["cell"]).alias("r"), "t")
    assert [r["r"] for r in df.orderBy("t").collect()] == [1.5, 1.5, 0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=30))
def test_ecdf_is_exact_and_monotone_invariant(spark, xs):
    one = [r["u"] for r in ecdf(cube_of(spark, [[x] for x in xs])).orderBy("t").collect()]
    two = [r["u"] for r in ecdf(cube_of(spark, [[2 * x**3 + 1] for x in xs])).orderBy("t").collect()]
    assert one == two == list(numpy_ecdf(np.array(xs)))
    assert sum(one) / len(one) == pytest.approx(0.5)


def test_windows():
    assert windows([1, 2], 3, 0, 10) == [(0, 7), (1, 8), (3, 10)]
    assert windows([1, 2], 3, 0, 10, "trailing") == [(3, 10), (2, 9), (0, 7)]
    assert offsets([2, 5, 1], 2) == [(0, 2), (2, 0)]
    with pytest.raises(ValueError):
        windows([4, 6], 3, 0, 10)
    with pytest.raises(ValueError):
        offsets([1], 2, "sideways")


def test_sequence_pairs(spark):
    got = sequence_pairs(cube_of(spark, [[v] for v in range(5)]), 3).orderBy("t").collect()
    assert [(r["x"], r["y"]) for r in got] == [([0, 1, 2], 3), ([1, 2, 3], 4)]


def test_joint_chi_goldens(spark):
    df = spark.createDataFrame([(0.2, 0.2, 0.9), (0.4, 0.4, 0.1), (0.6, 0.6, float("nan")), (0.8, 0.8, None)], "a double, b double, c double")
    assert df.agg(tail.joint_chi(["a", "b"], 0.5)).first()[0] == 1.0
    assert df.agg(tail.joint_chi(["a", "c"], 0.5)).first()[0] == 0.0
    assert spark.createDataFrame([(0.25, 0.75), (0.75, 0.25)], "x double, y double").agg(tail.theta(F.avg(F.abs(F.col("x") - F.col("y"))))).first()[0] == pytest.approx(3.0)


def test_madogram_by_group(spark):
    df = spark.createDataFrame([(g, float(x), float(x if g else -x)) for g in (0, 1) for x in range(9)] + [(0, None, 1.0)], "g long, x double, y double")
    got = {r["g"]: r["theta"] for r in tail.madogram(df, "x", "y", ["g"]).collect()}
    assert got[1] == 1.0 and got[0] > 2
    assert tail.madogram(df.where("g = 1"), "x", "y").first()["theta"] == 1.0


def test_graph_like_numpy(spark, rain, ranked):
    cube = cube_of(spark, rain)
    u = ecdf(cube).cache()
    cells = cube.select("cell").distinct()
    for lag, salt in ((1, 1), (3, 3)):
        got = {(r["i"], r["j"]): (r["hits"], r["chi"]) for r in graph.lag_graph(u, cells, lag, 5, 140, P, salt=salt).collect()}
        for i, j in itertools.product(range(6), repeat=2):
            hits, value = chi(ranked, (j, i), [lag], 5, 140, P)
            assert got[i, j] == (hits, value)
    land = spark.createDataFrame([(0,), (2,)], "cell long")
    assert {r["i"] for r in graph.lag_graph(u, cells, 1, 0, 149, P, rows=land).collect()} == {0, 2}
    theta = {(r["i"], r["j"]): r["chi"] for r in graph.madogram_graph(u, 2, 0, 149).collect()}
    for i, j in itertools.product(range(6), repeat=2):
        nu = 0.5 * np.abs(ranked[2:149, i] - ranked[:147, j]).mean()
        assert theta[i, j] == pytest.approx(2 - min((1 + 2 * nu) / (1 - 2 * nu), 2))


@pytest.mark.parametrize("lag,start,end,p", [(0, 0, 9, 0.9), (-1, 0, 9, 0.9), (9, 0, 9, 0.9), (1, 0, 9, 1.0), (1, 0, 9, 0.0)])
def test_graph_refuses(spark, lag, start, end, p):
    u = ecdf(cube_of(spark, [[1]] * 10))
    with pytest.raises(ValueError):
        graph.lag_graph(u, u.select("cell").distinct(), lag, start, end, p)


def test_percentiles_and_flow(spark):
    edges = spark.createDataFrame([(4, j, float(j == 0 or j == 2)) for j in range(9)] + [(0, j, 0.0) for j in range(9)], "i long, j long, chi double")
    assert {(r["i"], r["j"]) for r in paths.top_neighbors(edges, 0.9).collect()} == {(4, 0), (4, 2), *((0, j) for j in range(9))}
    assert {(r["i"], r["j"]) for r in paths.top_neighbors(edges, 0.5, strict=True).collect()} == {(4, 0), (4, 2)}
    got = {r["i"]: r for r in paths.flow_vectors(paths.top_neighbors(edges, 0.9), 3).collect()}
    assert (got[4]["i_c"], got[4]["j_c"], got[4]["u"], got[4]["v"], got[4]["max_chi"]) == (0, 1, 0, -1, 1)
    assert all(got[0][c] is None for c in ("i_c", "j_c", "u", "v", "max_chi"))
    image = edges.where("i = 4").withColumnRenamed("chi", "chi_mean")
    assert paths.image_selection(image, 80).count() == 2 and paths.image_selection(image, 0.8).count() == 2
    assert paths.percent(0.99) == 99
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            paths.image_selection(image, bad)


def brute_explore(u, stations, d_max, lags, s, e, p, percent):
    n_cells, out = u.shape[1], {}
    for st_ in stations:
        row = np.array([chi(u, (j, st_), lags[:1], s, e, p)[1] for j in range(n_cells)])  # station later, neighbour earlier
        lists = [[st_], list(np.flatnonzero(row > np.percentile(row, percent)))]
        for d in range(3, d_max + 1):
            total = {}
            best = None
            for t in itertools.product(*lists, range(n_cells)):
                hits, value = chi(u, t, lags, s, e, p)
                total.setdefault(t[-1], []).append(hits)
                if best is None or hits > best[1]:
                    best = (list(t), hits, value)
            n = e - s - sum(lags[: d - 1])
            image = {c: (len(h), sum(h) / len(h) / n / (1 - p), np.var(np.array(h) / n / (1 - p))) for c, h in total.items()}
            out[st_, d] = (best, image)
            if not image:
                break
            means = np.array([sum(total[c]) / len(total[c]) / n / (1 - p) for c in range(n_cells)])
            lists.append([c for c in range(n_cells) if means[c] > np.percentile(means, percent)])
    return out


def test_chains_like_brute_force(spark, rain, ranked):
    cube = cube_of(spark, rain)
    u = ecdf(cube).cache()
    cells = cube.select("cell").distinct()
    lags = [1, 2, 1]
    edges = graph.lag_graph(u, cells, 1, 0, 149, P)
    found = explore.explore_stations(u, edges, cells, 4, lags, 0, 149, P, 40)
    want = brute_explore(ranked, range(6), 4, lags, 0, 149, P, 40)
    for d in (3, 4):
        best = {r["origin"]: (r["path"], r["hits"]) for r in found.steps[d].best.collect()}
        image = {(r["origin"], r["cell"]): (r["count"], r["chi_mean"], r["chi_var"]) for r in found.steps[d].image.collect()}
        for s in range(6):
            if (s, d) not in want or want[s, d][0] is None:
                assert s not in best
                continue
            assert best[s] == want[s, d][0][:2]
            for c, (n, m, v) in want[s, d][1].items():
                assert image[s, c][0] == n and image[s, c][1] == pytest.approx(m) and image[s, c][2] == pytest.approx(v, abs=1e-9)
    chi3 = {tuple(r["path"]): r["chi"] for r in found.steps[3].combos.collect()}
    assert all(0 <= v <= 1 / (1 - P) + 1e-9 for v in chi3.values())
    tuples = found.steps[3].combos.select("path")
    packed = {tuple(r["path"]): r["hits"] for r in graph.bitset_hits(u, tuples, [0, 1, 3], 0, 146, P).collect()}
    assert packed == {tuple(r["path"]): r["hits"] for r in found.steps[3].combos.collect()}
    fallback = explore.best_or_self(cells, found.steps[3].best.where("origin <> 0"), 3)
    assert {r["origin"]: r["path"] for r in fallback.collect()}[0] == [0, 0, 0]
    with pytest.raises(ValueError):
        explore.explore_stations(u, edges, cells, 4, [1, 1], 0, 149, P, 40)
    with pytest.raises(ValueError):
        explore.explore_stations(u, edges, cells, 3, [1, 1], 0, 149, P, 40, rates=[1])


def test_regions_with_full_samples_match_one_pass(spark, rain, ranked):
    cube = cube_of(spark, rain)
    u = ecdf(cube).cache()
    members = spark.createDataFrame([(0, 0), (0, 1), (1, 3), (1, 4), (1, 5)], "origin long, cell long")
    weights = spark.createDataFrame([(o, c, float(c + o)) for o in (0, 1) for c in range(6)], "origin long, cell long, weight double")
    full = explore.explore_regions(u, members, weights, 3, [1, 1], 0, 149, [1.0, 1.0], P, 50, 0.01, 0.1, 5)
    grown = explore.explore_regions(u, members, weights, 3, [1, 1], 0, 149, [0.5, 0.5], P, 50, -1.0, 0.3, 10)
    pick = lambda f: {(r["origin"], r["cell"]): (r["count"], r["s"], r["q"]) for r in f.steps[3].image.collect()}
    assert pick(full) == pick(grown)  # grown until no tuple is new
    for (o, c), (n, s, _) in pick(full).items():
        hits = [chi(ranked, (a, b, c), [1, 1], 0, 149, P)[0] for a in ([0, 1], [3, 4, 5])[o] for b in (3, 4, 5)]
        assert (n, s) == (len(hits), sum(hits))
    assert [h[1] for h in grown.history] == list(range(len(grown.history)))


@pytest.mark.parametrize("pool,stride", [(2, 2), (3, 1), (2, 3), (5, 1)])
def test_pooling(spark, pool, stride):
    x = np.random.default_rng(pool).integers(0, 50, (5, 5))
    df = spark.createDataFrame([(0, i * 5 + j, float(x[i, j])) for i in range(5) for j in range(5)], "t long, cell long, value double")
    n = (5 - pool) // stride + 1
    for func, np_func in ((F.max, np.max), (F.avg, np.mean)):
        got = {(r["oi"], r["oj"]): r["value"] for r in pooling.pool_2d(df, 5, 5, pool, stride, func).collect()}
        assert got == {(i, j): pytest.approx(np_func(x[i * stride : i * stride + pool, j * stride : j * stride + pool])) for i in range(n) for j in range(n)}
    line = df.where("cell < 5").select(F.col("cell").alias("t"), F.lit(0).alias("cell"), "value")
    got = {r["o"]: r["value"] for r in pooling.pool_1d(line, 5, pool, stride).collect()}
    assert got == {i: x[0, i * stride : i * stride + pool].max() for i in range(n)}


def test_pooling_golden_and_python_functions(spark):
    df = spark.createDataFrame([(0, k, float(k)) for k in range(16)], "t long, cell long, value double")
    assert [r["value"] for r in pooling.pool_2d(df, 4, 4, 2, 2).orderBy("oi", "oj").collect()] == [5, 7, 13, 15]
    assert [r["value"] for r in pooling.pool_cube_py(df, 4, 4, 2, 2, np.ptp).orderBy("oi", "oj").collect()] == [5, 5, 5, 5]
    with pytest.raises(ValueError):
        pooling.pool_2d(df, 4, 4, 5, 1)


def test_puzzle_like_brute_force(spark, rain):
    cube = cube_of(spark, rain)
    lists = {"1_1": [1, 1], "2_1": [2, 1]}
    rng = random.Random(2)
    own = {k: {c: [c, rng.randrange(6), rng.randrange(6)] for c in range(5)} for k in lists}
    frames = {k: spark.createDataFrame(list(v.items()), "origin long, path array<long>") for k, v in own.items()}
    blocks = puzzle.joint_blocks(frames, cube, lists, 0, 149)
    assert {r["t"] for r in puzzle.common_dates(blocks, 2).collect()} == set(range(3, 149))
    got = {(r["t"], r["cell"]): (r["x"], r["y"]) for r in puzzle.puzzle(blocks, lists, cube.select("cell").distinct()).collect()}
    assert {t for t, _ in got} == set(range(3, 149))
    for t in range(3, 149):
        assert got[t, 5] == ([0.0] * 4, 0.0)
        for c in range(5):
            x = [rain[t - sum(lags[:m]), own[k][c][m]] for k, lags in lists.items() for m in (1, 2)]
            assert got[t, c] == (x, rain[t, c])
    forecast = puzzle.persistence(frames["1_1"], cube, 1)
    assert all(r["y_pred"] == rain[r["t"] - 1, own["1_1"][r["cell"]][1]] and r["y_true"] == rain[r["t"], r["cell"]] for r in forecast.collect())
    assert puzzle.resampled(forecast, 10).where("cell = 0").count() == 15


def pair_frame(spark, y, p):
    return spark.createDataFrame([(0, k, None if a is None else float(a), None if b is None else float(b)) for k, (a, b) in enumerate(zip(y, p, strict=True))], "cell long, t long, y_true double, y_pred double")


def test_metrics_like_numpy(spark):
    rng = np.random.default_rng(9)
    y, p = np.round(rng.standard_normal(80), 1), np.round(rng.standard_normal(80), 1)
    p += 0.5 * y
    got = metrics.metric_map(pair_frame(spark, [*y, None, 3.0], [*p, 1.0, float("nan")])).first()
    r = np.corrcoef(y, p)[0, 1]
    want = {
        "rmse": np.sqrt(((p - y) ** 2).mean()), "mae": np.abs(p - y).mean(), "mse": ((p - y) ** 2).mean(), "mbe": (p - y).mean(), "pearson": r, "nse": 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
        "explained_variance": 1 - (y - p).var() / y.var(), "kge": 1 - np.sqrt((r - 1) ** 2 + (p.std() / y.std() - 1) ** 2 + (p.mean() / y.mean() - 1) ** 2),
        "smape": (np.abs(p - y) / np.maximum((abs(y) + abs(p)) / 2, 1e-8)).mean() * 100, "mape": np.abs((p - y) / np.maximum(abs(y), 1e-8)).mean() * 100,
    }
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    con = dis = ty = tp = 0
    for a, b in itertools.combinations(range(80), 2):
        s = (y[a] - y[b]) * (p[a] - p[b])
        con, dis, ty, tp = con + (s > 0), dis + (s < 0), ty + (y[a] == y[b]), tp + (p[a] == p[b])
    n = 80 * 79 / 2
    df = pair_frame(spark, y, p)
    assert metrics.kendall(df).first()["kendall"] == pytest.approx((con - dis) / math.sqrt((n - ty) * (n - tp)))
    ranks = [numpy_ecdf(v) for v in (y, p)]
    assert metrics.spearman(df).first()[0] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    q = np.percentile(y, 95)
    assert metrics.quantile_mae(df).first()[0] == pytest.approx(np.abs(p - y)[y >= q].mean())
    hits = ((y >= np.percentile(y, 90)) & (p >= np.percentile(p, 90))).mean() / (1 - 0.9)
    assert metrics.bivariate_chi(df, 0.9).first()[0] == pytest.approx(hits) == metrics.bivariate_chi(df, 0.9, ["cell"]).first()["chi"]
    assert set(metrics.bundle(df).columns) == {"rmse", "mae", "mbe", "pearson", "nse", "kge", "spearman", "chi90", "chi95", "chi99"}
    assert metrics.group_metric_py(df, lambda a, b: float(np.abs(a - b).max())).first()["value"] == pytest.approx(np.abs(y - p).max())


def test_metric_goldens(spark):
    e = metrics.event_scores(pair_frame(spark, [1, 1, 0, 0], [1, 0, 1, 0]), 1.0).first()
    assert tuple(e) == (1, 1, 1, 1, 0.5, 0.5, pytest.approx(1 / 3), 1.0)
    none = metrics.event_scores(pair_frame(spark, [0], [0]), 1.0).first()
    assert none["pod"] is None and none["far"] is None and none["csi"] is None
    flat = metrics.metric_map(pair_frame(spark, [1, 1], [1, 2])).first()
    assert flat["pearson"] is None and flat["nse"] is None and flat["kge"] is None
    assert metrics.kendall(pair_frame(spark, [1, 1], [1, 2])).first()["kendall"] is None
    assert metrics.metric_map(pair_frame(spark, [1, float("nan")], [1, 2])).first()["mse"] == 0
    assert metrics.metric_map(pair_frame(spark, [1, 2, 5], [1, 2, 5])).first()["kge"] == 1.0
    with pytest.raises(ValueError):
        metrics.metric_reduce(pair_frame(spark, [1], [1]), metrics.mae, "sum")


def test_images_like_numpy(spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((9, 12)), rng.random((9, 12))
    df = spark.createDataFrame([(0, i * 12 + j, float(a[i, j]), float(b[i, j])) for i in range(9) for j in range(12)], "t long, cell long, y_true double, y_pred double")
    w = np.outer(metrics.gaussian(9), metrics.gaussian(9))
    values = []
    for j in range(4):
        x, y = a[:, j : j + 9], b[:, j : j + 9]
        mx, my = (w * x).sum(), (w * y).sum()
        sx, sy, sxy = (w * x * x).sum() - mx**2, (w * y * y).sum() - my**2, (w * x * y).sum() - mx * my
        values.append((2 * mx * my + 1e-4) / (mx**2 + my**2 + 1e-4) * (2 * sxy + 9e-4) / (sx + sy + 9e-4))
    got = metrics.ssim(df, 9, 12).first()["ssim"]
    assert got == pytest.approx(np.mean(values))
    mse, mae = ((a - b) ** 2).mean(), np.abs(a - b).mean()
    assert metrics.psnr(df).first()["psnr"] == pytest.approx(20 * np.log10(a.max() + 1e-6) - 10 * np.log10(mse))
    assert metrics.combined_loss(df, 9, 12).first()["loss"] == pytest.approx(0.4 * mse + 0.4 * mae + 0.2 * (1 - got))
    same = df.withColumn("y_pred", F.col("y_true"))
    assert metrics.ssim(same, 9, 12).first()["ssim"] == pytest.approx(1) and metrics.psnr(same).first()["psnr"] is None


def test_cluster_scores_like_numpy(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((12, 3)) + 4 * k for k in range(3)] + [[[50.0, 0, 0]]])
    label = [0] * 12 + [1] * 12 + [2] * 12 + [3]
    df = spark.createDataFrame([(k, v.tolist(), c) for k, (v, c) in enumerate(zip(x, label, strict=True))], "id long, x array<double>, label int")
    got = cluster.cluster_scores(df, None).first()
    label = np.array(label)
    centre = np.stack([x[label == k].mean(axis=0) for k in range(4)])
    d = np.linalg.norm(x - centre[label], axis=1)
    size = np.bincount(label)
    far = np.linalg.norm(centre - x.mean(axis=0), axis=1)
    s = np.array([d[label == k].mean() for k in range(4)])
    davies = np.mean([max((s[a] + s[b]) / np.linalg.norm(centre[a] - centre[b]) for b in range(4) if b != a) for a in range(4)])
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    sil = []
    for k in range(37):
        own = [j for j in range(37) if label[j] == label[k] and j != k]
        b = min(dist[k, label == c].mean() for c in range(4) if c != label[k])
        sil.append((b - dist[k, own].mean()) / max(b, dist[k, own].mean()) if own else 0)
    want = {"inertia": (d**2).sum(), "sdw": d.sum(), "sdb": (size * far).sum(), "calinski": (size * far**2).sum() / 3 / ((d**2).sum() / 33), "davies": davies, "silhouette": np.mean(sil)}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    found = cluster.kmeans(df, 4, restarts=4)
    groups = {r["id"]: r["label"] for r in found.collect()}
    assert len({groups[k] for k in range(12)}) == 1 and groups[0] == 0
    grid = cubes.grid(spark, 1, 40)
    image = {r["cell"]: r["label"] for r in cluster.cluster_image(grid, found).collect()}
    assert image[39] == -99 and image[0] == 0
    sweep = cluster.sweep(df, [2, 4], restarts=2)
    assert cluster.best_k(sweep).first()["k"] in (2, 4)
    axis = spark.range(3).select(F.col("id").alias("cell"))
    assert cluster.centroid_images(found, axis).count() == 12


def test_selection(spark):
    df = spark.range(100).select(F.col("id").alias("cell"))
    few, more = ({r["cell"] for r in selection.hash_prefix(df, x).collect()} for x in (0.1, 0.35))
    assert len(few) == 10 and len(more) == 35 and few <= more and selection.hash_prefix(df, 2).count() == 100
    grouped = df.withColumn("g", F.col("cell") % 3)
    assert {r["count"] for r in selection.hash_prefix(grouped, 0.5, by=["g"]).groupBy("g").count().collect()} == {16, 17}
    split = selection.positional_split(df, 0.8, "cell")
    assert split.where("part = 'train'").agg(F.max("cell")).first()[0] == 79
    assert selection.batched(df, 32, "cell").agg(F.max("batch")).first()[0] == 3
    assert [len(b) for b in selection.dataset(df, True, 40)] == [40, 40, 20]
    keys = [spark.createDataFrame([(k,) for k in v], "date long") for v in ([1, 2, 3, 3], [2, 3, 4])]
    assert sorted(r["date"] for r in selection.common_keys(keys, "date").collect()) == [2, 3]
    assert selection.unseen(keys[0], keys[1], ["date"]).collect() == [(1,)]
    assert selection.stacked(a=df, b=df).groupBy("run").count().count() == 2
    with pytest.raises(ValueError):
        selection.hash_prefix(df, -1)


def test_stations(spark):
    g = cubes.grid(spark, 5, 5)
    s = spark.createDataFrame([("tie", 9.5, 100.5), ("far", -90.0, 999.0), ("in", 8.1, 102.2)], "name string, lat double, lon double")
    got = {r["name"]: (r["i"], r["j"]) for r in selection.nearest_cell(s, g).collect()}
    assert got == {"tie": (0, 0), "far": (4, 4), "in": (2, 2)}
    sea = g.withColumn("is_land", F.col("cell") != 24)
    assert {r["name"] for r in selection.on_land(selection.nearest_cell(s, g), sea).collect()} == {"tie", "in"}
    nodes = spark.createDataFrame([(7, [7, 0, 24])], "origin long, nodes array<long>")
    assert explore.wkt_lines(nodes, g).first()["wkt"] == "LINESTRING(102.0 9.0, 100.0 10.0, 104.0 6.0)"
    assert explore.wkt_points(nodes, g).count() == 3


def test_scalars(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (-float("inf"),), (None,), (0.0,), (5.0,), (10.0,)], "value double")
    got = [r[0] for r in df.select(scalars.to_byte(F.col("value"), F.lit(0.0), F.lit(10.0))).collect()]
    assert got == [0, 255, 0, 0, 0, 127, 255]
    assert scalars.checked_range(df) == (0.0, 10.0)
    assert df.select(F.sum(scalars.zero_for_missing(F.col("value")))).first()[0] == 15
    assert spark.sql("select 'x' as a").select(scalars.safe_double(F.col("a"))).first()[0] is None
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0, float("nan")],), ([float("inf")],)], "x array<double>")
    assert scalars.finite_vectors(vectors, "x").count() == 1
    with pytest.raises(ValueError):
        scalars.checked_range(df.where("value = 5"))
    g = cubes.grid(spark, 2, 3)
    assert g.where(scalars.to_flat(scalars.to_row(F.col("cell"), 3), scalars.to_column(F.col("cell"), 3), 3) != F.col("cell")).count() == 0
    assert scalars.extent(g).first().asDict() == {"west": 100, "east": 102, "south": 9, "north": 10}
    assert g.select(scalars.frame_title(F.col("cell"), prefix="p ")).first()[0] == "p t=0"
    assert g.select(scalars.coordinate_key(F.col("i"), F.col("j")).alias("k")).where("k.i = 1").count() == 3


def test_sources_and_sinks(spark, tmp_path):
    cube = cube_of(spark, [[1, 2], [float("nan"), 4]])
    sinks.write_relations(str(tmp_path / "run"), cube=cube, grid=cubes.grid(spark, 1, 2))
    back = cubes.read_cube(spark, str(tmp_path / "run/cube"))
    assert back.where("value is null").count() == 1
    assert cubes.read_folder(spark, str(tmp_path / "run/cube")).select("source_file").distinct().count() >= 1
    nested = spark.sql("select 'r' as name, named_struct('a', array(1, 2), 'b', cast(null as int)) as v")
    sinks.write_nested(nested, str(tmp_path / "nested"))
    assert cubes.read_nested(spark, str(tmp_path / "nested"), "name string, v struct<a:array<int>,b:int>").collect() == nested.collect()
    edges = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.5), (1, 0, 0.0), (1, 1, 0.2)], "i long, j long, chi double")
    for lag in (1, 2):
        sinks.write_graph(edges, str(tmp_path / "graph"), lag)
    sinks.write_graph(edges.limit(1), str(tmp_path / "graph"), 2)
    assert spark.read.parquet(str(tmp_path / "graph")).groupBy("lag").count().orderBy("lag").collect() == [(1, 4), (2, 1)]
    assert [tuple(r) for r in sinks.matrix_view(edges, [0, 1]).collect()] == [(0, 1.0, 0.5), (1, 0.0, 0.2)]
    bands = cube.select(F.col("t").alias("band"), "cell", "value")
    sinks.write_raster(bands, str(tmp_path / "raster"), [10.0, 9.0], [100.0, 101.5])
    assert sinks.raster_metadata([10.0, 9.0], [100.0, 101.5])["pixel_x"] == 1.5 and sinks.raster_metadata([10.0, 9.0], [100.0, 101.5])["north"] == 10.5
    for total in (1, 2):
        sinks.append_runs(spark.createDataFrame([("a", total)], "run_name string, v int"), str(tmp_path / "runs"))
    sinks.append_runs(spark.createDataFrame([("b", 5)], "run_name string, v int"), str(tmp_path / "runs"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "runs")).select("run_name", "v").collect()) == [("a", 2), ("b", 5)]
    sinks.write_scores(edges, str(tmp_path / "scores"))
    assert spark.read.csv(str(tmp_path / "scores"), header=True).count() == 4
    sinks.write_puzzle(cube.withColumnRenamed("value", "y"), str(tmp_path / "puzzle"))
    assert spark.read.parquet(str(tmp_path / "puzzle")).count() == 4
    one, two = (spark.createDataFrame([(k, src)], "name string, v string") for k, src in (("x", "old"), ("x", "new")))
    assert cubes.merge_run_stores(one, two).collect() == [("x", "new")]
    with pytest.raises(ValueError):
        cubes.read_cube(spark, str(tmp_path), "other")
    for adapter in (lambda: cubes.read_hdf5_cube(spark, "x.h5"), lambda: sinks.write_geotiff(bands, "x.tif", [1.0, 2.0], [1.0, 2.0])):
        with pytest.raises(NotImplementedError):
            adapter()


def test_schema_check(spark):
    cube = cube_of(spark, [[1]])
    assert require(cube, "cube") is cube
    with pytest.raises(ValueError):
        require(cube.drop("value"), "cube")


def test_whole_flow(spark, rain):
    cube = cube_of(spark, rain)
    models = pipelines.build_models(cube, 3, [[1, 1], [1, 2]], 0, 149, p=P, percent=40)
    assert models["1_1"].edges is models["1_2"].edges
    assert all(m.chains.count() == 6 and m.flow.count() == 6 for m in models.values())
    table = pipelines.training_table(cube, models, 0, 149)
    assert table.count() == 6 * 146 and len(table.first()["x"]) == 4
    linear = pipelines.linear_baseline(table)
    rows = pipelines.compare(last=pipelines.baseline(cube), linear=linear).collect()
    assert len(rows) == 10
    assert linear.groupBy("part").count().count() == 2


def test_models_are_saved_merged_and_built_from_folders(spark, rain, tmp_path):
    cube_of(spark, rain).coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))
    options = {"p": P, "percent": 40}
    names = pipelines.build_folder(spark, str(tmp_path / "in"), 3, [[1, 1]], str(tmp_path / "out"), **options)
    assert len(names) == 1
    one = f"{tmp_path}/out/{names[0]}"
    models = pipelines.build_models(cube_of(spark, rain), 3, [[1, 1], [2, 1]], 0, 149, **options)
    pipelines.save_models(models, str(tmp_path / "two"))
    pipelines.save_models({"1_1": models["1_1"]}, str(tmp_path / "two"))
    assert pipelines.load_relations(spark, str(tmp_path / "two"))["edges"].groupBy("run_name").count().orderBy("run_name").collect() == [("1_1", 36), ("2_1", 36)]
    merged = pipelines.load_merged(spark, [one, str(tmp_path / "none"), str(tmp_path / "two")])
    assert merged.groupBy("run_name").count().orderBy("run_name").collect() == [("1_1", 6), ("2_1", 6)]
    with pytest.raises(ValueError):
        pipelines.load_merged(spark, [str(tmp_path / "none")])
    assert pipelines.predict(models["1_1"].chains, cube_of(spark, rain), 1, 10, 19, 5).count() == 12


def test_study_windows(spark):
    dates = spark.createDataFrame([(k, f"2001-01-0{k + 1}") for k in range(9)], "t long, date string")
    assert pipelines.study_window(dates, "2001-01-02", "2001-01-09") == (1, 8)
    with pytest.raises(ValueError):
        pipelines.study_window(dates, "2001-01-02", "2001-02-01")
    assert pipelines.with_dates(dates.select("t"), dates.where("t < 3")).count() == 3


def test_plan_filters_before_joining(spark, small):
    """Only exceedances reach the join on tau, and scans read only what is needed."""
    from tailweave import catalog

    plan = catalog.queries()["lag_graph_weekly"](spark, small)._jdf.queryExecution().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line and "lineitem" in line]
    assert scans and all("l_comment" not in s and "l_extendedprice" not in s for s in scans)


@pytest.mark.parametrize("ranges", [1, 4, 1024])
def test_long_series_are_ranked_by_ranges(spark, monkeypatch, ranges):
    from tailweave.functions import ranks

    monkeypatch.setattr(ranks, "RANGES", ranges)
    rng = np.random.default_rng(ranges)
    x = np.concatenate([np.zeros(300), rng.integers(0, 40, 200), rng.standard_normal(150) * 1e6])
    y = np.round(x / 7) + rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (float("nan"), 2.0)], "x double, y double")
    placed = {r["value"]: (r["n"], r["below"]) for r in ranks.placed_values(df, "x").collect()}
    assert placed == {v: (int((x == v).sum()), int((x < v).sum())) for v in set(x.tolist())}
    shares = [0, 0.02, 0.5, 0.95, 1]
    assert list(ranks.percentiles(df, "x", shares).first()) == pytest.approx(np.quantile(x, shares).tolist())
    assert ranks.percentiles(df.limit(0), "x", [0.5]).first()[0] is None

    def average(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    known = df.where("x is not null and not isnan(x)").withColumnRenamed("x", "y_true").withColumnRenamed("y", "y_pred")
    assert metrics.spearman(known).first()[0] == pytest.approx(np.corrcoef(average(x), average(y))[0, 1])
    apart = np.abs(average(x) - average(y)).mean() / (len(x) + 1)
    assert tail.madogram(known, "y_true", "y_pred").first()[0] == pytest.approx((1 + apart) / (1 - apart))


@pytest.mark.parametrize("block", [1, 2, 128])
def test_madogram_graph_by_blocks(spark, rain, ranked, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK_CELLS", block)
    u = ecdf(cube_of(spark, rain)).withColumn("u", F.when((F.col("t") % 17 != 3) | (F.col("cell") != 2), F.col("u")))
    got = {(r["i"], r["j"]): r["theta"] for r in graph.madogram_graph(u, 2, 5, 140).collect()}
    gaps = np.array(ranked, float)
    for i in range(6):
        for j in range(6):
            d = [abs(gaps[t + 2, i] - gaps[t, j]) for t in range(5, 138) if not (i == 2 and (t + 2) % 17 == 3) and not (j == 2 and t % 17 == 3)]
            nu = 0.5 * np.mean(d)
            assert got[i, j] == pytest.approx((1 + 2 * nu) / (1 - 2 * nu))


def test_kmeans_leaves_out_what_is_not_finite(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 3)
    monkeypatch.setattr(cluster, "PIECE", 2)
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((15, 5)) + 9 * k for k in range(3)])
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(90, [float("nan")] * 5), (91, [1.0, None, 1.0, 1.0, 1.0]), (92, [float("inf")] * 5)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    found = cluster.kmeans(df, 3, restarts=5)
    got = {r["id"]: r["label"] for r in found.collect()}
    assert got == {k: k // 15 for k in range(45)}
    again = {r["id"]: r["label"] for r in cluster.kmeans(df.repartition(7), 3, restarts=5).collect()}
    assert again == got
    label = np.arange(45) // 15
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    sil = []
    for k in range(45):
        a = dist[k, (label == label[k]) & (np.arange(45) != k)].mean()
        b = min(dist[k, label == c].mean() for c in range(3) if c != label[k])
        sil.append((b - a) / max(a, b))
    assert cluster.silhouette(found).first()[0] == pytest.approx(np.mean(sil))
    assert cluster.silhouette(found, sample=30).first()[0] == pytest.approx(np.mean(sil), abs=0.1)
    assert cluster.silhouette(found.withColumn("label", F.lit(0))).first()[0] == 0
    with pytest.raises(ValueError):
        cluster.kmeans(df, 46)


@pytest.mark.parametrize("block", [7, 1000])
def test_silhouettes_of_several_clusterings(spark, monkeypatch, block):
    """Off the origin, with copies, near copies and an id that stands for two rows: distances are measured once, each point in every pair of blocks."""
    monkeypatch.setattr(cluster, "BLOCK", block)
    monkeypatch.setattr(cluster, "TILE", 5)
    monkeypatch.setattr(cluster, "ROWS", 4)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((40, 4)) + 1e6
    x[20:25], x[30] = x[0], x[1] + 1e-7
    ids, label = [*range(39), 38], [k % 6 for k in range(40)]
    df = spark.createDataFrame(list(zip(ids, x.tolist(), label, strict=True)), "id long, x array<double>, label int")
    dist = np.linalg.norm(x[:, None] - x[None], axis=2)
    ids = np.array(ids)
    want = {}
    for m in (2, 3, 6):
        own, all_ = np.array(label) % m, []
        for i, c in sorted(set(zip(ids.tolist(), own.tolist(), strict=True))):
            d = dist[(ids == i) & (own == c)][:, ids != i]
            by = own[ids != i]
            a, b = d[:, by == c].mean(), min(d[:, by == o].mean() for o in range(m) if o != c)
            all_.append((b - a) / max(a, b))
        want[m] = np.mean(all_)
    got = {r["k"]: r["silhouette"] for r in cluster.silhouettes(df, {m: F.col("label") % m for m in (2, 3, 6)}).collect()}
    assert got == {m: pytest.approx(v, rel=1e-9, abs=1e-9) for m, v in want.items()}
    assert cluster.silhouette(df).first()[0] == pytest.approx(want[6], rel=1e-9, abs=1e-9)
    assert cluster.silhouette(df.limit(0)).first()[0] is None


def test_scores_of_a_thousand_vectors_meet_in_one_block(spark):
    """Vectors are not copied to every 512 others, and pairs whose squares cancel or are not finite are measured by themselves."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1100, 3))
    df = spark.createDataFrame([(k, v.tolist(), k % 3) for k, v in enumerate(x)], "id long, x array<double>, label int")
    plan = cluster.cluster_scores(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition, REPARTITION_BY_NUM" in plan  # one pair of blocks
    x[5], x[6], x[9] = x[4], x[4] + 1e-9, [np.inf, 0, 0]
    label = np.arange(1100) // 400
    with np.errstate(invalid="ignore"):
        dist = np.linalg.norm(x[:, None] - x[None, :50], axis=2)
    got = cluster.distance_sums(x, x[:50], label, label[:50] + np.arange(50) // 20)
    want = np.stack([dist[:, :20].sum(axis=1), dist[:, 20:40].sum(axis=1), dist[:, 40:].sum(axis=1)], axis=1)
    assert np.allclose(got[0], want, rtol=1e-9, atol=0, equal_nan=True) and got[1].shape == (50, 3)
    assert np.allclose(got[1][:, 1], dist[400:800].sum(axis=0), rtol=1e-9, atol=0, equal_nan=True)


@pytest.mark.parametrize(("cells", "steps"), [(2, 1000), (3, 40), (1000, 7)])
def test_joint_hits_by_blocks(spark, rain, ranked, monkeypatch, cells, steps):
    """Pairs are counted where two blocks meet: with one span of steps, no row of a pair is shuffled; repeated rows count."""
    monkeypatch.setattr(graph, "HIT_CELLS", cells)
    monkeypatch.setattr(graph, "HIT_STEPS", steps)
    monkeypatch.setattr(graph, "SLAB", 2)
    u = ecdf(cube_of(spark, rain))
    u = u.unionAll(u.where("cell = 1 and t < 30"))
    rows = spark.createDataFrame([(0,), (1,), (4,)], "cell long")
    out = graph.joint_hits(u, 2, 5, 140, P, rows)
    got = {(r["i"], r["j"]): r["hits"] for r in out.collect()}
    often = lambda c, t: 2 if c == 1 and t < 30 else 1
    over = {(r["cell"], r["t"]) for r in u.where(F.col("u") >= P).collect()}
    want = {(i, j): sum(often(i, t + 2) * often(j, t) for t in range(5, 138) if (i, t + 2) in over and (j, t) in over) for i in (0, 1, 4) for j in range(6)}
    assert got == {k: n for k, n in want.items() if n}
    after = out._jdf.queryExecution().executedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString() and ("Exchange" in after) == (steps < 135)


def test_joint_hits_shuffle_lists_once(spark, rain, monkeypatch):
    """Lists of exceedances are not copied for the blocks they meet: as many rows are shuffled for one block as for six."""

    def written(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
            return written(node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan())
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(written(node.children().apply(k)) for k in range(node.children().size()))

    u = ecdf(cube_of(spark, rain))
    seen = []
    for cells in (1000, 1):
        monkeypatch.setattr(graph, "HIT_CELLS", cells)
        monkeypatch.setattr(graph, "LATE_CELLS", cells, raising=False)
        out = graph.joint_hits(u, 2, 5, 140, P)
        seen.append((sorted(tuple(r) for r in out.collect()), written(out._jdf.queryExecution().executedPlan())))
    assert seen[0] == seen[1] and len(seen[0][0]) > 6 and seen[0][1] > 0


@pytest.mark.parametrize("slab", [2, 100, 262_144])
def test_hits_of_two_blocks(monkeypatch, slab):
    """Parts of a block give the hits of the whole, repeated exceedances count, and rows of as many hits stand together."""
    import pyarrow as pa

    monkeypatch.setattr(graph, "SLAB", slab)
    rng = np.random.default_rng(3)
    sides = []
    for cells, highest in ((range(100, 140), 30), (range(9), 20)):
        x = {c: sorted(rng.integers(0, highest, rng.integers(1, 9)).tolist()) for c in cells}
        rows = pa.RecordBatch.from_pydict({"span": [0] * len(x), "cell": list(x), "x": list(x.values()), "like": rng.integers(0, 3, len(x))})
        sides.append((x, next(iter(graph._block(iter([rows]))))))
    names = [f"{side}_{c}" for side in ("late", "early") for c in ("span", "cells", "sizes", "x")]
    found = list(graph._hits_of_blocks(iter([pa.RecordBatch.from_arrays([c for _, b in sides for c in b.columns], names=names)])))
    want = {(i, j): sum(a.count(t) * b.count(t) for t in set(a)) for i, a in sides[0][0].items() for j, b in sides[1][0].items()}
    got = [tuple(r.values()) for batch in found for r in batch.to_pylist()]
    assert len(got) == len({r[:2] for r in got}) and {r[:2]: r[2] for r in got} == {k: n for k, n in want.items() if n}
    assert all(b["hits"].to_pylist() == sorted(b["hits"].to_pylist()) for b in found) and (len(found) == 1) == (slab > 100)


def test_axes_of_hdf5_cubes(spark, monkeypatch):
    import sys
    import types

    class File(dict):
        def __init__(self, path):
            super().__init__(lat=np.array([10.0, 9.0]), lon=np.array([100.0, 101.0, 102.0]))

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "h5py", types.SimpleNamespace(File=File))
    got = [tuple(r) for r in cubes.read_hdf5_grid(spark, "x.h5", "real").orderBy("cell").collect()]
    assert got == [(3 * i + j, i, j, 10.0 - i, 100.0 + j, True) for i in range(2) for j in range(3)]


def test_observations_outside_the_spine_stay(spark):
    seen = spark.createDataFrame([(0, 0, 5), (9, 1, 7)], "t long, cell long, value long")
    assert sorted(map(tuple, cubes.dense(seen, 2, 2).collect())) == [(0, 0, 5), (0, 1, 0), (1, 0, 0), (1, 1, 0), (9, 1, 7)]


def test_shuffled_batches_are_one_order(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    one, two = ({r["k"]: r["batch"] for r in selection.shuffled_batches(df.repartition(n), 32, ["k"]).collect()} for n in (1, 7))
    assert one == two and sorted(one.values()) == [k // 32 for k in range(500)] and [one[k] for k in range(500)] != sorted(one.values())


def test_linear_baseline_like_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.standard_normal(40) * 0.1
    df = spark.createDataFrame([(k, 0, x[k].tolist(), float(y[k])) for k in range(40)], "t long, cell long, x array<double>, y double")
    got = {r["t"]: (r["part"], r["y_pred"]) for r in pipelines.linear_baseline(df).collect()}
    a = np.column_stack([x, np.ones(40)])
    w = np.linalg.lstsq(a[:32], y[:32], rcond=None)[0]
    assert all(got[k] == ("train" if k < 32 else "validation", pytest.approx(float(a[k] @ w), abs=1e-6)) for k in range(40))


def brute_regions(u, members, weights, d_max, lags, s, e, rates, percent, tolerance, delta, max_iter):
    """Cluster by cluster, as one would write it down: own samples, own rates, own stop."""
    history, images = [], {}
    for o in sorted(members):
        w = np.array([weights[o, c] for c in range(u.shape[1])])
        lists, now = [sorted(members[o]), [c for c in range(u.shape[1]) if w[c] > np.percentile(w, percent)]], list(rates)
        for d in range(3, d_max + 1):
            seen, was = {}, None
            for k in range(max_iter):
                own = [x[: int(math.floor(len(x) * min(r, 1.0)))] for x, r in zip(lists, now, strict=False)]
                new = [t for t in itertools.product(*own) if t not in seen]
                if not new:
                    break
                for t in new:
                    seen[t] = [chi(u, (*t, c), lags, s, e, P)[0] for c in range(u.shape[1])]
                sums = [sum(h[c] for h in seen.values()) for c in range(u.shape[1])]
                mean = np.array(sums) / len(seen) / (e - s - sum(lags[: d - 1])) / (1 - P)
                error = None if was is None else float(np.abs(mean - was).mean())
                history.append((o, d, k, [pytest.approx(r) for r in now[: d - 1]], None if error is None else pytest.approx(error)))
                was, now = mean, [r + delta for r in now]
                images[o, d] = (len(seen), sums)
                if error is not None and error <= tolerance:
                    break
            if (o, d) not in images:
                break
            lists.append([c for c in range(u.shape[1]) if was[c] > np.percentile(was, percent)])
    return history, images


def test_each_region_stops_by_itself(spark, rain, ranked):
    u = ecdf(cube_of(spark, rain)).cache()
    members = {0: [0, 1, 2, 3, 4, 5], 1: [3, 4], 2: [5]}
    weights = {(o, c): float((c * (o + 2)) % 7) for o in members for c in range(6)}
    frames = spark.createDataFrame([(o, c) for o, x in members.items() for c in x], "origin long, cell long"), spark.createDataFrame([(*k, v) for k, v in weights.items()], "origin long, cell long, weight double")
    settings = ([0.4, 0.5, 0.6], 30, 0.05, 0.2, 6)
    found = explore.explore_regions(u, *frames, 4, [1, 1, 1], 0, 149, settings[0], P, *settings[1:], order=F.col("cell"))
    history, images = brute_regions(ranked, members, weights, 4, [1, 1, 1], 0, 149, *settings)
    assert [tuple(r) for r in found.history_table(spark).orderBy("origin", "d", "iteration").collect()] == history
    rounds = [sum(h[:2] == (o, 3) for h in history) for o in members]
    assert len(set(rounds)) > 1  # they do stop apart
    for d in (3, 4):
        got = {(r["origin"], r["cell"]): (r["count"], r["s"]) for r in found.steps[d].image.collect()}
        assert got == {(o, c): (n, sums[c]) for (o, x), (n, sums) in images.items() if x == d for c in range(6)}
        best = {r["origin"]: r["hits"] for r in found.steps[d].best.collect()}
        every = {}
        for r in found.steps[d].hits.collect():
            every[r["origin"]] = max(every.get(r["origin"], 0), r["hits"])
        assert all(best[o] == every.get(o, 0) for o in best)


def test_storms_are_dealt_out(spark, monkeypatch):
    """One step holds half of all exceedances: no task of the step's join meets more than its share, and the rows stay the same."""
    from tailweave.operators import storms

    rng = np.random.default_rng(4)
    rows = [(50, c) for c in range(120)] + [(51, c) for c in range(0, 120, 2)] + [(int(t), int(c)) for t, c in zip(rng.integers(0, 100, 180), rng.integers(0, 120, 180), strict=True)]
    over = spark.createDataFrame(sorted(set(rows)), "t long, cell long")
    lists = [spark.createDataFrame([(o, c, False) for o in range(3) for c in range(o, 120, 3 + k)], "origin long, cell long, old boolean") for k in range(2)]
    plain = {(r["origin"], tuple(r["path"])): r["hits"] for r in explore.evaluate(over, lists, [1, 1], 0, 99).collect()}
    monkeypatch.setattr(storms, "TOGETHER", 20)
    stormy = storms.storms(over)
    assert {r["t"]: r["parts"] for r in stormy.collect()}[50] >= 6
    dealt = {(r["origin"], tuple(r["path"])): r["hits"] for r in explore.evaluate(over, lists, [1, 1], 0, 99, stormy).collect()}
    assert plain and dealt == plain
    seen = []
    left = over.select(F.col("t").alias("tau"), F.col("cell").alias("i"))
    right = over.select(F.col("t").alias("tau"), F.col("cell").alias("j"))
    parts = storms.placed(stormy, [0])
    real = DataFrame_join(seen)
    monkeypatch.setattr(type(left), "join", real)
    out = storms.joined(left, right, ["tau"], parts, parts, F.col("i"), F.col("j"))
    monkeypatch.undo()
    assert out.count() == left.join(right, "tau").count()
    a, b, keys = seen[-1]
    most = max(r["l"] * r["r"] for r in a.groupBy(*keys).agg(F.count(F.lit(1)).alias("l")).join(b.groupBy(*keys).agg(F.count(F.lit(1)).alias("r")), keys).collect())
    assert most <= left.join(right, "tau").count() / 10  # half of all pairs without the grid


def DataFrame_join(seen):
    """DataFrame.join that notes what it joins."""
    from pyspark.sql.classic.dataframe import DataFrame as Own

    real = Own.join

    def join(self, other, on=None, how=None):
        seen.append((self, other, on))
        return real(self, other, on, how)

    return join


def test_nan_is_null_in_ranks_and_madogram(spark):
    from tailweave.functions import ranks

    rng = np.random.default_rng(8)
    clean = [(k % 2, float(x), float(y)) for k, (x, y) in enumerate(rng.random((200, 2)))]
    for hole in (math.nan, None):
        dirty = [*clean, *[(k % 2, float(x), hole) for k, x in enumerate(rng.random(50))], *[(k % 2, hole, 0.5) for k in range(9)]]
        a, b = (spark.createDataFrame(x, "g long, x double, y double") for x in (clean, dirty))
        assert tail.madogram(a, "x", "y").first()[0] == pytest.approx(tail.madogram(b, "x", "y").first()[0])
        by = [{r["g"]: pytest.approx(r["theta"]) for r in tail.madogram(df, "x", "y", ["g"]).collect()} for df in (a, b)]
        assert by[0] == by[1]
        u = ecdf(spark.createDataFrame([(k, 0, v) for k, v in enumerate([1.0, 2.0, hole, None])], "t long, cell long, value double"))
        assert [r["u"] for r in u.orderBy("t").collect()] == [pytest.approx(1 / 3), pytest.approx(2 / 3), None, None]
        u = ranks.ecdf_by_ranges(spark.createDataFrame([(k, 0, v) for k, v in enumerate([1.0, 2.0, hole, None])], "t long, cell long, value double"))
        assert [r["u"] for r in u.orderBy("t").collect()] == [pytest.approx(1 / 3), pytest.approx(2 / 3), None, None]


def test_long_series_among_many(spark, monkeypatch):
    """One series has most rows, and most of those one value; places and percentiles come from ranges."""
    from tailweave.functions import heavy, ranks

    monkeypatch.setattr(ranks, "LONG", 50)
    monkeypatch.setattr(ranks, "SERIES_RANGES", 8)
    monkeypatch.setattr(heavy, "LEAST_HEAVY", 10)
    rng = np.random.default_rng(2)
    rows = [(0, float(v)) for v in rng.integers(0, 400, 900)] + [(0, 7.0)] * 900 + [(c, float(v)) for c in range(1, 6) for v in rng.integers(0, 9, 30)] + [(3, None), (0, math.nan)]
    cube = spark.createDataFrame([(t, *r) for t, r in enumerate(rows)], "t long, cell long, value double")
    want = {(r["t"], r["cell"]): r["u"] and pytest.approx(r["u"]) for r in ecdf(cube).collect()}
    assert {(r["t"], r["cell"]): r["u"] for r in ranks.ecdf_by_ranges(cube).collect()} == want
    cut = ranks.placed_by_series(cube, "value", ["cell"])
    assert cut.where("cell = 0").count() > 50 and cut.count() == cube.where("value is not null and not isnan(value)").select("cell", "value").distinct().count()
    got = {r["cell"]: (r["n"], r["limit"]) for r in ranks.group_percentiles(cube, "value", ["cell"], 0.83).collect()}
    for c in range(6):
        own = [v for k, v in rows if k == c and v is not None and not math.isnan(v)]
        assert got[c] == (len(own), pytest.approx(np.quantile(own, 0.83)))
    edges = cube.where("value is not null and not isnan(value)").select(F.col("cell").alias("i"), F.col("t").alias("j"), F.col("value").alias("chi"))
    for strict in (False, True):
        one, two = ({tuple(r) for r in paths.top_neighbors(edges, 0.9, strict, by_ranges=x).collect()} for x in (False, True))
        assert one == two
    image = edges.withColumnRenamed("i", "origin")
    assert {tuple(r) for r in paths.image_selection(image, 40, "chi", ["origin"]).collect()} == {tuple(r) for r in paths.image_selection(image, 40, "chi", ["origin"], by_ranges=True).collect()}


@pytest.mark.parametrize("pairs", [10, 100_000])
def test_kendall_of_one_long_series(spark, monkeypatch, pairs):
    monkeypatch.setattr(metrics, "RANGE_PAIRS", pairs)
    rng = np.random.default_rng(pairs)
    x, y = rng.integers(0, 40, 400).astype(float), rng.normal(size=400).round(1)
    y[::3] += x[::3] / 10
    x[:130], y[100:220] = 5.0, 0.3  # one value of either column in a third of all rows
    con = dis = ty = tp = 0
    for i in range(400):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            con, dis, ty, tp = con + (a * b > 0), dis + (a * b < 0), ty + (a == 0), tp + (b == 0)
    n = 400 * 399 // 2
    frame = pair_frame(spark, [*x, math.nan, None], [*y, 1.0, 2.0])
    assert metrics.kendall_by_ranges(frame).first()[0] == pytest.approx((con - dis) / math.sqrt((n - ty) * (n - tp)))
    assert metrics.kendall_by_ranges(pair_frame(spark, [1, 1], [1, 2])).first()[0] is None
    assert metrics.kendall_by_ranges(pair_frame(spark, [], [])).first()[0] is None


def test_ordered_pairs_of_large_weights():
    rng = np.random.default_rng(1)
    rows = sorted({(int(a), int(b)) for a, b in rng.integers(0, 30, (300, 2))})
    x, y = (np.array(c, float) for c in zip(*rows, strict=True))
    for scale in (1, 10**9):
        n = rng.integers(1, 5, len(rows)) * scale
        want = sum(int(n[i]) * int(n[j]) * int(np.sign((x[i] - x[j]) * (y[i] - y[j]))) for i in range(len(rows)) for j in range(i))
        assert metrics.ordered_pairs(x, y, n) == want


def test_best_tuples_by_bound(spark, rain, ranked):
    """Same best tuples, fewer rows that meet the last node."""
    cube = cube_of(spark, rain)
    u = ecdf(cube).cache()
    cells = cube.select("cell").distinct()
    edges = graph.lag_graph(u, cells, 1, 0, 149, 0.8)
    for d, lags in ((3, [1, 2]), (4, [1, 2, 1])):
        found = explore.explore_stations(u, edges, cells, d, lags, 0, 149, 0.8, 30)
        want = {r["origin"]: (r["path"], r["hits"]) for r in found.steps[d].best.collect()}
        assert {r["origin"]: (r["path"], r["hits"]) for r in explore.best_chains(u, edges, cells, d, lags, 0, 149, 0.8, 30).collect()} == want
        over, every = explore.prepare(u, 0.8)
        best, steps = explore.best_by_bound(over, found.steps[d].lists, every, lags, 0, 149, 0.8)
        assert {r["origin"]: (r["path"], r["hits"]) for r in best.collect()} == want
        assert 0 < steps.count() < explore.joint_steps(over, found.steps[d].lists, lags, 0, 149).count()


def jobs_of(spark, run) -> int:
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("counted", "")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before


def test_folders_are_built_in_one_plan(spark, rain, tmp_path):
    """Cubes of different lengths and of one file name in two sub-folders: each as if it were alone, and no more jobs for more of them."""
    options = {"p": 0.8, "percent": 40}
    cubes_ = {"a": cube_of(spark, rain), "sub/a": cube_of(spark, rain[:120, ::-1].copy()), "b": cube_of(spark, rain[20:])}
    for folder, own in (("one", ["a"]), ("all", list(cubes_))):
        for name in own:
            cubes_[name].repartition(2).write.parquet(str(tmp_path / folder / f"{name}.parquet"))
    counts = {}
    for folder in ("one", "all"):
        counts[folder] = jobs_of(spark, lambda f=folder: pipelines.build_folder(spark, str(tmp_path / f), 3, [[1, 2]], str(tmp_path / f"{f}-out"), **options))
    assert abs(counts["all"] - counts["one"]) <= 6  # adaptive plans differ by a few
    for name, cube in cubes_.items():
        last = cube.agg(F.max("t")).first()[0]
        alone = pipelines.build_models(cube, 3, [[1, 2]], 0, last, **options)["1_2"]
        saved = pipelines.load_relations(spark, str(tmp_path / "all-out" / name))
        image = alone.found.steps[3].image.withColumn("d", F.lit(3))
        for relation, df in {"edges": alone.edges, "top": alone.top, "flow": alone.flow, "chains": alone.chains, "best": alone.found.steps[3].best, "image": image}.items():
            rows = lambda x, df=df: sorted((tuple(r) for r in x.select(*df.columns).collect()), key=str)
            assert rows(saved[relation]) == rows(df), (name, relation)
        assert saved["runs"].first()["end"] == last


def test_a_broken_build_is_resumed(spark, rain, tmp_path, monkeypatch):
    cube, options = cube_of(spark, rain), {"parts": 3, "p": 0.8, "percent": 40}
    build = lambda folder: pipelines.build_resumable(cube, 3, [[1, 1], [1, 2]], 0, 149, str(tmp_path / folder), **options)
    assert len(build("whole")) == 6
    real, calls = explore.explore_stations, []

    def breaks(*a, **b):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return real(*a, **b)

    monkeypatch.setattr(explore, "explore_stations", breaks)
    with pytest.raises(RuntimeError):
        build("broken")
    whole = sorted((tmp_path / "broken" / "chains").rglob("*.parquet"))
    times = [f.stat().st_mtime_ns for f in whole]
    assert build("broken") == [("1_2", 0), ("1_2", 1), ("1_2", 2)] and len(calls) == 7
    assert [f.stat().st_mtime_ns for f in whole] == times  # finished parts are left alone
    for relation in pipelines.SAVED:
        one, two = (spark.read.parquet(str(tmp_path / f / relation)) for f in ("whole", "broken"))
        assert sorted(map(str, one.collect())) == sorted(map(str, two.select(*one.columns).collect()))
    assert build("broken") == []
    options["p"] = 0.9
    assert len(build("broken")) == 6  # other settings are another model
    models = pipelines.build_models(cube, 3, [[1, 2]], 0, 149, p=0.9, percent=40)
    chains = pipelines.load_relations(spark, str(tmp_path / "broken"))["chains"].where("run_name = '1_2'")
    assert {r["origin"]: r["path"] for r in chains.collect()} == {r["origin"]: r["path"] for r in models["1_2"].chains.collect()}


@pytest.mark.parametrize("pool,stride", [(2, 2), (17, 3), (24, 1), (1, 1), (30, 5)])
def test_large_pools(spark, pool, stride):
    """Rows then columns for maxima, integral images for means: the rows that are grouped don't grow with the square of the pool."""
    x = np.random.default_rng(pool).integers(0, 50, (30, 30))
    df = spark.createDataFrame([(0, i * 30 + j, float(x[i, j])) for i in range(30) for j in range(30) if (i + j) % 7] + [(1, 0, None), (2, 899, 5.0)], "t long, cell long, value double")
    known = np.array([[bool((i + j) % 7) for j in range(30)] for i in range(30)])
    n = (30 - pool) // stride + 1
    windows_ = {(i, j): x[i * stride : i * stride + pool, j * stride : j * stride + pool][known[i * stride : i * stride + pool, j * stride : j * stride + pool]] for i in range(n) for j in range(n)}
    windows_ = {k: w for k, w in windows_.items() if len(w)}
    for func, np_func in ((F.max, np.max), (F.min, np.min), (F.sum, np.sum)):
        got = {(r["oi"], r["oj"]): r["value"] for r in pooling.pool_2d(df.where("t = 0"), 30, 30, pool, stride, func).collect()}
        assert got == {k: np_func(w) for k, w in windows_.items()}
    rows = pooling.pool_means(df, 30, 30, pool, stride).collect()
    assert {(r["oi"], r["oj"]): r["value"] for r in rows if r["t"] == 0} == {k: pytest.approx(w.mean()) for k, w in windows_.items()}
    assert {r["value"] for r in rows if r["t"] == 2} <= {5.0} and not [r for r in rows if r["t"] == 1]


def test_batches_of_one_long_series(spark):
    rows = [(k, float(v)) for k, v in enumerate([*range(300), *[7] * 200])] + [(999, None), (998, math.nan)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = selection.batched(df, 32, "v").collect()
    assert len(got) == len(rows) and sorted({r["k"] for r in got}) == sorted(k for k, _ in rows)
    placed = sorted(got, key=lambda r: (r["v"] is None or math.isnan(r["v"]), r["v"] or 0))
    assert [r["batch"] for r in placed] == [k // 32 for k in range(len(rows))]


def test_pictures_by_tasks_hold_every_pixel(spark):
    from tailweave.sources import pictures

    rng = np.random.default_rng(3)
    frames = spark.createDataFrame([(t, c, int(v)) for t in range(3) for c, v in enumerate(rng.integers(0, 256, 35 * 20))], "t long, cell long, pixel int")
    assert sorted(map(tuple, pictures.read_frames(pictures.film_frames(frames, 35, 20)).collect())) == sorted(map(tuple, frames.collect()))
    bands = spark.createDataFrame([(b, c, None if c == 3 else float(np.float32(rng.random()))) for b in range(2) for c in range(12)], "band int, cell long, value double")
    got = pictures.read_tiffs(pictures.tiff_bands(bands, [3.0, 2.0, 1.0], [1.0, 2.0, 3.0, 4.0])).collect()
    assert sorted(((r["band"], r["cell"], r["value"]) for r in got), key=str) == sorted((tuple(r) for r in bands.collect()), key=str)


def test_bucketed_stores_meet_without_exchange(spark, small):
    from tailweave import catalog_stores

    one, two = catalog_stores.stored_in_buckets(spark, small)
    had = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for stores of any size
    try:
        joined = one.join(two, ["t", "cell"])
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == two.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", had)


def test_dated_training_table_has_rows(spark):
    """Zero cells and cells with chains, at a scale where chains meet more than once."""
    from tailweave import catalog

    rows = catalog.queries()["puzzle_dated_dense"](spark, "/root/testdata/sf0.01")
    every, with_values = rows.agg(F.count(F.lit(1)), F.count_if(F.expr("x0 > 0 or y > 0"))).first()
    assert every > with_values > 0


def test_cluster_scores_make_their_centres_once(spark):
    df = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], k % 3) for k in range(60)], "id long, x array<double>, label int")
    plan = cluster.cluster_scores(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") <= 1  # the middle of all; the centres of labels are stored


@pytest.mark.parametrize("n", [1, 383, 800])
def test_pairs_of_one_block_are_measured_once(n):
    """Both sums of a block with itself come from half of the pairs; copies and far points are exact."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 5)) + 1e4
    x[n // 2 :: 3] = x[0]
    label = np.sort(rng.integers(0, 4, n))
    each = np.unique(label)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = np.stack([d[:, label == c].sum(axis=1) for c in each], axis=1)
    for got in cluster.distance_sums(x, None, label, label):
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)
