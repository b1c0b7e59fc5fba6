"""End-to-end flows: models, training tables, verification."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics
from ..functions.ranks import ecdf
from ..operators import explore, graph, paths, puzzle
from ..operators.lags import sequence_pairs
from ..operators.selection import positional_split
from ..schema import require
from ..sources.cubes import read_folder
from ..sources.sinks import append_runs
from ..storage import move, remove, stored


@dataclass
class Model:
    """Relations of one lag list."""

    lags: list[int]
    ecdf: DataFrame
    edges: DataFrame
    top: DataFrame
    flow: DataFrame
    found: explore.Exploration
    chains: DataFrame  # origin, path; the own cell repeated where nothing was found
    settings: dict  # d, rates, p, q, percent, start, end


def study_window(dates: DataFrame, first: str, last: str) -> tuple[int, int]:
    """[start, end) of two dates, by exact match; the last date's own step is not used.  Missing dates are an error."""
    found = {r["date"]: r["t"] for r in dates.where(F.col("date").isin(first, last)).select("date", "t").collect()}
    for d in (first, last):
        if d not in found:
            raise ValueError(f"no step has the date {d}")
    return found[first], found[last]


def with_dates(table: DataFrame, dates: DataFrame) -> DataFrame:
    """table with its step's date; steps without one are left out."""
    return table.join(dates.select("t", "date"), "t")


def build_models(cube: DataFrame, width: int, lag_lists: Sequence[Sequence[int]], start: int, end: int, d: int = 3, p: float = 0.95, q: float = 0.9, percent: float = 50.0, rates: Sequence[float] | None = None, land: DataFrame | None = None, keep: bool = True, salt: int = 1) -> dict[str, Model]:
    """One model a lag list; lag lists with one first lag share their graph, and all share the ranks.

    salt: over so many tasks each step's pairs of exceedances are dealt, where storms make steps uneven.
    """
    hold = stored if keep else (lambda df, _: df)
    ranks = hold(ecdf(cube), "ecdf")
    prepared = explore.prepare(ranks, p, keep)
    cells = prepared[1]
    rows = land if land is not None else cells
    edges, out = {}, {}
    for lags in lag_lists:
        if lags[0] not in edges:
            edges[lags[0]] = hold(graph.lag_graph(ranks, cells, lags[0], start, end, p, rows, salt=salt), "edges")
        own = edges[lags[0]]
        top = paths.top_neighbors(own, q)
        found = explore.explore_stations(ranks, own, rows, d, lags, start, end, p, percent, rates, keep=keep, prepared=prepared)
        best = explore.best_or_self(rows, found.steps[d].best, d)
        settings = {"d": d, "rates": [float(x) for x in rates or [1.0] * (d - 1)], "p": p, "q": q, "percent": float(percent), "start": start, "end": end}
        out["_".join(map(str, lags))] = Model(list(lags), ranks, own, top, paths.flow_vectors(top, width), found, best, settings)
    return out


RUN_COLUMNS = "lags array<int>, d int, rates array<double>, p double, q double, percent double, start long, end long"
#: Relations of a saved model; points only where a grid was given.
SAVED = ("edges", "top", "flow", "best", "image", "chains", "runs")


def save_models(models: dict[str, Model], folder: str, grid: DataFrame | None = None) -> None:
    """Relations of all models, partitioned by run; a run that is saved again replaces itself only.

    runs: the settings (lags, d, rates, p, q, percent, start, end); image: of every d; points, with a grid: the chains' coordinates.
    """
    for key, m in models.items():
        images = None
        for d, step in sorted(m.found.steps.items()):
            own = step.image.withColumn("d", F.lit(d))
            images = own if images is None else images.unionByName(own)
        x = m.settings
        runs = m.edges.sparkSession.createDataFrame([(m.lags, x["d"], x["rates"], x["p"], x["q"], x["percent"], x["start"], x["end"])], RUN_COLUMNS)
        relations = {"edges": m.edges, "top": m.top, "flow": m.flow, "best": m.found.steps[max(m.found.steps)].best, "image": images, "chains": m.chains, "runs": runs}
        if grid is not None:
            nodes = m.chains.select("origin", F.posexplode("path").alias("k", "cell"))
            relations["points"] = nodes.join(grid.select("cell", "lat", "lon"), "cell").select("origin", "k", "cell", "lat", "lon")
        for name, df in relations.items():
            append_runs(df.withColumn("run_name", F.lit(key)), f"{folder}/{name}")


def load_relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The saved relations, each with its run_name."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in SAVED}


def load_merged(spark: SparkSession, folders: Sequence[str], relation: str = "chains") -> DataFrame:
    """One relation of several stores; of runs with one name the last folder's wins.  Folders that don't exist are passed over."""
    found = []
    for folder in folders:
        try:
            found.append(spark.read.parquet(f"{folder}/{relation}"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if not found:
        raise ValueError("none of the model folders exists")
    both = reduce(DataFrame.unionByName, [df.withColumn("__source", F.lit(k)) for k, df in enumerate(found)])
    newest = both.groupBy("run_name").agg(F.max("__source").alias("__source"))
    return both.join(newest, ["run_name", "__source"]).drop("__source")


def build_folder(spark: SparkSession, folder: str, width: int, lag_lists: Sequence[Sequence[int]], out: str, suffix: str = ".parquet", d: int = 3, p: float = 0.95, q: float = 0.9, percent: float = 50.0, rates: Sequence[float] | None = None) -> list[str]:
    """Models of every cube below a folder, all in one plan; returns their names.  A cube is a file, or a folder of files, with the suffix.

    A cube's name is its path below the folder, so equal names in two sub-folders stay apart.  Each cube's window is [0, its last step).  Each has
    a folder of the relations of ``save_models`` under its name; the number of jobs does not depend on the number of cubes.
    """
    base = folder.rstrip("/").split("://")[-1].removeprefix("file:")
    rows = read_folder(spark, folder, suffix)
    rows = rows.withColumn("cube", F.regexp_extract("source_file", rf"{re.escape(base)}/(.+?){re.escape(suffix)}(/|$)", 1))
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = stored(rows.select("cube", F.col("t").cast("bigint").alias("t"), F.col("cell").cast("bigint").alias("cell"), value.alias("value")), "cubes")
    each = sorted(tuple(r) for r in rows.groupBy("cube").agg(F.max("t"), F.max("cell")).collect())  # one row a cube
    names = [name for name, _, _ in each]
    cubes = explore.Cubes(width * -(-(1 + max(c for _, _, c in each)) // width), 1 + max(t for _, t, _ in each) + max(map(sum, lag_lists)), [t for _, t, _ in each])
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "__k long, cube string"))  # one row a cube
    moved = rows.join(number, "cube").select((F.col("t") + F.col("__k") * cubes.steps_each).alias("t"), (F.col("cell") + F.col("__k") * cubes.cells_each).alias("cell"), "value")
    ranks = stored(ecdf(moved), "ecdf")
    over, cells = explore.prepare(ranks, p)
    over, end = stored(cubes.windowed(over), "exceedances"), len(names) * cubes.steps_each
    pairs = explore.beside(cells.select(F.col("cell").alias("origin")), cells, cubes).select(F.col("origin").alias("i"), F.col("cell").alias("j"))
    settings = {"d": d, "rates": [float(x) for x in rates or [1.0] * (d - 1)], "p": p, "q": q, "percent": float(percent)}
    back = lambda c: F.col(c) % cubes.cells_each
    edges = {}
    for lags in lag_lists:
        if lags[0] not in edges:
            seen = cubes.windowed(ranks)
            edges[lags[0]] = stored(graph.lag_graph(seen, cells, lags[0], 0, end, p, domain=pairs, steps=cubes.steps("i", lags[0])), "edges")
        own = edges[lags[0]]
        found = explore.explore_stations(ranks, own, cells, d, lags, 0, end, p, percent, rates, prepared=(over, cells), cubes=cubes)
        last = found.steps[d].best

        def told(df: DataFrame, key: str, *ids: str, path: bool = False) -> DataFrame:
            """df with its cube's name, and the ids that its own cube gave."""
            out = df.withColumn("__k", F.expr(f"{key} div {cubes.cells_each}")).withColumns({c: back(c) for c in ids})
            out = out.withColumn("path", F.transform("path", lambda x: x % cubes.cells_each)) if path else out
            return out.join(number, "__k").drop("__k")

        top = told(paths.top_neighbors(own, q), "i", "i", "j")
        images = reduce(DataFrame.unionByName, [step.image.withColumn("d", F.lit(k)) for k, step in sorted(found.steps.items())])
        runs = spark.createDataFrame([(name, list(lags), settings["d"], settings["rates"], p, q, settings["percent"], 0, last_) for name, last_ in zip(names, cubes.ends, strict=True)], f"cube string, {RUN_COLUMNS}")
        relations = {
            "edges": told(own, "i", "i", "j"), "top": top, "flow": paths.flow_vectors(top, width, ["cube"]), "best": told(last, "origin", "origin", path=True),
            "image": told(images, "origin", "origin", "cell"), "chains": told(explore.best_or_self(cells, last, d), "origin", "origin", path=True), "runs": runs,
        }
        key, staged = "_".join(map(str, lags)), f"{out.rstrip('/')}/_building-{uuid.uuid4().hex}"
        for name, df in relations.items():
            df.join(number, "cube").drop("cube").write.partitionBy("__k").parquet(f"{staged}/{name}")
        for k, cube in enumerate(names):  # no jobs, renames only
            for name in relations:
                move(spark, f"{staged}/{name}/__k={k}", f"{out}/{cube}/{name}/run_name={key}")
        remove(spark, staged)
    return names


def build_resumable(cube: DataFrame, width: int, lag_lists: Sequence[Sequence[int]], start: int, end: int, folder: str, parts: int = 8, d: int = 3, p: float = 0.95, q: float = 0.9, percent: float = 50.0, rates: Sequence[float] | None = None, land: DataFrame | None = None) -> list[tuple[str, int]]:
    """The models of ``build_models``, stored part by part with a ledger; returns the (run, part) pairs that this call built.

    A part is a range of hashed origins.  Its relations replace what an earlier try left of it, and then one row in the ledger says that it is whole;
    a call after a broken one leaves out what the ledger has with the same settings.  Read it with ``load_relations``.
    """
    spark = cube.sparkSession
    ranks = stored(ecdf(cube), "ecdf")
    prepared = explore.prepare(ranks, p)
    rows = land if land is not None else prepared[1]
    settings = {"d": d, "rates": [float(x) for x in rates or [1.0] * (d - 1)], "p": p, "q": q, "percent": float(percent), "start": start, "end": end, "parts": parts}
    wanted = [("_".join(map(str, lags)), list(lags), part) for lags in lag_lists for part in range(parts)]
    done, built = finished(spark, folder, json.dumps(settings, sort_keys=True)), []
    part_of = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    edges = {}
    for key, lags, part in wanted:
        if (key, part) in done:
            continue
        if lags[0] not in edges:
            edges[lags[0]] = stored(graph.lag_graph(ranks, prepared[1], lags[0], start, end, p, rows), "edges")
        stations = rows.where(part_of("cell") == part).select("cell")
        own = edges[lags[0]].where(part_of("i") == part)
        found = explore.explore_stations(ranks, own, stations, d, lags, start, end, p, percent, rates, prepared=prepared)
        top = paths.top_neighbors(own, q)
        x = settings
        relations = {
            "edges": own, "top": top, "flow": paths.flow_vectors(top, width), "best": found.steps[d].best, "chains": explore.best_or_self(stations, found.steps[d].best, d),
            "image": reduce(DataFrame.unionByName, [step.image.withColumn("d", F.lit(k)) for k, step in sorted(found.steps.items())]),
            "runs": spark.createDataFrame([(lags, x["d"], x["rates"], x["p"], x["q"], x["percent"], x["start"], x["end"])], RUN_COLUMNS),
        }
        for name, df in relations.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}/run_name={key}/part={part}")
        spark.createDataFrame([(key, part, json.dumps(settings, sort_keys=True))], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ledger/{key}-{part}")
        built.append((key, part))
    return built


LEDGER = "run string, number int, settings string"


def finished(spark: SparkSession, folder: str, settings: str) -> set[tuple[str, int]]:
    """The (run, part) pairs that a folder's ledger calls whole under these settings: one row each."""
    try:
        rows = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(f"{folder}/ledger").where(F.col("settings") == settings).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return set()
    return {(r["run"], r["number"]) for r in rows}


def predict(chains: DataFrame, cube: DataFrame, lag: int, first: int, last: int, every: int = 1, value: str = "value") -> DataFrame:
    """Persistence forecast for steps first to last (both included), as means over ``every`` steps if more than 1."""
    own = puzzle.persistence(chains, cube, lag, value).where(F.col("t").between(first, last))
    return own if every == 1 else puzzle.resampled(own, every)


def training_table(cube: DataFrame, models: dict[str, Model], start: int, end: int, cells: DataFrame | None = None, value: str = "value") -> DataFrame:
    """puzzle(t, cell, x, y) over all lag lists."""
    lists = {k: m.lags for k, m in models.items()}
    blocks = puzzle.joint_blocks({k: m.chains for k, m in models.items()}, cube, lists, start, end, value)
    return puzzle.puzzle(blocks, lists, cells)


def baseline(cube: DataFrame, length: int = 3, share: float = 0.8, value: str = "value") -> DataFrame:
    """forecast(cell, t, part, y_true, y_pred): last value before, split by time; stands in for a trained network."""
    pairs = sequence_pairs(cube, length, value).select("cell", "t", F.col("y").alias("y_true"), F.element_at("x", -1).alias("y_pred"))
    return positional_split(pairs, share, "t")


def linear_baseline(table: DataFrame, share: float = 0.8) -> DataFrame:
    """forecast(cell, t, part, y_true, y_pred): linear regression on the puzzle's channels, fitted on its first dates."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    data = positional_split(stored(require(table, "puzzle"), "puzzle"), share, "t").withColumn("features", array_to_vector("x"))
    model = LinearRegression(labelCol="y", predictionCol="y_pred").fit(data.where("part = 'train'"))
    return model.transform(data).select("cell", "t", "part", F.col("y").alias("y_true"), "y_pred")


def compare(**forecasts: DataFrame) -> DataFrame:
    """(metric, one column a run) of the verification bundle."""
    return metrics.compared(**{n: metrics.bundle(f) for n, f in forecasts.items()})
