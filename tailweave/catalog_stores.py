"""Registered queries of readers, sinks and small expressions: most write a relation, read it back and give what was read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ALL3, CELLS, E1, E2, E22, F1, F2, F3, F4, F5, METRICS, P, U2, W_END, cells_of, d3_sql, graph_sql, hourly, met_cells, query, r, u_sql, weekly, weekly_edges
from .functions import metrics, scalars
from .functions.ranks import ecdf, zero_based_rank
from .operators import cluster, explore, graph, paths, selection
from .plans import pipelines
from .sources import cubes, pictures, sinks
from .storage import shared_folder, stored


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tailweave/stores-{uuid.uuid4().hex}"


def dates_of(spark: SparkSession) -> DataFrame:
    """The date of each week of the weekly cube."""
    return spark.range(cubes.WEEKLY_STEPS).select(F.col("id").alias("t"), F.expr("cast(date_add(date'1995-01-01', cast(7 * id as int)) as string)").alias("date"))


DATES = "dates AS (SELECT range AS t, strftime(DATE '1995-01-01' + CAST(7*range AS INTEGER), '%Y-%m-%d') AS date FROM range(358))"


# ---------------------------------------------------------------- cubes
@query(f"WITH {F1} SELECT t, cell, CAST(value AS DOUBLE) AS value FROM hourly")
def cube_store(spark, d):
    """A raw cube, written and read."""
    folder = scratch(spark)
    sinks.write_relations(folder, cube=hourly(spark, d).withColumn("value", F.col("value").cast("double")))
    return cubes.read_cube(spark, f"{folder}/cube")


@query(f"WITH {F2}, {DATES} SELECT weekly.t, cell, CASE WHEN value > 0 THEN CAST(value AS DOUBLE) END AS value, date FROM weekly JOIN dates ON dates.t = weekly.t")
def dated_cube_store(spark, d):
    """A cube with dates whose zeros are NaN, written and read: NaN comes back as NULL."""
    folder = scratch(spark)
    cube = weekly(spark, d).withColumn("value", F.when(F.col("value") > 0, F.col("value").cast("double")).otherwise(float("nan")))
    sinks.write_relations(folder, cube=pipelines.with_dates(cube, dates_of(spark)))
    return cubes.read_cube(spark, f"{folder}/cube", "real")


def missing_weekly(spark: SparkSession, d: str) -> DataFrame:
    """The weekly cube with NULL for weeks of less than a tenth of the cell's mean."""
    cube = weekly(spark, d)
    mean = cube.groupBy("cell").agg((F.sum("value") / F.count(F.lit(1))).alias("mean"))
    return cube.join(mean, "cell").select("t", "cell", F.when(F.col("value") * 10 >= F.col("mean"), F.col("value")).alias("value"))


MISSING = F2 + """, mean AS (SELECT cell, sum(value)/count(*)::DOUBLE AS mean FROM weekly GROUP BY cell),
gaps AS MATERIALIZED (SELECT weekly.t, weekly.cell, CASE WHEN value*10 >= mean THEN value END AS value FROM weekly JOIN mean ON mean.cell = weekly.cell),
ug AS MATERIALIZED (SELECT t, cell, (rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1)/2.0::DOUBLE)/(count(*) OVER (PARTITION BY cell) + 1) AS u FROM gaps WHERE value IS NOT NULL)"""


@query(f"WITH {MISSING} SELECT gaps.t, gaps.cell, u FROM gaps LEFT JOIN ug ON ug.t = gaps.t AND ug.cell = gaps.cell")
def ecdf_missing(spark, d):
    """Ranks of a cube with missing values: they have none and take none."""
    return ecdf(missing_weekly(spark, d))


@query(f"WITH {MISSING}, {graph_sql('ug', 1, W_END, 25)} SELECT i, j, hits, n, chi FROM edge")
def lag_graph_missing(spark, d):
    return graph.lag_graph(ecdf(missing_weekly(spark, d)), cells_of(spark, 25), 1, 0, W_END, P)


@query(f"""WITH {MISSING}, m AS (SELECT a.cell AS i, b.cell AS j, avg(abs(a.u - b.u)) AS m FROM ug a JOIN ug b ON a.t - 1 = b.t WHERE a.t >= 1 AND a.t < {W_END} GROUP BY 1, 2)
SELECT i, j, round((1 + 2*(0.5::DOUBLE*m))/nullif(1 - 2*(0.5::DOUBLE*m), 0), 9) AS theta FROM m""")
def madogram_missing(spark, d):
    return graph.madogram_graph(ecdf(missing_weekly(spark, d)), 1, 0, W_END).select("i", "j", r("theta").alias("theta"))


#: A cube that grows with the tables: weekly quantity by supplier, 1,000 suppliers for each 0.1 of scale.
SUPPLY = """sup AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))/7.0) AS BIGINT) AS t, l_suppkey AS cell, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2)"""


def supply_cube(spark: SparkSession, d: str) -> DataFrame:
    items = spark.read.parquet(f"{d}/lineitem.parquet")
    t = F.expr("cast(floor(datediff(to_date(l_shipdate), date'1995-01-01') / 7) as bigint)")
    return items.select(t.alias("t"), F.col("l_suppkey").alias("cell"), F.col("l_quantity").cast("bigint").alias("value")).groupBy("t", "cell").agg(F.sum("value").alias("value"))


@query(f"WITH {SUPPLY}, {u_sql('sup', 'us')}, h AS (SELECT a.cell AS i, b.cell AS j, count(*) AS hits FROM us a JOIN us b ON a.t - 1 = b.t WHERE a.u >= 0.95::DOUBLE AND b.u >= 0.95::DOUBLE AND a.t >= 1 AND a.t < {W_END} GROUP BY 1, 2) SELECT i, j, hits, CAST({W_END - 1} AS BIGINT) AS n, hits/{W_END - 1}.0::DOUBLE/(1 - 0.95::DOUBLE) AS chi FROM h")
def lag_graph_suppliers(spark, d):
    """The sparse graph of a cube whose cells grow with the tables."""
    over = stored(ecdf(supply_cube(spark, d)).where(F.col("u") >= P), "exceedances")  # read three times
    return graph.lag_graph(over, over.select("cell").distinct(), 1, 0, W_END, P, full=False, salt=4)


@query(f"WITH {SUPPLY}, {u_sql('sup', 'us')} SELECT t, cell, u FROM us")
def ecdf_suppliers(spark, d):
    return ecdf(supply_cube(spark, d))


# ---------------------------------------------------------------- nested and flat relations
@query(f"WITH {E2}, top AS (SELECT i, j, chi FROM (SELECT *, quantile_cont(chi, 0.9) OVER (PARTITION BY i) AS l FROM edge) WHERE chi >= l) SELECT i, j, chi, CASE WHEN chi > 0 THEN chi END AS positive FROM top")
def nested_store(spark, d):
    """Neighbour lists as nested documents, NULL members among them, written, read by a declared schema, and flattened."""
    path = scratch(spark)
    top = paths.top_neighbors(weekly_edges(spark, d), 0.9)
    links = F.struct("j", "chi", F.when(F.col("chi") > 0, F.col("chi")).alias("positive"))
    sinks.write_nested(top.groupBy("i").agg(F.array_sort(F.collect_list(links)).alias("links")), path)
    return cubes.read_nested(spark, path, "i long, links array<struct<j:long,chi:double,positive:double>>").select("i", F.inline("links"))


@query(f"WITH {E22} SELECT 1 AS lag, i, j, hits, chi FROM edge1 UNION ALL SELECT 2 AS lag, i, j, hits, chi FROM edge2")
def graph_store(spark, d):
    """Graphs of two lags in one folder; the first is written twice."""
    folder = scratch(spark)
    for lag in (1, 2, 1):
        sinks.write_graph(weekly_edges(spark, d, lag), folder, lag)
    return spark.read.parquet(folder).select("lag", "i", "j", "hits", "chi")


@query(f"WITH {E2} SELECT i, " + ", ".join(f"max(chi) FILTER (WHERE j = {j}) AS c{j}" for j in range(25)) + " FROM edge GROUP BY i")
def graph_matrix(spark, d):
    wide = sinks.matrix_view(weekly_edges(spark, d), list(range(25)))
    return wide.select("i", *[F.col(str(j)).alias(f"c{j}") for j in range(25)])


@query(f"WITH {E2}, x AS (SELECT i, max(chi) AS top, count(*) FILTER (WHERE hits > 0) AS links FROM edge GROUP BY i) SELECT 1 AS band, i AS cell, CAST(top AS FLOAT) AS value FROM x UNION ALL SELECT 2 AS band, i AS cell, CAST(links AS FLOAT) AS value FROM x")
def raster_store(spark, d):
    """Two bands of float pixels with metadata, written and read."""
    path = scratch(spark)
    own = weekly_edges(spark, d).groupBy("i").agg(F.max("chi").alias("top"), F.count_if(F.col("hits") > 0).cast("double").alias("links"))
    bands = own.select(F.col("i").alias("cell"), F.posexplode(F.array("top", "links")).alias("band", "value")).select((F.col("band") + 1).alias("band"), "cell", "value")
    sinks.write_raster(bands, path, [10.0 - k for k in range(5)], [100.0 + k for k in range(5)])
    return spark.read.parquet(f"{path}/pixels").select("band", "cell", "value")


@query(f"""WITH {CELLS}, a AS (SELECT 10.0::DOUBLE - cell // 5 AS lat, 100.0::DOUBLE + cell % 5 AS lon FROM seen)
SELECT 'EPSG:4326' AS crs, min(lon) - 0.5::DOUBLE AS west, max(lat) + 0.5::DOUBLE AS north, 1.0::DOUBLE AS pixel_x, 1.0::DOUBLE AS pixel_y, count(DISTINCT lat) AS height, count(DISTINCT lon) AS width FROM a""")
def raster_metadata(spark, d):
    """The metadata of a raster over the rows and columns that the weekly cube has values of."""
    path, cube = scratch(spark), weekly(spark, d)
    own = cubes.grid(spark, 5, 5).join(met_cells(cube), "cell", "left_semi")
    lat, lon = (sorted((r[0] for r in own.select(c).distinct().collect()), reverse=c == "lat") for c in ("lat", "lon"))  # the axes
    sinks.write_raster(cube.groupBy("cell").agg(F.sum("value").alias("value")).withColumn("band", F.lit(1)), path, lat, lon)
    kinds = "crs string, west double, north double, pixel_x double, pixel_y double, height long, width long"
    return spark.read.json(f"{path}/metadata").select(F.from_json("metadata", kinds).alias("m")).select("m.*")


@query(f"WITH {F4}, m AS (SELECT cell, {METRICS} FROM pair GROUP BY cell) SELECT cell, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM m")
def score_store(spark, d):
    """Scores by cell as CSV, written and read."""
    path = scratch(spark)
    own = metrics.metric_map(cubes.forecast_pair(spark, d), {"rmse": metrics.rmse, "mae": metrics.mae}).select("cell", r("rmse", 6).alias("rmse"), r("mae", 6).alias("mae"))
    sinks.write_scores(own, path)
    return spark.read.schema("cell long, rmse double, mae double").option("header", True).csv(path)


@query(f"WITH {E2}, n AS (SELECT i AS origin, 0 AS k, i AS c FROM edge WHERE hits > 0 UNION SELECT i, 1, min(j) FROM edge WHERE hits > 0 GROUP BY i) SELECT origin, k, 'POINT(' || (100 + c % 5) || '.0 ' || (10 - c // 5) || '.0)' AS wkt FROM n")
def points_wkt(spark, d):
    """Each cell that has links, and the first cell it is linked with."""
    nodes = weekly_edges(spark, d).where("hits > 0").groupBy(F.col("i").alias("origin")).agg(F.min("j").alias("j")).select("origin", F.array("origin", "j").alias("nodes"))
    return explore.wkt_points(nodes, cubes.grid(spark, 5, 5))


@query(f"""WITH {F2}, {DATES}, w AS (SELECT t, cell, list(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS x, value AS y FROM weekly)
SELECT CAST(date[1:4] AS INTEGER) AS date, w.t, cell, x[1] AS x0, x[2] AS x1, y FROM w JOIN dates ON dates.t = w.t WHERE len(x) = 2""")
def puzzle_store(spark, d):
    """A training table partitioned by (the year of) its date, written and read."""
    from .operators.lags import sequence_pairs

    path = scratch(spark)
    table = pipelines.with_dates(sequence_pairs(weekly(spark, d), 2), dates_of(spark)).withColumn("date", F.substring("date", 1, 4))
    sinks.write_puzzle(table.repartition("date"), path)
    return cubes.read_puzzle(spark, path).select("date", "t", "cell", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), "y")


@query(f"""WITH {F2}, w AS (SELECT t, cell, list(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS x FROM weekly)
SELECT w.t, w.cell, x[1] AS x0, x[2] AS x1, value AS y FROM w JOIN weekly ON weekly.t = w.t AND weekly.cell = w.cell WHERE len(x) = 2""")
def bucketed_stores(spark, d):
    """A cube and a training table stored in buckets by step and cell, and combined without an exchange."""
    one, two = stored_in_buckets(spark, d)
    return two.join(one, ["t", "cell"]).select("t", "cell", F.col("x")[0].alias("x0"), F.col("x")[1].alias("x1"), F.col("value").alias("y"))


def stored_in_buckets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from .operators.lags import sequence_pairs

    names = [f"bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    cube = weekly(spark, d)
    for name, df in zip(names, (cube, sequence_pairs(cube, 2).select("t", "cell", "x")), strict=True):
        sinks.write_bucketed(df, name, scratch(spark), buckets=8)
    return spark.table(names[0]), spark.table(names[1])


def file_heads(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(head, bytes): the first n bytes of each file, in hexadecimal, and its length."""
    return spark.read.format("binaryFile").load(path).select(F.hex(F.expr(f"substring(content, 1, {n})")).alias("head"), F.col("length").alias("bytes"))


@query(f"WITH {F1}, l AS (SELECT min(value) AS a, max(value) AS b FROM hourly) SELECT t, cell, CAST(floor((value - a)/(b - a)::DOUBLE*255) AS INTEGER) AS pixel FROM hourly CROSS JOIN l")
def film_store(spark, d):
    """The hourly cube as a film: frames encoded by the tasks that hold them, stored, and decoded to every pixel."""
    path = scratch(spark)
    pictures.film_frames(scalars.frames(hourly(spark, d)), 5, 4).write.parquet(path)
    return pictures.read_frames(spark.read.parquet(path))


@query(f"WITH {E2}, x AS (SELECT i, max(chi) AS top, count(*) FILTER (WHERE hits > 0) AS links FROM edge GROUP BY i) SELECT 0 AS band, i AS cell, CAST(top AS FLOAT) AS value FROM x UNION ALL SELECT 1 AS band, i AS cell, CAST(links AS FLOAT) AS value FROM x")
def tiff_store(spark, d):
    """Two bands as GeoTIFFs, each encoded by one task, stored, and decoded to every pixel."""
    path = scratch(spark)
    own = weekly_edges(spark, d).groupBy("i").agg(F.max("chi").alias("top"), F.count_if(F.col("hits") > 0).cast("double").alias("links"))
    bands = own.select(F.col("i").alias("cell"), F.posexplode(F.array("top", "links")).alias("band", "value"))
    pictures.tiff_bands(bands, [10.0 - k for k in range(5)], [100.0 + k for k in range(5)]).write.parquet(path)
    return pictures.read_tiffs(spark.read.parquet(path))


@query("SELECT '89504E470D0A1A0A' AS head, CAST(6 AS BIGINT) AS files")
def score_plots(spark, d):
    """The scores of a sweep over numbers of clusters as PNG curves."""
    folder = scratch(spark)
    points = stored(cluster.dependence_rows(weekly_edges(spark, d)), "rows")
    pictures.write_score_plots(stored(cluster.sweep(points, [2, 3, 4], restarts=3), "sweep"), folder)
    return file_heads(spark, folder, 8).groupBy("head").agg(F.count(F.lit(1)).alias("files"))


# ---------------------------------------------------------------- models and runs
@query(f"WITH {ALL3}, s AS (SELECT range AS origin FROM range(25)) SELECT '1_2' AS run_name, s.origin, coalesce(b, s.origin) AS b, coalesce(c, s.origin) AS c FROM s LEFT JOIN best ON best.origin = s.origin")
def model_store(spark, d):
    """A model of all relations, saved twice and loaded; its chains."""
    folder = scratch(spark)
    models = pipelines.build_models(weekly(spark, d), 5, [[1, 2]], 0, W_END)
    for _ in range(2):
        pipelines.save_models(models, folder)
    found = pipelines.load_relations(spark, folder)["chains"]
    return found.select("run_name", "origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))


@query(f"""WITH {ALL3}, s AS (SELECT range AS origin FROM range(25)), n AS (SELECT s.origin, coalesce(b, s.origin) AS b, coalesce(c, s.origin) AS c FROM s LEFT JOIN best ON best.origin = s.origin),
k AS (SELECT origin, 0 AS k, origin AS cell FROM n UNION ALL SELECT origin, 1 AS k, b AS cell FROM n UNION ALL SELECT origin, 2 AS k, c AS cell FROM n)
SELECT '1_2' AS run_name, '1,2' AS lags, 3 AS d, CAST({W_END} AS BIGINT) AS steps, origin, k, 10.0::DOUBLE - cell // 5 AS lat, 100.0::DOUBLE + cell % 5 AS lon FROM k""")
def model_points(spark, d):
    """The saved coordinates of a model's chains beside its settings."""
    folder = scratch(spark)
    pipelines.save_models(pipelines.build_models(weekly(spark, d), 5, [[1, 2]], 0, W_END), folder, cubes.grid(spark, 5, 5))
    runs = pipelines.load_relations(spark, folder)["runs"].select("run_name", F.array_join(F.transform("lags", lambda x: x.cast("string")), ",").alias("lags"), "d", F.col("end").alias("steps"))
    return spark.read.parquet(f"{folder}/points").join(F.broadcast(runs), "run_name").select("run_name", "lags", "d", "steps", "origin", "k", "lat", "lon")  # one row a run


@query(f"""WITH {CELLS} SELECT '1_1' AS run_name, cell AS origin, cell AS node FROM seen UNION ALL SELECT '1_2' AS run_name, cell AS origin, cell + 2 AS node FROM seen
UNION ALL SELECT '2_1' AS run_name, cell AS origin, cell + 2 AS node FROM seen""")
def model_merge(spark, d):
    """Two stores and a missing one: of runs with one name the later store's wins."""
    one, two = scratch(spark), scratch(spark)
    for folder, runs, more in ((one, ("1_1", "1_2"), 0), (two, ("1_2", "2_1"), 2)):
        rows = met_cells(weekly(spark, d)).select(F.explode(F.array(*map(F.lit, runs))).alias("run_name"), F.col("cell").alias("origin"), F.array("cell", F.col("cell") + more).alias("path"))
        sinks.append_runs(rows, f"{folder}/chains")
    found = pipelines.load_merged(spark, [one, f"{one}-none", two])
    return found.select("run_name", "origin", F.col("path")[1].alias("node"))


@query(f"WITH {ALL3}, s AS (SELECT range AS origin FROM range(25)) SELECT n.name, s.origin, coalesce(b, s.origin) AS b, coalesce(c, s.origin) AS c FROM (VALUES ('double'), ('single')) n(name) CROSS JOIN s LEFT JOIN best ON best.origin = s.origin")
def folder_models(spark, d):
    """Models of every cube of a folder; the second cube is twice the first, so its ranks and chains are the same."""
    folder, out = scratch(spark), scratch(spark)
    for name, times in (("single", 1), ("double", 2)):
        weekly(spark, d).withColumn("value", (F.col("value") * times).cast("double")).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    found = None
    for name in pipelines.build_folder(spark, folder, 5, [[1, 2]], out):
        own = pipelines.load_relations(spark, f"{out}/{name}")["chains"].select(F.lit(name).alias("name"), "origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))
        found = own if found is None else found.unionAll(own)
    return found


@query(f"WITH {ALL3}, s AS (SELECT range AS origin FROM range(25)) SELECT '1_2' AS run_name, s.origin, coalesce(b, s.origin) AS b, coalesce(c, s.origin) AS c FROM s LEFT JOIN best ON best.origin = s.origin")
def resumed_models(spark, d):
    """A model stored part by part, and once more: the second call finds every part in the ledger."""
    folder = scratch(spark)
    for _ in range(2):
        pipelines.build_resumable(weekly(spark, d), 5, [[1, 2]], 0, W_END, folder, parts=2)
    return pipelines.load_relations(spark, folder)["chains"].select("run_name", "origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))


@query(f"WITH {F2} SELECT 'year=' || (1995 + t // 52) AS part, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM weekly GROUP BY 1")
def folder_scan(spark, d):
    """All files below a folder, each row with the file it came from; another kind of file is passed over."""
    folder = scratch(spark)
    weekly(spark, d).withColumn("year", F.expr("1995 + t div 52")).repartition("year").write.partitionBy("year").parquet(folder)
    cells_of(spark, 3).write.mode("append").json(f"{folder}/other")
    rows = cubes.read_folder(spark, folder)
    return rows.groupBy(F.regexp_extract("source_file", "year=[0-9]+", 0).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


FIRST, LAST = 52, 300
LAND = U2 + f""", land AS MATERIALIZED (SELECT cell FROM weekly GROUP BY cell HAVING sum(value) >= (SELECT sum(value)/25.0::DOUBLE FROM weekly)),
{graph_sql("u2", 1, LAST, 25, "full_edge", FIRST)}, edge AS (SELECT full_edge.* FROM full_edge JOIN land ON land.cell = i), {d3_sql(1, 2, "true", start=FIRST, end=LAST)}, {DATES}"""


@query(f"""WITH {LAND}, p AS (SELECT land.cell AS origin, coalesce(b, land.cell) AS b, coalesce(c, land.cell) AS c FROM land LEFT JOIN best ON best.origin = land.cell)
SELECT dates.date, y.cell, y.value AS y_true, x.value AS y_pred FROM p JOIN weekly y ON y.cell = p.origin JOIN weekly x ON x.cell = p.b AND x.t = y.t - 1 JOIN dates ON dates.t = y.t WHERE y.t BETWEEN {FIRST + 1} AND {LAST}""")
def dated_land_forecast(spark, d):
    """A model run from date to date over land cells only, those of at least the mean total, and its persistence forecast with dates."""
    cube, dates = weekly(spark, d), dates_of(spark)
    start, end = pipelines.study_window(dates, "1995-12-31", "2000-10-01")
    total = cube.agg((F.sum("value") / 25).alias("mean"))
    land = stored(cube.groupBy("cell").agg(F.sum("value").alias("s")).crossJoin(F.broadcast(total)).where("s >= mean").select("cell"), "land")  # one row
    model = pipelines.build_models(cube, 5, [[1, 2]], start, end, land=land, salt=2)["1_2"]
    return pipelines.with_dates(pipelines.predict(model.chains, cube, 1, start + 1, end), dates).select("date", "cell", "y_true", "y_pred")


@query(f"""WITH {F4}, cut AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM pair)) WHERE k = floor(n*0.8::DOUBLE)),
f AS (SELECT regr_slope(y_true, y_pred) AS b, regr_intercept(y_true, y_pred) AS a FROM pair WHERE t <= (SELECT t FROM cut)),
o AS (SELECT CASE WHEN t <= (SELECT t FROM cut) THEN 'train' ELSE 'validation' END AS part, y_true, a + b*y_pred AS y_pred FROM pair CROSS JOIN f)
SELECT part, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse, round(1 - sum(pow(y_true - y_pred, 2))/(count(*)*var_pop(y_true)), 6) AS nse FROM o GROUP BY part""")
def linear_baseline_one(spark, d):
    """The linear baseline on one channel."""
    table = cubes.forecast_pair(spark, d).select("t", "cell", F.array("y_pred").alias("x"), F.col("y_true").alias("y"))
    return metrics.metric_map(pipelines.linear_baseline(table), {"rmse": metrics.rmse, "nse": metrics.nse}, ["part"]).select("part", r("rmse", 6).alias("rmse"), r("nse", 6).alias("nse"))


# ---------------------------------------------------------------- scalars
@query(f"WITH {F1} SELECT DISTINCT cell, cell // 4 AS i, cell % 4 AS j, CAST(cell AS BIGINT) AS again, cell // 4 AS key_i, cell % 4 AS key_j FROM hourly WHERE value > 0")
def flat_coordinates(spark, d):
    """Flat ids of cells with values to coordinates, back, and to keys."""
    cells = met_cells(hourly(spark, d))
    at = cells.select("cell", scalars.to_row(F.col("cell"), 4).alias("i"), scalars.to_column(F.col("cell"), 4).alias("j"))
    at = at.withColumn("again", scalars.to_flat(F.col("i"), F.col("j"), 4)).withColumn("key", scalars.coordinate_key(F.col("i"), F.col("j")))
    return at.select("cell", "i", "j", "again", F.col("key.i").alias("key_i"), F.col("key.j").alias("key_j"))


@query(f"WITH {F2} SELECT t, cell, value*value AS square FROM weekly")
def squares(spark, d):
    return weekly(spark, d).select("t", "cell", (F.col("value") * F.col("value")).alias("square"))


@query(f"WITH {CELLS} SELECT min(100.0::DOUBLE + cell % 5) AS west, max(100.0::DOUBLE + cell % 5) AS east, min(10.0::DOUBLE - cell // 5) AS south, max(10.0::DOUBLE - cell // 5) AS north FROM seen")
def grid_extent(spark, d):
    """The extent of the cells that the weekly cube has values of."""
    return scalars.extent(cubes.grid(spark, 5, 5).join(met_cells(weekly(spark, d)), "cell", "left_semi"))


@query(f"WITH {F2}, {DATES} SELECT dates.t, 'rain t=' || dates.t AS plain, 'rain ' || date AS dated FROM dates JOIN (SELECT DISTINCT t FROM weekly WHERE value > 0) w ON w.t = dates.t")
def frame_titles(spark, d):
    """Titles of the weeks with rain."""
    dates = pipelines.with_dates(weekly(spark, d).where("value > 0").select("t").distinct(), dates_of(spark))
    return dates.select("t", scalars.frame_title(F.col("t"), prefix="rain ").alias("plain"), scalars.frame_title(F.col("t"), F.col("date"), "rain ").alias("dated"))


@query("SELECT o_orderkey AS k, TRY_CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority WHEN o_orderstatus = 'F' THEN ' ' || o_totalprice ELSE '' END AS DOUBLE) AS number FROM orders")
def safe_numbers(spark, d):
    """Text as numbers; words and empty texts are NULL."""
    text = F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).when(F.col("o_orderstatus") == "F", F.concat(F.lit(" "), F.col("o_totalprice").cast("string"))).otherwise("")
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), scalars.safe_double(text).alias("number"))


@query(f"WITH {F5} SELECT k, coalesce(y_pred, 0) AS y_pred FROM orderpair")
def zero_filled(spark, d):
    return cubes.order_pair(spark, d).select("k", scalars.zero_for_missing(F.col("y_pred")).alias("y_pred"))


@query("SELECT vec_id AS id FROM embeddings WHERE list_max(embedding) <= 0.3::FLOAT")
def finite_rows(spark, d):
    """Vectors with no element over 0.3: others get NaN or infinities there and are left out."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    odd = F.transform("embedding", lambda v: F.when(v <= F.lit(0.3).cast("float"), v.cast("double")).when(F.col("vec_id") % 2 == 0, float("nan")).otherwise(float("inf")))
    return scalars.finite_vectors(e.select(F.col("vec_id").alias("id"), odd.alias("x")), "x").select("id")


@query(f"WITH {F1} SELECT t, cell, rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1)/2.0::DOUBLE - 1 AS rank FROM hourly")
def zero_based_ranks(spark, d):
    return hourly(spark, d).select("t", "cell", zero_based_rank("value", ["cell"]).alias("rank"))


# ---------------------------------------------------------------- sets and batches
@query(f"WITH {E22} SELECT i, j FROM edge1 WHERE hits > 0 EXCEPT SELECT i, j FROM edge2 WHERE hits > 0")
def novel_links(spark, d):
    """Links of the first lag, each given twice, that the second lag has not."""
    one, two = (weekly_edges(spark, d, lag).where("hits > 0").select("i", "j") for lag in (1, 2))
    return selection.unseen(one.unionAll(one), two, ["i", "j"])


@query(f"WITH {E22} SELECT 'one' AS run, i, j, hits FROM edge1 UNION ALL SELECT 'two' AS run, i, j, hits FROM edge2")
def stacked_runs(spark, d):
    return selection.stacked(one=weekly_edges(spark, d, 1), two=weekly_edges(spark, d, 2)).select("run", "i", "j", "hits")


@query(f"WITH {F1}, {F2} SELECT t FROM (SELECT DISTINCT t FROM hourly WHERE value > 0) INTERSECT SELECT t FROM weekly WHERE value > 0")
def common_steps(spark, d):
    return selection.common_keys([hourly(spark, d).where("value > 0"), weekly(spark, d).where("value > 0")], "t")


@query(f"WITH {F1} SELECT t, cell, CAST(floor((row_number() OVER (ORDER BY (t*7919 + cell*104729) % 1000003, t, cell) - 1)/32.0) AS BIGINT) AS batch FROM hourly")
def shuffled_batches(spark, d):
    """Batches of rows in a shuffled order that reruns keep."""
    order = ((F.col("t") * 7919 + F.col("cell") * 104729) % 1000003) * F.lit(1 << 43)
    return selection.shuffled_batches(hourly(spark, d), 32, ["t", "cell"], order=order).select("t", "cell", "batch")


#: Mean silhouettes of given clusterings: the labels themselves, and two coarser ones.
SILHOUETTES = f"""WITH {F3}, pr AS MATERIALIZED (SELECT a.t AS p, a.label AS lp, b.t AS q, b.label AS lq, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM image a JOIN image b ON a.cell = b.cell AND a.t <> b.t GROUP BY 1, 2, 3, 4),
mn AS (SELECT k, p, lp % k AS lp, lq % k AS lq, avg(d) AS m FROM pr CROSS JOIN (VALUES (2), (5), (10)) v(k) GROUP BY 1, 2, 3, 4),
ab AS (SELECT k, p, max(m) FILTER (WHERE lq = lp) AS a, min(m) FILTER (WHERE lq <> lp) AS b FROM mn GROUP BY 1, 2),
si AS (SELECT k, avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a)/nullif(greatest(a, b), 0) END) AS silhouette FROM ab GROUP BY k)"""


def _silhouettes(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
    return cluster.silhouettes(e, {k: F.col("label") % k for k in (2, 5, 10)})


@query(SILHOUETTES + " SELECT k, round(silhouette, 6) AS silhouette FROM si ORDER BY silhouette DESC, k LIMIT 1")
def best_cluster_count(spark, d):
    return cluster.best_k(_silhouettes(spark, d)).select("k", r("silhouette", 6).alias("silhouette"))


# ---------------------------------------------------------------- images of full window size
_G11 = metrics.gaussian(11)
_W11 = f"([{', '.join(f'{w!r}::DOUBLE' for w in _G11)}])"


@query(f"""WITH {F3}, q AS (SELECT t // 4 AS t, ((t % 4) // 2*8 + cell // 8)*16 + (t % 4) % 2*8 + cell % 8 AS cell, value FROM image),
ip AS MATERIALIZED (SELECT a.t, a.cell, a.value AS y_true, b.value AS y_pred FROM q a JOIN q b ON a.cell = b.cell AND b.t = a.t - 1),
wt AS MATERIALIZED (SELECT t, oi, oj, {_W11}[cell // 16 - oi + 1]*{_W11}[cell % 16 - oj + 1] AS w, y_true, y_pred FROM ip CROSS JOIN range(6) x(oi) CROSS JOIN range(6) y(oj) WHERE cell // 16 - oi BETWEEN 0 AND 10 AND cell % 16 - oj BETWEEN 0 AND 10),
l AS MATERIALIZED (SELECT t, oi, oj, sum(w*y_true) AS ma, sum(w*y_pred) AS mb, sum(w*y_true*y_true) AS aa, sum(w*y_pred*y_pred) AS bb, sum(w*y_true*y_pred) AS ab FROM wt GROUP BY 1, 2, 3)
SELECT t, round(avg((2*ma*mb + 0.0001::DOUBLE)/(ma*ma + mb*mb + 0.0001::DOUBLE)*(2*(ab - ma*mb) + 0.0009::DOUBLE)/(aa - ma*ma + bb - mb*mb + 0.0009::DOUBLE)), 6) AS ssim FROM l GROUP BY t""")
def ssim_window11(spark, d):
    """Similarity by the full window, on images of 16 x 16 made of four."""
    cube = cubes.image_cube(spark, d)
    row = F.expr("(t % 4) div 2 * 8 + cell div 8")
    column = F.expr("(t % 4) % 2 * 8 + cell % 8")
    big = cube.select(F.expr("t div 4").alias("t"), (row * 16 + column).alias("cell"), "value")
    before = big.select((F.col("t") + 1).alias("t"), "cell", F.col("value").alias("y_pred"))
    pair = big.select("t", "cell", F.col("value").alias("y_true")).join(before, ["t", "cell"])
    return metrics.ssim(pair, 16, 16).select("t", r("ssim", 6).alias("ssim"))


@query(f"WITH {E1} SELECT i, j, hits FROM edge WHERE hits > 0")
def hourly_links(spark, d):
    """Hits of a graph from packed exceedance times of all pairs of cells."""
    ranks = stored(ecdf(hourly(spark, d)), "ecdf")
    pairs = graph.pair_domain(cells_of(spark, 20)).select(F.array("j", "i").alias("path"))
    hits = graph.bitset_hits(ranks, pairs, [0, 1], 0, cubes.HOURLY_STEPS - 2, P).where("hits > 0")
    return hits.select(F.col("path")[1].alias("i"), F.col("path")[0].alias("j"), "hits")
