"""Registered queries of the engine, each with DuckDB SQL for the same rows where SQL can express it.

Settings: threshold 0.95, lag 1, windows [0, T - 1) (half open, so the last step is unused).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metrics, scalars
from .functions.ranks import ecdf, ecdf_by_ranges
from .operators import cluster, explore, graph, paths, pooling, puzzle, selection, tail
from .operators.lags import lag_pairs, sequence_pairs
from .plans import pipelines
from .sources import cubes
from .storage import stored

P = 0.95
H_END, W_END = cubes.HOURLY_STEPS - 1, cubes.WEEKLY_STEPS - 1
LAGS = {"1_1": [1, 1], "1_2": [1, 2], "2_1": [2, 1]}
PERCENT = 50.0

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def r(x, digits: int = 9):
    return F.round(x, digits)


# ---------------------------------------------------------------- inputs
F1 = """o1 AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', ts) AS t,
  (CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END)*4 + user_id%4 AS cell,
  CAST(round(value*100) AS BIGINT) AS c FROM events),
a1 AS (SELECT t, cell, sum(c) AS c FROM o1 GROUP BY t, cell),
hourly AS MATERIALIZED (SELECT coalesce(g.t, a1.t) AS t, coalesce(g.cell, a1.cell) AS cell, CAST(coalesce(a1.c, 0) AS BIGINT) AS value
FROM (SELECT x.range AS t, y.range AS cell FROM range(720) x CROSS JOIN range(20) y) g FULL JOIN a1 ON a1.t = g.t AND a1.cell = g.cell)"""
F2 = """o2 AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 7.0) AS BIGINT) AS t,
  CAST((s_nationkey%5)*5 + s_nationkey//5 AS BIGINT) AS cell, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
a2 AS (SELECT t, cell, CAST(sum(q) AS BIGINT) AS q FROM o2 GROUP BY t, cell),
weekly AS MATERIALIZED (SELECT coalesce(g.t, a2.t) AS t, coalesce(g.cell, a2.cell) AS cell, CAST(coalesce(a2.q, 0) AS BIGINT) AS value
FROM (SELECT x.range AS t, y.range AS cell FROM range(358) x CROSS JOIN range(25) y) g FULL JOIN a2 ON a2.t = g.t AND a2.cell = g.cell)"""
F3 = """image AS MATERIALIZED (SELECT vec_id AS t, p.range AS cell, CAST(embedding[p.range + 1] AS DOUBLE) AS value, label
FROM embeddings CROSS JOIN range(64) p)"""
F4 = F1 + """, pair AS (SELECT * FROM (SELECT cell, t, value/100.0::DOUBLE AS y_true,
  lag(value) OVER (PARTITION BY cell ORDER BY t)/100.0::DOUBLE AS y_pred FROM hourly) WHERE y_pred IS NOT NULL)"""
F5 = """orderpair AS (SELECT o_orderkey AS k, o_totalprice AS y_true, s.p AS y_pred FROM orders LEFT JOIN
 (SELECT l_orderkey, sum(CAST(round(l_extendedprice*100) AS BIGINT))/100.0::DOUBLE AS p FROM lineitem GROUP BY 1) s ON o_orderkey = s.l_orderkey)"""


def u_sql(source: str, name: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT t, cell, (rank() OVER (PARTITION BY cell ORDER BY value) + (count(*) OVER (PARTITION BY cell, value) - 1)/2.0::DOUBLE)
  / (count(*) OVER (PARTITION BY cell) + 1) AS u FROM {source})"""


def graph_sql(u: str, lag: int, end: int, cells: int, name: str = "edge", start: int = 0) -> str:
    n = end - start - lag
    return f"""{name}_h AS (SELECT a.cell AS i, b.cell AS j, count(*) AS hits FROM {u} a JOIN {u} b ON a.t - {lag} = b.t
  WHERE a.u >= 0.95::DOUBLE AND b.u >= 0.95::DOUBLE AND a.t >= {start + lag} AND a.t < {end} GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT x.range AS i, y.range AS j, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST({n} AS BIGINT) AS n,
  coalesce(hits, 0)/{n}.0::DOUBLE/(1 - 0.95::DOUBLE) AS chi
  FROM range({cells}) x CROSS JOIN range({cells}) y LEFT JOIN {name}_h h ON h.i = x.range AND h.j = y.range)"""


U1 = F1 + ", " + u_sql("hourly", "u1")
U2 = F2 + ", " + u_sql("weekly", "u2")
E1 = U1 + ", " + graph_sql("u1", 1, H_END, 20)
E2 = U2 + ", " + graph_sql("u2", 1, W_END, 25)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return cubes.hourly_cents(spark, d).withColumnRenamed("value_cents", "value")


def weekly(spark: SparkSession, d: str) -> DataFrame:
    return cubes.weekly_quantity(spark, d)


def cells_of(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("cell"))


def weekly_edges(spark: SparkSession, d: str, lag: int = 1) -> DataFrame:
    return graph.lag_graph(ecdf(weekly(spark, d)), cells_of(spark, 25), lag, 0, W_END, P)


def met_cells(cube: DataFrame) -> DataFrame:
    """Cells of a cube that ever have a value above 0."""
    return cube.where("value > 0").select("cell").distinct()


CELLS = F2 + ", seen AS (SELECT DISTINCT cell FROM weekly WHERE value > 0)"


@query(f"WITH {CELLS} SELECT cell, cell // 5 AS i, cell % 5 AS j, 10.0::DOUBLE - cell // 5 AS lat, 100.0::DOUBLE + cell % 5 AS lon FROM seen")
def grid_cells(spark, d):
    """The grid's cells that the weekly cube has values of."""
    return cubes.grid(spark, 5, 5).join(met_cells(weekly(spark, d)), "cell", "left_semi").drop("is_land")


@query(f"WITH {F1} SELECT t, cell, value FROM hourly")
def cube_hourly(spark, d):
    return hourly(spark, d)


@query(f"WITH {F2} SELECT t, cell, value FROM weekly")
def cube_weekly(spark, d):
    return weekly(spark, d)


@query(f"WITH {F3} SELECT t, cell, value, label FROM image")
def cube_image(spark, d):
    return cubes.image_cube(spark, d)


@query(f"WITH {CELLS} SELECT 'lags_1_2_cell_' || cell AS name, '[' || cell // 5 || ' ' || cell % 5 || ']' AS key FROM seen")
def run_names(spark, d):
    g = cubes.grid(spark, 5, 5).join(met_cells(weekly(spark, d)), "cell", "left_semi")
    return g.select(scalars.run_name([1, 2], F.col("cell")).alias("name"), scalars.key_text(F.col("i"), F.col("j")).alias("key"))


# ---------------------------------------------------------------- ranks and lags
@query(f"WITH {U1} SELECT t, cell, u FROM u1")
def ecdf_hourly(spark, d):
    return ecdf(hourly(spark, d))


@query(f"WITH {U2} SELECT t, cell, u FROM u2")
def ecdf_weekly(spark, d):
    return ecdf(weekly(spark, d))


@query(f"WITH {F3}, {u_sql('image', 'u3')} SELECT t, cell, u FROM u3")
def ecdf_image(spark, d):
    return ecdf(cubes.image_cube(spark, d))


@query(f"WITH {U1} SELECT a.t - 1 AS tau, a.cell, a.u AS u_late, b.u AS u_early FROM u1 a JOIN u1 b ON a.cell = b.cell AND a.t - 1 = b.t WHERE a.t >= 1 AND a.t < {H_END}")
def lag_pairs_hourly(spark, d):
    return lag_pairs(ecdf(hourly(spark, d)), 1, 0, H_END)


@query(f"WITH {F1}, w AS (SELECT t, cell, list(value) OVER (PARTITION BY cell ORDER BY t ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS x, value AS y FROM hourly) SELECT t, cell, x[1] AS x1, x[2] AS x2, x[3] AS x3, y FROM w WHERE len(x) = 3")
def sequence_pairs_hourly(spark, d):
    found = sequence_pairs(hourly(spark, d), 3)
    return found.select("t", "cell", *[F.col("x")[k].alias(f"x{k + 1}") for k in range(3)], "y")


# ---------------------------------------------------------------- tail dependence and graphs
@query(f"WITH {E1} SELECT i, j, hits, n, chi FROM edge")
def lag_graph_hourly(spark, d):
    return graph.lag_graph(ecdf(hourly(spark, d)), cells_of(spark, 20), 1, 0, H_END, P)


@query(f"WITH {E2} SELECT i, j, hits, n, chi FROM edge")
def lag_graph_weekly(spark, d):
    return weekly_edges(spark, d)


@query(f"WITH {E1} SELECT i, j, hits, n, CASE WHEN chi < 0.05::DOUBLE THEN 0.0::DOUBLE ELSE chi END AS chi FROM edge")
def lag_graph_pruned(spark, d):
    return graph.lag_graph(ecdf(hourly(spark, d)), cells_of(spark, 20), 1, 0, H_END, P, prune_below=0.05)


@query(f"WITH {E1} SELECT i, j, hits, n, chi FROM edge WHERE hits > 0 AND i IN (SELECT cell FROM hourly GROUP BY cell HAVING sum(value) > 0)")
def lag_graph_land_sparse(spark, d):
    cube = hourly(spark, d)
    land = cube.groupBy("cell").agg(F.sum("value").alias("s")).where("s > 0")
    return graph.lag_graph(ecdf(cube), cells_of(spark, 20), 1, 0, H_END, P, rows=land, full=False, salt=4)


MADOGRAM = U2 + f""", m AS (SELECT a.cell AS i, b.cell AS j, avg(abs(a.u - b.u)) AS m FROM u2 a JOIN u2 b ON a.t - 1 = b.t WHERE a.t >= 1 AND a.t < {W_END} GROUP BY 1, 2),
th AS (SELECT i, j, (1 + 2*(0.5::DOUBLE*m))/nullif(1 - 2*(0.5::DOUBLE*m), 0) AS theta FROM m)"""


@query(f"WITH {MADOGRAM} SELECT i, j, round(theta, 9) AS theta, round(2 - least(theta, 2.0::DOUBLE), 9) AS chi FROM th")
def madogram_graph(spark, d):
    return graph.madogram_graph(ecdf(weekly(spark, d)), 1, 0, W_END).select("i", "j", r("theta").alias("theta"), r("chi").alias("chi"))


@query(f"""WITH {F5}, b AS (SELECT y_true AS x, y_pred AS y FROM orderpair WHERE y_pred IS NOT NULL AND y_true IS NOT NULL),
k AS (SELECT (rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1)/2.0::DOUBLE)/(count(*) OVER () + 1) AS fx,
  (rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1)/2.0::DOUBLE)/(count(*) OVER () + 1) AS fy FROM b),
m AS (SELECT 0.5::DOUBLE*avg(abs(fx - fy)) AS nu FROM k) SELECT round((1 + 2*nu)/(1 - 2*nu), 9) AS theta FROM m""")
def madogram_theta(spark, d):
    return tail.madogram(cubes.order_pair(spark, d), "y_true", "y_pred").select(r("theta").alias("theta"))


@query(f"""WITH {F5}, b AS (SELECT * FROM orderpair WHERE y_pred IS NOT NULL), q AS (SELECT quantile_cont(y_true, 0.95) AS a, quantile_cont(y_pred, 0.95) AS b FROM b)
SELECT CAST(count(*) FILTER (WHERE y_true >= q.a AND y_pred >= q.b) AS BIGINT) AS hits, count(*) AS n,
  count(*) FILTER (WHERE y_true >= q.a AND y_pred >= q.b)/count(*)::DOUBLE/(1 - 0.95::DOUBLE) AS chi FROM b CROSS JOIN q""")
def chi_raw_threshold(spark, d):
    return tail.chi_of_raw(cubes.order_pair(spark, d), ["y_true", "y_pred"], P)


@query(f"""WITH {F5}, b AS (SELECT * FROM orderpair WHERE y_pred IS NOT NULL), c AS (SELECT * FROM b WHERE y_true >= 1000 AND y_pred >= 1000),
q AS (SELECT quantile_cont(y_true, 0.95) AS a, quantile_cont(y_pred, 0.95) AS b FROM c), h AS (SELECT count(*) AS hits FROM c CROSS JOIN q WHERE y_true >= q.a AND y_pred >= q.b)
SELECT hits, n, hits/n::DOUBLE/(1 - 0.95::DOUBLE) AS chi FROM h CROSS JOIN (SELECT count(*) AS n FROM b)""")
def chi_min_value(spark, d):
    return tail.chi_of_raw(cubes.order_pair(spark, d), ["y_true", "y_pred"], P, least=1000)


@query(f"""WITH {U1}, w AS (SELECT t, cell // 4 AS i, max(u) FILTER (WHERE cell % 4 = 0) AS a, max(u) FILTER (WHERE cell % 4 = 1) AS b, max(u) FILTER (WHERE cell % 4 = 2) AS c, max(u) FILTER (WHERE cell % 4 = 3) AS d FROM u1 GROUP BY 1, 2)
SELECT i, count(*) FILTER (WHERE a >= 0.9::DOUBLE AND b >= 0.9::DOUBLE)/count(*)::DOUBLE/(1 - 0.9::DOUBLE) AS chi2,
  count(*) FILTER (WHERE a >= 0.9::DOUBLE AND b >= 0.9::DOUBLE AND c >= 0.9::DOUBLE AND d >= 0.9::DOUBLE)/count(*)::DOUBLE/(1 - 0.9::DOUBLE) AS chi4 FROM w GROUP BY i""")
def joint_chi_columns(spark, d):
    """Each row of the grid: two of its cells, and all four, exceed together."""
    ranks = ecdf(hourly(spark, d)).select("t", F.expr("cell div 4").alias("i"), (F.col("cell") % 4).alias("j"), "u")
    wide = ranks.groupBy("t", "i").pivot("j", [0, 1, 2, 3]).agg(F.first("u"))
    return wide.groupBy("i").agg(tail.joint_chi(["0", "1"], 0.9).alias("chi2"), tail.joint_chi(["0", "1", "2", "3"], 0.9).alias("chi4"))


# ---------------------------------------------------------------- strongest links
TOP = "SELECT i, j, chi FROM (SELECT *, quantile_cont(chi, {q}) OVER (PARTITION BY i) AS l FROM edge) WHERE chi {op} l"


@query(f"WITH {E2} " + TOP.format(q=0.99, op=">"))
def top_neighbors_v1(spark, d):
    return paths.top_neighbors(weekly_edges(spark, d), 0.99, strict=True)


@query(f"WITH {E2} " + TOP.format(q=0.9, op=">="))
def top_neighbors_v2(spark, d):
    return paths.top_neighbors(weekly_edges(spark, d), 0.9)


FLOW = E2 + ", top AS (" + TOP.format(q=0.9, op=">=") + """), f AS (SELECT i, nullif(sum(chi), 0) AS w, sum((j // 5)*chi) AS wr, sum((j % 5)*chi) AS wc, avg(chi) AS m, max(chi) AS x FROM top GROUP BY i)"""


@query(f"WITH {FLOW} SELECT i, round(wr/w, 9) AS i_c, round(wc/w, 9) AS j_c, round((i % 5 - wc/w)*m, 9) AS u, round((wr/w - i // 5)*m, 9) AS v, CASE WHEN w IS NOT NULL THEN round(x, 9) END AS max_chi FROM f")
def flow_vectors(spark, d):
    found = paths.flow_vectors(paths.top_neighbors(weekly_edges(spark, d), 0.9), 5)
    return found.select("i", *[r(c).alias(c) for c in ("i_c", "j_c", "u", "v", "max_chi")])


@query(f"WITH {FLOW} SELECT i, i // 5 AS lat_row, i % 5 AS lon_column, CASE WHEN w IS NOT NULL THEN x END AS max_chi FROM f")
def max_chi_image(spark, d):
    found = paths.flow_vectors(paths.top_neighbors(weekly_edges(spark, d), 0.9), 5)
    return found.select("i", F.expr("i div 5").alias("lat_row"), (F.col("i") % 5).alias("lon_column"), "max_chi")


@query(f"WITH {E2}, top AS ({TOP.format(q=0.9, op='>=')}) SELECT i, array_to_string(list(CAST(j AS VARCHAR) ORDER BY j), ',') AS neighbors FROM top GROUP BY i")
def neighbor_map(spark, d):
    found = paths.neighbor_map(paths.top_neighbors(weekly_edges(spark, d), 0.9))
    return found.select("i", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("""WITH s AS (SELECT n_name AS name, 10.0::DOUBLE - (n_nationkey % 7)*0.7::DOUBLE AS lat, 100.0::DOUBLE + (n_nationkey % 6)*0.9::DOUBLE AS lon FROM nation),
a AS (SELECT name, range AS i, row_number() OVER (PARTITION BY name ORDER BY pow(lat - (10.0::DOUBLE - range), 2), range) AS k FROM s CROSS JOIN range(5)),
b AS (SELECT name, range AS j, row_number() OVER (PARTITION BY name ORDER BY pow(lon - (100.0::DOUBLE + range), 2), range) AS k FROM s CROSS JOIN range(5))
SELECT a.name, i, j, i*5 + j AS cell FROM a JOIN b ON a.name = b.name AND a.k = 1 AND b.k = 1""")
def nearest_cell(spark, d):
    nation = spark.read.parquet(f"{d}/nation.parquet")
    stations = nation.select(F.col("n_name").alias("name"), (10.0 - (F.col("n_nationkey") % 7) * 0.7).alias("lat"), (100.0 + (F.col("n_nationkey") % 6) * 0.9).alias("lon"))
    g = cubes.grid(spark, 5, 5)
    return selection.on_land(selection.nearest_cell(stations, g), g).select("name", "i", "j", "cell")


@query(f"WITH {F2} SELECT cell, cell // 5 AS i, cell % 5 AS j FROM weekly GROUP BY cell HAVING sum(value) > 0")
def land_filter(spark, d):
    land = weekly(spark, d).groupBy("cell").agg(F.sum("value").alias("s")).where("s > 0")
    return cubes.grid(spark, 5, 5).join(land, "cell", "left_semi").select("cell", "i", "j")


@query("SELECT r.r_name AS place, n.n_nationkey % 5 AS i, n.n_nationkey // 5 AS j, n.n_name AS name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_regionkey < 3")
def gazetteer_lookup(spark, d):
    nation, region = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    gazetteer = region.where("r_regionkey < 3").select("r_regionkey", F.col("r_name").alias("place"))
    found = cubes.gazetteer_lookup(nation.withColumnRenamed("n_regionkey", "r_regionkey"), gazetteer, "r_regionkey")
    return found.select("place", (F.col("n_nationkey") % 5).alias("i"), F.expr("cast(n_nationkey div 5 as int)").alias("j"), F.col("n_name").alias("name"))


# ---------------------------------------------------------------- pooling and frames
POOL = "SELECT t, oi, oj, {f} AS value FROM image JOIN range({n}) a(oi) ON cell // 8 BETWEEN oi*{s} AND oi*{s} + {p} - 1 JOIN range({n}) b(oj) ON cell % 8 BETWEEN oj*{s} AND oj*{s} + {p} - 1 GROUP BY t, oi, oj"


@query(f"WITH {F3} " + POOL.format(f="max(value)", n=4, s=2, p=2))
def pool2d_max(spark, d):
    return pooling.pool_2d(cubes.image_cube(spark, d), 8, 8, 2, 2)


@query(f"WITH {F3} " + POOL.format(f="round(avg(value), 9)", n=3, s=2, p=3))
def pool2d_avg(spark, d):
    return pooling.pool_2d(cubes.image_cube(spark, d), 8, 8, 3, 2, lambda c: r(F.avg(c)))


@query(f"WITH {F3} " + POOL.format(f="round(avg(value), 6)", n=2, s=2, p=6))
def pool2d_means(spark, d):
    """Large windows by integral images."""
    return pooling.pool_means(cubes.image_cube(spark, d), 8, 8, 6, 2).select("t", "oi", "oj", r("value", 6).alias("value"))


@query(f"WITH {F1} SELECT cell, o, max(value) AS value FROM hourly JOIN range(118) x(o) ON t BETWEEN o*6 AND o*6 + 17 GROUP BY cell, o")
def pool1d(spark, d):
    return pooling.pool_1d(hourly(spark, d), 720, 18, 6)


@query(f"WITH {F1} SELECT t, oi, oj, max(value) AS value FROM hourly JOIN range(4) a(oi) ON cell // 4 BETWEEN oi AND oi + 1 JOIN range(3) b(oj) ON cell % 4 BETWEEN oj AND oj + 1 GROUP BY t, oi, oj")
def pool_cube(spark, d):
    return pooling.pool_2d(hourly(spark, d), 5, 4, 2, 1)


@query(f"WITH {F3}, l AS (SELECT min(value) AS a, max(value) AS b FROM image) SELECT t, cell, CAST(floor((value - a)/(b - a)*255) AS INTEGER) AS pixel FROM image CROSS JOIN l")
def video_frames_u8(spark, d):
    return scalars.frames(cubes.image_cube(spark, d))


@query(f"WITH {F3} SELECT round(quantile_cont(value, 0.02), 9) AS vmin, round(quantile_cont(value, 0.98), 9) AS vmax FROM image")
def robust_range(spark, d):
    return scalars.value_range(cubes.image_cube(spark, d), robust=True).select(r("vmin").alias("vmin"), r("vmax").alias("vmax"))


# ---------------------------------------------------------------- sampling, splits, sets
@query(f"WITH {F1} SELECT t, cell, value, CASE WHEN t < 576 THEN 'train' ELSE 'validation' END AS part FROM hourly")
def train_val_split(spark, d):
    return selection.positional_split(hourly(spark, d), 0.8, "t")


@query(f"WITH {F1} SELECT t, cell, CAST(floor((row_number() OVER (PARTITION BY cell ORDER BY t) - 1)/32.0) AS BIGINT) AS batch FROM hourly")
def batches(spark, d):
    return selection.batched(hourly(spark, d), 32, "t", ["cell"]).select("t", "cell", "batch")


@query(f"WITH {F2}, h AS (SELECT cell, row_number() OVER (ORDER BY (cell*7919) % 104729, cell) AS k FROM (SELECT DISTINCT cell FROM weekly)) SELECT cell FROM h WHERE k <= 10")
def hash_sample(spark, d):
    cells = weekly(spark, d).select("cell").distinct()
    return selection.hash_prefix(cells, 0.4, order=(F.col("cell") * 7919) % 104729)


@query(f"""WITH {F2}, a AS (SELECT cell % 5 AS name, 'first' AS store, CAST(sum(value) AS BIGINT) AS total FROM weekly WHERE t < 100 GROUP BY 1),
b AS (SELECT cell % 3 AS name, 'second' AS store, CAST(sum(value) AS BIGINT) AS total FROM weekly WHERE t >= 100 GROUP BY 1)
SELECT * FROM b UNION ALL SELECT * FROM a WHERE name NOT IN (SELECT name FROM b)""")
def run_store_merge(spark, d):
    cube = weekly(spark, d)
    one = cube.where("t < 100").groupBy((F.col("cell") % 5).alias("name")).agg(F.sum("value").alias("total")).select("name", F.lit("first").alias("store"), "total")
    two = cube.where("t >= 100").groupBy((F.col("cell") % 3).alias("name")).agg(F.sum("value").alias("total")).select("name", F.lit("second").alias("store"), "total")
    return cubes.merge_run_stores(one, two)


# ---------------------------------------------------------------- chains
def d3_sql(lag1: int, lag2: int, station: str, tag: str = "", edge: str = "edge", start: int = 0, end: int = W_END) -> str:
    total, n = lag1 + lag2, end - start - lag1 - lag2
    return f"""n1{tag} AS (SELECT i AS origin, j AS cell FROM (SELECT *, quantile_cont(chi, 0.5) OVER (PARTITION BY i) AS l FROM {edge} WHERE {station}) WHERE chi > l),
h3{tag} AS (SELECT n.origin, n.cell AS b, z.cell AS c, count(*) AS hits FROM n1{tag} n
  JOIN u2 x ON x.cell = n.origin AND x.u >= 0.95::DOUBLE AND x.t >= {start} AND x.t < {end - total}
  JOIN u2 y ON y.cell = n.cell AND y.u >= 0.95::DOUBLE AND y.t = x.t + {lag1}
  JOIN u2 z ON z.u >= 0.95::DOUBLE AND z.t = x.t + {total} GROUP BY 1, 2, 3),
combo{tag} AS MATERIALIZED (SELECT n.origin, n.cell AS b, q.range AS c, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits, coalesce(h.hits, 0)/{n}.0::DOUBLE/(1 - 0.95::DOUBLE) AS chi
  FROM n1{tag} n CROSS JOIN range(25) q LEFT JOIN h3{tag} h ON h.origin = n.origin AND h.b = n.cell AND h.c = q.range),
best{tag} AS MATERIALIZED (SELECT origin, b, c, hits, chi FROM (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY hits DESC, b, c) AS k FROM combo{tag}) WHERE k = 1),
image{tag} AS (SELECT origin, c AS cell, count(*) AS count, CAST(sum(hits) AS BIGINT) AS s, CAST(sum(hits*hits) AS BIGINT) AS q FROM combo{tag} GROUP BY 1, 2),
peak{tag} AS (SELECT origin, cell FROM (SELECT origin, cell, row_number() OVER (PARTITION BY origin ORDER BY s/count::DOUBLE DESC, cell) AS k FROM image{tag}) WHERE k = 1)"""


STATION = 7


def _station(spark: SparkSession, d: str, lags: list[int], stations: DataFrame | None = None) -> explore.Exploration:
    ranks = ecdf(weekly(spark, d))
    edges = graph.lag_graph(ranks, cells_of(spark, 25), lags[0], 0, W_END, P)
    own = stations if stations is not None else spark.range(STATION, STATION + 1).select(F.col("id").alias("cell"))
    return explore.explore_stations(stored(ranks, "ecdf"), edges, own, 3, lags, 0, W_END, P, PERCENT, keep=True)


def _three(df: DataFrame) -> DataFrame:
    return df.select("origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"), "hits", "chi")


D3 = E2 + ", " + d3_sql(1, 2, f"i = {STATION}")
ALL3 = E2 + ", " + d3_sql(1, 2, "true")


@query(f"WITH {D3} SELECT origin, b, c, hits, chi FROM combo")
def station_d3_combos(spark, d):
    return _three(_station(spark, d, [1, 2]).steps[3].combos)


@query(f"WITH {D3} SELECT origin, cell, count, s/count::DOUBLE/{W_END - 3}.0::DOUBLE/(1 - 0.95::DOUBLE) AS chi_mean, round((count*q - s*s)/(count*count)::DOUBLE/pow({W_END - 3}*(1 - 0.95::DOUBLE), 2), 9) AS chi_var FROM image")
def station_d3_moments(spark, d):
    return _station(spark, d, [1, 2]).steps[3].image.select("origin", "cell", "count", "chi_mean", r("chi_var").alias("chi_var"))


@query(f"WITH {D3} SELECT origin, b, c, hits, chi FROM best")
def station_d3_best(spark, d):
    return _three(_station(spark, d, [1, 2]).steps[3].best)


@query(f"WITH {D3} SELECT origin, CAST(origin AS VARCHAR) || ',' || cell AS nodes FROM peak")
def station_path(spark, d):
    return explore.chain_nodes(_station(spark, d, [1, 2])).select("origin", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"))


@query(f"""WITH {D3}, g AS (SELECT origin, 'LINESTRING(' || (100 + origin % 5) || '.0 ' || (10 - origin // 5) || '.0, ' || (100 + cell % 5) || '.0 ' || (10 - cell // 5) || '.0)' AS wkt FROM peak) SELECT * FROM g""")
def station_d3_wkt(spark, d):
    return explore.wkt_lines(explore.chain_nodes(_station(spark, d, [1, 2])), cubes.grid(spark, 5, 5))


@query(f"WITH {ALL3}, s AS (SELECT range AS origin FROM range(25)) SELECT s.origin, coalesce(b, s.origin) AS b, coalesce(c, s.origin) AS c FROM s LEFT JOIN best ON best.origin = s.origin")
def all_chains(spark, d):
    every = cells_of(spark, 25)
    best = explore.best_or_self(every, _station(spark, d, [1, 2], every).steps[3].best, 3)
    return best.select("origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))


@query(f"WITH {D3} SELECT origin, b, c, hits FROM combo")
def station_d3_bitset(spark, d):
    """The same counts from packed exceedance times."""
    ranks = stored(ecdf(weekly(spark, d)), "ecdf")
    edges = graph.lag_graph(ranks, cells_of(spark, 25), 1, 0, W_END, P).where(F.col("i") == STATION)
    first = paths.image_selection(edges.select(F.col("i").alias("origin"), F.col("j").alias("cell"), "chi"), PERCENT, "chi", ["origin"])
    tuples = first.crossJoin(cells_of(spark, 25).withColumnRenamed("cell", "c")).select(F.array("origin", "cell", "c").alias("path"))
    hits = graph.bitset_hits(ranks, tuples, [0, 1, 3], 0, W_END - 3, P)
    return hits.select(F.col("path")[0].alias("origin"), F.col("path")[1].alias("b"), F.col("path")[2].alias("c"), "hits")


N4 = W_END - 3
D4 = E2 + f""", n1 AS (SELECT i AS origin, j AS cell FROM (SELECT *, quantile_cont(chi, 0.8) OVER (PARTITION BY i) AS l FROM edge) WHERE chi > l),
h3 AS (SELECT n.origin, n.cell AS b, z.cell AS c, count(*) AS hits FROM n1 n JOIN u2 x ON x.cell = n.origin AND x.u >= 0.95::DOUBLE AND x.t >= 0 AND x.t < {W_END - 2}
  JOIN u2 y ON y.cell = n.cell AND y.u >= 0.95::DOUBLE AND y.t = x.t + 1 JOIN u2 z ON z.u >= 0.95::DOUBLE AND z.t = x.t + 2 GROUP BY 1, 2, 3),
i3 AS (SELECT n.origin, q.range AS cell, count(*) AS count, CAST(coalesce(sum(h.hits), 0) AS BIGINT) AS s FROM n1 n CROSS JOIN range(25) q LEFT JOIN h3 h ON h.origin = n.origin AND h.b = n.cell AND h.c = q.range GROUP BY 1, 2),
m3 AS (SELECT origin, cell, s/count::DOUBLE/{W_END - 2}.0::DOUBLE/(1 - 0.95::DOUBLE) AS m FROM i3),
n2 AS (SELECT origin, cell FROM (SELECT *, quantile_cont(m, 0.8) OVER (PARTITION BY origin) AS l FROM m3) WHERE m > l),
h4 AS (SELECT n.origin, n.cell AS b, o.cell AS c, z.cell AS e, count(*) AS hits FROM n1 n JOIN n2 o ON o.origin = n.origin JOIN u2 x ON x.cell = n.origin AND x.u >= 0.95::DOUBLE AND x.t >= 0 AND x.t < {N4}
  JOIN u2 y ON y.cell = n.cell AND y.u >= 0.95::DOUBLE AND y.t = x.t + 1 JOIN u2 w ON w.cell = o.cell AND w.u >= 0.95::DOUBLE AND w.t = x.t + 2 JOIN u2 z ON z.u >= 0.95::DOUBLE AND z.t = x.t + 3 GROUP BY 1, 2, 3, 4),
c4 AS (SELECT n.origin, n.cell AS b, o.cell AS c, q.range AS e, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits FROM n1 n JOIN n2 o ON o.origin = n.origin CROSS JOIN range(25) q
  LEFT JOIN h4 h ON h.origin = n.origin AND h.b = n.cell AND h.c = o.cell AND h.e = q.range),
b4 AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY hits DESC, b, c, e) AS k FROM c4)"""


@query(f"WITH {D4} SELECT origin, origin || ',' || b || ',' || c || ',' || e AS path, hits, hits/{N4}.0::DOUBLE/(1 - 0.95::DOUBLE) AS chi FROM b4 WHERE k = 1")
def station_d4(spark, d):
    """Four nodes deep, from every cell."""
    ranks = stored(ecdf(weekly(spark, d)), "ecdf")
    edges = graph.lag_graph(ranks, cells_of(spark, 25), 1, 0, W_END, P)
    found = explore.explore_stations(ranks, edges, cells_of(spark, 25), 4, [1, 1, 1], 0, W_END, P, 80.0)
    return found.steps[4].best.select("origin", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "hits", "chi")


@query(_sql["all_chains"])
def all_chains_by_bound(spark, d):
    """The same chains without evaluating every tuple: a prefix's joint steps bound what begins with it."""
    every, ranks = cells_of(spark, 25), stored(ecdf(weekly(spark, d)), "ecdf")
    best = explore.best_chains(ranks, graph.lag_graph(ranks, every, 1, 0, W_END, P), every, 3, [1, 2], 0, W_END, P, PERCENT)
    return explore.best_or_self(every, best, 3).select("origin", F.col("path")[1].alias("b"), F.col("path")[2].alias("c"))


@query(_sql["station_d4"])
def station_d4_by_bound(spark, d):
    """Four nodes deep, from every cell, by bounds."""
    every, ranks = cells_of(spark, 25), stored(ecdf(weekly(spark, d)), "ecdf")
    best = explore.best_chains(ranks, graph.lag_graph(ranks, every, 1, 0, W_END, P), every, 4, [1, 1, 1], 0, W_END, P, 80.0)
    return best.select("origin", F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "hits", "chi")


def _regions(spark: SparkSession, d: str) -> explore.Exploration:
    ranks = stored(ecdf(weekly(spark, d)), "ecdf")
    edges = graph.lag_graph(ranks, cells_of(spark, 25), 1, 0, W_END, P)
    members = cells_of(spark, 25).select(F.expr("cell div 5").alias("origin"), "cell")
    centroids = edges.groupBy(F.expr("i div 5").alias("origin"), F.col("j").alias("cell")).agg((F.sum("hits") / F.count(F.lit(1))).alias("weight"))
    return explore.explore_regions(ranks, members, centroids, 3, [1, 1], 0, W_END, [0.6, 0.6], P, PERCENT, 0.01, 0.2, 10, order=(F.col("cell") * 7919) % 104729)


#: Rounds at 0.6, 0.8 and 1 (two tenths are added in floating point, as the engine does); a fourth has no tuple that is new.
RATES = [0.6, 0.6 + 0.2, 0.6 + 0.2 + 0.2]
REGIONS = E2 + f""", ce AS (SELECT i // 5 AS origin, j AS cell, CAST(sum(hits) AS DOUBLE)/count(*) AS w FROM edge GROUP BY 1, 2),
l1 AS (SELECT range // 5 AS origin, range AS cell FROM range(25)), l2 AS (SELECT origin, cell FROM (SELECT *, quantile_cont(w, 0.5) OVER (PARTITION BY origin) AS l FROM ce) WHERE w > l),
k1 AS (SELECT *, count(*) OVER (PARTITION BY origin) AS n, row_number() OVER (PARTITION BY origin ORDER BY (cell*7919) % 104729, cell) AS k FROM l1),
k2 AS (SELECT *, count(*) OVER (PARTITION BY origin) AS n, row_number() OVER (PARTITION BY origin ORDER BY (cell*7919) % 104729, cell) AS k FROM l2),
ro AS (SELECT * FROM (VALUES {", ".join(f"({k}, {min(x, 1.0)!r}::DOUBLE)" for k, x in enumerate(RATES))}) v(round, rate)),
pf AS MATERIALIZED (SELECT ro.round, a.origin, a.cell AS a, b.cell AS b FROM ro JOIN k1 a ON a.k <= floor(a.n*rate) JOIN k2 b ON b.origin = a.origin AND b.k <= floor(b.n*rate)),
hh AS MATERIALIZED (SELECT pf.origin, pf.a, pf.b, z.cell AS c, count(*) AS hits FROM (SELECT DISTINCT origin, a, b FROM pf) pf JOIN u2 x ON x.cell = pf.a AND x.u >= 0.95::DOUBLE AND x.t >= 0 AND x.t < {W_END - 2}
  JOIN u2 y ON y.cell = pf.b AND y.u >= 0.95::DOUBLE AND y.t = x.t + 1 JOIN u2 z ON z.u >= 0.95::DOUBLE AND z.t = x.t + 2 GROUP BY 1, 2, 3, 4),
im AS MATERIALIZED (SELECT round, pf.origin, q.range AS cell, count(*) AS count, CAST(coalesce(sum(hits), 0) AS BIGINT) AS s, CAST(coalesce(sum(hits*hits), 0) AS BIGINT) AS q
  FROM pf CROSS JOIN range(25) q LEFT JOIN hh ON hh.origin = pf.origin AND hh.a = pf.a AND hh.b = pf.b AND hh.c = q.range GROUP BY 1, 2, 3),
mi AS MATERIALIZED (SELECT *, s/count::DOUBLE/{W_END - 2}.0::DOUBLE/(1 - 0.95::DOUBLE) AS m FROM im),
er AS (SELECT x.round, x.origin, avg(abs(x.m - y.m)) AS e FROM mi x JOIN mi y ON y.round = x.round - 1 AND y.origin = x.origin AND y.cell = x.cell GROUP BY 1, 2),
fin AS (SELECT origin, coalesce(min(round) FILTER (WHERE e <= 0.01::DOUBLE), {len(RATES) - 1}) AS round FROM er GROUP BY origin)"""


@query(f"WITH {REGIONS} SELECT mi.origin, cell, count, m AS chi_mean, round((count*q - s*s)/(count*count)::DOUBLE/pow({W_END - 2}*(1 - 0.95::DOUBLE), 2), 9) AS chi_var FROM mi JOIN fin ON fin.round = mi.round AND fin.origin = mi.origin")
def hyperdim_converge(spark, d):
    """Regions by the cell's row of the grid, each searched with growing samples until its own mean image settles."""
    return _regions(spark, d).steps[3].image.select("origin", "cell", "count", "chi_mean", r("chi_var").alias("chi_var"))


@query(f"WITH {REGIONS} SELECT fin.origin, 3 AS d, ro.round AS iteration, round(ro.rate, 9) AS rate, round(e, 9) AS error FROM ro JOIN fin ON ro.round <= fin.round LEFT JOIN er ON er.round = ro.round AND er.origin = fin.origin")
def hyperdim_history(spark, d):
    """How far each region's mean image moved in each round that it took part in, and at which rate."""
    return _regions(spark, d).history_table(spark).select("origin", "d", "iteration", r(F.col("rates")[0]).alias("rate"), r("error").alias("error"))


# ---------------------------------------------------------------- training tables
def _best_chains(spark: SparkSession, d: str, lists: dict[str, list[int]] = LAGS) -> dict[str, DataFrame]:
    every, ranks = cells_of(spark, 25), stored(ecdf(weekly(spark, d)), "ecdf")
    edges = {lag: stored(graph.lag_graph(ranks, every, lag, 0, W_END, P), "edges") for lag in {x[0] for x in lists.values()}}
    prepared = explore.prepare(ranks, P)
    return {k: explore.explore_stations(ranks, edges[x[0]], every, 3, x, 0, W_END, P, PERCENT, prepared=prepared).steps[3].best for k, x in lists.items()}


def _chains(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {k: explore.best_or_self(cells_of(spark, 25), b, 3) for k, b in _best_chains(spark, d).items()}


E22 = U2 + ", " + graph_sql("u2", 1, W_END, 25, "edge1") + ", " + graph_sql("u2", 2, W_END, 25, "edge2")
PUZZLE = E22 + ", " + ", ".join(
    d3_sql(*x, "true", f"_{k}", f"edge{x[0]}") + f""",
p_{k} AS MATERIALIZED (SELECT s.range AS origin, coalesce(b, s.range) AS b, coalesce(c, s.range) AS c FROM range(25) s LEFT JOIN best_{k} z ON z.origin = s.range),
f_{k} AS MATERIALIZED (SELECT y.t, p.origin AS cell, y.value AS y, m1.value AS x1, m2.value AS x2 FROM p_{k} p JOIN weekly y ON y.cell = p.origin
  JOIN weekly m1 ON m1.cell = p.b AND m1.t = y.t - {x[0]} JOIN weekly m2 ON m2.cell = p.c AND m2.t = y.t - {sum(x)} WHERE y.t >= {sum(x)} AND y.t < {W_END})"""
    for k, x in LAGS.items()
)


@query(f"WITH {PUZZLE} " + " UNION ALL ".join(f"SELECT '{k}' AS key, t, cell, y, x1, x2 FROM f_{k}" for k in LAGS))
def puzzle_features(spark, d):
    blocks = puzzle.joint_blocks(_chains(spark, d), weekly(spark, d), LAGS, 0, W_END)
    return blocks.groupBy("key", "t", "cell").agg(*[F.max(F.when(F.col("m") == m, F.col("x"))).alias(n) for m, n in enumerate(("y", "x1", "x2"))])


@query(f"WITH {PUZZLE} SELECT t FROM f_1_1 INTERSECT SELECT t FROM f_1_2 INTERSECT SELECT t FROM f_2_1")
def puzzle_common_dates(spark, d):
    return puzzle.common_dates(puzzle.joint_blocks(_chains(spark, d), weekly(spark, d), LAGS, 0, W_END), 3)


@query(f"WITH {PUZZLE} SELECT a.t, a.cell, a.y, a.x1 AS x0, a.x2 AS x1, b.x1 AS x2, b.x2 AS x3, c.x1 AS x4, c.x2 AS x5 FROM f_1_1 a JOIN f_1_2 b ON a.t = b.t AND a.cell = b.cell JOIN f_2_1 c ON a.t = c.t AND a.cell = c.cell")
def puzzle_xy(spark, d):
    blocks = puzzle.joint_blocks(_chains(spark, d), weekly(spark, d), LAGS, 0, W_END)
    return puzzle.puzzle(blocks, LAGS).select("t", "cell", "y", *[F.col("x")[k].alias(f"x{k}") for k in range(6)])


@query(f"""WITH {PUZZLE}, m AS (SELECT a.t, a.cell, a.y, a.x1 AS x0, a.x2 AS x1, b.x1 AS x2, b.x2 AS x3 FROM f_1_1 a JOIN f_1_2 b ON a.t = b.t AND a.cell = b.cell
  WHERE a.cell IN (SELECT origin FROM best_1_1 WHERE hits >= 2) AND a.cell IN (SELECT origin FROM best_1_2 WHERE hits >= 2))
SELECT strftime(DATE '1995-01-01' + CAST(7*d.t AS INTEGER), '%Y-%m-%d') AS date, c.range AS cell, coalesce(y, 0) AS y, coalesce(x0, 0) AS x0, coalesce(x1, 0) AS x1, coalesce(x2, 0) AS x2, coalesce(x3, 0) AS x3
FROM (SELECT DISTINCT t FROM m) d CROSS JOIN range(25) c LEFT JOIN m ON m.t = d.t AND m.cell = c.range""")
def puzzle_dated_dense(spark, d):
    """Two lag lists, chains that meet in two steps at least: cells without one in both are zeros; steps carry their dates."""
    lists = {k: LAGS[k] for k in ("1_1", "1_2")}
    own = {k: v.where("hits >= 2") for k, v in _best_chains(spark, d, lists).items()}
    cube = weekly(spark, d).withColumn("value", F.col("value").cast("double"))
    table = puzzle.puzzle(puzzle.joint_blocks(own, cube, lists, 0, W_END), lists, cells_of(spark, 25))
    dates = spark.range(cubes.WEEKLY_STEPS).select(F.col("id").alias("t"), F.expr("cast(date_add(date'1995-01-01', cast(7 * id as int)) as string)").alias("date"))
    dated = pipelines.with_dates(table, dates)
    return dated.select("date", "cell", F.col("y").cast("bigint").alias("y"), *[F.col("x")[k].cast("bigint").alias(f"x{k}") for k in range(4)])


@query(f"""WITH {ALL3}, p AS (SELECT s.range AS origin, coalesce(b, s.range) AS b FROM range(25) s LEFT JOIN best ON best.origin = s.range),
f AS (SELECT y.cell, y.t // 4 AS period, y.value AS a, x.value AS b FROM p JOIN weekly y ON y.cell = p.origin JOIN weekly x ON x.cell = p.b AND x.t = y.t - 1 WHERE y.t BETWEEN 52 AND 155)
SELECT cell, CAST(period AS BIGINT) AS period, avg(a) AS y_true, avg(b) AS y_pred FROM f GROUP BY cell, period""")
def predict_resampled(spark, d):
    every = cells_of(spark, 25)
    best = explore.best_or_self(every, _station(spark, d, [1, 2], every).steps[3].best, 3)
    return pipelines.predict(best, weekly(spark, d), 1, 52, 155, 4)


@query(f"""WITH {ALL3}, p AS (SELECT s.range AS origin, coalesce(b, s.range) AS b FROM range(25) s LEFT JOIN best ON best.origin = s.range)
SELECT y.cell, y.t, y.value AS y_true, x.value AS y_pred FROM p JOIN weekly y ON y.cell = p.origin JOIN weekly x ON x.cell = p.b AND x.t = y.t - 1""")
def persistence_forecast(spark, d):
    every = cells_of(spark, 25)
    best = explore.best_or_self(every, _station(spark, d, [1, 2], every).steps[3].best, 3)
    return puzzle.persistence(best, weekly(spark, d), 1)


@query()
def linear_baseline(spark, d):
    """Verification of a linear model on the training table, by part."""
    blocks = puzzle.joint_blocks(_chains(spark, d), weekly(spark, d), LAGS, 0, W_END)
    table = puzzle.puzzle(blocks, LAGS).withColumn("x", F.transform("x", lambda v: v.cast("double"))).withColumn("y", F.col("y").cast("double"))
    return metrics.metric_map(pipelines.linear_baseline(table), {"rmse": metrics.rmse, "nse": metrics.nse}, ["part"]).select("part", r("rmse", 6).alias("rmse"), r("nse", 6).alias("nse"))


# ---------------------------------------------------------------- clustering
SCORES = f"""WITH {F3}, c AS (SELECT label, cell, avg(value) AS m FROM image GROUP BY 1, 2), w AS (SELECT cell, avg(value) AS m FROM image GROUP BY 1),
pt AS (SELECT i.t, i.label, sum(pow(i.value - c.m, 2)) AS d2 FROM image i JOIN c ON c.label = i.label AND c.cell = i.cell GROUP BY 1, 2),
sz AS (SELECT label, count(*) AS n, avg(sqrt(d2)) AS s FROM pt GROUP BY 1),
bt AS (SELECT c.label, sum(pow(c.m - w.m, 2)) AS b2 FROM c JOIN w ON w.cell = c.cell GROUP BY 1),
dd AS (SELECT a.label AS a, b.label AS b, sqrt(sum(pow(a.m - b.m, 2))) AS d FROM c a JOIN c b ON a.cell = b.cell AND a.label <> b.label GROUP BY 1, 2),
db AS (SELECT avg(m) AS davies FROM (SELECT a, max((x.s + y.s)/d) AS m FROM dd JOIN sz x ON x.label = a JOIN sz y ON y.label = b GROUP BY a)),
pr AS (SELECT a.t AS p, a.label AS lp, b.t AS q, b.label AS lq, sqrt(sum(pow(a.value - b.value, 2))) AS d FROM image a JOIN image b ON a.cell = b.cell AND a.t <> b.t GROUP BY 1, 2, 3, 4),
mn AS (SELECT p, lp, lq, avg(d) AS m FROM pr GROUP BY 1, 2, 3),
ab AS (SELECT p, max(m) FILTER (WHERE lq = lp) AS a, min(m) FILTER (WHERE lq <> lp) AS b FROM mn GROUP BY p),
si AS (SELECT avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a)/nullif(greatest(a, b), 0) END) AS silhouette FROM ab)
SELECT round((SELECT sum(d2) FROM pt), 6) AS inertia, round((SELECT sum(sqrt(d2)) FROM pt), 6) AS sdw, round((SELECT sum(n*sqrt(b2)) FROM bt JOIN sz ON bt.label = sz.label), 6) AS sdb,
 round(((SELECT sum(n*b2) FROM bt JOIN sz ON bt.label = sz.label)/((SELECT count(*) FROM sz) - 1))/((SELECT sum(d2) FROM pt)/((SELECT count(*) FROM pt) - (SELECT count(*) FROM sz))), 6) AS calinski,
 round((SELECT davies FROM db), 6) AS davies, round((SELECT silhouette FROM si), 6) AS silhouette"""


@query(SCORES)
def cluster_scores(spark, d):
    points = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"), "label")
    return cluster.cluster_scores(points).select(*[r(c, 6).alias(c) for c in ("inertia", "sdw", "sdb", "calinski", "davies", "silhouette")])


@query()
def kmeans_sweep(spark, d):
    points = stored(cluster.dependence_rows(weekly_edges(spark, d)), "rows")
    return cluster.sweep(points, [2, 3, 4])


def _clustered(spark: SparkSession, d: str, k: int) -> DataFrame:
    return stored(cluster.kmeans(stored(cluster.dependence_rows(weekly_edges(spark, d)), "rows"), k), "labelled")


@query("SELECT k, CAST(25 AS BIGINT) AS points, CAST(k AS BIGINT) AS clusters, true AS nearest, true AS ordered, true AS better_than_one FROM (VALUES (2), (3), (4)) v(k)")
def kmeans_invariants(spark, d):
    """What every fit has to fulfil: all rows labelled, no empty cluster, each row nearest to its own mean, labels by smallest id, less cost than one cluster."""
    out = None
    for k in (2, 3, 4):
        found = _clustered(spark, d, k)
        centres = cluster.centroids(found)
        d2 = found.select("id", "x", F.col("label").alias("own")).crossJoin(F.broadcast(centres.select("label", "centre"))).select("id", "own", "label", cluster.squares(F.col("x"), F.col("centre")).alias("d2"))  # k rows
        near = d2.groupBy("id", "own").agg(F.min(F.when(F.col("label") == F.col("own"), F.col("d2"))).alias("mine"), F.min("d2").alias("least"))
        first = found.groupBy("label").agg(F.min("id").alias("m")).agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("f"), F.count(F.lit(1)).alias("clusters"))  # k rows
        ordered = F.col("f.m") == F.array_sort(F.col("f.m"))
        one = cluster.cluster_scores(found.withColumn("label", F.lit(0))).select(F.col("inertia").alias("one"))
        own = near.agg(F.count(F.lit(1)).alias("points"), F.every(F.col("mine") <= F.col("least") + 1e-9).alias("nearest"), F.sum("mine").alias("cost")).crossJoin(first).crossJoin(one)  # single rows
        own = own.select(F.lit(k).alias("k"), "points", "clusters", "nearest", ordered.alias("ordered"), (F.col("cost") < F.col("one")).alias("better_than_one"))
        out = own if out is None else out.unionAll(own)
    return out


@query()
def cluster_image(spark, d):
    return cluster.cluster_image(cubes.grid(spark, 5, 5), _clustered(spark, d, 3))


@query(f"""WITH {E2}, a AS (SELECT i // 5 AS label, j AS cell, sum(hits) AS s, count(*) AS n FROM edge GROUP BY 1, 2)
SELECT label AS origin, cell, round(s/n::DOUBLE/{W_END - 1}.0::DOUBLE/(1 - 0.95::DOUBLE), 9) AS weight FROM a""")
def centroid_images(spark, d):
    """Mean rows of a given clustering, the rows of the grid, as images."""
    rows = cluster.dependence_rows(weekly_edges(spark, d)).withColumn("label", F.expr("id div 5"))
    return cluster.centroid_images(rows, cells_of(spark, 25)).select("origin", "cell", r("weight").alias("weight"))


@query(f"WITH {F2} SELECT cell, CASE WHEN sum(value) > 0 THEN CAST(cell // 5 AS INTEGER) ELSE -99 END AS label FROM weekly GROUP BY cell")
def label_image(spark, d):
    """A given clustering as an image; cells without a label have -99."""
    labelled = weekly(spark, d).groupBy(F.col("cell").alias("id")).agg(F.sum("value").alias("s")).where("s > 0").select("id", F.expr("cast(id div 5 as int)").alias("label"))
    return cluster.cluster_image(cubes.grid(spark, 5, 5), labelled)


# ---------------------------------------------------------------- verification
R_SQL = "(covar_pop(y_true, y_pred)/nullif(sqrt(var_pop(y_true)*var_pop(y_pred)), 0))"
METRICS = f"""sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae, avg(pow(y_pred - y_true, 2)) AS mse, avg(y_pred - y_true) AS mbe,
 {R_SQL} AS pearson, 1 - sum(pow(y_true - y_pred, 2))/nullif(count(*)*var_pop(y_true), 0) AS nse, 1 - sum(pow(y_true - y_pred, 2))/nullif(count(*)*var_pop(y_true), 0) AS r2,
 1 - var_pop(y_true - y_pred)/nullif(var_pop(y_true), 0) AS explained_variance, avg(abs((y_pred - y_true)/greatest(abs(y_true), 1e-8::DOUBLE)))*100 AS mape,
 avg(abs(y_pred - y_true)/greatest((abs(y_true) + abs(y_pred))/2, 1e-8::DOUBLE))*100 AS smape,
 1 - sqrt(pow({R_SQL} - 1, 2) + pow(sqrt(var_pop(y_pred))/nullif(sqrt(var_pop(y_true)), 0) - 1, 2) + pow(avg(y_pred)/nullif(avg(y_true), 0) - 1, 2)) AS kge"""
DIGITS = {"mape": 2, "rmse": 6, "mae": 6, "mse": 4}


def _rounded(names, keys=()):
    return [*keys, *[(r(n, DIGITS.get(n, 6)) + F.lit(0.0)).alias(n) for n in names]]


def _rounded_sql(names, keys=()):
    return ", ".join([*keys, *[f"round({n}, {DIGITS.get(n, 6)}) + 0.0::DOUBLE AS {n}" for n in names]])


@query(f"WITH {F4}, m AS (SELECT {METRICS} FROM pair) SELECT {_rounded_sql(metrics.SIMPLE)} FROM m")
def metrics_global(spark, d):
    return metrics.metric_map(cubes.forecast_pair(spark, d), by=()).select(*_rounded(metrics.SIMPLE))


BY_CELL = [n for n in metrics.SIMPLE if n != "mape"]


@query(f"WITH {F4}, m AS (SELECT cell, {METRICS} FROM pair GROUP BY cell) SELECT {_rounded_sql(BY_CELL, ['cell'])} FROM m")
def metrics_by_cell(spark, d):
    return metrics.metric_map(cubes.forecast_pair(spark, d)).select(*_rounded(BY_CELL, ["cell"]))


@query(f"WITH {F4}, m AS (SELECT cell, sqrt(avg(pow(y_pred - y_true, 2))) AS v FROM pair GROUP BY cell) SELECT round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM m")
def metrics_reduced(spark, d):
    pair = cubes.forecast_pair(spark, d)
    mean, median = (metrics.metric_reduce(pair, metrics.rmse, how).select(r("value", 6).alias(how)) for how in ("mean", "median"))
    return mean.crossJoin(median)  # single rows


SPEARMAN = """rk AS (SELECT (rank() OVER (ORDER BY y_true) + (count(*) OVER (PARTITION BY y_true) - 1)/2.0::DOUBLE) AS a,
 (rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1)/2.0::DOUBLE) AS b FROM pair)"""
CHI = "(SELECT count(*) FILTER (WHERE y_true >= a AND y_pred >= b)/count(*)::DOUBLE/(1 - {p}::DOUBLE) FROM pair CROSS JOIN (SELECT quantile_cont(y_true, {p}) AS a, quantile_cont(y_pred, {p}) AS b FROM pair))"


@query(f"""WITH {F4}, {SPEARMAN}, m AS (SELECT {METRICS} FROM pair) SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mbe, 6) AS mbe, round(pearson, 6) AS pearson,
 round(nse, 6) AS nse, round(kge, 6) AS kge, (SELECT round(covar_pop(a, b)/sqrt(var_pop(a)*var_pop(b)), 6) FROM rk) AS spearman,
 round({CHI.format(p=0.9)}, 6) AS chi90, round({CHI.format(p=0.95)}, 6) AS chi95, round({CHI.format(p=0.99)}, 6) AS chi99 FROM m""")
def metrics_bundle(spark, d):
    names = ("rmse", "mae", "mbe", "pearson", "nse", "kge", "spearman", "chi90", "chi95", "chi99")
    return metrics.bundle(stored(cubes.forecast_pair(spark, d), "pair")).select(*[r(n, 6).alias(n) for n in names])


@query(f"WITH {F4} SELECT round(avg(abs(y_pred - y_true)), 6) AS quantile_mae FROM pair WHERE y_true >= (SELECT quantile_cont(y_true, 0.95) FROM pair)")
def metrics_quantile_mae(spark, d):
    return metrics.quantile_mae(cubes.forecast_pair(spark, d)).select(r("quantile_mae", 6).alias("quantile_mae"))


@query(f"""WITH {F4}, rk AS (SELECT cell, (rank() OVER (PARTITION BY cell ORDER BY y_true) + (count(*) OVER (PARTITION BY cell, y_true) - 1)/2.0::DOUBLE) AS a,
 (rank() OVER (PARTITION BY cell ORDER BY y_pred) + (count(*) OVER (PARTITION BY cell, y_pred) - 1)/2.0::DOUBLE) AS b FROM pair)
SELECT cell, round(covar_pop(a, b)/nullif(sqrt(var_pop(a)*var_pop(b)), 0), 6) AS spearman FROM rk GROUP BY cell""")
def spearman_by_cell(spark, d):
    return metrics.spearman(cubes.forecast_pair(spark, d), ["cell"]).select("cell", r("spearman", 6).alias("spearman"))


@query(f"""WITH {F4}, q AS (SELECT cell, quantile_cont(y_true, 0.9) AS a, quantile_cont(y_pred, 0.9) AS b, count(*) AS n FROM pair GROUP BY cell),
h AS (SELECT pair.cell, max(n) AS n, count(*) FILTER (WHERE y_true >= a AND y_pred >= b) AS h FROM pair JOIN q ON q.cell = pair.cell GROUP BY pair.cell)
SELECT cell, h/n::DOUBLE/(1 - 0.9::DOUBLE) AS chi FROM h""")
def bivariate_chi_by_cell(spark, d):
    return metrics.bivariate_chi(cubes.forecast_pair(spark, d), 0.9, ["cell"])


EVENTS = """c AS (SELECT {key} count(*) FILTER (WHERE y_true >= {x} AND y_pred >= {x}) AS tp, count(*) FILTER (WHERE y_true < {x} AND y_pred >= {x}) AS fp,
 count(*) FILTER (WHERE y_true >= {x} AND y_pred < {x}) AS fn, count(*) FILTER (WHERE y_true < {x} AND y_pred < {x}) AS tn FROM pair {group})
SELECT {key} tp, fp, fn, tn, tp/nullif(tp + fn, 0)::DOUBLE AS pod, fp/nullif(tp + fp, 0)::DOUBLE AS far, tp/nullif(tp + fp + fn, 0)::DOUBLE AS csi, (tp + fp)/nullif(tp + fn, 0)::DOUBLE AS bias_score FROM c"""


@query(f"WITH {F4}, " + EVENTS.format(key="cell,", x=1, group="GROUP BY cell"))
def event_scores(spark, d):
    return metrics.event_scores(cubes.forecast_pair(spark, d), 1.0, ["cell"])


@query(f"WITH {F4}, " + EVENTS.format(key="", x=20, group=""))
def event_scores_thr20(spark, d):
    return metrics.event_scores(cubes.forecast_pair(spark, d), 20.0)


@query(f"""WITH {F4}, k AS (SELECT a.cell, sum(CASE WHEN (a.y_true - b.y_true)*(a.y_pred - b.y_pred) > 0 THEN 1 ELSE 0 END) AS c,
 sum(CASE WHEN (a.y_true - b.y_true)*(a.y_pred - b.y_pred) < 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN a.y_true = b.y_true THEN 1 ELSE 0 END) AS ty, sum(CASE WHEN a.y_pred = b.y_pred THEN 1 ELSE 0 END) AS tp, count(*) AS n
 FROM pair a JOIN pair b ON a.cell = b.cell AND a.t < b.t GROUP BY a.cell) SELECT cell, round((c - d)/nullif(sqrt((n - ty)::DOUBLE*(n - tp)), 0), 9) AS kendall FROM k""")
def kendall_tau(spark, d):
    return metrics.kendall(cubes.forecast_pair(spark, d)).select("cell", r("kendall").alias("kendall"))


IMAGE_PAIR = F3 + ", ip AS MATERIALIZED (SELECT a.t, a.cell, a.value AS y_true, b.value AS y_pred FROM image a JOIN image b ON a.cell = b.cell AND b.t = a.t - 1)"


def image_pair(spark: SparkSession, d: str) -> DataFrame:
    cube = cubes.image_cube(spark, d)
    before = cube.select((F.col("t") + 1).alias("t"), "cell", F.col("value").alias("y_pred"))
    return cube.select("t", "cell", F.col("value").alias("y_true")).join(before, ["t", "cell"])


@query(f"WITH {IMAGE_PAIR} SELECT t, round(20*log10(max(abs(y_true)) + 1e-6::DOUBLE) - 10*log10(nullif(avg(pow(y_pred - y_true, 2)), 0)), 6) AS psnr FROM ip GROUP BY t")
def psnr(spark, d):
    return metrics.psnr(image_pair(spark, d)).select("t", r("psnr", 6).alias("psnr"))


_G = metrics.gaussian(7)
SSIM = f"""{IMAGE_PAIR},
wt AS MATERIALIZED (SELECT t, oi, oj, ([{', '.join(f'{w!r}::DOUBLE' for w in _G)}])[cell // 8 - oi + 1]*([{', '.join(f'{w!r}::DOUBLE' for w in _G)}])[cell % 8 - oj + 1] AS w, y_true, y_pred
 FROM ip CROSS JOIN range(2) x(oi) CROSS JOIN range(2) y(oj) WHERE cell // 8 - oi BETWEEN 0 AND 6 AND cell % 8 - oj BETWEEN 0 AND 6),
l AS MATERIALIZED (SELECT t, oi, oj, sum(w*y_true) AS ma, sum(w*y_pred) AS mb, sum(w*y_true*y_true) AS aa, sum(w*y_pred*y_pred) AS bb, sum(w*y_true*y_pred) AS ab FROM wt GROUP BY 1, 2, 3),
s AS (SELECT t, avg((2*ma*mb + 0.0001::DOUBLE)/(ma*ma + mb*mb + 0.0001::DOUBLE)*(2*(ab - ma*mb) + 0.0009::DOUBLE)/(aa - ma*ma + bb - mb*mb + 0.0009::DOUBLE)) AS ssim FROM l GROUP BY t)"""


@query(f"WITH {SSIM} SELECT t, round(ssim, 6) AS ssim FROM s")
def ssim(spark, d):
    return metrics.ssim(image_pair(spark, d), 8, 8).select("t", r("ssim", 6).alias("ssim"))


@query(f"WITH {SSIM}, parts AS (SELECT t, 0.4::DOUBLE*avg(pow(y_pred - y_true, 2)) + 0.4::DOUBLE*avg(abs(y_pred - y_true)) AS x FROM ip GROUP BY t UNION ALL SELECT t, 0.2::DOUBLE*(1 - ssim) AS x FROM s) SELECT t, round(sum(x), 6) AS loss FROM parts GROUP BY t")
def combined_loss(spark, d):
    return metrics.combined_loss(image_pair(spark, d), 8, 8).select("t", r("loss", 6).alias("loss"))


@query(f"""WITH {F4}, q AS (SELECT cell, t, y_true, lag(y_pred) OVER (PARTITION BY cell ORDER BY t) AS y_pred FROM pair), two AS (SELECT * FROM q WHERE y_pred IS NOT NULL),
a AS (SELECT {METRICS} FROM pair), b AS (SELECT {METRICS} FROM (SELECT * FROM two)) SELECT x.metric, round(CASE x.metric WHEN 'rmse' THEN a.rmse WHEN 'mae' THEN a.mae ELSE a.nse END, 6) AS lag1,
 round(CASE x.metric WHEN 'rmse' THEN b.rmse WHEN 'mae' THEN b.mae ELSE b.nse END, 6) AS lag2 FROM (VALUES ('rmse'), ('mae'), ('nse')) x(metric) CROSS JOIN a CROSS JOIN b""")
def model_compare(spark, d):
    from pyspark.sql import Window

    one = cubes.forecast_pair(spark, d)
    two = one.withColumn("y_pred", F.lag("y_pred").over(Window.partitionBy("cell").orderBy("t")))
    chosen = {k: metrics.SIMPLE[k] for k in ("rmse", "mae", "nse")}
    found = metrics.compared(lag1=metrics.metric_map(one, chosen, ()), lag2=metrics.metric_map(two, chosen, ()))
    return found.select("metric", r("lag1", 6).alias("lag1"), r("lag2", 6).alias("lag2"))


@query(f"""WITH {F5}, b AS (SELECT * FROM orderpair WHERE y_pred IS NOT NULL), k AS (SELECT sum(CASE WHEN (a.y_true - b.y_true)*(a.y_pred - b.y_pred) > 0 THEN 1 ELSE 0 END) AS c,
 sum(CASE WHEN (a.y_true - b.y_true)*(a.y_pred - b.y_pred) < 0 THEN 1 ELSE 0 END) AS d, sum(CASE WHEN a.y_true = b.y_true THEN 1 ELSE 0 END) AS ty, sum(CASE WHEN a.y_pred = b.y_pred THEN 1 ELSE 0 END) AS tp, count(*) AS n
 FROM b a JOIN b ON a.k < b.k) SELECT round((c - d)/nullif(sqrt((n - ty)::DOUBLE*(n - tp)), 0), 9) AS kendall FROM k""")
def kendall_orders(spark, d):
    """One long series, by ranges of both columns."""
    return metrics.kendall_by_ranges(cubes.order_pair(spark, d)).select(r("kendall").alias("kendall"))


@query(f"""WITH {F5}, g AS (SELECT k, k % 3 AS cell, y_true AS value FROM orderpair UNION ALL SELECT k, 3, y_pred FROM orderpair)
SELECT k AS t, cell, CASE WHEN value IS NOT NULL THEN (rank() OVER (PARTITION BY cell ORDER BY value NULLS LAST) + (count(*) OVER (PARTITION BY cell, value) - 1)/2.0::DOUBLE)/(count(value) OVER (PARTITION BY cell) + 1) END AS u FROM g""")
def ecdf_long_series(spark, d):
    """Series of uneven length, one of as many rows as the others together, ranked by ranges of their values."""
    pair = cubes.order_pair(spark, d)
    short = pair.select(F.col("k").alias("t"), (F.col("k") % 3).alias("cell"), F.col("y_true").alias("value"))
    return ecdf_by_ranges(short.unionByName(pair.select(F.col("k").alias("t"), F.lit(3).cast("long").alias("cell"), F.col("y_pred").alias("value"))))


# ---------------------------------------------------------------- missing values
@query(f"WITH {F5} SELECT count(*) AS n, count(y_pred) AS known, round(sqrt(avg(pow(y_pred - y_true, 2))), 4) AS rmse FROM orderpair WHERE y_pred IS NOT NULL OR y_pred IS NULL")
def masked_pairs(spark, d):
    pair = cubes.order_pair(spark, d)
    counts = pair.agg(F.count(F.lit(1)).alias("n"), F.count("y_pred").alias("known"))
    return counts.crossJoin(metrics.metric_map(pair, {"rmse": metrics.rmse}, ()).select(r("rmse", 4).alias("rmse")))  # single rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


from . import catalog_stores  # noqa: E402, F401  its queries register themselves here
