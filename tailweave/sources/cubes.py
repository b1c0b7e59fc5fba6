"""Cubes and other inputs: readers, dense spines, and the cubes built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_cube(spark: SparkSession, path: str, layout: str = "raw") -> DataFrame:
    """cube(t, cell, value[, date]) from columnar storage; NaN becomes NULL.  layout 'real' keeps dates as text."""
    if layout not in ("raw", "real"):
        raise ValueError("layout is 'raw' or 'real'")
    df = spark.read.parquet(path)
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    columns = [F.col("t").cast("bigint"), F.col("cell").cast("bigint"), value.alias("value")]
    return df.select(*columns, *([F.col("date").cast("string")] if layout == "real" else []))


def read_folder(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """All files with a suffix below a folder, with the file each row came from."""
    return spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").parquet(folder).withColumn("source_file", F.input_file_name())


def read_nested(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested stores: one JSON document a row, with a declared schema."""
    return spark.read.schema(schema).json(path)


#: Places of the datasets in the two layouts of HDF5 cubes.
HDF5_NAMES = {
    "raw": {"data": "root/data", "lat": "root/lat", "lon": "root/lon", "time": "root/time"},
    "real": {"data": "Data", "lat": "lat", "lon": "lon", "time": "date"},
}


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("h5py is not installed; convert the file to parquet (t, cell, value)") from e
    return h5py


def _as_text(x) -> str:
    return x.decode() if isinstance(x, bytes) else str(x)


def read_hdf5_cube(spark: SparkSession, path: str, layout: str = "raw") -> DataFrame:
    """Adapter for HDF5 cubes, where h5py is installed: (t, cell, value, date); each task reads the steps it is given.  Non-finite values are NULL."""
    names = HDF5_NAMES[layout]
    with _h5py().File(path) as f:
        steps = f[names["data"]].shape[0]

    def block(batches):
        import h5py
        import numpy as np
        import pandas as pd

        with h5py.File(path) as f:
            data, time = f[names["data"]], f[names["time"]]
            for batch in batches:
                for t in batch["id"]:
                    flat = np.asarray(data[t], float).ravel()
                    yield pd.DataFrame({"t": t, "cell": np.arange(flat.size), "value": flat, "date": _as_text(time[t])})

    return spark.range(steps).mapInPandas(block, "t long, cell long, value double, date string").withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def read_hdf5_grid(spark: SparkSession, path: str, layout: str = "raw") -> DataFrame:
    """grid(cell, i, j, lat, lon, is_land) from the file's axes, which are as long as the grid is high and wide."""
    names = HDF5_NAMES[layout]
    with _h5py().File(path) as f:
        lat, lon = ([float(x) for x in f[names[k]][:]] for k in ("lat", "lon"))
    rows = spark.createDataFrame(list(enumerate(lat)), "i long, lat double").crossJoin(F.broadcast(spark.createDataFrame(list(enumerate(lon)), "j long, lon double")))  # axes
    return rows.select((F.col("i") * len(lon) + F.col("j")).alias("cell"), "i", "j", "lat", "lon", F.lit(True).alias("is_land"))


def read_hdf5_puzzle(spark: SparkSession, path: str) -> DataFrame:
    """puzzle(date, cell, x, y) of a file with X (N, [1,] H, W, C), Y (N, [1,] H, W[, 1]) and date."""
    with _h5py().File(path) as f:
        n = f["X"].shape[0]

    def block(batches):
        import h5py
        import numpy as np
        import pandas as pd

        with h5py.File(path) as f:
            for batch in batches:
                for k in batch["id"]:
                    x, y = np.asarray(f["X"][k], float), np.asarray(f["Y"][k], float).ravel()
                    x = x.reshape(y.size, -1)
                    yield pd.DataFrame({"date": _as_text(f["date"][k]), "cell": np.arange(y.size), "x": list(x), "y": y})

    return spark.range(n).mapInPandas(block, "date string, cell long, x array<double>, y double")


def read_puzzle(spark: SparkSession, path: str) -> DataFrame:
    """puzzle(t or date, cell, x, y) as the sink wrote it."""
    return spark.read.parquet(path)


def grid(spark: SparkSession, height: int, width: int, lat0: float = 10.0, lon0: float = 100.0, step: float = 1.0) -> DataFrame:
    """Row-major cells with coordinates, north first."""
    cells = spark.range(height * width).select(F.col("id").alias("cell"))
    i, j = F.expr(f"cell div {width}"), F.col("cell") % width
    return cells.select("cell", i.alias("i"), j.alias("j"), (F.lit(lat0) - step * i).alias("lat"), (F.lit(lon0) + step * j).alias("lon"), F.lit(True).alias("is_land"))


def dense(observed: DataFrame, steps: int, cells: int, value: str = "value") -> DataFrame:
    """The full (t, cell) spine with absent values 0, and whatever was observed outside it.  The spine is generated, not read."""
    spark = observed.sparkSession
    spine = spark.range(steps * cells).select(F.expr(f"id div {cells}").alias("t"), (F.col("id") % cells).alias("cell"))
    return spine.join(observed, ["t", "cell"], "full").select("t", "cell", F.coalesce(value, F.lit(0)).alias(value))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


HOURLY_STEPS, HOURLY_CELLS, HOURLY_WIDTH = 720, 20, 4
WEEKLY_STEPS, WEEKLY_CELLS, WEEKLY_WIDTH = 358, 25, 5
IMAGE_CELLS, IMAGE_WIDTH = 64, 8


def hourly_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sparse rain-like cube of integer cents: rows are event kinds, columns user groups."""
    events = _table(spark, sf_dir, "events")
    row = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup"))), F.col("event_type")) - 1
    row = F.when(row < 0, 4).otherwise(row)
    t = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").alias("t")
    cents = events.select(t, (row * 4 + F.col("user_id") % 4).alias("cell"), F.round(F.col("value") * 100).cast("bigint").alias("value_cents"))
    return dense(cents.groupBy("t", "cell").agg(F.sum("value_cents").alias("value_cents")), HOURLY_STEPS, HOURLY_CELLS, "value_cents")


def weekly_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantity by week and supplier nation: rows are regions."""
    items = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    t = F.expr("cast(floor(datediff(to_date(l_shipdate), date'1995-01-01') / 7) as bigint)")
    cell = F.expr("cast((s_nationkey % 5) * 5 + s_nationkey div 5 as bigint)")
    joined = items.join(suppliers, items["l_suppkey"] == suppliers["s_suppkey"])
    sums = joined.select(t.alias("t"), cell.alias("cell"), F.col("l_quantity").cast("bigint").alias("value")).groupBy("t", "cell").agg(F.sum("value").alias("value"))
    return dense(sums, WEEKLY_STEPS, WEEKLY_CELLS)


def image_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 image."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("cell", "value"), "label").select("t", F.col("cell").cast("bigint").alias("cell"), F.col("value").cast("double").alias("value"), "label")


def forecast_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persistence on the hourly cube: the value an hour before is the forecast."""
    cube = hourly_cents(spark, sf_dir)
    before = F.lag("value_cents").over(Window.partitionBy("cell").orderBy("t"))
    return cube.select("cell", "t", (F.col("value_cents") / 100).alias("y_true"), (before / 100).alias("y_pred")).where("y_pred is not null")


def order_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the sums of their items; orders without items have no forecast."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("y_true"))
    items = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100).alias("y_pred"))
    return orders.join(items, "k", "left")


def merge_run_stores(*stores: DataFrame, name: str = "name") -> DataFrame:
    """Union of run stores; of rows with one name the last store's wins."""
    tagged = [s.withColumn("__source", F.lit(k)) for k, s in enumerate(stores)]
    both = tagged[0]
    for s in tagged[1:]:
        both = both.unionByName(s)
    w = Window.partitionBy(name).orderBy(F.desc("__source"))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__source")


def gazetteer_lookup(places: DataFrame, gazetteer: DataFrame, name: str = "name") -> DataFrame:
    """lat and lon of each place by name; NULL where the gazetteer has none."""
    return places.join(gazetteer, name, "left")
