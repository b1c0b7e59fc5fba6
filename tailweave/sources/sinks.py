"""Sinks: partitioned tables, run stores, rasters with their metadata, and text exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_relations(folder: str, **relations: DataFrame) -> None:
    """One parquet table for each named relation."""
    for name, df in relations.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_nested(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines; NULL members stay, so that they come back."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_graph(edges: DataFrame, folder: str, lag: int) -> None:
    """Edges of one lag; other lags of the folder stay."""
    edges.write.mode("overwrite").parquet(f"{folder}/lag={lag}")


def matrix_view(edges: DataFrame, cells: list[int]) -> DataFrame:
    """The dense matrix, one row a cell, for exports of bounded size."""
    return edges.groupBy("i").pivot("j", cells).agg(F.first("chi")).orderBy("i")


def raster_metadata(lat: list[float], lon: list[float]) -> dict:
    """Origin and pixel size of a north-up raster in degrees; x steps along longitude."""
    dx, dy = abs(lon[1] - lon[0]), abs(lat[1] - lat[0])
    return {"crs": "EPSG:4326", "west": min(lon) - dx / 2, "north": max(lat) + dy / 2, "pixel_x": dx, "pixel_y": dy, "height": len(lat), "width": len(lon)}


def write_raster(bands: DataFrame, path: str, lat: list[float], lon: list[float]) -> None:
    """bands(band, cell, value): float pixels, with the metadata as a column of a one-row table beside them."""
    bands.select("band", "cell", F.col("value").cast("float").alias("value")).write.mode("overwrite").partitionBy("band").parquet(f"{path}/pixels")
    bands.sparkSession.createDataFrame([(json.dumps(raster_metadata(lat, lon)),)], "metadata string").write.mode("overwrite").json(f"{path}/metadata")


def write_geotiff(bands: DataFrame, path: str, lat: list[float], lon: list[float]) -> None:
    """Adapter for GeoTIFF, where rasterio is installed; one raster has to fit the driver."""
    try:
        import numpy as np
        import rasterio
        from rasterio.transform import from_origin
    except ImportError as e:
        raise NotImplementedError("rasterio is not installed; write_raster keeps the same pixels and metadata") from e
    m = raster_metadata(lat, lon)
    rows = bands.orderBy("band", "cell").select("value").toPandas()["value"].to_numpy(np.float32).reshape(-1, m["height"], m["width"])
    with rasterio.open(path, "w", driver="GTiff", height=m["height"], width=m["width"], count=len(rows), dtype="float32", crs=m["crs"], transform=from_origin(m["west"], m["north"], m["pixel_x"], m["pixel_y"])) as f:
        f.write(rows)


def write_scores(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_runs(df: DataFrame, folder: str, name: str = "run_name") -> None:
    """Idempotent store of runs: a run that is written again replaces its partition only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(folder)


def write_bucketed(df: DataFrame, table: str, folder: str, keys: Sequence[str] = ("t", "cell"), buckets: int = 64) -> None:
    """df as a table of the session's catalog, its files in folder, dealt to buckets by keys: joins and groups by these keys of tables with as many buckets need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).saveAsTable(table)


def write_puzzle(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("date" if "date" in df.columns else "t").parquet(path)
