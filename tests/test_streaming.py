"""Streams against frozen thresholds agree with the batch counts."""

from pyspark.sql import functions as F

from tailweave.operators import graph
from tailweave.functions.ranks import ecdf
from tailweave.sources import cubes
from tailweave.streaming import exceedances as stream


def test_streamed_counts_match_the_graph(spark, small, tmp_path):
    cube = cubes.hourly_cents(spark, small).withColumnRenamed("value_cents", "value")
    thresholds = stream.frozen_thresholds(cube)
    timed = cube.withColumn("ts", F.timestamp_seconds(F.col("t") * 3600 + 1704067200)).select("ts", "cell", "value")
    source = str(tmp_path / "in")
    timed.coalesce(2).write.parquet(source)
    read = lambda: spark.readStream.schema(timed.schema).parquet(source)
    late, early = (stream.stream_exceedances(read(), thresholds) for _ in range(2))
    out = str(tmp_path / "counts")
    run = stream.stream_joint(late, early, "1 hour").writeStream.foreachBatch(lambda df, k: stream.add_counts(df, out, k)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    streamed = {(r["i"], r["j"]): r["hits"] for r in spark.read.parquet(out).groupBy("i", "j").agg(F.sum("hits").alias("hits")).collect()}
    batch = {(r["i"], r["j"]): r["hits"] for r in graph.joint_hits(ecdf(cube), 1, 0, 720, 0.95).collect()}
    assert streamed == batch


def test_window_counts_wait_for_the_watermark(spark, small, tmp_path):
    cube = cubes.hourly_cents(spark, small).withColumnRenamed("value_cents", "value")
    timed = cube.withColumn("ts", F.timestamp_seconds(F.col("t") * 3600 + 1704067200)).select("ts", "cell", "value")
    timed.where("value > 0").coalesce(1).write.parquet(str(tmp_path / "in"))
    thresholds = cube.select("cell").distinct().withColumn("threshold", F.lit(1))
    found = stream.stream_window_counts(stream.stream_exceedances(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), thresholds))
    run = found.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] <= timed.where("value > 0").count()
    assert spark.table("windows").count() > 0
