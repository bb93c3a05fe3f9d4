from pyspark.sql import functions as F

from quarry.streaming import projection


def test_projection_failures_and_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long").repartition(3).write.parquet(src)
    stream = projection.source(spark, src, spark.read.parquet(src).schema, 1)
    calls = []

    def derive(batch):
        calls.append(1)
        if len(calls) in (1, 3, 4):  # the first batch fails once; the second fails with all its tries
            raise RuntimeError("broken")
        return batch.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    paths = [str(tmp_path / p) for p in ("out", "cp", "bad")]
    q = projection.project(stream, derive, *paths, retries=(0.0,), sleep=lambda s: None)
    projection.drain(q)
    assert spark.read.parquet(paths[2]).count() == 1
    assert spark.read.parquet(paths[0]).agg(F.sum("n")).first()[0] == 20
    projection.drain(projection.project(stream, derive, *paths, retries=(0.0,), sleep=lambda s: None))  # nothing new
    assert spark.read.parquet(paths[0]).agg(F.sum("n")).first()[0] == 20


def test_latest_state_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i, f"k{i % 7}", f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, k string, v string")
    df.repartition(4).write.parquet(src)
    stream = projection.source(spark, src, df.schema, 1)
    projection.drain(projection.latest_state_stream(stream, ["k"], ["id"], out, str(tmp_path / "cp")))
    assert {(r.k, r.v) for r in projection.read_state(spark, out, ["k"], ["id"]).collect()} == {(f"k{i % 7}", f"v{i}") for i in range(53, 60)}
    projection.compact_state(spark, out, ["k"], ["id"], str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 7
