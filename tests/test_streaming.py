from pyspark.sql import functions as F

from tablescry.streaming import incremental


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_pages_are_cut_free(spark, tmp_path):
    text = '{"a":1}\n{"b":2}\r\n{"c":3}'
    for size in (3, 10):
        folder = tmp_path / str(size)
        for i, at in enumerate(range(0, len(text), size)):
            part = spark.createDataFrame([("f", i, text[at : at + size], at + size >= len(text))], "source string, page long, data string, done boolean")
            part.coalesce(1).write.mode("append").json(str(folder))
        chunks = spark.readStream.schema("source string, page long, data string, done boolean").json(str(folder))
        out = run(incremental.paged_records(chunks), f"paged{size}")
        assert [(r["line"], r["raw"]) for r in out.orderBy("line").collect()] == [(1, '{"a":1}'), (2, '{"b":2}'), (3, '{"c":3}')]


def test_hourly_and_pyramid(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    events.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(incremental.hourly(stream), "hourly", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.hourly(events).collect()))
    frame = lambda df: df.select(F.col("event_id").alias("frame"), F.lit(0).alias("channel"), F.col("value").alias("sample"))
    got = run(incremental.bucketed(frame(stream)), "buckets", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.bucketed(frame(events)).collect()))


def test_row_window(spark, sf):
    df = spark.read.parquet(f"{sf}/orders.parquet")
    assert incremental.row_window(df, 100, 50).count() == 50
