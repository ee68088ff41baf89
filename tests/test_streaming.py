from pyspark.sql import functions as F

from tallyweave.streaming import eventlog


def test_stream_windows_match_the_table(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    parts = table.repartition(3)
    parts.write.parquet(str(tmp_path / "in"))
    stream = eventlog.read_events(spark, str(tmp_path / "in"), table.schema, 1)
    (eventlog.tumbling(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination())
    want = eventlog.tumbling(table.withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, spark.table("w").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_latest_status_as_state(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").limit(200)
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = eventlog.read_events(spark, str(tmp_path / "in"), table.schema).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("status"), "ts")
    eventlog.latest_status(stream).writeStream.outputMode("update").format("memory").queryName("s").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.key: r.status for r in spark.table("s").groupBy("key").agg(F.max_by("status", "ts").alias("status")).collect()}
    want = {str(r.user_id): r.ts for r in table.groupBy("user_id").agg(F.max("ts").alias("ts")).collect()}
    by_event = {str(r.event_id): r.ts for r in table.collect()}
    assert got.keys() == want.keys() and all(by_event[s] == want[k] for k, s in got.items())


def test_upsert(spark, tmp_path):
    write = eventlog.upsert_into(str(tmp_path / "t"), ["key"], F.col("at"))
    schema = "key string, status string, at long"
    write(spark.createDataFrame([("a", "new", 1), ("b", "new", 1)], schema), 0)
    write(spark.createDataFrame([("a", "done", 3), ("b", "old", 0)], schema), 1)
    assert {(r.key, r.status) for r in spark.read.parquet(str(tmp_path / "t" / "1")).collect()} == {("a", "done"), ("b", "new")}
