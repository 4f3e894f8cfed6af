"""Streams over several files equal the batch result."""

from pyspark.sql import functions as F

from cadastre.catalog.streams import EVENT_COLUMNS
from cadastre.operators import history as H
from cadastre.sources import derived as D
from cadastre.streaming import streams as T


def split_events(spark, small, path, parts=4):
    e = spark.read.parquet(f"{small}/events.parquet")
    n = e.count()
    for i in range(parts):
        lo, hi = n * i // parts, n * (i + 1) // parts
        e.where(F.col("event_id").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(path)
    return T.read_table_stream(spark, path).selectExpr(*EVENT_COLUMNS)


def test_current_state_over_files(spark, small, tmp_path):
    got = T.replay(T.current_state(split_events(spark, small, str(tmp_path / "e"))), "s", ["parcel_id"])
    parcels = D.events(spark, small).select("parcel_id").distinct().withColumn("status", F.lit(None).cast("string"))
    batch = H.current_state(parcels, D.events(spark, small)).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select(*got.columns).collect()))


def test_versions_equal_the_batch_numbers(spark, small, tmp_path):
    got = T.versions(split_events(spark, small, str(tmp_path / "e")))
    batch = H.number_events(D.events(spark, small)).select("event_id", "version_number")
    assert sorted(map(tuple, got.select("event_id", "version_number").collect())) == sorted(map(tuple, batch.collect()))


def test_a_late_event_moves_later_versions(spark, tmp_path):
    path = str(tmp_path / "e")
    for rows in ([(1, 7, "2024-01-02 00:00:00", "Edited")], [(2, 7, "2024-01-01 00:00:00", "Edited"), (1, 7, "2024-01-02 00:00:00", "Edited")]):
        df = spark.createDataFrame(rows, "event_id long, parcel_id long, ts string, action string")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(path)
    got = T.versions(T.read_table_stream(spark, path))
    assert {(r.event_id, r.version_number) for r in got.collect()} == {(2, 1), (1, 2)}


def test_only_moved_numbers_are_emitted(spark, tmp_path):
    path = str(tmp_path / "e")
    batches = [[(1, 7, "2024-01-02 00:00:00"), (3, 7, "2024-01-02 06:00:00")], [(4, 7, "2024-01-02 07:00:00"), (9, 7, "2024-01-05 00:00:00")], [(2, 7, "2024-01-02 05:00:00"), (1, 7, "2024-01-02 00:00:00")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "event_id long, parcel_id long, ts string").withColumn("action", F.lit("Edited"))
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(path)
    emitted = []
    stream = T.day_numbers(T.read_table_stream(spark, path))
    writer = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).outputMode("update")
    writer.foreachBatch(lambda b, i: emitted.append(sorted((r.event_id, r.number) for r in b.collect()))).start().awaitTermination()
    assert emitted == [[(1, 1), (3, 2)], [(4, 3), (9, 1)], [(2, 2), (3, 3), (4, 4)]]
    assert {(r.event_id, r.version_number) for r in T.versions(T.read_table_stream(spark, path)).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (9, 5)}


def test_day_numbers_run_without_python_and_keep_the_first_of_repeats(spark, tmp_path):
    path = str(tmp_path / "e")
    for rows in ([(1, 7, "2024-01-02 00:00:00", "Edited")], [(1, 7, "2024-01-02 00:00:00", "Accepted"), (None, 7, "2024-01-02 00:00:00", "Edited"), (5, 8, "2024-01-02 00:00:00", "Edited")]):
        df = spark.createDataFrame(rows, "event_id long, parcel_id long, ts string, action string")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(path)
    stream = T.day_numbers(T.read_table_stream(spark, path))
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = T.versions(T.read_table_stream(spark, path)).collect()
    assert {(r.parcel_id, r.event_id, r.version_number, r.action) for r in got} == {(7, None, 1, "Edited"), (7, 1, 2, "Edited"), (8, 5, 1, "Edited")}


def test_versions_of_events_without_time_or_parcel(spark, tmp_path):
    df = spark.createDataFrame([(1, 7, "2024-01-02 00:00:00"), (2, 7, None), (3, None, "2024-01-02 00:00:00")], "event_id long, parcel_id long, ts string")
    df.withColumns({"action": F.lit(None).cast("string"), "ts": F.to_timestamp_ntz("ts")}).coalesce(1).write.parquet(str(tmp_path / "e"))
    got = T.versions(T.read_table_stream(spark, str(tmp_path / "e"))).collect()
    assert {(r.event_id, r.parcel_id, r.ts is None, r.version_number) for r in got} == {(1, 7, False, 2), (2, 7, True, 1), (3, None, False, 1)}


def test_duplicates_are_dropped_within_the_watermark(spark, small, tmp_path):
    s = split_events(spark, small, str(tmp_path / "e"))
    a = s.select(F.col("event_id").alias("activity_id"), F.col("action").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    once = T.replay(T.activity_counts(a), "a").groupBy().sum("n").first()[0]
    s = split_events(spark, small, str(tmp_path / "f"))
    a = s.select(F.col("event_id").alias("activity_id"), F.col("action").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    twice = T.replay(T.activity_counts(a.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).drop("k")), "a").groupBy().sum("n").first()[0]
    assert once == twice > 0


def test_imagery_files_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.tif").write_bytes(b"1234")
    (folder / "b.png").write_bytes(b"12345678")
    got = {r.file_name: r.is_georeferenced for r in T.replay(T.imagery_files(spark, str(folder)), "files").collect()}
    assert got == {"a.tif": True, "b.png": False}
