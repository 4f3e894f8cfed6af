"""Structured Streaming forms of the event jobs; each equals its batch version on the same input.

Sinks are parquet folders with exactly-once or idempotent writes, so a restarted query continues from
its checkpoint. ``replay`` runs a stream over the files present and returns what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cadastre.functions import geom as G
from cadastre.operators import history as H
from cadastre.session import ensure_checkpoint_dir
from cadastre.sources.store import register_imagery, uploads_from_files

#: state store whose state need not fit in memory
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, name: str) -> str:
    """Folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A parquet table (file, glob or folder) replayed as a stream in file order."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def current_state(events: DataFrame) -> DataFrame:
    """Running status per parcel; a late event loses by its timestamp, whatever batch it comes in."""
    last = F.max_by(F.struct("action", "value", "ts", "event_id"), F.struct("ts", "event_id"))
    g = events.groupBy("parcel_id").agg(last.alias("last"), F.count("*").alias("review_count"))
    return g.select(
        "parcel_id", H.lookup(F.col("last.action"), H.STATUS_AFTER, F.lit(None)).alias("current_status"), F.col("last.ts").alias("reviewed_at"),
        F.col("last.event_id").alias("last_event_id"), "review_count",
    )


def job_progress(updates: DataFrame) -> DataFrame:
    """Latest stage and progress per job, with the number of log lines."""
    last = F.max_by(F.struct("status", "progress", "ts"), F.struct("ts", "update_id"))
    g = updates.groupBy("job_id").agg(last.alias("last"), F.count("*").alias("log_lines"))
    return g.select("job_id", "last.status", "last.progress", F.col("last.ts").alias("updated_at"), "log_lines")


def _untimed():
    """Stands for a missing time, before all others."""
    return F.timestamp_micros(F.lit(-(10**16)))


def day_numbers(events: DataFrame) -> DataFrame:
    """Running (parcel_id, day, event_id, us, action, number); an event comes again when its number moves.

    State is the set of a parcel's events of a day, each with the time of the batch that brought it, kept by
    Spark's own aggregation. An event that comes again with the same time counts once, as it came first. What
    stands before the first event new to a batch has kept its number and is not emitted.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.coalesce(F.col("ts").cast("timestamp"), _untimed())
    slim = events.select("parcel_id", F.to_date(at).alias("day"), F.unix_micros(at).alias("us"), "event_id", "action")
    slim = slim.select(*[F.col(c).cast("bigint").alias(c) if c in ("parcel_id", "event_id") else F.col(c) for c in slim.columns])
    slim = slim.withColumn("came", F.current_timestamp())
    seen = slim.groupBy("parcel_id", "day").agg(F.array_sort(F.collect_set(F.struct("us", "event_id", "came", "action"))).alias("events"))
    seen = seen.withColumn("now", F.current_timestamp())

    def first_of_its_kind(e, i):
        before = F.get("events", i - 1)
        return (i == 0) | ~(e["us"].eqNullSafe(before["us"]) & e["event_id"].eqNullSafe(before["event_id"]))

    kept = G.once(seen, events=F.filter("events", first_of_its_kind))
    numbered = F.transform("events", lambda e, i: F.struct(e["event_id"].alias("event_id"), e["us"].alias("us"), e["action"].alias("action"), (i + 1).cast("bigint").alias("number"), e["came"].alias("came")))

    def moved(n):
        first = F.array_min(F.transform(F.filter(n, lambda e: e["came"] == F.col("now")), lambda e: e["number"]))
        return F.slice(n, first, F.size(n))

    return kept.select("parcel_id", "day", F.inline(G.let(numbered, moved))).drop("came")


def versions(events: DataFrame, name: str = "versions") -> DataFrame:
    """Gap-free version numbers per parcel over the available files, as ``number_rows`` gives them in batch.

    The stream numbers events within (parcel, day), so a parcel with very many events is spread over its
    days and no batch reads stored events again; the counts of earlier days are added when the result is
    read. Late events move later numbers. An event that comes twice counts once. Events without a time
    come first, those without a parcel are numbered together.
    """
    numbers = replay(day_numbers(events), name, ["parcel_id", "day", "event_id", "us"])
    sizes = numbers.groupBy("parcel_id", "day").agg(F.max("number").alias("size"))
    before = Window.partitionBy("parcel_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("parcel_id", "day", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("earlier"))
    at = F.timestamp_micros("us")
    ts = F.when(at != _untimed(), at).cast(events.schema["ts"].dataType).alias("ts")
    shift = shift.withColumnsRenamed({"parcel_id": "p__", "day": "d__"})
    both = numbers.join(shift, F.col("parcel_id").eqNullSafe(F.col("p__")) & (F.col("day") == F.col("d__")))
    return both.select("event_id", "parcel_id", ts, "action", (F.col("number") + F.col("earlier")).alias("version_number"))


def activity_counts(activities: DataFrame, delay: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Tumbling counts per type of deduplicated activities; state is dropped behind the watermark.

    In update mode (``replay`` with the key) open windows come out with what they hold so far; in append
    mode a window comes out once, when the watermark has passed it.
    """
    fresh = activities.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["activity_id"])
    counted = fresh.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "type", "n")


def imagery_intake(uploads: DataFrame) -> DataFrame:
    """Upload records to catalogue rows as they arrive."""
    return register_imagery(uploads)


def imagery_files(spark: SparkSession, path: str) -> DataFrame:
    """New image files of a folder as catalogue rows."""
    schema = spark.read.format("binaryFile").load(path).schema
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return register_imagery(uploads_from_files(files))


def replay(stream: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """Run over the available files and read the result.

    With ``key`` the stream runs in update mode: every batch writes its changed rows into its own
    partition (a repeated batch overwrites itself) and the last batch of a key holds its state.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)
    writer = stream.writeStream.option("checkpointLocation", path + "/offsets").trigger(availableNow=True)
    if key is None:
        writer.outputMode("append").format("parquet").option("path", path + "/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path + "/rows")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    writer.outputMode("update").foreachBatch(save).start().awaitTermination()
    written = spark.read.parquet(path + "/rows")
    values = [c for c in stream.columns if c not in key]
    return written.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("s")).select(*key, "s.*")
