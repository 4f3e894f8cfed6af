"""Queries T01-T05: streams replayed over the tables, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.sources import derived as D
from cadastre.streaming import streams as T

EVENT_COLUMNS = [
    "event_id", "user_id AS parcel_id", "ts",
    "CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'error' THEN 'Rejected' WHEN 'signup' THEN 'Needs Review' ELSE 'Edited' END AS action", "event_type", "value",
]


def event_stream(spark, d):
    return T.read_table_stream(spark, f"{d}/events*.parquet").selectExpr(*EVENT_COLUMNS)


@query("t01_stream_current_state", sql("events_fx", body=""", l AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY parcel_id) AS n FROM events_fx)
  SELECT parcel_id, CASE action WHEN 'Accepted' THEN 'accepted' WHEN 'Edited' THEN 'accepted' WHEN 'Rejected' THEN 'rejected' ELSE 'needs_review' END AS current_status, ts AS reviewed_at, event_id AS last_event_id, n AS review_count FROM l WHERE rn=1"""))
def t01(spark, d):
    return T.replay(T.current_state(event_stream(spark, d)), "current-state", ["parcel_id"])


@query("t02_stream_versions", sql("events_fx", body="SELECT event_id, parcel_id, action, row_number() OVER (PARTITION BY parcel_id ORDER BY ts, event_id) AS version_number FROM events_fx"))
def t02(spark, d):
    return T.versions(event_stream(spark, d)).select("event_id", "parcel_id", "action", "version_number")


@query("t03_stream_activity_feed", sql("events_fx", body="""SELECT date_trunc('hour', ts) AS window_start, action AS type, count(*) AS n FROM events_fx GROUP BY 1,2"""))
def t03(spark, d):
    a = event_stream(spark, d).select(F.col("event_id").alias("activity_id"), F.col("action").alias("type"), F.col("ts").cast("timestamp").alias("ts"))
    out = T.replay(T.activity_counts(a), "activity-feed", ["window_start", "type"])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


STAGE = "CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'PROCESSING' WHEN 'signup' THEN 'AI_DETECTION' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END"
PROGRESS = "CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 20 WHEN 'signup' THEN 40 ELSE 100 END"


@query("t04_stream_job_progress", f"""WITH l AS (SELECT user_id AS job_id, {STAGE} AS status, {PROGRESS} AS progress, ts AS updated_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS log_lines FROM events)
  SELECT job_id, status, progress, updated_at, log_lines FROM l WHERE rn=1""")
def t04(spark, d):
    u = T.read_table_stream(spark, f"{d}/events*.parquet").selectExpr("event_id AS update_id", "user_id AS job_id", "ts", f"{STAGE} AS status", f"{PROGRESS} AS progress")
    return T.replay(T.job_progress(u), "job-progress", ["job_id"])


@query("t05_stream_imagery_intake", sql("uploads", body="""SELECT upload_id, coalesce(width,4000) AS width, coalesce(flag_georeferenced, lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff') AS is_georeferenced, 'READY' AS status FROM uploads"""))
def t05(spark, d):
    o = T.read_table_stream(spark, f"{d}/orders*.parquet")
    return T.replay(T.imagery_intake(D.upload_rows(o)), "intake").select("upload_id", "width", "is_georeferenced", "status")
