"""Table maintenance: replace, delete, soft delete, reset, import, upsert, chunk assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadastre.functions import geom as G


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str], replaced: DataFrame | None = None) -> DataFrame:
    """Rows of the replaced key values give way to ``new``; the rest is kept.

    ``replaced`` lists key values to clear even when no new row carries them.
    """
    gone = (replaced if replaced is not None else new).select(*keys).distinct()
    return table.join(gone, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def overwrite_partitions(new: DataFrame, path: str, keys: list[str]) -> None:
    """On-disk form: only the partitions present in ``new`` are rewritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def cascade_delete_imagery(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Drop images with their features, parcels and versions; log one activity per image."""
    gone = ids.select("imagery_id").distinct()
    out = dict(tables)
    for name in ("imagery", "features", "parcels", "versions"):
        if name in tables:
            out[name] = tables[name].join(gone, "imagery_id", "left_anti")
    out["activities"] = tables["imagery"].join(gone, "imagery_id", "left_semi").select(
        "project_id", F.lit("Drone Imagery Deleted").alias("title"),
        F.concat(F.lit('Image "'), "file_name", F.lit('" was deleted from the project.')).alias("description"), F.lit("imagery").alias("type"),
    )
    return out


def soft_delete(parcels: DataFrame, ids: DataFrame, versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark parcels deleted and append a version with change type rejected for each."""
    marked = parcels.join(ids.select("parcel_id").distinct().withColumn("hit", F.lit(True)), "parcel_id", "left")
    marked = marked.withColumn("status", F.when(F.col("hit"), "Deleted").otherwise(F.col("status")))
    latest = versions.groupBy("parcel_id").agg(F.max("version_number").alias("latest"))
    appended = marked.where("hit").select("parcel_id").join(latest, "parcel_id", "left").select(
        "parcel_id", (F.coalesce("latest", F.lit(0)) + 1).alias("version_number"), F.lit("Rejected").alias("action"), F.lit("rejected").alias("change_type")
    )
    return marked.drop("hit"), appended


def reset_seed(tables: dict[str, DataFrame], seed: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Remove every row of demo projects, then add the seed rows."""
    demo = tables["projects"].where("is_demo").select("project_id")
    if "projects" in seed:
        demo = demo.unionByName(seed["projects"].select("project_id"))
    demo = demo.distinct()
    out = {}
    for name, df in tables.items():
        kept = df.join(demo, "project_id", "left_anti")
        out[name] = kept.unionByName(seed[name], allowMissingColumns=True) if name in seed else kept
    return out


def import_parcels(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Append external parcels with default confidence, status and source; measures are added."""
    from cadastre.operators.measures import measure

    prepared = measure(
        rows.withColumn("confidence", F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.85).otherwise(F.col("confidence")))
        .withColumn("status", F.coalesce("status", F.lit("needs_review")))
        .withColumn("source", F.coalesce("source", F.lit("Manual / Imported")))
    )
    return existing.unionByName(prepared, allowMissingColumns=True)


def upsert(table: DataFrame, updates: DataFrame, keys: list[str], order: list[str], stamp: str) -> DataFrame:
    """Shallow merge: per key and column the last non-null update wins, and ``stamp`` moves along."""
    fields = [c for c in updates.columns if c not in [*keys, *order]]
    rank = F.struct(*order)
    last = updates.groupBy(*keys).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(f"new_{c}") for c in fields], F.max(order[0]).alias("new__stamp")
    )
    out = table.join(last, keys, "left")
    for c in fields:
        out = out.withColumn(c, F.coalesce(f"new_{c}", c) if c in table.columns else F.col(f"new_{c}"))
    out = out.withColumn(stamp, F.coalesce("new__stamp", stamp) if stamp in table.columns else F.col("new__stamp"))
    return out.drop("new__stamp", *[f"new_{c}" for c in fields])


def chunk_sessions(chunks: DataFrame) -> DataFrame:
    """Completeness and size of upload sessions from (session_id, chunk_index, total_chunks, size)."""
    g = chunks.groupBy("session_id").agg(
        F.countDistinct("chunk_index").alias("received"), F.max("total_chunks").alias("total_chunks"), F.max("chunk_index").alias("last_index"),
        F.sum("size").alias("total_size"),
    )
    complete = (F.col("received") == F.col("total_chunks")) & (F.col("last_index") + 1 == F.col("total_chunks"))
    return g.withColumn("is_complete", complete)


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """Complete sessions with their parts concatenated in index order.

    One file is one row by nature, so its parts (not a whole table) meet in one group; sessions with a
    missing part are left out.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "data")))
    g = chunks.groupBy("session_id").agg(parts.alias("parts"), F.max("total_chunks").alias("total_chunks"))
    whole = F.size("parts") == F.col("total_chunks")
    gapless = F.element_at("parts", -1)["chunk_index"] + 1 == F.col("total_chunks")
    data = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
    return g.where(whole & gapless).select("session_id", data.alias("data"))


def detection_run(table: DataFrame, found: DataFrame, project_id: Column, run_id: str) -> tuple[DataFrame, DataFrame]:
    """Stamp detections with project and run, replace the images' rows, report counts per image."""
    stamped = found.withColumn("project_id", project_id).withColumn("run_id", F.lit(run_id))
    merged = replace_rows(table, stamped, ["project_id", "imagery_id"])
    counts = stamped.groupBy("project_id", "imagery_id").agg(F.count("*").alias("written")).join(
        merged.groupBy("project_id", "imagery_id").agg(F.count("*").alias("persisted")), ["project_id", "imagery_id"], "left"
    )
    status = F.when(F.col("written") == F.col("persisted"), "DETECTION COMPLETE").otherwise("DETECTION FAILED")
    return merged, counts.withColumn("processing_status", status)
