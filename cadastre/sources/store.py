"""Readers: the JSON store, GeoJSON geometries, imagery files and the reference cadastre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastre.functions.canonical import is_tif
from cadastre.functions.geom import js_round

# fixed values: collections of the store document and their scalar fields
COLLECTIONS = {
    "projects": "project_id string, id string, name string, location string, coordinates array<double>, project_type string, status string, is_demo boolean, created_at string",
    "imagery": "imagery_id string, id string, project_id string, file_name string, width int, height int, is_georeferenced boolean, coordinate_mode string, metadata map<string,string>, created_at string",
    "detectedFeatures": "feature_id string, id string, project_id string, imagery_id string, detection_type string, feature_type string, sub_type string, name string, provider string, "
    "confidence double, is_valid boolean, geometry string, evidence array<string>, created_at string",
    "parcels": "parcel_id string, id string, project_id string, imagery_id string, status string, candidate_status string, source string, confidence double, geometry string, "
    "parent_parcel_id string, supporting_features array<string>, topology_issue string, created_at string, updated_at string",
    "verifications": "id string, parcel_id string, reviewer_name string, action string, comments string, timestamp string",
    "processingJobs": "id string, project_id string, job_type string, status string, progress int, logs array<string>, started_at string, completed_at string",
    "parcel_versions": "id string, parcel_id string, project_id string, imagery_id string, version_number int, action string, operation string, change_type string, geometry string, "
    "previous_geometry string, parent_parcel_id string, child_parcel_ids array<string>, edited_by string, comments string, timestamp string",
    "activities": "id string, project_id string, title string, description string, type string, user string, timestamp string",
    "users": "id string, name string, role string, email string",
}


def _struct(ddl: str) -> str:
    return "struct<" + ", ".join(f.strip().replace(" ", ":", 1) for f in _top_level(ddl)) + ">"


def _top_level(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def parse_store(documents: DataFrame) -> dict[str, DataFrame]:
    """Typed tables from JSON document texts (column ``value``); missing collections are empty.

    A store may be one document or many; every document is one row, so a store dumped as JSON lines
    spreads over the cluster. Nested geometry stays JSON text until ``parse_geometry``.
    """
    schema = ", ".join(f"`{name}` array<{_struct(ddl)}>" for name, ddl in COLLECTIONS.items())
    parsed = documents.select(F.from_json("value", schema).alias("doc"))
    out = {}
    for name in COLLECTIONS:
        rows = parsed.select(F.explode(F.col("doc")[name]).alias("r")).select("r.*")
        key = {"projects": "project_id", "imagery": "imagery_id", "detectedFeatures": "feature_id", "parcels": "parcel_id"}.get(name)
        out[name] = rows.withColumn(key, F.coalesce(key, "id")).drop("id") if key else rows
    return out


def read_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Store files: whole JSON documents, one per file."""
    return parse_store(spark.read.text(path, wholetext=True))


def parse_geometry(df: DataFrame, column: str, out: str = "pts") -> DataFrame:
    """GeoJSON Polygon or LineString text to points; nested or flat coordinates, bad ones to an empty array."""
    nested = F.from_json(F.col(column), "coordinates array<array<array<double>>>")["coordinates"]
    flat = F.from_json(F.col(column), "coordinates array<array<double>>")["coordinates"]

    def points(c: Column) -> Column:
        ok = F.size(c) > 0
        sound = F.forall(c, lambda p: (F.size(p) >= 2) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull())
        made = F.transform(c, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
        return F.when(ok & sound, made)

    empty = F.array().cast("array<struct<x:double,y:double>>")
    return df.withColumn(out, F.coalesce(points(F.get(nested, 0)), points(flat), empty))


def register_imagery(uploads: DataFrame) -> DataFrame:
    """Catalogue rows with defaults from upload records (file_name, size_bytes, flags, sizes)."""
    mb = F.col("size_bytes") / 1048576.0
    label = F.when(mb >= 1, F.concat(F.format_string("%.1f", js_round(mb, 1)), F.lit(" MB"))).otherwise(
        F.concat(js_round(F.col("size_bytes") / 1024.0).cast("string"), F.lit(" KB"))
    )
    geo = F.coalesce("flag_georeferenced", is_tif(F.col("file_name")))
    return (
        uploads.withColumn("file_size", label)
        .withColumn("width", F.coalesce("width", F.lit(4000)))
        .withColumn("height", F.coalesce("height", F.lit(3000)))
        .withColumn("is_georeferenced", geo)
        .withColumn("coordinate_mode", F.when(geo, "geographic").otherwise("image-space"))
        .withColumn("resolution", F.lit("2.8 cm/pixel GSD"))
        .withColumn("sensor", F.lit("Drone RGB Sensor"))
        .withColumn("flight_altitude", F.lit("120m AGL"))
        .withColumn("status", F.lit("READY"))
    )


def uploads_from_files(files: DataFrame) -> DataFrame:
    """Upload records from a ``binaryFile`` scan; the content column is not read."""
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("uploaded_at"),
        F.lit(None).cast("boolean").alias("flag_georeferenced"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
    )


def read_imagery_files(spark: SparkSession, path: str) -> DataFrame:
    return register_imagery(uploads_from_files(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)))


CADASTRE_SCHEMA = (
    "plots array<struct<id:string,plotNo:string,surveyNo:string,landType:string,status:string,owner:string,areaAcre:double,areaGuntha:double,areaHectare:double,areaSqM:double,"
    "village:string,coordinates:array<array<double>>>>, roads array<struct<id:string,name:string,type:string,widthM:double,coordinates:array<array<double>>>>, "
    "buildings array<struct<id:string,name:string,coordinates:array<array<double>>>>, pois array<struct<id:string,name:string,category:string,lat:double,lng:double>>, "
    "places array<struct<state:string,district:string,taluka:string,village:string,center:array<double>>>"
)


def read_reference_cadastre(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Plots, roads, buildings, points of interest and places; ``[lat, lng]`` pairs become x = lng, y = lat."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", CADASTRE_SCHEMA).alias("d"))

    def rows(name):
        return doc.select(F.explode(F.col("d")[name]).alias("r")).select("r.*")

    def swapped(df):
        return df.withColumn("pts", F.transform("coordinates", lambda p: F.struct(p[1].alias("x"), p[0].alias("y")))).drop("coordinates")

    return {
        "plots": swapped(rows("plots")), "roads": swapped(rows("roads")), "buildings": swapped(rows("buildings")),
        "pois": rows("pois").withColumnsRenamed({"lng": "x", "lat": "y"}),
        "places": rows("places").withColumn("x", F.get("center", 1)).withColumn("y", F.get("center", 0)).drop("center"),
    }
