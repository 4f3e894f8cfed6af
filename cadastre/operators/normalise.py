"""Scope filters, canonical records and threshold splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastre.functions import canonical as C
from cadastre.functions.geom import image_to_geo, js_round


def scope_features(features: DataFrame, project_id, imagery_id=None) -> DataFrame:
    out = features.where(F.col("project_id") == project_id)
    return out if imagery_id is None else out.where(F.col("imagery_id") == imagery_id)


def scope_parcels(parcels: DataFrame, imagery: DataFrame) -> DataFrame:
    """Non-deleted parcels with the image they are shown under.

    A parcel without an image belongs to its project's image only when the project has at most one.
    """
    images = imagery.groupBy("project_id").agg(F.count("*").alias("images"), F.min("imagery_id").alias("only_image"))
    live = parcels.where(F.col("status").isNull() | (F.col("status") != "Deleted"))
    return (
        live.join(images, "project_id", "left")
        .withColumn("images", F.coalesce("images", F.lit(0)))
        .where(F.col("imagery_id").isNotNull() | (F.col("images") <= 1))
        .withColumn("scope_imagery_id", F.coalesce("imagery_id", "only_image"))
        .drop("only_image")
    )


def active_parcels(parcels: DataFrame) -> DataFrame:
    return parcels.where(C.is_active(F.col("status")))


def valid_features(features: DataFrame) -> DataFrame:
    return features.where(F.coalesce(F.col("is_valid"), F.lit(True)))


def with_class(features: DataFrame) -> DataFrame:
    return features.withColumn("feature_class", C.canonical_class(F.col("detection_type"), F.col("sub_type")))


def split_by_threshold(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections at or above their class threshold, and the rejections of the rest."""
    key = C.threshold_key(F.col("detection_type"), F.col("sub_type"))
    scored = features.withColumn("threshold", C.class_threshold(key))
    weak = F.coalesce(F.col("confidence"), F.lit(0.0)) < F.col("threshold")
    rejected = scored.where(weak).select(
        F.col("feature_id").alias("item_id"),
        "imagery_id",
        F.lower("detection_type").alias("feature_class"),
        F.lit("Weak evidence").alias("category"),
        F.concat(F.lit("Confidence below class threshold ("), F.col("confidence"), F.lit(" < "), F.col("threshold"), F.lit(")")).alias("reason"),
        F.col("confidence").alias("score"),
        "threshold",
    )
    return scored.where(~weak).drop("threshold"), rejected


# fixed values: drawing order of map layers
LAYER_RANKS = (("water", 1), ("field", 2), ("veg", 3), ("build", 4), ("wall", 5), ("fence", 6), ("road", 7))


def layer_filter(features: DataFrame, classes: list[str] | None = None, band: str | None = None) -> DataFrame:
    """Visible features of a map layer with their drawing rank (water lowest, roads on top)."""
    text = F.lower("detection_type")
    rank = F.lit(3)
    for word, r in reversed(LAYER_RANKS):
        rank = F.when(text.contains(word), r).otherwise(rank)
    out = features.withColumn("layer_rank", rank)
    if classes:
        out = out.where(text.isin(*[c.lower() for c in classes]))
    if band:
        out = out.where(C.confidence_label(F.col("confidence")) == band)
    return out


QUEUE_FILTERS = {
    "pending": lambda: C.canonical_status(F.col("status")) == "pending",
    "needs_review": lambda: F.col("status").isin(*C.REVIEW),
    "accepted": lambda: F.col("status").isin("accepted", "Human Verified"),
    "rejected": lambda: F.col("status").isin(*C.REJECTED),
    "low_conf": lambda: F.coalesce(F.col("confidence"), F.lit(0.0)) < 0.60,
}


def verification_queue(parcels: DataFrame, status_filter: str | None = None, text: str = "") -> DataFrame:
    out = parcels
    if status_filter:
        out = out.where(QUEUE_FILTERS[status_filter]())
    if text:
        out = out.where(F.lower(F.col("parcel_id").cast("string")).contains(text.lower()))
    return out


def project_filter(projects: DataFrame, text: str) -> DataFrame:
    needle = text.lower().strip()
    if not needle:
        return projects
    fields = ("name", "location", "project_id")
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).contains(needle)
    return projects.where(hit)


def parse_coordinates(df: DataFrame, text: str) -> DataFrame:
    """``lat, lng`` texts to numbers; anything else, or out of range, gives nulls."""
    pattern = r"^([+-]?\d+(?:\.\d+)?)[,\s]+([+-]?\d+(?:\.\d+)?)$"
    trimmed = F.trim(F.col(text))
    lat = F.expr("try_cast(lat_text AS double)")
    lng = F.expr("try_cast(lng_text AS double)")
    parsed = (
        df.withColumn("lat_text", F.regexp_extract(trimmed, pattern, 1))
        .withColumn("lng_text", F.regexp_extract(trimmed, pattern, 2))
        .withColumn("lat", lat)
        .withColumn("lng", lng)
    )
    ok = F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)
    return parsed.withColumn("lat", F.when(ok, F.col("lat"))).withColumn("lng", F.when(ok, F.col("lng"))).drop("lat_text", "lng_text")


def geo_project(shapes: DataFrame, imagery: DataFrame, path: str = "pts") -> DataFrame:
    """Pixel paths to lng/lat through the image's centre and size (image rows are a dimension)."""
    dims = imagery.select("imagery_id", "width", "height", "lat", "lng")
    return (
        shapes.join(dims, "imagery_id")
        .withColumn("geo_" + path, image_to_geo(F.col(path), F.col("width"), F.col("height"), F.col("lat"), F.col("lng")))
        .drop("width", "height", "lat", "lng")
    )


def canonical_parcel(raw: DataFrame, plots: DataFrame | None = None) -> DataFrame:
    """One record shape from raw parcel rows.

    ``raw``: parcel_ref, survey_no, village, location, district, state, lat, lng, boundary, area_acres,
    land_type, status, confidence, is_demo. ``boundary`` is ``array<struct<x,y>>`` in degrees;
    ``plots`` (plot_no, boundary) fills missing ones.
    """
    number = C.strip_number_prefix(F.col("parcel_ref").cast("string"))
    survey = F.trim(F.regexp_replace(F.col("survey_no"), "(?i)^Survey\\s*", ""))
    swapped = (F.col("lat") > 60) & (F.col("lng") < 30)
    out = (
        raw.withColumn("parcel_number", F.coalesce(F.when(number != "", number), F.lit("Not available")))
        .withColumn("survey_number", F.coalesce(F.when(survey != "", survey), F.lit("Not available")))
        .withColumn("village", F.coalesce("village", "location", F.lit("Cadastral Block")))
        .withColumn("district", F.coalesce("district", F.lit("Survey Directorate")))
        .withColumn("state", F.coalesce("state", F.lit("Survey Division")))
        .withColumn("latitude", F.when(swapped, F.col("lng")).otherwise(F.col("lat")))
        .withColumn("longitude", F.when(swapped, F.col("lat")).otherwise(F.col("lng")))
        .withColumn("area", F.coalesce(F.concat(F.col("area_acres").cast("string"), F.lit(" acres")), F.lit("Not available")))
        .withColumn("land_use", F.coalesce("land_type", F.lit("Agricultural")))
        .withColumn("status", F.coalesce("status", F.lit("Active")))
        .withColumn(
            "confidence_text",
            F.when(F.coalesce("confidence", F.lit(0.0)) == 0, "95%").otherwise(
                F.concat(js_round(F.col("confidence") * 100).cast("string"), F.lit("%"))
            ),
        )
        .withColumn("source", F.when(F.coalesce("is_demo", F.lit(False)), "Demo Dataset").otherwise("Verified Cadastral Record"))
    )
    if plots is not None:
        known = plots.select(F.upper("plot_no").alias("plot_key"), F.col("boundary").alias("plot_boundary"))
        out = (
            out.withColumn("plot_key", F.upper("parcel_number"))
            .join(known, "plot_key", "left")
            .withColumn("boundary", F.when(F.coalesce(F.size("boundary"), F.lit(0)) >= 3, F.col("boundary")).otherwise(F.col("plot_boundary")))
            .drop("plot_key", "plot_boundary")
        )
    first, last = F.element_at("boundary", 1), F.element_at("boundary", -1)
    apart = (first["x"] != last["x"]) | (first["y"] != last["y"])
    return out.withColumn(
        "boundary",
        F.when(F.size("boundary") > 0, F.when(apart, F.concat("boundary", F.array(first))).otherwise(F.col("boundary"))),
    )


def enrich_parcels(parcels: DataFrame, versions: DataFrame) -> DataFrame:
    """Latest version, source lineage, support and confidence defaults.

    ``parcels`` may carry merged_from (array), split_from, is_human_edited, supported_pct; ``versions``
    needs parcel_id, version_number, action.
    """
    latest = versions.groupBy("parcel_id").agg(
        F.max("version_number").alias("latest_version"), F.max(F.col("action") == "Edited").alias("was_edited")
    )
    source, parent = F.col("source"), F.col("parent_parcel_id").cast("string")
    edited = F.coalesce("is_human_edited", F.lit(False)) | F.coalesce("was_edited", F.lit(False))
    support = F.coalesce("supported_pct", F.lit(48))
    return (
        parcels.join(latest, "parcel_id", "left")
        .withColumn("version", F.coalesce("latest_version", F.lit(1)))
        .withColumn(
            "source",
            F.when(source.startswith("Merged from") | source.startswith("Split from"), source)
            .when(F.size("merged_from") > 0, F.concat(F.lit("Merged from "), F.array_join("merged_from", " + ")))
            .when(F.col("split_from").isNotNull(), F.concat(F.lit("Split from "), F.col("split_from").cast("string")))
            .when(parent.isNotNull() & (parent != F.col("parcel_id").cast("string")), F.concat(F.lit("Split from "), parent))
            .when(edited, "Human Edited")
            .when(source.isNull() | source.isin("spatial_reasoning", "Human Verification Split"), "AI Generated")
            .otherwise(source),
        )
        .withColumn("supporting_features", F.filter("supporting_features", lambda f: ~F.lower(f).contains("merged with")))
        .withColumn("supported_pct", support)
        .withColumn("unsupported_pct", 100 - F.col("supported_pct"))
        .withColumn("confidence", F.coalesce("confidence", js_round(0.5 + 0.5 * (F.col("supported_pct") / 100.0), 2)))
        .drop("latest_version", "was_edited")
    )
