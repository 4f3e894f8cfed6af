"""Project metrics, reports, summaries and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastre.functions import canonical as C, geom as G
from cadastre.operators import history as H

# fixed values: texts of reports
DEFAULT_REVIEWER = "Lead Cadastral Surveyor"
DEFAULT_SOURCE = "AI Detection & Spatial Reasoning"
DISCLAIMER = "AI-assisted parcel boundaries are preliminary and require appropriate human and/or official cadastral verification."

# fixed values: diagnostic categories of rejected detections
REJECTION_CATEGORIES = (
    "Water crossing", "Unsupported line", "Image-edge artifact", "Insufficient continuity", "Invalid geometry",
    "Duplicate geometry", "Weak evidence", "Excessive size", "Disconnected feature",
)


def project_metrics(projects: DataFrame, imagery: DataFrame, features: DataFrame, parcels: DataFrame, critical: DataFrame) -> DataFrame:
    """Counts, verified percent and derived map status per project. ``parcels`` are active ones."""
    status = F.col("status")
    p = parcels.groupBy("project_id").agg(
        F.count("*").alias("preliminary_parcels"),
        F.count_if(status.isin(*C.ACCEPTED)).alias("verified_parcels"),
        F.count_if(status.isin(*C.REVIEW)).alias("needs_review_parcels"),
        F.count_if(status.isin(*C.REJECTED)).alias("rejected_parcels"),
    )
    i = imagery.groupBy("project_id").agg(F.count("*").alias("imagery_count"))
    f = features.groupBy("project_id").agg(F.count("*").alias("detections_count"))
    out = projects
    for part in (i, f, p, critical):
        out = out.join(part, "project_id", "left").fillna(0, [c for c in part.columns if c != "project_id"])
    total, ok = F.col("preliminary_parcels"), F.col("verified_parcels")
    pct = F.when(total > 0, G.js_round(ok / total * 100)).otherwise(F.lit(0)).cast("int")
    final = (
        F.when(total == 0, "PROCESSING").when(F.col("critical_issues") > 0, "REQUIRES ATTENTION").when(ok == total, "VERIFIED")
        .when((F.col("needs_review_parcels") > 0) | (ok > 0), "PARTIALLY VERIFIED").otherwise("READY FOR REVIEW")
    )
    return out.withColumn("verification_pct", pct).withColumn("final_status", final)


def project_listing(metrics: DataFrame) -> DataFrame:
    """Projects with metrics; the derived status replaces the stored one unless completed."""
    return metrics.withColumn("status", F.when(F.col("status") == "Completed", "Completed").otherwise(F.col("final_status")))


def class_breakdown(features: DataFrame, keys: list[str]) -> DataFrame:
    """Detections per class and provider in one pass."""
    t = F.upper("detection_type")
    water = C.canonical_class(F.col("detection_type"), F.col("sub_type")) == "water"
    boundary = F.lit(False)
    for w in C.BOUNDARY_WORDS:
        boundary = boundary | t.contains(w)
    return features.groupBy(*keys).agg(
        F.count("*").alias("detections"),
        F.count_if(F.col("provider") == "ml").alias("ml_features"),
        F.count_if(F.coalesce("provider", F.lit("")) != "ml").alias("cv_features"),
        F.count_if(t.contains("ROAD")).alias("roads"),
        F.count_if(t.contains("BUILDING")).alias("buildings"),
        F.count_if(t.contains("FIELD")).alias("fields"),
        F.count_if(boundary).alias("boundaries"),
        F.count_if(water).alias("water"),
    )


def class_summary(features: DataFrame, keys: list[str]) -> DataFrame:
    """Count and mean confidence per class; water split into bodies and canals."""
    c = F.coalesce("confidence", F.lit(0.8))
    canal = F.lower(F.coalesce("sub_type", F.lit(""))).contains("canal")
    return features.groupBy(*keys, F.lower("detection_type").alias("feature_class")).agg(
        F.count("*").alias("n"),
        G.js_round(F.sum(c) / F.count("*") * 100 + 1e-9).cast("int").alias("mean_confidence_pct"),
        F.count_if((F.col("detection_type") == "WATER") & canal).alias("canals"),
        F.count_if((F.col("detection_type") == "WATER") & ~canal).alias("bodies"),
    )


def rejection_diagnostics(rejections: DataFrame, keys: list[str]) -> DataFrame:
    """Rejections per standard category, zeros included; unknown categories count as weak evidence."""
    known = F.when(F.col("category").isin(*REJECTION_CATEGORIES), F.col("category")).otherwise("Weak evidence")
    counted = rejections.groupBy(*keys, known.alias("category")).agg(F.count("*").alias("n"))
    grid = rejections.select(*keys).distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in REJECTION_CATEGORIES])))
    return grid.join(counted, [*keys, "category"], "left").fillna(0, ["n"])


def top_rejections(rejections: DataFrame, n: int = 50) -> DataFrame:
    w = Window.partitionBy("imagery_id").orderBy("item_id")
    return rejections.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def stage_funnel(features: DataFrame, keys: list[str]) -> DataFrame:
    """Raw, cleaned and accepted detections per class. Flags: passed_clean, passed_final."""
    g = features.groupBy(*keys, F.lower("detection_type").alias("feature_class")).agg(
        F.count("*").alias("raw"), F.count_if("passed_clean").alias("cleaned"), F.count_if("passed_final").alias("accepted")
    )
    return g.withColumn("rejected", F.greatest(F.lit(0), F.col("raw") - F.col("accepted")))


def verified_area(measured: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of accepted square metres; null where the imagery has no georeference."""
    ok = F.col("status").isin(*C.ACCEPTED)
    total = F.when(F.max("is_georeferenced"), F.coalesce(F.sum(F.when(ok, F.col("area_sqm"))), F.lit(0)))
    out = measured.groupBy(*keys).agg(F.count_if(ok).alias("verified_parcels"), total.alias("total_area_sqm"))
    return out.withColumn("total_area_hectares", G.js_round(F.col("total_area_sqm") / 10000.0, 2))


def percent_text(confidence: Column, default: float = 0.85) -> Column:
    value = F.when(F.coalesce(confidence, F.lit(0.0)) == 0, default).otherwise(confidence)
    return F.concat(G.js_round(value * 100).cast("string"), F.lit("%"))


def area_text(thousands: bool = True) -> Column:
    shown = F.format_number(F.col("area_sqm"), 0) if thousands else F.col("area_sqm").cast("string")
    return F.when(F.col("is_georeferenced") & (F.coalesce("area_sqm", F.lit(0)) > 0), F.concat(shown, F.lit(" m²"))).otherwise(C.AREA_UNAVAILABLE)


def report_join(measured: DataFrame, first: DataFrame, projects: DataFrame, imagery: DataFrame) -> DataFrame:
    """Parcel lines of a report: first verification, project and image, with defaults."""
    ok = F.col("status").isin(*C.ACCEPTED)
    v = first.select("parcel_id", F.col("reviewer_name").alias("v_name"), F.col("comments").alias("v_comments"), F.col("ts").alias("v_ts"))
    out = (
        measured.join(v, "parcel_id", "left")
        .join(projects.select("project_id", F.col("name").alias("project_name"), "location"), "project_id", "left")
        .join(imagery.select("imagery_id", F.col("file_name").alias("imagery_file")), "imagery_id", "left")
    )
    return (
        out.withColumn("verification_status", C.verification_label(F.col("status")))
        .withColumn("confidence_formatted", percent_text(F.col("confidence")))
        .withColumn("area", area_text())
        .withColumn("reviewer", F.coalesce("v_name", F.when(ok, DEFAULT_REVIEWER).otherwise("Pending Review")))
        .withColumn("verification_date", F.coalesce("v_ts", "created_at"))
    )


def parcel_report(joined: DataFrame) -> DataFrame:
    """Dossier columns of one parcel each."""
    geo = F.col("is_georeferenced")
    return joined.select(
        "parcel_id", "project_id", "project_name", "location", "imagery_id", "imagery_file", "status", "verification_status",
        F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.85).otherwise(F.col("confidence")).alias("confidence"), "confidence_formatted",
        F.lit(DEFAULT_SOURCE).alias("source"), F.lit("Agricultural / Mixed Cadastre").alias("land_use"),
        F.when(geo, "Geographic (WGS84 EPSG:4326)").otherwise("Image-space coordinates").alias("coordinates_mode"),
        "area", F.when(geo, F.col("area_sqm")).alias("area_sqm"),
        F.when(geo & (F.col("area_sqm") > 0), F.col("area_hectares")).alias("area_hectares"),
        F.coalesce("v_comments", F.lit("Human verified boundary delineation confirmed by surveyor inspection.")).alias("verification_remarks"),
        F.coalesce("v_name", F.lit(DEFAULT_REVIEWER)).alias("reviewer_name"), F.coalesce("v_ts", "created_at").alias("verified_at"),
    )


def in_scope(parcels: DataFrame, scope: str, parcel_id=None) -> DataFrame:
    if parcel_id is not None:
        return parcels.where(F.col("parcel_id") == parcel_id)
    return parcels.where(F.col("status").isin(*C.ACCEPTED)) if scope == "verified" else parcels


CSV_COLUMNS = ["parcel_id", "project_id", "imagery_id", "status", "verification_status", "confidence", "source", "area", "created_at", "verified_at"]


def csv_rows(joined: DataFrame, scope: str = "verified", parcel_id=None) -> DataFrame:
    """The ten text columns of the CSV export."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    return in_scope(joined, scope, parcel_id).select(
        F.col("parcel_id").cast("string").alias("parcel_id"), F.col("project_id").cast("string").alias("project_id"),
        F.coalesce(F.col("imagery_id").cast("string"), F.lit("N/A")).alias("imagery_id"), "status", "verification_status",
        F.col("confidence_formatted").alias("confidence"), F.lit(DEFAULT_SOURCE).alias("source"), area_text(thousands=False).alias("area"),
        F.coalesce(F.date_format("created_at", stamp), F.lit("N/A")).alias("created_at"),
        F.coalesce(F.date_format("v_ts", stamp), F.date_format("created_at", stamp), F.lit("Pending")).alias("verified_at"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV parts, each with the header as its first line (a part may hold the header alone)."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def geojson_geometry(ring: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def geojson_features(joined: DataFrame, scope: str = "verified", parcel_id=None) -> DataFrame:
    """One GeoJSON Feature text per parcel, with its properties as columns."""
    area = F.when(F.col("is_georeferenced") & (F.col("area_sqm") > 0), F.col("area_sqm"))
    props = in_scope(joined, scope, parcel_id).select(
        "project_id", "imagery_id", "ring",
        F.struct(
            "parcel_id", "project_id", "imagery_id", "status", "verification_status",
            G.js_round(F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.85).otherwise(F.col("confidence")), 2).alias("confidence"),
            F.lit(DEFAULT_SOURCE).alias("source"), area.alias("area"), area_text().alias("area_display"), "is_georeferenced", "created_at",
            F.coalesce("v_ts", "created_at").alias("verified_at"),
        ).alias("properties"),
    )
    feature = F.struct(F.lit("Feature").alias("type"), "properties", geojson_geometry(F.col("ring")).alias("geometry"))
    return props.withColumn("feature", F.to_json(feature))


def geojson_header(features: DataFrame, projects: DataFrame, scope: str = "verified") -> DataFrame:
    """Collection members of each project: name, reference system, metadata."""
    per = features.groupBy("project_id").agg(F.count("*").alias("total_parcels"), F.max("properties.is_georeferenced").alias("geo"))
    crs = F.when(F.col("geo"), "urn:ogc:def:crs:OGC:1.3:CRS84").otherwise("urn:ogc:def:crs:OGC:1.0:PixelSpace")
    return per.join(projects.select("project_id", "name"), "project_id", "left").select(
        "project_id", "total_parcels",
        F.concat(F.lit("Cadastre_"), F.regexp_replace("name", "[^a-zA-Z0-9_-]", "_"), F.lit("_Parcels")).alias("name"),
        crs.alias("crs"), F.lit(scope).alias("export_scope"), F.lit(DISCLAIMER).alias("disclaimer"),
    )


def write_geojson(features: DataFrame, header: DataFrame, path: str) -> None:
    """Features as text lines and the collection members beside them, both by project."""
    features.select("project_id", F.col("feature").alias("value")).write.mode("overwrite").partitionBy("project_id").text(path + "/features")
    header.write.mode("overwrite").json(path + "/collections")


def write_layers(features: DataFrame, path: str) -> None:
    """One folder of features per class."""
    layered = features.withColumn("layer", F.lower("detection_type"))
    layered.write.mode("overwrite").partitionBy("layer").json(path)


def export_package(joined: DataFrame, projects: DataFrame, path: str) -> None:
    """Verified GeoJSON, CSV and a text manifest under one folder."""
    f = geojson_features(joined)
    header = geojson_header(f, projects)
    write_geojson(f, header, path + "/geojson")
    write_csv(csv_rows(joined), path + "/csv")
    manifest = header.select(
        F.concat_ws("\n", F.concat(F.lit("Project: "), F.col("name")), F.concat(F.lit("Verified parcels: "), F.col("total_parcels")), F.col("disclaimer")).alias("value"),
        "project_id",
    )
    manifest.write.mode("overwrite").partitionBy("project_id").text(path + "/manifest")


def cascading_facets(places: DataFrame) -> DataFrame:
    """Counts along state > district > taluka > village with the level of each row."""
    levels = ["state", "district", "taluka", "village"]
    return places.rollup(*levels).agg(F.count("*").alias("n"), F.grouping_id().alias("gid")).select(
        *levels, "n", (F.lit(4) - F.length(F.regexp_replace(F.bin("gid"), "0", ""))).alias("level")
    )


def land_use_profile(plots: DataFrame) -> DataFrame:
    """Plots and areas by land type and title status, with all subtotals."""
    acre = F.sum("area_acre")
    return plots.cube("land_type", "title_status").agg(
        F.count("*").alias("plots"), G.js_round(acre + 1e-7, 2).alias("acres"), G.js_round(acre * 40 + 1e-7, 1).alias("gunthas"),
        G.js_round(acre * G.SQM_PER_ACRE / 10000.0, 2).alias("hectares"), G.js_round(acre * G.SQM_PER_ACRE).alias("sqm"),
        F.grouping_id().cast("int").alias("grouping"),
    )


def activity_feed(activities: DataFrame, n: int | None = None) -> DataFrame:
    """Newest activities per project."""
    w = Window.partitionBy("project_id").orderBy(F.desc("ts"), F.desc("activity_id"))
    out = activities.withColumn("rank", F.row_number().over(w)) if n is not None else activities
    return out.where(F.col("rank") <= n) if n is not None else out.orderBy("project_id", F.desc("ts"), F.desc("activity_id"))
