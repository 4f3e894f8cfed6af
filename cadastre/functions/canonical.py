"""Canonical classes, statuses, labels and flags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: class and status vocabulary
BOUNDARY_WORDS = ("WALL", "FENCE", "BOUNDARY", "HEDGE")
WATER_SUBTYPES = ("WATER", "CANAL", "RIVER", "LAKE")
ACCEPTED = ("accepted", "Human Verified", "verified")
REVIEW = ("needs_review", "Needs Review")
REJECTED = ("rejected", "Rejected")
INACTIVE = ("Deleted", "split")

# fixed values: lowest confidence a detection class is accepted with
CLASS_THRESHOLDS = {
    "building": 0.40,
    "road": 0.65,
    "field": 0.55,
    "wall": 0.65,
    "fence": 0.65,
    "vegetation": 0.55,
    "water_body": 0.60,
    "water_canal": 0.70,
}
DEFAULT_THRESHOLD = 0.60

# fixed values: (high, medium) lower bounds
LABEL_BANDS = {"detection": (0.80, 0.60), "parcel": (0.85, 0.70)}

# fixed value: text of a missing area
AREA_UNAVAILABLE = "Area unavailable — imagery is not georeferenced."


def _any_of(text: Column, words) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def canonical_class(detection_type: Column, sub_type: Column) -> Column:
    t = F.upper(F.coalesce(detection_type, F.lit("")))
    s = F.upper(F.coalesce(sub_type, F.lit("")))
    return (
        F.when(t.contains("WATER") | _any_of(s, WATER_SUBTYPES), "water")
        .when(t.contains("ROAD"), "road")
        .when(t.contains("BUILDING"), "building")
        .when(t.contains("FIELD"), "field")
        .when(_any_of(t, BOUNDARY_WORDS), "boundary")
        .when(t.contains("VEGETATION"), "vegetation")
        .otherwise("other")
    )


def canonical_status(status: Column) -> Column:
    return (
        F.when(status.isin(*ACCEPTED), "accepted")
        .when(status.isin(*REVIEW), "review")
        .when(status.isin(*REJECTED), "rejected")
        .otherwise("pending")
    )


def verification_label(status: Column) -> Column:
    return (
        F.when(status.isin(*ACCEPTED), "Human Verified").when(status.isin(*REJECTED), "Rejected").otherwise("Needs Review")
    )


def is_active(status: Column) -> Column:
    return status.isNull() | ~status.isin(*INACTIVE)


def confidence_label(confidence: Column, scheme: str = "detection") -> Column:
    high, medium = LABEL_BANDS[scheme]
    return F.when(confidence >= high, "High").when(confidence >= medium, "Medium").otherwise("Low")


def threshold_key(detection_type: Column, sub_type: Column, name: Column | None = None) -> Column:
    cls = F.lower(detection_type)
    canal = F.lower(F.coalesce(sub_type, F.lit(""))).contains("canal")
    if name is not None:
        canal = canal | F.lower(F.coalesce(name, F.lit(""))).contains("canal")
    return F.when(cls == "water", F.when(canal, "water_canal").otherwise("water_body")).otherwise(cls)


def class_threshold(key: Column) -> Column:
    value = F.lit(DEFAULT_THRESHOLD)
    for cls, low in CLASS_THRESHOLDS.items():
        value = F.when(key == cls, low).otherwise(value)
    return value


def is_tif(file_name: Column) -> Column:
    name = F.lower(F.coalesce(file_name, F.lit("")))
    return name.endswith(".tif") | name.endswith(".tiff")


def georeferenced_for_report(meta_flag: Column, flag: Column, crs: Column, file_name: Column) -> Column:
    """Metadata flag, then column flag, then a CRS that is not pixel space."""
    return (
        F.when(meta_flag.isNotNull(), meta_flag)
        .when(flag.isNotNull(), flag)
        .when(F.coalesce(crs, F.lit("")).isin("", "PixelSpace"), F.length(F.coalesce(crs, F.lit(""))) * is_tif(file_name).cast("int") > 0)
        .otherwise(True)
    )


def georeferenced_for_inference(flag: Column, crs: Column, file_name: Column) -> Column:
    """Column flag, then a TIFF extension, then a CRS text that names a real system."""
    text = F.lower(F.coalesce(crs, F.lit("")))
    real = _any_of(text, ("epsg", "wgs", "utm")) & ~_any_of(text, ("image-space", "pixel", "local", "none"))
    return F.when(flag.isNotNull(), flag).otherwise(is_tif(file_name) | real)


def strip_number_prefix(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "(?i)^Plot\\s*#", ""), "(?i)^Parcel\\s*#", ""))


def clean_search_text(text: Column) -> Column:
    out = F.lower(F.trim(text))
    for word in ("parcel", "plot", "survey"):
        out = F.regexp_replace(out, f"^{word}\\s*#?", "")
    return F.trim(out)
