"""Areas, lengths, repairs and validity of parcel rings, in image space or in degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadastre.functions import geom as G
from cadastre.functions.canonical import is_active
from cadastre.operators.normalise import geo_project

EPS = 1e-7
# fixed values: size and shape limits per coordinate mode
SMALL = {"image": 600.0, "geographic": 50.0}
VALID_COMPACTNESS = 0.05
SLIVER_SMALL = {"image": 800.0, "geographic": 60.0}
SLIVER_LARGE = {"image": 3000.0, "geographic": 300.0}
SLIVER_COMPACTNESS = 0.08


def by_mode(limits: dict[str, float]) -> Column:
    return F.when(F.col("mode") == "image", limits["image"]).otherwise(limits["geographic"])


def looks_like_image_space(r: Column) -> Column:
    first = F.element_at(r, 1)
    return (F.abs(first["x"]) > 180) | (F.abs(first["y"]) > 90)


def working_geometry(parcels: DataFrame, imagery: DataFrame) -> DataFrame:
    """Choose the working ring: degrees for georeferenced images, pixels otherwise.

    The imagery row decides the mode. ``plane`` is the ring in a plane where shoelace area is the
    reported area: pixels, or equal-area metres.
    """
    out = geo_project(parcels, imagery.drop("is_georeferenced"), "ring")
    geo = F.col("is_georeferenced")
    out = out.withColumn("mode", F.when(geo, "geographic").otherwise("image"))
    return G.once(out, ring=F.when(geo, F.col("geo_ring")).otherwise(F.col("ring"))).drop("geo_ring")


def plane_ring(r: Column) -> Column:
    return F.when(F.col("mode") == "image", r).otherwise(G.equal_area_ring(r))


def ring_area(r: Column) -> Column:
    return F.when(F.col("mode") == "image", G.planar_area(r)).otherwise(G.geodesic_area(r))


def ring_length(r: Column) -> Column:
    return F.when(F.col("mode") == "image", G.planar_length(r)).otherwise(G.geodesic_length(r))


def measure(parcels: DataFrame) -> DataFrame:
    """Pixel area in image space; square metres, hectares and acres in degrees."""
    area = F.col("measured_area")
    image = F.col("mode") == "image"
    return (
        parcels.withColumn("measured_area", F.when(F.size("ring") < 3, 0.0).otherwise(ring_area(F.col("ring"))))
        .withColumn("area_px", F.when(image, G.js_round(area)).otherwise(F.lit(0).cast("long")))
        .withColumn("area_sqm", F.when(image, F.lit(0).cast("long")).otherwise(G.js_round(area)))
        .withColumn("area_hectares", F.when(image, 0.0).otherwise(G.js_round(area / G.SQM_PER_HECTARE, 2)))
        .withColumn("area_acres", F.when(image, 0.0).otherwise(G.js_round(area / G.SQM_PER_ACRE, 2)))
        .drop("measured_area")
    )


def repair_rings(parcels: DataFrame) -> DataFrame:
    """Drop consecutive duplicates, close the ring, count both repairs; ``clean`` is the result."""

    def repaired(kept):
        was_open = ~G.is_closed(kept, EPS)
        return F.struct(
            (F.size("ring") - F.size(kept)).alias("removed_vertices"),
            was_open.alias("was_open"),
            F.when(was_open, F.concat(kept, F.array(F.element_at(kept, 1)))).otherwise(kept).alias("clean"),
        )

    return parcels.select("*", F.inline(F.array(G.let(G.drop_repeats(F.col("ring"), EPS), repaired))))


def shape_facts(parcels: DataFrame) -> DataFrame:
    """Every measure the validity and sliver rules need, computed once per parcel."""
    r, clean = F.col("ring"), F.col("clean")
    out = G.once(
        repair_rings(parcels),
        vertex_count=F.size(clean),
        finite=F.forall(r, lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300)),
        kinks=G.self_intersections(clean),
        clean_area=ring_area(clean),
        clean_length=ring_length(clean),
        raw_area=ring_area(r),
        raw_length=ring_length(r),
    )
    return out.withColumn("clean_compactness", G.compactness(F.col("clean_area"), F.col("clean_length"))).withColumn(
        "raw_compactness", G.compactness(F.col("raw_area"), F.col("raw_length"))
    )


def _messages(*cases: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, text) for test, text in cases]))


def validate(facts: DataFrame) -> DataFrame:
    """``valid``, ``errors`` and ``warnings`` per parcel from its shape facts."""
    image = F.col("mode") == "image"
    area, unit = F.col("clean_area"), F.when(F.col("mode") == "image", "px²").otherwise("m²")
    kink_text = F.when(image, F.format_string("Polygon boundary contains %d self-intersecting segments.", "kinks")).otherwise(
        F.format_string("Polygon self-intersects (contains %d intersection kinks).", "kinks")
    )
    small_text = F.concat(
        F.when(image, "Polygon is extremely small (").otherwise("Polygon area is very small ("),
        G.js_round(area).cast("string"), F.lit(" "), unit, F.lit(")."),
    )
    structural = (
        F.when(F.size("ring") < 3, "Polygon must contain at least 3 distinct vertices")
        .when(~F.col("finite"), "Polygon contains invalid or non-numeric coordinates")
    )
    too_few = F.col("vertex_count") < 4
    sound = structural.isNull() & ~too_few
    small = by_mode(SMALL)
    errors = _messages(
        (structural.isNotNull(), structural),
        (structural.isNull() & too_few, F.lit("Polygon ring has fewer than 3 unique vertices")),
        (sound & (F.col("kinks") > 0), kink_text),
        (sound & (area <= 0.0001), F.lit("Polygon area must be greater than zero.")),
    )
    warnings = _messages(
        (structural.isNull() & (F.col("removed_vertices") > 0), F.format_string("Removed %d duplicate consecutive vertices.", "removed_vertices")),
        (structural.isNull() & F.col("was_open"), F.lit("Unclosed polygon ring was automatically closed.")),
        (sound & (area > 0.0001) & (area < small), small_text),
        (sound & (area >= small) & (F.col("clean_compactness") < VALID_COMPACTNESS), F.lit("High perimeter-to-area ratio (elongated sliver).")),
    )
    return G.once(facts, errors=errors, warnings=warnings).withColumn("valid", F.size("errors") == 0)


def is_sliver() -> Column:
    """Sliver rule on validated facts."""
    area = F.col("raw_area")
    thin = (F.col("raw_compactness") < SLIVER_COMPACTNESS) & (area < by_mode(SLIVER_LARGE))
    return F.col("valid") & ((area < by_mode(SLIVER_SMALL)) | thin)


def sliver_report(validated: DataFrame) -> DataFrame:
    area = F.col("raw_area")
    rounded = G.js_round(area).cast("string")
    tiny = F.when(F.col("mode") == "image", F.concat(F.lit("Tiny sliver polygon ("), rounded, F.lit(" px²)"))).otherwise(
        F.concat(F.lit("Tiny sliver polygon ("), rounded, F.lit(" m² < 60 m²)"))
    )
    return validated.where(is_sliver()).select(
        "parcel_id", "project_id", "imagery_id", "mode",
        G.js_round(area).alias("area"),
        G.js_round(F.col("raw_length")).alias("perimeter"),
        F.when(area < by_mode(SLIVER_SMALL), tiny).otherwise("High perimeter-to-area sliver ratio").alias("reason"),
        F.lit("High").alias("severity"),
    )


def confidence_bands(parcels: DataFrame, keys: list[str]) -> DataFrame:
    c = F.coalesce("confidence", F.lit(0.80))
    return parcels.groupBy(*keys).agg(
        F.count_if(c >= 0.80).alias("high"),
        F.count_if((c >= 0.60) & (c < 0.80)).alias("medium"),
        F.count_if(c < 0.60).alias("low"),
    )


def active_working(parcels: DataFrame, imagery: DataFrame) -> DataFrame:
    return working_geometry(parcels.where(is_active(F.col("status"))), imagery)


def jagged_score(df: DataFrame, path: str = "ring", max_edge: float = 60.0, min_cross: float = 10.0) -> DataFrame:
    """Direction reversals between successive pronounced turns of a closed ring; three make it jagged.

    Turns on long edges or with a small cross product are passed over, not counted as straight.
    """
    ring_edges = G.edges(F.col(path))

    def turn(a, b):
        ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
        cross = ax * by - ay * bx
        counted = (F.hypot(ax, ay) < max_edge) & (F.hypot(bx, by) < max_edge) & (F.abs(cross) > min_cross)
        return F.when(counted, F.signum(cross))

    def turns(e):
        n = F.size(e)
        before = F.concat(F.slice(e, n, 1), F.slice(e, 1, F.greatest(n - 1, F.lit(0))))
        return F.filter(F.zip_with(before, e, turn), lambda t: t.isNotNull())

    def reversals(t):
        m = F.greatest(F.size(t) - 1, F.lit(0))
        return F.size(F.filter(F.zip_with(F.slice(t, 1, m), F.slice(t, 2, m), lambda a, b: a != b), lambda f: f))

    score = F.when(F.size(F.col(path)) < 5, 0).otherwise(G.let(G.let(ring_edges, turns), reversals))
    return df.withColumn("jagged_score", score).withColumn("is_jagged", F.col("jagged_score") >= 3)


def axis_aligned_box(r: Column) -> Column:
    """Five-point ring whose first two edges run along the axes; tolerances follow the mode."""
    geo = ~looks_like_image_space(r)
    eps = F.when(geo, 1e-6).otherwise(1.0)
    least = F.when(geo, 1e-5).otherwise(5.0)
    p, q, s = (F.element_at(r, i) for i in (1, 2, 3))

    def along(a, b, flat, run):
        return (F.abs(a[flat] - b[flat]) <= eps) & (F.abs(a[run] - b[run]) > least)

    return (F.size(r) == 5) & (
        (along(p, q, "y", "x") & along(q, s, "x", "y")) | (along(p, q, "x", "y") & along(q, s, "y", "x"))
    )


def sharpest_turn(path: Column, min_edge: float = 2.0) -> Column:
    """Largest heading change along a line, in degrees; tiny edges do not count."""

    def bend(a, b):
        ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
        la, lb = F.hypot(ax, ay), F.hypot(bx, by)
        cos = (ax * bx + ay * by) / F.when((la > min_edge) & (lb > min_edge), la * lb)
        return F.coalesce(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))), F.lit(0.0))

    def bends(e):
        n = F.greatest(F.size(e) - 1, F.lit(0))
        return F.array_max(F.zip_with(F.slice(e, 1, n), F.slice(e, 2, n), bend))

    return F.coalesce(G.let(G.edges(path), bends), F.lit(0.0))


MAX_TURN_DEGREES = 95.0


def erratic_lines(features: DataFrame) -> DataFrame:
    turns = G.once(features.where(F.col("is_line")), turn=sharpest_turn(F.col("pts")))
    return turns.where(F.col("turn") > MAX_TURN_DEGREES)
