"""Detection post-processing: cleaning, merging, suppression, acceptance, tiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cadastre.functions import canonical as C, geom as G, rings as S
from cadastre.functions.pairs import with_shared_area
from cadastre.operators import chains, history as H, joins as J
from cadastre.operators.grid import near, overlapping_boxes
from cadastre.operators.rounds import MANY_PAIRS, components, greedy_dropped, keep_strongest_copies
from cadastre.session import cut_lineage, joined_by_sorting
from cadastre.sources.derived import IMAGE_HEIGHT, IMAGE_WIDTH

# fixed values: simplification tolerance per class
TOLERANCES = {"BUILDING": 1.5, "ROAD": 2.5, "FIELD": 3.0, "VEGETATION": 3.0, "WALL": 2.0, "FENCE": 2.0, "WATER": 2.0}


def remove_noise(features: DataFrame) -> DataFrame:
    """Drop features without points, with too few points or with non-finite coordinates."""
    least = F.when(F.col("is_line"), 2).otherwise(3)
    sound = F.forall("pts", lambda p: p["x"].isNotNull() & p["y"].isNotNull() & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300))
    return features.where(F.col("pts").isNotNull() & (F.size("pts") >= least) & sound)


def remove_tiny(features: DataFrame, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> DataFrame:
    sized = G.once(features, size=F.when(F.col("is_line"), G.planar_length(F.col("pts"))).otherwise(G.planar_area(F.col("pts"))))
    least = F.when(F.col("is_line"), 14.0).otherwise(max(25.0, width * height * 0.00015))
    return sized.where(F.col("size") >= least).drop("size")


def class_tolerance() -> Column:
    t = F.lit(2.0)
    for cls, value in TOLERANCES.items():
        t = F.when(F.col("detection_type") == cls, value).otherwise(t)
    return t


def simplify(features: DataFrame) -> DataFrame:
    """Class-tuned simplification; areas are simplified open and closed again."""
    line = F.col("is_line")
    path = F.when(line, F.col("pts")).otherwise(G.open_ring(F.col("pts")))
    out = features.withColumn("slim", S.simplified(path, class_tolerance()))
    closed = F.when(F.size("slim") >= 3, F.concat("slim", F.slice("slim", 1, 1))).otherwise(F.col("pts"))
    return out.withColumn("pts", F.when(line, F.col("slim")).otherwise(closed)).drop("slim")


def fix_rings(features: DataFrame, eps: float = 0.5) -> DataFrame:
    """Drop repeated vertices, close areas; what is left too short is removed."""

    def fixed(kept):
        return F.when(F.col("is_line"), kept).otherwise(G.close_ring(kept))

    out = G.once(features, pts=G.let(G.drop_repeats(F.col("pts"), eps, per_axis=False), fixed))
    return out.where(F.size("pts") >= F.when(F.col("is_line"), 2).otherwise(4))


# fixed values: end gap and heading limits per line class
MERGE_LIMITS = {"ROAD": (32.0, 25.0), "WALL": (22.0, 25.0), "FENCE": (22.0, 25.0)}


def heading_between(a: Column, b: Column) -> Column:
    """Angle between two headings in degrees, whichever way the lines run."""
    turn = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(turn, 180.0 - turn)


def line_ends(lines: DataFrame) -> DataFrame:
    """Both ends of every line: ``u`` is twice the line's id, plus one at its tail."""
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    heading = F.degrees(F.atan2(last["y"] - first["y"], last["x"] - first["x"]))
    sides = F.array(F.struct(F.lit(0).alias("side"), first.alias("p")), F.struct(F.lit(1).alias("side"), last.alias("p")))
    ends = lines.select("imagery_id", "detection_type", "feature_id", heading.alias("heading"), F.explode(sides).alias("e"))
    return ends.select("imagery_id", "detection_type", "feature_id", "heading", (F.col("feature_id") * 2 + F.col("e.side")).alias("u"), F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"))


def end_joints(ends: DataFrame, reach: float) -> DataFrame:
    """(u, v, weight): ends of two lines of one class that nearly meet, with agreeing headings; ``weight`` is the gap, ``reach`` at most."""
    gap = F.create_map(*[F.lit(v) for k, (g, _) in MERGE_LIMITS.items() for v in (k, g)])
    angle = F.create_map(*[F.lit(v) for k, (_, a) in MERGE_LIMITS.items() for v in (k, a)])
    others = J.as_points_box(ends.withColumnsRenamed({"feature_id": "other_id", "heading": "other_heading", "u": "v"}))
    kind = F.col("detection_type")
    meets = (F.col("feature_id") < F.col("other_id")) & (J.point_distance() <= gap[kind]) & (heading_between(F.col("heading"), F.col("other_heading")) <= angle[kind])
    weight = F.round(J.point_distance(), 6)
    # gaps that round down to the reach belong to it
    found = near(ends, others, ["imagery_id", "detection_type"], meets & (weight <= reach), reach=reach + 1e-6, cell=max(4 * reach, 16.0))
    return found.select("u", "v", weight.alias("weight"))


def line_joints(lines: DataFrame) -> DataFrame:
    """The joints (u, v, weight) that a pass by rising gap makes, each end at most once.

    The first reach follows the densest spot of 64 pixels: about 16 ends are met there.
    """
    ends = cut_lineage(line_ends(lines))
    spot = ends.groupBy("imagery_id", "detection_type", F.floor(F.col("px") / 64), F.floor(F.col("py") / 64)).count()
    densest = spot.agg(F.max("count")).first()[0] or 1
    reach = max(g for g, _ in MERGE_LIMITS.values())
    return chains.matching_in_bands(ends, end_joints, reach, max(1.0, 64.0 * (16 / (3.1416 * densest)) ** 0.5))


def merge_collinear(lines: DataFrame) -> DataFrame:
    """Join lines of one class whose ends nearly meet and whose headings agree.

    Every end joins at most one other, the closest pairs first (``chains.matching``); a closed ring of
    lines opens at its widest joint. The joined lines are put in order by list ranking, so no task holds
    more than the points of one merged line, which are its output row. Headings are those of the lines as
    they come, not of what they were joined to before. Lines of equal points are one line with several ids.

    A merged line runs the way its line of the smallest id does and takes that id; all ids are in
    ``merged_ids``. Its other columns are those of its most confident line (of equal ones the smallest id,
    of lines without a ``confidence`` column the smallest id).
    """
    own = ("imagery_id", "detection_type", "feature_id", "pts")
    rest = [c for c in lines.columns if c not in own]
    rank = F.struct(F.coalesce(F.col("confidence").cast("double"), F.lit(-1.0)) if "confidence" in rest else F.lit(0.0), -F.col("feature_id"))
    facts = F.max_by(F.struct("feature_id", *rest), rank).alias("facts"), F.max(rank).alias("rank")
    alike = lines.groupBy("imagery_id", "detection_type", "pts").agg(F.min("feature_id").alias("feature_id"), F.collect_list("feature_id").alias("ids"), *facts)
    # a checkpointed table keeps the small estimate of its files
    alike = joined_by_sorting(cut_lineage(alike))
    joints = line_joints(alike).withColumns({"a": F.shiftright("u", 1), "b": F.shiftright("v", 1)})
    joints = cut_lineage(joints)
    labels = components(joints.select(F.col("a").alias("u"), F.col("b").alias("v")))
    joints = cut_lineage(chains.open_rings(joints, labels))
    both = joints.select("u", "v").unionByName(joints.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.select(F.shiftright("u", 1).alias("feature_id")).distinct()
    # leaving a line by an end, one enters the line at the joint and leaves it by its other end
    ends = joined.select(F.explode(F.array(F.col("feature_id") * 2, F.col("feature_id") * 2 + 1)).alias("n"))
    ranks = chains.list_ranks(ends.join(both.select(F.col("u").alias("n"), F.col("v").bitwiseXOR(F.lit(1)).alias("nxt")), "n", "left"))
    by_line = ranks.groupBy(F.shiftright("n", 1).alias("feature_id")).agg(
        *[F.max(F.when(F.col("n") % 2 == side, F.struct("last", "steps"))).alias(name) for side, name in ((0, "head"), (1, "tail"))]
    )
    onward = F.col("head.last") < F.col("tail.last")  # the walk from the smaller outer end enters at the head
    placed = by_line.select("feature_id", onward.alias("onward"), F.when(onward, F.col("head")).otherwise(F.col("tail")).alias("start"))
    parts = alike.join(placed, "feature_id")
    step = F.struct(F.col("start.steps").alias("place"), "onward", "pts")
    whole = parts.groupBy("imagery_id", "detection_type", F.col("start.last").alias("start")).agg(
        F.sort_array(F.collect_list(step)).alias("steps"), F.min_by("onward", "feature_id").alias("along"), F.min("feature_id").alias("feature_id"),
        F.flatten(F.collect_list("ids")).alias("ids"), F.max_by("facts", "rank").alias("facts"),
    )
    turned = F.when(F.col("along"), F.col("steps")).otherwise(F.reverse("steps"))
    path = F.flatten(F.transform(turned, lambda s: F.when(s["onward"] == F.col("along"), s["pts"]).otherwise(F.reverse(s["pts"]))))
    merged = whole.withColumn("pts", path).select("imagery_id", "detection_type", "feature_id", "ids", "pts", "facts")
    alone = alike.join(joined, "feature_id", "left_anti").select("imagery_id", "detection_type", "feature_id", "ids", "pts", "facts")
    out = merged.unionByName(alone)
    return out.select("imagery_id", "detection_type", "feature_id", F.sort_array("ids").alias("merged_ids"), "pts", *[F.col("facts")[c].alias(c) for c in rest])


#: points (with itself) that a point may meet in its cell on average before leaders are chosen cell by cell
SPARSE = 2.0


def firsts_apart(points: DataFrame, scope: list[str], key: str, distance: float) -> DataFrame:
    """Keys that a pass by rising ``key`` keeps: a point goes when a kept one is closer than ``distance``.

    Points (px, py; one per place) lie in cells of a diagonal below the distance. A point that comes first
    in all cells within reach is kept, and what it reaches leaves; both are linear in the points, however
    dense. Pairs are built from what is left once cells hold few points on average.
    """
    side = distance / 1.5
    at = [*scope, "kx", "ky"]
    # points without a place or an image are near nothing
    placed = (F.abs("px") < float("inf")) & (F.abs("py") < float("inf"))
    for c in scope:
        placed = placed & F.col(c).isNotNull()
    placed = F.coalesce(placed, F.lit(False))
    chosen_keys = [points.where(~placed).select(key)]
    open_points = cut_lineage(points.where(placed).select(*scope, key, F.col("px").cast("double"), F.col("py").cast("double")))

    def reached(how, targets):
        return near(open_points, J.as_points_box(targets), scope, J.point_distance() < distance, reach=distance, how=how, cell=max(32.0, 4 * distance))

    while True:
        celled = open_points.withColumns({"kx": F.floor(F.col("px") / side), "ky": F.floor(F.col("py") / side)})
        full = celled.groupBy(*at).count().agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
        if full[0] is None or full[0] < 2 or full[1] <= SPARSE * full[0]:
            break
        lead = cut_lineage(celled.groupBy(*at).agg(F.min(F.struct(key, "px", "py")).alias("lead")))
        offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-2, 3) for dy in range(-2, 3)])
        around = lead.select(*at, F.col("lead")[key].alias("k"), F.explode(offsets).alias("o"))
        best = around.groupBy(*scope, (F.col("kx") + F.col("o.dx")).alias("kx"), (F.col("ky") + F.col("o.dy")).alias("ky")).agg(F.min("k").alias("best"))
        chosen = joined_by_sorting(lead).join(best, at).where(F.col("lead")[key] == F.col("best"))
        chosen = cut_lineage(chosen.select(*scope, F.col("lead")[key].alias("other_id"), "lead.px", "lead.py"))
        chosen_keys.append(chosen.select(F.col("other_id").alias(key)))
        open_points = joined_by_sorting(open_points) if full[0] > MANY_PAIRS else open_points
        open_points = cut_lineage(reached("left_anti", chosen.drop("other_id")))
    others = open_points.withColumnRenamed(key, "other_id")
    pairs = reached("inner", others).where(F.col("other_id") < F.col(key))
    dropped = greedy_dropped(pairs.select(F.col("other_id").alias("strong"), F.col(key).alias("weak")))
    kept = joined_by_sorting(open_points).join(dropped.withColumnRenamed("id", key), key, "left_anti").select(key)
    for part in chosen_keys:
        kept = kept.unionByName(part)
    return kept


def _dedupe_points(features: DataFrame, scope: list[str], distance: float) -> DataFrame:
    """Keep the first feature (id order) of every crowd closer than ``distance``; needs px, py."""
    slim = features.select(*scope, "feature_id", "px", "py")
    first = keep_strongest_copies(slim, [*scope, "px", "py"], F.col("feature_id"), "feature_id")
    kept = firsts_apart(first, scope, "feature_id", distance)
    return features.join(kept, "feature_id", "left_semi")


def dedupe_centroids(features: DataFrame, distance: float = 8.0) -> DataFrame:
    c = G.once(features, c=G.mean_point(F.col("pts"))).withColumn("px", F.col("c.x")).withColumn("py", F.col("c.y")).drop("c")
    return _dedupe_points(c, ["imagery_id", "detection_type"], distance).drop("px", "py")


def dedupe_line_middles(lines: DataFrame, distance: float = 20.0) -> DataFrame:
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    m = lines.withColumn("px", (first["x"] + last["x"]) / 2).withColumn("py", (first["y"] + last["y"]) / 2)
    return _dedupe_points(m, ["imagery_id", "detection_type"], distance).drop("px", "py")


def boxes(features: DataFrame) -> DataFrame:
    return G.once(features, bb=G.bbox(F.col("pts")), area=G.planar_area(F.col("pts")))


def suppress(detections: DataFrame, iou: float = 0.35, ignore: DataFrame | None = None) -> DataFrame:
    """Confidence-ordered suppression: box overlap over polygon areas above ``iou`` drops the weaker.

    ``ignore`` rings (imagery_id, ring) remove detections whose centre they contain beforehand.
    """
    d = detections
    if ignore is not None:
        hit = J.points_in_rings(J.feature_points(d, ["imagery_id", "feature_id"]), ignore, how="left_semi").select("feature_id")
        d = d.join(hit, "feature_id", "left_anti")
    slim = boxes(d).select("imagery_id", "feature_id", "confidence", "bb", "area")
    order = F.struct(-F.col("confidence"), F.col("feature_id"))
    # copies are folded only where a box suppresses a copy of itself; boxes without extent meet nothing
    extent = (F.col("bb.xmax") - F.col("bb.xmin")) * (F.col("bb.ymax") - F.col("bb.ymin"))
    alone = F.coalesce(extent <= 0, F.lit(True))
    own_share = extent / F.greatest(F.lit(1.0), 2 * F.col("area") - extent)
    apart = slim.where(alone)
    loose = slim.where(~alone & (own_share <= iou))
    slim = keep_strongest_copies(slim.where(~alone & (own_share > iou)), ["imagery_id", "bb", "area"], order, "feature_id").unionByName(loose)
    before = F.struct(-F.col("a_confidence"), F.col("a_feature_id")) < F.struct(-F.col("b_confidence"), F.col("b_feature_id"))
    pairs = overlapping_boxes(slim, slim, ["imagery_id"], once=before, strict=True, cell=128.0)
    a, b = F.col("a_bb"), F.col("b_bb")
    inter = (F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])) * (F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))
    share = inter / F.greatest(F.lit(1.0), F.col("a_area") + F.col("b_area") - inter)
    dropped = greedy_dropped(pairs.where(share > iou).select(F.col("a_feature_id").alias("strong"), F.col("b_feature_id").alias("weak")))
    kept = slim.join(dropped.withColumnRenamed("id", "feature_id"), "feature_id", "left_anti").select("feature_id")
    return d.join(kept.unionByName(apart.select("feature_id")), "feature_id", "left_semi")


def drop_covered_fields(fields: DataFrame, share: float = 0.35) -> DataFrame:
    """A later field goes when one kept earlier field covers more than ``share`` of it."""
    slim = boxes(fields).select("imagery_id", "feature_id", "pts", "bb", "area")
    # nothing covers a part of a field without area, and it covers no part of another
    flat = slim.where("area is null or area <= 0").select("feature_id")
    slim = keep_strongest_copies(slim.where("area > 0"), ["imagery_id", "pts"], F.col("feature_id"), "feature_id")
    pairs = overlapping_boxes(slim, slim, ["imagery_id"], once=F.col("a_feature_id") < F.col("b_feature_id"), strict=True, cell=128.0)
    pairs = with_shared_area(pairs, "shared", "a_pts", "b_pts")
    bad = pairs.where(F.col("shared") > F.col("b_area") * share)
    dropped = greedy_dropped(bad.select(F.col("a_feature_id").alias("strong"), F.col("b_feature_id").alias("weak")))
    kept = slim.join(dropped.withColumnRenamed("id", "feature_id"), "feature_id", "left_anti").select("feature_id")
    return fields.join(kept.unionByName(flat), "feature_id", "left_semi")


def snap_endpoints(roads: DataFrame, tolerance: float = 20.0) -> DataFrame:
    """Road ends closer than the tolerance collapse onto the earliest one in (road, end) order."""
    n = F.size("pts")
    ends = roads.select(
        "imagery_id", "feature_id", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.element_at("pts", 1).alias("p")), F.struct(F.lit(1).alias("end"), F.element_at("pts", -1).alias("p")))).alias("e")
    ).select("imagery_id", (F.col("feature_id") * 2 + F.col("e.end")).alias("end_id"), F.col("e.p.x").alias("px"), F.col("e.p.y").alias("py"))
    place = ends.groupBy("imagery_id", "px", "py").agg(F.min("end_id").alias("end_id"))
    kept = cut_lineage(joined_by_sorting(place).join(firsts_apart(place, ["imagery_id"], "end_id", tolerance), "end_id", "left_semi"))
    # kept ends are apart from each other, so an end meets few of them
    pairs = near(place, J.as_points_box(kept.withColumnRenamed("end_id", "leader")), ["imagery_id"], (F.col("leader") < F.col("end_id")) & (J.point_distance() < tolerance), reach=tolerance)
    moves = pairs.groupBy("imagery_id", "px", "py").agg(F.min_by(F.struct("qx", "qy"), "leader").alias("to"))
    snapped = ends.join(moves, ["imagery_id", "px", "py"], "left")
    return snapped.select(
        "imagery_id", F.expr("end_id DIV 2").alias("feature_id"), (F.col("end_id") % 2).cast("int").alias("end"),
        F.coalesce("to.qx", "px").alias("x"), F.coalesce("to.qy", "py").alias("y"), F.col("to").isNotNull().alias("moved"),
    )


def validity_reason_pixel(width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> Column:
    """First failing rule of the pixel detector's gate; null when the feature passes. Needs facts."""
    total, longest = float(width * height), float(max(width, height))
    cls, area, length = F.lower("detection_type"), F.col("area"), F.col("length")
    w, h = F.greatest(F.lit(1.0), F.col("bb.xmax") - F.col("bb.xmin")), F.greatest(F.lit(1.0), F.col("bb.ymax") - F.col("bb.ymin"))
    outside = (F.col("bb.xmin") < -5) | (F.col("bb.xmax") > width + 10) | (F.col("bb.ymin") < -5) | (F.col("bb.ymax") > height + 10)
    polygon = (
        F.when(F.size("pts") < 4, "polygon_ring_too_short").when(outside, "out_of_bounds")
        .when((cls == "building") & ((area < 60) | (area > total * 0.35)), "building_area_out_of_bounds")
        .when((cls == "building") & (F.least(w, h) < 6), "building_too_thin")
        .when((cls == "building") & (F.greatest(w, h) / F.least(w, h) > 4.5), "building_aspect_ratio")
        .when((cls == "field") & ((area < total * 0.015) | (area > total * 0.55)), "field_area_out_of_bounds")
        .when((cls == "vegetation") & ((area < 100) | (area > total * 0.25)), "vegetation_area_out_of_bounds")
        .when((cls == "water") & ((area < 80) | (area > total * 0.25)), "water_area_out_of_bounds")
    )
    line = (
        F.when(F.size("pts") < 2, "linestring_too_short").when(outside, "out_of_bounds")
        .when(F.col("longest_edge") > longest * 0.55, "extreme_segment_jump").when(length < 25, "line_length_too_short")
        .when((cls == "road") & (length > longest * 2.2), "road_length_excessive").when((cls != "road") & (length > 150), "extreme_diagonal_artifact")
    )
    return F.when(F.col("is_line"), line).otherwise(polygon)


def validity_reason_model(width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT) -> Column:
    """First failing rule of the model detector's gate as ``category: reason``; water tests are joins."""
    total, longest = float(width * height), float(max(width, height))
    cls, area, length = F.lower("detection_type"), F.col("area"), F.col("length")
    canal = F.lower(F.coalesce("sub_type", F.lit(""))).contains("canal")
    solidity = area / F.greatest(F.lit(1.0), F.col("hull_area"))
    aspect = F.col("rect_long") / F.greatest(F.lit(1.0), F.col("rect_short"))
    outside = (F.col("bb.xmin") < -2) | (F.col("bb.xmax") > width + 5) | (F.col("bb.ymin") < -2) | (F.col("bb.ymax") > height + 5)

    def rule(kind, test, text):
        return ((cls == kind) & test, text)

    rules = [
        (F.size("pts") < 4, "Invalid geometry: polygon_too_few_points"),
        (outside, "Invalid geometry: coordinates_out_of_image_bounds"),
        (F.col("kinks") > 0, "Invalid geometry: self_intersecting_polygon"),
        rule("building", area < 100, "Weak evidence: building_too_small"),
        rule("building", area > total * 0.35, "Excessive size: building_area_out_of_bounds"),
        rule("building", F.col("rect_short") < 4.5, "Invalid geometry: building_dimension_too_thin"),
        rule("building", aspect > 4.8, "Invalid geometry: building_aspect_ratio_too_high"),
        rule("field", area > total * 0.95, "Excessive size: field_area_exceeds_threshold"),
        rule("field", area < max(5000.0, total * 0.008), "Weak evidence: field_area_too_small"),
        rule("field", solidity < 0.65, "Invalid geometry: field_solidity_too_low"),
        rule("field", aspect > 3.8, "Invalid geometry: field_aspect_ratio_too_high"),
        rule("vegetation", area < 100, "Weak evidence: vegetation_too_small"),
        rule("vegetation", area > total * 0.20, "Excessive size: vegetation_area_too_large"),
        rule("vegetation", solidity < 0.35, "Invalid geometry: vegetation_solidity_too_low"),
        rule("water", canal & ((area < 100) | (area > total * 0.08)), "Invalid geometry: water_canal_area_out_of_bounds"),
        rule("water", ~canal & ((area < 150) | (area > total * 0.70)), "Invalid geometry: water_body_area_out_of_bounds"),
    ]
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)

    def at_edge(p):
        return (p["x"] < 12) | (p["x"] > width - 12) | (p["y"] < 12) | (p["y"] > height - 12)

    border = at_edge(a) & at_edge(b) & (length > longest * 0.92)
    lines = [
        (F.size("pts") < 2, "Insufficient continuity: linestring_too_few_points"),
        (outside, "Invalid geometry: coordinates_out_of_image_bounds"),
        (cls.isin("wall", "fence") & (length < 35), "Insufficient continuity: boundary_too_short"),
        (cls.isin("wall", "fence") & (length > 150), "Unsupported line: boundary_too_long_artifact"),
        rule("road", border, "Image-edge artifact: border_to_border"),
        rule("road", length < 30, "Insufficient continuity: road_too_short"),
        (F.col("turn") > 95.0, "Invalid geometry: erratic_turning_angle"),
        (F.col("longest_edge") > longest * 0.40, "Unsupported line: extreme_single_segment_jump"),
    ]

    def first_of(cases):
        out = F.lit(None).cast("string")
        for test, text in reversed(cases):
            out = F.when(test, text).otherwise(out)
        return out

    return F.when(F.col("is_line"), first_of(lines)).otherwise(first_of(rules))


def feature_facts(features: DataFrame) -> DataFrame:
    """Measures the validity rules read."""
    from cadastre.operators.measures import sharpest_turn

    line = F.col("is_line")
    edge = G.edges(F.col("pts"))
    out = G.once(
        features,
        bb=G.bbox(F.col("pts")),
        area=F.when(line, 0.0).otherwise(G.planar_area(F.col("pts"))),
        length=F.when(line, G.planar_length(F.col("pts"))).otherwise(0.0),
        longest_edge=F.array_max(F.transform(edge, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))),
        turn=F.when(line, sharpest_turn(F.col("pts"))).otherwise(0.0),
        kinks=F.when(line, 0).otherwise(G.self_intersections(F.col("pts"))),
    )
    return out.withColumn("o", S.outline_stats(F.col("pts"))).select("*", "o.hull_area", "o.rect_long", "o.rect_short").drop("o")


def false_positive_filter(features: DataFrame, water: DataFrame | None = None, width: float = IMAGE_WIDTH, height: float = IMAGE_HEIGHT, solidity: bool = True) -> DataFrame:
    """Features left after the per-class size rules and the anchoring of walls and fences."""
    total = float(width * height)
    f = G.once(features, area=G.planar_area(F.col("pts")), length=G.planar_length(F.col("pts")))
    kind = F.col("detection_type")
    buildings = f.where((kind == "BUILDING") & (F.col("area") >= 100) & (F.col("area") <= total * 0.35))
    roads = f.where((kind == "ROAD") & (F.col("length") >= 42))
    if water is not None:
        roads = J.roads_outside_water(roads, water).select(*f.columns)
    fields = f.where((kind == "FIELD") & (F.col("area") >= max(5000.0, total * 0.008)) & (F.col("area") <= total * 0.45))
    if solidity:
        fields = fields.where(F.col("area") / F.greatest(F.lit(1.0), S.outline_stats(F.col("pts"))["hull_area"]) >= 0.65)
    longest = F.when(kind == "WALL", 150.0).otherwise(140.0)
    lines = f.where(kind.isin("WALL", "FENCE") & (F.col("length") >= 35) & (F.col("length") <= longest))
    lines = J.anchored(lines, buildings, roads).where("is_anchored").select(*f.columns)
    rest = f.where(kind.isin("VEGETATION", "WATER"))
    out = buildings
    for part in (roads, fields, lines, rest):
        out = out.unionByName(part)
    return out.drop("area", "length")


# fixed values: order in which classes are numbered
CLASS_ORDER = ("building", "road", "field", "wall", "fence", "vegetation", "water")


def accept_or_reject(features: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted features with running ids per image, and rejections with category and threshold."""
    key = C.threshold_key(F.col("detection_type"), F.col("sub_type"))
    d = G.once(features, reason=reason).withColumn("threshold", C.class_threshold(key))
    weak = F.coalesce("confidence", F.lit(0.0)) < F.col("threshold")
    rejected = d.where(F.col("reason").isNotNull() | weak).select(
        F.col("feature_id").alias("item_id"), "imagery_id", F.lower("detection_type").alias("feature_class"),
        F.when(F.col("reason").isNull(), "Weak evidence").otherwise(F.substring_index("reason", ":", 1)).alias("category"),
        F.coalesce(F.concat(F.lit("Rejected Geometry: "), F.trim(F.substring_index("reason", ":", -1))), F.lit("Confidence below class threshold")).alias("reason"),
        F.col("confidence").alias("score"), "threshold",
    )
    good = d.where(F.col("reason").isNull() & ~weak).drop("reason", "threshold")
    rank = H.lookup(F.lower("detection_type"), {c: f"{i}" for i, c in enumerate(CLASS_ORDER)}, F.lit("9"))
    ranked = good.withColumn("class_rank", rank)
    numbered = H.number_rows(ranked, ["imagery_id"], ["class_rank", "feature_id"], F.struct("class_rank", F.floor(F.col("feature_id") / 1e12)))
    name = F.concat(F.lit("det_"), "imagery_id", F.lit("_"), F.lower("detection_type"), F.lit("_"), "number")
    return numbered.withColumn("detection_id", name).drop("class_rank"), rejected


def clean_features(features: DataFrame) -> DataFrame:
    """The whole cleaning chain over all images and classes; the columns are those handed in.

    A line merged from several keeps the columns of its most confident part (``merge_collinear``).
    """
    f = cut_lineage(fix_rings(simplify(remove_tiny(remove_noise(features)))))
    line = F.col("is_line")
    merged = merge_collinear(f.where(line)).select(*f.columns)
    deduped = dedupe_centroids(cut_lineage(merged.unionByName(f.where(~line))))
    facts = G.once(
        deduped, bb=G.bbox(F.col("pts")), area=F.when(line, 0.0).otherwise(G.planar_area(F.col("pts"))), length=F.when(line, G.planar_length(F.col("pts"))).otherwise(0.0),
        longest_edge=F.array_max(F.transform(G.edges(F.col("pts")), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))),
    )
    return facts.where(validity_reason_pixel().isNull()).select(*deduped.columns)


def tile_index(images: DataFrame, tile: int = 1000, overlap: int = 180, least: int = 120) -> DataFrame:
    """Overlapping tiles of every image from fixed steps; slim remainders are skipped."""
    step = tile - overlap
    xs, ys = (F.sequence(F.lit(0), F.col(s) - 1, F.lit(step)) for s in ("width", "height"))
    t = images.withColumn("tile_x", F.explode(xs)).withColumn("tile_y", F.explode(ys))
    t = t.withColumn("tile_w", F.least(F.lit(tile), F.col("width") - F.col("tile_x"))).withColumn("tile_h", F.least(F.lit(tile), F.col("height") - F.col("tile_y")))
    return t.where((F.col("tile_w") >= least) & (F.col("tile_h") >= least))


def tile_index_flush(images: DataFrame, tile: int = 640, overlap: float = 0.20, least: int = 20) -> DataFrame:
    """Tiles of equal size; the last one of a row or column is set flush with the border."""
    step = int(tile * (1 - overlap))

    def starts(size):
        regular = F.sequence(F.lit(0), F.greatest(F.lit(0), size - tile), F.lit(step))
        last = F.element_at(regular, -1)
        return F.when(last + tile < size, F.concat(regular, F.array(size - tile))).otherwise(regular)

    t = images.withColumn("tile_x", F.explode(starts(F.col("width")))).withColumn("tile_y", F.explode(starts(F.col("height"))))
    t = t.withColumn("tile_w", F.least(F.lit(tile), F.col("width") - F.col("tile_x"))).withColumn("tile_h", F.least(F.lit(tile), F.col("height") - F.col("tile_y")))
    return t.where((F.col("tile_w") >= least) & (F.col("tile_h") >= least))


def untile(found: DataFrame, path: str = "pts") -> DataFrame:
    """Tile coordinates (tile_x, tile_y) back to whole image pixels."""
    moved = F.transform(path, lambda p: G.point(G.js_round(p["x"] + F.col("tile_x")), G.js_round(p["y"] + F.col("tile_y"))))
    return found.withColumn(path, moved)


def land_blocks(roads: DataFrame, images: DataFrame) -> DataFrame:
    """Split each image into blocks from its first one or two roads (id order)."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("imagery_id").orderBy("feature_id"))
    top = roads.select("imagery_id", "feature_id", "pts").withColumn("rank", rank).where(F.col("rank") <= 2)
    mean = G.mean_point(F.col("pts"))
    a, b = F.element_at("pts", 1), F.element_at("pts", -1)
    facts = top.select("imagery_id", "rank", F.struct(mean["x"].alias("mx"), mean["y"].alias("my"), F.abs(b["x"] - a["x"]).alias("dx"), F.abs(b["y"] - a["y"]).alias("dy")).alias("r"))
    pair = facts.groupBy("imagery_id").agg(F.max(F.when(F.col("rank") == 1, F.col("r"))).alias("r1"), F.max(F.when(F.col("rank") == 2, F.col("r"))).alias("r2"))
    i = images.join(pair, "imagery_id", "left").withColumn("w", F.col("width").cast("double")).withColumn("h", F.col("height").cast("double"))
    split_y, split_x = F.least("r1.my", "r2.my"), (F.col("r1.mx") + F.col("r2.mx")) / 2

    def block(name, x1, y1, x2, y2):
        return F.struct(F.lit(name).alias("block_id"), x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))

    zero, w, h = F.lit(0.0), F.col("w"), F.col("h")
    r1x, r1y = F.col("r1.mx"), F.col("r1.my")
    blocks = (
        F.when(F.col("r1").isNull(), F.array(block("block_primary", zero, zero, w, h)))
        .when(
            F.col("r2").isNotNull(),
            F.array(
                block("block_north", zero, zero, w, F.greatest(split_y, h * 0.35)),
                block("block_west_central", zero, F.least(split_y, h * 0.3), split_x, h),
                block("block_south_settlement", split_x, F.least(split_y, h * 0.35), w, h),
            ),
        )
        .when(F.col("r1.dx") >= F.col("r1.dy"), F.array(block("block_north", zero, zero, w, r1y), block("block_south", zero, r1y, w, h)))
        .otherwise(F.array(block("block_west", zero, zero, r1x, h), block("block_east", r1x, zero, w, h)))
    )
    return i.select("imagery_id", F.inline(blocks))
