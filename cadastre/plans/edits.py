"""Surveyor edits over whole request tables: split, undo, merge and redraw."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cadastre.functions import geom as G
from cadastre.operators import joins as J, measures as M, repair as P
from cadastre.operators.cells import pair_counts
from cadastre.session import cut_lineage


def wet_rings(rings: DataFrame, water: DataFrame, key: str) -> DataFrame:
    """Keys whose ring shares area with a water ring (pixels)."""
    a = G.once(rings.select("imagery_id", key, "ring"), bb=G.bbox(F.col("ring")))
    b = G.once(water.select("imagery_id", "ring"), bb=G.bbox(F.col("ring")))
    return pair_counts(a, b, ["imagery_id"], key, ring="ring", counted=False).select(key).distinct()


def apply_splits(requests: DataFrame, parcels: DataFrame, water: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Children, rejected requests and version rows.

    ``requests``: parcel_id, cut; ``parcels``: parcel_id, project_id, imagery_id, mode, clean, confidence.
    A request is refused when the line does not split the ring, a child is invalid, or a child touches
    water; accepted children are measured, supported by evidence and marked for review.
    """
    cut = cut_lineage(P.split_rings(parcels.join(requests, "parcel_id")))
    halves = cut.where("split_error IS NULL").select(
        "project_id", "imagery_id", "mode", "confidence", F.col("parcel_id").alias("parent_parcel_id"),
        F.inline(F.array(F.struct(F.lit("A").alias("half"), F.col("ring_a").alias("ring")), F.struct(F.lit("B").alias("half"), F.col("ring_b").alias("ring")))),
    ).withColumn("parcel_id", F.concat_ws("-", F.col("parent_parcel_id").cast("string"), "half"))
    judged = cut_lineage(M.validate(M.shape_facts(halves)))
    wet = wet_rings(judged.select("imagery_id", "parcel_id", F.col("clean").alias("ring")), water, "parcel_id").withColumn("wet", F.lit(True))
    judged = judged.join(wet, "parcel_id", "left").withColumn(
        "problem",
        F.when(~F.col("valid"), F.concat(F.lit("Child parcel "), "half", F.lit(" geometry invalid: "), F.array_join("errors", "; ")))
        .when(F.col("wet"), F.concat(F.lit("Invalid split: Child parcel "), "half", F.lit(" overlaps protected water body."))),
    )
    refused = judged.where("problem IS NOT NULL").groupBy("parent_parcel_id").agg(F.min("problem").alias("reason"))
    rejected = refused.select(F.col("parent_parcel_id").alias("parcel_id"), "reason").unionByName(
        cut.where("split_error IS NOT NULL").select("parcel_id", F.col("split_error").alias("reason"))
    )
    kept = judged.join(refused.select("parent_parcel_id"), "parent_parcel_id", "left_anti")
    supported = J.perimeter_support(M.measure(kept.drop("ring").withColumnRenamed("clean", "ring")), features)
    children = supported.select(
        "parcel_id", "parent_parcel_id", "project_id", "imagery_id", "ring", "area_px", "area_sqm", "area_hectares", "area_acres", "supported_pct", "unsupported_pct",
        F.coalesce("confidence", "support_confidence").alias("confidence"), F.lit("needs_review").alias("status"),
        F.concat(F.lit("Split from "), F.col("parent_parcel_id").cast("string")).alias("source"),
    )
    version = [F.lit("Split").alias("action"), F.lit("SPLIT").alias("operation"), F.lit("split").alias("change_type")]
    ids = children.groupBy("parent_parcel_id").agg(F.array_sort(F.collect_list("parcel_id")).alias("child_parcel_ids"))
    parents = ids.select(F.col("parent_parcel_id").cast("string").alias("parcel_id"), F.lit(None).cast("long").alias("parent_parcel_id"), "child_parcel_ids", *version)
    own = children.select("parcel_id", "parent_parcel_id", F.lit(None).cast("array<string>").alias("child_parcel_ids"), *version)
    return children, rejected, parents.unionByName(own)


def undo_splits(requests: DataFrame, parcels: DataFrame, split_versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop the two children of each request's parent and bring the parent back for review.

    ``split_versions``: parent_id, previous_ring. Returns the parcels and the revert versions.
    """
    undone = split_versions.join(requests.select("parent_id").distinct(), "parent_id", "left_semi")
    children = undone.select(F.explode(F.array(F.concat("parent_id", F.lit("-A")), F.concat("parent_id", F.lit("-B")))).alias("parcel_id"))
    gone = children.unionByName(undone.select(F.col("parent_id").alias("parcel_id"))).distinct()
    restored = undone.select(F.col("parent_id").alias("parcel_id"), F.col("previous_ring").alias("ring"), F.lit("needs_review").alias("status"), F.lit("Split Reverted").alias("source"))
    versions = undone.select(F.col("parent_id").alias("parcel_id"), F.lit("Edited").alias("action"), F.lit("REVERT_SPLIT").alias("operation"), F.lit("vertex_edit").alias("change_type"))
    return parcels.join(gone, "parcel_id", "left_anti").unionByName(restored, allowMissingColumns=True), versions


def apply_merges(requests: DataFrame, parcels: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged parcels, ids to delete, and versions. ``requests``: parcel_id, target_id (each parcel once)."""
    target = parcels.select(F.col("parcel_id").alias("target_id"), F.col("clean").alias("ring_b"))
    pairs = requests.join(parcels.withColumnRenamed("clean", "ring_a"), "parcel_id").join(target, "target_id")
    merged = cut_lineage(P.merge_rings(pairs).withColumn("ring", F.col("merged")).drop("merged", "ring_b"))
    done = J.perimeter_support(M.measure(merged), features).select(
        "parcel_id", "target_id", "project_id", "imagery_id", "ring", F.col("ring_a").alias("previous_ring"), "area_px", "area_sqm", "supported_pct", F.lit("accepted").alias("status"),
        F.concat(F.lit("Merged from "), F.col("parcel_id").cast("string"), F.lit(" + "), F.col("target_id").cast("string")).alias("source"),
    )
    versions = done.select("parcel_id", F.lit("Merged").alias("action"), F.lit("merge").alias("change_type")).unionByName(
        done.select(F.col("target_id").alias("parcel_id"), F.lit("Rejected").alias("action"), F.lit("rejected").alias("change_type"))
    )
    return done, done.select(F.col("target_id").alias("parcel_id")), versions


def apply_edits(edits: DataFrame, accepted: DataFrame, water: DataFrame) -> DataFrame:
    """Judge redrawn rings: validity, water, accepted neighbours; ``reasons`` is empty for a saved edit.

    ``edits``: edit_id, parcel_id, imagery_id, mode, ring; ``accepted``: parcel_id, imagery_id, bb.
    """
    judged = cut_lineage(M.validate(M.shape_facts(edits)))
    good_rings = judged.where("kinks = 0")
    wet = wet_rings(good_rings.select("imagery_id", "edit_id", F.col("clean").alias("ring")), water, "edit_id").withColumn("wet", F.lit(True))
    boxes = G.once(judged.select("edit_id", "parcel_id", "imagery_id", "clean"), bb=G.bbox(F.col("clean"))).drop("clean")
    crowd = J.neighbour_conflicts(boxes, accepted)
    out = judged.join(wet, "edit_id", "left").join(crowd, "edit_id", "left")
    extra = F.array_compact(
        F.array(
            F.when(F.col("wet"), F.lit("Prohibited water overlap detected with water body")),
            F.when(F.col("first_neighbour").isNotNull(), F.concat(F.lit("Unacceptable overlap with accepted neighboring parcel "), F.col("first_neighbour").cast("string"))),
        )
    )
    return out.withColumn("reasons", F.concat("errors", extra)).withColumn("saved", F.size("reasons") == 0).drop("wet", "first_neighbour", "conflicts")
