"""Version numbers, timelines and current state from append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastre.session import cut_lineage

# fixed values: change type to standard action name
ACTION_NAMES = {
    "generated": "Generated",
    "vertex_edit": "Edited",
    "Edited": "Edited",
    "split": "Split",
    "Split": "Split",
    "merge": "Merged",
    "Merged": "Merged",
    "accepted": "Accepted",
    "Accepted": "Accepted",
    "rejected": "Rejected",
    "Rejected": "Rejected",
    "needs_review": "Needs Review",
    "review": "Needs Review",
}
CHANGE_TYPES = {"Accepted": "accepted", "Rejected": "rejected", "Needs Review": "needs_review", "Edited": "vertex_edit"}
STATUS_AFTER = {"Accepted": "accepted", "Edited": "accepted", "Rejected": "rejected", "Needs Review": "needs_review"}


def lookup(value: Column, mapping: dict[str, str], default: Column) -> Column:
    out = default
    for key, name in mapping.items():
        out = F.when(value == key, name).otherwise(out)
    return out


def number_rows(df: DataFrame, keys: list[str], order: list[str], bucket: Column, carry: list[str] = ()) -> DataFrame:
    """Gap-free ``number`` per key in the given order, plus ``prev_*`` of the carried columns.

    ``bucket`` must not decrease along the order. Rows are numbered inside (key, bucket) and shifted
    by the counts of earlier buckets, so one very large key is spread over its buckets instead of
    being sorted in one task; only one row per bucket crosses the per-key window.
    """
    b = df.withColumn("bucket__", bucket)
    within = Window.partitionBy(*keys, "bucket__").orderBy(*order)
    tail = F.max_by(F.struct(*carry), F.struct(*order)) if carry else F.lit(None)
    sizes = b.groupBy(*keys, "bucket__").agg(F.count("*").alias("size__"), tail.alias("tail__"))
    before = Window.partitionBy(*keys).orderBy("bucket__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"k__{i}") for i, k in enumerate(keys)],
        F.col("bucket__").alias("b__"),
        F.coalesce(F.sum("size__").over(before), F.lit(0)).alias("offset__"),
        F.last("tail__").over(before).alias("tail__"),
    )
    on = F.col("bucket__").eqNullSafe(F.col("b__"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"k__{i}"))
    out = b.withColumn("number", F.row_number().over(within))
    for c in carry:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(within))
    out = out.withColumn("first__", F.col("number") == 1).join(offsets, on, "left")
    for c in carry:
        out = out.withColumn(f"prev_{c}", F.when(F.col("first__"), F.col(f"tail__.{c}")).otherwise(F.col(f"prev_{c}")))
    out = out.withColumn("number", (F.col("number") + F.col("offset__")).cast("long"))
    return out.drop("bucket__", "b__", "offset__", "tail__", "first__", *[f"k__{i}" for i in range(len(keys))])


def number_events(events: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Append review events as parcel versions: next number, standard names, previous value."""
    numbered = number_rows(events, ["parcel_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), list(carry))
    change = lookup(F.col("action"), CHANGE_TYPES, F.lower(F.regexp_replace("action", "\\s+", "_")))
    return (
        numbered.withColumnRenamed("number", "version_number")
        .withColumn("operation", F.upper("action"))
        .withColumn("change_type", change)
    )


def standard_action(action: Column, change_type: Column) -> Column:
    return F.coalesce(action, lookup(change_type, ACTION_NAMES, F.lit("Edited")))


def version_history(versions: DataFrame) -> DataFrame:
    """Recency 1 is the newest version of a parcel."""
    top = versions.groupBy("parcel_id").agg(F.max("version_number").alias("latest"))
    return versions.join(top, "parcel_id").withColumn("recency", F.col("latest") - F.col("version_number") + 1)


def timeline(parcels: DataFrame, versions: DataFrame, verifications: DataFrame) -> DataFrame:
    """Versions of the parcel and of its parent, and verifications, in one schema."""
    own = versions.select("parcel_id", F.lit("version").alias("entry_type"), F.col("event_id").alias("entry_id"), "version_number", "action", "ts")
    parents = parcels.where(F.col("parent_parcel_id").isNotNull()).select("parcel_id", F.col("parent_parcel_id").alias("source_id"))
    inherited = (
        versions.withColumnRenamed("parcel_id", "source_id")
        .join(parents, "source_id")
        .select("parcel_id", F.lit("version").alias("entry_type"), F.col("event_id").alias("entry_id"), "version_number", "action", "ts")
    )
    reviews = verifications.select(
        "parcel_id", F.lit("verification").alias("entry_type"), F.col("event_id").alias("entry_id"), F.lit(None).cast("long").alias("version_number"), "action", "ts"
    )
    return own.unionByName(inherited).unionByName(reviews)


def current_state(parcels: DataFrame, events: DataFrame) -> DataFrame:
    """Fold review events: the latest by (ts, id) decides the status, partial aggregation only."""
    latest = events.groupBy("parcel_id").agg(
        F.max_by(F.struct("action", "value", "ts", "event_id"), F.struct("ts", "event_id")).alias("last"), F.count("*").alias("review_count")
    )
    return (
        parcels.join(latest, "parcel_id", "left")
        .withColumn("current_status", F.coalesce(lookup(F.col("last.action"), STATUS_AFTER, F.lit(None)), F.col("status")))
        .withColumn("reviewed_at", F.col("last.ts"))
        .withColumn("review_count", F.coalesce("review_count", F.lit(0)))
        .withColumn("last_event_id", F.col("last.event_id"))
        .drop("last")
    )


def first_verification(events: DataFrame) -> DataFrame:
    """Earliest inserted verification per parcel."""
    return events.groupBy("parcel_id").agg(F.min_by(F.struct("event_id", "action", "ts"), "event_id").alias("v")).select("parcel_id", "v.*")


def lineage(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Root and depth of every parcel from (parcel_id, parent_parcel_id) rows.

    Pointer doubling: each round follows the pointer of the pointer, so a chain of n splits needs
    log2(n) rounds of one equi-join. Raises if pointers form a cycle.
    """
    state = edges.select("parcel_id", F.coalesce("parent_parcel_id", "parcel_id").alias("root_id"), F.col("parent_parcel_id").isNotNull().cast("long").alias("depth"))
    for _ in range(max_rounds):
        up = state.select(F.col("parcel_id").alias("via"), F.col("root_id").alias("up_id"), F.col("depth").alias("up_depth"))
        state = cut_lineage(
            state.join(up, F.col("root_id") == F.col("via"), "left").select(
                "parcel_id",
                F.coalesce("up_id", "root_id").alias("root_id"),
                F.when(F.col("up_id") != F.col("root_id"), F.col("depth") + F.col("up_depth")).otherwise(F.col("depth")).alias("depth"),
                (F.col("up_id") != F.col("root_id")).alias("moved"),
            )
        )
        if state.where("moved").isEmpty():
            with_parent = edges.where(F.col("parent_parcel_id").isNotNull()).select(F.col("parcel_id").alias("root_id"))
            if not state.join(with_parent, "root_id", "left_semi").isEmpty():
                break
            children = edges.where(F.col("parent_parcel_id").isNotNull()).groupBy(F.col("parent_parcel_id").alias("parcel_id")).agg(F.count("*").alias("n_children"))
            return state.drop("moved").join(children, "parcel_id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        state = state.drop("moved")
    raise RuntimeError("lineage did not settle: parent pointers form a cycle")


def renumber(parcels: DataFrame, projects: DataFrame, width: int = 10000) -> DataFrame:
    """Sequential ids per project in parcel order; demo projects have no project part."""
    numbered = number_rows(parcels, ["project_id"], ["parcel_id"], F.floor(F.col("parcel_id") / width))
    named = numbered.join(projects.select("project_id", F.col("name").alias("project_name"), "is_demo"), "project_id", "left")
    suffix = F.expr("right(regexp_replace(coalesce(project_name, 'prj'), '[^a-zA-Z0-9]', ''), 6)")
    digits = F.when(F.col("number") < 10000, F.lpad(F.col("number").cast("string"), 4, "0")).otherwise(F.col("number").cast("string"))
    return named.withColumn(
        "new_id", F.when(F.col("is_demo"), F.concat(F.lit("PM-"), digits)).otherwise(F.concat(F.lit("PM-"), suffix, F.lit("-"), digits))
    )


# fixed values: detections kept per image and class
CLASS_CAPS = {"ROAD": 16, "BUILDING": 30, "FIELD": 16, "VEGETATION": 16, "WATER": 10}


def cap_per_class(features: DataFrame) -> DataFrame:
    """Detection limits per image: buildings by confidence, the rest in detection order."""
    cap = lookup(F.col("detection_type"), CLASS_CAPS, F.lit(None))
    by_confidence = F.when(F.col("detection_type") == "BUILDING", -F.col("confidence")).otherwise(0.0)
    rank = F.row_number().over(Window.partitionBy("imagery_id", "detection_type").orderBy(by_confidence, "feature_id"))
    most = max(CLASS_CAPS.values())
    capped = features.where(F.col("detection_type").isin(*CLASS_CAPS)).withColumn("rank", rank).where(F.col("rank") <= most)
    return capped.where(F.col("rank") <= cap.cast("int"))
