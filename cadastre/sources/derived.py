"""Domain tables derived from the TPC-H-like parquet files.

Integer arithmetic only, so that the same definitions run in any SQL engine. All functions are
narrow maps or key joins over whole tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastre.functions.geom import once, ring

IMAGE_WIDTH, IMAGE_HEIGHT = 4000, 3000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str, columns: list[str]) -> DataFrame:
    """A scan with at least one partition per core.

    Large tables have enough splits and are read as they are; only a table smaller than the cluster
    (one file, one split) is hashed over the cores, because the geometry that follows is CPU work.
    """
    df = table(spark, folder, name).select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


ORDER_FIELDS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
LINE_FIELDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]


def projects(spark: SparkSession, folder: str) -> DataFrame:
    """One project per region."""
    return table(spark, folder, "region").selectExpr(
        "r_regionkey AS project_id",
        "r_name AS name",
        "concat('Taluka ', r_regionkey, ', District ', r_regionkey % 3, ', State ', r_regionkey % 2) AS location",
        "CASE WHEN r_regionkey % 2 = 0 THEN 'Rural Cadastral Mapping' ELSE 'Cadastral Survey Project' END AS project_type",
        "r_regionkey = 4 AS is_demo",
        "CASE WHEN r_regionkey = 3 THEN 'Completed' ELSE 'Created' END AS status",
        "18e0 + r_regionkey * 0.25e0 AS lat",
        "73e0 + r_regionkey * 0.5e0 AS lng",
    )


def imagery(spark: SparkSession, folder: str) -> DataFrame:
    """One image per nation; every fifth one is georeferenced."""
    return table(spark, folder, "nation").selectExpr(
        "n_nationkey AS imagery_id",
        "n_regionkey AS project_id",
        "concat(lower(n_name), CASE WHEN n_nationkey % 5 = 0 THEN '.tif' ELSE '.jpg' END) AS file_name",
        f"{IMAGE_WIDTH} AS width",
        f"{IMAGE_HEIGHT} AS height",
        "n_nationkey % 5 = 0 AS is_georeferenced",
        "18e0 + n_regionkey * 0.25e0 + n_nationkey * 0.01e0 AS lat",
        "73e0 + n_regionkey * 0.5e0 + n_nationkey * 0.01e0 AS lng",
    )


PARCEL_COLUMNS = (
    "o.o_orderkey AS parcel_id",
    "c.c_nationkey AS imagery_id",
    "n.n_regionkey AS project_id",
    "200+(o.o_orderkey*37)%3600 AS x0",
    "200+(o.o_orderkey*91)%2600 AS y0",
    "CASE WHEN o.o_orderkey%61=0 THEN 300 ELSE 20+(o.o_orderkey*13)%120 END AS w",
    "CASE WHEN o.o_orderkey%61=0 THEN 2 ELSE 20+(o.o_orderkey*29)%90 END AS h",
    "CASE WHEN o.o_orderkey%41=0 THEN 'bowtie' WHEN o.o_orderkey%53=0 THEN 'open' "
    "WHEN o.o_orderkey%47=0 THEN 'dupvertex' ELSE 'quad' END AS shape",
    "CASE WHEN o.o_orderkey%97=0 THEN 'Deleted' WHEN o.o_orderkey%89=0 THEN 'split' "
    "WHEN o.o_orderstatus='F' THEN 'accepted' WHEN o.o_orderstatus='O' THEN 'needs_review' "
    "ELSE 'rejected' END AS status",
    "CASE WHEN o.o_orderkey%71=0 THEN NULL ELSE (40+o.o_orderkey%60)/100e0 END AS confidence",
    "CASE WHEN o.o_orderkey%83=0 THEN o.o_orderkey-1 END AS parent_parcel_id",
    "CASE WHEN o.o_orderkey%67=0 THEN concat('Possible gap near ', o.o_orderkey+25) "
    "WHEN o.o_orderkey%73=0 THEN concat('Shares border with ', o.o_orderkey+50) "
    "WHEN o.o_orderkey%79=0 THEN 'Touches water mask' END AS topology_issue",
    "c.c_nationkey % 5 = 0 AS is_georeferenced",
    "o.o_orderdate AS created_at",
)


def parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Parcels with their image-space ring; bow-tie, open and duplicate-vertex rings included."""
    base = (
        spread_table(spark, folder, "orders", "o_orderkey", ORDER_FIELDS).alias("o")
        .join(table(spark, folder, "customer").alias("c"), F.expr("o.o_custkey = c.c_custkey"))
        .join(table(spark, folder, "nation").alias("n"), F.expr("c.c_nationkey = n.n_nationkey"))
        .selectExpr(*PARCEL_COLUMNS)
    )
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    a, b, c, d = (x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0 + 5, y0 + h)
    shape = F.col("shape")
    return once(
        base,
        ring=F.when(shape == "bowtie", ring(a, b, (x0, y0 + h), (x0 + w, y0 + h), a))
        .when(shape == "open", ring(a, b, c, d))
        .when(shape == "dupvertex", ring(a, b, b, c, d, a))
        .otherwise(ring(a, b, c, d, a)),
    )


FEATURE_COLUMNS = (
    "((l_orderkey*10+l_linenumber)*100000+l_partkey)*1000+l_suppkey AS feature_id",
    "CAST(l_suppkey%25 AS INT) AS imagery_id",
    "CAST(l_suppkey%5 AS INT) AS project_id",
    "CASE l_linenumber WHEN 1 THEN 'ROAD' WHEN 2 THEN 'BUILDING' WHEN 3 THEN 'FIELD' WHEN 4 THEN 'WALL' "
    "WHEN 5 THEN 'FENCE' WHEN 6 THEN 'VEGETATION' ELSE 'WATER' END AS detection_type",
    "200+(l_partkey*71+l_orderkey*17)%3600 AS fx",
    "200+(l_partkey*43+l_orderkey*59)%2600 AS fy",
    "10+(l_orderkey*7+l_partkey)%90 AS fw",
    "10+(l_partkey*11)%70 AS fh",
    "(30+CAST(l_quantity AS INT))/100e0 AS confidence",
    "l_returnflag<>'R' AS is_valid",
    "CASE WHEN l_partkey%3=0 THEN 'ml' ELSE 'cv' END AS provider",
    "CASE WHEN l_linenumber=7 AND l_partkey%4=0 THEN 'canal' END AS sub_type",
    "l_shipdate AS created_at",
)

LINE_TYPES = ("ROAD", "WALL", "FENCE")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """Detections: boxes for area classes, three-point polylines for roads, walls and fences."""
    base = spread_table(spark, folder, "lineitem", "l_orderkey", LINE_FIELDS).selectExpr(*FEATURE_COLUMNS)
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "fw", "fh"))
    return once(
        base,
        pts=F.when(F.col("detection_type").isin(*LINE_TYPES), ring((x, y), (x + w, y), (x + w, y + h))).otherwise(
            ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
        ),
    ).withColumn("is_line", F.col("detection_type").isin(*LINE_TYPES))


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Review events, ordered by (ts, event_id)."""
    return table(spark, folder, "events").selectExpr(
        "event_id",
        "user_id AS parcel_id",
        "ts",
        "CASE event_type WHEN 'purchase' THEN 'Accepted' WHEN 'error' THEN 'Rejected' "
        "WHEN 'signup' THEN 'Needs Review' ELSE 'Edited' END AS action",
        "event_type",
        "value",
    )


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    return upload_rows(table(spark, folder, "orders"))


def upload_rows(orders: DataFrame) -> DataFrame:
    """Raw upload records (one per order): the intake side of the imagery catalogue."""
    return orders.selectExpr(
        "o_orderkey AS upload_id",
        "CAST(o_custkey % 5 AS INT) AS project_id",
        "concat('Flight_', o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' "
        "WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' ELSE '.JPEG' END) AS file_name",
        "o_orderkey * 7919 % 400000000 AS size_bytes",
        "CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus = 'F' END AS flag_georeferenced",
        "CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus = 'O' END AS meta_georeferenced",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'EPSG:4326' WHEN o_orderkey % 4 = 1 THEN 'PixelSpace' END AS crs",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(1000 + o_orderkey % 5000 AS INT) END AS width",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(800 + o_orderkey % 4000 AS INT) END AS height",
        "o_orderdate AS uploaded_at",
    )


#: raster tile derived from one block of order keys
TILE_WIDTH, TILE_HEIGHT = 64, 48

PIXEL_KIND = "(x DIV 8 * 7 + y DIV 8 * 5 + imagery_id * 3 + x DIV 24) % 8"
#: fixed test palette: vegetation, pavement, dirt, rooftop, water, soil, pale field, dark
PALETTE = ((60, 150, 50), (125, 122, 128), (160, 125, 90), (190, 80, 70), (40, 90, 160), (120, 85, 60), (190, 185, 90), (30, 32, 30))


def palette_channel(kind: Column, channel: int) -> Column:
    expr = F.lit(PALETTE[-1][channel])
    for i, rgb in enumerate(PALETTE[:-1]):
        expr = F.when(kind == i, rgb[channel]).otherwise(expr)
    return expr


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Pixel rows: every order key is one image row of 64 pixels, 48 rows make an image."""
    rows = spread_table(spark, folder, "orders", "o_orderkey", ["o_orderkey", "o_custkey"]).selectExpr(
        f"o_orderkey DIV {TILE_HEIGHT} AS imagery_id", f"CAST(o_orderkey % {TILE_HEIGHT} AS INT) AS y", "o_custkey"
    )
    px = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(TILE_WIDTH - 1))))
    px = px.withColumn("kind", F.expr(PIXEL_KIND)).withColumn("noise", F.expr("CAST((x*7 + y*3 + o_custkey*11) % 13 AS INT)"))
    channels = {n: palette_channel(F.col("kind"), ch) + F.col("noise") * (ch + 1) % 13 for ch, n in enumerate("rgb")}
    return once(px, **channels).select("imagery_id", "x", "y", "r", "g", "b")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Review events numbered as parcel versions."""
    from cadastre.operators.history import number_events

    return number_events(events(spark, folder), ["value"])


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Verifications with a reviewer and comments."""
    return events(spark, folder).selectExpr("*", "concat('Surveyor ', event_id % 7) AS reviewer_name", "concat('Note on ', event_type) AS comments")


def activities(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events of the projects their parcels belong to."""
    mine = parcels(spark, folder).select("parcel_id", "project_id")
    return events(spark, folder).join(mine, "parcel_id").selectExpr("event_id AS activity_id", "project_id", "action AS type", "ts")


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Processing jobs: one per order."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS job_id",
        "CAST(o_custkey % 5 AS INT) AS project_id",
        "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status",
        "CASE o_orderstatus WHEN 'O' THEN 20 ELSE 100 END AS progress",
        "o_orderdate AS started_at",
    )


def plots(spark: SparkSession, folder: str) -> DataFrame:
    """Cadastral plots: one per order, owned by its customer."""
    o = table(spark, folder, "orders").alias("o").join(table(spark, folder, "customer").alias("c"), F.expr("o_custkey = c_custkey"))
    return o.selectExpr(
        "o_orderkey AS plot_id",
        "concat(o_orderkey, CASE WHEN o_orderkey % 10 = 4 THEN 'A' ELSE '' END) AS plot_no",
        "concat(o_orderkey % 97, '/', o_orderkey % 7) AS survey_no",
        "c_name AS owner",
        "concat('Village ', o_orderkey % 23) AS village",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'Commercial' WHEN '2-HIGH' THEN 'Residential' WHEN '3-MEDIUM' THEN 'Agricultural' "
        "WHEN '4-NOT SPECIFIED' THEN 'Government' ELSE 'Industrial' END AS land_type",
        "CASE o_orderstatus WHEN 'F' THEN 'Clear Title' WHEN 'O' THEN 'Under Survey' ELSE 'Disputed' END AS title_status",
        "(o_orderkey * 13 % 500 + 20) / 100e0 AS area_acre",
    )


def rejections(spark: SparkSession, folder: str) -> DataFrame:
    """Rejected detections with a diagnostic category; some categories are unknown or missing."""
    from cadastre.operators.reports import REJECTION_CATEGORIES

    names = F.array(*[F.lit(c) for c in (*REJECTION_CATEGORIES, "Other cause")])
    k = F.col("fw") % 11
    return features(spark, folder).where("NOT is_valid").select(
        F.col("feature_id").alias("item_id"), "imagery_id", F.lower("detection_type").alias("feature_class"),
        F.when(k < 10, F.element_at(names, (k + 1).cast("int"))).alias("category"), F.col("confidence").alias("score"),
    )
