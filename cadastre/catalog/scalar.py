"""Queries N01-N16: scoping, canonical values, simple predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import canonical as C
from cadastre.functions.geom import ring
from cadastre.operators import history, normalise as N
from cadastre.sources import derived as D


@query("n01_scope_features", sql("features", body="""SELECT feature_id, detection_type, confidence FROM features
  WHERE project_id=2 AND imagery_id=7"""))
def n01(spark, d):
    return N.scope_features(D.features(spark, d), 2, 7).select("feature_id", "detection_type", "confidence")


PARTLY_PLACED = "CASE WHEN parcel_id%9=0 THEN NULL ELSE imagery_id END"


@query("n02_scope_parcels", sql("parcels", "imagery", body=f""", p AS (SELECT parcel_id, project_id, status, {PARTLY_PLACED} AS imagery_id FROM parcels UNION ALL SELECT -1-parcel_id, project_id+1000, status, {PARTLY_PLACED}+1000 FROM parcels),
  im AS (SELECT project_id, imagery_id FROM imagery UNION ALL SELECT project_id+1000, min(imagery_id)+1000 FROM imagery GROUP BY 1),
  n AS (SELECT project_id, count(*) AS images, min(imagery_id) AS only_image FROM im GROUP BY 1)
  SELECT parcel_id, project_id, coalesce(imagery_id, only_image) AS scope_imagery_id, coalesce(images,0) AS images
  FROM p LEFT JOIN n USING (project_id) WHERE status<>'Deleted' AND (imagery_id IS NOT NULL OR coalesce(images,0)<=1)"""))
def n02(spark, d):
    parcels = D.parcels(spark, d).withColumn("imagery_id", F.expr(PARTLY_PLACED))
    images = D.imagery(spark, d)
    # every project comes again, with ids of its own and a single image, for the single-image rule
    again = parcels.withColumns({"parcel_id": -1 - F.col("parcel_id"), "project_id": F.col("project_id") + 1000, "imagery_id": F.col("imagery_id") + 1000})
    single = images.groupBy((F.col("project_id") + 1000).alias("project_id")).agg((F.min("imagery_id") + 1000).alias("imagery_id"))
    parcels, images = parcels.unionByName(again), images.select("project_id", "imagery_id").unionByName(single)
    return N.scope_parcels(parcels, images).select("parcel_id", "project_id", "scope_imagery_id", "images")


@query("n03_active_parcels", sql("parcels", body="SELECT parcel_id, status FROM parcels WHERE status NOT IN ('Deleted','split')"))
def n03(spark, d):
    return N.active_parcels(D.parcels(spark, d)).select("parcel_id", "status")


@query("n04_valid_features", sql("features", body="""SELECT feature_id, imagery_id, detection_type FROM features
  WHERE coalesce(CASE WHEN feature_id%13=0 THEN NULL ELSE is_valid END, true)"""))
def n04(spark, d):
    f = D.features(spark, d).withColumn("is_valid", F.expr("CASE WHEN feature_id%13=0 THEN NULL ELSE is_valid END"))
    return N.valid_features(f).select("feature_id", "imagery_id", "detection_type")


RAW_TYPE = "CASE WHEN detection_type='FENCE' AND fw%3=0 THEN 'Hedge row' WHEN detection_type='WALL' AND fw%3=1 THEN 'field boundary' ELSE lower(detection_type) END"


@query("n05_canonical_class", sql("features", body=f""", t AS (SELECT feature_id, upper({RAW_TYPE}) AS t, upper(coalesce(sub_type,'')) AS s FROM features)
  SELECT feature_id, CASE WHEN t LIKE '%WATER%' OR s LIKE '%WATER%' OR s LIKE '%CANAL%' OR s LIKE '%RIVER%' OR s LIKE '%LAKE%' THEN 'water'
   WHEN t LIKE '%ROAD%' THEN 'road' WHEN t LIKE '%BUILDING%' THEN 'building' WHEN t LIKE '%FIELD%' THEN 'field'
   WHEN t LIKE '%WALL%' OR t LIKE '%FENCE%' OR t LIKE '%BOUNDARY%' OR t LIKE '%HEDGE%' THEN 'boundary'
   WHEN t LIKE '%VEGETATION%' THEN 'vegetation' ELSE 'other' END AS feature_class FROM t"""))
def n05(spark, d):
    f = D.features(spark, d).withColumn("detection_type", F.expr(RAW_TYPE))
    return N.with_class(f).select("feature_id", "feature_class")


@query("n06_canonical_status", sql("parcels", body="""SELECT parcel_id, CASE WHEN status='accepted' THEN 'accepted' WHEN status='needs_review' THEN 'review'
  WHEN status='rejected' THEN 'rejected' ELSE 'pending' END AS canonical_status FROM parcels"""))
def n06(spark, d):
    return D.parcels(spark, d).select("parcel_id", C.canonical_status(F.col("status")).alias("canonical_status"))


@query("n07_georeferenced", sql("uploads", body="""SELECT upload_id,
  CASE WHEN meta_georeferenced IS NOT NULL THEN meta_georeferenced WHEN flag_georeferenced IS NOT NULL THEN flag_georeferenced
   WHEN crs IS NOT NULL AND crs<>'PixelSpace' THEN true
   WHEN crs IS NOT NULL AND (lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff') THEN true ELSE false END AS report_georeferenced,
  CASE WHEN flag_georeferenced IS NOT NULL THEN flag_georeferenced
   WHEN lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff' THEN true
   ELSE coalesce(lower(crs) LIKE '%epsg%', false) END AS inference_georeferenced FROM uploads"""))
def n07(spark, d):
    flag, crs, name = F.col("flag_georeferenced"), F.col("crs"), F.col("file_name")
    return D.uploads(spark, d).select(
        "upload_id",
        C.georeferenced_for_report(F.col("meta_georeferenced"), flag, crs, name).alias("report_georeferenced"),
        C.georeferenced_for_inference(flag, crs, name).alias("inference_georeferenced"),
    )


@query("n08_canonical_parcel", sql("parcels", body="""SELECT parcel_id, CAST(parcel_id AS VARCHAR) AS parcel_number,
  CASE WHEN parcel_id%4=0 THEN 'Not available' ELSE (parcel_id%97)||'/'||(parcel_id%7) END AS survey_number,
  CASE WHEN parcel_id%3=0 THEN 'Village '||parcel_id%11 ELSE 'Cadastral Block' END AS village,
  18e0+parcel_id%100/100e0 AS latitude, 73e0+parcel_id%50/100e0 AS longitude,
  CASE WHEN parcel_id%5=0 THEN 'Not available' ELSE (parcel_id%40)||' acres' END AS area,
  CASE WHEN confidence IS NULL THEN '95%' ELSE CAST(floor(confidence*100+0.5) AS INT)||'%' END AS confidence_text,
  CASE WHEN project_id=4 THEN 'Demo Dataset' ELSE 'Verified Cadastral Record' END AS source,
  CASE WHEN parcel_id%6=0 THEN 4 WHEN parcel_id%4=1 THEN 4 ELSE NULL END AS boundary_points FROM parcels"""))
def n08(spark, d):
    p = D.parcels(spark, d)
    swap = F.col("parcel_id") % 10 == 3
    lat, lng = 18.0 + F.col("parcel_id") % 100 / 100.0, 73.0 + F.col("parcel_id") % 50 / 100.0
    triangle = ring((lng, lat), (lng + 0.001, lat), (lng, lat + 0.001))
    raw = p.select(
        "parcel_id",
        F.when(F.col("parcel_id") % 2 == 0, F.concat(F.lit("Plot #"), "parcel_id")).otherwise(F.concat(F.lit("parcel# "), "parcel_id")).alias("parcel_ref"),
        F.expr("CASE WHEN parcel_id%4<>0 THEN concat('Survey ', parcel_id%97, '/', parcel_id%7) END").alias("survey_no"),
        F.expr("CASE WHEN parcel_id%3=0 THEN concat('Village ', parcel_id%11) END").alias("village"),
        F.lit(None).cast("string").alias("location"),
        F.lit(None).cast("string").alias("district"),
        F.lit(None).cast("string").alias("state"),
        F.when(swap, lng).otherwise(lat).alias("lat"),
        F.when(swap, lat).otherwise(lng).alias("lng"),
        F.when(F.col("parcel_id") % 6 == 0, triangle).alias("boundary"),
        F.expr("CASE WHEN parcel_id%5<>0 THEN parcel_id%40 END").alias("area_acres"),
        F.lit(None).cast("string").alias("land_type"),
        "status",
        "confidence",
        (F.col("project_id") == 4).alias("is_demo"),
    )
    # every parcel has a plot; three of four carry a number no parcel refers to
    number = F.when(F.col("parcel_id") % 4 == 1, F.col("parcel_id").cast("string")).otherwise(F.concat(F.lit("old "), "parcel_id"))
    plots = p.select(number.alias("plot_no"), triangle.alias("boundary"))
    return N.canonical_parcel(raw, plots).select(
        "parcel_id", "parcel_number", "survey_number", "village", "latitude", "longitude", "area", "confidence_text", "source",
        F.when(F.col("boundary").isNotNull(), F.size("boundary")).alias("boundary_points"),
    )


@query("n09_enrich_parcel", sql("parcels", "events_fx", body=""", v AS (SELECT parcel_id, count(*) AS n, max(CASE WHEN action='Edited' THEN 1 ELSE 0 END) AS edited FROM events_fx GROUP BY 1),
  s AS (SELECT p.*, CASE WHEN p.parcel_id%6=0 THEN CAST(p.parcel_id%90+5 AS INT) END AS sup FROM parcels p)
  SELECT s.parcel_id, coalesce(v.n,1) AS version,
   CASE WHEN s.parcel_id%100=7 THEN 'Merged from '||(s.parcel_id+1)||' + '||(s.parcel_id+2)
        WHEN s.parcel_id%100=8 THEN 'Split from '||(s.parcel_id*2)
        WHEN parent_parcel_id IS NOT NULL THEN 'Split from '||parent_parcel_id
        WHEN coalesce(v.edited,0)=1 THEN 'Human Edited' WHEN s.parcel_id%4=1 THEN 'Imported' ELSE 'AI Generated' END AS source,
   coalesce(sup,48) AS supported_pct, 100-coalesce(sup,48) AS unsupported_pct,
   coalesce(confidence, floor((0.5e0+0.5e0*(coalesce(sup,48)/100e0))*100+0.5)/100e0) AS confidence,
   1 AS n_supporting FROM s LEFT JOIN v USING (parcel_id)"""))
def n09(spark, d):
    pid = F.col("parcel_id")
    p = D.parcels(spark, d).select(
        "parcel_id", "parent_parcel_id", "confidence",
        F.when(pid % 4 == 1, "Imported").when(pid % 4 == 2, "spatial_reasoning").alias("source"),
        F.when(pid % 100 == 7, F.array((pid + 1).cast("string"), (pid + 2).cast("string"))).alias("merged_from"),
        F.when(pid % 100 == 8, pid * 2).alias("split_from"),
        F.lit(None).cast("boolean").alias("is_human_edited"),
        F.when(pid % 6 == 0, (pid % 90 + 5).cast("int")).alias("supported_pct"),
        F.array(F.lit("Road-1"), F.lit("Merged with #4")).alias("supporting_features"),
    )
    versions = history.number_events(D.events(spark, d))
    return N.enrich_parcels(p, versions).select(
        "parcel_id", "version", "source", "supported_pct", "unsupported_pct", "confidence", F.size("supporting_features").alias("n_supporting")
    )


@query("n10_verification_queue", sql("parcels", body="""SELECT 'low_conf' AS queue, parcel_id FROM parcels WHERE status NOT IN ('Deleted','split') AND coalesce(confidence,0)<0.6 AND CAST(parcel_id AS VARCHAR) LIKE '%12%'
  UNION ALL SELECT 'needs_review', parcel_id FROM parcels WHERE status='needs_review'
  UNION ALL SELECT 'accepted', parcel_id FROM parcels WHERE status='accepted' UNION ALL SELECT 'rejected', parcel_id FROM parcels WHERE status='rejected'
  UNION ALL SELECT 'pending', parcel_id FROM parcels WHERE status IN ('Deleted','split')"""))
def n10(spark, d):
    p = D.parcels(spark, d)
    parts = [N.verification_queue(N.active_parcels(p), "low_conf", "12").select(F.lit("low_conf").alias("queue"), "parcel_id")]
    for name in ("needs_review", "accepted", "rejected", "pending"):
        parts.append(N.verification_queue(p, name).select(F.lit(name).alias("queue"), "parcel_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("n11_feature_layer_filter", sql("features", body="""SELECT feature_id, CASE detection_type WHEN 'WATER' THEN 1 WHEN 'FIELD' THEN 2 WHEN 'VEGETATION' THEN 3
  WHEN 'BUILDING' THEN 4 WHEN 'WALL' THEN 5 WHEN 'FENCE' THEN 6 ELSE 7 END AS layer_rank FROM features
  WHERE detection_type IN ('ROAD','WATER','FIELD','BUILDING','VEGETATION','WALL') AND confidence>=0.6 AND confidence<0.8"""))
def n11(spark, d):
    classes = ["ROAD", "WATER", "FIELD", "BUILDING", "VEGETATION", "WALL"]
    return N.layer_filter(D.features(spark, d), classes, "Medium").select("feature_id", "layer_rank")


@query("n12_confidence_label", sql("features", body="""SELECT feature_id, CASE WHEN confidence>=0.8 THEN 'High' WHEN confidence>=0.6 THEN 'Medium' ELSE 'Low' END AS detection_label,
  CASE WHEN confidence>=0.85 THEN 'High' WHEN confidence>=0.7 THEN 'Medium' ELSE 'Low' END AS parcel_label FROM features"""))
def n12(spark, d):
    c = F.col("confidence")
    return D.features(spark, d).select(
        "feature_id", C.confidence_label(c).alias("detection_label"), C.confidence_label(c, "parcel").alias("parcel_label")
    )


@query("n13_class_threshold_filter", sql("features", body=""", t AS (SELECT *, CASE WHEN detection_type='BUILDING' THEN 0.40e0
   WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 0.65e0 WHEN detection_type IN ('FIELD','VEGETATION') THEN 0.55e0
   WHEN sub_type='canal' THEN 0.70e0 ELSE 0.60e0 END AS threshold FROM features)
  SELECT feature_id, CASE WHEN confidence<threshold THEN 'Weak evidence' ELSE 'kept' END AS outcome,
   CASE WHEN confidence<threshold THEN threshold END AS threshold FROM t"""))
def n13(spark, d):
    kept, rejected = N.split_by_threshold(D.features(spark, d))
    return kept.select("feature_id", F.lit("kept").alias("outcome"), F.lit(None).cast("double").alias("threshold")).unionByName(
        rejected.select(F.col("item_id").alias("feature_id"), F.col("category").alias("outcome"), "threshold")
    )


QUERY_TEXT = "CASE WHEN o_orderkey%4=0 THEN {c} WHEN o_orderkey%4=1 THEN {s} WHEN o_orderkey%4=2 THEN {b} ELSE {w} END"


@query("n14_parse_coordinate_query", """WITH t AS (SELECT o_orderkey AS query_id, o_orderkey%4 AS k, CAST(o_orderkey%200-100 AS DOUBLE)+0.25e0 AS lat, CAST(o_custkey%400-200 AS DOUBLE)+0.5e0 AS lng FROM orders),
  u AS (SELECT query_id, k IN (0,1) AND lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AS ok, lat, lng FROM t)
  SELECT query_id, CASE WHEN ok THEN lat END AS lat, CASE WHEN ok THEN lng END AS lng FROM u""")
def n14(spark, d):
    o = D.table(spark, d, "orders").selectExpr(
        "o_orderkey AS query_id",
        "CAST(CAST(o_orderkey%200-100 AS double)+0.25e0 AS string) AS a",
        "CAST(CAST(o_custkey%400-200 AS double)+0.5e0 AS string) AS b",
    )
    text = F.expr("CASE WHEN query_id%4=0 THEN concat(' ', a, ', ', b) WHEN query_id%4=1 THEN concat(a, ' ', b) WHEN query_id%4=2 THEN concat(a, ';', b) ELSE concat('near ', a) END")
    return N.parse_coordinates(o.withColumn("text", text), "text").select("query_id", "lat", "lng")


@query("n15_project_filter", """SELECT c_custkey AS project_id, c_name AS name FROM customer
  WHERE lower(c_name) LIKE '%13%' OR lower(c_mktsegment) LIKE '%13%' OR CAST(c_custkey AS VARCHAR) LIKE '%13%'
  UNION ALL SELECT c_custkey, c_name FROM customer WHERE lower(c_mktsegment) LIKE '%build%'""")
def n15(spark, d):
    portfolio = D.table(spark, d, "customer").selectExpr("c_custkey AS project_id", "c_name AS name", "c_mktsegment AS location")
    return N.project_filter(portfolio, " 13").unionByName(N.project_filter(portfolio, "Build")).select("project_id", "name")


@query("n16_geo_project", sql("fvertices", "imagery", body="""SELECT feature_id, seq,
  floor((m.lng+(x/width-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lng, floor((m.lat-(y/height-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lat
  FROM fvertices JOIN imagery m USING (imagery_id)"""))
def n16(spark, d):
    f = D.features(spark, d).select("feature_id", "imagery_id", "pts")
    g = N.geo_project(f, D.imagery(spark, d))
    return g.select("feature_id", F.posexplode("geo_pts").alias("seq", "p")).select(
        "feature_id", "seq", F.col("p.x").alias("lng"), F.col("p.y").alias("lat")
    )
