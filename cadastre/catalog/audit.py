"""Queries A01, A04-A14: audit, issues, metrics and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.joins import GAPS, OVERLAPS, WATER, water_rings
from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G
from cadastre.operators import audit as A, history as H, measures as M, normalise as N, reports as R
from cadastre.sources import derived as D


def parts(spark, d):
    return A.audit_parts(D.parcels(spark, d), D.imagery(spark, d), water_rings(spark, d))


def meeting_parts(spark, d, counted=True):
    return A.counted_parts(D.parcels(spark, d), D.imagery(spark, d), water_rings(spark, d), counted)


def counted_parts(spark, d):
    return A.audit_parts(D.parcels(spark, d), D.imagery(spark, d), pairs=False)


# the overlap, water and gap texts share the plane tables; rename what both define
WATER_TAIL = WATER[WATER.index(", wrect AS"):].replace("cand", "wcand").replace("shared", "wshared").replace(" pe ", " wpe ").replace("pe AS", "wpe AS").replace(
    "FROM pe)", "FROM wpe)").replace("pr AS", "wpr AS").replace("FROM pr ", "FROM wpr ").replace("pf AS", "wpf AS").replace("FROM pf ", "FROM wpf ").replace("wwpe", "wpe")

AUDIT = OVERLAPS + WATER_TAIL + GAPS + """, ids AS (SELECT parcel_a AS parcel_id FROM ovl UNION SELECT parcel_b FROM ovl UNION SELECT parcel_id FROM water_issues),
  fx AS (SELECT f.*, f.parcel_id IN (SELECT parcel_id FROM slivers) AS sliver, f.status='needs_review' OR NOT f.valid OR f.parcel_id IN (SELECT parcel_id FROM ids)
     OR f.parcel_id IN (SELECT parcel_id FROM slivers) OR coalesce(confidence,0.8)<0.6 AS needs FROM facts f WHERE status NOT IN ('Deleted','split'))"""
AUDIT_TABLES = ("slivers", "features", "imagery")


@query("a01_topology_audit", sql(*AUDIT_TABLES, body=AUDIT + """
  SELECT project_id, imagery_id, count(*) AS total_parcels, count(CASE WHEN valid THEN 1 END) AS valid_polygons, count(CASE WHEN NOT valid THEN 1 END) AS invalid_polygons,
   count(CASE WHEN sliver THEN 1 END) AS slivers, count(CASE WHEN coalesce(confidence,0.8)<0.6 THEN 1 END) AS low_confidence,
   count(CASE WHEN shape IN ('dupvertex','open') OR (area>0.0001 AND (area<CASE WHEN geo THEN 50 ELSE 600 END OR comp<0.05e0)) THEN 1 END) AS repairs_performed,
   count(CASE WHEN needs THEN 1 END) AS needs_review, count(CASE WHEN status='rejected' THEN 1 END) AS rejected, count(CASE WHEN status<>'rejected' AND valid THEN 1 END) AS ready_for_review,
   (SELECT count(*) FROM ovl o WHERE o.imagery_id=fx.imagery_id) AS overlaps, (SELECT count(*) FROM gp WHERE gp.imagery_id=fx.imagery_id) AS gaps,
   (SELECT count(*) FROM water_issues w WHERE w.imagery_id=fx.imagery_id) AS water_overlaps FROM fx GROUP BY project_id, imagery_id"""))
def a01(spark, d):
    return A.topology_audit(meeting_parts(spark, d))


@query("a04_needs_review_set", sql(*AUDIT_TABLES, body=AUDIT + " SELECT parcel_id, imagery_id, status FROM fx WHERE needs"))
def a04(spark, d):
    return A.with_review_flag(meeting_parts(spark, d, counted=False)).where("needs_review").select("parcel_id", "imagery_id", "status")


@query("a05_issue_feed", sql(*AUDIT_TABLES, body=AUDIT + """
  SELECT imagery_id, 'Invalid Geometry' AS issue_type, parcel_id, NULL AS other_parcel_id, 'High' AS severity, 'Needs Review' AS status,
    concat_ws('; ', CASE WHEN kinks>0 THEN CASE WHEN geo THEN 'Polygon self-intersects (contains '||kinks||' intersection kinks).' ELSE 'Polygon boundary contains '||kinks||' self-intersecting segments.' END END,
    CASE WHEN area<=0.0001 THEN 'Polygon area must be greater than zero.' END) AS description FROM fx WHERE NOT valid
  UNION ALL SELECT imagery_id, 'Overlap', parcel_a, parcel_b, severity, 'Needs Review', 'Overlaps with adjacent parcel ('||CAST(floor(area+0.5) AS BIGINT)||CASE WHEN geo THEN ' m²)' ELSE ' px²)' END FROM ovl
  UNION ALL SELECT imagery_id, 'Possible Gap', parcel_a, NULL, 'Medium', 'Possible gap — review required', count(*)||' possible gaps — review required' FROM gp GROUP BY imagery_id, parcel_a
  UNION ALL SELECT imagery_id, 'Sliver', parcel_id, NULL, 'High', 'Needs Review', CASE WHEN raw_area<CASE WHEN geo THEN 60 ELSE 800 END THEN 'Tiny sliver polygon ('||CAST(floor(raw_area+0.5) AS BIGINT)||CASE WHEN geo THEN ' m² < 60 m²)' ELSE ' px²)' END ELSE 'High perimeter-to-area sliver ratio' END FROM slivers
  UNION ALL SELECT imagery_id, 'Low Confidence', parcel_id, NULL, 'Low', 'Review', 'AI confidence: '||CAST(floor(confidence*100+0.5) AS INT)||'%' FROM fx WHERE confidence<0.6
  UNION ALL SELECT imagery_id, 'Water Overlap', parcel_id, NULL, 'High', 'Needs Review', 'Overlaps water boundary' FROM water_issues"""))
def a05(spark, d):
    return A.issue_feed(parts(spark, d)).drop("project_id")


CRITICAL = OVERLAPS + """, crit AS (SELECT project_id, count(*) AS critical_issues FROM (SELECT p.project_id FROM ovl JOIN parcels p ON p.parcel_id=ovl.parcel_a
   UNION ALL SELECT project_id FROM facts WHERE NOT valid AND status NOT IN ('Deleted','split')) t GROUP BY 1),
  pc AS (SELECT project_id, count(*) AS preliminary_parcels, count(CASE WHEN status='accepted' THEN 1 END) AS verified_parcels, count(CASE WHEN status='needs_review' THEN 1 END) AS needs_review_parcels,
   count(CASE WHEN status='rejected' THEN 1 END) AS rejected_parcels FROM parcels WHERE status NOT IN ('Deleted','split') GROUP BY 1),
  im AS (SELECT project_id, count(*) AS imagery_count FROM imagery GROUP BY 1), fc AS (SELECT project_id, count(*) AS detections_count FROM features GROUP BY 1),
  met AS (SELECT pr.project_id, pr.name, pr.status, imagery_count, detections_count, preliminary_parcels, verified_parcels, needs_review_parcels, rejected_parcels, coalesce(critical_issues,0) AS critical_issues,
   CAST(floor(verified_parcels/CAST(preliminary_parcels AS DOUBLE)*100+0.5) AS INT) AS verification_pct,
   CASE WHEN coalesce(critical_issues,0)>0 THEN 'REQUIRES ATTENTION' WHEN verified_parcels=preliminary_parcels THEN 'VERIFIED' WHEN needs_review_parcels>0 OR verified_parcels>0 THEN 'PARTIALLY VERIFIED' ELSE 'READY FOR REVIEW' END AS final_status
   FROM projects pr JOIN im USING (project_id) JOIN fc USING (project_id) JOIN pc USING (project_id) LEFT JOIN crit USING (project_id))"""
METRIC_COLUMNS = ["project_id", "imagery_count", "detections_count", "preliminary_parcels", "verified_parcels", "needs_review_parcels", "rejected_parcels",
                  "critical_issues", "verification_pct", "final_status"]


def metrics(spark, d):
    critical = A.critical_counts(counted_parts(spark, d))
    active = N.active_parcels(D.parcels(spark, d))
    return R.project_metrics(D.projects(spark, d), D.imagery(spark, d), D.features(spark, d), active, critical)


@query("a06_project_metrics", sql("facts", "projects", "features", body=CRITICAL + f" SELECT {', '.join(METRIC_COLUMNS)} FROM met"))
def a06(spark, d):
    return metrics(spark, d).select(*METRIC_COLUMNS)


@query("a07_project_listing", sql("facts", "projects", "features", body=CRITICAL + " SELECT project_id, name, CASE WHEN status='Completed' THEN 'Completed' ELSE final_status END AS status, verified_parcels, verification_pct FROM met"))
def a07(spark, d):
    return R.project_listing(metrics(spark, d)).select("project_id", "name", "status", "verified_parcels", "verification_pct")


BREAKDOWN = """SELECT project_id, count(*) AS detections, count(CASE WHEN provider='ml' THEN 1 END) AS ml_features, count(CASE WHEN provider<>'ml' THEN 1 END) AS cv_features,
  count(CASE WHEN detection_type='ROAD' THEN 1 END) AS roads, count(CASE WHEN detection_type='BUILDING' THEN 1 END) AS buildings, count(CASE WHEN detection_type='FIELD' THEN 1 END) AS fields,
  count(CASE WHEN detection_type IN ('WALL','FENCE') THEN 1 END) AS boundaries, count(CASE WHEN detection_type='WATER' THEN 1 END) AS water FROM features GROUP BY 1"""


@query("a08_project_report", sql("facts", "projects", "features", body=CRITICAL + f""", br AS ({BREAKDOWN}),
  ar AS (SELECT project_id, sum(CASE WHEN status='accepted' THEN floor(area+0.5) END) AS sqm, max(CASE WHEN geo THEN 1 ELSE 0 END)=1 AS geo FROM facts WHERE status NOT IN ('Deleted','split') GROUP BY 1)
  SELECT met.project_id, detections, ml_features, cv_features, roads, buildings, fields, boundaries, water, preliminary_parcels, verified_parcels, verification_pct,
   verified_parcels||' / '||preliminary_parcels||' parcels verified' AS progress_text, CAST(CASE WHEN geo THEN sqm END AS BIGINT) AS total_area_sqm FROM met JOIN br USING (project_id) JOIN ar USING (project_id)"""))
def a08(spark, d):
    m = metrics(spark, d)
    breakdown = R.class_breakdown(D.features(spark, d), ["project_id"])
    measured = M.measure(M.active_working(D.parcels(spark, d), D.imagery(spark, d)))
    area = R.verified_area(measured, ["project_id"]).select("project_id", "total_area_sqm")
    progress = F.concat("verified_parcels", F.lit(" / "), "preliminary_parcels", F.lit(" parcels verified"))
    return m.join(breakdown, "project_id", "left").join(area, "project_id", "left").select(
        "project_id", *[c for c in breakdown.columns if c != "project_id"], "preliminary_parcels", "verified_parcels", "verification_pct",
        progress.alias("progress_text"), "total_area_sqm",
    )


def report_lines(spark, d):
    measured = M.measure(M.active_working(D.parcels(spark, d), D.imagery(spark, d)))
    first = D.reviews(spark, d).groupBy("parcel_id").agg(F.min_by(F.struct("reviewer_name", "comments", "ts"), "event_id").alias("v")).select("parcel_id", "v.*")
    return R.report_join(measured, first, D.projects(spark, d), D.imagery(spark, d))


REPORT = """, fv AS (SELECT * FROM (SELECT parcel_id, 'Surveyor '||(event_id%7) AS reviewer_name, 'Note on '||event_type AS comments, ts, row_number() OVER (PARTITION BY parcel_id ORDER BY event_id) AS rn FROM events_fx) t WHERE rn=1),
  rep AS (SELECT f.*, p.created_at, pr.name AS project_name, m.file_name AS imagery_file, fv.reviewer_name, fv.comments, fv.ts AS v_ts,
   CASE WHEN f.status='accepted' THEN 'Human Verified' WHEN f.status='rejected' THEN 'Rejected' ELSE 'Needs Review' END AS verification_status,
   CAST(floor(coalesce(f.confidence,0.85e0)*100+0.5) AS INT)||'%' AS confidence_formatted, CAST(floor(f.area+0.5) AS BIGINT) AS sqm
   FROM facts f JOIN parcels p USING (parcel_id) JOIN projects pr ON pr.project_id=f.project_id JOIN imagery m ON m.imagery_id=f.imagery_id LEFT JOIN fv ON fv.parcel_id=f.parcel_id WHERE f.status NOT IN ('Deleted','split'))"""
NO_AREA = "'Area unavailable — imagery is not georeferenced.'"


@query("j21_report_join", sql("facts", "projects", "events_fx", body=REPORT + f""" SELECT parcel_id, verification_status, confidence_formatted,
   CASE WHEN geo AND sqm>0 THEN format('{{:,}}', sqm)||' m²' ELSE {NO_AREA} END AS area,
   coalesce(reviewer_name, CASE WHEN status='accepted' THEN 'Lead Cadastral Surveyor' ELSE 'Pending Review' END) AS reviewer, coalesce(v_ts, created_at) AS verification_date FROM rep"""))
def j21(spark, d):
    return report_lines(spark, d).select("parcel_id", "verification_status", "confidence_formatted", "area", "reviewer", "verification_date")


@query("a09_parcel_report", sql("facts", "projects", "events_fx", body=REPORT + """ SELECT parcel_id, project_name, imagery_file, coalesce(confidence,0.85e0) AS confidence,
   CASE WHEN geo THEN 'Geographic (WGS84 EPSG:4326)' ELSE 'Image-space coordinates' END AS coordinates_mode, CASE WHEN geo THEN sqm END AS area_sqm,
   coalesce(comments,'Human verified boundary delineation confirmed by surveyor inspection.') AS verification_remarks, coalesce(reviewer_name,'Lead Cadastral Surveyor') AS reviewer_name FROM rep"""))
def a09(spark, d):
    return R.parcel_report(report_lines(spark, d)).select(
        "parcel_id", "project_name", "imagery_file", "confidence", "coordinates_mode", "area_sqm", "verification_remarks", "reviewer_name"
    )


@query("a10_class_summary", sql("features", body="""SELECT imagery_id, lower(detection_type) AS feature_class, count(*) AS n,
  CAST(floor(sum(CASE WHEN fw%17=0 THEN 0.8e0 ELSE confidence END)/count(*)*100+1e-9+0.5) AS INT) AS mean_confidence_pct,
  count(CASE WHEN detection_type='WATER' AND sub_type='canal' THEN 1 END) AS canals, count(CASE WHEN detection_type='WATER' AND sub_type IS NULL THEN 1 END) AS bodies FROM features GROUP BY 1,2"""))
def a10(spark, d):
    f = D.features(spark, d).withColumn("confidence", F.expr("CASE WHEN fw%17<>0 THEN confidence END"))
    return R.class_summary(f, ["imagery_id"])


@query("a11_rejection_diagnostics", sql("rejections", body=""", cat AS (SELECT * FROM (VALUES ('Water crossing'),('Unsupported line'),('Image-edge artifact'),('Insufficient continuity'),('Invalid geometry'),('Duplicate geometry'),('Weak evidence'),('Excessive size'),('Disconnected feature')) t(category)),
  r AS (SELECT imagery_id, feature_class, coalesce(cat.category,'Weak evidence') AS category FROM rejections LEFT JOIN cat USING (category)),
  k AS (SELECT DISTINCT imagery_id, feature_class FROM rejections)
  SELECT k.imagery_id, k.feature_class, cat.category, count(r.category) AS n FROM k CROSS JOIN cat LEFT JOIN r ON r.imagery_id=k.imagery_id AND r.feature_class=k.feature_class AND r.category=cat.category GROUP BY 1,2,3"""))
def a11(spark, d):
    return R.rejection_diagnostics(D.rejections(spark, d), ["imagery_id", "feature_class"])


@query("a12_stage_funnel", sql("features", body="""SELECT imagery_id, lower(detection_type) AS feature_class, count(*) AS raw, count(CASE WHEN is_valid THEN 1 END) AS cleaned,
  count(CASE WHEN is_valid AND confidence>=CASE WHEN detection_type='BUILDING' THEN 0.40e0 WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 0.65e0 WHEN detection_type IN ('FIELD','VEGETATION') THEN 0.55e0 WHEN sub_type='canal' THEN 0.70e0 ELSE 0.60e0 END THEN 1 END) AS accepted,
  count(CASE WHEN NOT (is_valid AND confidence>=CASE WHEN detection_type='BUILDING' THEN 0.40e0 WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 0.65e0 WHEN detection_type IN ('FIELD','VEGETATION') THEN 0.55e0 WHEN sub_type='canal' THEN 0.70e0 ELSE 0.60e0 END) THEN 1 END) AS rejected
  FROM features GROUP BY 1,2"""))
def a12(spark, d):
    from cadastre.functions import canonical as C

    f = D.features(spark, d)
    strong = F.col("confidence") >= C.class_threshold(C.threshold_key(F.col("detection_type"), F.col("sub_type")))
    staged = f.withColumn("passed_clean", F.col("is_valid")).withColumn("passed_final", F.col("is_valid") & strong)
    return R.stage_funnel(staged, ["imagery_id"])


@query("a13_completion_gate", sql("facts", "projects", "features", body=CRITICAL + """, g AS (SELECT p.project_id, count(CASE WHEN coalesce(confidence,0)<0.6 THEN 1 END) AS low_confidence, count(CASE WHEN status='needs_review' THEN 1 END) AS needs_review,
   count(CASE WHEN status='rejected' THEN 1 END) AS rejected, count(CASE WHEN status<>'accepted' THEN 1 END) AS unverified FROM parcels p WHERE status NOT IN ('Deleted','split') GROUP BY 1)
  SELECT project_id, low_confidence, needs_review, rejected, unverified, critical_issues, true AS blocked,
   critical_issues||' unresolved critical GIS topology issues (overlaps/invalid geometries)|'||low_confidence||' parcels with low AI confidence (<60%)|'||needs_review||' parcels flagged as ''Needs Review''|'||rejected||' rejected parcels still present|'||unverified||' parcels awaiting surveyor verification' AS issues
  FROM g JOIN crit USING (project_id)"""))
def a13(spark, d):
    g = A.completion_gate(counted_parts(spark, d))
    return g.withColumn("issues", F.array_join("issues", "|"))


@query("a14_verified_area", sql("facts", body="""SELECT project_id, imagery_id, count(CASE WHEN status='accepted' THEN 1 END) AS verified_parcels,
  CAST(CASE WHEN bool_or(geo) THEN coalesce(sum(CASE WHEN status='accepted' THEN floor(area+0.5) END),0) END AS BIGINT) AS total_area_sqm,
  floor(CASE WHEN bool_or(geo) THEN coalesce(sum(CASE WHEN status='accepted' THEN floor(area+0.5) END),0) END/10000e0*100+0.5)/100 AS total_area_hectares
  FROM facts WHERE status NOT IN ('Deleted','split') GROUP BY 1,2"""))
def a14(spark, d):
    measured = M.measure(M.active_working(D.parcels(spark, d), D.imagery(spark, d)))
    return R.verified_area(measured, ["project_id", "imagery_id"])


@query("a15_cascading_facets", """WITH pl AS (SELECT 'State '||n_regionkey AS state, n_name AS district, c_mktsegment AS taluka, 'Village '||(c_custkey%10) AS village FROM customer JOIN nation ON c_nationkey=n_nationkey)
  SELECT state, district, taluka, village, count(*) AS n, 4-(GROUPING(state)+GROUPING(district)+GROUPING(taluka)+GROUPING(village)) AS level FROM pl GROUP BY ROLLUP(state, district, taluka, village)""")
def a15(spark, d):
    c = D.table(spark, d, "customer").join(D.table(spark, d, "nation"), F.expr("c_nationkey = n_nationkey"))
    return R.cascading_facets(c.selectExpr("concat('State ', n_regionkey) AS state", "n_name AS district", "c_mktsegment AS taluka", "concat('Village ', c_custkey % 10) AS village"))


@query("a16_land_use_profile", sql("plots", body="""SELECT land_type, title_status, count(*) AS plots, floor((sum(area_acre)+1e-7)*100+0.5)/100 AS acres, floor((sum(area_acre)*40+1e-7)*10+0.5)/10 AS gunthas,
  floor(sum(area_acre)*4046.8564224e0/10000*100+0.5)/100 AS hectares, CAST(floor(sum(area_acre)*4046.8564224e0+0.5) AS BIGINT) AS sqm, CAST(GROUPING(land_type)*2+GROUPING(title_status) AS INT) AS grouping FROM plots GROUP BY CUBE(land_type, title_status)"""))
def a16(spark, d):
    return R.land_use_profile(D.plots(spark, d))
