"""Queries S, W and L: maintenance, history, search and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.audit import NO_AREA, REPORT, report_lines
from cadastre.catalog.measures import working
from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G
from cadastre.operators import history as H, maintain as T, measures as M, normalise as N, reports as R, search as Q
from cadastre.sources import derived as D, store as S


@query("s01_read_store", sql("parcels", "features", body="""SELECT 'parcels' AS table_name, count(*) AS n FROM parcels UNION ALL SELECT 'detectedFeatures', count(*) FROM features
  UNION ALL SELECT 'projects', 5 UNION ALL SELECT 'imagery', 0 UNION ALL SELECT 'verifications', 0 UNION ALL SELECT 'processingJobs', 0 UNION ALL SELECT 'parcel_versions', 0 UNION ALL SELECT 'activities', 0 UNION ALL SELECT 'users', 0"""))
def s01(spark, d):
    # documents of one entity each; the collections a document lacks read as empty
    p = D.parcels(spark, d).select(F.to_json(F.struct(F.array(F.struct("parcel_id", "project_id", "status", "confidence")).alias("parcels"))).alias("value"))
    f = D.features(spark, d).select(F.to_json(F.struct(F.array(F.struct("feature_id", "project_id", "detection_type", "confidence")).alias("detectedFeatures"))).alias("value"))
    j = D.projects(spark, d).select(F.to_json(F.struct(F.array(F.struct("project_id", "name")).alias("projects"))).alias("value"))
    tables = S.parse_store(p.unionByName(f).unionByName(j))
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, t in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s02_read_features_geojson", sql("fvertices", body="""SELECT feature_id, detection_type, CASE WHEN feature_id%97=0 THEN 0 ELSE CAST(count(*) AS INT) END AS points,
   CASE WHEN feature_id%97<>0 THEN sum(x) END AS sum_x, CASE WHEN feature_id%97<>0 THEN sum(y) END AS sum_y FROM fvertices GROUP BY 1,2"""))
def s02(spark, d):
    f = D.features(spark, d)
    flat = F.transform("pts", lambda p: F.array(p["x"], p["y"]))
    nested = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(flat).alias("coordinates")))
    plain = F.to_json(F.struct(F.lit("LineString").alias("type"), flat.alias("coordinates")))
    text = F.when(F.col("feature_id") % 97 == 0, '{"type":"Polygon","coordinates":"bad"}').when(F.col("is_line"), plain).otherwise(nested)
    parsed = S.parse_geometry(f.select("feature_id", "detection_type", text.alias("geometry")), "geometry")
    total = lambda c: F.aggregate("pts", F.lit(0.0), lambda acc, p: acc + p[c])
    has = F.size("pts") > 0
    return parsed.select("feature_id", "detection_type", F.size("pts").alias("points"), F.when(has, total("x")).alias("sum_x"), F.when(has, total("y")).alias("sum_y"))


@query("s03_register_imagery", sql("uploads", body="""SELECT upload_id, CASE WHEN size_bytes/1048576e0>=1 THEN printf('%.1f', floor(size_bytes/1048576e0*10+0.5)/10)||' MB' ELSE CAST(floor(size_bytes/1024e0+0.5) AS BIGINT)||' KB' END AS file_size,
  coalesce(width,4000) AS width, coalesce(height,3000) AS height, coalesce(flag_georeferenced, lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff') AS is_georeferenced,
  CASE WHEN coalesce(flag_georeferenced, lower(file_name) LIKE '%.tif' OR lower(file_name) LIKE '%.tiff') THEN 'geographic' ELSE 'image-space' END AS coordinate_mode, 'READY' AS status FROM uploads"""))
def s03(spark, d):
    return S.register_imagery(D.uploads(spark, d)).select("upload_id", "file_size", "width", "height", "is_georeferenced", "coordinate_mode", "status")


def chunks(spark, d):
    """Upload parts: the lines of an order, with gaps where lines are missing."""
    li = D.table(spark, d, "lineitem").selectExpr("l_orderkey AS session_id", "l_linenumber - 1 AS chunk_index", "l_partkey").groupBy("session_id", "chunk_index").agg(F.min("l_partkey").alias("part"))
    total = li.groupBy("session_id").agg((F.max("chunk_index") + 1 + (F.col("session_id") % 5 == 0).cast("int")).alias("total_chunks"))
    return li.join(total, "session_id").withColumn("data", F.encode(F.concat("chunk_index", F.lit(":"), "part", F.lit(";")), "UTF-8")).withColumn("size", F.octet_length("data"))


CHUNKS = """WITH li AS (SELECT l_orderkey AS session_id, l_linenumber-1 AS chunk_index, min(l_partkey) AS part FROM lineitem GROUP BY 1,2),
  c AS (SELECT *, chunk_index||':'||part||';' AS data, max(chunk_index) OVER (PARTITION BY session_id)+1+CASE WHEN session_id%5=0 THEN 1 ELSE 0 END AS total_chunks FROM li),
  g AS (SELECT session_id, count(DISTINCT chunk_index) AS received, max(total_chunks) AS total_chunks, max(chunk_index) AS last_index, sum(length(data)) AS total_size, string_agg(data,'' ORDER BY chunk_index) AS body FROM c GROUP BY 1)"""


@query("s04_assemble_chunks", CHUNKS + """ SELECT session_id, received, CAST(total_size AS BIGINT) AS total_size, received=total_chunks AND last_index+1=total_chunks AS is_complete,
  CASE WHEN received=total_chunks AND last_index+1=total_chunks THEN body END AS body FROM g""")
def s04(spark, d):
    c = chunks(spark, d)
    files = T.assemble_chunks(c).select("session_id", F.decode("data", "UTF-8").alias("body"))
    return T.chunk_sessions(c).join(files, "session_id", "left").select("session_id", "received", "total_size", "is_complete", "body")


@query("s05_replace_partition", sql("features", body="""SELECT feature_id, imagery_id, 'old' AS run_id FROM features WHERE imagery_id%4<>1
  UNION ALL SELECT feature_id+1, imagery_id, 'new' FROM features WHERE imagery_id%4=1 AND imagery_id<>5 AND is_valid"""))
def s05(spark, d):
    f = D.features(spark, d).select("feature_id", "project_id", "imagery_id", "is_valid")
    old = f.select("feature_id", "project_id", "imagery_id", F.lit("old").alias("run_id"))
    new = f.where("imagery_id % 4 = 1 AND imagery_id <> 5 AND is_valid").select((F.col("feature_id") + 1).alias("feature_id"), "project_id", "imagery_id", F.lit("new").alias("run_id"))
    cleared = f.where("imagery_id % 4 = 1").select("project_id", "imagery_id")
    return T.replace_rows(old, new, ["project_id", "imagery_id"], cleared).select("feature_id", "imagery_id", "run_id")


@query("s06_cascade_delete_imagery", sql("parcels", "features", "imagery", body="""SELECT 'imagery' AS table_name, imagery_id AS item_id FROM imagery WHERE imagery_id%6<>2 UNION ALL SELECT 'features', feature_id FROM features WHERE imagery_id%6<>2
  UNION ALL SELECT 'parcels', parcel_id FROM parcels WHERE imagery_id%6<>2 UNION ALL SELECT 'activities', imagery_id FROM imagery WHERE imagery_id%6=2"""))
def s06(spark, d):
    im = D.imagery(spark, d)
    tables = {"imagery": im, "features": D.features(spark, d), "parcels": D.parcels(spark, d)}
    out = T.cascade_delete_imagery(tables, im.where("imagery_id % 6 = 2"))
    keys = {"imagery": F.col("imagery_id"), "features": F.col("feature_id"), "parcels": F.col("parcel_id"), "activities": F.regexp_extract("description", "nation_(\\d+)", 1)}
    parts = [out[n].select(F.lit(n).alias("table_name"), k.cast("long").alias("item_id")) for n, k in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("s07_soft_delete", sql("parcels", "events_fx", body=""", v AS (SELECT parcel_id, count(*) AS n FROM events_fx GROUP BY 1)
  SELECT p.parcel_id, CASE WHEN p.parcel_id%10=3 THEN 'Deleted' ELSE status END AS status, CASE WHEN p.parcel_id%10=3 THEN coalesce(n,0)+1 END AS new_version FROM parcels p LEFT JOIN v USING (parcel_id)"""))
def s07(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "status")
    marked, appended = T.soft_delete(p, p.where("parcel_id % 10 = 3"), H.number_events(D.events(spark, d)))
    return marked.join(appended.select("parcel_id", F.col("version_number").alias("new_version")), "parcel_id", "left")


@query("s08_reset_seed", sql("parcels", body="""SELECT parcel_id, project_id FROM parcels WHERE project_id NOT IN (4) UNION ALL SELECT parcel_id+1000000, 4 FROM parcels WHERE project_id=4 AND status='accepted'"""))
def s08(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "project_id", "status")
    seed_parcels = p.where("project_id = 4 AND status = 'accepted'").withColumn("parcel_id", F.col("parcel_id") + 1000000)
    projects = D.projects(spark, d)
    out = T.reset_seed({"projects": projects, "parcels": p}, {"projects": projects.where("is_demo"), "parcels": seed_parcels})
    return out["parcels"].select("parcel_id", "project_id")


@query("s09_export_geojson", sql("facts", "projects", "events_fx", body=REPORT + f""" SELECT parcel_id, imagery_id, verification_status, floor(coalesce(confidence,0.85e0)*100+0.5)/100 AS confidence, CASE WHEN geo AND sqm>0 THEN sqm END AS area,
  CASE WHEN geo AND sqm>0 THEN format('{{:,}}', sqm)||' m²' ELSE {NO_AREA} END AS area_display, 'Polygon' AS geometry_type FROM rep WHERE status='accepted'"""))
def s09(spark, d):
    f = R.geojson_features(report_lines(spark, d))
    # read the exported text back, so that the JSON itself is checked
    return f.select(
        F.col("properties.parcel_id").alias("parcel_id"), F.col("properties.imagery_id").alias("imagery_id"),
        F.get_json_object("feature", "$.properties.verification_status").alias("verification_status"),
        F.get_json_object("feature", "$.properties.confidence").cast("double").alias("confidence"),
        F.get_json_object("feature", "$.properties.area").cast("long").alias("area"),
        F.get_json_object("feature", "$.properties.area_display").alias("area_display"), F.get_json_object("feature", "$.geometry.type").alias("geometry_type"),
    )


@query("s10_export_csv", sql("facts", "projects", "events_fx", body=REPORT + f""" SELECT CAST(parcel_id AS VARCHAR) AS parcel_id, CAST(project_id AS VARCHAR) AS project_id, CAST(imagery_id AS VARCHAR) AS imagery_id, status, verification_status,
  confidence_formatted AS confidence, 'AI Detection & Spatial Reasoning' AS source, CASE WHEN geo AND sqm>0 THEN sqm||' m²' ELSE {NO_AREA} END AS area, strftime(created_at,'%Y-%m-%dT%H:%M:%S') AS created_at,
  strftime(coalesce(v_ts,created_at),'%Y-%m-%dT%H:%M:%S') AS verified_at FROM rep"""))
def s10(spark, d):
    return R.csv_rows(report_lines(spark, d), scope="all")


@query("s11_export_layers", sql("features", body="""SELECT lower(detection_type) AS layer, feature_id FROM features WHERE is_valid"""))
def s11(spark, d):
    f = D.features(spark, d).where("is_valid")
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("feature_id").alias("id"), "detection_type"))
    return f.select(F.lower("detection_type").alias("layer"), F.get_json_object(text, "$.id").cast("long").alias("feature_id"))


@query("s12_export_package", sql("facts", "projects", "events_fx", body=REPORT + """ SELECT project_id, count(*) AS total_parcels, 'Cadastre_'||regexp_replace(any_value(project_name),'[^a-zA-Z0-9_-]','_','g')||'_Parcels' AS name,
  CASE WHEN bool_or(geo) THEN 'urn:ogc:def:crs:OGC:1.3:CRS84' ELSE 'urn:ogc:def:crs:OGC:1.0:PixelSpace' END AS crs FROM rep WHERE status='accepted' GROUP BY 1"""))
def s12(spark, d):
    f = R.geojson_features(report_lines(spark, d))
    return R.geojson_header(f, D.projects(spark, d)).select("project_id", "total_parcels", "name", "crs")


@query("s13_import_parcels", sql("facts", body="""SELECT parcel_id+500000 AS parcel_id, coalesce(confidence,0.85e0) AS confidence, CASE WHEN parcel_id%2=0 THEN status ELSE 'needs_review' END AS status, 'Manual / Imported' AS source,
  CASE WHEN geo THEN 0 ELSE CAST(floor(raw_area+0.5) AS BIGINT) END AS area_px, CASE WHEN geo THEN CAST(floor(area+0.5) AS BIGINT) ELSE 0 END AS area_sqm FROM facts
  UNION ALL SELECT parcel_id, confidence, status, NULL, NULL, NULL FROM facts"""))
def s13(spark, d):
    w = working(spark, d)
    rows = w.select((F.col("parcel_id") + 500000).alias("parcel_id"), "mode", "ring", "confidence", F.expr("CASE WHEN parcel_id%2=0 THEN status END").alias("status"), F.lit(None).cast("string").alias("source"))
    existing = w.select("parcel_id", "project_id", "confidence", "status")
    return T.import_parcels(existing, rows).select("parcel_id", "confidence", "status", "source", "area_px", "area_sqm")


@query("s15_upsert", sql("parcels", body=""", u AS (SELECT l_orderkey AS parcel_id, l_shipdate AS ts, l_partkey*100+l_suppkey AS seq, CASE WHEN l_linenumber%2=0 THEN 'status '||l_returnflag END AS status, CASE WHEN l_linenumber%3=0 THEN l_quantity/100e0 END AS confidence FROM lineitem),
  s AS (SELECT parcel_id, arg_max(status, ts::VARCHAR||lpad(seq::VARCHAR,12,'0')) AS status FROM u WHERE status IS NOT NULL GROUP BY 1), c AS (SELECT parcel_id, arg_max(confidence, ts::VARCHAR||lpad(seq::VARCHAR,12,'0')) AS confidence FROM u WHERE confidence IS NOT NULL GROUP BY 1),
  t AS (SELECT parcel_id, max(ts) AS ts FROM u GROUP BY 1)
  SELECT p.parcel_id, coalesce(s.status,p.status) AS status, coalesce(c.confidence,p.confidence) AS confidence, coalesce(t.ts,p.created_at) AS updated_at FROM parcels p LEFT JOIN s USING (parcel_id) LEFT JOIN c USING (parcel_id) LEFT JOIN t USING (parcel_id)"""))
def s15(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "status", "confidence", F.col("created_at").alias("updated_at"))
    u = D.table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS parcel_id", "l_shipdate AS ts", "l_partkey*100+l_suppkey AS seq", "CASE WHEN l_linenumber%2=0 THEN concat('status ', l_returnflag) END AS status",
        "CASE WHEN l_linenumber%3=0 THEN l_quantity/100e0 END AS confidence",
    )
    return T.upsert(p, u, ["parcel_id"], ["ts", "seq"], "updated_at")


@query("w01_append_versions", sql("events_fx", body="""SELECT event_id, parcel_id, row_number() OVER w AS version_number, upper(action) AS operation,
  CASE action WHEN 'Accepted' THEN 'accepted' WHEN 'Rejected' THEN 'rejected' WHEN 'Needs Review' THEN 'needs_review' ELSE 'vertex_edit' END AS change_type, lag(value) OVER w AS prev_value FROM events_fx WINDOW w AS (PARTITION BY parcel_id ORDER BY ts, event_id)"""))
def w01(spark, d):
    return D.versions(spark, d).select("event_id", "parcel_id", "version_number", "operation", "change_type", "prev_value")


@query("w02_version_history", sql("events_fx", body="""SELECT event_id, parcel_id, row_number() OVER (PARTITION BY parcel_id ORDER BY ts, event_id) AS version_number,
  row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, event_id DESC) AS recency FROM events_fx"""))
def w02(spark, d):
    return H.version_history(D.versions(spark, d)).select("event_id", "parcel_id", "version_number", "recency")


@query("w03_parcel_timeline", sql("parcels", "events_fx", body=""", v AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts, event_id) AS version_number FROM events_fx)
  SELECT parcel_id, 'version' AS entry_type, event_id AS entry_id, version_number, action, ts FROM v UNION ALL SELECT p.parcel_id, 'version', event_id, version_number, action, ts FROM parcels p JOIN v ON v.parcel_id=p.parent_parcel_id
  UNION ALL SELECT parcel_id, 'verification', event_id, NULL, action, ts FROM events_fx"""))
def w03(spark, d):
    return H.timeline(D.parcels(spark, d), D.versions(spark, d), D.events(spark, d))


@query("w04_current_state", sql("parcels", "events_fx", body=""", l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY parcel_id) AS n FROM events_fx) t WHERE rn=1)
  SELECT p.parcel_id, CASE l.action WHEN 'Accepted' THEN 'accepted' WHEN 'Edited' THEN 'accepted' WHEN 'Rejected' THEN 'rejected' WHEN 'Needs Review' THEN 'needs_review' ELSE p.status END AS current_status, l.ts AS reviewed_at, coalesce(n,0) AS review_count, l.event_id AS last_event_id FROM parcels p LEFT JOIN l USING (parcel_id)"""))
def w04(spark, d):
    return H.current_state(D.parcels(spark, d), D.events(spark, d)).select("parcel_id", "current_status", "reviewed_at", "review_count", "last_event_id")


@query("w05_first_verification", sql("events_fx", body="SELECT parcel_id, event_id, action, ts FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY event_id) AS rn FROM events_fx) t WHERE rn=1"))
def w05(spark, d):
    return H.first_verification(D.events(spark, d))


PARENT = "CASE WHEN parcel_id%83=0 AND parcel_id%664<>0 THEN parcel_id-83 WHEN parcel_id%7=3 THEN parcel_id-1 END"


@query("w06_lineage", sql("parcels", recursive=True, body=f""", e AS (SELECT parcel_id, {PARENT} AS parent FROM parcels),
  r AS (SELECT parcel_id, parcel_id AS root_id, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.parcel_id, r.root_id, r.depth+1 FROM e JOIN r ON e.parent=r.parcel_id),
  c AS (SELECT parent AS parcel_id, count(*) AS n FROM e WHERE parent IS NOT NULL GROUP BY 1)
  SELECT r.parcel_id, root_id, depth, coalesce(n,0) AS n_children FROM r LEFT JOIN c USING (parcel_id)"""))
def w06(spark, d):
    return H.lineage(D.parcels(spark, d).select("parcel_id", F.expr(PARENT).alias("parent_parcel_id")))


@query("w11_renumber_parcels", sql("parcels", "projects", body=""", n AS (SELECT parcel_id, project_id, row_number() OVER (PARTITION BY project_id ORDER BY parcel_id) AS k FROM parcels WHERE status NOT IN ('Deleted','split'))
  SELECT parcel_id, CASE WHEN is_demo THEN 'PM-' ELSE 'PM-'||right(regexp_replace(name,'[^a-zA-Z0-9]','','g'),6)||'-' END||CASE WHEN k<10000 THEN lpad(CAST(k AS VARCHAR),4,'0') ELSE CAST(k AS VARCHAR) END AS new_id FROM n JOIN projects USING (project_id)"""))
def w11(spark, d):
    return H.renumber(N.active_parcels(D.parcels(spark, d)).select("parcel_id", "project_id"), D.projects(spark, d)).select("parcel_id", "new_id")


@query("w12_cap_per_class", sql("features", body="""SELECT imagery_id, detection_type, feature_id FROM (SELECT *, row_number() OVER (PARTITION BY imagery_id, detection_type ORDER BY CASE WHEN detection_type='BUILDING' THEN -confidence ELSE 0e0 END, feature_id) AS rn FROM features WHERE detection_type NOT IN ('WALL','FENCE')) t
  WHERE rn<=CASE detection_type WHEN 'BUILDING' THEN 30 WHEN 'WATER' THEN 10 ELSE 16 END"""))
def w12(spark, d):
    return H.cap_per_class(D.features(spark, d).drop("pts")).select("imagery_id", "detection_type", "feature_id")


SEARCHES = ["parcel #12", "Plot #7", "accepted", "taluka 3", "survey 5/3", "rural", "junk-free", "Surveyor 4"]


def searchable(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "project_id", "status")
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("parcel_id"), F.col("text").alias("comments"))
    k = F.col("parcel_id")
    return p.join(docs, "parcel_id", "left").select(
        "*", F.expr("concat(parcel_id % 97, '/', parcel_id % 7)").alias("survey_no"), F.concat(F.lit("Road-"), k % 50).alias("features_text"), F.concat(F.lit("Surveyor "), k % 7).alias("reviewer")
    )


@query("l01_search_parcels", sql("parcels", "projects", body=f""", qs AS (SELECT * FROM (VALUES ('parcel #12','parcel #12','12'),('Plot #7','plot #7','7'),('accepted','accepted','accepted'),('taluka 3','taluka 3','taluka 3'),('survey 5/3','survey 5/3','5/3'),('rural','rural','rural'),('junk-free','junk-free','junk-free'),('Surveyor 4','surveyor 4','or 4')) t(query,q,c)),
  s AS (SELECT p.parcel_id, p.project_id, p.status, (p.parcel_id%97)||'/'||(p.parcel_id%7) AS survey_no, 'road-'||(p.parcel_id%50) AS feats, 'surveyor '||(p.parcel_id%7) AS reviewer, lower(d.text) AS comments FROM parcels p LEFT JOIN documents d ON d.doc_id=p.parcel_id WHERE p.status<>'Deleted'),
  m AS (SELECT query, s.parcel_id, is_demo, CAST(s.parcel_id AS VARCHAR)=c AS en, survey_no=c AS es FROM s JOIN projects j USING (project_id) CROSS JOIN qs WHERE contains(CAST(s.parcel_id AS VARCHAR), c) OR contains(CAST(s.parcel_id AS VARCHAR), q) OR contains(lower(s.status), q) OR contains(lower(j.name), q)
    OR contains(lower(j.location), q) OR contains(lower(j.project_type), q) OR contains(feats, q) OR contains(reviewer, q) OR coalesce(contains(comments, q), false)),
  r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY en DESC, es DESC, is_demo, parcel_id) AS rank, count(*) OVER (PARTITION BY query) AS total FROM m)
  SELECT query, CAST(rank AS INT) AS rank, parcel_id, total, total>8 AS has_more FROM r WHERE rank<=8""".replace("'or 4'", "'surveyor 4'")))
def l01(spark, d):
    return Q.search_parcels(searchable(spark, d), D.projects(spark, d), SEARCHES).select("query", "rank", "parcel_id", "total", "has_more")


@query("l02_search_plots", sql("plots", body=""", qs AS (SELECT * FROM (VALUES ('104A','104a','104a'),('Survey 41/6','survey 41/6','41/6'),('416','416','416'),('customer#000000012','customer#000000012','customer#000000012'),('village 7','village 7','village 7')) t(query,q,c)),
  r AS (SELECT query, plot_id, row_number() OVER (PARTITION BY query ORDER BY plot_id) AS rank FROM plots CROSS JOIN qs WHERE contains(lower(plot_no), c) OR contains(survey_no, c) OR contains(replace(survey_no,'/',''), c) OR contains(lower(owner), q) OR contains(lower(village), q))
  SELECT query, plot_id, CAST(rank AS INT) AS rank FROM r WHERE rank<=12"""))
def l02(spark, d):
    return Q.search_plots(D.plots(spark, d), ["104A", "Survey 41/6", "416", "customer#000000012", "village 7"]).select("query", "plot_id", "rank")


@query("l03_plot_by_id", sql("plots", body="""SELECT o_custkey AS request_id, p.plot_id, p.land_type FROM (SELECT DISTINCT o_custkey FROM orders) o JOIN plots p ON lower(p.plot_no)=o.o_custkey||CASE WHEN o.o_custkey%10=4 THEN 'a' ELSE '' END"""))
def l03(spark, d):
    ids = D.table(spark, d, "orders").select("o_custkey").distinct().select(
        F.col("o_custkey").alias("request_id"),
        F.concat(F.when(F.col("o_custkey") % 2 == 0, "Plot-").otherwise("parcel-"), "o_custkey", F.when(F.col("o_custkey") % 10 == 4, "a").otherwise("")).alias("request"),
    )
    return Q.plot_by_id(D.plots(spark, d), ids).select("request_id", "plot_id", "land_type")


@query("l04_activity_feed", sql("activities", body="SELECT project_id, activity_id, type, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ts DESC, activity_id DESC) AS rn FROM activities) t WHERE rn<=10"))
def l04(spark, d):
    return R.activity_feed(D.activities(spark, d), 10).select("project_id", "activity_id", "type", "rank")


@query("l05_verification_timeline", sql("parcels", "events_fx", body="SELECT e.event_id, e.parcel_id, p.project_id, e.action, e.ts FROM events_fx e JOIN parcels p USING (parcel_id) WHERE p.status<>'Deleted' ORDER BY e.ts DESC, e.event_id DESC"))
def l05(spark, d):
    live = D.parcels(spark, d).where("status <> 'Deleted'").select("parcel_id", "project_id")
    return D.events(spark, d).join(live, "parcel_id").select("event_id", "parcel_id", "project_id", "action", "ts").orderBy(F.desc("ts"), F.desc("event_id"))


@query("l06_boundary_union", sql("features", body="SELECT DISTINCT feature_id, imagery_id FROM features WHERE detection_type IN ('WALL','FENCE')"))
def l06(spark, d):
    f = D.features(spark, d)
    lines = f.where("detection_type = 'WALL'").unionByName(f.where("detection_type = 'FENCE'")).unionByName(f.where("detection_type IN ('WALL', 'FENCE') AND fw % 2 = 0"))
    return lines.dropDuplicates(["feature_id"]).select("feature_id", "imagery_id")


@query("l07_top_rejections", sql("rejections", body="SELECT imagery_id, item_id, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY imagery_id ORDER BY item_id) AS rn FROM rejections) t WHERE rn<=50"))
def l07(spark, d):
    return R.top_rejections(D.rejections(spark, d)).select("imagery_id", "item_id", "rank")


@query("l08_jobs_by_project", sql("jobs", body="SELECT job_id, status, progress, started_at FROM jobs WHERE project_id=3 UNION ALL SELECT job_id, status, progress, started_at FROM jobs WHERE job_id=77"))
def l08(spark, d):
    j = D.jobs(spark, d)
    return j.where("project_id = 3").unionByName(j.where("job_id = 77")).select("job_id", "status", "progress", "started_at")


@query("l09_lookups", sql("uploads", "events_fx", body="SELECT 'upload' AS kind, upload_id AS item_id FROM uploads WHERE project_id=1 UNION ALL SELECT 'verification', event_id FROM events_fx WHERE parcel_id=42"))
def l09(spark, d):
    u = D.uploads(spark, d).where("project_id = 1").select(F.lit("upload").alias("kind"), F.col("upload_id").alias("item_id"))
    return u.unionByName(D.events(spark, d).where("parcel_id = 42").select(F.lit("verification").alias("kind"), F.col("event_id").alias("item_id")))


@query("d13_detection_run_write", sql("features", body="""SELECT imagery_id, count(*) AS stored, count(*) AS written, count(*) AS persisted, 'DETECTION COMPLETE' AS processing_status FROM features GROUP BY 1
  UNION ALL SELECT imagery_id+1000, count(*), NULL, NULL, NULL FROM features GROUP BY 1"""))
def d13(spark, d):
    found = D.features(spark, d).select("feature_id", "imagery_id")
    # the table holds older rows of the run's images, which it replaces, and images of their own, which stay
    older, others = F.col("imagery_id"), F.col("imagery_id") + 1000
    table = found.select((-1 - F.col("feature_id")).alias("feature_id"), F.explode(F.array(older, others)).alias("imagery_id")).withColumn("project_id", F.col("imagery_id") % 5)
    merged, counts = T.detection_run(table, found, F.col("imagery_id") % 5, "run_1")
    stored = merged.groupBy("imagery_id").agg(F.count("*").alias("stored"))
    return stored.join(counts, "imagery_id", "left").select("imagery_id", "stored", "written", "persisted", "processing_status")
