"""Queries M01-M09, M14, M15, M19 and the sliver and confidence reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G
from cadastre.operators import measures as M
from cadastre.operators.normalise import geo_project
from cadastre.sources import derived as D


def working(spark, d):
    return M.working_geometry(D.parcels(spark, d), D.imagery(spark, d))


def validated(spark, d):
    """Active parcels with shape facts and validity."""
    return M.validate(M.shape_facts(M.active_working(D.parcels(spark, d), D.imagery(spark, d))))


@query("m01_measure", sql("facts", body="""SELECT parcel_id, CASE WHEN geo THEN 'geographic' ELSE 'image' END AS mode,
  CASE WHEN geo THEN 0 ELSE CAST(floor(raw_area+0.5) AS BIGINT) END AS area_px, CASE WHEN geo THEN CAST(floor(area+0.5) AS BIGINT) ELSE 0 END AS area_sqm,
  CASE WHEN geo THEN floor(area/10000*100+0.5)/100 ELSE 0e0 END AS area_hectares,
  CASE WHEN geo THEN floor(area/4046.8564224e0*100+0.5)/100 ELSE 0e0 END AS area_acres FROM facts"""))
def m01(spark, d):
    return M.measure(working(spark, d)).select("parcel_id", "mode", "area_px", "area_sqm", "area_hectares", "area_acres")


@query("m02_planar_area", sql("edges", body="SELECT parcel_id, abs(sum(x1*y2-x2*y1))/2 AS area_px FROM edges GROUP BY 1"))
def m02(spark, d):
    return D.parcels(spark, d).select("parcel_id", G.planar_area(F.col("ring")).alias("area_px"))


@query("m03_perimeter", sql("edges", "fedges", body="""SELECT 'parcel' AS kind, parcel_id AS item_id, floor(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))*1000+0.5)/1000 AS length_px FROM edges GROUP BY 2
  UNION ALL SELECT 'line', feature_id, floor(sum(sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))*1000+0.5)/1000 FROM fedges WHERE detection_type IN ('ROAD','WALL','FENCE') GROUP BY 2"""))
def m03(spark, d):
    def length(c):
        return G.js_round(G.planar_length(F.col(c)), 3).alias("length_px")

    p = D.parcels(spark, d).select(F.lit("parcel").alias("kind"), F.col("parcel_id").alias("item_id"), length("ring"))
    f = D.features(spark, d).where("is_line").select(F.lit("line").alias("kind"), F.col("feature_id").alias("item_id"), length("pts"))
    return p.unionByName(f)


@query("m04_geodesic", sql("imagery", "features", body=""", g AS (SELECT feature_id, lng, lat, lead(lng) OVER w AS lng2, lead(lat) OVER w AS lat2 FROM (
   SELECT f.feature_id, k.i, floor((m.lng+((CASE WHEN k.i IN (1,2) THEN fx+fw ELSE fx END)/4000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lng,
     floor((m.lat-((CASE WHEN k.i IN (2,3) THEN fy+fh ELSE fy END)/3000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lat
   FROM features f JOIN imagery m USING (imagery_id) CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS k(i)
   WHERE k.i <= CASE WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 2 ELSE 4 END) v WINDOW w AS (PARTITION BY feature_id ORDER BY i)),
  h AS (SELECT *, pow(sin(radians(lat2-lat)/2),2)+cos(radians(lat))*cos(radians(lat2))*pow(sin(radians(lng2-lng)/2),2) AS a FROM g WHERE lng2 IS NOT NULL)
  SELECT feature_id, floor(sum(2*6371008.8e0*atan2(sqrt(a),sqrt(1-a)))*100+0.5)/100 AS length_m,
   CASE WHEN any_value(detection_type) IN ('ROAD','WALL','FENCE') THEN NULL ELSE
     floor(abs(sum(radians(lng2-lng)*(sin(radians(lat))+sin(radians(lat2)))))/2*6371008.8e0*6371008.8e0*10+0.5)/10 END AS area_sqm
  FROM h JOIN features USING (feature_id) GROUP BY 1"""))
def m04(spark, d):
    f = geo_project(D.features(spark, d).select("feature_id", "imagery_id", "is_line", "pts"), D.imagery(spark, d))
    return f.select(
        "feature_id",
        G.js_round(G.geodesic_length(F.col("geo_pts")), 2).alias("length_m"),
        F.when(~F.col("is_line"), G.js_round(G.geodesic_area(F.col("geo_pts")), 1)).alias("area_sqm"),
    )


@query("m05_compactness", sql("facts", body="SELECT parcel_id, floor(raw_comp*100000+0.5)/100000 AS compactness FROM facts"))
def m05(spark, d):
    f = M.shape_facts(working(spark, d))
    return f.select("parcel_id", G.js_round(F.col("raw_compactness"), 5).alias("compactness"))


@query("m06_centroid_bbox", sql("vertices", body=""", v AS (SELECT v.* FROM vertices v JOIN parcels p USING (parcel_id) WHERE NOT (p.shape<>'open' AND v.seq=CASE WHEN p.shape='dupvertex' THEN 5 ELSE 4 END))
  SELECT parcel_id, floor(avg(x)*10000+0.5)/10000 AS cx, floor(avg(y)*10000+0.5)/10000 AS cy, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax,
   max(x)-min(x) AS width, max(y)-min(y) AS height, floor(greatest(max(x)-min(x),max(y)-min(y))/greatest(1,least(max(x)-min(x),max(y)-min(y)))*10000+0.5)/10000 AS aspect FROM v GROUP BY 1"""))
def m06(spark, d):
    p = D.parcels(spark, d).select("parcel_id", G.vertex_centroid(F.col("ring")).alias("c"), G.bbox(F.col("ring")).alias("b"))
    w, h = F.col("b.xmax") - F.col("b.xmin"), F.col("b.ymax") - F.col("b.ymin")
    return p.select(
        "parcel_id", G.js_round(F.col("c.x"), 4).alias("cx"), G.js_round(F.col("c.y"), 4).alias("cy"), "b.xmin", "b.ymin", "b.xmax", "b.ymax",
        w.alias("width"), h.alias("height"), G.js_round(F.greatest(w, h) / F.greatest(F.lit(1.0), F.least(w, h)), 4).alias("aspect"),
    )


@query("m07_repair_rings", sql("rvertices", body="""SELECT p.parcel_id, CASE WHEN shape='dupvertex' THEN 1 ELSE 0 END AS removed_vertices, shape='open' AS was_open,
  CAST(count(*) AS INT) AS vertex_count FROM parcels p JOIN rvertices v USING (parcel_id) GROUP BY 1,2,3"""))
def m07(spark, d):
    r = M.repair_rings(D.parcels(spark, d))
    return r.select("parcel_id", "removed_vertices", "was_open", F.size("clean").alias("vertex_count"))


@query("m08_self_intersections", sql("redges", body="""SELECT a.parcel_id, CAST(count(*) AS INT) AS kinks FROM redges a JOIN redges b ON a.parcel_id=b.parcel_id AND b.seq>=a.seq+2
  JOIN (SELECT parcel_id, max(seq) AS last FROM redges GROUP BY 1) l ON l.parcel_id=a.parcel_id WHERE NOT (a.seq=0 AND b.seq=l.last)
  AND ((b.y2-a.y1)*(b.x1-a.x1)>(b.y1-a.y1)*(b.x2-a.x1)) <> ((b.y2-a.y2)*(b.x1-a.x2)>(b.y1-a.y2)*(b.x2-a.x2))
  AND ((b.y1-a.y1)*(a.x2-a.x1)>(a.y2-a.y1)*(b.x1-a.x1)) <> ((b.y2-a.y1)*(a.x2-a.x1)>(a.y2-a.y1)*(b.x2-a.x1)) GROUP BY 1"""))
def m08(spark, d):
    r = M.repair_rings(D.parcels(spark, d))
    return r.select("parcel_id", G.self_intersections(F.col("clean")).alias("kinks")).where("kinks > 0")


@query("m09_validate_parcels", sql("facts", body="""SELECT parcel_id, valid,
  concat_ws('; ', CASE WHEN kinks>0 THEN CASE WHEN geo THEN 'Polygon self-intersects (contains '||kinks||' intersection kinks).' ELSE 'Polygon boundary contains '||kinks||' self-intersecting segments.' END END,
    CASE WHEN area<=0.0001 THEN 'Polygon area must be greater than zero.' END) AS errors,
  concat_ws('; ', CASE WHEN shape='dupvertex' THEN 'Removed 1 duplicate consecutive vertices.' END, CASE WHEN shape='open' THEN 'Unclosed polygon ring was automatically closed.' END,
    CASE WHEN area>0.0001 THEN CASE WHEN area<CASE WHEN geo THEN 50 ELSE 600 END THEN
      CASE WHEN geo THEN 'Polygon area is very small ('||CAST(floor(area+0.5) AS BIGINT)||' m²).' ELSE 'Polygon is extremely small ('||CAST(floor(area+0.5) AS BIGINT)||' px²).' END
      WHEN comp<0.05e0 THEN 'High perimeter-to-area ratio (elongated sliver).' END END) AS warnings
  FROM facts WHERE status NOT IN ('Deleted','split')"""))
def m09(spark, d):
    return validated(spark, d).select(
        "parcel_id", "valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings")
    )


@query("m14_jagged_score", sql("parcels", body=""", s AS (SELECT * FROM (VALUES (0,0,0),(1,10,10),(2,20,0),(3,30,10),(4,40,0),(5,50,10),(6,50,40),(7,0,40)) t(i,dx,dy)),
  q AS (SELECT * FROM (VALUES (0,0,0),(1,50,0),(2,50,40),(3,0,40)) t(i,dx,dy)),
  v AS (SELECT parcel_id, i, 8 AS n, (x0+dx)*CASE WHEN parcel_id%3=2 THEN 8 ELSE 1 END AS x, (y0+dy)*CASE WHEN parcel_id%3=2 THEN 8 ELSE 1 END AS y FROM parcels, s WHERE parcel_id%3<>0
        UNION ALL SELECT parcel_id, i, 4, x0+dx, y0+dy FROM parcels, q WHERE parcel_id%3=0),
  t AS (SELECT b.parcel_id, b.i, b.x-a.x AS ax, b.y-a.y AS ay, c.x-b.x AS bx, c.y-b.y AS cy FROM v b JOIN v a ON a.parcel_id=b.parcel_id AND a.i=(b.i+b.n-1)%b.n
        JOIN v c ON c.parcel_id=b.parcel_id AND c.i=(b.i+1)%b.n),
  k AS (SELECT parcel_id, i, sign(ax*cy-ay*bx) AS s FROM t WHERE sqrt(ax*ax+ay*ay)<60 AND sqrt(bx*bx+cy*cy)<60 AND abs(ax*cy-ay*bx)>10),
  f AS (SELECT parcel_id, CASE WHEN s<>lag(s) OVER (PARTITION BY parcel_id ORDER BY i) THEN 1 ELSE 0 END AS flip FROM k),
  g AS (SELECT parcel_id, CAST(sum(flip) AS INT) AS n FROM f GROUP BY 1)
  SELECT p.parcel_id AS ring_id, coalesce(n,0) AS jagged_score, coalesce(n,0)>=3 AS is_jagged FROM parcels p LEFT JOIN g USING (parcel_id)"""))
def m14(spark, d):
    # saw-tooth, plain and large rings around the parcel corner
    p = D.parcels(spark, d)
    x, y, k = F.col("x0"), F.col("y0"), F.col("parcel_id") % 3
    saw = G.ring((x, y), (x + 10, y + 10), (x + 20, y), (x + 30, y + 10), (x + 40, y), (x + 50, y + 10), (x + 50, y + 40), (x, y + 40), (x, y))
    plain = G.ring((x, y), (x + 50, y), (x + 50, y + 40), (x, y + 40), (x, y))
    large = F.transform(saw, lambda q: G.point(q["x"] * 8, q["y"] * 8))
    r = p.select(F.col("parcel_id").alias("ring_id"), F.when(k == 0, plain).when(k == 1, saw).otherwise(large).alias("ring"))
    return M.jagged_score(r).select("ring_id", "jagged_score", "is_jagged")


@query("m15_axis_aligned_box_flag", sql("features", "parcels", body="""SELECT 'feature' AS kind, feature_id AS item_id, detection_type NOT IN ('ROAD','WALL','FENCE') AS is_box FROM features
  UNION ALL SELECT 'parcel', parcel_id, shape='quad' AND h>5 FROM parcels"""))
def m15(spark, d):
    f = D.features(spark, d).select(F.lit("feature").alias("kind"), F.col("feature_id").alias("item_id"), M.axis_aligned_box(F.col("pts")).alias("is_box"))
    p = D.parcels(spark, d).select(F.lit("parcel").alias("kind"), F.col("parcel_id").alias("item_id"), M.axis_aligned_box(F.col("ring")).alias("is_box"))
    return f.unionByName(p)


@query("m19_turning_angle_filter", sql("features", body="""SELECT feature_id, 135e0 AS turn_degrees FROM features
  WHERE detection_type IN ('ROAD','WALL','FENCE') AND feature_id%2=0 AND fw>2"""))
def m19(spark, d):
    # even lines get a doubled-back tail; the others keep their right angle
    f = D.features(spark, d)
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "fw", "fh"))
    tail = G.ring((x, y), (x + w, y), (x + w - h - 3, y + h + 3))
    f = f.withColumn("pts", F.when(F.col("feature_id") % 2 == 0, tail).otherwise(F.col("pts")))
    return M.erratic_lines(f).select("feature_id", G.js_round(F.col("turn"), 3).alias("turn_degrees"))


@query("a02_sliver_report", sql("slivers", body="""SELECT parcel_id, imagery_id, CAST(floor(raw_area+0.5) AS BIGINT) AS area, CAST(floor(raw_len+0.5) AS BIGINT) AS perimeter,
  CASE WHEN raw_area<CASE WHEN geo THEN 60 ELSE 800 END THEN 'Tiny sliver polygon ('||CAST(floor(raw_area+0.5) AS BIGINT)||CASE WHEN geo THEN ' m² < 60 m²)' ELSE ' px²)' END
   ELSE 'High perimeter-to-area sliver ratio' END AS reason FROM slivers"""))
def a02(spark, d):
    return M.sliver_report(validated(spark, d)).select("parcel_id", "imagery_id", "area", "perimeter", "reason")


@query("a03_confidence_bands", sql("parcels", body="""SELECT project_id, imagery_id, count(CASE WHEN coalesce(confidence,0.8)>=0.8 THEN 1 END) AS high,
  count(CASE WHEN coalesce(confidence,0.8)>=0.6 AND coalesce(confidence,0.8)<0.8 THEN 1 END) AS medium, count(CASE WHEN coalesce(confidence,0.8)<0.6 THEN 1 END) AS low
  FROM parcels WHERE status NOT IN ('Deleted','split') GROUP BY 1,2"""))
def a03(spark, d):
    from cadastre.operators.normalise import active_parcels

    return M.confidence_bands(active_parcels(D.parcels(spark, d)), ["project_id", "imagery_id"])
