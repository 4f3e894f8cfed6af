"""Queries D01-D14, J15 and the ring rebuilding operators M10-M25."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.joins import dist_sql, features_of, valid_parcels
from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G, rings as S
from cadastre.operators import detect as T, history as H, joins as J, measures as M, normalise as N, repair as P
from cadastre.sources import derived as D


def total(path, axis):
    return F.aggregate(path, F.lit(0.0), lambda acc, p: acc + p[axis])


def greedy_sql(rounds: int = 16) -> str:
    """CTE ``dropped(id)`` of the sequential selection over ``pairs(s, w)``, unrolled."""
    out = ", g0 AS MATERIALIZED (SELECT DISTINCT s, w FROM pairs)"
    for i in range(rounds):
        out += f", k{i} AS MATERIALIZED (SELECT DISTINCT w FROM g{i} WHERE s NOT IN (SELECT w FROM g{i})), g{i + 1} AS MATERIALIZED (SELECT * FROM g{i} WHERE w NOT IN (SELECT w FROM k{i}) AND s NOT IN (SELECT w FROM k{i}))"
    return out + ", dropped AS MATERIALIZED (" + " UNION ".join(f"SELECT w AS id FROM k{i}" for i in range(rounds)) + ")"


@query("m10_simplify", sql("features", body="""SELECT feature_id, 3 AS points, CAST(3*fx+2*fw AS DOUBLE) AS sum_x, CAST(3*fy+fh AS DOUBLE) AS sum_y FROM features WHERE detection_type IN ('ROAD','WALL','FENCE')"""))
def m10(spark, d):
    # noisy lines: inner points one pixel off both legs
    f = D.features(spark, d).where("is_line")
    x, y, w, h = (F.col(c) for c in ("fx", "fy", "fw", "fh"))
    legs = [(x, y), (x + w * 0.25, y + 1), (x + w * 0.5, y - 1), (x + w * 0.75, y + 1), (x + w, y), (x + w + 1, y + h * 0.25), (x + w - 1, y + h * 0.5), (x + w + 1, y + h * 0.75), (x + w, y + h)]
    s = T.simplify(f.withColumn("pts", G.ring(*legs)))
    return s.select("feature_id", F.size("pts").alias("points"), total("pts", "x").alias("sum_x"), total("pts", "y").alias("sum_y"))


def quads(spark, d, dense=False, grow=0):
    x, y, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    a, b, c, e = (x, y), (x + w, y), (x + w, y + h), (x + 5, y + h)

    def mid(p, q):
        return ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)

    ring = G.ring(a, mid(a, b), b, mid(b, c), c, mid(c, e), e, mid(e, a), a) if dense else G.ring(a, b, c, e, a)
    return D.parcels(spark, d).withColumn("ring", ring)


@query("m11_simplify_closed_ring", sql("parcels", body="""SELECT parcel_id, CAST(3+CASE WHEN w*h/sqrt(w*w+h*h)>3 THEN 1 ELSE 0 END+CASE WHEN (w-5)*h/sqrt(w*w+h*h)>3 THEN 1 ELSE 0 END AS INT) AS points FROM parcels"""))
def m11(spark, d):
    return quads(spark, d, dense=True).select("parcel_id", F.size(S.simplified_ring(F.col("ring"), 3.0)).alias("points"))


@query("m12_regularize_ring", sql("parcels", body=""", t AS (SELECT parcel_id, w*h/sqrt(w*w+h*h)>12 AS a, (w-5)*h/sqrt(w*w+h*h)>12 AS b, h/sqrt(w*w+h*h)>0.85e0 AND h<40 AS spike FROM parcels)
  SELECT parcel_id, CASE WHEN a AND NOT b AND NOT spike THEN 4 ELSE 5 END AS points FROM t"""))
def m12(spark, d):
    return quads(spark, d).select("parcel_id", F.size(S.regularised(F.col("ring"), 12.0)).alias("points"))


@query("m13_despike_contour", sql("parcels", body="SELECT parcel_id, 5 AS points, CAST((100+w)*(60+h) AS DOUBLE) AS area FROM parcels"))
def m13(spark, d):
    x, y, w, h = F.col("x0"), F.col("y0"), F.col("w") + 100, F.col("h") + 60
    mid = x + w / 2
    spiked = G.ring((x, y), (x + w, y), (x + w, y + h), (mid + 1.5, y + h), (mid, y + h + 60), (mid - 1.5, y + h), (x, y + h), (x, y))
    p = D.parcels(spark, d).select("parcel_id", G.despiked(spiked, 50.0).alias("ring"))
    return p.select("parcel_id", F.size("ring").alias("points"), G.planar_area(F.col("ring")).alias("area"))


@query("m16_convex_hull", sql("parcels", body="SELECT parcel_id, CASE WHEN shape='bowtie' THEN CAST(w*h AS DOUBLE) ELSE (2*w-5)*h/2e0 END AS area FROM parcels"))
def m16(spark, d):
    from cadastre.operators.grid import vertices

    pts = vertices(D.parcels(spark, d).select("parcel_id", "ring"), "ring")
    return P.group_hulls(pts, ["parcel_id"]).select("parcel_id", G.planar_area(F.col("ring")).alias("area"))


@query("m17_solidity", sql("features", body="""SELECT feature_id, 1e0 AS solidity, floor(greatest(fw,fh)/CAST(least(fw,fh) AS DOUBLE)*10000+0.5)/10000 AS aspect FROM features WHERE detection_type NOT IN ('ROAD','WALL','FENCE')"""))
def m17(spark, d):
    f = D.features(spark, d).where("NOT is_line").withColumn("o", S.outline_stats(F.col("pts")))
    return f.select(
        "feature_id", G.js_round(G.planar_area(F.col("pts")) / F.greatest(F.lit(1.0), F.col("o.hull_area")), 6).alias("solidity"),
        G.js_round(F.col("o.rect_long") / F.greatest(F.lit(1.0), F.col("o.rect_short")), 4).alias("aspect"),
    )


@query("m18_rectify_buildings", sql("parcels", body="SELECT parcel_id, CASE WHEN degrees(atan2(5,h))<=22 THEN CAST(w*h AS DOUBLE) ELSE (2*w-5)*h/2e0 END AS area FROM parcels"))
def m18(spark, d):
    return quads(spark, d).select("parcel_id", G.js_round(G.planar_area(S.squared(F.col("ring"), 22.0)), 3).alias("area"))


@query("m20_split_parcels", sql("parcels", body="""SELECT parcel_id, CASE WHEN w>h THEN w/2e0*h ELSE (2*w-2.5e0)/2*h/2 END AS area_a, CASE WHEN w>h THEN (2*w-5)*h/2e0-w/2e0*h ELSE (2*w-7.5e0)/2*h/2 END AS area_b, NULL AS split_error
  FROM parcels WHERE shape<>'bowtie' UNION ALL SELECT parcel_id, CASE WHEN w<=h THEN w*h/4e0 END, CASE WHEN w<=h THEN w*h/4e0 END, CASE WHEN w>h THEN 'Invalid split line — draw a line that crosses the selected parcel.' END FROM parcels WHERE shape='bowtie'"""))
def m20(spark, d):
    p = M.repair_rings(D.parcels(spark, d)).withColumn("cut", F.lit(None).cast("array<struct<x:double,y:double>>"))
    s = P.split_rings(p)
    areas = [F.when(F.col("split_error").isNull(), G.js_round(G.planar_area(F.col(r)), 4)).alias(a) for r, a in (("ring_a", "area_a"), ("ring_b", "area_b"))]
    return s.select("parcel_id", *areas, "split_error")


@query("m21_merge_parcels", sql("parcels", body="""SELECT parcel_id, CASE parcel_id%3 WHEN 0 THEN (2*w-5)*h/2e0+30*h WHEN 1 THEN (2*w-5)*h/2e0+20*h ELSE (2*(w+55)-5)*h/2e0 END AS area FROM parcels"""))
def m21(spark, d):
    x, y, w, h, k = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.col("parcel_id") % 3
    left = x + w + F.when(k == 0, 0).when(k == 1, -10).otherwise(25)
    other = G.ring((left, y), (left + 30, y), (left + 30, y + h), (left, y + h), (left, y))
    pairs = quads(spark, d).select("parcel_id", F.col("ring").alias("ring_a"), other.alias("ring_b"))
    return P.merge_rings(pairs).select("parcel_id", G.js_round(G.planar_area(F.col("merged")), 4).alias("area"))


def geo_vertices(df, imagery, key, path):
    from cadastre.operators.grid import vertices

    v = vertices(N.geo_project(df.select("imagery_id", key, path), imagery, path).select("imagery_id", key, "geo_" + path), "geo_" + path)
    return v.select("imagery_id", (F.col(key) * 10 + F.col("seq")).alias("id"), F.col("px").alias("lng"), F.col("py").alias("lat"))


@query("m22_snap_vertices", sql("vertices", "fvertices", "imagery", body=""", gi AS (SELECT * FROM imagery WHERE is_georeferenced),
  p AS (SELECT v.parcel_id*10+v.seq AS point_id, v.imagery_id, floor((m.lng+(x/4000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lng, floor((m.lat-(y/3000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lat FROM vertices v JOIN gi m USING (imagery_id)),
  r AS (SELECT v.feature_id*10+v.seq AS ref_id, v.imagery_id, floor((m.lng+(x/4000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lng, floor((m.lat-(y/3000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000 AS lat FROM fvertices v JOIN gi m USING (imagery_id)),
  c AS (SELECT point_id, ref_id, pow(sin(radians(r.lat-p.lat)/2),2)+cos(radians(p.lat))*cos(radians(r.lat))*pow(sin(radians(r.lng-p.lng)/2),2) AS a FROM p JOIN r ON p.imagery_id=r.imagery_id AND abs(p.lat-r.lat)<0.00005 AND abs(p.lng-r.lng)<0.00005),
  k AS (SELECT point_id, 2*6371008.8e0*atan2(sqrt(a),sqrt(1-a)) AS d, ref_id FROM c),
  b AS (SELECT point_id, min(d) AS d FROM k WHERE d<2 GROUP BY 1)
  SELECT p.point_id, b.d IS NOT NULL AS snapped, floor(b.d*1000+0.5)/1000 AS distance_m FROM p LEFT JOIN b USING (point_id)"""))
def m22(spark, d):
    im = D.imagery(spark, d).where("is_georeferenced").drop("is_georeferenced")
    p = geo_vertices(D.parcels(spark, d), im, "parcel_id", "ring").withColumnRenamed("id", "point_id")
    r = geo_vertices(D.features(spark, d), im, "feature_id", "pts").withColumnRenamed("id", "ref_id")
    return P.snap_vertices(p, r).select("point_id", "snapped", G.js_round(F.col("distance_m"), 3).alias("distance_m"))


LINE_LEN = "(fw+fh)"


@query("m23_validate_features", sql("features", body=f"""SELECT feature_id, CASE
   WHEN detection_type='BUILDING' AND fw*fh<60 THEN 'building_area_out_of_bounds' WHEN detection_type='BUILDING' AND greatest(fw,fh)/CAST(least(fw,fh) AS DOUBLE)>4.5e0 THEN 'building_aspect_ratio'
   WHEN detection_type='FIELD' AND fw*fh<180000 THEN 'field_area_out_of_bounds' WHEN detection_type='VEGETATION' AND fw*fh<100 THEN 'vegetation_area_out_of_bounds'
   WHEN detection_type IN ('ROAD','WALL','FENCE') AND {LINE_LEN}<25 THEN 'line_length_too_short' WHEN detection_type IN ('WALL','FENCE') AND {LINE_LEN}>150 THEN 'extreme_diagonal_artifact' END AS pixel_reason,
  CASE WHEN detection_type='BUILDING' AND fw*fh<100 THEN 'Weak evidence: building_too_small' WHEN detection_type='BUILDING' AND greatest(fw,fh)/CAST(least(fw,fh) AS DOUBLE)>4.8e0 THEN 'Invalid geometry: building_aspect_ratio_too_high'
   WHEN detection_type='FIELD' AND fw*fh<96000 THEN 'Weak evidence: field_area_too_small' WHEN detection_type='VEGETATION' AND fw*fh<100 THEN 'Weak evidence: vegetation_too_small'
   WHEN detection_type='WATER' AND sub_type='canal' AND fw*fh<100 THEN 'Invalid geometry: water_canal_area_out_of_bounds' WHEN detection_type='WATER' AND sub_type IS NULL AND fw*fh<150 THEN 'Invalid geometry: water_body_area_out_of_bounds'
   WHEN detection_type IN ('WALL','FENCE') AND {LINE_LEN}<35 THEN 'Insufficient continuity: boundary_too_short' WHEN detection_type IN ('WALL','FENCE') AND {LINE_LEN}>150 THEN 'Unsupported line: boundary_too_long_artifact'
   WHEN detection_type='ROAD' AND {LINE_LEN}<30 THEN 'Insufficient continuity: road_too_short' END AS model_reason FROM features"""))
def m23(spark, d):
    f = T.feature_facts(D.features(spark, d))
    return f.select("feature_id", T.validity_reason_pixel().alias("pixel_reason"), T.validity_reason_model().alias("model_reason"))


@query("m24_land_block_partition", sql("features", "imagery", body=""", k AS (SELECT imagery_id*2+CASE WHEN fw%2=0 THEN 1 ELSE 0 END AS image, * FROM features WHERE detection_type='ROAD'),
  r AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY feature_id) AS rn FROM k), one AS (SELECT image, (3*fx+2*fw)/3e0 AS mx, (3*fy+fh)/3e0 AS my FROM r WHERE rn=1), two AS (SELECT image, (3*fx+2*fw)/3e0 AS mx, (3*fy+fh)/3e0 AS my FROM r WHERE rn=2),
  s AS (SELECT image, least(one.my,two.my) AS sy, (one.mx+two.mx)/2 AS sx FROM one JOIN two USING (image)),
  b AS (SELECT image, 'block_north' AS block_id, 0e0 AS x1, 0e0 AS y1, 4000e0 AS x2, greatest(sy,1050) AS y2 FROM s UNION ALL SELECT image, 'block_west_central', 0e0, least(sy,900), sx, 3000e0 FROM s UNION ALL SELECT image, 'block_south_settlement', sx, least(sy,1050), 4000e0, 3000e0 FROM s)
  SELECT image AS imagery_id, block_id, floor(x1*1000+0.5)/1000 AS x1, floor(y1*1000+0.5)/1000 AS y1, floor(x2*1000+0.5)/1000 AS x2, floor(y2*1000+0.5)/1000 AS y2 FROM b"""))
def m24(spark, d):
    roads = features_of(spark, d, "ROAD").withColumn("imagery_id", F.col("imagery_id") * 2 + F.when(F.col("fw") % 2 == 0, 1).otherwise(0))
    images = roads.select("imagery_id").distinct().withColumn("width", F.lit(D.IMAGE_WIDTH)).withColumn("height", F.lit(D.IMAGE_HEIGHT))
    b = T.land_blocks(roads, images)
    return b.select("imagery_id", "block_id", *[G.js_round(F.col(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("m25_water_clip", sql("parcels", body="""SELECT parcel_id, CASE WHEN shape='bowtie' THEN 0 ELSE (2*w-5)*h/2e0-CASE WHEN parcel_id%2=0 THEN 8*least(7,h) ELSE 0 END END AS area FROM parcels"""))
def m25(spark, d):
    p = M.repair_rings(D.parcels(spark, d))
    # every parcel has its own image here, so the area is known in closed form
    p = p.withColumn("imagery_id", F.col("parcel_id"))
    # bow-ties (whose halves cancel out) and odd parcels have their pool out of touch
    x, y = F.col("x0") + F.col("w") + F.when((F.col("parcel_id") % 2 == 0) & (F.col("shape") != "bowtie"), 0).otherwise(40), F.col("y0")
    pool = G.ring((x - 8, y - 5), (x + 8, y - 5), (x + 8, y + 7), (x - 8, y + 7), (x - 8, y - 5))
    water = p.select("imagery_id", F.col("parcel_id").alias("feature_id"), pool.alias("ring"))
    return P.water_clip(p, water).select("parcel_id", G.js_round(G.planar_area(F.col("clipped")), 4).alias("area"))


@query("d01_clean_features")
def d01(spark, d):
    c = T.clean_features(D.features(spark, d))
    return c.groupBy("imagery_id", "detection_type").agg(F.count("*").alias("n"), F.sum(F.size("pts")).alias("points"))


@query("d02_remove_noise", sql("features", body="SELECT feature_id FROM features WHERE feature_id%31<>0 AND feature_id%37<>0 AND NOT (feature_id%41=0)"))
def d02(spark, d):
    k = F.col("feature_id")
    f = D.features(spark, d)
    f = f.withColumn("pts", F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, F.transform("pts", lambda p: G.point(F.lit(float("nan")), p["y"])))
                     .when(k % 41 == 0, F.slice("pts", 1, 1)).otherwise(F.col("pts")))
    return T.remove_noise(f).select("feature_id")


@query("d03_remove_tiny", sql("features", body="SELECT feature_id FROM features WHERE CASE WHEN detection_type IN ('ROAD','WALL','FENCE') THEN fw+fh>=14 ELSE fw*fh>=1800 END"))
def d03(spark, d):
    return T.remove_tiny(D.features(spark, d)).select("feature_id")


@query("d04_fix_feature_rings", sql("features", body="SELECT feature_id, CASE WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 3 ELSE 5 END AS points FROM features"))
def d04(spark, d):
    k, first = F.col("feature_id"), F.element_at("pts", 1)
    f = D.features(spark, d)
    stutter = F.concat(F.array(first), F.array(G.point(first["x"] + 0.3, first["y"] + 0.3)), F.slice("pts", 2, 10))
    unclosed = F.slice("pts", 1, 4)
    f = f.withColumn("pts", F.when(k % 5 == 0, stutter).when((k % 7 == 0) & ~F.col("is_line"), unclosed).otherwise(F.col("pts")))
    return T.fix_rings(f).select("feature_id", F.size("pts").alias("points"))


MERGED = """, l AS MATERIALIZED (SELECT imagery_id, detection_type, min(feature_id) AS id, count(*) AS copies, fx, fy, fw, fh, degrees(atan2(fh, fw)) AS heading FROM features
    WHERE detection_type IN ('ROAD','WALL','FENCE') GROUP BY imagery_id, detection_type, fx, fy, fw, fh),
  e AS (SELECT *, 2*id AS n, fx AS px, fy AS py FROM l UNION ALL SELECT *, 2*id+1, fx+fw, fy+fh FROM l),
  near_ends AS (SELECT a.id AS a, b.id AS b, a.n AS u, b.n AS v, round(sqrt(pow(a.px-b.px,2)+pow(a.py-b.py,2)),6) AS weight, (a.n%1000003*7919+b.n%1000003*104729)%1000003 AS scatter
    FROM e a JOIN e b ON a.imagery_id=b.imagery_id AND a.detection_type=b.detection_type AND a.id<b.id AND abs(a.px-b.px)<=32 AND abs(a.py-b.py)<=32
    WHERE sqrt(pow(a.px-b.px,2)+pow(a.py-b.py,2)) <= CASE a.detection_type WHEN 'ROAD' THEN 32 ELSE 22 END AND least(abs(a.heading-b.heading), 180-abs(a.heading-b.heading)) <= 25),
  ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight, scatter, u, v) AS k FROM near_ends),
  touching AS (SELECT k, u AS n FROM ranked UNION ALL SELECT k, v FROM ranked),
  pairs AS (SELECT DISTINCT p.k AS s, q.k AS w FROM touching p JOIN touching q ON p.n=q.n AND p.k<q.k)""" + greedy_sql(24) + """,
  chosen AS MATERIALIZED (SELECT * FROM ranked WHERE k NOT IN (SELECT id FROM dropped)),
  step AS (SELECT a AS p, b AS q FROM chosen UNION ALL SELECT b, a FROM chosen),
  reach AS (WITH RECURSIVE r AS (SELECT DISTINCT p AS id, p AS root FROM step UNION SELECT s.q, r.root FROM r JOIN step s ON s.p=r.id) SELECT id, min(root) AS root FROM r GROUP BY id),
  counted AS (SELECT r.root, count(*) AS joints, max(k) AS worst FROM chosen c JOIN reach r ON r.id=c.a GROUP BY r.root),
  sized AS (SELECT root, count(*) AS pieces FROM reach GROUP BY root),
  kept AS (SELECT r.root, sum(c.weight) AS gaps FROM chosen c JOIN reach r ON r.id=c.a JOIN counted n ON n.root=r.root JOIN sized z ON z.root=r.root WHERE NOT (n.joints=z.pieces AND c.k=n.worst) GROUP BY r.root)
  SELECT l.imagery_id, l.detection_type, min(l.id) AS feature_id, CAST(sum(l.copies) AS INT) AS parts, CAST(3*count(*) AS INT) AS points, round(sum(l.fw+l.fh)+coalesce(any_value(g.gaps),0),2) AS length
  FROM l LEFT JOIN reach r ON r.id=l.id LEFT JOIN kept g ON g.root=r.root GROUP BY l.imagery_id, l.detection_type, coalesce(r.root, l.id)"""


@query("d05_merge_collinear", sql("features", body=MERGED))
def d05(spark, d):
    m = T.merge_collinear(D.features(spark, d).where("is_line"))
    return m.select("imagery_id", "detection_type", "feature_id", F.size("merged_ids").alias("parts"), F.size("pts").alias("points"), G.js_round(G.planar_length(F.col("pts")), 2).alias("length"))


CENTROIDS = """, c AS (SELECT feature_id, imagery_id, detection_type, avg(x) AS x, avg(y) AS y FROM fvertices GROUP BY 1,2,3)"""


@query("d06_dedupe_centroids", sql("fvertices", body=CENTROIDS + """, pairs AS (SELECT a.feature_id AS s, b.feature_id AS w FROM c a JOIN c b ON a.imagery_id=b.imagery_id AND a.detection_type=b.detection_type AND a.feature_id<b.feature_id
    AND abs(a.x-b.x)<8 AND abs(a.y-b.y)<8 AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<8)""" + greedy_sql() + " SELECT feature_id FROM features WHERE feature_id NOT IN (SELECT id FROM dropped)"))
def d06(spark, d):
    return T.dedupe_centroids(D.features(spark, d)).select("feature_id")


def orders_as_images(spark, d):
    """Image sizes that grow with the data: one image per order."""
    return D.table(spark, d, "orders").selectExpr("o_orderkey AS imagery_id", "CAST(500 + o_orderkey % 3600 AS INT) AS width", "CAST(400 + o_custkey % 2700 AS INT) AS height")


@query("d07_tile_index", """WITH i AS (SELECT o_orderkey AS imagery_id, CAST(500+o_orderkey%3600 AS INT) AS w, CAST(400+o_custkey%2700 AS INT) AS h FROM orders),
  a AS (SELECT imagery_id, x.range AS tx, y.range AS ty, least(1000,w-x.range) AS tw, least(1000,h-y.range) AS th FROM i, range(0,4100,820) x, range(0,3200,820) y WHERE x.range<w AND y.range<h),
  sx AS (SELECT imagery_id, w, h, range AS t FROM i, range(0,4100,512) WHERE range<=greatest(0,w-640) UNION SELECT imagery_id, w, h, w-640 FROM i WHERE w>640),
  sy AS (SELECT imagery_id, range AS t FROM i, range(0,3200,512) WHERE range<=greatest(0,h-640) UNION SELECT imagery_id, h-640 FROM i WHERE h>640)
  SELECT 'fixed' AS scheme, imagery_id, CAST(tx AS INT) AS tile_x, CAST(ty AS INT) AS tile_y, CAST(tw AS INT) AS tile_w, CAST(th AS INT) AS tile_h FROM a WHERE tw>=120 AND th>=120
  UNION ALL SELECT 'flush', sx.imagery_id, CAST(sx.t AS INT), CAST(sy.t AS INT), CAST(least(640,w-sx.t) AS INT), CAST(least(640,h-sy.t) AS INT) FROM sx JOIN sy USING (imagery_id) WHERE least(640,w-sx.t)>=20 AND least(640,h-sy.t)>=20""")
def d07(spark, d):
    i = orders_as_images(spark, d)
    cols = ["imagery_id", "tile_x", "tile_y", "tile_w", "tile_h"]
    return T.tile_index(i).select(F.lit("fixed").alias("scheme"), *cols).unionByName(T.tile_index_flush(i).select(F.lit("flush").alias("scheme"), *cols))


@query("d08_untile", sql("fvertices", body="SELECT feature_id, sum(x) AS sum_x, sum(y) AS sum_y FROM fvertices GROUP BY 1"))
def d08(spark, d):
    f = D.features(spark, d).withColumn("tile_x", F.floor(F.col("fx") / 820) * 820).withColumn("tile_y", F.floor(F.col("fy") / 820) * 820)
    local = f.withColumn("pts", F.transform("pts", lambda p: G.point(p["x"] - F.col("tile_x") + 0.2, p["y"] - F.col("tile_y") - 0.2)))
    return T.untile(local).select("feature_id", total("pts", "x").alias("sum_x"), total("pts", "y").alias("sum_y"))


@query("d09_nms", sql("features", body=""", b AS (SELECT feature_id, imagery_id, confidence, fx, fy, fw, fh FROM features WHERE detection_type='BUILDING'),
  q AS (SELECT a.feature_id AS s, z.feature_id AS w, (least(a.fx+a.fw,z.fx+z.fw)-greatest(a.fx,z.fx))*(least(a.fy+a.fh,z.fy+z.fh)-greatest(a.fy,z.fy)) AS i, a.fw*a.fh+z.fw*z.fh AS t
    FROM b a JOIN b z ON a.imagery_id=z.imagery_id AND (a.confidence>z.confidence OR (a.confidence=z.confidence AND a.feature_id<z.feature_id)) AND a.fx<z.fx+z.fw AND z.fx<a.fx+a.fw AND a.fy<z.fy+z.fh AND z.fy<a.fy+a.fh),
  pairs AS (SELECT s, w FROM q WHERE i/CAST(greatest(1,t-i) AS DOUBLE)>0.35e0)""" + greedy_sql() + " SELECT feature_id FROM b WHERE feature_id NOT IN (SELECT id FROM dropped)"))
def d09(spark, d):
    return T.suppress(features_of(spark, d, "BUILDING")).select("feature_id")


FALSE_POSITIVES = """, kb AS (SELECT * FROM features WHERE detection_type='BUILDING' AND fw*fh>=100), kr AS (SELECT * FROM features WHERE detection_type='ROAD' AND fw+fh>=42),
  ln AS (SELECT feature_id, imagery_id, fx+fw/2e0 AS x, CAST(fy AS DOUBLE) AS y FROM features WHERE detection_type IN ('WALL','FENCE') AND fw+fh>=35 AND fw+fh<=CASE detection_type WHEN 'WALL' THEN 150 ELSE 140 END),
  kl AS (SELECT feature_id FROM ln WHERE EXISTS (SELECT 1 FROM fvertices v JOIN kb USING (feature_id) WHERE v.imagery_id=ln.imagery_id AND sqrt(pow(v.x-ln.x,2)+pow(v.y-ln.y,2))<=28)
    OR EXISTS (SELECT 1 FROM fvertices v JOIN kr USING (feature_id) WHERE v.imagery_id=ln.imagery_id AND sqrt(pow(v.x-ln.x,2)+pow(v.y-ln.y,2))<=22))"""


@query("d10_false_positive_filter", sql("fvertices", body=FALSE_POSITIVES + """ SELECT feature_id FROM kb UNION ALL SELECT feature_id FROM kr UNION ALL SELECT feature_id FROM features WHERE detection_type='FIELD' AND fw*fh>=96000
  UNION ALL SELECT feature_id FROM kl UNION ALL SELECT feature_id FROM features WHERE detection_type IN ('VEGETATION','WATER')"""))
def d10(spark, d):
    return T.false_positive_filter(D.features(spark, d)).select("feature_id")


# every 17th line is stretched thirty times to the right, so lines leave the image or jump
@query("d11_accept_or_reject", sql("features", body=f""", g AS (SELECT * EXCLUDE (fw), CASE WHEN detection_type IN ('ROAD','WALL','FENCE') AND feature_id%17=3 THEN fw*30 ELSE fw END AS fw FROM features), t AS (SELECT *, CASE WHEN detection_type='BUILDING' THEN 0.40e0 WHEN detection_type IN ('ROAD','WALL','FENCE') THEN 0.65e0 WHEN detection_type IN ('FIELD','VEGETATION') THEN 0.55e0 WHEN sub_type='canal' THEN 0.70e0 ELSE 0.60e0 END AS thr,
   CASE WHEN fx+fw>4010 OR fy+fh>3010 THEN 'out_of_bounds' WHEN detection_type='BUILDING' AND fw*fh<60 THEN 'building_area_out_of_bounds' WHEN detection_type='BUILDING' AND least(fw,fh)<6 THEN 'building_too_thin' WHEN detection_type='BUILDING' AND greatest(fw,fh)/CAST(least(fw,fh) AS DOUBLE)>4.5e0 THEN 'building_aspect_ratio'
   WHEN detection_type='FIELD' AND fw*fh<180000 THEN 'field_area_out_of_bounds' WHEN detection_type='VEGETATION' AND fw*fh<100 THEN 'vegetation_area_out_of_bounds' WHEN detection_type='WATER' AND fw*fh<80 THEN 'water_area_out_of_bounds' WHEN detection_type IN ('ROAD','WALL','FENCE') AND greatest(fw,fh)>2200 THEN 'extreme_segment_jump'
   WHEN detection_type IN ('ROAD','WALL','FENCE') AND {LINE_LEN}<25 THEN 'line_length_too_short' WHEN detection_type IN ('WALL','FENCE') AND {LINE_LEN}>150 THEN 'extreme_diagonal_artifact' END AS reason FROM g),
  a AS (SELECT *, row_number() OVER (PARTITION BY imagery_id ORDER BY CASE detection_type WHEN 'BUILDING' THEN 0 WHEN 'ROAD' THEN 1 WHEN 'FIELD' THEN 2 WHEN 'WALL' THEN 3 WHEN 'FENCE' THEN 4 WHEN 'VEGETATION' THEN 5 ELSE 6 END, feature_id) AS n FROM t WHERE reason IS NULL AND confidence>=thr)
  SELECT feature_id, 'det_'||imagery_id||'_'||lower(detection_type)||'_'||n AS detection_id, NULL AS category, NULL AS threshold FROM a UNION ALL SELECT feature_id, NULL, coalesce(reason,'Weak evidence'), thr FROM t WHERE reason IS NOT NULL OR confidence<thr"""))
def d11(spark, d):
    stretched = F.transform("pts", lambda p: G.point(F.col("fx") + (p["x"] - F.col("fx")) * 30.0, p["y"]))
    f = D.features(spark, d).withColumn("pts", F.when(F.col("is_line") & (F.col("feature_id") % 17 == 3), stretched).otherwise(F.col("pts")))
    good, bad = T.accept_or_reject(T.feature_facts(f), T.validity_reason_pixel())
    none = F.lit(None).cast("string")
    return good.select("feature_id", "detection_id", none.alias("category"), F.lit(None).cast("double").alias("threshold")).unionByName(
        bad.select(F.col("item_id").alias("feature_id"), none.alias("detection_id"), "category", "threshold")
    )


@query("d12_duplicate_line_filter", sql("features", body=""", c AS (SELECT feature_id, imagery_id, detection_type, fx+fw/2e0 AS x, fy+fh/2e0 AS y FROM features WHERE detection_type IN ('WALL','FENCE')),
  pairs AS (SELECT a.feature_id AS s, b.feature_id AS w FROM c a JOIN c b ON a.imagery_id=b.imagery_id AND a.detection_type=b.detection_type AND a.feature_id<b.feature_id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<20)""" + greedy_sql() + " SELECT feature_id FROM c WHERE feature_id NOT IN (SELECT id FROM dropped)"))
def d12(spark, d):
    return T.dedupe_line_middles(features_of(spark, d, "WALL", "FENCE")).select("feature_id")


@query("d14_duplicate_field_filter", sql("features", body=""", b AS (SELECT feature_id, imagery_id, fx, fy, fw, fh FROM features WHERE detection_type='FIELD'),
  pairs AS (SELECT a.feature_id AS s, z.feature_id AS w FROM b a JOIN b z ON a.imagery_id=z.imagery_id AND a.feature_id<z.feature_id AND a.fx<z.fx+z.fw AND z.fx<a.fx+a.fw AND a.fy<z.fy+z.fh AND z.fy<a.fy+a.fh
    AND (least(a.fx+a.fw,z.fx+z.fw)-greatest(a.fx,z.fx))*(least(a.fy+a.fh,z.fy+z.fh)-greatest(a.fy,z.fy))>0.35e0*z.fw*z.fh+1e-9)""" + greedy_sql() + " SELECT feature_id FROM b WHERE feature_id NOT IN (SELECT id FROM dropped)"))
def d14(spark, d):
    return T.drop_covered_fields(features_of(spark, d, "FIELD")).select("feature_id")


@query("j15_endpoint_snap", sql("features", body=""", e AS (SELECT feature_id*2 AS id, imagery_id, fx AS x, fy AS y FROM features WHERE detection_type='ROAD' UNION ALL SELECT feature_id*2+1, imagery_id, fx+fw, fy+fh FROM features WHERE detection_type='ROAD'),
  pl AS (SELECT imagery_id, x, y, min(id) AS id FROM e GROUP BY 1,2,3),
  q AS (SELECT a.id AS s, b.id AS w, a.x AS sx, a.y AS sy FROM pl a JOIN pl b ON a.imagery_id=b.imagery_id AND a.id<b.id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<20), pairs AS (SELECT s, w FROM q)""" + greedy_sql() + """,
  mv AS (SELECT w, arg_min(sx, s) AS x, arg_min(sy, s) AS y FROM q WHERE s NOT IN (SELECT id FROM dropped) GROUP BY 1)
  SELECT e.id//2 AS feature_id, CAST(e.id%2 AS INT) AS "end", CAST(coalesce(mv.x,e.x) AS DOUBLE) AS x, CAST(coalesce(mv.y,e.y) AS DOUBLE) AS y FROM e JOIN pl ON pl.imagery_id=e.imagery_id AND pl.x=e.x AND pl.y=e.y LEFT JOIN mv ON mv.w=pl.id"""))
def j15(spark, d):
    return T.snap_endpoints(features_of(spark, d, "ROAD")).select("feature_id", "end", "x", "y")
