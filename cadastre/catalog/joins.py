"""Queries J01-J25: spatial, distance and report joins. The oracles are brute force per image."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.measures import validated
from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G
from cadastre.operators import history as H, joins as J, measures as M, normalise as N
from cadastre.session import cut_lineage
from cadastre.sources import derived as D


def features_of(spark, d, *types):
    return D.features(spark, d).where(F.col("detection_type").isin(*types))


def valid_parcels(spark, d):
    return validated(spark, d).where("valid")


def valid_rings(spark, d):
    """Valid parcels with their clean ring, measured once although the joins of rings read them twice."""
    return cut_lineage(valid_parcels(spark, d).select("project_id", "imagery_id", "parcel_id", "mode", "clean"))


def water_rings(spark, d):
    """Water detections with their working ring in the image's coordinate mode."""
    w = features_of(spark, d, "WATER").select("imagery_id", "feature_id", F.col("pts").alias("ring"))
    geo = D.imagery(spark, d).select("imagery_id", "is_georeferenced")
    return M.working_geometry(w.join(geo, "imagery_id"), D.imagery(spark, d))


# signed strip integral over two edges a, b of plane coordinates: see functions.geom
STRIP = """sign(a.x2-a.x1)*sign(b.x2-b.x1)*greatest(0, hi-lo)/2*
  CASE WHEN (al-bl)*(ar-br)<0 THEN CASE WHEN al<bl THEN (al+al+(ar-al)*(al-bl)/((al-bl)-(ar-br)))*(al-bl)/((al-bl)-(ar-br))+(al+(ar-al)*(al-bl)/((al-bl)-(ar-br))+br)*(1-(al-bl)/((al-bl)-(ar-br)))
    ELSE (bl+al+(ar-al)*(al-bl)/((al-bl)-(ar-br)))*(al-bl)/((al-bl)-(ar-br))+(al+(ar-al)*(al-bl)/((al-bl)-(ar-br))+ar)*(1-(al-bl)/((al-bl)-(ar-br))) END
   ELSE least(al,bl)+least(ar,br) END"""


def shared_area_sql(left: str, right: str, pairs: str, lid: str, rid: str) -> str:
    """CTE ``shared(lid, rid, area)`` over edges (id, x1, y1, x2, y2) of candidate pairs, moved near the origin."""
    return f""", pe AS (SELECT p.{lid} AS la, p.{rid} AS rb, a.x1-o.x AS ax1, a.y1-o.y AS ay1, a.x2-o.x AS ax2, a.y2-o.y AS ay2, b.x1-o.x AS bx1, b.y1-o.y AS by1, b.x2-o.x AS bx2, b.y2-o.y AS by2
    FROM {pairs} p JOIN {left} a ON a.id=p.{lid} JOIN {right} b ON b.id=p.{rid} JOIN (SELECT id, x1 AS x, y1 AS y FROM {left} WHERE seq=0) o ON o.id=p.{lid} WHERE a.x1<>a.x2 AND b.x1<>b.x2),
  pr AS (SELECT *, greatest(least(ax1,ax2),least(bx1,bx2)) AS lo, least(greatest(ax1,ax2),greatest(bx1,bx2)) AS hi FROM pe),
  pf AS (SELECT *, ay1+(lo-ax1)*(ay2-ay1)/(ax2-ax1) AS al, ay1+(hi-ax1)*(ay2-ay1)/(ax2-ax1) AS ar, by1+(lo-bx1)*(by2-by1)/(bx2-bx1) AS bl, by1+(hi-bx1)*(by2-by1)/(bx2-bx1) AS br FROM pr WHERE hi>lo),
  shared AS (SELECT la AS {lid}, rb AS {rid}, abs(sum({STRIP.replace('a.x', 'ax').replace('b.x', 'bx')})) AS area FROM pf GROUP BY 1,2)"""


PLANE = """, vp AS (SELECT * FROM facts WHERE valid AND status NOT IN ('Deleted','split')),
  pedge AS (SELECT e.parcel_id AS id, e.imagery_id, e.geo, e.seq, px1 AS x1, py1 AS y1, px2 AS x2, py2 AS y2 FROM wedges e JOIN vp USING (parcel_id) WHERE kind='clean'),
  pbox AS (SELECT id, any_value(imagery_id) AS imagery_id, any_value(geo) AS geo, min(x1) AS xa, min(y1) AS ya, max(x1) AS xb, max(y1) AS yb FROM pedge GROUP BY 1)"""

OVERLAPS = PLANE + """, cand AS (SELECT a.id AS parcel_a, b.id AS parcel_b, a.imagery_id, a.geo FROM pbox a JOIN pbox b ON a.imagery_id=b.imagery_id AND a.id<b.id
    AND a.xa<b.xb AND b.xa<a.xb AND a.ya<b.yb AND b.ya<a.yb)""" + shared_area_sql("pedge", "pedge", "cand", "parcel_a", "parcel_b") + """,
  ovl AS (SELECT imagery_id, geo, parcel_a, parcel_b, area, CASE WHEN area>CASE WHEN geo THEN 100 ELSE 2000 END THEN 'High' WHEN area>CASE WHEN geo THEN 25 ELSE 600 END THEN 'Medium' ELSE 'Low' END AS severity
    FROM cand JOIN shared USING (parcel_a, parcel_b) WHERE area>CASE WHEN geo THEN 2 ELSE 1e-6 END)"""

ON_EDGE = """sqrt(pow(v.x-(e.x1+t*(e.x2-e.x1)),2)+pow(v.y-(e.y1+t*(e.y2-e.y1)),2))<=1e-6"""

CORNERS = """, held AS (SELECT o.parcel_a, o.parcel_b, 'a' AS own, v.x1 AS x, v.y1 AS y, e.x1, e.y1, e.x2, e.y2 FROM ovl o JOIN pedge v ON v.id=o.parcel_a JOIN pedge e ON e.id=o.parcel_b
    UNION ALL SELECT o.parcel_a, o.parcel_b, 'b', v.x1, v.y1, e.x1, e.y1, e.x2, e.y2 FROM ovl o JOIN pedge v ON v.id=o.parcel_b JOIN pedge e ON e.id=o.parcel_a),
  ht AS (SELECT *, CASE WHEN x1=x2 AND y1=y2 THEN 0 ELSE greatest(0,least(1,((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS t FROM held),
  hv AS (SELECT parcel_a, parcel_b, own, x, y, bool_or(sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2))<=1e-6) AS border,
     sum(CASE WHEN (y1>y)<>(y2>y) AND x<(x2-x1)*(y-y1)/CASE WHEN y2=y1 THEN 1 ELSE y2-y1 END+x1 THEN 1 ELSE 0 END)%2=1 AS inside FROM ht GROUP BY 1,2,3,4,5),
  cr AS (SELECT o.parcel_a, o.parcel_b, a.x1 AS ax, a.y1 AS ay, a.x2-a.x1 AS adx, a.y2-a.y1 AS ady, b.x1-a.x1 AS ox, b.y1-a.y1 AS oy, b.x2-b.x1 AS bdx, b.y2-b.y1 AS bdy
     FROM ovl o JOIN pedge a ON a.id=o.parcel_a JOIN pedge b ON b.id=o.parcel_b),
  ct AS (SELECT *, (ox*bdy-oy*bdx)/(adx*bdy-ady*bdx) AS t, (ox*ady-oy*adx)/(adx*bdy-ady*bdx) AS u FROM cr WHERE adx*bdy-ady*bdx<>0),
  cc AS (SELECT DISTINCT parcel_a, parcel_b, floor(x*1000+0.5)/1000 AS x, floor(y*1000+0.5)/1000 AS y FROM (
     SELECT parcel_a, parcel_b, x, y FROM hv WHERE border OR inside UNION ALL
     SELECT parcel_a, parcel_b, ax+t*adx, ay+t*ady FROM ct WHERE t>0 AND t<1 AND u>0 AND u<1) q),
  mid AS (SELECT parcel_a, parcel_b, avg(x) AS cx, avg(y) AS cy FROM cc GROUP BY 1,2)"""


@query("j01_parcel_overlaps", sql("facts", "wedges", body=OVERLAPS + CORNERS + """
  SELECT imagery_id, parcel_a, parcel_b, CAST(floor(area+0.5) AS BIGINT) AS overlap, severity,
   floor(CASE WHEN geo THEN degrees(cx/6371008.8e0)*100000 ELSE cx*100 END+0.5)/CASE WHEN geo THEN 100000 ELSE 100 END AS center_x,
   floor(CASE WHEN geo THEN degrees(asin(cy/6371008.8e0))*100000 ELSE cy*100 END+0.5)/CASE WHEN geo THEN 100000 ELSE 100 END AS center_y
  FROM ovl JOIN mid USING (parcel_a, parcel_b)"""))
def j01(spark, d):
    o = J.parcel_overlaps(valid_rings(spark, d))

    def rounded(c):
        return F.when(F.col("mode") == "image", G.js_round(F.col(c), 2)).otherwise(G.js_round(F.col(c), 5)).alias(c)

    return o.select("imagery_id", "parcel_a", "parcel_b", G.js_round(F.col("overlap")).alias("overlap"), "severity", rounded("center_x"), rounded("center_y"))


@query("j02_intersection_area", sql("facts", "redges", "features", "fedges", body=""", vp AS (SELECT * FROM facts WHERE valid AND status NOT IN ('Deleted','split')),
  le AS (SELECT parcel_id AS id, imagery_id, seq, x1, y1, x2, y2 FROM redges JOIN vp USING (parcel_id, imagery_id)),
  re AS (SELECT feature_id AS id, imagery_id, seg AS seq, x1, y1, x2, y2 FROM fedges WHERE detection_type='FIELD'),
  lb AS (SELECT id, any_value(imagery_id) AS imagery_id, min(x1) AS xa, min(y1) AS ya, max(x1) AS xb, max(y1) AS yb FROM le GROUP BY 1),
  cand AS (SELECT lb.id AS left_id, f.feature_id AS right_id, lb.imagery_id FROM lb JOIN features f ON f.imagery_id=lb.imagery_id AND f.detection_type='FIELD'
    AND xa<fx+fw AND fx<xb AND ya<fy+fh AND fy<yb)""" + shared_area_sql("le", "re", "cand", "left_id", "right_id") + """
  SELECT cand.imagery_id, left_id, right_id, floor((area+1e-8)*100+0.5)/100 AS area FROM cand JOIN shared USING (left_id, right_id) WHERE area>1e-6"""))
def j02(spark, d):
    keep = valid_parcels(spark, d).select("parcel_id")
    left = M.repair_rings(D.parcels(spark, d)).join(keep, "parcel_id", "left_semi").select("imagery_id", F.col("parcel_id").alias("id"), F.col("clean").alias("ring"))
    left = cut_lineage(left)
    right = features_of(spark, d, "FIELD").select("imagery_id", F.col("feature_id").alias("id"), F.col("pts").alias("ring"))
    return J.shared_areas(left, right).select("imagery_id", "left_id", "right_id", G.js_round(F.col("area") + 1e-8, 2).alias("area"))


WATER = PLANE + """, wrect AS (SELECT f.feature_id AS id, f.imagery_id, m.is_georeferenced AS geo, k.i AS seq,
    CASE WHEN m.is_georeferenced THEN radians(floor((m.lng+((CASE WHEN k.i IN (1,2) THEN fx+fw ELSE fx END)/4000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000)*6371008.8e0 ELSE CASE WHEN k.i IN (1,2) THEN fx+fw ELSE fx END END AS x,
    CASE WHEN m.is_georeferenced THEN sin(radians(floor((m.lat-((CASE WHEN k.i IN (2,3) THEN fy+fh ELSE fy END)/3000e0-0.5e0)*(2*0.0035e0))*1000000+0.5)/1000000))*6371008.8e0 ELSE CASE WHEN k.i IN (2,3) THEN fy+fh ELSE fy END END AS y
    FROM features f JOIN imagery m ON m.imagery_id=f.imagery_id CROSS JOIN (VALUES (0),(1),(2),(3),(4)) AS k(i) WHERE detection_type='WATER'),
  wedge AS (SELECT * FROM (SELECT id, imagery_id, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM wrect WINDOW w AS (PARTITION BY id ORDER BY seq)) t WHERE x2 IS NOT NULL),
  wbox AS (SELECT id, any_value(imagery_id) AS imagery_id, min(x1) AS xa, min(y1) AS ya, max(x1) AS xb, max(y1) AS yb FROM wedge GROUP BY 1),
  cand AS (SELECT a.id AS parcel_id, b.id AS feature_id, a.imagery_id, a.geo FROM pbox a JOIN wbox b ON a.imagery_id=b.imagery_id AND a.xa<=b.xb AND b.xa<=a.xb AND a.ya<=b.yb AND b.ya<=a.yb)""" + shared_area_sql("pedge", "wedge", "cand", "parcel_id", "feature_id") + """,
  tv AS (SELECT c.parcel_id, c.feature_id, v.x1 AS x, v.y1 AS y, e.x1, e.y1, e.x2, e.y2 FROM cand c JOIN pedge v ON v.id=c.parcel_id JOIN wedge e ON e.id=c.feature_id
    UNION ALL SELECT c.parcel_id, c.feature_id, v.x1, v.y1, e.x1, e.y1, e.x2, e.y2 FROM cand c JOIN wedge v ON v.id=c.feature_id JOIN pedge e ON e.id=c.parcel_id),
  tt AS (SELECT *, CASE WHEN x1=x2 AND y1=y2 THEN 0 ELSE greatest(0,least(1,((x-x1)*(x2-x1)+(y-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS t FROM tv),
  tx AS (SELECT parcel_id, feature_id, bool_or(sqrt(pow(x-(x1+t*(x2-x1)),2)+pow(y-(y1+t*(y2-y1)),2))<=1e-6) AS touch FROM tt GROUP BY 1,2),
  wo AS (SELECT imagery_id, parcel_id, feature_id, CASE WHEN coalesce(area,0)>1e-6 THEN area WHEN touch THEN 5e0 END AS overlap FROM cand LEFT JOIN shared USING (parcel_id, feature_id) JOIN tx USING (parcel_id, feature_id)),
  wat AS (SELECT * FROM wo WHERE overlap>2),
  water_issues AS (SELECT imagery_id, parcel_id, feature_id, overlap FROM wat UNION ALL
    SELECT imagery_id, parcel_id, NULL, NULL FROM parcels p WHERE status NOT IN ('Deleted','split') AND lower(topology_issue) LIKE '%water%' AND parcel_id NOT IN (SELECT parcel_id FROM wat))"""


def water_issue_rows(spark, d):
    active = N.active_parcels(D.parcels(spark, d))
    return J.water_issues(active, J.water_overlaps(valid_rings(spark, d), water_rings(spark, d)))


@query("j03_water_overlaps", sql("facts", "wedges", "features", "imagery", body=WATER + """
  SELECT imagery_id, parcel_id, feature_id, CAST(floor(overlap+0.5) AS BIGINT) AS overlap FROM water_issues"""))
def j03(spark, d):
    return water_issue_rows(spark, d).select("imagery_id", "parcel_id", "feature_id", G.js_round(F.col("overlap")).alias("overlap"))


@query("j04_neighbour_conflicts", sql("parcels", "events_fx", body=""", bx AS (SELECT parcel_id, imagery_id, status, x0 AS xa, y0 AS ya, x0+w AS xb, y0+h AS yb FROM parcels),
  ed AS (SELECT e.event_id AS edit_id, b.parcel_id, b.imagery_id, xa+e.event_id%40 AS xa, ya+e.event_id%30 AS ya, xb+e.event_id%40 AS xb, yb+e.event_id%30 AS yb FROM events_fx e JOIN bx b USING (parcel_id) WHERE e.action='Edited'),
  pr AS (SELECT a.edit_id, b.parcel_id AS other, (least(a.xb,b.xb)-greatest(a.xa,b.xa))*(least(a.yb,b.yb)-greatest(a.ya,b.ya)) AS inter, (a.xb-a.xa)*(a.yb-a.ya) AS own
    FROM ed a JOIN bx b ON a.imagery_id=b.imagery_id AND a.parcel_id<>b.parcel_id AND b.status='accepted' AND a.xa<=b.xb AND b.xa<=a.xb AND a.ya<=b.yb AND b.ya<=a.yb)
  SELECT edit_id, min(other) AS first_neighbour, count(*) AS conflicts FROM pr WHERE inter>200 AND inter/CAST(own AS DOUBLE)>0.08 GROUP BY 1"""))
def j04(spark, d):
    edits, accepted = edit_boxes(spark, d)
    return J.neighbour_conflicts(edits, accepted)


def edit_boxes(spark, d):
    p = D.parcels(spark, d)
    e = D.events(spark, d).where("action = 'Edited'").select(F.col("event_id").alias("edit_id"), "parcel_id", "ts")
    moved = e.join(p.select("parcel_id", "imagery_id", "project_id", "ring"), "parcel_id").withColumn(
        "ring", F.transform("ring", lambda q: G.point(q["x"] + F.col("edit_id") % 40, q["y"] + F.col("edit_id") % 30))
    )
    edits = moved.select("edit_id", "parcel_id", "imagery_id", G.bbox(F.col("ring")).alias("bb"))
    accepted = p.where("status = 'accepted'").select("parcel_id", "imagery_id", G.bbox(F.col("ring")).alias("bb"))
    return edits, accepted


def ranked_active(active):
    total = active.groupBy("imagery_id").agg(F.count("*").alias("image_total"))
    slim = active.select("project_id", "imagery_id", "parcel_id", "topology_issue")
    return H.number_rows(slim, ["imagery_id"], ["parcel_id"], F.floor(F.col("parcel_id") / 10000)).join(total, "imagery_id")


def gap_rows(active):
    return J.note_partners(active, ranked_active(active))


GAPS = """, act AS (SELECT * FROM parcels WHERE status NOT IN ('Deleted','split')),
  gp AS (SELECT a.imagery_id, a.parcel_id AS parcel_a, b.parcel_id AS parcel_b, lower(a.topology_issue) LIKE '%gap%' AS by_gap FROM act a JOIN act b ON a.imagery_id=b.imagery_id AND a.parcel_id<b.parcel_id
    WHERE a.topology_issue IS NOT NULL AND (contains(a.topology_issue, CAST(b.parcel_id AS VARCHAR)) OR lower(a.topology_issue) LIKE '%gap%'))"""


@query("j05_flagged_gaps", sql("parcels", body=GAPS + """ SELECT imagery_id, parcel_a AS parcel_id, count(*) AS partners,
   CASE WHEN any_value(by_gap) THEN NULL ELSE string_agg(CAST(parcel_b AS VARCHAR), ',' ORDER BY CAST(parcel_b AS VARCHAR)) END AS named FROM gp GROUP BY 1,2"""))
def j05(spark, d):
    active = N.active_parcels(D.parcels(spark, d))
    return gap_rows(active).select("imagery_id", "parcel_id", "partners", "named")


# building vertex mean counts the closing vertex twice
CENTERS = """, bc AS (SELECT feature_id, imagery_id, avg(x) AS px, avg(y) AS py FROM fvertices WHERE detection_type='BUILDING' GROUP BY 1,2)"""


def building_points(spark, d):
    return J.feature_points(features_of(spark, d, "BUILDING"), ["imagery_id", "feature_id"])


@query("j06_point_in_polygon", sql("fvertices", "redges", body=CENTERS + """
  SELECT b.feature_id, e.parcel_id FROM bc b JOIN redges e ON e.imagery_id=b.imagery_id AND (e.y1>py)<>(e.y2>py)
   AND px < (e.x2-e.x1)*(py-e.y1)/CASE WHEN e.y2=e.y1 THEN 1 ELSE e.y2-e.y1 END+e.x1 GROUP BY 1,2 HAVING count(*)%2=1"""))
def j06(spark, d):
    rings = M.repair_rings(D.parcels(spark, d)).select("imagery_id", "parcel_id", F.col("clean").alias("ring"))
    return J.points_in_rings(building_points(spark, d), rings).select("feature_id", "parcel_id")


INSIDE = CENTERS + """, hit AS (SELECT b.feature_id, e.parcel_id FROM bc b JOIN redges e ON e.imagery_id=b.imagery_id AND (e.y1>py)<>(e.y2>py)
   AND px < (e.x2-e.x1)*(py-e.y1)/CASE WHEN e.y2=e.y1 THEN 1 ELSE e.y2-e.y1 END+e.x1 GROUP BY 1,2 HAVING count(*)%2=1)"""


@query("j07_enclosed_other_buildings", sql("fvertices", "redges", body=INSIDE + """, n AS (SELECT parcel_id, min(feature_id) AS anchor_id, count(*) AS n FROM hit GROUP BY 1)
  SELECT parcel_id AS candidate_id, anchor_id FROM n WHERE n=1"""))
def j07(spark, d):
    rings = M.repair_rings(D.parcels(spark, d)).select("imagery_id", "parcel_id", F.col("clean").alias("ring"))
    points = building_points(spark, d)
    anchors = J.points_in_rings(points, rings).groupBy("parcel_id").agg(F.min("feature_id").alias("anchor_id"))
    candidates = rings.join(anchors, "parcel_id").withColumnRenamed("parcel_id", "candidate_id")
    return candidates.join(J.rings_holding_other_points(candidates, points), "candidate_id", "left_anti").select("candidate_id", "anchor_id")


DIST = """(SELECT *, sqrt(pow(px-(x1+t*(x2-x1)),2)+pow(py-(y1+t*(y2-y1)),2)) AS dist FROM (SELECT *, CASE WHEN x1=x2 AND y1=y2 THEN 0 ELSE
   greatest(0,least(1,((px-x1)*(x2-x1)+(py-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) END AS t FROM {src}))"""


def dist_sql(src: str) -> str:
    return DIST.format(src=src)


@query("j08_nearest_polyline", sql("fvertices", "fedges", body=CENTERS + f""", q AS (SELECT b.feature_id, px, py, e.feature_id AS line_id, e.seg, x1, y1, x2, y2 FROM bc b JOIN fedges e
     ON e.imagery_id=b.imagery_id AND e.detection_type='ROAD' AND px BETWEEN least(x1,x2)-131 AND greatest(x1,x2)+131 AND py BETWEEN least(y1,y2)-131 AND greatest(y1,y2)+131),
  r AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY dist, line_id, seg) AS rn FROM {dist_sql('q')} z WHERE dist<=130)
  SELECT feature_id, line_id, CAST(seg AS INT) AS segment, floor(dist*10000+0.5)/10000 AS distance, floor(t*10000+0.5)/10000 AS t FROM r WHERE rn=1"""))
def j08(spark, d):
    roads = features_of(spark, d, "ROAD").select("imagery_id", F.col("feature_id").alias("line_id"), "pts")
    n = J.nearest_polyline(building_points(spark, d), roads, 130.0, ["feature_id"])
    return n.select("feature_id", "line_id", "segment", G.js_round(F.col("distance"), 4).alias("distance"), G.js_round(F.col("t"), 4).alias("t"))


@query("j09_road_frontage", sql("vertices", "fedges", body=f""", q AS (SELECT parcel_id, v.x AS px, v.y AS py, e.feature_id AS road_id, x1, y1, x2, y2 FROM vertices v JOIN fedges e ON e.imagery_id=v.imagery_id AND e.detection_type='ROAD'
    AND v.x BETWEEN least(x1,x2)-46 AND greatest(x1,x2)+46 AND v.y BETWEEN least(y1,y2)-46 AND greatest(y1,y2)+46)
  SELECT parcel_id, min(road_id) AS road_id FROM {dist_sql('q')} z WHERE dist<45 GROUP BY 1"""))
def j09(spark, d):
    return J.road_frontage(D.parcels(spark, d), features_of(spark, d, "ROAD")).select("parcel_id", "road_id")


@query("j10_adjacent_boundaries", sql("vertices", "fvertices", body="""SELECT DISTINCT v.parcel_id, f.feature_id AS boundary_id FROM vertices v JOIN fvertices f ON f.imagery_id=v.imagery_id
   AND f.detection_type IN ('WALL','FENCE') AND sqrt(pow(v.x-f.x,2)+pow(v.y-f.y,2))<35"""))
def j10(spark, d):
    return J.adjacent_boundaries(D.parcels(spark, d), features_of(spark, d, "WALL", "FENCE")).select("parcel_id", "boundary_id")


@query("j11_perimeter_support", sql("edges", "fedges", body=f""", pe AS (SELECT parcel_id, imagery_id, seq, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS len, (x1+x2)/2 AS px, (y1+y2)/2 AS py FROM edges),
  q AS (SELECT parcel_id, seq, len, px, py, e.x1, e.y1, e.x2, e.y2 FROM pe JOIN fedges e ON e.imagery_id=pe.imagery_id AND e.detection_type IN ('ROAD','WALL','FENCE','FIELD')
    AND px BETWEEN least(e.x1,e.x2)-41 AND greatest(e.x1,e.x2)+41 AND py BETWEEN least(e.y1,e.y2)-41 AND greatest(e.y1,e.y2)+41 WHERE len>0),
  s AS (SELECT parcel_id, sum(len) AS sup FROM (SELECT DISTINCT parcel_id, seq, len FROM {dist_sql('q')} z WHERE dist<=40) y GROUP BY 1),
  t AS (SELECT parcel_id, sum(len) AS tot FROM pe GROUP BY 1),
  im AS (SELECT DISTINCT imagery_id FROM fedges WHERE detection_type IN ('ROAD','WALL','FENCE','FIELD')),
  r AS (SELECT p.parcel_id, CASE WHEN im.imagery_id IS NULL THEN 50 ELSE CAST(greatest(10,least(100,floor(coalesce(sup,0)/tot*100+0.5))) AS INT) END AS supported_pct
    FROM parcels p JOIN t USING (parcel_id) LEFT JOIN s USING (parcel_id) LEFT JOIN im ON im.imagery_id=p.imagery_id)
  SELECT parcel_id, supported_pct, 100-supported_pct AS unsupported_pct, floor((0.5e0+0.5e0*(supported_pct/100e0))*100+0.5)/100 AS support_confidence FROM r"""))
def j11(spark, d):
    return J.perimeter_support(D.parcels(spark, d), D.features(spark, d)).select("parcel_id", "supported_pct", "unsupported_pct", "support_confidence")


EDGE_SUPPORT = f""", pe AS (SELECT *, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS len, CAST(greatest(2,ceil(sqrt(pow(x2-x1,2)+pow(y2-y1,2))/8)) AS INT) AS ns FROM edges WHERE x1<>x2 OR y1<>y2),
  pm AS (SELECT parcel_id, count(*) AS nv, max(CASE WHEN seq=0 THEN x END) AS vx, max(CASE WHEN seq=0 THEN y END) AS vy FROM vertices GROUP BY 1),
  ctr AS (SELECT v.parcel_id, avg(x) AS cx, avg(y) AS cy FROM vertices v JOIN pm USING (parcel_id) WHERE v.seq<nv-1 GROUP BY 1),
  sm AS (SELECT parcel_id, imagery_id, seq, s, nv, vx, vy, x1*(1-s/CAST(ns AS DOUBLE))+x2*(s/CAST(ns AS DOUBLE)) AS px, y1*(1-s/CAST(ns AS DOUBLE))+y2*(s/CAST(ns AS DOUBLE)) AS py
     FROM (SELECT *, unnest(generate_series(0, ns)) AS s FROM pe) a JOIN pm USING (parcel_id)),
  ff AS (SELECT e.*, CASE e.detection_type WHEN 'ROAD' THEN 1 WHEN 'FIELD' THEN 3 ELSE 2 END AS pri, CASE e.detection_type WHEN 'ROAD' THEN 35 ELSE 25 END AS reach, fx, fy FROM fedges e JOIN features f USING (feature_id) WHERE e.detection_type IN ('ROAD','WALL','FENCE','FIELD')),
  q AS (SELECT parcel_id, seq, s, px, py, e.x1, e.y1, e.x2, e.y2, pri, reach FROM sm JOIN ff e ON e.imagery_id=sm.imagery_id AND px BETWEEN least(e.x1,e.x2)-36 AND greatest(e.x1,e.x2)+36
     AND py BETWEEN least(e.y1,e.y2)-36 AND greatest(e.y1,e.y2)+36 AND NOT (pri=3 AND nv=5 AND sqrt(pow(vx-fx,2)+pow(vy-fy,2))<5)),
  h AS (SELECT parcel_id, seq, s, min(pri) AS k FROM {dist_sql('q')} z WHERE dist<=reach GROUP BY 1,2,3),
  hc AS (SELECT parcel_id, seq, count(CASE WHEN k=1 THEN 1 END) AS r, count(CASE WHEN k=2 THEN 1 END) AS w, count(CASE WHEN k=3 THEN 1 END) AS f FROM h GROUP BY 1,2),
  er AS (SELECT pe.parcel_id, pe.seq, len, (x1+x2)/2 AS mx, (y1+y2)/2 AS my, coalesce(r,0)/CAST(ns+1 AS DOUBLE) AS rr, coalesce(w,0)/CAST(ns+1 AS DOUBLE) AS wr, coalesce(f,0)/CAST(ns+1 AS DOUBLE) AS fr FROM pe LEFT JOIN hc USING (parcel_id, seq)),
  es AS (SELECT *, least(1,rr+wr+fr) AS su, CASE WHEN rr>=0.4e0 THEN 'road' WHEN wr>=0.35e0 THEN 'wall_fence' WHEN fr>=0.35e0 THEN 'field' WHEN least(1,rr+wr+fr)>=0.4e0 THEN 'mixed' ELSE 'unsupported' END AS et FROM er),
  eo AS (SELECT *, len*(1-su) AS op, et='unsupported' OR su<0.4e0 AS gap FROM es),
  ag AS (SELECT e.parcel_id, sum(len) AS tot, sum(op) AS opt, sum(len*rr) AS rl, sum(len*wr) AS wl, sum(len*fr) AS fl, sum(CASE WHEN gap THEN (mx-cx)*op END) AS gx, sum(CASE WHEN gap THEN (my-cy)*op END) AS gy, sum(CASE WHEN gap THEN op END) AS gw,
     count(CASE WHEN et='road' THEN 1 END) AS road_edges, count(CASE WHEN et='unsupported' THEN 1 END) AS unsupported_edges FROM eo e JOIN ctr USING (parcel_id) GROUP BY 1),
  ap AS (SELECT *, floor(gx/gw*1000000+0.5)/1000000 AS ax, floor(gy/gw*1000000+0.5)/1000000 AS ay FROM ag)"""


@query("j12_edge_support", sql("edges", "fedges", body=EDGE_SUPPORT + """
  SELECT parcel_id, CAST(floor(tot+0.5) AS BIGINT) AS total_px, CAST(floor(greatest(0,tot-opt)/tot*100+0.5) AS INT) AS supported_pct, CAST(floor(rl/tot*100+0.5) AS INT) AS road_pct,
   CAST(floor(wl/tot*100+0.5) AS INT) AS wall_fence_pct, CAST(floor(fl/tot*100+0.5) AS INT) AS field_pct,
   CASE WHEN coalesce(gw,0)<=0 THEN 'interior' WHEN abs(ax)>abs(ay) THEN CASE WHEN ax>0 THEN 'eastern' ELSE 'western' END ELSE CASE WHEN ay>0 THEN 'southern' ELSE 'northern' END END AS unsupported_direction,
   road_edges, unsupported_edges FROM ap"""))
def j12(spark, d):
    return J.edge_support(D.parcels(spark, d), D.features(spark, d)).select(
        "parcel_id", "total_px", "supported_pct", "road_pct", "wall_fence_pct", "field_pct", "unsupported_direction", "road_edges", "unsupported_edges"
    )


IN_BOX = "(fy>py)<>(fy+fh>py) AND px<fx+fw AND NOT px<fx"


@query("j13_water_contact", sql("edges", "features", body=f""", s AS (SELECT parcel_id, imagery_id, x1*(1-t)+x2*t AS px, y1*(1-t)+y2*t AS py FROM edges, (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) k(t))
  SELECT DISTINCT parcel_id FROM s JOIN features f ON f.imagery_id=s.imagery_id AND detection_type='WATER' AND {IN_BOX}"""))
def j13(spark, d):
    water = features_of(spark, d, "WATER").select("imagery_id", F.col("pts").alias("ring"))
    return J.water_contact(D.parcels(spark, d), water)


CROSS = """, rs AS (SELECT * FROM fedges WHERE detection_type='ROAD'),
  rx AS (SELECT a.imagery_id, a.feature_id AS road_a, b.feature_id AS road_b, a.seg AS segment_a, b.seg AS segment_b, a.x1, a.y1, a.x2, a.y2,
    ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))/((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)) AS ua, ((a.x2-a.x1)*(a.y1-b.y1)-(a.y2-a.y1)*(a.x1-b.x1))/((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)) AS ub
    FROM rs a JOIN rs b ON a.imagery_id=b.imagery_id AND a.feature_id<b.feature_id AND (b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)<>0
    AND least(a.x1,a.x2)<=greatest(b.x1,b.x2) AND least(b.x1,b.x2)<=greatest(a.x1,a.x2))"""


@query("j14_road_intersections", sql("fedges", body=CROSS + """ SELECT imagery_id, road_a, road_b, floor((x1+ua*(x2-x1))*100+0.5)/100 AS x, floor((y1+ua*(y2-y1))*100+0.5)/100 AS y FROM rx WHERE ua>=0 AND ua<=1 AND ub>=0 AND ub<=1"""))
def j14(spark, d):
    return J.road_intersections(features_of(spark, d, "ROAD")).select("imagery_id", "road_a", "road_b", "x", "y")


@query("j16_road_water_exclusion", sql("fvertices", "features", body=f""", wet AS (SELECT DISTINCT v.feature_id FROM (SELECT feature_id, imagery_id, x AS px, y AS py FROM fvertices WHERE detection_type='ROAD') v
    JOIN features f ON f.imagery_id=v.imagery_id AND f.detection_type='WATER' AND {IN_BOX})
  SELECT feature_id, imagery_id FROM features WHERE detection_type='ROAD' AND feature_id NOT IN (SELECT feature_id FROM wet)"""))
def j16(spark, d):
    water = features_of(spark, d, "WATER").select("imagery_id", F.col("pts").alias("ring"))
    return J.roads_outside_water(features_of(spark, d, "ROAD"), water).select("feature_id", "imagery_id")


def conflicts_sql(wall_road, fence_road, fence_wall, tag):
    drop_fence = f"AND NOT EXISTS (SELECT 1 FROM fvertices r WHERE r.detection_type='ROAD' AND r.imagery_id=m.imagery_id AND sqrt(pow(r.x-m.x,2)+pow(r.y-m.y,2))<{fence_road})" if fence_road else ""
    return f"""w{tag} AS (SELECT m.feature_id FROM mid m WHERE detection_type='WALL' AND NOT EXISTS (SELECT 1 FROM fvertices r WHERE r.detection_type='ROAD' AND r.imagery_id=m.imagery_id AND sqrt(pow(r.x-m.x,2)+pow(r.y-m.y,2))<{wall_road})),
  f{tag} AS (SELECT m.feature_id FROM mid m WHERE detection_type='FENCE' {drop_fence}
    AND NOT EXISTS (SELECT 1 FROM fvertices r WHERE r.feature_id IN (SELECT feature_id FROM w{tag}) AND r.imagery_id=m.imagery_id AND sqrt(pow(r.x-m.x,2)+pow(r.y-m.y,2))<{fence_wall}))"""


@query("j17_class_conflicts", sql("fvertices", body=f""", mid AS (SELECT * FROM fvertices WHERE seq=1), {conflicts_sql(12, None, 10, 'p')}, {conflicts_sql(18, 18, 15, 'm')}
  SELECT 'pixel' AS ruleset, feature_id FROM wp UNION ALL SELECT 'pixel', feature_id FROM fp UNION ALL SELECT 'model', feature_id FROM wm UNION ALL SELECT 'model', feature_id FROM fm"""))
def j17(spark, d):
    f = D.features(spark, d)
    parts = [J.class_conflicts(f, r).select(F.lit(r).alias("ruleset"), "feature_id") for r in ("pixel", "model")]
    return parts[0].unionByName(parts[1])


@query("j18_anchor_filter", sql("features", "fvertices", body=""", ln AS (SELECT feature_id, imagery_id, fx+fw/2e0 AS x, CAST(fy AS DOUBLE) AS y FROM features WHERE detection_type IN ('WALL','FENCE'))
  SELECT feature_id, EXISTS (SELECT 1 FROM fvertices v WHERE v.imagery_id=ln.imagery_id AND v.detection_type='BUILDING' AND sqrt(pow(v.x-ln.x,2)+pow(v.y-ln.y,2))<=28)
   OR EXISTS (SELECT 1 FROM fvertices v WHERE v.imagery_id=ln.imagery_id AND v.detection_type='ROAD' AND sqrt(pow(v.x-ln.x,2)+pow(v.y-ln.y,2))<=22) AS is_anchored FROM ln"""))
def j18(spark, d):
    return J.anchored(features_of(spark, d, "WALL", "FENCE"), features_of(spark, d, "BUILDING"), features_of(spark, d, "ROAD")).select("feature_id", "is_anchored")


@query("j19_settlement_field_filter", sql("features", "fvertices", body=""", fl AS (SELECT * FROM features WHERE detection_type='FIELD'), bl AS (SELECT * FROM features WHERE detection_type='BUILDING'),
  ins AS (SELECT fl.feature_id, count(*) AS n FROM fl JOIN bl ON bl.imagery_id=fl.imagery_id AND bl.fx BETWEEN fl.fx AND fl.fx+fl.fw AND bl.fy BETWEEN fl.fy AND fl.fy+fl.fh GROUP BY 1),
  dense AS (SELECT imagery_id FROM bl GROUP BY 1 HAVING count(*)>=20),
  bor AS (SELECT fl.feature_id, count(DISTINCT v.feature_id) AS n FROM fl JOIN dense USING (imagery_id) JOIN fvertices v ON v.imagery_id=fl.imagery_id AND v.detection_type='BUILDING' AND sqrt(pow(fl.fx-v.x,2)+pow(fl.fy-v.y,2))<30 GROUP BY 1)
  SELECT fl.feature_id, coalesce(ins.n,0) AS inside, CASE WHEN coalesce(ins.n,0)>=2 OR coalesce(ins.n,0)/(fw*fh/10000e0)>0.8e0 THEN 'encloses' WHEN coalesce(bor.n,0)>=2 THEN 'borders' END AS settlement
  FROM fl LEFT JOIN ins USING (feature_id) LEFT JOIN bor USING (feature_id)"""))
def j19(spark, d):
    return J.settlement_fields(features_of(spark, d, "FIELD"), features_of(spark, d, "BUILDING")).select("feature_id", "inside", "settlement")


@query("j22_project_verifications", sql("parcels", "events_fx", body="""SELECT e.event_id, e.parcel_id, e.action FROM events_fx e
  WHERE e.parcel_id IN (SELECT parcel_id FROM parcels WHERE project_id=2 AND status<>'Deleted')"""))
def j22(spark, d):
    mine = D.parcels(spark, d).where("project_id = 2 AND status <> 'Deleted'").select("parcel_id")
    return D.events(spark, d).join(mine, "parcel_id", "left_semi").select("event_id", "parcel_id", "action")


GEO_CENTERS = """, gc AS (SELECT p.parcel_id, m.lng+((x0+w/2e0)/4000e0-0.5e0)*(2*0.0035e0) AS lng, m.lat-((y0+h/2e0)/3000e0-0.5e0)*(2*0.0035e0) AS lat FROM parcels p JOIN imagery m ON m.imagery_id=p.imagery_id WHERE m.is_georeferenced),
  qs AS (SELECT c_custkey AS query_id, 73e0+(c_custkey%25)*0.01e0+(c_custkey%60-30)*0.0001e0 AS lng, 18e0+(c_custkey%25)*0.01e0+(c_custkey%50-25)*0.0001e0 AS lat, 20+c_custkey%60 AS radius_m FROM customer WHERE c_custkey%25%5=0)"""


@query("j23_parcels_within_radius", sql("parcels", "imagery", body=GEO_CENTERS + """, pr AS (SELECT query_id, parcel_id, radius_m, 2*6371008.8e0*atan2(sqrt(a),sqrt(1-a)) AS dist FROM (
    SELECT query_id, parcel_id, radius_m, pow(sin(radians(g.lat-q.lat)/2),2)+cos(radians(q.lat))*cos(radians(g.lat))*pow(sin(radians(g.lng-q.lng)/2),2) AS a FROM qs q JOIN gc g ON abs(g.lat-q.lat)<0.002 AND abs(g.lng-q.lng)<0.002) z)
  SELECT query_id, parcel_id, floor(dist*100+0.5)/100 AS distance_m FROM pr WHERE dist<=radius_m"""))
def j23(spark, d):
    m = D.imagery(spark, d).where("is_georeferenced").select("imagery_id", F.col("lat").alias("lat0"), F.col("lng").alias("lng0"))
    centers = D.parcels(spark, d).join(m, "imagery_id").selectExpr(
        "parcel_id", "lng0+((x0+w/2e0)/4000e0-0.5e0)*(2*0.0035e0) AS lng", "lat0-((y0+h/2e0)/3000e0-0.5e0)*(2*0.0035e0) AS lat"
    )
    queries = D.table(spark, d, "customer").where("c_custkey%25%5=0").selectExpr(
        "c_custkey AS query_id", "73e0+(c_custkey%25)*0.01e0+(c_custkey%60-30)*0.0001e0 AS lng", "18e0+(c_custkey%25)*0.01e0+(c_custkey%50-25)*0.0001e0 AS lat",
        "20+c_custkey%60 AS radius_m",
    )
    return J.parcels_within_radius(queries, centers).select("query_id", "parcel_id", G.js_round(F.col("distance_m"), 2).alias("distance_m"))


@query("j24_nearby_parcels", sql("parcels", body=""", c AS (SELECT parcel_id, imagery_id, x0+w/2e0 AS x, y0+h/2e0 AS y FROM parcels),
  r AS (SELECT a.parcel_id, b.parcel_id AS other_id, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS d, row_number() OVER (PARTITION BY a.parcel_id ORDER BY sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.parcel_id) AS rn FROM c a JOIN c b ON a.imagery_id=b.imagery_id AND a.parcel_id<>b.parcel_id)
  SELECT parcel_id, CAST(rn AS INT) AS rank, other_id, floor(d*1000+0.5)/1000 AS distance FROM r WHERE rn<=3"""))
def j24(spark, d):
    c = D.parcels(spark, d).selectExpr("imagery_id", "parcel_id", "x0+w/2e0 AS px", "y0+h/2e0 AS py")
    return J.nearest_parcels(c, 3).select("parcel_id", "rank", "other_id", G.js_round(F.col("distance"), 3).alias("distance"))


@query("j25_parcel_lookup", sql("parcels", body=""", st AS (SELECT parcel_id, project_id, imagery_id, status, parcel_id AS inserted_at FROM parcels UNION ALL
    SELECT parcel_id//2, project_id, imagery_id, status, 10000000+parcel_id FROM parcels WHERE parcel_id%3=0),
  lk AS (SELECT l_orderkey*1000+l_linenumber*100+l_suppkey%100 AS lookup_id, l_orderkey AS parcel_id, CASE WHEN l_linenumber%3<>0 THEN l_suppkey%5 END AS wp, CASE WHEN l_linenumber%2=0 THEN l_suppkey%25 END AS wi FROM lineitem),
  lq AS (SELECT DISTINCT * FROM lk),
  m AS (SELECT lookup_id, lq.parcel_id, project_id, imagery_id, status, inserted_at, CASE WHEN project_id=wp AND imagery_id=wi THEN 2 WHEN project_id=wp THEN 1 ELSE 0 END AS lv FROM lq JOIN st ON st.parcel_id=lq.parcel_id WHERE status<>'Deleted'),
  r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id, parcel_id ORDER BY lv DESC, inserted_at DESC) AS rn FROM m)
  SELECT lookup_id, parcel_id, max(project_id) AS project_id, max(imagery_id) AS imagery_id, max(lv) AS match_level FROM r WHERE rn=1 GROUP BY 1,2"""))
def j25(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "project_id", "imagery_id", "status", F.col("parcel_id").alias("inserted_at"))
    again = p.where("parcel_id % 3 = 0").select(
        F.expr("parcel_id DIV 2").alias("parcel_id"), "project_id", "imagery_id", "status", (F.lit(10000000) + F.col("parcel_id")).alias("inserted_at")
    )
    lookups = D.table(spark, d, "lineitem").selectExpr(
        "l_orderkey*1000+l_linenumber*100+l_suppkey%100 AS lookup_id", "l_orderkey AS parcel_id",
        "CASE WHEN l_linenumber%3<>0 THEN CAST(l_suppkey%5 AS INT) END AS project_id", "CASE WHEN l_linenumber%2=0 THEN CAST(l_suppkey%25 AS INT) END AS imagery_id",
    ).distinct()
    return J.parcel_lookup(lookups, p.unionByName(again)).select("lookup_id", "parcel_id", "project_id", "imagery_id", "match_level")
