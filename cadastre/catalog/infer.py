"""Queries P01-P12, J20, S16 and the edit operators W07-W10."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.detect import greedy_sql, quads
from cadastre.catalog.joins import IN_BOX, dist_sql, edit_boxes, features_of, shared_area_sql
from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G
from cadastre.operators import audit as A, detect as T, joins as J, measures as M
from cadastre.plans import edits as E, infer as I
from cadastre.session import cut_lineage
from cadastre.sources import derived as D


def bare_and_built(spark, d):
    """All features and images, and every image again, with ids of its own, where buildings are vegetation,
    so both inference strategies run over whole tables."""
    f, images = D.features(spark, d), D.imagery(spark, d)
    bare = f.withColumns({
        "feature_id": -1 - F.col("feature_id"), "imagery_id": F.col("imagery_id") + 1000,
        "detection_type": F.when(F.col("detection_type") == "BUILDING", "VEGETATION").otherwise(F.col("detection_type")),
    })
    return f.unionByName(bare), images.unionByName(images.withColumn("imagery_id", F.col("imagery_id") + 1000))


@query("p01_infer_parcels")
def p01(spark, d):
    r = I.infer_parcels(*bare_and_built(spark, d))
    return r.parcels.select("imagery_id", "candidate_id", "kind", "candidate_status", "confidence", "supported_pct", "road_pct", "wall_fence_pct", G.js_round(F.col("area")).alias("area"))


@query("s16_generate_and_audit")
def s16(spark, d):
    features, images = bare_and_built(spark, d)
    r = I.infer_parcels(features, images)
    parcels = r.parcels.join(images.select("imagery_id", "project_id", "is_georeferenced"), "imagery_id").select(
        F.col("candidate_id").alias("parcel_id"), "project_id", "imagery_id", "status", "confidence", F.lit(None).cast("string").alias("topology_issue"), "is_georeferenced", "ring"
    )
    parts = A.audit_parts(cut_lineage(parcels), images)
    return A.topology_audit(parts).withColumn("job_status", F.lit("COMPLETED")).withColumn("progress", F.lit(100))


GATED = "CASE WHEN fw%5=0 OR (imagery_id%3=1 AND detection_type NOT IN ('VEGETATION','WATER')) THEN false ELSE is_valid END"


@query("p02_evidence_gate", sql("features", "imagery", body=f""", v AS (SELECT imagery_id, detection_type, {GATED} AS ok FROM features UNION ALL SELECT imagery_id, NULL, false FROM imagery UNION ALL SELECT imagery_id+1000, NULL, false FROM imagery),
  g AS (SELECT imagery_id, count(CASE WHEN ok THEN 1 END) AS features, count(CASE WHEN ok AND detection_type='ROAD' THEN 1 END) AS roads, count(CASE WHEN ok AND detection_type='FIELD' THEN 1 END) AS fields,
   count(CASE WHEN ok AND detection_type IN ('WALL','FENCE') THEN 1 END) AS boundaries, count(CASE WHEN ok AND detection_type='BUILDING' THEN 1 END) AS buildings FROM v GROUP BY 1)
  SELECT *, CASE WHEN roads=0 AND fields=0 AND boundaries=0 THEN 'FAILED' ELSE 'OK' END AS status, CASE WHEN roads=0 AND fields=0 AND boundaries=0 THEN 'Insufficient validated spatial evidence for parcel generation.' END AS reason,
   CASE WHEN roads=0 AND fields=0 AND boundaries=0 THEN NULL WHEN buildings>0 AND roads>0 THEN 'houses' ELSE 'land' END AS strategy FROM g"""))
def p02(spark, d):
    images = D.imagery(spark, d)
    bare = images.withColumn("imagery_id", F.col("imagery_id") + 1000)  # images of their own, without features
    return I.evidence_gate(D.features(spark, d).withColumn("is_valid", F.expr(GATED)), images.unionByName(bare))


DRY_ROADS = f""", wet AS (SELECT DISTINCT v.feature_id FROM (SELECT feature_id, imagery_id, x AS px, y AS py FROM fvertices WHERE detection_type='ROAD') v JOIN features f ON f.imagery_id=v.imagery_id AND f.detection_type='WATER' AND f.is_valid AND {IN_BOX}),
  rd AS (SELECT * FROM features WHERE detection_type='ROAD' AND is_valid AND feature_id NOT IN (SELECT feature_id FROM wet)),
  e AS (SELECT feature_id*2 AS id, imagery_id, fx AS x, fy AS y FROM rd UNION ALL SELECT feature_id*2+1, imagery_id, fx+fw, fy+fh FROM rd),
  pl AS (SELECT imagery_id, x, y, min(id) AS id FROM e GROUP BY 1,2,3),
  q AS (SELECT a.id AS s, b.id AS w, a.x AS sx, a.y AS sy FROM pl a JOIN pl b ON a.imagery_id=b.imagery_id AND a.id<b.id AND sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))<20), pairs AS (SELECT s, w FROM q)""" + greedy_sql() + """,
  mv AS (SELECT w, arg_min(sx, s) AS x, arg_min(sy, s) AS y FROM q WHERE s NOT IN (SELECT id FROM dropped) GROUP BY 1),
  se AS (SELECT e.id, e.imagery_id, mv.w IS NOT NULL AS moved, CAST(coalesce(mv.x,e.x) AS DOUBLE) AS x, CAST(coalesce(mv.y,e.y) AS DOUBLE) AS y FROM e JOIN pl ON pl.imagery_id=e.imagery_id AND pl.x=e.x AND pl.y=e.y LEFT JOIN mv ON mv.w=pl.id),
  rs AS (SELECT rd.feature_id, rd.imagery_id, h.x AS x1, h.y AS y1, CAST(fx+fw AS DOUBLE) AS x2, CAST(fy AS DOUBLE) AS y2 FROM rd JOIN se h ON h.id=rd.feature_id*2 UNION ALL
         SELECT rd.feature_id, rd.imagery_id, CAST(fx+fw AS DOUBLE), CAST(fy AS DOUBLE), t.x, t.y FROM rd JOIN se t ON t.id=rd.feature_id*2+1),
  rx AS (SELECT a.imagery_id, ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1))/((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)) AS ua, ((a.x2-a.x1)*(a.y1-b.y1)-(a.y2-a.y1)*(a.x1-b.x1))/((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)) AS ub
    FROM rs a JOIN rs b ON a.imagery_id=b.imagery_id AND a.feature_id<b.feature_id AND (b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1)<>0),
  ix AS (SELECT imagery_id, count(*) AS n FROM rx WHERE ua>=0 AND ua<=1 AND ub>=0 AND ub<=1 GROUP BY 1),
  sn AS (SELECT imagery_id, count(CASE WHEN moved THEN 1 END) AS snapped FROM se GROUP BY 1)"""


@query("p03_road_network", sql("fvertices", body=DRY_ROADS + " SELECT rd.imagery_id, count(*) AS roads, any_value(snapped) AS snapped, coalesce(any_value(ix.n),0) AS intersections FROM rd JOIN sn USING (imagery_id) LEFT JOIN ix USING (imagery_id) GROUP BY 1"))
def p03(spark, d):
    ev = I.Evidence.of(D.features(spark, d))
    return I.network_counts(cut_lineage(I.road_network(ev.roads, ev.water)))


def network_of(spark, d):
    ev = I.Evidence.of(D.features(spark, d))
    return ev, cut_lineage(I.road_network(ev.roads, ev.water))


@query("p04_field_candidates")
def p04(spark, d):
    ev, network = network_of(spark, d)
    kept, rejected = I.field_candidates(ev, network)
    return kept.select("imagery_id", "feature_id", F.lit("kept").alias("outcome"), "candidate_status", "confidence", "supported_pct").unionByName(
        rejected.select("imagery_id", F.col("item_id").alias("feature_id"), F.col("category").alias("outcome")), allowMissingColumns=True
    )


@query("p05_enclosure_candidates")
def p05(spark, d):
    ev, network = network_of(spark, d)
    fields = ev.fields.select("imagery_id", F.col("pts").alias("ring"))
    kept, rejected = I.enclosure_candidates(ev, network, fields)
    return kept.select("imagery_id", "feature_id", F.lit("kept").alias("outcome"), "candidate_status", "confidence", "supported_pct").unionByName(
        rejected.select("imagery_id", F.col("item_id").alias("feature_id"), F.col("category").alias("outcome")), allowMissingColumns=True
    )


@query("p06_holding_candidates")
def p06(spark, d):
    ev, network = network_of(spark, d)
    fields = ev.fields.select("imagery_id", F.col("pts").alias("ring"))
    kept, rejected = I.holding_candidates(ev, network, D.imagery(spark, d), fields)
    return kept.select("imagery_id", "feature_id", "block_id", "enclosed", "candidate_status", "confidence", "supported_pct", G.js_round(F.col("area")).alias("area")).unionByName(
        rejected.select("imagery_id", F.col("item_id").alias("feature_id"), F.col("category").alias("rejected")), allowMissingColumns=True
    )


@query("j20_assign_to_road", sql("fvertices", "fedges", body=f""", bc AS (SELECT feature_id, imagery_id, avg(x) AS px, avg(y) AS py FROM fvertices WHERE detection_type='BUILDING' GROUP BY 1,2),
  fr AS (SELECT * FROM bc WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.imagery_id=bc.imagery_id AND f.detection_type='FIELD' AND {IN_BOX})),
  q AS (SELECT b.feature_id, px, py, e.feature_id AS line_id, e.seg, x1, y1, x2, y2 FROM fr b JOIN fedges e ON e.imagery_id=b.imagery_id AND e.detection_type='ROAD' AND px BETWEEN least(x1,x2)-131 AND greatest(x1,x2)+131 AND py BETWEEN least(y1,y2)-131 AND greatest(y1,y2)+131),
  n AS (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY dist, line_id, seg) AS rn FROM {dist_sql('q')} z WHERE dist<=130),
  r AS (SELECT *, row_number() OVER (PARTITION BY imagery_id ORDER BY feature_id) AS rk FROM features WHERE detection_type='ROAD'), one AS (SELECT imagery_id, (3*fx+2*fw)/3e0 AS mx, (3*fy+fh)/3e0 AS my FROM r WHERE rk=1), two AS (SELECT imagery_id, (3*fx+2*fw)/3e0 AS mx, (3*fy+fh)/3e0 AS my FROM r WHERE rk=2),
  s AS (SELECT imagery_id, least(one.my,two.my) AS sy, (one.mx+two.mx)/2 AS sx FROM one JOIN two USING (imagery_id)),
  b AS (SELECT imagery_id, 'block_north' AS block_id, 0e0 AS x1, 0e0 AS y1, 4000e0 AS x2, greatest(sy,1050) AS y2 FROM s UNION ALL SELECT imagery_id, 'block_west_central', 0e0, least(sy,900), sx, 3000e0 FROM s UNION ALL SELECT imagery_id, 'block_south_settlement', sx, least(sy,1050), 4000e0, 3000e0 FROM s)
  SELECT fr.feature_id, b.block_id, n.line_id AS road_id FROM fr JOIN n ON n.feature_id=fr.feature_id AND n.rn=1 JOIN b ON b.imagery_id=fr.imagery_id AND fr.px BETWEEN b.x1 AND b.x2 AND fr.py BETWEEN b.y1 AND b.y2"""))
def j20(spark, d):
    roads = features_of(spark, d, "ROAD").select("imagery_id", "feature_id", "pts")
    blocks = T.land_blocks(roads, D.imagery(spark, d))
    points = J.feature_points(features_of(spark, d, "BUILDING"), ["imagery_id", "feature_id"])
    fields = features_of(spark, d, "FIELD").select("imagery_id", F.col("pts").alias("ring"))
    return I.assign_to_road(points, roads, blocks, fields).select("feature_id", "block_id", "road_id")


@query("p07_house_candidates")
def p07(spark, d):
    kept, rejected = I.house_candidates(I.Evidence.of(D.features(spark, d)))
    return kept.select("imagery_id", "feature_id", F.lit("kept").alias("outcome"), "supported_pct", G.js_round(F.col("area")).alias("area"), G.js_round(F.col("score"), 4).alias("score")).unionByName(
        rejected.select("imagery_id", F.col("item_id").alias("feature_id"), F.col("category").alias("outcome")), allowMissingColumns=True
    )


def scored_parcels(spark, d):
    """Parcels as scored candidates."""
    p = M.repair_rings(D.parcels(spark, d).where("shape <> 'bowtie'"))
    return p.select(
        "imagery_id", F.col("parcel_id").alias("feature_id"), F.col("clean").alias("ring"), (40 + F.col("parcel_id") * 7 % 57).cast("int").alias("supported_pct"),
        (F.col("parcel_id") * 31 % 1000 / 1000.0).alias("score"),
    )


# quads lean by five pixels on their left side; convex shapes are apart when one of their sides' normals parts them
LEANS = "({a}.h*({b}.x0+{b}.w)-5*{b}.y0 < {a}.h*{a}.x0-5*{a}.y0 OR {a}.h*({a}.x0+{a}.w)-5*{a}.y0 < least({a}.h*{b}.x0-5*{b}.y0, {a}.h*({b}.x0+5)-5*({b}.y0+{b}.h)))"
QUADS_MEET = f"a.x0<=b.x0+b.w AND b.x0<=a.x0+a.w AND a.y0<=b.y0+b.h AND b.y0<=a.y0+a.h AND NOT {LEANS.format(a='a', b='b')} AND NOT {LEANS.format(a='b', b='a')}"


@query("p08_select_disjoint", sql("parcels", body=f""", c AS (SELECT imagery_id, parcel_id AS id, x0, y0, w, h, 40+parcel_id*7%57 AS sup, parcel_id*31%1000/1000e0 AS score FROM parcels WHERE shape<>'bowtie'),
  o AS (SELECT *, CASE WHEN sup>=58 THEN 0 WHEN sup>=50 THEN 1 ELSE 2 END AS tier FROM c),
  mt AS MATERIALIZED (SELECT a.id AS s, b.id AS w FROM o a JOIN o b ON a.imagery_id=b.imagery_id AND a.id<>b.id AND a.sup>=45 AND b.sup>=45 AND (a.tier<b.tier OR (a.tier=b.tier AND (a.score>b.score OR (a.score=b.score AND a.id<b.id)))) AND {QUADS_MEET}),
  pairs AS (SELECT s, w FROM mt)""" + greedy_sql() + """,
  ch AS (SELECT *, CASE WHEN sup>=50 THEN 'ACCEPTED' ELSE 'REVIEW' END AS status FROM o WHERE sup>=45 AND id NOT IN (SELECT id FROM dropped))
  SELECT imagery_id, id AS feature_id, status AS candidate_status, CAST(row_number() OVER (PARTITION BY imagery_id, status ORDER BY tier, score DESC, id) AS INT) AS pick, sup AS supported_pct, NULL AS reason FROM ch
  UNION ALL SELECT imagery_id, id, 'LEFT', NULL, sup, CASE WHEN sup<45 THEN 'Weak evidence' ELSE 'Meets a chosen candidate' END FROM o WHERE id NOT IN (SELECT id FROM ch)
  UNION ALL SELECT imagery_id, parcel_id, 'REFUSED', NULL, 40+parcel_id*7%57, 'Crossing ring' FROM parcels WHERE shape='bowtie'"""))
def p08(spark, d):
    s = I.select_disjoint(scored_parcels(spark, d)).select("imagery_id", "feature_id", "candidate_status", "pick", "supported_pct", "reason")
    crossing = D.parcels(spark, d).where("shape = 'bowtie'").selectExpr(
        "imagery_id", "parcel_id AS feature_id", "'REFUSED' AS candidate_status", "CAST(NULL AS INT) AS pick", "CAST(40 + parcel_id * 7 % 57 AS INT) AS supported_pct", "'Crossing ring' AS reason"
    )
    return s.unionByName(crossing)


@query("p09_evidence_score", sql("edges", "fedges", "parcels", body=f""", pe AS (SELECT parcel_id, imagery_id, seq, sqrt(pow(x2-x1,2)+pow(y2-y1,2)) AS len, (x1+x2)/2 AS px, (y1+y2)/2 AS py FROM edges),
  q AS (SELECT parcel_id, seq, px, py, e.x1, e.y1, e.x2, e.y2 FROM pe JOIN fedges e ON e.imagery_id=pe.imagery_id AND e.detection_type='ROAD' AND px BETWEEN least(e.x1,e.x2)-57 AND greatest(e.x1,e.x2)+57 AND py BETWEEN least(e.y1,e.y2)-57 AND greatest(e.y1,e.y2)+57),
  hit AS (SELECT DISTINCT parcel_id, seq FROM {dist_sql('q')} z WHERE dist<=56),
  b AS (SELECT pe.parcel_id, pe.seq, len, h.seq IS NOT NULL AS road, px, py, CAST(x0 AS DOUBLE) AS x1, CAST(y0+h AS DOUBLE)+20 AS y1, CAST(x0+w AS DOUBLE) AS x2, CAST(y0+h AS DOUBLE)+20 AS y2 FROM pe JOIN parcels USING (parcel_id) LEFT JOIN hit h ON h.parcel_id=pe.parcel_id AND h.seq=pe.seq),
  a AS (SELECT parcel_id, sum(len) AS tot, coalesce(sum(CASE WHEN road THEN len END),0) AS rl, coalesce(sum(CASE WHEN NOT road AND dist<=56 THEN len END),0) AS wl FROM {dist_sql('b')} z GROUP BY 1),
  s AS (SELECT parcel_id, CAST(floor(rl/tot*100+0.5) AS INT) AS road_pct, CAST(floor(wl/tot*100+0.5) AS INT) AS wall_fence_pct, CAST(least(96,greatest(48,floor((rl+wl)*1.35e0/tot*100+0.5))) AS INT) AS supported_pct FROM a)
  SELECT parcel_id, road_pct, wall_fence_pct, supported_pct, floor((coalesce(confidence,0.85e0)*0.40e0+supported_pct/100e0*0.35e0+CASE WHEN parcel_id%3<>0 AND parcel_id%300<=175 THEN 0.25e0 ELSE 0.10e0 END)*10000+0.5)/10000 AS score FROM s JOIN parcels USING (parcel_id)"""))
def p09(spark, d):
    x, y, w = F.col("x0"), F.col("y0") + F.col("h") + 20, F.col("w")
    c = D.parcels(spark, d).select(
        "imagery_id", F.col("parcel_id").alias("feature_id"), "ring", "confidence", G.ring((x, y), (x + w, y)).alias("bound"),
        F.when(F.col("parcel_id") % 3 != 0, (F.col("parcel_id") % 300).cast("double")).alias("road_distance"),
    )
    s = I.evidence_score(c, features_of(spark, d, "ROAD"))
    return s.select(F.col("feature_id").alias("parcel_id"), "road_pct", "wall_fence_pct", "supported_pct", G.js_round(F.col("score"), 4).alias("score"))


REASONS = f""", s AS (SELECT e.parcel_id, e.imagery_id, x1*(1-t)+x2*t AS px, y1*(1-t)+y2*t AS py FROM redges e, (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) k(t) UNION ALL
    SELECT parcel_id, imagery_id, sum(x)/(count(*)-1), sum(y)/(count(*)-1) FROM rvertices GROUP BY 1,2),
  wt AS (SELECT DISTINCT parcel_id FROM s JOIN features f ON f.imagery_id=s.imagery_id AND detection_type='WATER' AND {IN_BOX}),
  z AS (SELECT parcel_id, abs(sum(x1*y2-x2*y1))/2 AS area, sum(sqrt(pow(x2-x1,2)+pow(y2-y1,2))) AS len FROM redges GROUP BY 1),
  rs AS (SELECT p.parcel_id, p.imagery_id, coalesce(p.confidence,0) AS conf, p.x0, p.y0, p.w, p.h, CASE WHEN wt.parcel_id IS NOT NULL THEN 'water overlap' WHEN shape IN ('quad','open','dupvertex') AND h>5 THEN 'building-box artifact'
    WHEN area>5400000 OR (area>35000 AND 100-p.parcel_id%100>50) THEN 'excessive size' WHEN area<3600 THEN 'invalid geometry' WHEN 4*pi()*area/(len*len)<0.015e0 AND area<1500 THEN 'invalid geometry'
    WHEN p.parcel_id%100<35 THEN 'insufficient boundary evidence' WHEN coalesce(p.confidence,0)<0.6 THEN 'insufficient boundary evidence' END AS reason FROM parcels p JOIN z USING (parcel_id) LEFT JOIN wt USING (parcel_id))"""


def judged_candidates(spark, d):
    p = M.repair_rings(D.parcels(spark, d)).select(
        "imagery_id", F.col("parcel_id").alias("candidate_id"), F.col("clean").alias("ring"), "confidence", (F.col("parcel_id") % 100).cast("int").alias("supported_pct"),
        (100 - F.col("parcel_id") % 100).cast("int").alias("unsupported_pct"), F.lit(False).alias("is_field"),
    )
    water = features_of(spark, d, "WATER").select("imagery_id", F.col("pts").alias("ring"))
    return p, water


@query("p10_validate_candidates", sql("redges", "features", body=REASONS + " SELECT parcel_id AS candidate_id, reason FROM rs"))
def p10(spark, d):
    return I.candidate_reasons(*judged_candidates(spark, d)).select("candidate_id", "reason")


@query("p10_duplicate_candidates", sql("parcels", body=""", b0 AS (SELECT parcel_id, imagery_id, coalesce(confidence,0) AS conf, x0-20 AS xa, y0-20 AS ya, x0+w+20 AS xb, y0+h+20 AS yb FROM parcels),
  rs AS (SELECT parcel_id, CASE WHEN (xb-xa)*(yb-ya)-50-(xb-xa-10)*5<3600 THEN 'invalid geometry' WHEN parcel_id%100<35 OR conf<0.6 THEN 'insufficient boundary evidence' END AS reason FROM b0),
  b AS (SELECT b0.* FROM b0 JOIN rs USING (parcel_id) WHERE reason IS NULL),
  q AS (SELECT a.parcel_id AS s, z.parcel_id AS w, (least(a.xb,z.xb)-greatest(a.xa,z.xa))*(least(a.yb,z.yb)-greatest(a.ya,z.ya)) AS i, (a.xb-a.xa)*(a.yb-a.ya)+(z.xb-z.xa)*(z.yb-z.ya) AS t FROM b a JOIN b z ON a.imagery_id=z.imagery_id AND (a.conf>z.conf OR (a.conf=z.conf AND a.parcel_id<z.parcel_id))
    AND a.xa<z.xb AND z.xa<a.xb AND a.ya<z.yb AND z.ya<a.yb), pairs AS (SELECT s, w FROM q WHERE i/CAST(t-i AS DOUBLE)>0.45e0)""" + greedy_sql() + " SELECT parcel_id AS candidate_id, CASE WHEN parcel_id IN (SELECT id FROM dropped) THEN 'duplicate' ELSE reason END AS reason FROM rs"))
def p10_duplicates(spark, d):
    # rings with cut corners are no boxes, and the water lies in other images
    x1, y1, x2, y2 = F.col("x0") - 20, F.col("y0") - 20, F.col("x0") + F.col("w") + 20, F.col("y0") + F.col("h") + 20
    ring = G.ring((x1 + 10, y1), (x2, y1 + 10), (x2, y2), (x1, y2), (x1, y1 + 10), (x1 + 10, y1))
    p = D.parcels(spark, d).select(
        "imagery_id", F.col("parcel_id").alias("candidate_id"), ring.alias("ring"), "confidence", (F.col("parcel_id") % 100).cast("int").alias("supported_pct"), F.lit(10).alias("unsupported_pct"), F.lit(True).alias("is_field")
    )
    water = features_of(spark, d, "WATER").select((F.col("imagery_id") + 1000).alias("imagery_id"), F.col("pts").alias("ring"))
    return I.validate_candidates(p, water).select("candidate_id", "reason")


@query("p11_bbox_iou", sql("parcels", body=""", q AS (SELECT a.parcel_id AS parcel_a, b.parcel_id AS parcel_b, (least(a.x0+a.w,b.x0+b.w)-greatest(a.x0,b.x0))*(least(a.y0+a.h,b.y0+b.h)-greatest(a.y0,b.y0)) AS i, a.w*a.h+b.w*b.h AS t FROM parcels a JOIN parcels b
   ON a.imagery_id=b.imagery_id AND a.parcel_id<b.parcel_id AND a.x0<b.x0+b.w AND b.x0<a.x0+a.w AND a.y0<b.y0+b.h AND b.y0<a.y0+a.h) SELECT parcel_a, parcel_b, floor(i/CAST(t-i AS DOUBLE)*1000000+0.5)/1000000 AS iou FROM q"""))
def p11(spark, d):
    from cadastre.operators.grid import overlapping_boxes

    b = G.once(D.parcels(spark, d).select("imagery_id", "parcel_id", "ring"), bb=G.bbox(F.col("ring"))).drop("ring")
    pairs = overlapping_boxes(b, b, ["imagery_id"], once=F.col("a_parcel_id") < F.col("b_parcel_id"), strict=True)
    return pairs.select(F.col("a_parcel_id").alias("parcel_a"), F.col("b_parcel_id").alias("parcel_b"), G.js_round(I.bbox_iou("a_bb", "b_bb"), 6).alias("iou"))


@query("p12_explain", sql("parcels", body=""", c AS (SELECT parcel_id, CAST(parcel_id*7%101 AS INT) AS s, CAST(parcel_id%40 AS INT) AS r, CAST(parcel_id%23 AS INT) AS w, CAST(parcel_id%31 AS INT) AS f, parcel_id%3 AS e, CASE WHEN parcel_id%2=0 THEN 'Eastern' ELSE 'Northern' END AS dir FROM parcels)
  SELECT parcel_id, concat_ws('; ', CASE WHEN r>0 THEN 'Road boundary ✓ ('||r||'% edge)' END, CASE WHEN f>0 THEN 'Field boundary ✓ ('||f||'% edge)' END, CASE WHEN w>0 THEN 'Wall/fence evidence ✓ ('||w||'% edge)' END, CASE WHEN e>0 THEN 'Building context ✓ ('||e||' structure(s))' END,
    CASE WHEN 100-s>0 THEN dir||' boundary unsupported ⚠ ('||(100-s)||'%)' END) AS supporting_features,
   CASE WHEN s>=60 THEN 'Strongly supported by physical evidence ('||s||'% perimeter supported).' WHEN 100-s>25 THEN 'Partially supported parcel ('||s||'% supported). '||dir||' boundary is unsupported ('||(100-s)||'% unverified edge).' ELSE 'Physical demarcation detected ('||s||'% supported) but requires manual verification.' END AS decision_reason FROM c"""))
def p12(spark, d):
    k = F.col("parcel_id")
    c = D.parcels(spark, d).select(
        "parcel_id", (k * 7 % 101).cast("int").alias("supported_pct"), (k % 40).cast("int").alias("road_pct"), (k % 23).cast("int").alias("wall_fence_pct"), (k % 31).cast("int").alias("field_pct"),
        (k % 3).alias("enclosed"), F.when(k % 2 == 0, "eastern").otherwise("northern").alias("unsupported_direction"),
    ).withColumn("unsupported_pct", 100 - F.col("supported_pct")).withColumn("candidate_status", F.when(F.col("supported_pct") >= 60, "ACCEPTED").otherwise("REVIEW"))
    return I.explain(c).select("parcel_id", F.array_join("supporting_features", "; ").alias("supporting_features"), "decision_reason")


def pixel_parcels(spark, d):
    return M.repair_rings(D.parcels(spark, d)).withColumn("mode", F.lit("image"))


def water_of(spark, d):
    return features_of(spark, d, "WATER").select("imagery_id", F.col("pts").alias("ring"))


@query("w07_apply_splits")
def w07(spark, d):
    p = pixel_parcels(spark, d).select("parcel_id", "project_id", "imagery_id", "mode", "clean", "confidence")
    requests = p.select("parcel_id", F.lit(None).cast("array<struct<x:double,y:double>>").alias("cut"))
    children, rejected, _ = E.apply_splits(requests, p, water_of(spark, d), D.features(spark, d))
    return children.select("parcel_id", "status", "source", "area_px", "supported_pct", F.lit(None).cast("string").alias("reason")).unionByName(
        rejected.select(F.col("parcel_id").cast("string").alias("parcel_id"), "reason"), allowMissingColumns=True
    )


@query("w08_undo_split", sql("parcels", body=""", ch AS (SELECT parcel_id||'-A' AS parcel_id, parcel_id AS parent, 'needs_review' AS status FROM parcels WHERE status='split' UNION ALL SELECT parcel_id||'-B', parcel_id, 'needs_review' FROM parcels WHERE status='split')
  SELECT CAST(parcel_id AS VARCHAR) AS parcel_id, status FROM parcels WHERE status<>'split' UNION ALL SELECT parcel_id, status FROM ch WHERE parent%2<>0 UNION ALL SELECT CAST(parcel_id AS VARCHAR), 'needs_review' FROM parcels WHERE status='split' AND parcel_id%2=0"""))
def w08(spark, d):
    p = D.parcels(spark, d).select("parcel_id", "status", "ring")
    split = p.where("status = 'split'")
    children = split.select(F.explode(F.array(F.lit("-A"), F.lit("-B"))).alias("h"), "parcel_id", "ring").select(F.concat("parcel_id", "h").alias("parcel_id"), F.lit("needs_review").alias("status"), "ring")
    stock = p.where("status <> 'split'").select(F.col("parcel_id").cast("string").alias("parcel_id"), "status", "ring").unionByName(children)
    versions = split.select(F.col("parcel_id").cast("string").alias("parent_id"), F.col("ring").alias("previous_ring"))
    requests = split.where("parcel_id % 2 = 0").select(F.col("parcel_id").cast("string").alias("parent_id"))
    parcels, _ = E.undo_splits(requests, stock, versions)
    return parcels.select("parcel_id", "status")


@query("w09_apply_merges", sql("parcels", body=""" SELECT parcel_id, parcel_id+1000000000000 AS target_id, CAST(floor(CASE parcel_id%3 WHEN 0 THEN (2*w-5)*h/2e0+30*h WHEN 1 THEN (2*w-5)*h/2e0+20*h ELSE (2*(w+55)-5)*h/2e0 END+1e-6+0.5) AS BIGINT) AS area_px, 'Merged from '||parcel_id||' + '||(parcel_id+1000000000000) AS source FROM parcels"""))
def w09(spark, d):
    x, y, w, h, k = F.col("x0"), F.col("y0"), F.col("w"), F.col("h"), F.col("parcel_id") % 3
    q = quads(spark, d)
    target = F.col("parcel_id") + 1000000000000
    left = x + w + F.when(k == 0, 0).when(k == 1, -10).otherwise(25)
    own = q.select("parcel_id", "project_id", "imagery_id", F.lit("image").alias("mode"), F.col("ring").alias("clean"))
    other = q.select(target.alias("parcel_id"), "project_id", "imagery_id", F.lit("image").alias("mode"), G.ring((left, y), (left + 30, y), (left + 30, y + h), (left, y + h), (left, y)).alias("clean"))
    requests = own.select("parcel_id", target.alias("target_id"))
    done, _, _ = E.apply_merges(requests, own.unionByName(other), D.features(spark, d))
    return done.select("parcel_id", "target_id", G.js_round(G.planar_area(F.col("ring")) + 1e-6).alias("area_px"), "source")


@query("w10_apply_edits", sql("redges", "features", "fedges", "events_fx", body=""", ed AS (SELECT e.event_id AS edit_id, p.* FROM events_fx e JOIN parcels p USING (parcel_id) WHERE e.action='Edited'),
  me AS (SELECT ed.edit_id AS id, ed.imagery_id, e.seq, e.x1+ed.edit_id%40 AS x1, e.y1+ed.edit_id%30 AS y1, e.x2+ed.edit_id%40 AS x2, e.y2+ed.edit_id%30 AS y2 FROM ed JOIN redges e ON e.parcel_id=ed.parcel_id WHERE ed.shape<>'bowtie'),
  mb AS (SELECT id, any_value(imagery_id) AS imagery_id, min(x1) AS xa, min(y1) AS ya, max(x1) AS xb, max(y1) AS yb FROM me GROUP BY 1),
  we AS (SELECT feature_id AS id, imagery_id, seg AS seq, x1, y1, x2, y2 FROM fedges WHERE detection_type='WATER'),
  cand AS (SELECT mb.id AS edit_id, f.feature_id FROM mb JOIN features f ON f.imagery_id=mb.imagery_id AND f.detection_type='WATER' AND xa<fx+fw AND fx<xb AND ya<fy+fh AND fy<yb)""" + shared_area_sql("me", "we", "cand", "edit_id", "feature_id") + """,
  wt AS (SELECT DISTINCT edit_id FROM shared WHERE area>1e-6),
  bx AS (SELECT parcel_id, imagery_id, x0 AS xa, y0 AS ya, x0+w AS xb, y0+h AS yb FROM parcels WHERE status='accepted'),
  nbp AS (SELECT a.edit_id, b.parcel_id AS other, (least(a.x0+a.w+a.edit_id%40,b.xb)-greatest(a.x0+a.edit_id%40,b.xa))*(least(a.y0+a.h+a.edit_id%30,b.yb)-greatest(a.y0+a.edit_id%30,b.ya)) AS inter, a.w*a.h AS own FROM ed a JOIN bx b ON a.imagery_id=b.imagery_id AND a.parcel_id<>b.parcel_id
     AND a.x0+a.edit_id%40<=b.xb AND b.xa<=a.x0+a.w+a.edit_id%40 AND a.y0+a.edit_id%30<=b.yb AND b.ya<=a.y0+a.h+a.edit_id%30),
  nb AS (SELECT edit_id, min(other) AS other FROM nbp WHERE inter>200 AND inter/CAST(own AS DOUBLE)>0.08e0 GROUP BY 1)
  SELECT ed.edit_id, shape<>'bowtie' AND wt.edit_id IS NULL AND nb.edit_id IS NULL AS saved, concat_ws('; ', CASE WHEN shape='bowtie' THEN 'Polygon boundary contains 1 self-intersecting segments.' END, CASE WHEN shape='bowtie' THEN 'Polygon area must be greater than zero.' END,
    CASE WHEN wt.edit_id IS NOT NULL THEN 'Prohibited water overlap detected with water body' END, CASE WHEN nb.edit_id IS NOT NULL THEN 'Unacceptable overlap with accepted neighboring parcel '||nb.other END) AS reasons FROM ed LEFT JOIN wt USING (edit_id) LEFT JOIN nb USING (edit_id)"""))
def w10(spark, d):
    _, accepted = edit_boxes(spark, d)
    e = D.events(spark, d).where("action = 'Edited'").select(F.col("event_id").alias("edit_id"), "parcel_id").join(D.parcels(spark, d).select("parcel_id", "imagery_id", "ring"), "parcel_id")
    moved = e.withColumn("ring", F.transform("ring", lambda q: G.point(q["x"] + F.col("edit_id") % 40, q["y"] + F.col("edit_id") % 30))).withColumn("mode", F.lit("image"))
    return E.apply_edits(moved, accepted, water_of(spark, d)).select("edit_id", "saved", F.array_join("reasons", "; ").alias("reasons"))
