"""Queries R01-R16 on the pixel table; windows on both sides, recursion free."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.catalog.prelude import sql
from cadastre.catalog.registry import query
from cadastre.functions import geom as G, rings as S
from cadastre.operators import raster as R
from cadastre.session import cut_lineage
from cadastre.sources import derived as D

W, H = D.TILE_WIDTH, D.TILE_HEIGHT
TOTAL = float(W * H)


def sizes(spark, d, pixels):
    """Image heights differ only for the last image, which may be cut short."""
    return pixels.groupBy("imagery_id").agg((F.max("y") + 1).alias("height")).withColumn("width", F.lit(W))


IDX = """, hx AS (SELECT *, r/255e0 AS rr, g/255e0 AS gg, b/255e0 AS bb, greatest(r,g,b)/255e0 AS hi, least(r,g,b)/255e0 AS lo FROM pixels),
  hh AS (SELECT *, hi-lo AS de, CASE WHEN hi=lo THEN 0 WHEN hi=rr THEN 60*((gg-bb)/(hi-lo)) WHEN hi=gg THEN 60*((bb-rr)/(hi-lo)+2) ELSE 60*((rr-gg)/(hi-lo)+4) END AS h0 FROM hx),
  idx AS (SELECT imagery_id, x, y, r, g, b, 0.299e0*r+0.587e0*g+0.114e0*b AS luma, CASE WHEN h0<0 THEN h0+360 ELSE h0 END AS hue, CASE WHEN hi=0 THEN 0 ELSE de/hi END AS sat, hi AS val, 2*gg-rr-bb AS exg FROM hh)"""


@query("r01_spectral_indices", sql("pixels", body=IDX + """ SELECT imagery_id, x, y, floor(luma*1000+0.5)/1000 AS luma, floor(hue*1000+0.5)/1000 AS hue, floor(sat*10000+0.5)/10000 AS sat, floor(exg*10000+0.5)/10000 AS exg FROM idx"""))
def r01(spark, d):
    i = R.indices(D.pixels(spark, d))
    return i.select("imagery_id", "x", "y", *[G.js_round(F.col(c), n).alias(c) for c, n in (("luma", 3), ("hue", 3), ("sat", 4), ("exg", 4))])


LEAFY = "(sat>=0.20e0 AND hue BETWEEN 45 AND 155 AND exg>0.05e0)"
MASKS = f"""SELECT imagery_id, count(CASE WHEN NOT {LEAFY} AND ((sat<=0.38e0 AND val BETWEEN 0.20e0 AND 0.98e0) OR (hue BETWEEN 14 AND 45 AND sat<=0.45e0 AND val BETWEEN 0.25e0 AND 0.85e0)) THEN 1 END) AS road,
  count(CASE WHEN NOT {LEAFY} AND (((hue<=40 OR hue>=335) AND sat>=0.20e0 AND val>=0.22e0) OR (val>=0.60e0 AND sat<=0.35e0) OR (val BETWEEN 0.46e0 AND 0.95e0 AND sat<=0.25e0) OR (hue BETWEEN 175 AND 245 AND sat>=0.18e0 AND val>=0.18e0)) THEN 1 END) AS building,
  count(CASE WHEN exg>0.05e0 OR (hue BETWEEN 45 AND 160 AND sat>=0.18e0 AND val>=0.18e0) OR (hue BETWEEN 18 AND 42 AND sat>=0.28e0 AND val>=0.22e0) THEN 1 END) AS field,
  count(CASE WHEN exg>0.20e0 AND hue BETWEEN 45 AND 155 AND sat>0.35e0 AND val>0.15e0 THEN 1 END) AS vegetation,
  count(CASE WHEN (hue BETWEEN 170 AND 250 AND sat>=0.18e0 AND val<=0.95e0) OR (luma<0.12e0 AND sat<0.30e0) THEN 1 END) AS water FROM idx GROUP BY 1"""


@query("r02_class_masks", sql("pixels", body=IDX + " " + MASKS))
def r02(spark, d):
    m = R.class_masks(R.indices(D.pixels(spark, d)))
    return m.groupBy("imagery_id").agg(*[F.sum(f"m_{c}").alias(c) for c in ("road", "building", "field", "vegetation", "water")])


HSV8 = "floor(hue/2+0.5)", "floor(sat*255+0.5)", "floor(val*255+0.5)"
STD7 = """, rw AS (SELECT *, avg(luma) OVER r3 AS m1, avg(luma*luma) OVER r3 AS q1 FROM idx WINDOW r3 AS (PARTITION BY imagery_id, y ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  cw AS (SELECT *, avg(m1) OVER c3 AS m2, avg(q1) OVER c3 AS q2 FROM rw WINDOW c3 AS (PARTITION BY imagery_id, x ORDER BY y ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  sd AS (SELECT *, sqrt(greatest(0,q2-m2*m2)) AS std7 FROM cw)"""


@query("r02_model_masks", sql("pixels", body=IDX + STD7 + f""" SELECT imagery_id, count(CASE WHEN {HSV8[0]} BETWEEN 85 AND 135 AND {HSV8[1]}>=70 AND b>r*1.5e0+20 AND b>=g-10 AND r<28 THEN 1 END) AS water,
  count(CASE WHEN ({HSV8[1]}<55 AND {HSV8[2]} BETWEEN 80 AND 240 AND abs(2*g-r-b)<14) OR ({HSV8[0]} BETWEEN 16 AND 38 AND {HSV8[1]} BETWEEN 40 AND 160 AND {HSV8[2]} BETWEEN 70 AND 210 AND 2*g-r-b<8) THEN 1 END) AS road,
  count(CASE WHEN 2*g-r-b>22 AND r>=b-10 AND r>=25 AND std7>14 THEN 1 END) AS canopy, count(CASE WHEN {HSV8[0]} BETWEEN 10 AND 42 AND {HSV8[1]} BETWEEN 28 AND 210 AND {HSV8[2]}>=35 AND 2*g-r-b<=8 THEN 1 END) AS soil,
  count(CASE WHEN {HSV8[0]} BETWEEN 32 AND 88 AND {HSV8[1]}>=35 AND 2*g-r-b>12 THEN 1 END) AS green_crop, count(CASE WHEN {HSV8[0]} BETWEEN 18 AND 32 AND {HSV8[1]}>=35 AND {HSV8[2]}>=70 AND 2*g-r-b>-8 THEN 1 END) AS yellow_crop FROM sd GROUP BY 1"""))
def r02_model(spark, d):
    luma = R.indices(D.pixels(spark, d)).select("imagery_id", "x", "y", "r", "g", "b", "luma")
    m = R.model_masks(R.indices(R.local_deviation(luma, keep=["r", "g", "b"])))
    return m.groupBy("imagery_id").agg(*[F.sum(f"k_{c}").alias(c) for c in ("water", "road", "canopy", "soil", "green_crop", "yellow_crop")])


@query("r03_resample", sql("pixels", body=""", hs AS (SELECT imagery_id, max(y)+1 AS h FROM pixels GROUP BY 1), t AS (SELECT imagery_id, h, CAST(greatest(1,floor(h/64e0*40+0.5)) AS INT) AS th FROM hs),
  k AS (SELECT imagery_id, CAST(nx.range AS INT) AS x, CAST(ny.range AS INT) AS y, least(63,floor(nx.range*(64e0/40))) AS sx, least(h-1,floor(ny.range*(h/CAST(th AS DOUBLE)))) AS sy FROM t, range(0,40) nx, range(0,48) ny WHERE ny.range<th)
  SELECT k.imagery_id, k.x, k.y, p.r, p.g, p.b FROM k JOIN pixels p ON p.imagery_id=k.imagery_id AND p.x=k.sx AND p.y=k.sy"""))
def r03(spark, d):
    px = D.pixels(spark, d)
    p = px.join(sizes(spark, d, px), "imagery_id")
    return R.resample(p, F.col("width"), F.col("height"), 40).select("imagery_id", "x", "y", "r", "g", "b")


BLUR = """, b1 AS (SELECT *, avg(luma) OVER (PARTITION BY imagery_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h1 FROM idx),
  bl AS (SELECT *, avg(h1) OVER (PARTITION BY imagery_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS blur FROM b1)"""


def luma(spark, d):
    return R.indices(D.pixels(spark, d)).select("imagery_id", "x", "y", "luma")


def gradient(spark, d):
    return R.blurred_gradient(luma(spark, d))


@query("r04_box_blur", sql("pixels", body=IDX + BLUR + STD7 + " SELECT imagery_id, x, y, floor(blur*1000+0.5)/1000 AS blur, floor(std7*1000+0.5)/1000 AS std7 FROM bl JOIN sd USING (imagery_id, x, y)"))
def r04(spark, d):
    i = R.indices(D.pixels(spark, d)).select("imagery_id", "x", "y", "luma")
    t = R.blur_and_deviation(i)
    return t.select("imagery_id", "x", "y", G.js_round(F.col("blur"), 3).alias("blur"), G.js_round(F.col("std7"), 3).alias("std7"))


SOBEL = BLUR + """, rw AS (SELECT *, lead(blur) OVER w-lag(blur) OVER w AS dx, lag(blur) OVER w+2*blur+lead(blur) OVER w AS sx FROM bl WINDOW w AS (PARTITION BY imagery_id, y ORDER BY x)),
  gr AS (SELECT imagery_id, x, y, luma, coalesce(lag(dx) OVER w+2*dx+lead(dx) OVER w,0) AS gx, coalesce(lead(sx) OVER w-lag(sx) OVER w,0) AS gy FROM rw WINDOW w AS (PARTITION BY imagery_id, x ORDER BY y)),
  sob AS (SELECT *, sqrt(gx*gx+gy*gy) AS magnitude FROM gr)"""


@query("r05_sobel", sql("pixels", body=IDX + SOBEL + " SELECT imagery_id, x, y, floor(magnitude*1000+0.5)/1000 AS magnitude FROM sob"))
def r05(spark, d):
    i = R.indices(D.pixels(spark, d)).select("imagery_id", "x", "y", "luma")
    return R.blurred_gradient(i, keep=[]).select("imagery_id", "x", "y", G.js_round(F.col("magnitude"), 3).alias("magnitude"))


# ridge pixels by the four directions of the gradient, then a flood from the strong ones over the weak ones
CANNY = SOBEL + """, lim AS (SELECT imagery_id, greatest(30e0, avg(magnitude)*1.8e0) AS high FROM sob GROUP BY 1),
  ud AS (SELECT *, lag(magnitude) OVER w AS u, lead(magnitude) OVER w AS dn FROM sob WINDOW w AS (PARTITION BY imagery_id, x ORDER BY y)),
  nb AS (SELECT *, lag(magnitude) OVER w AS we, lead(magnitude) OVER w AS ea, lag(u) OVER w AS nw, lead(u) OVER w AS ne, lag(dn) OVER w AS sw, lead(dn) OVER w AS se FROM ud WINDOW w AS (PARTITION BY imagery_id, y ORDER BY x)),
  th AS (SELECT *, degrees(atan2(gy,gx)) AS dg FROM nb), tt AS (SELECT *, CASE WHEN dg<0 THEN dg+180 ELSE dg END AS t FROM th),
  ridge AS (SELECT imagery_id, x, y, magnitude, high FROM tt JOIN lim USING (imagery_id) WHERE magnitude>=high*0.45e0 AND u IS NOT NULL AND dn IS NOT NULL AND we IS NOT NULL AND ea IS NOT NULL AND
    CASE WHEN t<22.5e0 OR t>=157.5e0 THEN magnitude>=we AND magnitude>=ea WHEN t<67.5e0 THEN magnitude>=ne AND magnitude>=sw WHEN t<112.5e0 THEN magnitude>=u AND magnitude>=dn ELSE magnitude>=nw AND magnitude>=se END),
  edge AS (SELECT imagery_id, x, y FROM ridge WHERE magnitude>=high UNION SELECT r.imagery_id, r.x, r.y FROM edge e JOIN ridge r ON r.imagery_id=e.imagery_id AND abs(r.x-e.x)<=1 AND abs(r.y-e.y)<=1)"""


@query("r06_canny", sql("pixels", recursive=True, body=IDX + CANNY + " SELECT imagery_id, x, y FROM edge"))
def r06(spark, d):
    return R.canny(luma(spark, d), tile=32).select("imagery_id", "x", "y")


def morph_sql(name, src, col, agg, span, erode=False):
    full = 2 * span + 1

    def win(c, part, order):
        over = f"OVER (PARTITION BY imagery_id, {part} ORDER BY {order} ROWS BETWEEN {span} PRECEDING AND {span} FOLLOWING)"
        return f"CASE WHEN count(*) {over}={full} THEN min({c}) {over} ELSE 0 END" if erode else f"{agg}({c}) {over}"

    return f"""{name}_r AS (SELECT imagery_id, x, y, {win(col, 'y', 'x')} AS v FROM {src}), {name} AS (SELECT imagery_id, x, y, {win('v', 'x', 'y')} AS m FROM {name}_r)"""


@query("r07_morphology", sql("pixels", body=IDX + """, mk AS (SELECT imagery_id, x, y, CASE WHEN (hue BETWEEN 170 AND 250 AND sat>=0.18e0 AND val<=0.95e0) OR (luma<0.12e0 AND sat<0.30e0) THEN 1 ELSE 0 END AS m FROM idx), """
    + morph_sql("di", "mk", "m", "max", 2) + ", " + morph_sql("cl", "di", "m", "min", 2, True) + ", " + morph_sql("er", "mk", "m", "min", 1, True) + ", " + morph_sql("op", "er", "m", "max", 1) + """
  SELECT 'close' AS op, imagery_id, x, y FROM cl WHERE m=1 UNION ALL SELECT 'open', imagery_id, x, y FROM op WHERE m=1"""))
def r07(spark, d):
    m = R.class_masks(R.indices(D.pixels(spark, d))).select("imagery_id", "x", "y", F.col("m_water").alias("m"))
    both = R.morphs(m, "m", {"close": ("close", 2), "open": ("open", 1)}, keep=[])
    ops = F.array_compact(F.array(*[F.when(F.col(op) == 1, F.lit(op)) for op in ("close", "open")]))
    return both.select(F.explode(ops).alias("op"), "imagery_id", "x", "y")


# every image once per class mask, as images of their own: five times the id plus the place of the class
LAYERS = ("road", "building", "field", "vegetation", "water")
LAYER_PIXELS = """, layers AS (SELECT imagery_id*5+k.i AS imagery_id, x, y FROM idx, (VALUES (0),(1),(2),(3),(4)) k(i) WHERE CASE k.i
    WHEN 0 THEN NOT (sat>=0.20e0 AND hue BETWEEN 45 AND 155 AND exg>0.05e0) AND ((sat<=0.38e0 AND val BETWEEN 0.20e0 AND 0.98e0) OR (hue BETWEEN 14 AND 45 AND sat<=0.45e0 AND val BETWEEN 0.25e0 AND 0.85e0))
    WHEN 1 THEN NOT (sat>=0.20e0 AND hue BETWEEN 45 AND 155 AND exg>0.05e0) AND (((hue<=40 OR hue>=335) AND sat>=0.20e0 AND val>=0.22e0) OR (val>=0.60e0 AND sat<=0.35e0) OR (val BETWEEN 0.46e0 AND 0.95e0 AND sat<=0.25e0) OR (hue BETWEEN 175 AND 245 AND sat>=0.18e0 AND val>=0.18e0))
    WHEN 2 THEN exg>0.05e0 OR (hue BETWEEN 45 AND 160 AND sat>=0.18e0 AND val>=0.18e0) OR (hue BETWEEN 18 AND 42 AND sat>=0.28e0 AND val>=0.22e0)
    WHEN 3 THEN exg>0.20e0 AND hue BETWEEN 45 AND 155 AND sat>0.35e0 AND val>0.15e0
    ELSE (hue BETWEEN 170 AND 250 AND sat>=0.18e0 AND val<=0.95e0) OR (luma<0.12e0 AND sat<0.30e0) END)"""


def layer_labels(spark, d):
    m = R.class_masks(R.indices(D.pixels(spark, d)))
    on = F.array_compact(F.array(*[F.when(F.col(f"m_{c}") == 1, i) for i, c in enumerate(LAYERS)]))
    layers = m.select("imagery_id", "x", "y", F.explode(on).alias("i"))
    return R.label_components(layers.select((F.col("imagery_id") * 5 + F.col("i")).alias("imagery_id"), "x", "y"), tile=32)


# a flood from every run start without a pixel above it; a pixel's component is its smallest source
@query("r08_connected_components", sql("pixels", recursive=True, body=IDX + LAYER_PIXELS + """, near AS (SELECT *, y*64+x AS id, lag(x) OVER (PARTITION BY imagery_id, y ORDER BY x) AS lx, lag(y) OVER (PARTITION BY imagery_id, x ORDER BY y) AS uy FROM layers),
  runs AS (SELECT imagery_id, y, x-row_number() OVER (PARTITION BY imagery_id, y ORDER BY x) AS g, x, uy FROM near),
  r AS (SELECT imagery_id, y, min(x) AS xa, max(x) AS xb, min(y*64+x) AS id, max(CASE WHEN uy=y-1 THEN 1 ELSE 0 END) AS above FROM runs GROUP BY imagery_id, y, g),
  fl AS (SELECT imagery_id, y, xa, xb, id, id AS source FROM r WHERE above=0 UNION SELECT r.imagery_id, r.y, r.xa, r.xb, r.id, fl.source FROM fl JOIN r ON r.imagery_id=fl.imagery_id AND abs(r.y-fl.y)=1 AND r.xa<=fl.xb AND fl.xa<=r.xb),
  lb AS (SELECT imagery_id, y, xa, xb, min(source) AS label FROM fl GROUP BY 1,2,3,4)
  SELECT imagery_id, CAST(sum(xb-xa+1) AS BIGINT) AS n, min(xa) AS xmin, max(xb) AS xmax, min(y) AS ymin, max(y) AS ymax FROM lb GROUP BY imagery_id, label HAVING sum(xb-xa+1)>=20"""))
def r08(spark, d):
    s = R.component_stats(layer_labels(spark, d), 20)
    return s.select("imagery_id", "n", "xmin", "xmax", "ymin", "ymax")


# given labels: the palette patch a pixel belongs to, by class; every eleventh pixel and the lower part of road patches form a second component
LABELS = """, lb0 AS (SELECT *, ['road','building','field','vegetation','water'][1+(x//8+y//8+imagery_id)%5] AS patch FROM idx), lb1 AS (SELECT *, (x+y+imagery_id)%11=0 OR (patch='road' AND y%8>1) AS apart FROM lb0),
  lab AS (SELECT imagery_id, x, y, luma, r, imagery_id*100+(x//8)*10+(y//8)+CASE WHEN apart THEN 1000000 ELSE 0 END AS label, CASE WHEN apart THEN 'vegetation' ELSE patch END AS feature_class FROM lb1),
  st AS (SELECT imagery_id, label, feature_class, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM lab GROUP BY 1,2,3),
  sg AS (SELECT *, xmax-xmin AS w, ymax-ymin AS h, n/3072e0 AS fr, greatest(xmax-xmin,ymax-ymin)/CAST(greatest(1,least(xmax-xmin,ymax-ymin)) AS DOUBLE) AS asp, (xmax-xmin)/CAST(greatest(1,ymax-ymin) AS DOUBLE) AS ra, n/CAST(greatest(1,(xmax-xmin)*(ymax-ymin)) AS DOUBLE) AS co FROM st)"""


def given_stats(spark, d):
    i = R.indices(D.pixels(spark, d))
    classes = F.array(*[F.lit(c) for c in ("road", "building", "field", "vegetation", "water")])
    px, py = F.expr("x DIV 8"), F.expr("y DIV 8")
    lab = i.withColumn("patch", F.get(classes, ((px + py + F.col("imagery_id")) % 5).cast("int"))).withColumn("apart", F.expr("(x + y + imagery_id) % 11 = 0 OR (patch = 'road' AND y % 8 > 1)"))
    lab = lab.withColumn("label", F.col("imagery_id") * 100 + px * 10 + py + F.when(F.col("apart"), 1000000).otherwise(0)).withColumn("feature_class", F.when(F.col("apart"), "vegetation").otherwise(F.col("patch")))
    return lab.groupBy("imagery_id", "label", "feature_class").agg(
        F.count("*").alias("n"), F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.stddev_pop("luma").alias("deviation"), F.avg("r").alias("mean_red")
    )


def clamp_sql(value, low, high):
    return f"floor(least({high},greatest({low},{value}))*100+0.5)/100"


@query("r09_component_features", sql("pixels", body=IDX + LABELS + f""", k AS (SELECT *, CASE feature_class WHEN 'road' THEN greatest(w,h)>=25 AND (asp>=1.7e0 OR (asp>=1.4e0 AND greatest(w,h)>=40)) AND fr<0.15e0 WHEN 'building' THEN fr BETWEEN 0.0003e0 AND 0.45e0 AND ra BETWEEN 0.25e0 AND 3.8e0 AND w>=5 AND h>=5 AND co>=0.25e0
    WHEN 'field' THEN fr BETWEEN 0.012e0 AND 0.98e0 WHEN 'vegetation' THEN fr BETWEEN 0.0015e0 AND 0.25e0 ELSE fr BETWEEN 0.0010e0 AND 0.30e0 END AS accepted FROM sg)
  SELECT imagery_id, label, feature_class, accepted, CASE WHEN accepted THEN CASE feature_class WHEN 'road' THEN {clamp_sql('0.76e0+CASE WHEN asp>3 THEN 0.14e0 ELSE 0.06e0 END', '0.72e0', '0.96e0')} WHEN 'building' THEN {clamp_sql('0.70e0+0.5e0*0.15e0+co*0.12e0', '0.68e0', '0.98e0')}
   WHEN 'field' THEN {clamp_sql('0.72e0+least(0.20e0,fr*4)', '0.70e0', '0.95e0')} WHEN 'vegetation' THEN {clamp_sql('0.70e0+least(0.20e0,fr*10)', '0.65e0', '0.92e0')} ELSE {clamp_sql('0.72e0+CASE WHEN asp>=2.5e0 THEN 0.14e0 ELSE 0.06e0 END', '0.66e0', '0.95e0')} END END AS confidence FROM k"""))
def r09(spark, d):
    f = R.component_features(given_stats(spark, d), F.lit(TOTAL))
    return f.select("imagery_id", "label", "feature_class", "accepted", "confidence")


# bends from the four pixels round each corner: one or three on make one bend, two across make two
@query("r10_trace_contours", sql("pixels", body=IDX + LAYER_PIXELS + """, c AS (SELECT imagery_id, x+k.dx AS cx, y+k.dy AS cy, sum(k.bit) AS p FROM layers, (VALUES (0,0,1),(1,0,2),(0,1,4),(1,1,8)) k(dx,dy,bit) GROUP BY 1,2,3),
  b AS (SELECT *, CASE WHEN p IN (1,2,4,8,7,11,13,14) THEN 1 WHEN p IN (6,9) THEN 2 ELSE 0 END AS bends, CASE WHEN p IN (1,2,4,8) THEN 1 WHEN p IN (7,11,13,14) THEN -1 WHEN p IN (6,9) THEN 2 ELSE 0 END AS turn,
    CASE WHEN p IN (0,15) THEN 0 WHEN p IN (6,9) THEN 4 ELSE 2 END AS sides FROM c),
  n AS (SELECT imagery_id, count(*) AS area FROM layers GROUP BY 1)
  SELECT imagery_id, CAST(sum(turn)/4 AS BIGINT) AS outer_less_holes, CAST(sum(bends) AS BIGINT) AS bends, CAST(sum(bends*cx) AS DOUBLE) AS sum_x, CAST(sum(bends*cy) AS DOUBLE) AS sum_y, CAST(sum(bends*cx*cy) AS DOUBLE) AS sum_xy, CAST(sum(sides)/2 AS DOUBLE) AS length, CAST(any_value(area) AS DOUBLE) AS area
  FROM b JOIN n USING (imagery_id) GROUP BY 1"""))
def r10(spark, d):
    c = R.trace_contours(cut_lineage(layer_labels(spark, d)))
    bends, sign = F.slice("pts", F.lit(1), F.size("pts") - 1), F.when(F.col("ring") == 0, 1).otherwise(-1)
    c = c.withColumn("bends", bends).withColumn("sign", sign)

    def total(value):
        return F.sum(F.aggregate("bends", F.lit(0.0), lambda acc, p: acc + value(p)))

    return c.groupBy("imagery_id").agg(
        F.sum("sign").cast("long").alias("outer_less_holes"), F.sum(F.size("bends")).alias("bends"), total(lambda p: p["x"]).alias("sum_x"), total(lambda p: p["y"]).alias("sum_y"),
        total(lambda p: p["x"] * p["y"]).alias("sum_xy"), F.sum(G.planar_length(F.col("pts"))).alias("length"), F.sum(F.col("sign") * G.planar_area(F.col("pts"))).alias("area"),
    )


@query("r11_component_spine", sql("pixels", body=IDX + """, lb AS (SELECT imagery_id, x, y, imagery_id*4+CASE WHEN y<imagery_id%30+9 THEN 0 ELSE 1 END+CASE WHEN (x*3+y*(1+imagery_id%4))%29<14 THEN 0 ELSE 2 END AS label FROM idx),
  m AS (SELECT label, avg(x) AS mx, avg(y) AS my, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x,y) AS cxy, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM lb GROUP BY 1),
  th AS (SELECT *, 0.5e0*atan2(2*floor(cxy*1e9+0.5)/1e9, floor((cxx-cyy)*1e9+0.5)/1e9) AS theta FROM m),
  p AS (SELECT lb.imagery_id, label, x, y, floor(((x-mx)*cos(theta)+(y-my)*sin(theta))*1000000+0.5)/1000000 AS t FROM lb JOIN th USING (label)),
  s AS (SELECT label, min(t) AS t0, floor((max(t)-min(t))*1000000+0.5)/1000000 AS rg FROM p GROUP BY 1), q AS (SELECT p.*, t0, rg, least(24,greatest(8,floor(rg/14+0.5))) AS ns FROM p JOIN s USING (label) WHERE rg>=10),
  b AS (SELECT label, CAST(least(ns-1,greatest(0,floor(floor((t-t0)/rg*ns*1000000+0.5)/1000000))) AS INT) AS slice, x, y FROM q)
  SELECT label, slice, CAST(floor(avg(x)+0.5) AS BIGINT) AS x, CAST(floor(avg(y)+0.5) AS BIGINT) AS y FROM b GROUP BY 1,2
  UNION ALL SELECT label, 0, xa, ya FROM m JOIN s USING (label) WHERE rg<10 UNION ALL SELECT label, 1, xb, yb FROM m JOIN s USING (label) WHERE rg<10"""))
def r11(spark, d):
    px = D.pixels(spark, d)
    striped = F.expr("(x * 3 + y * (1 + imagery_id % 4)) % 29 < 14")
    label = F.col("imagery_id") * 4 + F.when(F.col("y") < F.col("imagery_id") % 30 + 9, 0).otherwise(1) + F.when(striped, 0).otherwise(2)
    return R.component_spine(px.select("imagery_id", "x", "y", label.alias("label"))).select("label", "slice", "x", "y")


# an open line has one pixel more than links; its ends are the pixels with fewer than two links to others of its kind
@query("r12_trace_edge_lines", sql("pixels", recursive=True, body=IDX + CANNY + """, nx AS (SELECT a.imagery_id, a.x, a.y, b.x AS bx, b.y AS by FROM edge a JOIN edge b ON a.imagery_id=b.imagery_id AND abs(a.x-b.x)<=1 AND abs(a.y-b.y)<=1 AND (a.x<>b.x OR a.y<>b.y)),
  lk AS (SELECT n.* FROM nx n LEFT JOIN edge p ON p.imagery_id=n.imagery_id AND p.x=n.bx AND p.y=n.y AND n.x<>n.bx AND n.y<>n.by LEFT JOIN edge q ON q.imagery_id=n.imagery_id AND q.x=n.x AND q.y=n.by AND n.x<>n.bx AND n.y<>n.by WHERE p.x IS NULL AND q.x IS NULL),
  dg AS (SELECT imagery_id, x, y, count(*) AS n FROM lk GROUP BY 1,2,3), ph AS (SELECT e.imagery_id, e.x, e.y FROM edge e LEFT JOIN dg USING (imagery_id, x, y) WHERE coalesce(n,0)<=2),
  pd AS (SELECT lk.imagery_id, lk.x, lk.y, count(*) AS n FROM lk JOIN ph a ON a.imagery_id=lk.imagery_id AND a.x=lk.x AND a.y=lk.y JOIN ph b ON b.imagery_id=lk.imagery_id AND b.x=lk.bx AND b.y=lk.by GROUP BY 1,2,3)
  SELECT imagery_id, CAST(sum(2-coalesce(n,0))/2 AS BIGINT) AS open_lines, count(*) AS pixels, CAST(sum((2-coalesce(n,0))*x) AS DOUBLE) AS ends_x, CAST(sum((2-coalesce(n,0))*y) AS DOUBLE) AS ends_y FROM ph LEFT JOIN pd USING (imagery_id, x, y) GROUP BY 1"""))
def r12(spark, d):
    lines = R.trace_edge_lines(cut_lineage(R.canny(luma(spark, d), tile=32)), least=1)
    first, last, is_open = F.element_at("pts", 1), F.element_at("pts", -1), ~F.col("closed")

    def ends(axis):
        return F.sum(F.when(is_open, first[axis] + last[axis]).otherwise(0.0)).alias(f"ends_{axis}")

    return lines.groupBy("imagery_id").agg(F.count_if(is_open).alias("open_lines"), F.sum("path_length").alias("pixels"), ends("x"), ends("y"))


@query("r13_zonal_gradient", sql("pixels", body=IDX + SOBEL + """, ln AS (SELECT DISTINCT l_orderkey//48 AS imagery_id, l_orderkey*10+l_linenumber AS line_id, CAST((l_partkey+k.i*7)%64 AS INT) AS x, CAST((l_suppkey+k.i*5)%48 AS INT) AS y FROM lineitem, (VALUES (0),(1),(2)) k(i) WHERE l_linenumber IN (4,5)),
  z AS (SELECT ln.imagery_id, line_id, avg(magnitude) AS gradient FROM ln JOIN sob USING (imagery_id, x, y) GROUP BY 1,2)
  SELECT line_id, floor(gradient*1000+0.5)/1000 AS gradient, CASE WHEN gradient>=105 THEN 'wall' WHEN gradient>=60 THEN 'fence' END AS line_class, CASE WHEN gradient>=105 THEN floor(least(0.94e0,greatest(0.68e0,0.70e0+least(0.22e0,gradient/200)))*100+0.5)/100
   WHEN gradient>=60 THEN floor(least(0.82e0,greatest(0.55e0,0.58e0+least(0.20e0,gradient/220)))*100+0.5)/100 END AS score FROM z"""))
def r13(spark, d):
    li = D.table(spark, d, "lineitem").where("l_linenumber IN (4, 5)").withColumn("i", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    v = li.selectExpr("l_orderkey DIV 48 AS imagery_id", "l_orderkey*10+l_linenumber AS line_id", "CAST((l_partkey+i*7)%64 AS INT) AS x", "CAST((l_suppkey+i*5)%48 AS INT) AS y").distinct()
    z = R.zonal_gradient(v, gradient(spark, d))
    return z.select("line_id", G.js_round(F.col("gradient"), 3).alias("gradient"), "line_class", "score")


@query("r14_border_and_divider_mask", sql("pixels", body="""
  , px AS (SELECT imagery_id, x, y, CASE WHEN x=30+imagery_id%5 OR y=20 THEN 255e0 ELSE 0.299e0*r+0.587e0*g+0.114e0*b END AS luma FROM pixels), hs AS (SELECT imagery_id, max(y)+1 AS h FROM px GROUP BY 1),
  cx AS (SELECT imagery_id, x FROM px GROUP BY 1,2 HAVING avg(CASE WHEN luma>248 THEN 1 ELSE 0 END)>0.85 OR avg(CASE WHEN luma<8 THEN 1 ELSE 0 END)>0.85), cy AS (SELECT imagery_id, y FROM px GROUP BY 1,2 HAVING avg(CASE WHEN luma>248 THEN 1 ELSE 0 END)>0.85 OR avg(CASE WHEN luma<8 THEN 1 ELSE 0 END)>0.85)
  SELECT imagery_id, x, y FROM px JOIN hs USING (imagery_id) WHERE x<16 OR y<16 OR x>=48 OR y>=h-16 OR EXISTS (SELECT 1 FROM cx WHERE cx.imagery_id=px.imagery_id AND abs(cx.x-px.x)<=6) OR EXISTS (SELECT 1 FROM cy WHERE cy.imagery_id=px.imagery_id AND abs(cy.y-px.y)<=6)"""))
def r14(spark, d):
    px = D.pixels(spark, d)
    p = R.indices(px).withColumn("luma", F.when((F.col("x") == 30 + F.col("imagery_id") % 5) | (F.col("y") == 20), 255.0).otherwise(F.col("luma"))).select("imagery_id", "x", "y", "luma")
    return R.margin_mask(p, width=W).select("imagery_id", "x", "y")


@query("r15_region_rules", sql("features", body=""", g AS (SELECT feature_id, CASE detection_type WHEN 'WATER' THEN 'water' WHEN 'VEGETATION' THEN 'vegetation' ELSE 'field' END AS c, fw*fh*30e0 AS a, 400000e0 AS t, 0.3e0+fw%70/100e0 AS sol, greatest(fw,fh)*5e0 AS rl, least(fw,fh)*1e0 AS rs, fw%40*1e0 AS dv, fh%30*1e0 AS mr FROM features WHERE detection_type IN ('WATER','VEGETATION','FIELD')),
  o AS (SELECT *, CASE WHEN c='water' AND NOT ((a>=greatest(600,t*0.005e0) OR (rl/greatest(1,rs)>=4.5e0 AND a>=300)) AND dv<26 AND mr<22) THEN 'dropped: texture' WHEN c='water' AND a<greatest(500,t*0.005e0) THEN 'dropped: small' WHEN c='water' AND rl/greatest(1,rs)>=4.5e0 AND rs<=28 AND a<t*0.08e0 THEN 'canal'
    WHEN c='water' AND a>t*0.12e0 THEN 'ocean' WHEN c='water' THEN 'water body' WHEN c='vegetation' AND a>t*0.15e0 THEN 'Excessive size' WHEN c='vegetation' AND a<200 THEN 'dropped: small' WHEN c='vegetation' AND sol<0.42e0 THEN 'Invalid geometry' WHEN c='vegetation' THEN 'canopy'
    WHEN a>t*0.40e0 THEN 'Excessive size' WHEN a<greatest(7000,t*0.008e0) THEN 'dropped: small' WHEN sol<0.65e0 THEN 'Invalid geometry' ELSE 'field' END AS outcome FROM g)
  SELECT feature_id, outcome, CASE outcome WHEN 'canal' THEN floor(least(0.88e0,greatest(0.68e0,0.72e0+a/t*0.20e0))*10000+0.5)/10000 WHEN 'ocean' THEN floor(least(0.95e0,greatest(0.75e0,0.80e0+a/t*0.15e0))*10000+0.5)/10000 WHEN 'water body' THEN floor(least(0.95e0,greatest(0.75e0,0.80e0+a/t*0.15e0))*10000+0.5)/10000
   WHEN 'canopy' THEN floor(least(0.88e0,greatest(0.68e0,0.70e0+a/t*0.25e0))*10000+0.5)/10000 WHEN 'field' THEN floor(least(0.92e0,greatest(0.68e0,0.72e0+a/t*0.25e0))*10000+0.5)/10000 END AS score FROM o"""))
def r15(spark, d):
    f = D.features(spark, d).where("detection_type IN ('WATER', 'VEGETATION', 'FIELD')").selectExpr(
        "feature_id", "lower(detection_type) AS feature_class", "fw*fh*30e0 AS area", "400000e0 AS total", "0.3e0+fw%70/100e0 AS solidity",
        "greatest(fw,fh)*5e0 AS rect_long", "least(fw,fh)*1e0 AS rect_short", "fw%40*1e0 AS deviation", "fh%30*1e0 AS mean_red",
    )
    return R.region_rules(f).select("feature_id", "outcome", "score")


@query("r16_region_rules_v1", sql("pixels", body=IDX + LABELS + f""", mk AS (SELECT imagery_id, count(CASE WHEN sat<0.50e0 AND val>0.16e0 AND val<0.92e0 THEN 1 END) AS road_pixels, count(CASE WHEN (val>0.45e0 AND sat<0.45e0) OR ((hue<=45 OR hue>=340) AND sat>0.22e0 AND val>0.28e0) OR (hue BETWEEN 190 AND 245 AND val>0.15e0 AND val<0.60e0) THEN 1 END) AS building_pixels,
    count(CASE WHEN exg>0.04e0 OR (hue BETWEEN 28 AND 175 AND sat>=0.10e0 AND val>=0.15e0) OR (hue BETWEEN 12 AND 45 AND sat>=0.18e0 AND val>=0.20e0) THEN 1 END) AS field_pixels FROM idx GROUP BY 1),
  k AS (SELECT *, CASE feature_class WHEN 'road' THEN sqrt(w*w+h*h)>48*0.15e0 AND n>80 WHEN 'building' THEN fr BETWEEN 0.0008e0 AND 0.06e0 AND ra BETWEEN 0.25e0 AND 3.8e0 AND w>=8 AND h>=8 WHEN 'field' THEN fr BETWEEN 0.010e0 AND 0.98e0 ELSE false END AS accepted FROM sg)
  SELECT k.imagery_id, label, feature_class, accepted, CASE WHEN accepted THEN CASE feature_class WHEN 'road' THEN {clamp_sql('0.70e0+0.5e0*0.15e0+0.12e0', '0.72e0', '0.96e0')} WHEN 'building' THEN {clamp_sql('0.70e0+0.5e0*0.18e0+co*0.10e0', '0.68e0', '0.97e0')} ELSE {clamp_sql('0.76e0+least(0.18e0,fr*4)', '0.74e0', '0.95e0')} END END AS confidence,
   road_pixels, building_pixels, field_pixels FROM k JOIN mk USING (imagery_id)"""))
def r16(spark, d):
    m = R.class_masks(R.indices(D.pixels(spark, d))).groupBy("imagery_id").agg(*[F.sum(f"m_v1_{c}").alias(f"{c}_pixels") for c in ("road", "building", "field")])
    s = given_stats(spark, d).withColumn("min_side", F.lit(48))
    f = R.component_features(s, F.lit(TOTAL), ruleset="v1")
    return f.join(m, "imagery_id").select("imagery_id", "label", "feature_class", "accepted", "confidence", "road_pixels", "building_pixels", "field_pixels")
