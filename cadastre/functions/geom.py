"""Geometry measures as Column expressions over ``array<struct<x:double,y:double>>``.

Everything stays in the JVM: no Python runs per row and nothing is shuffled, because a ring is one
column value. ``ring`` arguments may be any Column of that type.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EARTH_RADIUS_M = 6371008.8
SQM_PER_ACRE = 4046.8564224
SQM_PER_HECTARE = 10000.0


def point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in points])


def js_round(value: Column, digits: int = 0) -> Column:
    """Half up toward +infinity on the binary value."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale if digits else F.floor(value + 0.5)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; lambdas would otherwise repeat it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed a single time per row.

    Filters on a plain computed column are pushed below it together with a copy of its expression;
    a generated one-row struct is not copied, so costly geometry is not evaluated again.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def edges(r: Column) -> Column:
    """Consecutive vertex pairs as structs (x1, y1, x2, y2)."""
    n = F.greatest(F.size(r) - 1, F.lit(0))
    return F.zip_with(
        F.slice(r, 1, n),
        F.slice(r, 2, n),
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )


def indexed_edges(r: Column) -> Column:
    """Edges with their position, for operators that explode them into rows."""
    return F.transform(
        edges(r),
        lambda e, i: F.struct(i.alias("seq"), e["x1"].alias("x1"), e["y1"].alias("y1"), e["x2"].alias("x2"), e["y2"].alias("y2")),
    )


def _sum(items: Column, term) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def signed_area(r: Column) -> Column:
    return _sum(edges(r), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2.0


def planar_area(r: Column) -> Column:
    return F.when(F.size(r) < 3, F.lit(0.0)).otherwise(F.abs(signed_area(r)))


def planar_length(r: Column) -> Column:
    return _sum(edges(r), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def compactness(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter > 0, area * (4 * math.pi) / (perimeter * perimeter)).otherwise(F.lit(0.0))


def equal_area_ring(geo_ring: Column) -> Column:
    """Lng/lat degrees to cylindrical equal-area metres: planar area there is spherical area."""
    return F.transform(
        geo_ring,
        lambda p: point(F.radians(p["x"]) * EARTH_RADIUS_M, F.sin(F.radians(p["y"])) * EARTH_RADIUS_M),
    )


def trapezoid_area(r: Column) -> Column:
    """Area of a closed ring far from the origin: width times mean height keeps the digits."""
    return F.abs(_sum(edges(close_ring(r)), lambda e: (e["x2"] - e["x1"]) * (e["y1"] + e["y2"]))) / 2.0


def geodesic_area(geo_ring: Column) -> Column:
    return trapezoid_area(equal_area_ring(geo_ring))


def haversine(lng1, lat1, lng2, lat2) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2.0)
    a = half_lat * half_lat + half_lng * half_lng * F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
    return F.atan2(F.sqrt(a), F.sqrt(1.0 - a)) * (2.0 * EARTH_RADIUS_M)


def geodesic_length(geo_ring: Column) -> Column:
    return _sum(edges(geo_ring), lambda e: haversine(e["x1"], e["y1"], e["x2"], e["y2"]))


def image_to_geo(r: Column, width, height, lat, lng, half_extent: float = 0.0035, digits: int = 6) -> Column:
    """Axis-aligned affine map of a centred image onto degrees."""
    return F.transform(
        r,
        lambda p: point(
            js_round(lng + (p["x"] / width - 0.5) * (2 * half_extent), digits),
            js_round(lat - (p["y"] / height - 0.5) * (2 * half_extent), digits),
        ),
    )


def xs(r: Column) -> Column:
    return F.transform(r, lambda p: p["x"])


def ys(r: Column) -> Column:
    return F.transform(r, lambda p: p["y"])


def bbox(r: Column) -> Column:
    return F.struct(
        F.array_min(xs(r)).alias("xmin"),
        F.array_min(ys(r)).alias("ymin"),
        F.array_max(xs(r)).alias("xmax"),
        F.array_max(ys(r)).alias("ymax"),
    )


def open_ring(r: Column) -> Column:
    """Ring without its closing vertex."""
    first, last = F.element_at(r, 1), F.element_at(r, -1)
    closed = (F.size(r) > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    return F.when(closed, F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))).otherwise(r)


def mean_point(points: Column) -> Column:
    n = F.greatest(F.size(points), F.lit(1)).cast("double")
    return point(
        F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["x"]) / n,
        F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p["y"]) / n,
    )


def vertex_centroid(r: Column) -> Column:
    return mean_point(open_ring(r))


def drop_repeats(points: Column, eps: float, per_axis: bool = True) -> Column:
    """Fold that keeps a vertex only when it moves away from the last kept one."""
    empty = F.slice(points, 1, 0)

    def step(acc, p):
        last = F.element_at(acc, -1)
        dx, dy = F.abs(p["x"] - last["x"]), F.abs(p["y"] - last["y"])
        moved = (dx > eps) | (dy > eps) if per_axis else F.hypot(dx, dy) > eps
        return F.when((F.size(acc) == 0) | moved, F.concat(acc, F.array(p))).otherwise(acc)

    return F.aggregate(points, empty, step)


# fixed values: shortest edge of a contour; widest mouth, shortest flank and widest angle of a notch
SHORT_EDGE, NOTCH_BASE, NOTCH_EDGE, NOTCH_ANGLE = 4.0, 45.0, 25.0, 70.0


def _spike(before: Column, corner: Column, after: Column, min_angle: float) -> Column:
    """Whether a corner is at a short edge, is sharper than ``min_angle``, or is the bottom of a notch.

    The three points, the products of the legs and the leg lengths are each evaluated once.
    """

    def products(p):
        ux, uy, vx, vy = p["ox"] - p["x"], p["oy"] - p["y"], p["qx"] - p["x"], p["qy"] - p["y"]
        return F.struct((ux * ux + uy * uy).alias("u2"), (vx * vx + vy * vy).alias("v2"), (ux * vx + uy * vy).alias("dot"))

    def limits(p):
        return F.struct(
            p["dot"].alias("dot"), F.sqrt(p["u2"] * p["v2"]).alias("legs"), F.least(p["u2"], p["v2"]).alias("flank"), (p["u2"] + p["v2"] - 2 * p["dot"]).alias("mouth")
        )

    def judged(m):
        def sharper(degrees: float) -> Column:
            return m["dot"] > math.cos(math.radians(degrees)) * m["legs"]

        return (m["flank"] < SHORT_EDGE**2) | sharper(min_angle) | ((m["mouth"] < NOTCH_BASE**2) & (m["flank"] > NOTCH_EDGE**2) & sharper(NOTCH_ANGLE))

    points = let(before, lambda o: let(corner, lambda p: let(after, lambda q: F.struct(
        o["x"].alias("ox"), o["y"].alias("oy"), p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("qx"), q["y"].alias("qy")
    ))))
    return let(let(let(points, products), limits), judged)


def despiked(ring: Column, min_angle: float) -> Column:
    """The ring without spikes: all corners that are one go, and the rest is judged again until none is left.

    Every round takes a corner away, so there are no more rounds than corners; there is no other limit, and
    a ring with spikes on spikes comes out clean. A triangle is not judged further; a ring that loses that
    too comes back as the open points that remain, and one of fewer than five points as it is.
    """

    def next_round(state: Column, _: Column) -> Column:
        pts = state["pts"]
        n = F.size(pts)

        def kept(p: Column, i: Column) -> Column:
            return ~_spike(F.element_at(pts, F.pmod(i - 1, n) + 1), p, F.element_at(pts, F.pmod(i + 1, n) + 1), min_angle)

        rest = let(F.filter(pts, kept), lambda left: F.struct(left.alias("pts"), (F.size(left) == n).alias("done")))
        return F.when(state["done"] | (n < 4), state).otherwise(rest)

    corners = open_ring(ring)
    start = F.struct(corners.alias("pts"), (F.size(corners) < 0).alias("done"))
    clean = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(corners))), start, next_round, lambda s: s["pts"])
    closed = let(clean, lambda pts: F.when(F.size(pts) >= 3, F.concat(pts, F.slice(pts, 1, 1))).otherwise(pts))
    return F.when(F.size(ring) < 5, ring).otherwise(closed)


def close_ring(points: Column, eps: float = 0.0) -> Column:
    def close(r):
        first, last = F.element_at(r, 1), F.element_at(r, -1)
        apart = (F.abs(first["x"] - last["x"]) > eps) | (F.abs(first["y"] - last["y"]) > eps)
        return F.when((F.size(r) > 0) & apart, F.concat(r, F.array(first))).otherwise(r)

    return let(points, close)


def is_closed(points: Column, eps: float) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return (F.abs(first["x"] - last["x"]) < eps) & (F.abs(first["y"] - last["y"]) < eps)


def _turns_left(ax, ay, bx, by, cx, cy) -> Column:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def segments_cross(a: Column, b: Column) -> Column:
    """Strict orientation test between two edge structs."""
    p1, p2, p3, p4 = (a["x1"], a["y1"]), (a["x2"], a["y2"]), (b["x1"], b["y1"]), (b["x2"], b["y2"])
    return (_turns_left(*p1, *p3, *p4) != _turns_left(*p2, *p3, *p4)) & (
        _turns_left(*p1, *p2, *p3) != _turns_left(*p1, *p2, *p4)
    )


def self_intersections(r: Column) -> Column:
    """Crossing pairs of non-adjacent edges of one closed ring."""

    def count(e):
        last = F.size(e) - 1

        def partners(a):
            later = F.slice(e, a["seq"] + 3, F.greatest(F.size(e), F.lit(1)))
            return F.size(F.filter(later, lambda b: ~((a["seq"] == 0) & (b["seq"] == last)) & segments_cross(a, b)))

        return F.aggregate(F.transform(e, partners), F.lit(0), lambda acc, n: acc + n)

    return let(indexed_edges(r), count)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / F.when(l2 != 0, l2)))
    )
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def contains_point(r: Column, px, py) -> Column:
    """Even-odd ray cast over the closed ring's edges."""

    def crosses(e):
        return ((e["y1"] > py) != (e["y2"] > py)) & (
            px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]
        )

    return F.size(F.filter(edges(r), crosses)) % 2 == 1


def _strips(r: Column) -> Column:
    """Non-vertical edges as the line over [lo, hi] with the sign of their direction."""

    def strip(e):
        dx = e["x2"] - e["x1"]
        return F.struct(
            F.least(e["x1"], e["x2"]).alias("lo"), F.greatest(e["x1"], e["x2"]).alias("hi"), F.when(dx > 0, e["y1"]).otherwise(e["y2"]).alias("y"),
            ((e["y2"] - e["y1"]) / F.when(dx != 0, dx)).alias("slope"), F.signum(dx).alias("sign"),
        )

    return F.transform(F.filter(edges(r), lambda e: e["x1"] != e["x2"]), strip)


def _under_both(a: Column, b: Column) -> Column:
    """Signed area below both strips over their common x-range."""
    lo, hi = F.greatest(a["lo"], b["lo"]), F.least(a["hi"], b["hi"])

    def area(h):
        dl, dr = h["al"] - h["bl"], h["ar"] - h["br"]
        split = dl / (dl - dr)
        mid = h["al"] + (h["ar"] - h["al"]) * split
        crossed = F.when(dl < 0, (h["al"] + mid) * split + (mid + h["br"]) * (1.0 - split)).otherwise(
            (h["bl"] + mid) * split + (mid + h["ar"]) * (1.0 - split)
        )
        return h["width"] * F.when(dl * dr < 0, crossed).otherwise(F.least(h["al"], h["bl"]) + F.least(h["ar"], h["br"]))

    heights = F.struct(
        (hi - lo).alias("width"), (a["y"] + (lo - a["lo"]) * a["slope"]).alias("al"), (a["y"] + (hi - a["lo"]) * a["slope"]).alias("ar"),
        (b["y"] + (lo - b["lo"]) * b["slope"]).alias("bl"), (b["y"] + (hi - b["lo"]) * b["slope"]).alias("br"),
    )
    return F.when(hi > lo, a["sign"] * b["sign"] / 2.0 * let(heights, area)).otherwise(0.0)


def intersection_area(ring_a: Column, ring_b: Column) -> Column:
    """Area shared by two simple rings.

    A ring's inside is the signed sum of the strips below its edges, so the shared area is the
    signed sum of what lies below both edges, over all edge pairs. Exact for concave rings and for
    shared borders.
    """

    def shared(first):
        def local(r):
            return F.transform(r, lambda p: point(p["x"] - first["x"], p["y"] - first["y"]))

        return let(_strips(local(ring_b)), lambda sb: _sum(_strips(local(ring_a)), lambda a: _sum(sb, lambda b: _under_both(a, b))))

    return F.abs(let(F.element_at(ring_a, 1), shared))


def on_border(r_edges: Column, px, py, eps: float = 1e-6) -> Column:
    """Within ``eps`` of an edge: a box test first, then the distance to the edge's line."""

    def close(e):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        cross = dx * (py - e["y1"]) - dy * (px - e["x1"])
        return (
            (px >= F.least(e["x1"], e["x2"]) - eps) & (px <= F.greatest(e["x1"], e["x2"]) + eps)
            & (py >= F.least(e["y1"], e["y2"]) - eps) & (py <= F.greatest(e["y1"], e["y2"]) + eps)
            & (cross * cross <= (dx * dx + dy * dy) * (eps * eps))
        )

    return F.exists(r_edges, close)


def _inside(r_edges: Column, px, py) -> Column:
    def crosses(e):
        return ((e["y1"] > py) != (e["y2"] > py)) & (
            px < (e["x2"] - e["x1"]) * (py - e["y1"]) / F.when(e["y2"] != e["y1"], e["y2"] - e["y1"]) + e["x1"]
        )

    return F.size(F.filter(r_edges, crosses)) % 2 == 1


def rings_touch(ring_a: Column, ring_b: Column) -> Column:
    """True when a vertex of one ring lies on the other's border."""

    def touch(ea, eb):
        return F.exists(eb, lambda e: on_border(ea, e["x1"], e["y1"])) | F.exists(ea, lambda e: on_border(eb, e["x1"], e["y1"]))

    return let(edges(ring_a), lambda ea: let(edges(ring_b), lambda eb: touch(ea, eb)))


def intersection_vertices(ring_a: Column, ring_b: Column, digits: int = 3) -> Column:
    """Distinct corner points of the shared region: vertices inside or on the other ring, and crossings."""

    def corner(x, y):
        return point(js_round(x, digits), js_round(y, digits))

    def corners(ea, eb):
        def held(own, other):
            kept = F.filter(own, lambda e: _inside(other, e["x1"], e["y1"]) | on_border(other, e["x1"], e["y1"]))
            return F.transform(kept, lambda e: corner(e["x1"], e["y1"]))

        def crossing(a, b):
            def meet(v):
                t = (v["ox"] * v["dy2"] - v["oy"] * v["dx2"]) / v["denom"]
                return corner(a["x1"] + t * v["dx1"], a["y1"] + t * v["dy1"])

            dx1, dy1, dx2, dy2 = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
            ox, oy = b["x1"] - a["x1"], b["y1"] - a["y1"]
            v = F.struct(
                dx1.alias("dx1"), dy1.alias("dy1"), dx2.alias("dx2"), dy2.alias("dy2"), ox.alias("ox"), oy.alias("oy"), (dx1 * dy2 - dy1 * dx2).alias("denom")
            )

            def inner(n, d):
                return (n * d > 0) & (F.abs(n) < F.abs(d))

            def strict(v):
                hit = inner(v["ox"] * v["dy2"] - v["oy"] * v["dx2"], v["denom"]) & inner(v["ox"] * v["dy1"] - v["oy"] * v["dx1"], v["denom"])
                return F.when(hit, meet(v))

            return let(v, strict)

        met = F.flatten(F.transform(ea, lambda a: F.transform(eb, lambda b: crossing(a, b))))
        return F.array_distinct(F.concat(held(ea, eb), held(eb, ea), F.filter(met, lambda p: p.isNotNull())))

    return let(edges(ring_a), lambda ea: let(edges(ring_b), lambda eb: corners(ea, eb)))


def project_on_path(path: Column, x, y) -> Column:
    """Nearest position on a polyline: struct (distance, segment, t, x, y); the earliest segment wins ties."""

    def on_edge(e, i):
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        l2 = dx * dx + dy * dy
        t = F.when(l2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.when(l2 > 0, l2)))).otherwise(0.0)
        px, py = e["x1"] + t * dx, e["y1"] + t * dy
        return F.struct(F.hypot(x - px, y - py).alias("distance"), i.alias("segment"), t.alias("t"), px.alias("x"), py.alias("y"))

    return F.array_min(F.transform(edges(path), on_edge))


def segments_meet(a: Column, b: Column) -> Column:
    """Closed intersection test of two edges: crossing, touching or overlapping."""
    apart = (
        (F.greatest(a["x1"], a["x2"]) < F.least(b["x1"], b["x2"])) | (F.greatest(b["x1"], b["x2"]) < F.least(a["x1"], a["x2"]))
        | (F.greatest(a["y1"], a["y2"]) < F.least(b["y1"], b["y2"])) | (F.greatest(b["y1"], b["y2"]) < F.least(a["y1"], a["y2"]))
    )

    def turn(e, x, y):
        return F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))

    split_b = turn(a, b["x1"], b["y1"]) * turn(a, b["x2"], b["y2"]) <= 0
    split_a = turn(b, a["x1"], a["y1"]) * turn(b, a["x2"], a["y2"]) <= 0
    return ~apart & split_a & split_b


def rings_meet(ring_a: Column, ring_b: Column) -> Column:
    """True when two rings share any point, inside included."""

    def meet(ea, eb):
        fa, fb = F.element_at(ea, 1), F.element_at(eb, 1)
        border = F.exists(ea, lambda a: F.exists(eb, lambda b: segments_meet(a, b)))
        return border | _inside(eb, fa["x1"], fa["y1"]) | _inside(ea, fb["x1"], fb["y1"])

    return let(edges(ring_a), lambda ea: let(edges(ring_b), lambda eb: meet(ea, eb)))
