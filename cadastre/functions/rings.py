"""Ring rebuilding helpers that run on Arrow batches.

Only what column expressions cannot say: recursive simplification, hulls, rectangles and outlines.
Each helper takes one ring as an (n, 2) array; Spark partitions and ships the rings.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

XY = "xs array<double>, ys array<double>"
XY_TYPE = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("xs", "ys")])
STATS_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("hull_area", "rect_long", "rect_short")])


def _points(xs, ys) -> np.ndarray:
    return np.array([xs, ys], dtype=float).T


def _frame(rings) -> pd.DataFrame:
    return pd.DataFrame({"xs": [r[:, 0] for r in rings], "ys": [r[:, 1] for r in rings]})


def xy(r: Column) -> tuple[Column, Column]:
    return F.transform(r, lambda p: p["x"]), F.transform(r, lambda p: p["y"])


def to_ring(pair: Column) -> Column:
    return F.zip_with(pair["xs"], pair["ys"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def per_ring(fn):
    """Column function applying ``fn(points, parameter)`` to a ring column."""

    @F.pandas_udf(XY_TYPE)
    def run(xs: pd.Series, ys: pd.Series, parameter: pd.Series) -> pd.DataFrame:
        return _frame([fn(_points(x, y), p) for x, y, p in zip(xs, ys, parameter)])

    def column(r: Column, parameter: Column | float = 0.0) -> Column:
        p = parameter if isinstance(parameter, Column) else F.lit(float(parameter))
        return to_ring(run(*xy(r), p))

    return column


#: spans of a path up to this long are measured in floats, longer ones as arrays
SHORT_SPAN = 32


def _farthest(points: np.ndarray, pts: list[tuple[float, float]], a: int, b: int) -> tuple[int, float]:
    """The point between two others that strays farthest from their line, and by how much."""
    if b - a > SHORT_SPAN:
        away = points[a + 1 : b] - points[a]
        chord = points[b] - points[a]
        length = np.hypot(*chord)
        stray = np.hypot(*away.T) if length == 0 else np.abs(away @ np.array([-chord[1], chord[0]])) / length
        k = int(np.argmax(stray))
        return a + 1 + k, float(stray[k])
    (x0, y0), (x1, y1) = pts[a], pts[b]
    dx, dy = x1 - x0, y1 - y0
    length = math.hypot(dx, dy)
    stray = [math.hypot(x - x0, y - y0) if length == 0 else abs((y - y0) * dx - (x - x0) * dy) / length for x, y in pts[a + 1 : b]]
    most = max(stray)
    return a + 1 + stray.index(most), most


def corner_mask(points: np.ndarray, anchors: list[int], tolerance: float) -> np.ndarray:
    """Which points a path keeps: the anchors, and between two kept points whatever strays farthest
    from their line by more than the tolerance."""
    pts = _tuples(points)
    kept = np.zeros(len(points), dtype=bool)
    kept[anchors] = True
    open_spans = list(zip(anchors[:-1], anchors[1:]))
    while open_spans:
        a, b = open_spans.pop()
        if b - a < 2:
            continue
        middle, stray = _farthest(points, pts, a, b)
        if stray > tolerance:
            kept[middle] = True
            open_spans += [(a, middle), (middle, b)]
    return kept


def keep_corners(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Open path without the points closer than the tolerance to its simplified course."""
    return points if len(points) <= 2 else points[corner_mask(points, [0, len(points) - 1], tolerance)]


def keep_ring_corners(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Closed ring simplified between two anchors: its first vertex and the one farthest from that."""
    if len(ring) < 5:
        return ring
    opposite = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    # a ring without extent has no vertex apart from the first; any other serves
    return ring[corner_mask(ring, [0, opposite or 1, len(ring) - 1], tolerance)]


# fixed values: shortest edge, straightness and spike limits of a regular ring
MIN_EDGE, STRAIGHT_COS, SPIKE_COS, SPIKE_EDGE = 8.0, 0.96, -0.85, 40.0


def _unwanted(pts: list[tuple[float, float]]) -> list[bool]:
    out = []
    for (ox, oy), (px, py), (qx, qy) in zip(pts[-1:] + pts[:-1], pts, pts[1:] + pts[:1]):
        ux, uy, vx, vy = px - ox, py - oy, qx - px, qy - py
        before, after = math.hypot(ux, uy), math.hypot(vx, vy)
        shorter, product = min(before, after), before * after
        cos = (ux * vx + uy * vy) / (product if product > 0 else 1.0)
        out.append(shorter < MIN_EDGE or cos > STRAIGHT_COS or (cos < SPIKE_COS and shorter < SPIKE_EDGE))
    return out


def unwanted_corners(corners: np.ndarray) -> np.ndarray:
    """Vertices of an unclosed ring at a short edge, on a straight run or at the tip of a spike."""
    return np.array(_unwanted(_tuples(corners)), dtype=bool)


def regular_ring(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Whole-pixel ring in which no vertex but the first is unwanted.

    Vertices are judged against their neighbours of the moment, every second one of an unwanted run
    goes, and the rest is judged again; a single left-to-right pass may keep other vertices of such a run.
    A ring that would lose its area comes back in whole pixels only.
    """
    if len(ring) < 4:
        return ring
    whole = np.floor(ring + 0.5)
    if (whole[0] != whole[-1]).any():
        whole = np.vstack([whole, whole[:1]])
    corners = _tuples(keep_ring_corners(whole, tolerance)[:-1])
    while len(corners) >= 3:
        kept, wanted_at = [], 0
        for i, unwanted in enumerate(_unwanted(corners)):
            if i == 0 or not unwanted:
                wanted_at = i
            if (i - wanted_at) % 2 == 0:
                kept.append(corners[i])
        if len(kept) == len(corners):
            return np.array(corners + corners[:1])
        corners = kept
    return whole


def hull(points: np.ndarray) -> np.ndarray:
    """Closed convex hull; fewer than three distinct corners come back unclosed."""
    pts = sorted(set(_tuples(points)))
    if len(pts) <= 2:
        return np.array(pts).reshape(-1, 2)

    def chain(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = chain(pts) + chain(pts[::-1])
    return np.array(ring + ring[:1]) if len(ring) >= 3 else np.array(ring)


def ring_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float(abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2)


def smallest_rectangle(points: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Corners (closed) and side lengths of the smallest rectangle around the points."""
    return _rectangle_around(hull(points), points)


def _rectangle_around(corners: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, float, float]:
    if len(corners) < 4:
        span = np.ptp(points, axis=0)
        return np.vstack([corners, corners[:1]]), float(np.hypot(*span)), 0.0
    pts = _tuples(corners)
    best = None
    for (px, py), (qx, qy) in zip(pts[:-1], pts[1:]):
        length = math.hypot(qx - px, qy - py)
        ux, uy = (qx - px) / length, (qy - py) / length
        along, across = [x * ux + y * uy for x, y in pts], [y * ux - x * uy for x, y in pts]
        lo_u, hi_u, lo_v, hi_v = min(along), max(along), min(across), max(across)
        area = round((hi_u - lo_u) * (hi_v - lo_v), 9)
        if best is None or area < best[0]:
            best = area, ux, uy, lo_u, hi_u, lo_v, hi_v
    _, ux, uy, lo_u, hi_u, lo_v, hi_v = best
    box = [(u * ux - v * uy, u * uy + v * ux) for u, v in ((lo_u, lo_v), (hi_u, lo_v), (hi_u, hi_v), (lo_u, hi_v))]
    return np.array([*box, box[0]]), hi_u - lo_u, hi_v - lo_v


def square_up(ring: np.ndarray, max_deviation: float) -> np.ndarray:
    """A four-corner ring close to right angles becomes its smallest rectangle."""
    pts = _tuples(ring)
    pts = pts[:-1] if pts and pts[0] == pts[-1] else pts
    if len(pts) != 4 or len(ring) < 5:
        return ring
    for (ox, oy), (px, py), (qx, qy) in zip(pts[-1:] + pts[:-1], pts, pts[1:] + pts[:1]):
        ux, uy, vx, vy = ox - px, oy - py, qx - px, qy - py
        a, b = math.hypot(ux, uy), math.hypot(vx, vy)
        if min(a, b) < 1e-4:
            return ring
        if abs(math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / (a * b))))) - 90.0) > max_deviation:
            return ring
    return np.round(smallest_rectangle(np.trunc(np.array(pts)))[0], 2)


def _tuples(ring: np.ndarray) -> list[tuple[float, float]]:
    return [tuple(p) for p in np.asarray(ring, dtype=float).tolist()]


# Rings are mostly short, so their edges are walked as tuples of floats: array calls on a few
# numbers cost more than the arithmetic.


def _edges(ring) -> list[tuple[float, float, float, float]]:
    return [(*p, *q) for p, q in zip(ring[:-1], ring[1:])]


def _cut(edge, others, eps=1e-9) -> list[float]:
    """Positions on one edge where the other ring's edges meet it."""
    px, py, qx, qy = edge
    dx, dy = qx - px, qy - py
    l2 = dx * dx + dy * dy
    # edges whose boxes are apart by far more than the tolerance can't meet; tiny edges are always compared
    margin = 1e-6 * (1.0 + abs(dx) + abs(dy)) if l2 > 1e-6 else math.inf
    xmin, xmax, ymin, ymax = min(px, qx) - margin, max(px, qx) + margin, min(py, qy) - margin, max(py, qy) + margin
    cuts = {0.0, 1.0}
    for rx, ry, sx, sy in others:
        ex, ey = sx - rx, sy - ry
        slack = 1e-6 * (abs(ex) + abs(ey))
        if min(rx, sx) - slack > xmax or max(rx, sx) + slack < xmin or min(ry, sy) - slack > ymax or max(ry, sy) + slack < ymin:
            continue
        cross = dx * ey - dy * ex
        wx, wy = rx - px, ry - py
        along = wx * dy - wy * dx
        if abs(cross) > eps:
            t, u = (wx * ey - wy * ex) / cross, along / cross
            if -eps <= t <= 1 + eps and -eps <= u <= 1 + eps:
                cuts.add(min(1.0, max(0.0, t)))
        elif l2 > 0 and abs(along) <= eps * max(1.0, l2):
            cuts.update(t for t in ((wx * dx + wy * dy) / l2, ((sx - px) * dx + (sy - py) * dy) / l2) if 0 < t < 1)
    return sorted(cuts)


def _side(px: float, py: float, ring_edges, eps=1e-7) -> tuple[str, tuple[float, float] | None]:
    """'in', 'out' or 'on' (with the direction of the border edge) for a point."""
    inside = False
    for rx, ry, sx, sy in ring_edges:
        ex, ey, wx, wy = sx - rx, sy - ry, px - rx, py - ry
        if min(rx, sx) - eps <= px <= max(rx, sx) + eps and min(ry, sy) - eps <= py <= max(ry, sy) + eps:
            l2 = ex * ex + ey * ey
            if l2 > 0:
                t = min(1.0, max(0.0, (wx * ex + wy * ey) / l2))
                if math.hypot(wx - t * ex, wy - t * ey) <= eps:
                    return "on", (ex, ey)
        if (ry > py) != (sy > py) and px < ex * (py - ry) / ey + rx:
            inside = not inside
    return ("in" if inside else "out"), None


def _signed_area(ring) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring[:-1], ring[1:])) / 2


def _counter_clockwise(ring):
    return ring if _signed_area(ring) >= 0 else ring[::-1]


def _pieces(ring, other):
    against = _edges(other)
    for edge in _edges(ring):
        px, py, qx, qy = edge
        dx, dy = qx - px, qy - py
        length = math.hypot(dx, dy)
        cuts = _cut(edge, against)
        for t0, t1 in zip(cuts[:-1], cuts[1:]):
            if (t1 - t0) * length > 1e-9:
                middle = (t0 + t1) / 2
                side, border = _side(px + dx * middle, py + dy * middle, against)
                same = border is not None and border[0] * dx + border[1] * dy > 0
                yield (px + dx * t0, py + dy * t0), (px + dx * t1, py + dy * t1), side, same


def _stitch(pieces) -> list[list[tuple[float, float]]]:
    """Closed outlines from directed pieces; at a shared corner the sharpest left turn is taken."""

    def key(p):
        return (round(p[0], 6), round(p[1], 6))

    leaving = defaultdict(list)
    for a, b in pieces:
        leaving[key(a)].append((a, b))
    rings = []
    while any(leaving.values()):
        start = min(k for k, v in leaving.items() if v)
        a, b = leaving[start].pop()
        ring = [a, b]
        while key(b) != start:
            nxt = leaving.get(key(b))
            if not nxt:
                break
            if len(nxt) == 1:
                _, b = nxt.pop()
            else:
                cx, cy = ring[-1][0] - ring[-2][0], ring[-1][1] - ring[-2][1]
                legs = [(f[0] - e[0], f[1] - e[1]) for e, f in nxt]
                turns = [math.atan2(cx * y - cy * x, cx * x + cy * y) for x, y in legs]
                _, b = nxt.pop(turns.index(max(turns)))
            ring.append(b)
        if key(b) == start:
            rings.append(straightened(ring))
    return [r for r in rings if len(r) >= 4]


def straightened(ring: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Drop vertices on a straight run; the start vertex included."""
    pts = ring[:-1]
    kept = [
        p for o, p, q in zip(pts[-1:] + pts[:-1], pts, pts[1:] + pts[:1])
        if abs((p[0] - o[0]) * (q[1] - p[1]) - (p[1] - o[1]) * (q[0] - p[0])) > 1e-9
    ]
    return kept + kept[:1] if len(kept) >= 3 else kept


def union_outline(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Outer ring of both rings together; the hull of all points when they do not touch along an edge."""
    ra, rb = _counter_clockwise(_tuples(a)), _counter_clockwise(_tuples(b))
    kept = [(p, q) for p, q, side, same in _pieces(ra, rb) if side == "out" or (side == "on" and same)]
    kept += [(p, q) for p, q, side, _ in _pieces(rb, ra) if side == "out"]
    outer = [r for r in _stitch(kept) if _signed_area(r) > 0]
    return np.array(outer[0]) if len(outer) == 1 else hull(np.vstack([a, b]))


def difference_outline(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First piece of ring ``a`` left after taking ring ``b`` away; empty when nothing is left."""
    ra, rb = _counter_clockwise(_tuples(a)), _counter_clockwise(_tuples(b))
    kept = [(p, q) for p, q, side, same in _pieces(ra, rb) if side == "out" or (side == "on" and not same)]
    kept += [(q, p) for p, q, side, _ in _pieces(rb, ra) if side == "in"]
    outer = [r for r in _stitch(kept) if _signed_area(r) > 0]
    return np.array(outer[0]) if outer else np.zeros((0, 2))


simplified = per_ring(keep_corners)
simplified_ring = per_ring(keep_ring_corners)
simplified_path = per_ring(lambda pts, t: (keep_ring_corners if len(pts) > 2 and (pts[0] == pts[-1]).all() else keep_corners)(pts, t))
regularised = per_ring(regular_ring)
hull_ring = per_ring(lambda pts, _: hull(pts))
squared = per_ring(square_up)


@F.pandas_udf(STATS_TYPE)
def _outline_stats(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(xs, ys):
        p = _points(x, y)
        corners = hull(p)
        _, a, b = _rectangle_around(corners, p)
        rows.append((abs(_signed_area(corners.tolist())) if len(corners) >= 3 else 0.0, max(a, b), min(a, b)))
    return pd.DataFrame(rows, columns=["hull_area", "rect_long", "rect_short"])


def outline_stats(r: Column) -> Column:
    """Hull area and smallest-rectangle sides of a ring."""
    return _outline_stats(*xy(r))


@F.pandas_udf(XY_TYPE)
def _merged(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series) -> pd.DataFrame:
    return _frame([union_outline(_points(*a), _points(*b)) for a, b in zip(zip(ax, ay), zip(bx, by))])


def merged_ring(a: Column, b: Column) -> Column:
    return to_ring(_merged(*xy(a), *xy(b)))


@F.pandas_udf(XY_TYPE)
def _clipped(xs: pd.Series, ys: pd.Series, wx: pd.Series, wy: pd.Series) -> pd.DataFrame:
    out = []
    for x, y, holes_x, holes_y in zip(xs, ys, wx, wy):
        ring = _points(x, y)
        for hx, hy in zip(holes_x, holes_y):
            if len(ring):
                ring = difference_outline(ring, _points(hx, hy))
        out.append(ring)
    return _frame(out)


def clipped_ring(r: Column, holes: Column) -> Column:
    """``r`` minus each ring of the array ``holes``, in order."""
    hx = F.transform(holes, lambda h: F.transform(h, lambda p: p["x"]))
    hy = F.transform(holes, lambda h: F.transform(h, lambda p: p["y"]))
    return to_ring(_clipped(*xy(r), hx, hy))
