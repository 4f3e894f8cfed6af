"""Golden values and invariants of the ring functions."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.functions import geom as G, rings as S
from cadastre.operators import measures as M, repair as P
from tests.conftest import RING_TYPE, ring

SQUARE = ring((100, 100), (200, 100), (200, 200), (100, 200), (100, 100))
NEXT = ring((200, 100), (300, 100), (300, 200), (200, 200), (200, 100))
FAR = ring((500, 500), (510, 500), (510, 510), (500, 510), (500, 500))
ELL = ring((0, 0), (40, 0), (40, 10), (10, 10), (10, 40), (0, 40), (0, 0))
BOW = ring((0, 0), (10, 0), (0, 10), (10, 10), (0, 0))


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {RING_TYPE}" for k in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("v")).first()["v"]


def test_areas_and_lengths(spark):
    assert one(spark, G.planar_area(F.col("r")), r=SQUARE) == 10000
    assert one(spark, G.planar_length(F.col("r")), r=SQUARE) == 400
    assert one(spark, G.planar_area(F.col("r")), r=ELL) == 700
    assert one(spark, G.self_intersections(F.col("r")), r=ELL) == 0
    assert one(spark, G.self_intersections(F.col("r")), r=BOW) == 1


def test_geodesic_square_near_equator(spark):
    side = 0.001
    r = ring((10, 0), (10 + side, 0), (10 + side, side), (10, side), (10, 0))
    metres = G.EARTH_RADIUS_M * np.radians(side)
    assert one(spark, G.geodesic_area(F.col("r")), r=r) == pytest.approx(metres**2, rel=1e-6)
    assert one(spark, G.geodesic_length(F.col("r")), r=r) == pytest.approx(4 * metres, rel=1e-6)


def test_intersection_area_known_cases(spark):
    def area(a, b):
        return one(spark, G.intersection_area(F.col("a"), F.col("b")), a=a, b=b)

    assert area(SQUARE, NEXT) == pytest.approx(0, abs=1e-9)
    assert area(SQUARE, SQUARE) == pytest.approx(10000)
    assert area(ELL, ring((5, 5), (30, 5), (30, 30), (5, 30), (5, 5))) == pytest.approx(25 * 5 + 5 * 20)
    assert area(SQUARE, FAR) == pytest.approx(0, abs=1e-9)


def clip_area(subject, clip):
    """Sutherland-Hodgman area against a convex counter-clockwise ring."""
    out = [np.array(p, dtype=float) for p in subject[:-1]]
    for a, b in zip(clip[:-1], clip[1:]):
        a, b = np.array(a, float), np.array(b, float)
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
        new = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                new.append(p)
            if sp * sq < 0:
                new.append(p + (q - p) * sp / (sp - sq))
        out = new
        if not out:
            return 0.0
    x, y = np.array(out).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def test_intersection_area_matches_clipping(spark):
    rnd = random.Random(7)

    def quad():
        x, y, w, h = rnd.randint(0, 30), rnd.randint(0, 30), rnd.randint(3, 30), rnd.randint(3, 30)
        return [(x, y), (x + w, y + rnd.randint(0, 2)), (x + w, y + h), (x + rnd.randint(0, 2), y + h), (x, y)]

    pairs = [(quad(), quad()) for _ in range(300)]
    rows = [(i, ring(*a), ring(*b)) for i, (a, b) in enumerate(pairs)]
    got = spark.createDataFrame(rows, f"i int, a {RING_TYPE}, b {RING_TYPE}").select("i", G.intersection_area(F.col("a"), F.col("b")).alias("s"), G.intersection_area(F.col("b"), F.col("a")).alias("t"))
    for row in got.collect():
        a, b = pairs[row.i]
        assert row.s == pytest.approx(clip_area(a, b), abs=1e-6)
        assert row.s == pytest.approx(row.t, abs=1e-6)


def test_repair_is_idempotent(spark):
    rows = [(1, ring((0, 0), (0, 0), (5, 0), (5, 5))), (2, ring((0, 0), (5, 0), (5, 5), (0, 0)))]
    df = spark.createDataFrame(rows, f"parcel_id int, ring {RING_TYPE}")
    first = M.repair_rings(df).collect()
    assert [(r.removed_vertices, r.was_open, len(r.clean)) for r in sorted(first, key=lambda r: r.parcel_id)] == [(1, True, 4), (0, False, 4)]
    again = M.repair_rings(M.repair_rings(df).select("parcel_id", F.col("clean").alias("ring"))).collect()
    assert all(r.removed_vertices == 0 and not r.was_open for r in again)


def test_two_squares_split_and_merge(spark):
    df = spark.createDataFrame([(1, SQUARE, NEXT, FAR)], f"parcel_id int, clean {RING_TYPE}, other {RING_TYPE}, far {RING_TYPE}").withColumn(
        "cut", F.lit(None).cast(RING_TYPE)
    )
    s = P.split_rings(df).first()
    areas = [S.ring_area(np.array([(p.x, p.y) for p in r])) for r in (s.ring_a, s.ring_b)]
    assert s.split_error is None and areas == [5000, 5000]
    half = spark.createDataFrame([(ring((150, 100), (200, 100), (200, 200), (150, 200), (150, 100)), NEXT)], f"ring_a {RING_TYPE}, ring_b {RING_TYPE}")
    merged = P.merge_rings(half).select(G.planar_area(F.col("merged")).alias("a")).first()["a"]
    assert merged == pytest.approx(15000)
    apart = P.merge_rings(df, "clean", "far").select(G.planar_area(F.col("merged")).alias("a")).first()["a"]
    assert apart > 10000 + 100


def test_split_refuses_a_line_outside(spark):
    cut = ring((400, 0), (400, 50))
    df = spark.createDataFrame([(1, SQUARE, cut)], f"parcel_id int, clean {RING_TYPE}, cut {RING_TYPE}")
    assert P.split_rings(df).first().split_error is not None


def test_outlines():
    a = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], float)
    b = a + [5, 5]
    assert S.ring_area(S.union_outline(a, b)) == pytest.approx(175)
    assert S.ring_area(S.difference_outline(a, b)) == pytest.approx(75)
    hole = np.array([(-5, 4), (15, 4), (15, 6), (-5, 6), (-5, 4)], float)
    assert S.ring_area(S.difference_outline(a, hole)) == pytest.approx(40)
    assert len(S.difference_outline(a, np.array([(-5, -5), (20, -5), (20, 20), (-5, 20), (-5, -5)], float))) == 0
    assert S.ring_area(S.hull(np.vstack([a, b]))) == pytest.approx(200)


def test_hull_matches_extreme_points():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        p = rnd.integers(0, 20, (30, 2)).astype(float)
        h = S.hull(p)
        for (a, b), q in itertools.product(zip(h[:-1], h[1:]), p):
            assert (b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) >= -1e-9


def test_simplification_keeps_tolerance():
    t = np.linspace(0, 20, 200)
    line = np.column_stack([t * 10, np.sin(t) * 15])
    slim = S.keep_corners(line, 2.0)
    assert len(slim) < len(line) and (slim[0] == line[0]).all() and (slim[-1] == line[-1]).all()


def test_group_hulls_reduce_big_groups(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.uniform(0, 100), rnd.uniform(0, 100)) for k in (1, 2) for _ in range(500)]
    df = spark.createDataFrame(rows, "k int, px double, py double").repartition(5)
    got = {r.k: r.a for r in P.group_hulls(df, ["k"]).select("k", G.planar_area(F.col("ring")).alias("a")).collect()}
    for k in (1, 2):
        pts = np.array([(x, y) for kk, x, y in rows if kk == k])
        assert got[k] == pytest.approx(S.ring_area(S.hull(pts)))


def test_spikes_on_spikes_go_however_many(spark):
    """Each round bares the next spike: more rounds than any small limit."""
    box = [(0, 0), (400, 0), (400, 300), (0, 300)]
    teeth = [(201, 300 + 30.0 * k) for k in range(12)]  # only the peak is sharp; without it the pair below is at a short edge
    ridge = [*teeth, (200, 700), *[(400 - x, y) for x, y in reversed(teeth)]]
    rows = [(1, ring(*box[:3], *ridge, box[3], box[0])), (2, ring(*box, box[0])), (3, ring((0, 0), (5, 5), (0, 0))), (4, None), (5, [])]
    df = spark.createDataFrame(rows, f"id int, ring {RING_TYPE}").select("id", G.despiked(F.col("ring"), 50.0).alias("ring"))
    got = {r.id: r.ring and [(p.x, p.y) for p in r.ring] for r in df.collect()}
    assert got[1] == got[2] == [(float(x), float(y)) for x, y in [*box, box[0]]]
    assert got[3] == [(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)] and not got[4] and not got[5]


def test_outlines_of_small_rings_are_quick():
    rnd = np.random.default_rng(5)
    rects = [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float) for x, y, w, h in rnd.integers(5, 60, (2001, 4))]
    start = time.process_time()
    merged = [S.union_outline(a, b) for a, b in zip(rects, rects[1:])]
    left = [S.difference_outline(a, b) for a, b in zip(rects, rects[1:])]
    took = time.process_time() - start
    for a, b, m in zip(rects, rects[1:], merged):
        w, h = np.minimum(a[2], b[2]) - np.maximum(a[0], b[0])
        if w > 0 and h > 0:
            assert S.ring_area(m) == pytest.approx(S.ring_area(a) + S.ring_area(b) - w * h)
    assert len(left) == 2000 and took < 2.5


def test_small_rings_are_rebuilt_quickly():
    rnd = np.random.default_rng(6)
    rings = [np.array([(x, y), (x + w, y), (x + w, y + h), (x + 5, y + h), (x, y)], float) for x, y, w, h in rnd.integers(8, 90, (4000, 4))]
    start = time.process_time()
    for r in rings:
        assert S.smallest_rectangle(r)[1] > 0 and len(S.square_up(r, 22.0)) == 5 and len(S.regular_ring(r, 12.0)) >= 4
    assert time.process_time() - start < 2.5
