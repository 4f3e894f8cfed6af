"""Distributed selections against their sequential definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.functions import geom as G
from cadastre.operators import chains, detect as T, history as H, raster as R
from cadastre.operators.groups import map_groups
from cadastre.operators.rounds import components, greedy_dropped
from cadastre.plans import infer as I
from tests.conftest import RING_TYPE, ring


def sequential_drop(n, pairs):
    against = {}
    for s, w in pairs:
        against.setdefault(w, []).append(s)
    kept = set()
    for i in range(n):
        if not any(s in kept for s in against.get(i, [])):
            kept.add(i)
    return set(range(n)) - kept


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    n = 60
    pairs = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(150)})
    df = spark.createDataFrame(pairs, "strong long, weak long")
    expected = sequential_drop(n, pairs)
    for parts in (1, 5):
        assert {r.id for r in greedy_dropped(df.repartition(parts)).collect()} == expected


def test_greedy_long_chain(spark):
    pairs = [(i, i + 1) for i in range(25)]
    got = {r.id for r in greedy_dropped(spark.createDataFrame(pairs, "strong long, weak long")).collect()}
    assert got == set(range(1, 26, 2))


def test_components_equal_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)]
    root = list(range(80))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    expected = {v: find(v) for e in edges for v in e if e[0] != e[1]}
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: v for k, v in expected.items() if k in got} and set(expected) == set(got)


def naive_chain(lines, gap, angle):
    """Joints by rising gap, each end once, rings left open; paths from the line of the smallest id."""

    def heading(p):
        return np.degrees(np.arctan2(p[-1][1] - p[0][1], p[-1][0] - p[0][0]))

    ids, pairs = sorted(lines), []
    for i in ids:
        for j in ids:
            turn = abs(heading(lines[i]) - heading(lines[j])) % 180
            if i < j and min(turn, 180 - turn) <= angle:
                for s in (0, 1):
                    for t in (0, 1):
                        d = round(float(np.hypot(*np.subtract(lines[i][-s], lines[j][-t]))), 6)
                        if d <= gap:
                            u, v = 2 * i + s, 2 * j + t
                            pairs.append((d, (u * 7919 + v * 104729) % 1000003, u, v))
    at, joints = {}, []
    for p in sorted(pairs):
        if p[2] not in at and p[3] not in at:
            at[p[2]], at[p[3]] = p[3], p[2]
            joints.append(p)
    for p in reversed(sorted(joints)):  # the widest joint of a ring opens it
        n = p[2]
        seen = [n]
        while n in at and at[n] ^ 1 != seen[0] and len(seen) < 2 * len(ids) + 2:
            n = at[n] ^ 1
            seen.append(n)
        if n in at and at[n] ^ 1 == seen[0]:
            del at[p[2]], at[p[3]]
    out, used = [], set()
    for i in ids:
        if i in used:
            continue
        left, right = [], []
        for side, walk in ((0, left), (1, right)):
            n = 2 * i + side
            while n in at:
                n = at[n] ^ 1
                walk.append(n)
        def points(n, enter_first):
            p = lines[n >> 1]
            return p if (n & 1) == (1 if enter_first else 0) else p[::-1]
        path = [q for n in reversed(left) for q in points(n, False)] + list(lines[i]) + [q for n in right for q in points(n, True)]
        members = [i, *[n >> 1 for n in left + right]]
        used.update(members)
        out.append((sorted(members), path))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_merging_equals_matching_by_gap(spark, seed):
    rnd = random.Random(seed)
    rows = {}
    for i in range(60):
        x, y, w, h = rnd.randrange(0, 300), rnd.randrange(0, 300), rnd.randrange(10, 60), rnd.randrange(5, 40)
        rows[i] = [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h))]
    df = spark.createDataFrame([(1, "ROAD", i, ring(*p)) for i, p in rows.items()], f"imagery_id int, detection_type string, feature_id long, pts {RING_TYPE}")
    got = sorted((sorted(r.merged_ids), [(p.x, p.y) for p in r.pts]) for r in T.merge_collinear(df).collect())
    assert got == naive_chain(rows, 32.0, 25.0)


def test_a_long_line_in_pieces_is_one_line_again(spark):
    """Shuffled ids, pieces that run either way, small gaps, copies; attributes of the most confident piece."""
    n = 90
    order = list(range(n))
    random.Random(4).shuffle(order)
    rows = []
    for k in range(n):
        p = [(20.0 * k, 100.0), (20.0 * k + 19.0, 100.0)]
        rows.append((1, "WALL", order[k], ring(*(p if k % 3 else p[::-1])), 0.5 + (k == 17) * 0.4, "ml" if k == 17 else "cv"))
    rows.append((1, "WALL", 500, rows[7][3], 0.1, "cv"))  # equal points
    rows += [(1, "WALL", 600, ring((0, 400), (50, 400)), None, "cv"), (2, "WALL", 601, ring((0, 100), (19, 100)), 0.3, "cv"), (1, "ROAD", 602, ring((0, 100), (19, 100)), 0.3, "cv")]
    df = spark.createDataFrame(rows, f"imagery_id int, detection_type string, feature_id long, pts {RING_TYPE}, confidence double, provider string")
    got = {r.feature_id: r for r in T.merge_collinear(df).collect()}
    assert sorted(got) == [0, 600, 601, 602]
    long = got[0]
    assert long.merged_ids == [*range(n), 500] and (long.confidence, long.provider) == (0.9, "ml")
    xs = [p.x for p in long.pts]
    assert len(xs) == 2 * n and xs in (sorted(xs), sorted(xs)[::-1])
    assert got[600].confidence is None


def test_a_ring_of_lines_opens_at_its_widest_joint(spark):
    corners = [(100 + 40 * np.cos(a), 100 + 40 * np.sin(a)) for a in np.linspace(0, 2 * np.pi, 25)]
    rows = [(1, "FENCE", k, ring(corners[k], (corners[k + 1][0], corners[k + 1][1] + (1.0 if k == 9 else 0.0)))) for k in range(24)]
    df = spark.createDataFrame(rows, f"imagery_id int, detection_type string, feature_id long, pts {RING_TYPE}")
    got = T.merge_collinear(df).collect()
    assert len(got) == 1 and len(got[0].pts) == 48
    assert {(round(p.x, 6), round(p.y, 6)) for p in (got[0].pts[0], got[0].pts[-1])} == {(round(corners[10][0], 6), round(corners[10][1], 6)), (round(corners[10][0], 6), round(corners[10][1] + 1.0, 6))}


def test_list_ranks_of_a_long_list(spark):
    links = spark.range(3000).selectExpr("id * 7 AS n", "CASE WHEN id < 2999 THEN (id + 1) * 7 END AS nxt")
    got = chains.list_ranks(links).collect()
    assert len(got) == 3000 and all(r["last"] == 2999 * 7 and r["steps"] == 2999 - r["n"] // 7 for r in got)


def test_suppression_handles_copies(spark):
    box = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    shifted = ring((2, 0), (12, 0), (12, 10), (2, 10), (2, 0))
    rows = [(1, "BUILDING", i, 0.5 + (i % 3) / 10, box) for i in range(50)] + [(1, "BUILDING", 100, 0.9, shifted), (1, "BUILDING", 101, 0.2, ring((50, 50), (60, 50), (60, 60), (50, 60), (50, 50)))]
    df = spark.createDataFrame(rows, f"imagery_id int, detection_type string, feature_id long, confidence double, pts {RING_TYPE}")
    assert sorted(r.feature_id for r in T.suppress(df).collect()) == [100, 101]


def flood(pixels, eight):
    left, out = set(pixels), {}
    while left:
        seed = min(left)
        stack, comp = [seed], set()
        left.discard(seed)
        while stack:
            x, y = stack.pop()
            comp.add((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (dx or dy) and (eight or dx == 0 or dy == 0) and (x + dx, y + dy) in left:
                        left.discard((x + dx, y + dy))
                        stack.append((x + dx, y + dy))
        for p in comp:
            out[p] = frozenset(comp)
    return set(out.values())


@pytest.mark.parametrize("eight", [False, True])
def test_labels_equal_flood_fill(spark, eight):
    rnd = random.Random(9)
    pixels = {(x, y) for x in range(20) for y in range(17) if rnd.random() < 0.55}
    df = spark.createDataFrame([(1, x, y) for x, y in pixels], "imagery_id long, x int, y int")
    got = {}
    for r in R.label_components(df, tile=6, eight=eight).collect():
        got.setdefault(r.label, set()).add((r.x, r.y))
    assert {frozenset(v) for v in got.values()} == flood(pixels, eight)


def test_number_rows_is_gap_free_for_one_hot_key(spark):
    rows = [(1 if i % 3 else 2, i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(7)
    got = H.number_rows(df, ["k"], ["o"], F.floor(F.col("o") / 50), ["v"]).collect()
    for key in (1, 2):
        mine = sorted((r.o, r.number, r.prev_v) for r in got if r.k == key)
        assert [m[1] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[2] for m in mine] == [None] + [f"v{m[0]}" for m in mine[:-1]]


def test_lineage_raises_on_a_cycle(spark):
    with pytest.raises(RuntimeError):
        H.lineage(spark.createDataFrame([(1, 2), (2, 1)], "parcel_id long, parent_parcel_id long"), max_rounds=6).collect()


def test_map_groups_spans_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k int, v int")
        out = map_groups(df, ["k"], lambda g: [(int(g["k"][0]), int(g["v"].sum()), len(g["v"]))], "k int, s long, n int")
        assert {(r.k, r.s, r.n) for r in out.collect()} == {(k, sum(range(k, 100, 5)), 20) for k in range(5)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def sequential_pick(cands):
    order = sorted(cands, key=lambda c: (-c["score"], c["id"]))
    meet = lambda a, b: not (a["x"] > b["x"] + 10 or b["x"] > a["x"] + 10 or a["y"] > b["y"] + 10 or b["y"] > a["y"] + 10)
    acc, rev = [], []
    for least in (58, 50):
        for c in order:
            if len(acc) >= 3:
                break
            if c not in acc and c["sup"] >= least and not any(meet(c, a) for a in acc):
                acc.append(c)
    for c in order:
        if rev:
            break
        if c not in acc and c["sup"] >= 45 and not any(meet(c, a) for a in acc + rev):
            rev.append(c)
    return {(c["id"], "ACCEPTED") for c in acc} | {(c["id"], "REVIEW") for c in rev}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_selection_equals_sequential(spark, seed):
    rnd = random.Random(seed)
    cands = [{"id": i, "x": rnd.randrange(0, 40), "y": rnd.randrange(0, 40), "score": rnd.randrange(100) / 100, "sup": rnd.randrange(40, 70)} for i in range(30)]
    rows = [(1, c["id"], c["score"], c["sup"], ring((c["x"], c["y"]), (c["x"] + 10, c["y"]), (c["x"] + 10, c["y"] + 10), (c["x"], c["y"] + 10), (c["x"], c["y"]))) for c in cands]
    df = spark.createDataFrame(rows, f"imagery_id int, feature_id long, score double, supported_pct int, ring {RING_TYPE}")
    assert {(r.feature_id, r.candidate_status) for r in I.select_disjoint(df, **I.FEW_PER_IMAGE).collect() if r.candidate_status != "LEFT"} == sequential_pick(cands)


def test_snapping_across_bands_of_latitude(spark):
    """Scales change at half degrees; a reference on the other side is still met."""
    from cadastre.operators.repair import snap_vertices

    points = spark.createDataFrame([(1, 1, 73.0, 18.499995), (1, 2, 73.0, 18.500005), (1, 3, 73.0, 18.6)], "imagery_id long, point_id long, lng double, lat double")
    refs = spark.createDataFrame([(1, 7, 73.0, 18.500005), (1, 8, 73.0, 18.499996)], "imagery_id long, ref_id long, lng double, lat double")
    got = {r["point_id"]: (r["snapped"], r["ref_id"]) for r in snap_vertices(points, refs, 1.5).collect()}
    assert got == {1: (True, 8), 2: (True, 7), 3: (False, None)}
    only = {r["point_id"]: r["snapped"] for r in snap_vertices(points, refs.where("ref_id = 7"), 1.5).collect()}
    assert only == {1: True, 2: True, 3: False}


def test_long_chain_of_decisions_settles(spark):
    from cadastre.operators.rounds import greedy_dropped

    pairs = spark.createDataFrame([(k, k + 1) for k in range(60)], "strong long, weak long")
    assert sorted(r["id"] for r in greedy_dropped(pairs).collect()) == list(range(1, 61, 2))


def test_salts_spread_one_hot_cell(spark):
    from pyspark.sql import functions as F

    from cadastre.operators.grid import _salted

    rows = spark.range(200).select(F.lit(1).alias("scope"), F.lit(2).alias("image"), "id")
    left, _, _ = _salted(rows, rows, 8)
    assert left.select("salt").distinct().count() == 8


def test_many_pairs_are_joined_by_sorting(spark, monkeypatch):
    """A checkpointed table keeps the small estimate of its files, so the count of pairs decides."""
    from cadastre.operators import rounds

    met = []
    monkeypatch.setattr(rounds, "joined_by_sorting", lambda df: met.append(df) or df.hint("merge"))
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    for limit, hinted in ((1000, False), (10, True)):
        monkeypatch.setattr(rounds, "MANY_PAIRS", limit)
        met.clear()
        assert {r.component for r in components(edges).collect()} == {0}
        assert bool(met) == hinted


def test_overlaps_are_counted_from_folded_rings(spark):
    """Counts equal the listed pairs, but copies of a ring build no pairs."""
    from cadastre.operators import joins as J

    box = lambda x, y, w, h: ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))
    shapes = [box(0, 0, 40, 40)] * 30 + [box(20, 20, 40, 40)] * 20 + [box(40, 0, 10, 10)] * 3 + [box(250, 250, 30, 30), box(500, 500, 9, 9)]
    rows = [(image % 2, image, 1000 * image + i, "image", s) for image in (1, 2, 3) for i, s in enumerate(shapes[: len(shapes) - image])]
    valid = spark.createDataFrame(rows, f"project_id long, imagery_id long, parcel_id long, mode string, clean {RING_TYPE}").repartition(5)
    listed = {r.project_id: r["count"] for r in J.parcel_overlaps(valid, with_center=False).groupBy("project_id").count().collect()}
    counted = {r.project_id: r.overlaps for r in J.overlap_counts(valid).collect()}
    one = 30 * 29 // 2 + 20 * 19 // 2 + 3 + 30 * 20
    assert counted == listed and listed[0] == one


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_lines_merge_in_growing_bands(spark, seed, monkeypatch):
    """Crowded ends are settled band by band: the same lines, from fewer pairs than all ends in reach make."""
    rnd = random.Random(seed)
    rows = {}
    for i in range(260):
        x, y, w, h = rnd.randrange(0, 160), rnd.randrange(0, 160), rnd.randrange(10, 40), rnd.randrange(5, 30)
        rows[i] = [(float(x), float(y)), (float(x + w), float(y)), (float(x + w), float(y + h))]
    df = spark.createDataFrame([(1, "ROAD", i, ring(*p)) for i, p in rows.items()], f"imagery_id int, detection_type string, feature_id long, pts {RING_TYPE}")
    built = []
    real = chains.matching
    monkeypatch.setattr(chains, "matching", lambda pairs: built.append(pairs.count()) or real(pairs))
    got = sorted((sorted(r.merged_ids), [(p.x, p.y) for p in r.pts]) for r in T.merge_collinear(df).collect())
    assert got == naive_chain(rows, 32.0, 25.0)
    assert len(built) > 1 and sum(built) < T.end_joints(T.line_ends(df), 32.0).count() / 2


@pytest.mark.parametrize("distance", [8.0, 20.0])
def test_crowds_keep_their_firsts_without_all_pairs(spark, distance, monkeypatch):
    rnd = random.Random(int(distance))
    places = sorted({(rnd.randrange(0, 90), rnd.randrange(0, 90)) for _ in range(1200)})
    rnd.shuffle(places)
    rows = [(1 + k % 2, k, float(x), float(y)) for k, (x, y) in enumerate(places)] + [(None, 5000, 1.0, 1.0), (None, 5001, 1.0, 2.0), (1, 5002, None, 3.0), (1, 5003, float("nan"), 3.0)]
    points = spark.createDataFrame(rows, "imagery_id int, feature_id long, px double, py double")
    kept = []
    for image, k, x, y in rows[:-4]:
        if not any(image == i and np.hypot(x - u, y - v) < distance for i, _, u, v in kept):
            kept.append((image, k, x, y))
    pairs = []
    real = T.greedy_dropped
    monkeypatch.setattr(T, "greedy_dropped", lambda p: pairs.append(p.count()) or real(p))
    got = sorted(r.feature_id for r in T.firsts_apart(points, ["imagery_id"], "feature_id", distance).collect())
    assert got == sorted(k for _, k, _, _ in kept) + [5000, 5001, 5002, 5003]
    assert pairs[0] < 4 * len(rows)
