"""Toxicity, hard negatives and centroid clustering against brute force, on small tables with awkward rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import centroids, hard_negatives, toxicity, vectors


@pytest.fixture(scope="module")
def awkward_vectors(spark):
    """Clusters, copies, ties, repeated ids, and rows with nulls, other lengths or non-finite components."""
    r = np.random.default_rng(5)
    middles = r.standard_normal((5, 64))
    rows = []
    for k in range(400):
        v = middles[k % 5] + 0.4 * r.standard_normal(64)
        rows.append((k, [float(x) for x in v / np.linalg.norm(v)], k % 3))
    copy = rows[0][1]
    rows += [(400 + k, copy, k % 3) for k in range(60)]  # equal vectors: ties
    rows += [(7, copy, 1), (50, copy, 2), (500, None, 1), (501, [], 1), (502, [0.1] * 63, 1), (503, [0.0] * 64, 2), (504, [float("nan")] + copy[1:], 1)]
    rows += [(505, [None] + copy[1:], 1), (506, [float("inf")] + copy[1:], 1), (550, copy, None), (None, copy, 1), (600, [-x for x in copy], 0)]
    return spark.createDataFrame([(*x, "k", 1) for x in rows], "vec_id long, embedding array<float>, label int, v string, cell int")


def plain_clusters(rows):
    kept = [(i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([v for _, v in kept], np.int64)
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"3:{kept[k][0]}".encode()).hexdigest()))
    c = x[order[:8]].copy()
    for _ in range(10):
        own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([x[own == k].sum(axis=0) // (own == k).sum() if (own == k).any() else c[k] for k in range(8)])
    far = ((x[:, None] - c) ** 2).sum(axis=2)
    own, d = far.argmin(axis=1), far.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in c.tolist()]
    return sorted(((str(kept[k][0]), int(own[k]), int(d[k]), int(d[own == own[k]].sum()), int(d.sum()), digest[own[k]]) for k in range(len(kept))))


@pytest.mark.parametrize("bits", [2, 8])
def test_clusters_equal_a_plain_scan(awkward_vectors, bits):
    got = centroids.cluster(awkward_vectors, bits=bits)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = plain_clusters([(r["vec_id"], r["embedding"]) for r in awkward_vectors.collect()])
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want


def test_clusters_of_few_or_no_vectors(spark, awkward_vectors):
    assert centroids.cluster(awkward_vectors.limit(0)).count() == 0
    few = centroids.cluster(awkward_vectors.where("vec_id in (1, 2, 3)")).collect()
    assert sorted(r["cluster"] for r in few) == [0, 1, 2] and all(r["inertia"] == 0 for r in few)
    with pytest.raises(Exception, match="component"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<float>")).collect()


def test_cells_leave_the_nearest_centroid_open():
    r = np.random.default_rng(2)
    x, c = r.integers(-900, 900, (500, 16)), r.integers(-500, 500, (6, 16))
    c[5] = c[1]  # ties
    for bits in (1, 4, 8):
        grid = centroids.Grid(x.min(axis=0), x.max(axis=0), bits)
        may = centroids.Intervals(grid, c).open(grid.cells(x))
        assert may[np.arange(len(x)), centroids.distances(x, c).argmin(axis=1)].all()
    assert may.sum(axis=1).mean() < 1.2


def plain_negatives(rows):
    used = [(i, l, np.array([int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0] * (64 - len(v)))) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, l, v in used:
        if i % 50:
            continue
        others = sorted((-int(v @ w), j, m) for j, m, w in used if j != i)
        for s, j, _ in [o for o in others if o[2] == l][:5]:
            hard = [o for o in others if o[2] != l and 50 * -s <= 100 * -o[0] <= 95 * -s][:3]
            out += [(i, j, k + 1, o[1], -s, -o[0]) for k, o in enumerate(hard)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(awkward_vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL", 8)  # many cells
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)  # hot cells in several chunks
    monkeypatch.setattr(hard_negatives, "BLOCK", 4)
    monkeypatch.setattr(hard_negatives, "FIRST", 2)
    got = hard_negatives.mine(awkward_vectors, F.col("vec_id") % 50 == 0)
    want = plain_negatives([(r["vec_id"], r["embedding"], r["label"]) for r in awkward_vectors.collect()])
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == want
    assert hard_negatives.mine(awkward_vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(awkward_vectors.where("vec_id = 50"), F.col("vec_id") % 50 == 0).count() == 0


def test_cells_come_by_falling_bound():
    r = np.random.default_rng(1)
    a, b = r.standard_normal(7), r.standard_normal(5)
    order = list(hard_negatives.in_order(a, b))
    assert len({(i, j) for _, i, j in order}) == 35
    assert [t for t, _, _ in order] == sorted((t for t, _, _ in order), reverse=True)


def test_relabelled(spark):
    rows = spark.createDataFrame([(7, [0.5], 9), (8, [0.5], 9), (14, [0.5], None)], "vec_id long, embedding array<float>, label int")
    assert [r["label"] for r in hard_negatives.relabelled(rows).orderBy("vec_id").collect()] == [0, 9, None]


def test_kernel_equals_its_definition():
    def features(s):
        out, s = {}, b"\0" + s + b"\0"
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    u = (s[i], s[j], s[k])
                    out[u] = out.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        n = sum(x * x for x in out.values()) ** 0.5
        return {u: x / n for u, x in out.items()}

    strings = [bytes(w) for w in ([1, 2, 3], [1, 2, 1, 2, 1], [9], [5, 5, 5, 5], [3, 2, 1, 9, 9, 27])]
    got = toxicity.kernel(strings, toxicity.landmark_table(strings))
    want = [[sum(x * features(b).get(u, 0) for u, x in features(a).items()) for b in strings] for a in strings]
    assert np.allclose(got, want, atol=1e-5)


def test_strings_of_a_text():
    assert toxicity.signs("Ídi.0t!") == toxicity.signs("idiot") and toxicity.signs("--") == []
    assert "idiot" in toxicity.words_of("so an x. i d i o t") or any("idiot" in w for w in toxicity.words_of("i d i o t"))
    assert all(len(s) == toxicity.LONG for s in toxicity.signs("a" * 48))


def insults_and_prose(n=400):
    r = random.Random(8)
    syllables = ["ba", "ren", "ti", "ous", "mel", "or", "fin", "da", "ke", "lu"]
    rows, labels = [], []
    for k in range(n):
        words = ["".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60))]
        bad = k % 4 == 0
        if bad:
            words.insert(r.randrange(len(words)), r.choice(["grumphead", "snoutface", "wazzock"]))
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(bad)))
    return rows, labels


def test_toxicity_finds_disguised_insults(spark):
    rows, labels = insults_and_prose()
    odd = [(1000, None), (1001, ""), (1002, " \n "), (1003, "12 !!"), (1004, "bamel " * 9000 + "wazz.ock"), (1005, "ren tida grumphxead lu"), (1006, "w a z z o c k"), (1007, "ren tida mellu"), (5, "ren"), (None, "tida ren")]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows + odd], "doc_id long, text string, y string, score double")
    known = spark.createDataFrame(labels + [(1000, 1), (1001, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.classify(docs, known)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    said = {r["doc_id"]: r["predicted"] for r in out}
    held = [(y, said[k]) for (k, y), h in zip(labels, [r["held_out"] for r in sorted(out, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) if r["doc_id"] is not None]) if h and k != 5]
    assert len(held) > 40 and sum(y == p for y, p in held) / len(held) > 0.95
    assert said[1004] == said[1005] == said[1006] == 1
    assert said[1000] == said[1001] == said[1002] == said[1003] == said[1007] == 0


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "ren tida")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.classify(docs, none).collect()] == [0.0]
    assert toxicity.classify(docs.limit(0), none).count() == 0


def test_integer_vectors_keep_their_rows():
    x = np.array([[1, -2, 3], [4, 5, -6]])
    assert (vectors.unpacked(vectors.packed(x, "<i2"), 3, "<i2") == x).all()
