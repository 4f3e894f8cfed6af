"""Operators of the training-data subpackage against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from cadastre.llm import decontaminate, embeddings, jaccard, language, licenses, packing, pii, quality, sharding, tokens

WORDS = [f"{a}{b}" for a in "bcdfghklmnprstvw" for b in ("a", "el", "ion", "or", "ut")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns that clash with inner names."""
    base = prose(1, 120)
    near = " ".join(["changed", *base.split()[1:]])
    rows = [
        (1, base, "aa"), (2, base, "aa"), (2, base, "aa"), (3, near, "aa"), (4, prose(2, 90), "bb"), (5, None, "aa"), (6, "", None), (7, "   ", "bb"), (8, "12 34 !!", "bb"),
        (9, prose(3, 30_000), "aa"), (10, "one two", "bb"), (11, "One  TWO", "aa"), (12, prose(4, 60), None), (None, prose(5, 40), "aa"), (13, "x" * 50_000, "bb"),
    ]
    return spark.createDataFrame([(*r, "k", 7, "t", "h", "id") for r in rows], "doc_id long, text string, lang string, k string, d int, t string, h string, id string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def as_rows(df):
    return [tuple(r) for r in df.collect()]


def test_token_counts(spark, awkward, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary())
    got = tokens.count_tokens(awkward)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(own.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert tokens.count_tokens(nothing).count() == 0


def test_pieces_equal_the_tokenizer():
    pieces = tokens.Pieces(tokens.vocabulary(), packing.as_bytes)
    parts = ["a", "Ab", "'s", " ", "  ", "\n", "\t", " \n", "\x1c", "1", "23", "é", "中", "!!", "<|endoftext|>", "😀", "́", "\x00", "\x85", " ", "_", "word"]
    r = random.Random(1)
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        want = pieces.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(next(pieces.of([text]))), "<u4").tolist() == want
        if (direct := pieces.ids(text)) is not None:
            assert direct.tolist() == want


def test_packing_round_trip(spark, awkward, nothing):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokens.vocabulary())
    rows = packing.pack_documents(awkward).collect()
    texts = [(r["doc_id"], own.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in awkward.collect()]
    want = []
    for doc_id, ids in texts:
        start, stop, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want.append((str(doc_id), piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, piece = stop, stop + 1024, piece + 1
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024
    assert packing.pack_documents(nothing).count() == 0


def test_best_two_fit_uses_every_piece_once():
    r = random.Random(3)
    counts = {n: r.randint(1, 20) for n in r.sample(range(1, 1025), 300)}
    bins = packing.best_two_fit(counts)
    used = {}
    for lengths, times in bins:
        assert sum(lengths) <= 1024
        for n in lengths:
            used[n] = used.get(n, 0) + times
    assert used == counts
    gaps: list[int] = []  # best fit, longest first
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(1024 - n)
    assert sum(t for _, t in bins) <= len(gaps)
    # the smallest piece gives way to two that fit more tightly
    assert ([600, 220, 204], 1) in packing.best_two_fit({600: 1, 300: 1, 220: 1, 204: 1})


def components_by_hand(rows, words, percent):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(root(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def similar(df, words, percent):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_groups(df, words=words, percent=percent).collect())


@pytest.mark.parametrize("words, percent", [(4, 85), (5, 80)])
def test_jaccard_join(spark, awkward, nothing, words, percent):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert similar(awkward, words, percent) == components_by_hand(rows, words, percent)
    assert jaccard.similar_groups(nothing, words=words, percent=percent).count() == 0


def test_jaccard_regions_and_tiles(spark, monkeypatch):
    """Groups of near copies that exceed a task's limits are cut and tiled without losing a link."""
    r = random.Random(5)
    rows = []
    for g in range(3):
        base = prose(100 + g, 80).split()
        for _ in range(30):
            text = [w if r.random() > 0.03 * r.randint(0, 2) else "new%d" % r.randint(0, 99) for w in base]
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "REGION_SETS", 8)
    assert similar(df, 4, 85) == components_by_hand(rows, 4, 85)


def test_language(spark, awkward, nothing):
    rows = [(k, f"{'der die und' if k % 2 else 'the and of'} {'ungen schaft' if k % 2 else 'tion ness'} " * 5, "de" if k % 2 else "en") for k in range(60)]
    docs = spark.createDataFrame([*rows, (100, None, "en"), (101, "123 !!", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.predict(docs).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows)
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (100, 101))
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for k, r in got.items())
    assert language.predict(awkward).count() == awkward.count()
    assert language.predict(nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang <> ''")).collect()} == set()


def luhn(d):
    return sum(v - 9 * (v > 9) for v in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0


def personal(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([ -]?[0-9])+"), ("phone", r"\+[0-9][ ().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark, awkward, nothing):
    r = random.Random(3)
    parts = [*"0123456789" * 2, " ", "-", ".", "+", "(", ")", "@", "a", "b.c", "x@y.z", "😀", "é", "\n", "4111111111111111", "+1 (017) 555-7713", "1.2.3.4", "999.1.1.1", "0005.1.2.3", "_"]
    rows = [(k, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for k in range(600)] + [(-1, None), (-2, "a" * 50_000), (-3, "1 " * 9_000), (-4, "1." * 9_000), (-5, "a@b" * 9_000), (-6, "1" * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for row in pii.find(docs).collect():
        want = personal(dict(rows)[row["doc_id"]] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k) for w in want) for k in pii.KINDS]
        assert set(want) <= set(row["spans"].split(",")) | {""}
    assert pii.find(awkward).count() == awkward.count()
    assert pii.find(nothing).count() == 0
    text = spark.createDataFrame([(1, "mail me: joe@example.com or +1 (017) 555-7713 now"), (2, None)], "doc_id long, text string")
    assert sorted(as_rows(pii.mask(text))) == [(1, "mail me: <email> or <phone> now"), (2, None)]


def test_added_spans(spark):
    """Loose spans after cues are added, decoys and wrong cards are not."""
    r = random.Random(5)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    area = lambda: r.choice("23456789") + digits(2)
    rows, want, decoys = [], {}, {}

    def plant(into, kind, before, span, after=" and so on"):
        k = len(rows)
        text = f"words about nothing much {before} {span}{after}"
        rows.append((k, text))
        into[k] = f"{kind}:{text.index(span)}:{text.index(span) + len(span)}"

    for i in range(60):
        rows.append((len(rows), f"some text +1 ({area()}) 555-{digits(4)} and mail{i}@example.com go on"))
        plant(want, "phone", r.choice(["call me at", "my phone is", "tel."]), r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(area(), area(), digits(4)))
        plant(want, "email", r.choice(["write to", "contact"]), f"name{i} [at] example [dot] com")
        plant(decoys, "phone", r.choice(["order", "serial number", "invoice", "ticket"]), f"{r.choice('01')}{digits(2)}-{area()}-{digits(4)}")
        card = "4" + digits(15)
        while luhn(card):
            card = "4" + digits(15)
        plant(decoys, "card", r.choice(["", "order", "my card"]), card)
        good = "5" + digits(14)
        rows.append((len(rows), "paid with " + next(good + c for c in "0123456789" if luhn(good + c))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["spans"].split(",") for x in pii.find(docs).collect()}
    assert sum(s in got[k] for k, s in want.items()) >= 0.95 * len(want)
    assert sum(s in got[k] for k, s in decoys.items()) == 0
    each = pii.spans(pii.candidates(docs))
    scored = each.withColumn("p", pii.train(each).probability())
    assert scored.where("kind = 2 and broken = 1").agg({"p": "max"}).first()[0] < 0.5


def test_labelers_that_abstain_say_nothing():
    patterns = [((1, 1, 1, 0), 90), ((-1, 1, 1, 0), 30), ((0, 1, 1, 1), 20), ((0, 1, -1, -1), 20)]
    prior, tables, post = pii.reliabilities(patterns)
    assert post[0] > 0.95 and post[1] < 0.1 and post[2] > 0.9 and post[3] < 0.1
    assert tables[2][1][0] > tables[2][1][1] and 0.3 < prior[0] < 0.7


def test_shards(spark, awkward, nothing):
    limit = 2_000
    rows = sharding.assign(awkward, limit=limit).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    names = sorted(by)
    for name, own in by.items():
        assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] and len(own) == own[0]["shard_docs"]
        assert own[0]["shard_bytes"] <= limit or len(own) == 1
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.assign(nothing).count() == 0
    many = spark.createDataFrame([(1, "x" * 100)] * 50, "doc_id long, text string")
    assert max(r["shard_bytes"] for r in sharding.assign(many, limit=500).collect()) <= 500
    assert sharding.directory(sharding.assign(many, limit=500)).count() >= 10


def test_embeddings(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((40, 16))
    x = np.concatenate([base, base[:10] + 0.1 * r.standard_normal((10, 16)), np.repeat(base[:1], 30, axis=0), base[1:2] * 3])
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [None] + [1.0] * 15), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {row["vec_id"]: row for row in embeddings.near_copies(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = sum(got[k]["n_links"] for k in range(len(x)))
    assert found >= 0.9 * links.sum() and all(got[k]["n_links"] <= links[k].sum() for k in range(len(x)))
    assert all(got[k]["component_id"] == 0 and got[k]["kept"] == (k == 0) for k in [0, *range(50, 80)])
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 905))
    assert got[905]["component_id"] == got[906]["component_id"] == 905
    assert embeddings.near_copies(df.where("vec_id < 0")).count() == 0


def test_licenses(spark, awkward, nothing):
    notice, permission = licenses.TEMPLATES["MIT notice"], licenses.TEMPLATES["MIT permission"]
    changed = permission.replace("modify", "alter", 1)
    docs = spark.createDataFrame([(1, f"{prose(1, 40)} {notice} {prose(2, 300)}"), (2, f"{prose(3, 500)}\n{changed}\n{prose(4, 77)}"), (3, prose(5, 900)), (4, None), (5, " ".join(permission.split()[:20]))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license"], r["containment"] == 1) for r in licenses.scan(docs).collect()) == [(1, "MIT notice", True), (2, "MIT permission", False)]
    assert licenses.scan(awkward).count() == 0 and licenses.scan(nothing).count() == 0


def test_quality(spark, awkward, nothing):
    rows = [(k, " ".join(w + ("!! ###" if k % 3 == 0 else "") for w in prose(k, 50).split())) for k in range(240)]
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows] + [(1000, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    held = [k for k, _ in rows if got[k]["held_out"]]
    assert held and sum(got[k]["predicted"] == (k % 3 > 0) for k in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["score"] for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels.where("doc_id < 0")).count() == 0


def test_sum_of_squares_identity():
    r = np.random.default_rng(2)
    m = quality.Machine(0.3, r.standard_normal(6), r.standard_normal((6, 3)))
    x = r.standard_normal((4, 6))
    pairs = [sum((m.factors[i] @ m.factors[j]) * v[i] * v[j] for i in range(6) for j in range(i)) for v in x]
    assert np.allclose(m.logit(x), 0.3 + x @ m.weights + pairs)


def test_decontamination(spark, awkward, nothing):
    items = [(k, prose(500 + k, 20 + k) + ". " + prose(700 + k, 8) + ".") for k in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, "..")], "item_id long, text string")
    reworded = items[3][1].split()
    reworded[4] = reworded[11] = "other"
    rows = [(1, f"{prose(1, 200)} {items[0][1]} {prose(2, 100)}"), (2, prose(3, 400)), (3, f"{prose(4, 33)} {' '.join(reworded)}"), (4, items[29][1]), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, bench).collect()) == [(1, 0), (3, 3), (4, 29)]
    assert sorted(r["doc_id"] for r in decontaminate.remove(docs, bench).collect()) == [2, 5, 6]
    assert decontaminate.remove(awkward, bench).count() == awkward.count()
    assert decontaminate.search(nothing, bench).count() == 0 and decontaminate.search(docs, bench.limit(0)).count() == 0
    assert decontaminate.subsequence(list("abcbdab"), list("bdcaba")) == 4


def reworded_plants(items, keep, seed, hosts):
    """(doc_id, item_id, text): each item between other words, words replaced at random, those that still pass the sequence check."""
    r = random.Random(seed)
    out = []
    for item_id, text in items:
        item = decontaminate.parse(item_id, text)
        new = [w if r.random() < keep else f"new{r.randint(0, 9999)}".encode() for w in item.words]
        if decontaminate.subsequence(item.words, new) >= 0.6 * len(item.words) and decontaminate.subsequence(item.answer, new) >= 0.5 * len(item.answer):
            host = hosts(r)
            at = r.randint(0, len(host))
            out.append((len(out), item_id, " ".join([*host[:at], b" ".join(new).decode(), *host[at:]])))
    return out


def test_decontamination_finds_common_words(spark):
    """Copies that keep only the commonest words of an item pass the sequence check at a small cosine."""
    r = random.Random(11)
    common = WORDS[:40]
    items = []
    for k in range(40):
        kept = [r.choice(common) for _ in range(16)]
        rare = {a: f"rare{k}x{a}" for a in r.sample(range(16), 5)}
        words = [rare.get(a, w) for a, w in enumerate(kept)]
        items.append((k, " ".join(words), " ".join(f"other{k}x{a}" if a in rare else w for a, w in enumerate(words))))
    docs = [(k, f"{prose(k, 60)} {changed} {prose(100 + k, 60)}") for k, _, changed in items] + [(1000 + k, " ".join(r.choice(common) for _ in range(40))) for k in range(300)]
    bench = spark.createDataFrame([(k, text) for k, text, _ in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(k, k) for k in range(40)} <= got
    words = {k: decontaminate.plain_words(t.encode()) for k, t in docs}
    assert all(decontaminate.subsequence(decontaminate.plain_words(items[i][1].encode()), words[d]) >= 0.6 * 16 for d, i in got)


def test_decontamination_does_not_depend_on_the_size_of_the_benchmark(spark):
    """Items of a benchmark of well over a block, verbatim and reworded, are found with the cosines of a small one."""
    r = random.Random(12)
    pool = [a + b for a in WORDS for b in WORDS[:20]]
    weights = [1 / (k + 8) for k in range(len(pool))]
    items = [(k, " ".join(r.choices(pool, weights, k=r.randint(15, 40))) + ". " + " ".join(r.choices(pool, weights, k=6))) for k in range(450)]
    schema = "doc_id long, text string"
    verbatim = spark.createDataFrame(items[:400], schema)

    def cosines(n):
        bench = spark.createDataFrame(items[:n], "item_id long, text string")
        return {r["doc_id"]: r["cosine"] for r in decontaminate.search(verbatim, bench).collect() if r["doc_id"] == r["item_id"]}

    few, many = cosines(40), cosines(450)
    assert len(many) == 400 and max(abs(many[k] - few[k]) for k in range(40)) < 0.03
    plants = [p for seed, keep in enumerate((0.62, 0.7, 0.8)) for p in reworded_plants(items, keep, seed, lambda r: r.choices(pool, weights, k=140))]
    docs = spark.createDataFrame([(k, text) for k, (_, _, text) in enumerate(plants)], schema)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.search(docs, bench).collect()}
    missed = [k for k, (_, item, _) in enumerate(plants) if (k, item) not in got]
    print(len(plants), "plants, missed", len(missed))
    assert not missed


def test_pipeline_on_awkward_rows(spark, awkward, small):
    import corpus_pipeline

    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = sorted(str(r["doc_id"]) for r in docs.collect())
    assert {"1", "4", "9", "12"} <= set(kept) and not {"2", "3", "5", "6", "7", "8"} & set(kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= len(kept)
