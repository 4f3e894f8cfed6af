"""Hard negatives through an inverted multi-index over the two halves of a vector.

Each half has a codebook (means of a bounded sample of rows); a row lies in the cell of its two nearest
codewords, and every row is indexed. A codeword's radius is the largest distance of a row's half to it,
over all rows. For an anchor, half scores plus (length of the anchor's half) times radius bound the inner
product in a cell from above and below. A heap walks the cells by falling sum of the two half bounds
(multi-sequence order). An anchor stops when every window it still looks for is certified: no cell left can
hold a row that enters the window's list. Rows are reached in a few passes over growing parts of that order:
anchors ask for cells, cells are cut into chunks of bounded size and meet anchors in blocks, so neither a
hot cell nor the number of anchors makes one task large. Scores are exact integers.

First the walk finds an anchor's positives (no window, same label), then for each positive the window of
scores from ``low`` to ``high`` percent of its score, among rows of other labels. Ties go to the smaller id.

Rows with a null id, a null label, a null vector or a null or non-finite component take no part. Shorter
vectors count as padded with zeros. Rows of one id never meet each other; otherwise repeated rows are rows
of their own, and a repeated anchor gives its rows again. A component that reaches 2^27 after scaling, or
scores that would pass 2^53, raise an error. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from cadastre.llm.vectors import finite, matrix, packed, scaled, unpacked
from cadastre.session import cut_lineage

#: rows that the codebooks are fitted on, and the steps of fitting
SAMPLE = 4_096
STEPS = 8
#: rows a cell has on average, and bounds of the codewords of a half
CELL = 1_024
CODES = (2, 64)
#: rows of a chunk and anchors of a block that meet in one group
CHUNK = 4_096
BLOCK = 4_096
#: cells of the order that the first pass covers; each next one covers so many times more
FIRST = 8
GROWTH = 4
#: anchors scored in one matrix
STEP = 256

_PARTIAL = "aid long, w int, score long, id long"


@dataclass
class Index:
    """Codebooks of both halves, their radii, and the number of rows in each occupied cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: dict[int, int]
    dim: int
    kind: str

    def bounds(self, a: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half: bounds of the half score for each codeword, from above and from below."""
        cut = len(self.books[0][0])
        out = []
        for book, radius, half in zip(self.books, self.radii, (a[:cut], a[cut:])):
            middle = book @ half
            slack = np.linalg.norm(half) * radius + 1e-9 * np.abs(middle) + 1e-3  # float rounding never hides a row
            out.append((middle + slack, middle - slack))
        return out


def in_order(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs of positions by falling sum, with a heap (multi-sequence)."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def _book(x: np.ndarray, codes: int) -> np.ndarray:
    """Means of ``codes`` groups at most, from a spread start."""
    start = np.unique(x, axis=0)
    book = start[np.linspace(0, len(start) - 1, min(codes, len(start))).astype(int)].astype(np.float64)
    for _ in range(STEPS):
        own = ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)
        for c in np.unique(own):
            book[c] = x[own == c].mean(axis=0)
    return book


def _index(rows: DataFrame, dim: int, kind: str, count: int) -> tuple[Index, DataFrame]:
    """The index and its rows (rid, id, label, v, cell)."""
    sample = rows.select("v", F.xxhash64("id").alias("h"), "rid").orderBy("h", "rid").limit(SAMPLE).select("v").collect()
    x = np.frombuffer(b"".join(bytes(r["v"]) for r in sample), kind).reshape(len(sample), dim).astype(np.float64)
    codes, cut = int(min(CODES[1], max(CODES[0], round((count / CELL) ** 0.5)))), max(1, dim // 2)
    books = (_book(x[:, :cut], codes), _book(x[:, cut:], codes))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(batch.column(3), dim, kind).astype(np.float64)
            own, far = [], []
            for book, half in zip(books, (x[:, :cut], x[:, cut:])):
                nearest = ((book**2).sum(axis=1) - 2 * half @ book.T).argmin(axis=1)
                own.append(nearest)
                far.append(np.linalg.norm(half - book[nearest], axis=1))
            cell = own[0] * len(books[1]) + own[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[0]), pa.array(far[1])], names=["rid", "id", "label", "v", "cell", "f0", "f1"])

    placed = cut_lineage(rows.mapInArrow(place, "rid long, id long, label long, v binary, cell int, f0 double, f1 double"))
    wide = len(books[1])
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("f0").alias("f0"), F.max("f1").alias("f1")).collect()  # a row for each of at most CODES[1] ** 2 cells
    radii = tuple(np.zeros(len(b)) for b in books)
    for r in found:
        for radius, at, far in ((radii[0], r["cell"] // wide, r["f0"]), (radii[1], r["cell"] % wide, r["f1"])):
            radius[at] = max(radius[at], far * (1 + 1e-9))
    return Index(books, radii, {r["cell"]: r["n"] for r in found}, dim, kind), placed.drop("f0", "f1")


def _asked(active: DataFrame, index: Index, start: int, stop: int) -> DataFrame:
    """(cell, anchor) for the cells from ``start`` to ``stop`` of each anchor's order that it still needs.

    ``active`` has the windows (w, lo, hi) of an anchor and, in ``held``, the last score of full lists.
    """
    wide = len(index.books[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[int] = []
            rows: list[int] = []
            vectors = unpacked(batch.column(1), index.dim, index.kind).astype(np.float64)
            for k, (windows, held) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                full = {h["w"]: h["score"] for h in held or ()}
                wanted = [(max(w["lo"], full.get(w["w"], w["lo"])), w["hi"]) for w in windows or () if w["lo"] <= w["hi"]]
                if not wanted:
                    continue
                least = min(lo for lo, _ in wanted)
                (up0, down0), (up1, down1) = index.bounds(vectors[k])
                for position, (bound, i, j) in enumerate(in_order(up0, up1)):
                    if bound < least or position >= stop:
                        break  # what follows is bounded lower: certified, or left to the next pass
                    below = down0[i] + down1[j]
                    if position >= start and i * wide + j in index.rows and any(bound >= lo and below <= hi for lo, hi in wanted):
                        cells.append(i * wide + j)
                        rows.append(k)
            yield pa.record_batch([pa.array(cells, pa.int32()), batch.column(0).take(pa.array(rows, pa.int64()))], ["cell", "aid"])

    return active.select("aid", "v", "windows", "held").mapInArrow(run, "cell int, aid long")


def _group(key: tuple, anchors: pa.Table, rows: pa.Table, index: Index, same: bool, wanted: int) -> pa.Table:
    """Best rows of one chunk for the windows of one block of anchors, at most ``wanted`` each."""
    rows = rows.take(pa.array(np.argsort(rows["id"].to_numpy(), kind="stable")))  # ties then come by id
    x = unpacked(rows["v"].combine_chunks(), index.dim, index.kind).astype(np.float64)
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    out: list[tuple] = []
    for a in range(0, anchors.num_rows, STEP):
        part = anchors.slice(a, STEP)
        scores = unpacked(part["v"].combine_chunks(), index.dim, index.kind).astype(np.float64) @ x.T
        allowed = (part["label"].to_numpy()[:, None] == labels) == same
        allowed &= part["id"].to_numpy()[:, None] != ids
        windows = part["windows"].to_pylist()
        held = [{h["w"]: h["score"] for h in hs or ()} for hs in part["held"].to_pylist()]
        aids = part["aid"].to_numpy()
        for at in range(max((len(w) for w in windows), default=0)):
            own = [(w[at]["w"], w[at]["lo"], w[at]["hi"]) if at < len(w) else (0, 1, 0) for w in windows]
            lo = np.array([max(l, held[k].get(w, l)) for k, (w, l, _) in enumerate(own)], np.float64)
            hi = np.array([h for _, _, h in own], np.float64)
            value = np.where(allowed & (scores >= lo[:, None]) & (scores <= hi[:, None]), scores, -np.inf)
            last = np.partition(value, -wanted, axis=1)[:, -wanted] if value.shape[1] > wanted else np.full(len(value), -np.inf)
            r, c = np.nonzero((value >= last[:, None]) & (value > -np.inf))
            order = np.lexsort((c, -value[r, c], r))
            r, c = r[order], c[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            r, c = r[rank < wanted], c[rank < wanted]
            w = np.array([o[0] for o in own])
            out.append((aids[r], w[r], value[r, c].astype(np.int64), ids[c]))
    aid, w, score, found = (np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"aid": pa.array(aid, pa.int64()), "w": pa.array(w, pa.int32()), "score": pa.array(score, pa.int64()), "id": pa.array(found, pa.int64())})


def _walk(anchors: DataFrame, placed: DataFrame, index: Index, *, same: bool, wanted: int, number: int) -> DataFrame:
    """(aid, w, rank, score, id): the first ``wanted`` rows of each window of each of ``number`` anchors.

    ``anchors`` has aid, id, label, v and ``windows``: array of (w, lo, hi).
    """
    spark = anchors.sparkSession
    blocks = -(-number // BLOCK)
    sizes = F.broadcast(spark.createDataFrame([(c, -(-n // CHUNK)) for c, n in index.rows.items()], "cell int, chunks int"))
    chunked = placed.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks").cast("int")).drop("chunks", "rid")
    order = Window.partitionBy("aid", "w").orderBy(F.desc("score"), "id")
    best = spark.createDataFrame([], f"{_PARTIAL}, rank int")
    start, stop, cells = 0, FIRST, len(index.books[0]) * len(index.books[1])
    while start < cells:
        held = best.where(F.col("rank") == wanted).groupBy("aid").agg(F.collect_list(F.struct("w", "score")).alias("held"))  # one for each window
        active = anchors.join(held, "aid", "left").withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int"))
        asked = cut_lineage(_asked(active, index, start, stop))
        start, stop = stop, stop * GROWTH
        if asked.isEmpty():
            # certified anchors ask for nothing; others may only skip cells that their windows don't reach
            continue
        asking = active.join(asked, "aid").join(sizes, "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        meeting = asking.select("cell", "block").distinct()  # at most a row for each cell and block
        rows = chunked.join(meeting, "cell").select("id", "label", "v", F.col("cell").alias("c"), F.col("chunk").alias("k"), F.col("block").alias("b"))
        pairs = asking.groupBy("cell", "chunk", "block").cogroup(rows.groupBy("c", "k", "b"))
        found = pairs.applyInArrow(lambda key, a, r: _group(key, a, r, index, same, wanted), _PARTIAL)
        both = best.select("aid", "w", "score", "id").unionByName(found)
        best = cut_lineage(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted))
    return best


def mine(vectors: DataFrame, anchor: Column, *, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each anchor (rows where ``anchor`` holds) and positive: its first ``negatives`` hard negatives.

    A negative's score n and the positive's score p satisfy low * p <= 100 * n <= high * p.
    """
    name = F.col(label).cast("long") if isinstance(vectors.schema[label].dataType, IntegralType) else F.xxhash64(label)
    used = vectors.where(finite(vector) & F.col(label).isNotNull() & F.col(key).isNotNull())
    used = used.select(F.col(key).cast("long").alias("id"), name.alias("label"), scaled(vector, scale).alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
    size = used.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.count("*").alias("n"), F.count_if("asks").alias("anchors")).first()
    spark, dim, most = vectors.sparkSession, size["dim"] or 0, size["most"] or 0
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size["anchors"]:
        return spark.createDataFrame([], names)
    dim = max(2, dim)
    if dim * most * most >= 1 << 53:
        raise ValueError("scores would pass 2^53")
    kind = "<i2" if most < 1 << 15 else "<i4"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns[:3], packed(matrix(batch.column(3), dim), kind)], ["id", "label", "asks", "v"])

    padded = used.select("id", "label", "asks", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    rows = cut_lineage(padded.mapInArrow(pack, "id long, label long, asks boolean, v binary").withColumn("rid", F.monotonically_increasing_id()))
    index, placed = _index(rows.select("rid", "id", "label", "v"), dim, kind, size["n"])
    anchors = rows.where("asks").select(F.col("rid").alias("aid"), "id", "label", "v")
    limit = 1 << 53
    everything = F.array(F.struct(F.lit(0).alias("w"), F.lit(-limit).alias("lo"), F.lit(limit).alias("hi")))
    first = _walk(anchors.withColumn("windows", everything), placed, index, same=True, wanted=positives, number=size["anchors"])
    # whole numbers n with low * p <= 100 n <= high * p
    lo, hi = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100L)) div 100)"), F.expr(f"({high} * score - pmod({high} * score, 100L)) div 100")
    windows = first.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("w"), lo.alias("lo"), hi.alias("hi")))).alias("windows"))  # one for each positive
    second = _walk(cut_lineage(anchors.join(windows, "aid")), placed, index, same=False, wanted=negatives, number=size["anchors"])
    positive = first.select("aid", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = second.select("aid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(positive, ["aid", "w"])
    named = out.join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """The rows with the label of every seventh id moved to the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", "embedding", moved.alias("label"))


ORACLE = """with r as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from r a join r b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as materialized (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
n as (
  select p.a, p.b as p, p.score as ps, s.b as n, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as k
  from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, p as positive_id, cast(k as int) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where k <= 3"""
