"""Centroid clustering in Lloyd's rounds through a vector-approximation file.

A vector is kept twice: whole, and as one cell of ``bits`` bits per dimension between the least and the
largest component there. A round reads the cells only. Lookup tables give, for each dimension and cell,
the least and the largest squared distance to a centroid; their sums are an interval per centroid. Where
intervals overlap, a second table bounds the difference of two distances, which is linear in the vector
and so much narrower. Whole vectors are fetched by row number for the rows that stay undecided, and
for those that change their centroid: centroid sums are carried from round to round and corrected by
the rows that moved. All arithmetic is on integers, so the clusters equal those of a plain scan.

Kept are vectors of exactly ``dim`` components, none null or non-finite; other rows give none. A component
that reaches 2^27 after scaling raises an error. Ties go to the smaller centroid. Equal vectors and
repeated ids are rows of their own. Fewer than ``k`` kept vectors make as many centroids, an empty table
gives no rows. A null id is kept but starts a centroid only after all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadastre.llm.text import broadcast_if_small
from cadastre.llm.vectors import finite, matrix, packed, scaled, unpacked
from cadastre.session import cut_lineage

#: bits of a cell; about 0.97 of random unit vectors of 64 dimensions stay undecided at 4, half at 6
BITS = 8
#: undecided rows that are broadcast, some 200 bytes each; more are joined by a shuffle
FETCHED = 200_000
#: rows whose lookups are summed in one step
STEP = 4_096


@dataclass
class Grid:
    """Cells of equal width per dimension: ``low`` is the least component, ``high`` the largest."""

    low: np.ndarray
    high: np.ndarray
    bits: int

    def __post_init__(self):
        self.width = -(-(self.high - self.low + 1) // (1 << self.bits))
        first = self.low[:, None] + np.arange(1 << self.bits) * self.width[:, None]
        self.first = np.minimum(first, self.high[:, None])
        self.last = np.minimum(first + self.width[:, None] - 1, self.high[:, None])

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.width).astype(np.uint8)


class Intervals:
    """Lookup tables of a round: distance intervals per centroid, bounds of differences of two."""

    def __init__(self, grid: Grid, centroids: np.ndarray):
        self.grid, self.centroids = grid, centroids
        self.at = np.arange(len(grid.low)) * (1 << grid.bits)
        below, above = grid.first - centroids[:, :, None], grid.last - centroids[:, :, None]
        self.most = np.maximum(below * below, above * above).reshape(len(centroids), -1)
        self.least = np.where((below <= 0) & (above >= 0), 0, np.minimum(below * below, above * above)).reshape(len(centroids), -1)

    def gap(self, near: int, far: int) -> np.ndarray:
        """Table of the least share of each cell in: distance to ``far`` minus distance to ``near``."""
        a, b = self.centroids[near], self.centroids[far]
        slope = 2 * (a - b)[:, None]
        return (np.minimum(self.grid.first * slope, self.grid.last * slope) + (b * b - a * a)[:, None]).ravel()

    def open(self, cells: np.ndarray) -> np.ndarray:
        """Per row and centroid, whether it may be the nearest one (ties to the smaller number)."""
        k = len(self.centroids)
        at = cells.astype(np.int64) + self.at
        least = np.stack([t.take(at).sum(axis=1) for t in self.least], axis=1)
        most = np.stack([t.take(at).sum(axis=1) for t in self.most], axis=1)
        best = most.argmin(axis=1)
        bound = most[np.arange(len(at)), best][:, None]
        number = np.arange(k)
        may = (least < bound) | ((least == bound) & (number < best[:, None]))
        may[np.arange(len(at)), best] = True
        for b in range(k):
            for c in range(k):
                rows = np.flatnonzero((best == b) & may[:, c]) if b != c else ()
                if len(rows):
                    gap = self.gap(b, c).take(at[rows]).sum(axis=1)
                    may[rows[(gap > 0) | ((gap == 0) & (c > b))], c] = False
        return may


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _grid(vectors: DataFrame, dim: int, bits: int) -> Grid | None:
    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column(0), dim)
                yield pa.record_batch([pa.array(range(dim), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["d", "low", "high"])

    found = vectors.select("v").mapInArrow(extremes, "d int, low long, high long").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return Grid(np.array([r["low"] for r in found]), np.array([r["high"] for r in found]), bits) if found else None


def _judged(state: DataFrame, grid: Grid, centroids: np.ndarray) -> DataFrame:
    """(rid, cells, old, new, may): new is -1 and ``may`` a bit per centroid where cells don't decide."""
    bit = np.int64(1) << np.arange(len(centroids), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Intervals(grid, centroids)
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                may = tables.open(unpacked(part.column(1), len(grid.low), "u1"))
                new = np.where(may.sum(axis=1) == 1, may.argmax(axis=1), -1)
                yield pa.record_batch([*part.columns, pa.array(new, pa.int32()), pa.array((may * bit).sum(axis=1), pa.int64())], ["rid", "cells", "old", "new", "may"])

    return state.mapInArrow(run, "rid long, cells binary, old int, new int, may long")


def _settled(need: DataFrame, vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows of ``need`` with their exact nearest centroid; ``v`` only where that changes."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, STEP):
                part = batch.slice(a, STEP)
                old, may = part.column(2).to_numpy(), part.column(3).to_numpy()
                exact = distances(unpacked(part.column(4), dim), centroids)
                exact[(may[:, None] >> np.arange(len(centroids))) & 1 == 0] = np.iinfo(np.int64).max
                new = exact.argmin(axis=1)
                v = [x if moved else None for x, moved in zip(part.column(4).to_pylist(), (new != old).tolist())]
                yield pa.record_batch([*part.columns[:3], pa.array(new, pa.int32()), pa.array(v, pa.binary())], ["rid", "cells", "old", "new", "v"])

    joined = broadcast_if_small(need, FETCHED).join(vectors.select("rid", "v"), "rid")
    return joined.select("rid", "cells", "old", "may", "v").mapInArrow(run, "rid long, cells binary, old int, new int, v binary")


def _moves(settled: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """What moved rows add to the count and the component sums of each centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = np.pad(unpacked(batch.column(2), dim), ((0, 0), (1, 0)), constant_values=1)
            old, new = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            np.add.at(total, new, x)
            np.subtract.at(total, old[old >= 0], x[old >= 0])
        c, d = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d])], ["c", "d", "s"])

    parts = settled.where("old <> new").select("old", "new", "v").mapInArrow(run, "c int, d int, s long").groupBy("c", "d").agg(F.sum("s").alias("s"))
    total = np.zeros((k, dim + 1), np.int64)
    for r in parts.collect():  # at most k * (dim + 1) rows
        total[r["c"], r["d"]] = r["s"]
    return total[:, 0], total[:, 1:]


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:", bits: int = BITS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per kept vector: cluster, squared distance, inertia of its cluster and of all, centroid digest.

    The first centroids are the ``k`` vectors (62 at most) with the smallest sha256 of ``seed`` and id.
    """
    if not 1 <= k <= 62 or not 1 <= bits <= 8:
        raise ValueError("k is 1 to 62 and bits 1 to 8")
    kind = vectors.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), packed(matrix(batch.column(1), dim))], ["id", "v"])

    sized = vectors.where(finite(vector) & (F.size(vector) == dim)).select(F.col(key).alias("id"), scaled(vector, scale).alias("v"))
    whole = cut_lineage(sized.mapInArrow(pack, f"id {kind}, v binary").withColumn("rid", F.monotonically_increasing_id()))
    digest = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = whole.select("v", digest.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([np.frombuffer(bytes(r["v"]), "<i4") for r in first], np.int64).reshape(len(first), dim)
    sums, counts = np.zeros_like(centroids), np.zeros(len(first), np.int64)
    grid = _grid(whole, dim, bits)
    parts = whole.rdd.getNumPartitions()
    kept = whole.select("rid", "v")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), packed(grid.cells(unpacked(batch.column(1), dim)), "u1")], ["rid", "cells"])

    state = cut_lineage(kept.mapInArrow(approximate, "rid long, cells binary").withColumn("old", F.lit(-1)))
    for step in range(rounds + 1 if grid else 0):
        judged = cut_lineage(_judged(state, grid, centroids))
        settled = cut_lineage(_settled(judged.where("new < 0 or new <> old").drop("new"), kept, centroids))
        stay = judged.where("new >= 0 and new = old").select("rid", "cells", "old")
        state = stay.unionByName(settled.select("rid", "cells", F.col("new").alias("old"))).coalesce(max(1, parts))
        if step < rounds:
            more, added = _moves(settled, *centroids.shape)
            if not more.any() and not added.any():
                break  # nothing moved, so no later round differs
            counts, sums = counts + more, sums + added
            filled = counts > 0
            centroids = np.where(filled[:, None], sums // np.maximum(counts, 1)[:, None], centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(1).to_numpy()
            far = ((unpacked(batch.column(2), dim) - centroids[own]) ** 2).sum(axis=1) if len(own) else np.zeros(0, np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    joined = state.select("rid", F.col("old").alias("cluster")).join(whole, "rid").select("id", "cluster", "v")
    measured = cut_lineage(joined.mapInArrow(measure, f"id {kind}, cluster int, distance long"))
    of_cluster = {r["cluster"]: r["s"] for r in measured.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    spark = vectors.sparkSession
    named = spark.createDataFrame([(c, of_cluster.get(c, 0), sum(of_cluster.values()), digests[c]) for c in range(len(digests))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = measured.join(F.broadcast(named), "cluster")
    return out.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10) -> str:
    apart = "cast(list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint)"
    text = f"""with whole as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select cast(row_number() over (order by sha256('3:' || cast(vec_id as varchar))) - 1 as int) as c, v from whole order by c limit {k})"""
    for r in range(rounds + 1):
        text += f""",
a{r} as materialized (select w.vec_id, w.v, min({apart} * {k} + c.c) as best from whole w cross join c{r} c group by w.vec_id, w.v)"""
        if r < rounds:
            text += f""",
s{r} as (select best % {k} as c, list_transform(generate_series(1, 64), lambda d: d) as ds, list(v) as vs, count(*) as n from a{r} group by all),
c{r + 1} as materialized (
  select c.c, coalesce(list_transform(s.ds, lambda d: cast(floor(list_sum(list_transform(s.vs, lambda v: v[d])) / s.n) as bigint)), c.v) as v from c{r} c left join s{r} s on s.c = c.c)"""
    return text + f""",
f as (select vec_id, best % {k} as c, best // {k} as distance from a{rounds})
select f.vec_id, cast(f.c as int) as "cluster", cast(f.distance as bigint) as distance, cast(sum(f.distance) over (partition by f.c) as bigint) as cluster_inertia,
  cast(sum(f.distance) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from f join c{rounds} c on c.c = f.c"""


ORACLE = _oracle()
