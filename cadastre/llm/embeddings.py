"""Near copies of vectors through a pivot-permutation index.

Reference vectors (pivots) are a bounded sample, about 4 sqrt(n) of them. A vector is described by its
``NEAREST`` pivots in order. Inverted lists hold, for each pivot, the vectors that name it; two vectors
are candidates when their descriptions share at least ``SHARED`` pivots, and a pair is taken only in the
list of the first pivot they share. Candidates are verified by cosine in double precision. Lists are cut
into tiles of chunk pairs, so one very long list is spread over many tasks. A tile reports per vector
the number of its links and one edge to the group it belongs to there, never all pairs.

Equal vectors are one class with a multiplicity; copies link with each other. Vectors that are null,
empty, zero or hold null or non-finite components link with nothing, as do vectors of other lengths.
Repeated ids are rows of their own. An empty table gives no rows. Other columns are ignored. Recall
against brute force is tested; a found pair is always right.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cadastre.operators.rounds import components
from cadastre.session import cut_lineage

THRESHOLD = 0.95
#: pivots that describe a vector, and how many a candidate pair shares
NEAREST = 16
SHARED = 2
#: bounds of the number of pivots
PIVOTS = (16, 16_384)
#: vectors of one list in a chunk; a tile holds two chunks
CHUNK = 512


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpointed rows (id, d) and classes (d, size, dim, v) of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, dim, values = [], [], []
            for value in batch.column(1):
                v = value.as_py()
                x = np.array([np.nan if c is None else c for c in v or []], np.float64)
                norm = float(np.linalg.norm(x)) if len(x) and np.isfinite(x).all() else 0.0
                usable = 0.0 < norm < math.inf
                raw = (x + 0.0).tobytes() if usable else None  # -0.0 equals 0.0
                d.append(xxhash.xxh3_64_intdigest(raw) - (1 << 63) if usable else None)
                dim.append(len(x))
                values.append(raw)
            yield pa.record_batch([batch.column(0), pa.array(d, pa.int64()), pa.array(dim, pa.int32()), pa.array(values, pa.binary())], ["id", "d", "dim", "v"])

    kind = vectors.schema["id"].dataType.simpleString()
    parsed = cut_lineage(vectors.mapInArrow(run, f"id {kind}, d long, dim int, v binary"))
    classes = parsed.where("d is not null").groupBy("d").agg(F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    return parsed.select("id", "d"), cut_lineage(classes)


def _described(classes: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Classes with ``near``: their nearest pivots in order, numbered over all vector lengths."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            near: list[list[int]] = [[]] * batch.num_rows
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                x = unit(np.stack([np.frombuffer(batch.column(3)[k].as_py()) for k in own.tolist()]))
                at = np.argsort(-(x @ shared.value[dim].T), axis=1, kind="stable")[:, :nearest] + first[dim]
                for k, a in zip(own.tolist(), at.tolist()):
                    near[k] = a
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], names=["d", "size", "dim", "v", "near"])

    return classes.select("d", "size", "dim", "v").mapInArrow(run, "d long, size long, dim int, v binary, near array<int>")


def _tile(t: pa.Table, threshold: float, shared: int) -> pa.Table:
    """Link counts and roots of the vectors of one tile (pivot, i, j)."""
    pivot, i, j = (t[c][0].as_py() for c in ("pivot", "i", "j"))
    order = np.argsort(t["d"].to_numpy(), kind="stable")
    t = t.take(pa.array(order))
    d, size, own = t["d"].to_numpy(), t["size"].to_numpy(), t["own"].to_numpy()
    x = unit(np.stack([np.frombuffer(v.as_buffer()) for v in t["v"]]))
    near = np.array(t["near"].to_pylist(), np.int64)
    links = np.zeros(len(d), np.int64)
    root = np.arange(len(d))
    for a in range(0, len(d), 256):
        left, right = np.nonzero(x[a : a + 256] @ x.T >= threshold)
        left = left + a
        keep = (left < right) & ((own[left] != own[right]) if i != j else True)
        left, right = left[keep], right[keep]
        for s in range(0, len(left), 20_000):
            l, r = left[s : s + 20_000], right[s : s + 20_000]
            both = near[l][:, :, None] == near[r][:, None, :]
            first = np.where(both.any(axis=2), near[l], np.iinfo(np.int64).max).min(axis=1)
            hit = (both.sum(axis=(1, 2)) >= shared) & (first == pivot)
            l, r = l[hit], r[hit]
            np.add.at(links, l, size[r])
            np.add.at(links, r, size[l])
            while len(l):  # smaller root on both ends until nothing changes
                low = np.minimum(root[l], root[r])
                change = (root[l] != low) | (root[r] != low)
                if not change.any():
                    break
                np.minimum.at(root, root[l], low)
                np.minimum.at(root, root[r], low)
                root = root[root]
    while (root[root] != root).any():
        root = root[root]
    some = links > 0
    return pa.table({"d": pa.array(d[some]), "links": pa.array(links[some]), "root": pa.array(d[root[some]])})


def near_copies(vectors: DataFrame, *, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector: ``n_links``, ``component_id`` (smallest id reachable by links) and ``kept``."""
    rows, classes = _classes(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")))
    count = classes.count()
    wanted = int(min(PIVOTS[1], max(PIVOTS[0], 4 * math.sqrt(count))))
    sample = classes.orderBy(F.xxhash64("d"), "d").limit(wanted).select("d", "dim", "v").collect()
    dims = {r["dim"] for r in classes.select("dim").distinct().collect()}
    pivots = {dim: unit(np.stack([np.frombuffer(r["v"]) for r in sample if r["dim"] == dim])) for dim in sorted({r["dim"] for r in sample})}
    for dim in sorted(dims - set(pivots)):  # a length that the sample missed has one pivot of its own
        pivots[dim] = np.ones((1, dim)) / math.sqrt(dim)
    described = cut_lineage(_described(classes, pivots, nearest))
    lists = described.withColumn("pivot", F.explode("near"))
    sizes = lists.groupBy("pivot").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = lists.join(F.broadcast(sizes), "pivot")  # a row for each of at most PIVOTS[1] pivots
    placed = placed.withColumn("own", F.pmod(F.xxhash64("d"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = placed.select("d", "size", "v", "near", "pivot", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = cut_lineage(tiles.groupBy("pivot", "i", "j").applyInArrow(lambda t: _tile(t, threshold, min(shared, len(t["near"][0]))), "d long, links long, root long"))
    links = found.groupBy("d").agg(F.sum("links").alias("links"))
    groups = components(found.where("d <> root").select(F.col("d").alias("u"), F.col("root").alias("v"))).select(F.col("id").alias("d"), "component")
    named = rows.where("d is not null").groupBy("d").agg(F.min("id").alias("least")).join(groups, "d", "left").withColumn("component", F.coalesce("component", "d"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classed = named.join(first, "component").join(links, "d", "left").join(classes.select("d", "size"), "d")
    classed = classed.select("d", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = rows.join(classed, "d", "left").select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
