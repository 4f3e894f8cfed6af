"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Benchmark items are cut into passages of at most ``PASSAGE`` words and weighted by TF-IDF with document
counts over the whole corpus. A randomised SVD, whose products with the passage matrix Spark sums over
partitions, gives the latent space, of the smallest rank at which every passage keeps ``KEPT`` of its
squared norm; passages have norm 1 in it, whatever the rank. Every document is read whole through
overlapping windows; a window is projected, and its cosine to a passage finds candidates. The threshold
is ``COSINE`` or, where lower, the smallest cosine of a window that holds ``LCS`` of the passage's words,
the commonest ones. A candidate counts when the longest common subsequence of item and surrounding words
covers ``LCS`` of the item and ``ANSWER`` of the item's last sentence, or ``COPIED`` of the item. Regions
of a document in which too few of an item's words occur at all to pass this check are not projected for
it, which drops nothing.

The benchmark is a stated query set: its passages go in blocks of ``BLOCK``, each with its own space, and
only models of bounded size are broadcast. Null and empty texts match nothing; items without words are
never found; repeated rows give repeated results; empty tables give no rows; other columns are kept by
``remove`` and ignored by ``search``. Ties go to the first window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cadastre.llm.text import broadcast_if_small, frugal, in_chunks, plain_words, whole_text
from cadastre.session import cut_lineage

#: words of a passage, and (most words of a passage, window, step) of each window class
PASSAGE = 48
WINDOWS = ((12, 16, 4), (24, 32, 8), (48, 64, 16))
#: passages of a block, oversampling of its space, power iterations
BLOCK = 400
OVER, POWER = 8, 2
#: words of a strip, by which sums of the space are folded on the executors
STRIP = 512
#: part of its squared norm that every passage keeps in the space of its block
KEPT = 0.95
#: cosine from which any passage is a candidate; a passage of common words is one from less
COSINE = 0.25
#: window starts of a region, at least
REGION = 256
#: parts of an item, and of its last sentence, that the common subsequence covers
LCS, ANSWER, COPIED = 0.6, 0.5, 0.8


def subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    at: dict = {}
    for k, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Item:
    id: object
    words: list[bytes]
    answer: list[bytes]


@dataclass
class Block:
    """Projected passages of up to ``BLOCK`` passages, by window class."""

    owner: np.ndarray  # item of each passage
    window: np.ndarray  # window class of each passage
    basis: np.ndarray = field(repr=False)  # one latent row for each word
    latent: np.ndarray = field(repr=False)  # passages of norm 1 in the space
    need: np.ndarray = field(repr=False)  # least product of each passage and a window that holds LCS of it, by the norm kept
    lost: np.ndarray = field(repr=False)  # norm of each passage outside the space, by the norm kept


class Presence:
    """Which items of at most ``margin`` words can pass the sequence check in a region, by the words that occur at all."""

    def __init__(self, margin: int, at: list[int], items: list[Item], vocabulary: dict[bytes, int]):
        self.margin, self.at = margin, np.array(at)
        self.words, self.first, self.count = self.laid([items[k].words for k in at], vocabulary)
        self.answers, self.answer_first, self.answer_count = self.laid([items[k].answer for k in at], vocabulary)

    @staticmethod
    def laid(lists: list[list[bytes]], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        count = np.array([len(w) for w in lists])
        return np.array([vocabulary[w] for ws in lists for w in ws]), np.cumsum(count) - count, count

    def able(self, held: np.ndarray) -> np.ndarray:
        """Items that can pass, given for each word of the vocabulary whether it occurs."""
        cover = np.add.reduceat(held.take(self.words), self.first, dtype=np.int32) / self.count
        if not (near := cover >= LCS).any():
            return self.at[:0]
        answer = np.add.reduceat(held.take(self.answers), self.answer_first, dtype=np.int32) / self.answer_count
        return self.at[(cover >= COPIED) | near & (answer >= ANSWER)]


@dataclass
class Model:
    items: list[Item]
    vocabulary: dict[bytes, int]
    idf: np.ndarray  # of each word
    other: float  # IDF of words outside the vocabulary
    blocks: list[Block]
    presence: list[Presence]


def parse(item_id: object, text: str | None) -> Item:
    sentences = [w for s in (text or "").replace("?", ".").replace("!", ".").split(".") if (w := plain_words(s.encode()))]
    return Item(item_id, [w for s in sentences for w in s], sentences[-1] if sentences else [])


def passages(items: list[Item]) -> list[tuple[int, list[bytes]]]:
    """(item, words) of the passages of all items, of nearly equal lengths within an item."""
    out = []
    for k, item in enumerate(items):
        n = -(-len(item.words) // PASSAGE)
        for a in range(n):
            out.append((k, item.words[a * len(item.words) // n : (a + 1) * len(item.words) // n]))
    return out


def document_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """Documents, and how many hold each word of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = shared.value
        total, counts = 0, np.zeros(len(look), np.int64)
        for batch in batches:
            for _, texts in in_chunks(batch.column(0)):
                total += len(texts)
                for t in texts:
                    counts[[look[w] for w in look.keys() & set(plain_words(t))]] += 1
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], total))], ["w", "n"])

    sums = docs.mapInArrow(frugal(run), "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    w, n = sums["w"].to_numpy(), sums["n"].to_numpy()
    counts = np.zeros(len(vocabulary), np.int64)
    counts[w[w >= 0]] = n[w >= 0]
    return int(n[w < 0].sum()), counts


def latent_space(spark, rows: list[tuple[list[int], list[float]]], width: int) -> np.ndarray:
    """All right singular vectors of sparse rows, largest first, by randomised subspace iteration on Spark."""
    k = min(len(rows), width)
    y = np.random.default_rng(5).standard_normal((width, min(width, k + OVER)))
    matrix = spark.createDataFrame(rows, "at array<int>, x array<double>").repartition(4)
    matrix = cut_lineage(matrix)

    def product(basis: np.ndarray) -> np.ndarray:
        """A^T A times the basis, summed on the executors by strips of words; one matrix reaches the driver."""
        shared = spark.sparkContext.broadcast(basis.astype(np.float32))
        shape = basis.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for at, x in zip(batch.column(0), batch.column(1)):
                    at, x = np.array(at.as_py(), np.int64), np.array(x.as_py())
                    added = x[:, None] * (x @ shared.value[at])[None, :]
                    for strip in np.unique(at // STRIP).tolist():
                        mine = at // STRIP == strip
                        held = total.setdefault(strip, np.zeros((STRIP, shape[1])))
                        held[at[mine] % STRIP] += added[mine]  # a word occurs once in a row
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["strip", "s"])

        def fold(key: tuple, part: pa.Table) -> pa.Table:
            summed = sum(np.frombuffer(v.as_buffer()) for v in part["s"])
            return pa.table({"strip": pa.array([key[0].as_py()], pa.int32()), "s": pa.array([summed.astype(np.float32).tobytes()], pa.binary())})

        out = np.zeros(shape)
        for r in matrix.mapInArrow(frugal(run), "strip int, s binary").groupBy("strip").applyInArrow(fold, "strip int, s binary").collect():
            first = r["strip"] * STRIP
            out[first : first + STRIP] = np.frombuffer(r["s"], np.float32).reshape(STRIP, -1)[: shape[0] - first]
        shared.destroy()
        return out

    for _ in range(POWER):
        y, _ = np.linalg.qr(product(y))
    q, _ = np.linalg.qr(y)
    _, vectors = np.linalg.eigh(q.T @ product(q))
    return (q @ vectors[:, ::-1][:, :k]).astype(np.float32)


def least_product(words: list[bytes], vocabulary: dict[bytes, int], idf: np.ndarray) -> float:
    """Least product of a passage of norm 1 and a window that holds ``LCS`` of its words."""
    at = [vocabulary[w] for w in words]
    squares = np.sort(idf[at] ** 2)
    return float(squares[: math.ceil(LCS * len(words) - 1e-9)].sum() / np.linalg.norm(np.bincount(at) * idf[: max(at) + 1]))


def build(docs: DataFrame, benchmark: DataFrame, *, text: str, item_key: str, item_text: str) -> Model:
    spark = docs.sparkSession
    items = [i for r in benchmark.select(item_key, item_text).orderBy(item_key, item_text).collect() if (i := parse(r[0], r[1])).words]
    cut = passages(items)
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, p in cut for w in p}))}
    if not vocabulary:
        return Model([], {}, np.zeros(0), 0.0, [], [])
    total, counts = document_counts(docs.select(whole_text(text).cast("binary").alias("t")), vocabulary)
    idf = np.log((total + 1) / (counts + 0.5)).clip(0.05)
    other = float(np.median(idf))
    blocks = []
    for start in range(0, len(cut), BLOCK):
        own = cut[start : start + BLOCK]
        dense = np.zeros((len(own), len(vocabulary)), np.float32)
        for k, (_, words) in enumerate(own):
            np.add.at(dense[k], [vocabulary[w] for w in words], 1.0)
        dense *= idf
        dense /= np.linalg.norm(dense, axis=1, keepdims=True)
        rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].astype(float).tolist()) for r in dense]
        basis = latent_space(spark, rows, len(vocabulary))
        latent = dense @ basis
        part = np.cumsum(latent.astype(float) ** 2, axis=1).min(axis=0)
        rank = min(int(np.searchsorted(part, KEPT)) + 1, len(part))
        basis, latent = np.ascontiguousarray(basis[:, :rank]), latent[:, :rank]
        norm = np.linalg.norm(latent, axis=1, keepdims=True)
        latent = latent / norm
        window = np.array([next(c for c, (most, _, _) in enumerate(WINDOWS) if len(words) <= most) for _, words in own])
        need = np.array([least_product(words, vocabulary, idf) for _, words in own])
        lost = np.sqrt((1 - norm[:, 0].astype(float) ** 2).clip(0))
        blocks.append(Block(np.array([k for k, _ in own]), window, basis, latent, need / norm[:, 0], lost / norm[:, 0]))
    by_margin: dict[int, list[int]] = {}
    for k, item in enumerate(items):
        by_margin.setdefault(max(16, 1 << (len(item.words) - 1).bit_length()), []).append(k)
    return Model(items, vocabulary, idf, other, blocks, [Presence(m, at, items, vocabulary) for m, at in sorted(by_margin.items())])


def scan(text: bytes, model: Model) -> list[tuple[object, float, float, float, int]]:
    """(item, cosine, LCS part, answer part, first word) of the items found in a text, best cover of each."""
    words = plain_words(text)
    n = len(words)
    if not n or not model.vocabulary:
        return []
    ids = np.fromiter(map(model.vocabulary.get, words, repeat(-1)), np.int64, n)
    known = ids >= 0
    if not known.any():
        return []
    weight = np.where(known, model.idf[ids], model.other)
    energy = np.concatenate(([0.0], np.cumsum(weight * weight)))
    held = np.zeros(len(model.vocabulary) + 1, bool)  # the last place is of words outside the vocabulary
    longest = max(length for _, length, _ in WINDOWS)
    best: dict[int, tuple[float, float, float, int]] = {}
    for presence in model.presence:
        size = max(REGION, presence.margin)
        for first in range(0, n, size):
            inside = ids[max(0, first - presence.margin) : first + size + longest + presence.margin]
            held[inside] = True
            able = presence.able(held)
            held[inside] = False
            if len(able):
                judge(words, ids, weight, energy, first, min(n, first + size), able, model, best)
    return [(model.items[k].id, *best[k]) for k in sorted(best)]


def judge(words: list[bytes], ids: np.ndarray, weight: np.ndarray, energy: np.ndarray, first: int, last: int, able: np.ndarray, model: Model, best: dict) -> None:
    """Compares the windows that start in first..last with the passages of some items."""
    n = len(words)
    stop = min(n, last + max(length for _, length, _ in WINDOWS))
    known = np.flatnonzero(ids[first:stop] >= 0)
    wanted = np.zeros(len(model.items), bool)
    wanted[able] = True
    for block in model.blocks:
        mine = np.flatnonzero(wanted[block.owner])
        if not len(mine):
            continue
        rows = block.basis[ids[first + known]]
        for c, (_, length, step) in enumerate(WINDOWS):
            own = mine[block.window[mine] == c]
            starts = np.arange(-(-first // step) * step, min(last, max(1, n - length + step)), step)
            if not len(own) or not len(starts):
                continue
            ends = np.minimum(starts + length, n)
            products = np.zeros((len(own), stop - first + 1))
            products[:, known + 1] = (block.latent[own] @ rows.T) * weight[first + known]
            products = np.cumsum(products, axis=1)
            norm = np.sqrt(energy[ends] - energy[starts])
            cosine = (products[:, ends - first] - products[:, starts - first]) / norm
            enough = np.minimum(COSINE, block.need[own, None] / norm - block.lost[own, None])
            for j, k in np.argwhere((cosine >= enough - 1e-5).T).tolist():
                a, e = int(starts[j]), int(ends[j])
                item_at = int(block.owner[own[k]])
                item = model.items[item_at]
                around = words[max(0, a - len(item.words)) : e + len(item.words)]
                # no common subsequence is longer than the number of item words that occur at all
                most = sum(map(set(around).__contains__, item.words)) / len(item.words)
                so_far = best.get(item_at, (0, 0.0, 0.0, 0))
                if most < LCS or (most, -a) <= (so_far[1], -so_far[3]):
                    continue
                cover = subsequence(item.words, around) / len(item.words)
                answer = subsequence(item.answer, around) / len(item.answer)
                if (cover >= COPIED or cover >= LCS and answer >= ANSWER) and (cover, -a) > (so_far[1], -so_far[3]):
                    best[item_at] = float(cosine[k, j]), cover, answer, a


def search(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, cosine, lcs, answer, at_word) for every benchmark item found in a document."""
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, benchmark, text=text, item_key=item_key, item_text=item_text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_chunks(batch.column(1)):
                rows = [(first + k, *found) for k, t in enumerate(texts) for found in scan(t, shared.value)]
                if rows:
                    at, *columns = zip(*rows)
                    values = [pa.array(c, t) for c, t in zip(columns, (item_type, pa.float64(), pa.float64(), pa.float64(), pa.int64()))]
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), *values], ["id", "item", "cosine", "lcs", "answer", "at_word"])

    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_key].dataType)
    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t"))
    found = rows.mapInArrow(frugal(run), f"id {kinds[0]}, item {kinds[1]}, cosine double, lcs double, answer double, at_word long")
    return found.toDF(key, item_key, "cosine", "lcs", "answer", "at_word")


def remove(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", **names) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns."""
    place = "place"
    while place in docs.columns:
        place += "_"
    marked = docs.withColumn(place, F.struct(F.xxhash64(key, text).alias("a"), F.hash(text, key).alias("b")))
    found = search(marked.select(place, text), benchmark, text=text, key=place, **names).select(place).distinct()
    return marked.join(broadcast_if_small(cut_lineage(found)), place, "left_anti").select(*docs.columns)
