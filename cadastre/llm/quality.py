"""Quality scores from a factorisation machine over hashed words, structure statistics and text size.

A text's features are the square roots of its words' parts (hashed into ``BUCKETS``, so their vector
has length 1) and ``STATISTICS`` numbers about its structure and size. The machine adds a low-rank weight
for every pair of features, scored in linear time as half of (sum of v x) squared minus the sum of
squares. It is fitted by full gradients that Spark sums over a bounded sample of labelled rows
(``SAMPLE``, a parameter); only the parameters and their gradients, of a fixed size, reach the driver.
Scoring is a map over whole texts. Ids, labels, language and source are never inputs.

Null and empty texts have zero word features and get a score like any other. Without labelled rows every
score is 0.5. Of several labels of one id the smallest counts. Repeated rows give repeated results; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadastre.llm.text import frugal, bounded_rows, held_out, in_chunks, whole_text, word_hashes
from cadastre.session import cut_lineage

BUCKETS = 1 << 12
STATISTICS = 14
RANK = 6
#: labelled rows that the machine is fitted on, and the tasks that sum their gradients
SAMPLE = 6_000
TASKS = 8
STEPS = 40
RATE = 0.08
DECAY = 1e-4
#: documents scored in one matrix
BATCH = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
WIDTH = BUCKETS + STATISTICS


def features(text: bytes) -> np.ndarray:
    """Feature vector of one text."""
    x = np.zeros(WIDTH, np.float32)
    words = text.split()
    n = len(words)
    if n:
        h = word_hashes([w.lower() for w in words])
        counts = np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        x[:BUCKETS] = np.sqrt(counts / n)
        raw = np.frombuffer(text, np.uint8)
        use = np.bincount(raw, minlength=256)
        size = len(raw)
        letters = int(use[_LETTER].sum())
        marks = size - letters - int(use[_DIGIT].sum()) - int(use[_SPACE].sum())
        lines = [l for l in text.split(b"\n") if l.strip()]
        x[BUCKETS:] = [
            letters / size,
            int(use[_UPPER].sum()) / max(1, letters),
            int(use[_DIGIT].sum()) / size,
            min(1.0, 4 * marks / size),
            min(1.0, 20 * int(use[33]) / size),
            min(1.0, 10 * int(use[[35, 36, 37, 38, 42, 124]].sum()) / size),
            min(1.0, size / n / 16),
            len(np.unique(h)) / n,
            1 - len(set(lines)) / max(1, len(lines)),
            min(1.0, n / max(1, len(lines)) / 200),
            min(1.0, max(map(len, words)) / 64),
            min(1.0, np.log1p(size) / 14),
            min(1.0, np.log1p(len(lines)) / 8),
            sum(w.isupper() for w in words) / n,
        ]
    return x


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Sum-of-squares identity: all pairwise terms in time linear in the features."""
        sums = x @ self.factors
        squares = (x * x) @ (self.factors * self.factors)
        return self.bias + x @ self.weights + 0.5 * (sums * sums - squares).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Loss, rows and the gradients of bias, weights and factors in one vector of fixed length."""
        p = self.score(x)
        g = p - y
        sums = x @ self.factors
        factors = x.T @ (g[:, None] * sums) - ((x * x).T @ g)[:, None] * self.factors
        loss = -np.log(np.where(y > 0.5, p, 1 - p) + 1e-12).sum()
        return np.concatenate(([loss, len(y), g.sum()], x.T @ g, factors.ravel()))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", key: str = "doc_id", sample: int = SAMPLE, steps: int = STEPS) -> Machine:
    """Machine fitted on at most ``sample`` labelled documents of those handed in."""
    start = np.random.default_rng(11)
    machine = Machine(0.0, np.zeros(WIDTH, np.float32), (start.standard_normal((WIDTH, RANK)) * 0.02).astype(np.float32))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("y"))
    chosen = bounded_rows(known, key, sample).select(F.col(key).alias("id"), "y")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in in_chunks(batch.column(1)):
                x = [features(t) for t in texts]
                at = [np.flatnonzero(v) for v in x]
                packed = [a.astype("<u4").tobytes() + v[a].astype("<f4").tobytes() for a, v in zip(at, x)]
                yield pa.record_batch([batch.column(0).slice(first, len(texts)), pa.array(packed, pa.binary())], ["y", "x"])

    # the sample has a fixed largest size, so its ids may be broadcast
    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t")).join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    rows = rows.repartition(TASKS, "id").select(F.col("y").cast("double").alias("y"), "t").mapInArrow(vectors, "y double, x binary")
    rows = cut_lineage(rows).coalesce(TASKS)  # so many gradients reach the driver in each step at most
    size = 1 + WIDTH * (1 + RANK)
    first, second = np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):

        def sums(batches: Iterator[pa.RecordBatch], now: Machine = machine) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + size)
            for batch in batches:
                for a in range(0, batch.num_rows, BATCH):
                    part = batch.slice(a, BATCH)
                    x = np.zeros((part.num_rows, WIDTH), np.float32)
                    for k, packed in enumerate(part.column(1)):
                        packed = packed.as_py()
                        n = len(packed) // 8
                        x[k, np.frombuffer(packed, "<u4", n)] = np.frombuffer(packed, "<f4", n, 4 * n)
                    total += now.gradient(x, part.column(0).to_numpy())
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["g"])

        parts = [np.frombuffer(r["g"]) for r in rows.mapInArrow(sums, "g binary").collect()]
        total = sum(parts, np.zeros(2 + size))
        if not total[1]:
            return Machine(0.0, np.zeros(WIDTH, np.float32), np.zeros((WIDTH, RANK), np.float32))
        g = total[2:] / total[1]
        theta = np.concatenate(([machine.bias], machine.weights, machine.factors.ravel()))
        g[1:] += DECAY * theta[1:]
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta = theta - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        machine = Machine(float(theta[0]), theta[1 : 1 + WIDTH].astype(np.float32), theta[1 + WIDTH :].reshape(WIDTH, RANK).astype(np.float32))
    return machine


def score(docs: DataFrame, machine: Machine, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for _, texts in in_chunks(batch.column(1)):
                for a in range(0, len(texts), BATCH):
                    scores += shared.value.score(np.stack([features(t) for t in texts[a : a + BATCH]])).tolist()
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"id {kind}, score double").withColumnRenamed("id", key)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text: str = "text", key: str = "doc_id", **fitting) -> DataFrame:
    """Score and prediction of every document, learned from the labels that aren't held out."""
    machine = fit(docs.select(key, text), labels.where(~held_out(key)), text=text, key=key, **fitting)
    out = score(docs, machine, text=text, key=key)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
