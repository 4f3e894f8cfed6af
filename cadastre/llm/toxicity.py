"""Toxicity from a support vector machine on a subsequence string kernel with Nyström landmarks.

A text's sentences are read as strings: each word in folded letters (case, accents, look-alike digits; marks
dropped) between two border signs, and runs of very short pieces joined ("i d i o t"). The kernel of two
strings counts common subsequences of three signs, gaps allowed up to a span of ``SPAN`` signs, each
weighted with ``DECAY`` to the power of its span, and is normalised; an inserted or masked letter thus
costs part of the similarity only. Landmarks are strings that toxic documents hold far more often than
clean ones, and common clean strings. Nyström features are kernel values to the landmarks times the
inverse root of the landmark kernel. A squared-hinge machine is fitted on labelled sentences: every string
of a clean document counts as clean; of a toxic document the strings that the machine so far finds most
toxic share the label, as only the document has one. Since the machine is linear in the subsequences,
it folds into one weight per subsequence, and scoring is a map over whole texts in linear time.
A sentence scores as its most toxic string, a document as its most toxic sentence, mapped to 0..1.

The machine is fitted on at most ``TOXIC`` toxic and ``CLEAN`` clean labelled documents (parameters), in
Spark sums; candidates for landmarks and the sums that reach the driver have fixed sizes. Ids, labels,
language and source are never inputs. Null and empty texts have no strings and get the score of a text
without signs of toxicity. Without labelled rows of both kinds every score is 0. Of several labels of one id
the largest counts, of several texts of a labelled id the smallest. Repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cadastre.llm.text import bounded_rows, frugal, in_chunks, whole_text
from cadastre.session import cut_lineage

#: subsequences have three signs within a span of ``SPAN``
SPAN = 6
DECAY = 0.7
SIGNS = 32
#: strings longer than ``LONG`` signs are read in windows that overlap by half
LONG = 24
#: labelled documents that the machine is fitted on
TOXIC = 1_500
CLEAN = 3_000
#: landmarks of either kind, and the candidates that reach the driver
MARKED = 96
PLAIN = 32
CANDIDATES = 4_000
#: pieces of strings that may become landmarks
PIECES = (4, 5, 6, 7)
#: strings of a document, most like the landmarks, that the fitting uses, and its steps
STRINGS = 24
STEPS = 16
#: strings of a toxic document whose disguised forms are examples too
BENT = 3
TASKS = 8
PENALTY = 3e-4
#: how many times more often, as a logarithm, toxic documents hold a landmark
LIFT = 1.2
#: distinct words whose scores a worker keeps
CACHE = 200_000

#: digits read as the letters they are often written for
_DIGITS = dict(zip("0134578", "oieastb"))
_SHORT = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


class _Fold(dict):
    """Sign of each character, filled as characters come: 1 to 26 letters, 27 to 31 other scripts."""

    def __missing__(self, code: int) -> str:
        base = unicodedata.normalize("NFKD", chr(code))[:1].lower()
        base = _DIGITS.get(base, base)
        if "a" <= base <= "z":
            sign = chr(ord(base) - 96)
        elif base.isalpha():
            sign = chr(27 + code % 5)
        else:
            sign = ""
        self[code] = sign
        return sign


_FOLD = _Fold()


def signs(word: str) -> list[bytes]:
    """A word as strings of signs, in windows where it is long; none if it has no letters."""
    s = word.translate(_FOLD).encode("latin-1")
    if len(s) <= LONG:
        return [s] if s else []
    return [s[a : a + LONG] for a in range(0, len(s) - LONG // 2, LONG // 2)]


def joined(text: str) -> Iterator[str]:
    """Runs of three or more pieces of one or two characters, joined, eight pieces at a time."""
    for run in _SHORT.finditer(text):
        parts = run.group().split()
        for a in range(0, max(1, len(parts) - 4), 4):
            yield "".join(parts[a : a + 8])


def words_of(text: str) -> set[str]:
    return {*text.split(), *joined(text)}


def subsequences(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, code, weight) of all subsequences, weights normalised to length 1 per string."""
    flat = np.frombuffer(b"".join(b"\0" + s + b"\0" for s in strings), np.uint8).astype(np.int64)
    own = np.repeat(np.arange(len(strings)), [len(s) + 2 for s in strings])
    keys, weights = [], []
    for a, b in _OFFSETS:
        if len(flat) > b:
            at = np.flatnonzero(own[:-b] == own[b:])
            keys.append(((own[at] * SIGNS + flat[at]) * SIGNS + flat[at + a]) * SIGNS + flat[at + b])
            weights.append(np.full(len(at), DECAY ** (b + 1)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    weight = np.bincount(inverse, np.concatenate(weights))
    string, code = key // SIGNS**3, key % SIGNS**3
    norm = np.sqrt(np.bincount(string, weight * weight, len(strings)))
    return string, code, weight / norm[string]


def kernel(strings: list[bytes], table: np.ndarray) -> np.ndarray:
    """Kernel values of strings (rows) to the landmarks of ``table`` (codes, landmarks)."""
    out = np.zeros((len(strings), table.shape[1]), np.float32)
    for a in range(0, len(strings), 512):
        string, code, weight = subsequences(strings[a : a + 512])
        if len(string):
            first = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
            out[a + string[first]] = np.add.reduceat(table[code] * weight[:, None].astype(np.float32), first, axis=0)
    return out


def bent(string: bytes) -> list[bytes]:
    """A string with a sign put in, and with one replaced by it, near its middle."""
    k = max(1, len(string) // 2)
    return [string[:k] + b"\x18" + string[k:], string[: k - 1] + b"\x11" + string[k - 1 :], string[:k] + b"\x18" + string[k + 1 :]]


def landmark_table(landmarks: list[bytes]) -> np.ndarray:
    table = np.zeros((SIGNS**3, len(landmarks)), np.float32)
    string, code, weight = subsequences(landmarks)
    table[code, string] = weight
    return table


@dataclass
class Machine:
    """Weight per subsequence, and the map of a document's largest margin to 0..1."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    known: dict = field(default_factory=dict)

    def margins(self, strings: list[bytes]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for a in range(0, len(strings), 4096):
            string, code, weight = subsequences(strings[a : a + 4096])
            part = strings[a : a + 4096]
            out[a : a + 4096] += np.bincount(string, self.weights[code] * weight, len(part))
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Margins of words that are not in the cache yet."""
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE:
            self.known = {}
        strings = [signs(w) for w in new]
        margins = self.margins([s for group in strings for s in group])
        at = 0
        for word, group in zip(new, strings):
            self.known[word] = float(margins[at : at + len(group)].max()) if group else self.bias
            at += len(group)

    def score(self, texts: list[str]) -> list[float]:
        """Score of each text: its most toxic string."""
        out = []
        for text in texts:
            words = words_of(text.lower())
            if not words <= self.known.keys():
                self.learn(words)
                if not words <= self.known.keys():  # the cache was emptied on the way
                    self.learn(words)
            out.append(max(map(self.known.__getitem__, words), default=self.bias))
        z = np.clip(self.slope * np.array(out) + self.offset, -30, 30)
        return (1 / (1 + np.exp(-z))).tolist()


def _sample(docs: DataFrame, known: DataFrame, text: str, key: str, toxic: int, clean: int) -> DataFrame:
    """Checkpointed (y, t) of labelled documents, a bounded number of either kind."""
    chosen = bounded_rows(known.where("y = 1"), key, toxic).unionByName(bounded_rows(known.where("y = 0"), key, clean)).select(F.col(key).alias("id"), "y")
    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("t")).join(F.broadcast(chosen), "id")  # the sample has a fixed largest size
    return cut_lineage(rows.groupBy("id", "y").agg(F.min("t").alias("t")).select("y", "t").repartition(TASKS)).coalesce(TASKS)


def _pieces(strings: Iterable[bytes]) -> set[bytes]:
    out = set()
    for s in strings:
        whole = b"\0" + s + b"\0"
        out.add(whole)
        for n in PIECES:
            out.update(whole[a : a + n] for a in range(len(whole) - n + 1))
    return out


def _landmarks(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Strings that mark toxic documents, then common clean ones; the weight of those of the first kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[y].update(_pieces({s for w in words_of(t.lower()) for s in signs(w)}))
        for y in (0, 1):
            yield pa.record_batch([pa.array(list(seen[y]), pa.binary()), pa.array([y] * len(seen[y]), pa.int32()), pa.array(list(seen[y].values()), pa.int64())], ["piece", "y", "n"])

    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not size.get(0) or not size.get(1):
        return [], np.zeros(0)
    n = rows.mapInArrow(count, "piece binary, y int, n long").groupBy("piece").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("n0"))
    lift = F.log((F.col("n1") + 0.5) / (size[1] + 1)) - F.log((F.col("n0") + 0.5) / (size[0] + 1))
    n = cut_lineage(n.where("n1 + n0 > 1").withColumn("lift", lift).withColumn("gain", F.col("n1") * F.col("lift")))
    found = n.where((F.col("n1") > 1) & (F.col("lift") > LIFT)).orderBy(F.desc("gain"), F.desc(F.length("piece")), "piece").limit(CANDIDATES).select("piece", "gain").collect()
    marked, gain = [bytes(r["piece"]) for r in found], {bytes(r["piece"]): r["gain"] for r in found}
    plain = [bytes(r["piece"]) for r in n.where("n0 > 1").orderBy(F.desc("n0"), "piece").limit(CANDIDATES).select("piece").collect()]
    chosen: list[bytes] = []
    for pool, most in ((marked, MARKED), (plain, MARKED + PLAIN)):
        string, code, weight = subsequences(pool)
        free = np.ones(len(pool), bool)
        for k, piece in enumerate(pool):
            if len(chosen) == most or not free.any():
                break
            core = piece.strip(b"\0")
            if free[k] and not any(core in c or c.strip(b"\0") in piece for c in chosen):  # a part says what the whole says
                chosen.append(piece)
                own = np.zeros(SIGNS**3)
                own[code[string == k]] = weight[string == k]
                free &= np.bincount(string, weight * own[code], len(pool)) < 0.75  # strings much like it stand behind it
        first = len(chosen) if pool is marked else first
    return chosen, np.sqrt([gain[c] for c in chosen[:first]])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", key: str = "doc_id", toxic: int = TOXIC, clean: int = CLEAN) -> Machine | None:
    """Machine fitted on a bounded number of the labelled documents handed in; None without both kinds."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(F.col(label).cast("int")).alias("y"))
    total = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    rows = _sample(docs, known, text, key, toxic, clean)
    landmarks, marking = _landmarks(rows)
    if not len(marking):
        return None
    table = landmark_table(landmarks)
    among = table.T @ table
    values, vectors = np.linalg.eigh(among.astype(np.float64))
    root = (vectors / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    width = len(landmarks)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                strings = sorted({s for w in words_of(t.lower()) for s in signs(w)})
                near = kernel(strings, table)
                hint = (near[:, : len(marking)] * marking).max(axis=1)
                best = np.argsort(-hint, kind="stable")[:STRINGS]
                near, hint = near[best], hint[best]
                if y and len(best):  # disguised forms of what seems most toxic are examples too
                    hidden = [(v, h) for k, h in zip(best[:BENT].tolist(), hint.tolist()) for v in bent(strings[k])]
                    near, hint = np.vstack((near, kernel([v for v, _ in hidden], table))), np.append(hint, [h for _, h in hidden])
                x.append(np.column_stack((near @ root, np.ones(len(near)), hint)).astype("<f4").tobytes())
            yield pa.record_batch([batch.column(0), pa.array(x, pa.binary())], ["y", "x"])

    described = cut_lineage(rows.mapInArrow(describe, "y int, x binary")).coalesce(TASKS)
    w = np.zeros(width + 1)
    size = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    for step in range(STEPS):

        def sums(batches: Iterator[pa.RecordBatch], w: np.ndarray = w, start: bool = step < STEPS - 4) -> Iterator[pa.RecordBatch]:
            right, left = np.zeros(width + 1), np.zeros((width + 1, width + 1))
            for batch in batches:
                for y, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    x = np.frombuffer(x, "<f4").reshape(-1, width + 2).astype(np.float64)
                    if not len(x):
                        continue
                    x, hint = x[:, :-1], x[:, -1]
                    sign = 1.0 if y else -1.0
                    margin = x @ w
                    share = np.full(len(x), 1.0 / size[0] / 4)
                    if y:  # the most toxic strings share the label of their document
                        lead = np.exp(8 * (hint / max(hint.max(), 1e-9) - 1)) if start else np.exp(2 * (margin - margin.max()))
                        share = lead / lead.sum() / size[1]
                    short = sign * margin < 1
                    x, share = x[short], share[short]
                    left += (share[:, None] * x).T @ x
                    right += sign * share @ x
            yield pa.record_batch([pa.array([right.tobytes()], pa.binary()), pa.array([left.tobytes()], pa.binary())], ["r", "l"])

        parts = described.mapInArrow(sums, "r binary, l binary").collect()  # one matrix of fixed size from each of TASKS tasks
        right = sum(np.frombuffer(p["r"]) for p in parts)
        left = sum(np.frombuffer(p["l"]) for p in parts).reshape(width + 1, width + 1)
        ridge = np.full(width + 1, PENALTY)
        ridge[-1] = 1e-6
        w = (w + np.linalg.solve(left + np.diag(ridge), right)) / 2  # half steps, as whole ones swing about the margin

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [float((np.frombuffer(x, "<f4").reshape(-1, width + 2)[:, :-1] @ w).max(initial=w[-1])) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(best, pa.float64())], ["y", "m"])

    found = described.mapInArrow(largest, "y int, m double").collect()  # TOXIC + CLEAN numbers at most
    m, y = np.array([r["m"] for r in found]), np.array([r["y"] for r in found], np.float64)
    slope, offset = _sigmoid(m, y)
    # the sample holds more toxic rows than the table
    offset += np.log((total[1] / total[0]) / (size[1] / size[0]))
    return Machine((table.astype(np.float64) @ (root @ w[:-1])), float(w[-1]), slope, offset)


def _sigmoid(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over margins, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([m, np.ones(len(m))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0]))
        theta = theta - np.clip(step, -2, 2)
    return max(1e-3, float(theta[0])), float(theta[1])


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows whose crc32 of the id's decimal text leaves no rest modulo 5; a null id is not."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, machine: Machine | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, score) of every document."""
    if machine is None:
        return docs.select(key, F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for _, texts in in_chunks(batch.column(1)):
                scores += shared.value.score([t or "" for t in texts])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(key).alias("id"), whole_text(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(frugal(run), f"id {kind}, score double").withColumnRenamed("id", key)


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, text: str = "text", key: str = "doc_id", **fitting) -> DataFrame:
    """Score and prediction of every document, learned from the labels that aren't held out."""
    machine = fit(docs.select(key, text), labels.where(~held_out(key)), text=text, key=key, **fitting)
    out = score(docs, machine, text=text, key=key)
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
