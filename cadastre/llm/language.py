"""Language identification with bit-sliced Bloom filters of character n-grams.

A filter is an array of slots; a slot has one bit for each language. An n-gram's slots ANDed together
name all languages whose profile holds it. A text's n-grams are counted per language bit, each count is
corrected for the false positives that its bit slice's fill predicts, and the largest count decides.
Profiles are learned from at most ``ROWS`` labelled rows of each language: an n-gram belongs to every
language in which it is at least ``SHARE`` as frequent as where it is most frequent. Slots are built by
Spark with a bitwise OR per slot; the filter's size is set by the distinct n-grams of that bounded
sample and never exceeds ``SLOTS``, so it may be broadcast. Prediction is a map over whole texts.

Text that is null or has no letter gives ``und`` with score 0. Without any labelled row every text does.
Ties go to the language that sorts first. Repeated rows give repeated results; other columns are kept by
``identify`` and ignored by ``predict``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cadastre.llm.text import frugal, held_out, in_chunks, whole_text

#: labelled rows of a language that its profile is learned from
ROWS = 1_000
#: lengths of n-grams in characters
GRAMS = (3, 4)
#: share of an n-gram's highest relative frequency that another language's profile needs
SHARE = 0.3
#: slots that an n-gram sets, and most slots of a filter
PROBES = 2
SLOTS = 1 << 21
#: languages that share one 64-bit slot word
WORD = 62
UNKNOWN = "und"

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str, letters: np.ndarray) -> np.ndarray:
    """Hashes of the character n-grams of a text; all that isn't a letter is one space."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters[x]
    if not alpha.any():
        return np.empty(0, np.uint64)
    keep = alpha.copy()
    keep[1:] |= alpha[:-1]
    x = np.where(alpha, x, 32)[keep]
    x = np.concatenate(([32], x, [32])).astype(np.uint64)
    out = []
    for n in GRAMS:
        m = len(x) - n + 1
        if m > 0:
            h = x[:m] + np.uint64(n)
            for k in range(1, n):
                h = h * _A + x[k : k + m]
            h ^= h >> np.uint64(31)
            out.append(h * _B)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def probes(h: np.ndarray, slots: int) -> list[np.ndarray]:
    """The slots of each n-gram."""
    mask = np.uint64(slots - 1)
    return [((h >> np.uint64(5 + 29 * k)) & mask).astype(np.int64) for k in range(PROBES)]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray = field(repr=False)  # one row of slots for each WORD languages
    false_rate: np.ndarray = field(repr=False)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """Corrected n-gram count of each language."""
        found = np.empty(len(self.languages))
        at = probes(h, self.slots.shape[1])
        for w, row in enumerate(self.slots):
            hit = row[at[0]]
            for p in at[1:]:
                hit &= row[p]
            for b in range(min(WORD, len(self.languages) - w * WORD)):
                found[w * WORD + b] = np.count_nonzero(hit & np.int64(1 << b))
        return np.maximum(0.0, (found - len(h) * self.false_rate) / (1 - self.false_rate))


def learn(docs: DataFrame, *, rows: int = ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Filters:
    """Filters of the languages of the labelled rows handed in."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(key).alias("h"), F.col(text).alias("text"))
    first = Window.partitionBy("lang").orderBy("h")
    last = labelled.select("lang", "h").withColumn("k", F.row_number().over(first)).where(F.col("k") <= rows).groupBy("lang").agg(F.max("h").alias("last")).orderBy("lang").collect()
    languages = [r["lang"] for r in last]
    if not languages:
        return Filters([], np.zeros((1, 2), np.int64), np.zeros(0))
    bounds = spark.createDataFrame([(r["lang"], k, r["last"]) for k, r in enumerate(last)], "lang string, l int, last long")
    sample = labelled.join(F.broadcast(bounds), "lang").where("h <= last").dropDuplicates(["lang", "h"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letters()
        for batch in batches:
            own = batch.column(0).to_numpy()
            for at, texts in in_chunks(batch.column(1)):
                by: dict[int, list[np.ndarray]] = {}
                for l, t in zip(own[at:].tolist(), texts):
                    by.setdefault(l, []).append(grams(t.decode(), letters))
                for l, parts in by.items():
                    h, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(h), l, np.int32)), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["l", "g", "n"])

    counts = sample.select("l", F.col("text").cast("binary").alias("t")).mapInArrow(frugal(count), "l int, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("l"))
    profile = counts.withColumn("r", rate).withColumn("most", F.max("r").over(Window.partitionBy("g"))).where(F.col("r") >= SHARE * F.col("most")).select("l", "g")
    profile = profile.persist()
    distinct = profile.select("g").distinct().count()
    size = min(SLOTS, 1 << max(10, int(8 * distinct).bit_length()))
    slot = [F.shiftright(F.col("g"), 5 + 29 * k).bitwiseAND(F.lit(size - 1)) for k in range(PROBES)]
    bit = F.expr(f"shiftleft(1L, l % {WORD})")
    marks = profile.select(F.floor(F.col("l") / WORD).cast("int").alias("w"), F.explode(F.array(*slot)).alias("slot"), bit.alias("bit"))
    table = marks.groupBy("w", "slot").agg(F.bit_or("bit").alias("mask")).toArrow()
    profile.unpersist()
    slots = np.zeros((-(-len(languages) // WORD), size), np.int64)
    slots[table["w"].to_numpy(), table["slot"].to_numpy()] = table["mask"].to_numpy()
    fill = np.array([np.count_nonzero(slots[l // WORD] & np.int64(1 << l % WORD)) / size for l in range(len(languages))])
    return Filters(languages, slots, np.minimum(fill**PROBES, 0.999))


def identify(docs: DataFrame, filters: Filters, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but none named) with ``lang_pred``, ``score`` and ``rate``.

    ``score`` is the language's part of all corrected counts, ``rate`` the part of the text's n-grams
    that its profile holds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    keep = docs.columns if keep is None else keep
    own = keep.index(text) if text in keep else len(keep)  # a kept text isn't sent twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, letters = shared.value, _letters()
        for batch in batches:
            names, scores, rates = [], [], []
            for _, texts in in_chunks(batch.column(own)):
                for t in texts:
                    h = grams(t.decode() if isinstance(t, bytes) else t, letters)
                    counts = model.counts(h) if len(h) and model.languages else np.zeros(1)
                    best, total = int(np.argmax(counts)), float(counts.sum())
                    known = total > 0 or len(h) and model.languages
                    names.append(model.languages[best] if known else UNKNOWN)
                    scores.append(min(1.0, float(counts[best]) / total) if total else 0.0)
                    rates.append(min(1.0, float(counts[best]) / len(h)) if len(h) else 0.0)
            columns = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    columns = [F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]
    n = len(keep)
    schema = ", ".join([*(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep)), f"c{n} string, c{n + 1} double, c{n + 2} double"])
    more = [] if text in keep else [whole_text(text).alias(f"c{n}")]
    out = docs.select(*columns, *more).mapInArrow(frugal(run), schema)
    return out.toDF(*keep, "lang_pred", "score", "rate")


def predict(docs: DataFrame, *, rows: int = ROWS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Language of every document, learned from the rows that aren't held out."""
    filters = learn(docs.where(~held_out(key)), rows=rows, text=text, lang=lang, key=key)
    out = identify(docs.select(key, text), filters, text=text, keep=[key])
    return out.select(key, held_out(key).alias("held_out"), "lang_pred", "score", "rate")
