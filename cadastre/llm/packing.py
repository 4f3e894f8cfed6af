"""Best-two-fit packing of token pieces into sequences of a fixed length.

Every document is encoded, closed with an end id and cut into pieces of at most ``size`` tokens. Pieces
of one length are interchangeable, so the packing is planned on the counts of lengths, at most ``size``
numbers whatever the corpus holds: a bin is filled greedily from the longest length down, then its
smallest piece gives way to two unpacked ones that fit the widened gap more tightly. A planned bin is
repeated while the counts allow it. The plan says which numbers of each length go to which bins; pieces
are numbered per length in (length, bucket) parts, so a length with a third of all pieces is no hot key.

A null or empty text is a document of the end id alone. Repeated rows are packed as documents of their
own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadastre.llm.text import frugal, in_chunks, whole_text
from cadastre.llm.tokens import Pieces, vocabulary
from cadastre.operators.history import number_rows
from cadastre.session import cut_lineage

SIZE = 1024
END = 2
#: rows of one length that are numbered in one task
NUMBERED = 100_000


def as_bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def pieces_of(docs: DataFrame, *, size: int = SIZE, end: int = END, text: str = "text", key: str = "doc_id", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces (piece, start, length, ids_crc32) of every document; the first one takes the remainder."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Pieces.of_worker(path, as_bytes)
        close = np.array([end], "<u4").tobytes()
        for batch in batches:
            for first, texts in in_chunks(batch.column(1)):
                rows: list[tuple] = []
                for k, t in enumerate(texts):
                    whole = t.decode()
                    direct = encoder.ids(whole)
                    parts = next(encoder.of([whole])) if direct is None else [as_bytes(direct)]
                    ids = b"".join([*parts, close])
                    total = len(ids) // 4
                    start, stop = 0, total % size or size
                    for piece in range(-(-total // size)):
                        own = ids[4 * start : 4 * stop]
                        rows.append((first + k, piece, start, stop - start, zlib.crc32(own), own if with_ids else None))
                        start, stop = stop, stop + size
                at, piece, start, length, crc, own = zip(*rows)
                columns = [batch.column(0).take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                yield pa.record_batch([*columns, pa.array(own, pa.binary())] if with_ids else columns, [*names, "ids"] if with_ids else names)

    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""
    return rows.mapInArrow(frugal(run), f"id {kind}, piece int, start long, length long, ids_crc32 long{extra}").withColumnRenamed("id", key)


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[list[int], int]]:
    """Bins as (lengths, times) that use up the counts of lengths."""
    left = dict(sorted(counts.items(), reverse=True))
    bins: list[tuple[list[int], int]] = []

    def longest(gap: int, used: Counter) -> int | None:
        return next((n for n in left if n <= gap and left[n] > used[n]), None)

    def tightest(low: int, high: int, used: Counter) -> tuple[int, int] | None:
        """Two free lengths with the largest sum above ``low`` and at most ``high``."""
        free = [n for n in left if left[n] > used[n]]
        best, at = None, len(free) - 1
        top = low
        for k, a in enumerate(free):  # a falls while its largest partner grows
            while at > 0 and a + free[at - 1] <= high:
                at -= 1
            if at < k:
                at = k
            for b in free[at : at + 2]:
                if b <= a and top < a + b <= high and (a != b or left[a] > used[a] + 1):
                    best, top = (a, b), a + b
            if top == high:
                break
        return best

    while left:
        taken: list[int] = []
        used: Counter = Counter()
        gap = size
        while (n := longest(gap, used)) is not None:
            taken.append(n)
            used[n] += 1
            gap -= n
        if gap and len(taken) > 1:
            smallest = taken[-1]
            used[smallest] -= 1
            if two := tightest(smallest, gap + smallest, used):
                taken = [*taken[:-1], *two]
                used.update(two)
            else:
                used[smallest] += 1
        times = min(left[n] // k for n, k in used.items() if k)
        bins.append((taken, times))
        for n, k in used.items():
            if k:
                left[n] -= k * times
                if not left[n]:
                    del left[n]
    return bins


def slots(bins: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number, first sequence, offset) of each place in a planned bin.

    The places of one length in one bin are listed apart, each with a run of numbers of its own.
    """
    given: Counter = Counter()
    out = []
    sequence = 0
    for lengths, times in bins:
        offset = 0
        for n in lengths:
            out.append((n, given[n] + 1, given[n] + times, sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, *, size: int = SIZE, key: str = "doc_id") -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; sequences are filled without gaps from 0."""
    spark = pieces.sparkSession
    rows = cut_lineage(pieces)
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(best_two_fit(counts, size))
    # the plan has a few rows for each of at most ``size`` lengths, so it may be broadcast
    table = spark.createDataFrame(plan, "at long, low long, high long, base long, offset long")
    buckets = max(1, -(-max(counts.values(), default=0) // NUMBERED))
    # the rows lie in a checkpoint, so their positions stay the same and spread repeated rows as well
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets))
    numbered = number_rows(rows.withColumn("spread", spread), ["length"], [key, "piece", "ids_crc32"], F.col("spread")).drop("spread")
    inside = (F.col("length") == F.col("at")) & F.col("number").between(F.col("low"), F.col("high"))
    placed = numbered.join(F.broadcast(table), inside)
    return placed.withColumn("sequence_id", F.col("base") + F.col("number") - F.col("low")).drop("at", "low", "high", "base", "number")


def pack_documents(docs: DataFrame, *, size: int = SIZE, end: int = END, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    pieces = pieces_of(docs, size=size, end=end, text=text, key=key, path=path)
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(pieces, size=size, key=key).select(*columns)
