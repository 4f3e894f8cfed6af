"""Helpers shared by the text operators: null-safe columns, shingle keys, bounded samples."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: characters of text that a task turns into words at a time; a longer text is one piece of its own
CHUNK_CHARS = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A map over Arrow batches whose worker gives memory back to the system when a task ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def whole_text(text: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def in_chunks(texts: pa.Array, size: int = CHUNK_CHARS) -> Iterator[tuple[int, list]]:
    """(first row, texts as the column has them) of runs of rows of about ``size`` bytes or characters."""
    held: list = []
    first = total = 0
    for k, text in enumerate(texts):
        value = text.as_py() or b""
        held.append(value)
        total += len(value)
        if total >= size:
            yield first, held
            held, first, total = [], k + 1, 0
    if held:
        yield first, held


def plain_words(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z) without ASCII marks."""
    return text.translate(_LOWER, _MARKS).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles_of(h: np.ndarray, words: int) -> np.ndarray:
    """Hash of each run of ``words`` word hashes; fewer words make one run, none make none."""
    if not len(h):
        return h
    span = min(words, len(h))
    last = len(h) - span + 1
    acc = h[:last] ^ np.uint64(span)
    for k in range(1, span):
        acc = acc * _STEP + h[k : k + last]
        acc ^= acc >> _SHIFT
    return acc * _STEP


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, lower-cased in A-Z.

    Words are what ASCII white space separates. A text of fewer words is one shingle; one without
    words has none. Equal hashes stand for equal shingles (about 2^-64 a pair that they don't).
    """
    return np.unique(shingles_of(word_hashes(text.lower().split()), words))


def bounded_rows(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those whose key has the smallest hash, one for each key."""
    spread = F.xxhash64(F.col(key))
    last = df.select(spread.alias("h")).distinct().orderBy("h").limit(rows).agg(F.max("h").alias("last")).first()["last"]
    if last is None:
        return df.limit(0)
    return df.where(spread <= last).dropDuplicates([key])


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """The rows, marked for broadcast where there are at most ``rows``; a larger side is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(column: Column) -> Column:
    """crc32 of an id's decimal text modulo 4, by which labelled rows are dealt to folds."""
    return F.crc32(column.cast("string").cast("binary")) % 4


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows kept out of training; a null id is trained on as any other."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(fold(column) == 2, F.lit(False))
