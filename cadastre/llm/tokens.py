"""Token counts through a broadcast table of frequent pre-tokens and a cache in every worker.

Texts are cut before spaces where the tokenizer's own pattern always has a border, so the tokens of a
text are those of its pieces. Each piece is looked up in two tiers: the broadcast table of frequent
pieces, then the worker's cache; what neither has is encoded by the tokenizer in one batch and cached.
No piece of the whole corpus is ever shuffled: only a bounded sample of rows is counted to fill the
broadcast table, which changes the speed and never a count.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results, an empty table
gives none, and other columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cadastre.llm.text import frugal, bounded_rows, in_chunks, whole_text

#: rows from which frequent pieces are chosen, and how many of them are broadcast (a few MB at most)
SAMPLE_ROWS = 2_000
FREQUENT = 50_000
#: entries of a worker's cache before it starts anew, and the longest piece that is kept
CACHE = 200_000
LONGEST = 48


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def plain_ranks(model: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file whose merges are ranked by id; None for other files."""
    if model["normalizer"] or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"] for t in model["added_tokens"]}
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    made = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
    if any(vocab[m] != 256 + k for k, m in enumerate(made)):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}


class Pieces:
    """Values of a text's pieces. ``value`` turns the ids of one piece into what is kept of them.

    New pieces of Latin letters, digits and marks are encoded together, a line for each, by the faster
    of two libraries that give the same ids for such a file; all others by the tokenizer itself.
    """

    held: dict[tuple, Pieces] = {}

    def __init__(self, path: str, value: Callable[[np.ndarray], object], frequent: dict | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        import public_tokenizers
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        ranks = plain_ranks(model)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.fast = ranks and tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.line = ranks and ranks[b"\n"]
        self.value = value
        self.frequent = frequent or {}
        self.known = dict(self.frequent)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @classmethod
    def of_worker(cls, path: str, value: Callable[[np.ndarray], object], frequent: Callable[[], dict] = dict) -> Pieces:
        """The worker's own instance, so that its cache serves one task after the other."""
        name = path, value.__qualname__
        if name not in cls.held:
            cls.held[name] = cls(path, value, frequent())
        return cls.held[name]

    def encode(self, pieces: list[str]) -> Iterator[tuple[str, object]]:
        simple = [p for p in pieces if p[0] == " " and (p.isascii() or max(p) < "\u0180") and len(p.split()) == 1 and not p[-1].isspace()] if self.fast else []
        joined = "\n".join(simple)
        if any(t in joined for t in self.special):
            simple, joined = [], ""
        if simple:
            ids = self.fast.encode_to_numpy(joined)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
            start = 0
            for p, end in zip(simple, ends, strict=True):
                yield p, self.value(ids[start:end])
                start = end + 1
        rest = list(set(pieces).difference(simple))
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            yield p, self.value(np.array(e.ids, np.uint32))

    def ids(self, text: str) -> np.ndarray | None:
        """Ids of a text of Latin-1 characters without special strings; None where ``of`` must be asked."""
        if not self.fast or any(t in text for t in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return self.fast.encode_to_numpy(text)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that join to the text; each but the first begins with a space."""
        return [p for p in text.replace(" ", "\0 ").split("\0") if p]

    def of(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its pieces, in order.

        A space that more white space follows is no border by itself; a text with one is encoded whole.
        """
        cuts = [self.cut(t) if "\0" not in t else [" "] for t in texts]
        fresh = set().union(*cuts).difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known = dict(self.frequent)
            fresh = set().union(*cuts).difference(self.known)
        odd = [p for p in fresh if p == " " or p[0] == " " and p[1].isspace()]
        self.known.update(dict.fromkeys(odd))
        plain = list(fresh.difference(odd))
        for k in range(0, len(plain), 20_000):
            self.known.update(self.encode(plain[k : k + 20_000]))
        look = self.known.__getitem__
        for text, pieces in zip(texts, cuts):
            values = list(map(look, pieces))
            yield [self.value(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))] if None in values else values
        for piece in fresh:
            if len(piece) > LONGEST:
                del self.known[piece]


def frequent_table(docs: DataFrame, path: str, text: str, key: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Compact table (joined UTF-8 pieces, ends, token counts) of the sample's most frequent pieces."""
    sample = bounded_rows(docs.select(key, text), key, SAMPLE_ROWS)
    pieces = sample.select(F.explode(F.split(whole_text(text), " ")).alias("p")).where("p <> '' and length(p) < 48")
    top = pieces.groupBy("p").count().orderBy(F.desc("count"), "p").limit(FREQUENT).select("p").toArrow()["p"].to_pylist()
    encoder = Pieces(path, len)
    led = [f" {p}" for p in top if not p[0].isspace()]
    counts = [row[0] for row in encoder.of(led)]
    blobs = [p.encode() for p in led]
    return b"".join(blobs), np.cumsum([len(b) for b in blobs], dtype=np.uint32), np.array(counts, np.uint16)


def unpack(table: tuple[bytes, np.ndarray, np.ndarray]) -> dict[str, int]:
    blob, ends, counts = table
    bounds = [0, *ends.tolist()]
    return {blob[a:b].decode(): n for a, b, n in zip(bounds[:-1], bounds[1:], counts.tolist())}


def count_tokens(docs: DataFrame, *, limit: int = 512, text: str = "text", key: str = "doc_id", path: str | None = None) -> DataFrame:
    """Per document: id, UTF-8 bytes, tokens and whether there are more than ``limit``."""
    path = path or vocabulary()
    table = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, text, key))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of_worker(path, len, lambda: unpack(table.value))
        for batch in batches:
            counts: list[int] = []
            for _, texts in in_chunks(batch.column(1)):
                counts += [sum(row) for row in pieces.of([t.decode() for t in texts])]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("id"), whole_text(text).cast("binary").alias("t"), F.octet_length(whole_text(text)).cast("long").alias("n_bytes"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(frugal(run), f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
