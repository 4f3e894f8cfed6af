"""Shards by extendible hashing: a bucket is split on one more hash bit only while it is too large.

A row's bits are 60 bits of its key's hash, then, for rows that share a key, bits of a hash of their
place. Bytes are summed for every prefix of a fine histogram; a bucket is the shortest prefix whose rows
fit the limit. Buckets that are still too large at the histogram's depth get a deeper one of their own.
All work is DataFrame operations; the histogram has a number of rows that follows the number of shards.

A null key hashes as the empty string, a null text has 0 bytes. Repeated rows are kept and may go to
different shards. One row above the limit makes a shard of its own. An empty table gives no rows. Other
columns are ignored by ``assign``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from cadastre.session import cut_lineage

#: bytes of text in a shard
LIMIT = 1 << 20
#: bits of a hash, and bits that a histogram is finer than the expected depth
BITS = 60
FINER = 6


def hash_bits(value: Column) -> Column:
    """60-bit number from the MD5 of a value's text."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(hash_: str, depth: Column | int) -> Column:
    return F.expr(f"shiftright({hash_}, {BITS} - {depth})") if isinstance(depth, (int, str)) else F.shiftright(hash_, BITS - depth)


def _split(rows: DataFrame, hash_: str, start: int, depth: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows that found a bucket between the two depths, and those whose bucket is still too large."""
    cells = rows.groupBy("held", _prefix(hash_, depth).alias("cell")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
    each = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn("p", F.expr(f"shiftright(cell, {depth} - depth)"))
    sums = each.groupBy("held", "depth", "p").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
    fits = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    found = each.select("held", "cell", "depth", "p").join(fits, ["held", "depth", "p"])
    leaf = found.groupBy("held", "cell").agg(F.min(F.struct("depth", "p", "shard_bytes", "shard_docs")).alias("leaf"))
    placed = cut_lineage(rows.withColumn("cell", _prefix(hash_, depth)).join(leaf, ["held", "cell"], "left"))
    done = placed.where("leaf is not null").select(
        "id", "n_bytes", F.concat("held", F.lpad(F.bin("leaf.p"), F.col("leaf.depth"), F.lit("0"))).alias("shard"), (F.col("leaf.depth") + F.length("held")).cast("int").alias("depth"), "leaf.shard_bytes", "leaf.shard_docs"
    )
    return done, placed.where("leaf is null").select(*rows.columns)


def assign(docs: DataFrame, *, limit: int = LIMIT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, ``n_bytes``, ``shard`` (its prefix bits), ``depth`` and the shard's bytes and rows."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = cut_lineage(docs.select(F.col(key).alias("id"), hash_bits(F.col(key)).alias("by_key"), size.alias("n_bytes"), F.lit("").alias("held")))
    # the rows lie in a checkpoint, so their places stay the same
    rows = rows.withColumn("by_place", hash_bits(F.monotonically_increasing_id()))
    total = rows.agg(F.sum("n_bytes").alias("b")).first()["b"] or 0
    depth = max(0, math.ceil(math.log2(max(1.0, total / limit)))) + FINER
    parts: list[DataFrame] = []
    for hash_ in ("by_key", "by_place"):
        start, end = (0, min(BITS, depth)) if hash_ == "by_key" else (1, min(BITS, depth))
        while True:
            done, rows = _split(rows, hash_, start, end, limit)
            parts.append(done)
            if end == BITS or rows.isEmpty():
                break
            start, end = end + 1, min(BITS, end + 2 * FINER)
        if rows.isEmpty():
            break
        rows = rows.withColumn("held", F.lpad(F.bin("by_key"), BITS, F.lit("0")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", key)


def directory(shards: DataFrame) -> DataFrame:
    """One entry per bucket: its bits, depth, first directory slot and number of slots at the deepest level."""
    leaves = shards.groupBy("shard", "depth").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias("shard_docs"))
    deepest = leaves.agg(F.max("depth").alias("global_depth"))
    joined = leaves.join(F.broadcast(deepest))
    return joined.withColumn("first_slot", F.rpad("shard", F.col("global_depth"), F.lit("0"))).withColumn("slots", F.pow(F.lit(2.0), F.col("global_depth") - F.col("depth")))


ORACLE = f"""
with rows as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from documents),
depths as (select unnest(range(0, 41)) d),
sums as (select d, h >> ({BITS} - d) p, sum(n_bytes)::bigint b, count(*) n from rows, depths group by 1, 2),
fits as (
  select r.doc_id, r.n_bytes, s.d, s.p, s.b, s.n, row_number() over (partition by r.doc_id order by s.d) k
  from rows r, sums s where s.p = r.h >> ({BITS} - s.d) and (s.b <= {LIMIT} or s.n = 1))
select doc_id, n_bytes, case when d = 0 then '' else lpad(bin(p), d::int, '0') end shard, d::int as depth, b shard_bytes, n shard_docs from fits where k = 1
"""
