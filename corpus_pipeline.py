"""Corpus cleaning in stages; each takes (spark, docs, sf_dir), and its result is the next one's input.

Language identification, near copies, benchmark passages, personal data, packing. Every stage reads all
its predecessor kept; all but the last return the columns they were given. Between stages the documents
are written as Parquet to the session's checkpoint folder and read again, so a lost executor costs at
most the stage it was in.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastre.llm import decontaminate, jaccard, language, packing, pii
from cadastre.llm.text import broadcast_if_small
from cadastre.session import configure, cut_lineage, ensure_checkpoint_dir

#: part of a text's n-grams that its language's profile must hold for the document to stay
LEAST_RATE = 0.25


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those that no learned language explains.

    Profiles come from the labelled rows of the documents themselves; without any, only letterless
    texts go.
    """
    filters = language.learn(docs)
    if not filters.languages:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    found = language.identify(docs.withColumnsRenamed({c: f"c_{c}" for c in docs.columns}), filters, text="c_text")
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("rate") >= LEAST_RATE))
    return kept.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by shingle sets, the one with the smallest id.

    Texts without words are no copies of each other. Repeated rows are copies.
    """
    place = F.struct("doc_id", F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"))
    marked = docs.withColumn("place__", place)
    groups = jaccard.similar_groups(marked.select("place__", "text"), words=5, percent=80, key="place__")
    verdict = groups.groupBy("place__").agg(F.max(F.col("place__") != F.col("component_id")).alias("copy__"), (F.count("*") * F.max(F.col("n_shingles") > 0).cast("int") > 1).alias("again__"))
    going = broadcast_if_small(cut_lineage(verdict.where("copy__ or again__")))
    joined = marked.join(going, "place__", "left")
    alone = joined.where("copy__ is null").select(*docs.columns)
    again = joined.where("not copy__ and again__").dropDuplicates(["place__"]).select(*docs.columns)
    return alone.unionByName(again)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.remove(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("benchmark", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can't express the trained stages; their operators and stages are tested one by one, not yet the whole run
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    folder = os.path.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
