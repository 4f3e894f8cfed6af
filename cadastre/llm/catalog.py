"""Queries of the subpackage, in the form ``__spark_entry__`` registers them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadastre.llm import centroids, decontaminate, embeddings, hard_negatives, jaccard, language, licenses, packing, pii, quality, sharding, tokens, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_weak_supervision_pii")
def op1(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


@query("op2_best_two_fit_packing")
def op2(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op3_latent_decontamination")
def op3(spark, sf_dir):
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_bitmask_filters")
def op5(spark, sf_dir):
    return language.predict(table(spark, sf_dir, "documents"))


@query("op6_pivot_permutation_near_copies")
def op6(spark, sf_dir):
    return embeddings.near_copies(table(spark, sf_dir, "embeddings"))


@query("op7_two_tier_token_counts")
def op7(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


@query("op9_metric_space_jaccard_join")
def op9(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), words=4, percent=85).drop("d")


@query("op4_extendible_hash_shards", oracle=sharding.ORACLE)
def op4(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op8_minhash_license_scan")
def op8(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_factorisation_machine_quality")
def op10(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_va_file_clustering", oracle=centroids.ORACLE)
def op13(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op12_inverted_multi_index_negatives", oracle=hard_negatives.ORACLE)
def op12(spark, sf_dir):
    return hard_negatives.mine(hard_negatives.relabelled(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


@query("op11_string_kernel_toxicity")
def op11(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
