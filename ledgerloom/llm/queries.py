"""One query per operator over its whole table, and SQL counterparts where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (ann, bpe, html, impact, mixing, pivots, quality, secrets, sharding, simhash,
               spelling, training_order, whitening)

QUERIES = {}
SQL = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_byte_bpe(spark, sf_dir):
    coded = bpe.encode(table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), decode=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_simhash(spark, sf_dir):
    return simhash.near_copies(table(spark, sf_dir, "documents"))


@query
def op2_credential_links(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE),
                        F.sha2(secrets.as_text(F.col("base")), 256).alias("base_sha256"),
                        secrets.as_text(F.col("spans")).alias("spans"))


SQL["op2_credential_links"] = secrets.oracle()


@query
def op9_sampled_splitters(spark, sf_dir):
    return sharding.by_text(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_curriculum(spark, sf_dir):
    return mixing.schedule(table(spark, sf_dir, "documents"))


SQL["op5_curriculum"] = mixing.ORACLE


@query
def op8_quality_trees(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_host_consensus(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op4_pivot_permutations(spark, sf_dir):
    return pivots.near_copies(table(spark, sf_dir, "embeddings"))


@query
def op6_adaptive_scan(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op1_training_order(spark, sf_dir):
    index, _ = training_order.write_shards(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), secret=2026)
    return index


@query
def op11_impact_order(spark, sf_dir):
    return impact.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL["op11_impact_order"] = impact.ORACLE


@query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


SQL["op13_spelling_variants"] = spelling.ORACLE
