"""Queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe, langid, linededup, lsh, multiset, pareto, quality_pu, shardtree, simhash, toxicity
from tokenloom.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.equal_sets(multiset.fingerprint(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shardtree.assign(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.groups(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_embeddings_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors and made-up copies of some, as test tables may hold no near copies of their own."""
    return lsh.groups(lsh.with_copies(table(spark, sf_dir, "embeddings"))).withColumnRenamed("id", "vec_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.strip_lines(table(spark, sf_dir, "documents"), removed="removed_lines").select("doc_id", "text", "removed_lines")


def op8_line_dedup_proven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As the pipeline does it: only proven mirrors keep boilerplate lines."""
    docs = table(spark, sf_dir, "documents")
    return linededup.strip_lines(docs, spare_mirrors=True, removed="removed_lines").select("doc_id", "text", "removed_lines")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto.draw(table(spark, sf_dir, "documents")).select("doc_id", "source", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_fingerprints,
        op3_toxicity,
        op4_sharding,
        op5_simhash,
        op6_language,
        op7_embeddings,
        op7_embeddings_copies,
        op8_line_dedup,
        op8_line_dedup_proven,
        op9_bpe,
        op10_mixing,
    )
}

ORACLES: dict[str, str] = {
    "op2_fingerprints": multiset.oracle(),
    "op4_sharding": shardtree.oracle(),
    "op7_embeddings": lsh.oracle(),
    "op7_embeddings_copies": lsh.oracle(copies=True),
    "op8_line_dedup": linededup.oracle(),
    "op8_line_dedup_proven": linededup.oracle(spare_mirrors=True),
    "op10_mixing": pareto.oracle(),
}
