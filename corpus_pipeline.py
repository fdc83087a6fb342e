"""Corpus pipeline: language ID, line dedup, near-dedup, mixing and BPE encoding, each stage on what the one before kept.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of docs. A stage's
tables are deleted when its result is stored, or when it fails.

Defined cases, as in each operator's docstring: a null or letterless text has no language and goes in the first stage; a
text made of boilerplate alone goes on empty and is never drawn by the mixing stage; repeated rows of one id are one
document from near-dedup on, the row of the least text stays; very long texts are read whole; language ties are
ambiguous and go; drawing ties fall on one side; an empty table gives an empty result; clashing columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenloom.llm import bpe, langid, linededup, pareto, simhash
from tokenloom.llm.common import outliving, scratch, stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with an ambiguous one."""
    return langid.accepted(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes cross-site boilerplate lines out of all texts but proven mirrors; keeps every document, if with empty text."""
    return linededup.strip_lines(docs, spare_mirrors=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return simhash.deduped(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the sources meet their target weights; certain whole copies become repeated rows."""
    return pareto.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a flag that they decode to its text."""
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Language ID and near-dedup cannot be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, not yet computed: the table they are made from stays until common.released()."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            if kept is not None:
                made.append(kept)
            docs, path = stored(stage(spark, docs, sf_dir), name)
            kept = outliving(path)
    return STAGES[-1][1](spark, docs, sf_dir)
