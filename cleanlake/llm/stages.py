"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir), applies one operator to all of docs and returns the columns of docs.

A row is named by its file and place, so rows that repeat an identifier are judged one by one; only near duplicates are named by
doc_id, as their operator does. Rows to drop are joined by that name, broadcast when a count proves them few; numbers of copies are
packed by file and block first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleanlake.core import c
from cleanlake.llm import exact_dedup, jaccard_join, langid, lattice, mixing
from cleanlake.llm.common import arrow_rows, checked_broadcast, located, placed, stored, unused

WORDS, PERCENT = 5, 80      # of the near-duplicate stage; those of op10 are its own


def _without(docs: DataFrame, dropped: DataFrame, at: str, columns: list[str]) -> DataFrame:
    return docs.join(checked_broadcast(stored(dropped, "stage-dropped")), at, "left_anti").select(*[c(x) for x in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in none of the languages: blank texts and texts that fit the unknown language best."""
    at = unused(docs, "__at")
    rows = located(docs, at)
    found = langid.identify(langid.document_evidence(rows, id_col=at))
    return _without(rows, found.where("not kept").select(F.col("id").alias(at)), at, docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of each group of equal texts."""
    at = unused(docs, "__at")
    rows = located(docs, at)
    base = rows.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col(at).alias("at"))
    return _without(rows, exact_dedup.grouped(base).where(F.col("at") != F.col("keep.at")).select(F.col("at").alias(at)), at, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class of near duplicates. Rows that repeat a doc_id go only if each of them is a near copy."""
    classes = jaccard_join.classes(docs, words=WORDS, percent=PERCENT)
    gone = classes.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("gone")).where("gone").select("doc_id")
    return docs.join(checked_broadcast(stored(gone, "stage-near")), "doc_id", "left_anti").select(*[c(x) for x in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near their target shares of the words."""
    at, n = unused(docs, "__at"), unused(docs, "__copies")
    rows = located(docs, at)
    copies = mixing.copies(rows, id_col=at).select(F.col("doc_id").alias(at), F.col("copies").alias(n))
    chosen = placed(rows, copies, at, n).where(F.col(n) > 0)
    return chosen.select(*[c(x) for x in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(n)).select(*[c(x) for x in docs.columns])


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, sample, ids, log_prob, log_inclusion: sampled segmentations of every document of the mix."""
    with arrow_rows(spark, 256):      # holds for jobs that run here, hence the table
        return stored(lattice.encode(docs).withColumnRenamed("row_key", "doc_id"), "stage-pieces")
