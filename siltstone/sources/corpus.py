"""Corpora, judgements, claims."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.staging import positions


def evidence_ids(qrels: DataFrame) -> DataFrame:
    """Distinct doc_id with a positive relevance."""
    return qrels.where("relevance > 0 and doc_id is not null").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()


def load_corpus(documents: DataFrame, qrels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(doc_id, title, text), only evidence documents if qrels is given; the first `limit` in the order of the ids as numbers."""
    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    if qrels is not None:
        docs = docs.join(evidence_ids(qrels), "doc_id", "left_semi")
    return docs if limit is None else docs.orderBy(F.col("doc_id").try_cast("bigint"), "doc_id").limit(max(0, limit))


def indexed_ids(documents: DataFrame, qrels: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    return load_corpus(documents, qrels, limit).select("doc_id")


def qa_pairs(qrels: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """A row per distinct positive judgement with the claim's and the document's text; '' for what is missing."""
    q = queries.groupBy("query_id").agg(F.min("text").alias("claim"))
    d = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("evidence"))
    pairs = qrels.where("relevance > 0").select("query_id", "doc_id").distinct()
    out = pairs.join(q, "query_id", "left").join(d, "doc_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(F.col("query_id").alias("Query_ID"), text("claim").alias("Claim_Text"), F.col("doc_id").alias("Evidence_Doc_ID"), text("evidence").alias("Evidence_Text"))


def claims(queries: DataFrame, qrels: DataFrame, indexed: DataFrame | None = None) -> DataFrame:
    """(claim_id, text, ground_truth_doc_ids): claims with evidence, of which only indexed documents count."""
    good = qrels.where("relevance > 0 and doc_id is not null").select("query_id", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    if indexed is not None:
        good = good.join(indexed.select("doc_id").distinct(), "doc_id", "left_semi")
    truth = good.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("ground_truth_doc_ids"))
    q = queries.groupBy("query_id").agg(F.min("text").alias("text"))
    return q.join(truth, "query_id").select(F.col("query_id").alias("claim_id"), F.coalesce("text", F.lit("")).alias("text"), "ground_truth_doc_ids")


def sample_claims(df: DataFrame, n: int | None, seed: int = 42, most: int = 1_000_000) -> DataFrame:
    """n claims without replacement, the same for a seed whatever the partitions: positions drawn from the sorted ids.

    None or n at least their number: all; n below 1: none. Only the n positions are sent, at most `most` of them.
    """
    if n is None:
        return df
    if n < 1:
        return df.limit(0)
    total = df.count()
    if n >= total:
        return df
    if n > most:
        raise ValueError(f"a sample of more than {most}")
    picked = df.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(total), n)], "at long")
    numbered = positions(df.select("claim_id"), [F.col("claim_id").cast("string")], "at")
    return df.join(numbered.join(F.broadcast(picked), "at", "left_semi").select("claim_id"), "claim_id", "left_semi")


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
