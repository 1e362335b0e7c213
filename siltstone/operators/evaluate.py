"""Hits, reciprocal ranks, precision; comparisons of runs; statistics of chunks and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def relevance(results: DataFrame, claims: DataFrame) -> DataFrame:
    """results (claim_id, rank, doc_ids, ...) with relevant: does any of the slot's documents belong to the claim's truth?"""
    return results.join(claims.select("claim_id", "ground_truth_doc_ids"), "claim_id").withColumn("relevant", F.coalesce(F.arrays_overlap("doc_ids", "ground_truth_doc_ids"), F.lit(False)))


def per_claim(results: DataFrame, claims: DataFrame, k: int = 3, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, claim_id, hit, first_rank, rr, precision): slots up to rank k; precision is divided by k. Claims without results miss."""
    r = relevance(results, claims).where(F.col("rank") <= k)
    got = r.groupBy(*keys, "claim_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.sum(F.col("relevant").cast("int")).alias("n_rel"))
    base = claims.select("claim_id")
    if keys:
        base = got.select(*keys, "claim_id")
    rows = base.join(got, [*keys, "claim_id"], "left")
    precision = F.coalesce(F.col("n_rel"), F.lit(0)) / F.lit(float(k)) if k > 0 else F.lit(0.0)
    return rows.select(*keys, "claim_id", F.col("first_rank").isNotNull().alias("hit"), "first_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("rr"), precision.alias("precision"))


def summary(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, total_claims, hits, hit_at_k, mrr, precision_at_k); 0.0 without claims."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    hit = F.col("hit").cast("int")
    return rows.groupBy(*keys).agg(F.count("*").alias("total_claims"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"), mean(hit).alias("hit_at_k"), mean("rr").alias("mrr"), mean("precision").alias("precision_at_k"))


def contingency(a: Column, b: Column) -> list[Column]:
    """Counts of claims that both, one, or neither of two runs hit, and the difference of their rates in points."""
    n = lambda c: F.count_if(c)
    return [
        F.count("*").alias("claims"), n(a & b).alias("both"), n(a & ~b).alias("only_a"), n(~a & b).alias("only_b"), n(~a & ~b).alias("neither"),
        F.round((F.avg(b.cast("int")) - F.avg(a.cast("int"))) * 100, 4).alias("delta_points"),
    ]


def matrix(cells: DataFrame, modes: list[str], metric: str = "hit_at_k") -> DataFrame:
    """A row per collection, a column per requested mode."""
    return cells.groupBy("collection").pivot("mode", modes).agg(F.first(metric))


def details(results: DataFrame, claims: DataFrame, k: int = 3) -> DataFrame:
    """(claim_id, ground_truth, hits): a row per claim with its slots in order of rank."""
    r = relevance(results, claims).where(F.col("rank") <= k)
    slot = F.struct("rank", F.array_join("doc_ids", "|").alias("doc_ids"), "score", "relevant")
    return r.groupBy("claim_id").agg(F.array_join(F.first("ground_truth_doc_ids"), ",").alias("ground_truth"), F.array_sort(F.collect_list(slot)).alias("hits"))


def token_stats(chunks: DataFrame, low: int = 256, high: int = 512) -> DataFrame:
    """One row: count, least, greatest, mean, median, sample deviation (0 for one), share in the range in percent."""
    t = F.col("token_count")
    return chunks.where(t.isNotNull()).agg(
        F.count("*").alias("n"), F.min(t).alias("least"), F.max(t).alias("greatest"), F.round(F.avg(t), 4).alias("mean"), F.median(t).alias("median"),
        F.round(F.coalesce(F.stddev_samp(t), F.lit(0.0)), 4).alias("deviation"), F.round(F.avg(t.between(low, high).cast("int")) * 100, 4).alias("in_range"),
    )


def auxiliary_stats(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, avg_tokens, median_tokens); a count that is null or 0 is counted again from the text."""
    t = F.coalesce(F.when(F.col("token_count") != 0, F.col("token_count")), tx.word_count(F.col("text")))
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.round(F.avg(t), 1).alias("avg_tokens"), F.floor(F.median(t)).cast("int").alias("median_tokens"))


def topic_histogram(chunks: DataFrame) -> DataFrame:
    """(topic_id, n, label, first_chunk): size of each topic, its label and chunk that come first by id."""
    named = F.min_by(F.when(F.col("topic_label") != "", F.col("topic_label")), F.when(F.col("topic_label") != "", F.col("chunk_id")))
    return chunks.groupBy("topic_id").agg(F.count("*").alias("n"), named.alias("label"), F.min("chunk_id").alias("first_chunk"))


def orphans(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(topic_id, side): topics of anchors that no chunk has, and of chunks (from 0) that have no anchor."""
    a, c = anchors.select("topic_id").where("topic_id is not null").distinct(), chunks.where("topic_id >= 0").select("topic_id").distinct()
    return a.join(c, "topic_id", "left_anti").withColumn("side", F.lit("anchors")).unionByName(c.join(a, "topic_id", "left_anti").withColumn("side", F.lit("chunks")))


def coverage(chunks: DataFrame, *arrays: str) -> DataFrame:
    """How many rows have anything in each array column."""
    return chunks.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0).alias(f"with_{c}") for c in arrays])


def boundary_decisions(sims: DataFrame, least: float = 0.55) -> DataFrame:
    """Comparisons made and boundaries found."""
    return sims.agg(F.count("*").alias("comparisons"), F.count_if(F.col("similarity") < least).alias("boundaries"))


def first_examples(details_: DataFrame, order: str = "claim_id") -> DataFrame:
    """The first claim that only the second run hits, the first hit and the first miss of the second run."""
    kinds = {"gained": ~F.col("baseline_hit") & F.col("enriched_hit"), "hit": F.col("enriched_hit"), "miss": ~F.col("enriched_hit")}
    rows = details_.select("*", F.explode(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()])).alias("example")).where("example is not null")
    w = Window.partitionBy("example").orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def sample_chunks(chunks: DataFrame, n: int = 2, seed: int | None = None) -> DataFrame:
    """n chunks at random, for a look at them."""
    return chunks.orderBy(F.rand(seed)).limit(n)
