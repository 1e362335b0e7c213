"""Chunk, enrich, index and evaluate a corpus by several methods; every stage is kept and may be reused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions.models import Embedder, PairScorer, TokenCounter, embed
from siltstone.operators import chunkers, enrich, evaluate, retrieve, topics
from siltstone.sources import files, store

MODES = ("dense_only", "hybrid")


def search(points: DataFrame, claims: DataFrame, mode: str, k: int = 3, candidates: int | None = None, embedder: Embedder | None = None, scorer: PairScorer | None = None) -> DataFrame:
    """(claim_id, id, score, rank, doc_ids) of a collection for all claims; candidates: so many at least k are re-ranked by pairs."""
    if mode not in MODES:
        raise ValueError(mode)
    rows = points.withColumnRenamed("chunk_id", "id")
    candidates = max(candidates, k) if candidates else None
    asked = embed(claims.select(F.col("claim_id").alias("query_id"), "text"), "text", "vector", embedder)
    far = max(20 * (candidates or k), 32) if mode == "hybrid" else (candidates or k)
    dense = retrieve.dense_topk(asked, rows.select("id", "vector"), far).withColumnRenamed("query_id", "claim_id")
    if mode == "hybrid":
        hits = retrieve.hybrid(dense, retrieve.lexical_hits(claims, rows, limit=far), candidates or k)
    else:
        hits = dense.select("claim_id", "id", F.round("similarity", 4).alias("score"), "rank")
    if candidates:
        pairs = hits.join(claims.select("claim_id", F.col("text").alias("claim")), "claim_id").join(rows.select("id", tx.strip(F.coalesce("text", F.lit(""))).alias("text")), "id")
        hits = retrieve.rerank(pairs, scorer, k)
    return hits.join(rows.select("id", "doc_ids"), "id")


def compare_runs(spark: SparkSession, root: str, claims: DataFrame, enriched: str, baseline: str | None, k: int = 3, **more) -> tuple[DataFrame, bool]:
    """(a row per claim, was the baseline compared): dense search of the baseline against hybrid search of the enriched collection.

    ValueError if the enriched collection is missing; a missing baseline is left out, its hits are then false.
    """
    store.validate(spark, root, [enriched])
    with_base = baseline is not None and store.collection_exists(spark, root, baseline)
    base = store.read_collection(spark, root, baseline) if with_base else None
    return two_runs(base, store.read_collection(spark, root, enriched), claims, k, **more), with_base


def two_runs(baseline: DataFrame | None, enriched: DataFrame, claims: DataFrame, k: int = 3, mode: str = "hybrid", candidates: int | None = None, **more) -> DataFrame:
    """(claim_id, claim_text, ground_truth_doc_ids, baseline_hit, baseline_top_doc_ids, baseline_scores, the same of enriched): a row per claim."""
    out = claims.select("claim_id", F.col("text").alias("claim_text"), "ground_truth_doc_ids")
    runs = {"baseline": None if baseline is None else search(baseline, claims, "dense_only", k, **more), "enriched": search(enriched, claims, mode, k, candidates, **more)}
    for name, hits in runs.items():
        if hits is None:
            out = out.select("*", F.lit(False).alias(f"{name}_hit"), F.array().cast("array<string>").alias(f"{name}_top_doc_ids"), F.array().cast("array<double>").alias(f"{name}_scores"))
            continue
        slots = hits.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.array_join("doc_ids", "|").alias("d"), F.col("score").cast("double").alias("s")))).alias("slots"))  # at most k each
        lists = [F.coalesce(F.col(f"slots.{c}"), F.array().cast(t)).alias(f"{name}_{n}") for c, n, t in (("d", "top_doc_ids", "array<string>"), ("s", "scores", "array<double>"))]
        out = out.join(slots, "claim_id", "left").select(*out.columns, *lists)
        ids = F.split(F.array_join(f"{name}_top_doc_ids", "|"), r"\|")
        out = out.withColumn(f"{name}_hit", F.coalesce(F.arrays_overlap(ids, "ground_truth_doc_ids"), F.lit(False)))
    return out


def evaluate_cell(points: DataFrame, claims: DataFrame, collection: str, mode: str, k: int = 3, candidates: int | None = None, embedder: Embedder | None = None, scorer: PairScorer | None = None) -> DataFrame:
    """One row of the matrix. Hybrid search of a collection without anchor queries is dense search, and says so."""
    fell_back = mode == "hybrid" and not store.has_anchor_queries(points)
    hits = search(points, claims, "dense_only" if fell_back else mode, k, candidates, embedder, scorer)
    rows = evaluate.summary(evaluate.per_claim(hits, claims, k))
    return rows.select(F.lit(collection).alias("collection"), F.lit(mode).alias("mode"), F.lit(fell_back).alias("fell_back"), "*")


def run(
    spark: SparkSession, docs: DataFrame, claims: DataFrame, root: str, methods: list[str], mode: str = "both", k: int = 3,
    skip_chunking: bool = False, skip_enrichment: bool = False, skip_indexing: bool = False, embedder: Embedder | None = None,
    counter: TokenCounter | None = None, scorer: PairScorer | None = None, candidates: int | None = None,
) -> DataFrame:
    """The matrix of methods and modes. Skipped stages are read from `root`, where the others are written."""
    methods = files.validate_methods(methods)
    if mode != "both" and mode not in MODES:
        raise ValueError(mode)
    cells = []
    for m in methods:
        raw, rich = files.stage_path(root, "raw", m), files.stage_path(root, "enriched", m)
        if not skip_chunking:
            labelled = None
            if m == "semantic_gmm":
                sents = embed(chunkers.sentences(docs), "sentence", "vector", embedder)
                labelled, _ = topics.gaussian_topics(sents, "vector")
            chunkers.chunk(docs, m, labelled, counter).write.mode("overwrite").parquet(raw)
        if not skip_enrichment:
            done = enrich.enrich(spark.read.parquet(raw), embedder=embedder)
            done.chunks.write.mode("overwrite").parquet(rich)
            done.anchors.withColumn("k", F.lit(done.optimal_k)).write.mode("overwrite").parquet(files.stage_path(root, "anchors", m))
        if not skip_indexing:
            store.index_chunks(spark.read.parquet(rich), root, m, embedder=embedder)
        store.validate(spark, root, [m])
        points = store.read_collection(spark, root, m)
        cells += [evaluate_cell(points, claims, m, x, k, candidates, embedder, scorer) for x in (MODES if mode == "both" else (mode,))]
    out = cells[0]
    for c in cells[1:]:
        out = out.unionByName(c)
    return out


def chunk_stats(spark: SparkSession, root: str, method: str) -> dict:
    """Number of chunks, mean and median tokens of a method's raw stage."""
    rows = spark.read.parquet(files.stage_path(root, "raw", method)).withColumn("__m", F.lit(method))
    got = evaluate.auxiliary_stats(rows, "__m").collect()
    return {k: v for k, v in got[0].asDict().items() if k != "__m"} if got else {}
