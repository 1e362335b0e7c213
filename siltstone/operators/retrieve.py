"""Dense, lexical, hybrid, entity-boosted and re-ranked search of all claims at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx
from siltstone.functions.models import PairScorer, pair_scores
from siltstone.staging import stage

RRF_K, DENSE_WEIGHT, LEXICAL_WEIGHT = 60, 0.7, 0.3


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, threshold: float | None = None, block_bytes: int = 64_000_000, digits: int = 6) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of `corpus` (id, vector) to each of `queries` (query_id, vector) by cosine.

    Queries are taken in blocks of `block_bytes`; for each block one pass over the corpus multiplies matrices and keeps k
    per partition. Similarities are rounded before ranking; ties by id. A threshold drops hits before the cut. Vectors
    without length have similarity 0.
    """
    spark = queries.sparkSession
    q = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    head = q.select(F.size("vector")).limit(1).collect()
    dim = head[0][0] if head else 1
    per = max(1, block_bytes // (4 * dim))
    total = q.count()
    blocks = max(1, -(-total // per))
    q = stage(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks if blocks > 1 else 1))), "queries")
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": corpus.schema["id"].dataType}
    schema = T.StructType([T.StructField(c, t) for c, t in kinds.items()] + [T.StructField("similarity", T.DoubleType())])
    items = corpus.where("vector is not null").select("id", F.col("vector").cast("array<float>").alias("vector"))
    if blocks > 1:  # every block reads them again: vectors aren't made again
        items = stage(items, "vectors")
    found = None
    for i in range(2 * blocks if blocks > 1 else 1):
        rows = q.where(F.col("block") == i).select("query_id", "vector").toArrow()  # about half of block_bytes
        ids = rows.column("query_id").combine_chunks()
        m = np.asarray(rows.column("vector").combine_chunks().flatten(), np.float32).reshape(-1, dim).astype(np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        shared = spark.sparkContext.broadcast((ids.to_pylist(), m.astype(np.float64)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, qm = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in names]
            for b in batches:
                for s in range(0, b.num_rows if names else 0, 2000):
                    part = b.slice(s, 2000)
                    x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
                    sims, keys = np.round(qm @ x.T, digits), part.column(0).to_pylist()
                    kth = np.partition(sims, max(0, sims.shape[1] - k), axis=1)[:, max(0, sims.shape[1] - k)] if sims.size else np.zeros(len(names))
                    for j in range(len(names)):
                        near = np.flatnonzero(sims[j] >= kth[j])
                        if threshold is not None:
                            near = near[sims[j, near] >= threshold]
                        merged = best[j] + [(-float(sims[j, n]), keys[n]) for n in near]
                        best[j] = sorted(merged)[:k]
            rows = [(names[j], i, -s) for j, hits in enumerate(best) for s, i in hits]
            cols = list(zip(*rows)) or [(), (), ()]
            types = [f.type for f in pa.schema([("q", _arrow(kinds["query_id"])), ("i", _arrow(kinds["id"])), ("s", pa.float64())])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], schema.fieldNames())

        hits = items.mapInArrow(search, schema)
        found = hits if found is None else found.unionByName(hits)
    return ranked(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def ranked(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)


def inverted_index(chunks: DataFrame, key: str = "chunk_id", fields: tuple[str, ...] = ("keywords",), least: int = 2, most: int = 20) -> DataFrame:
    """(token, key, field): lower-case words of `least` to `most` characters of the string arrays."""
    parts = [chunks.select(F.col(key), F.lit(f).alias("field"), F.explode(F.split(F.lower(F.array_join(f, " ")), r"[^\p{L}\p{N}]+")).alias("token")) for f in fields]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.length("token").between(least, most)).select("token", key, "field").distinct()


def lexical_hits(claims: DataFrame, chunks: DataFrame, fields: tuple[str, ...] = ("anchor_queries", "keywords"), mode: str = "all_tokens", limit: int = 60) -> DataFrame:
    """(claim_id, id, overlap, rank) of the chunks whose fields match a claim, at most `limit`, ranked by overlap and id, both descending.

    The first `limit` by id are ranked, but with any_token, where one common word is a match, the best `limit` of all.

    claims: claim_id, text; chunks: id and the fields, arrays of strings. mode: all_tokens (all words of the claim of 2 to 20
    letters occur in one field), any_token, or substring (the claim occurs in a string of a field). Words meet through the
    inverted index, so only claims and chunks with a common word are compared; substring needs common words as well, and
    claims without a word match nothing.
    """
    if mode not in ("all_tokens", "any_token", "substring"):
        raise ValueError(mode)
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(2, 20)))
    q = claims.select("claim_id", "text", words.alias("w")).where(F.size("w") > 0)
    asked = q.select("claim_id", F.size("w").alias("need"), F.explode("w").alias("token"))
    index = inverted_index(chunks, "id", fields)
    met = asked.join(index, "token").groupBy("claim_id", "id", "field", "need").agg(F.count("*").alias("have"))
    if mode == "all_tokens":
        met = met.where("have = need")
    pairs = met.select("claim_id", "id").distinct()
    rows = pairs.join(claims.select("claim_id", "text"), "claim_id").join(chunks.select("id", *fields), "id")
    if mode == "substring":
        inside = None
        for f in fields:
            hit = F.exists(F.coalesce(f, F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), F.lower(tx.strip(F.col("text")))))
            inside = hit if inside is None else inside | hit
        rows = rows.where(F.coalesce(inside, F.lit(False)))
    scored = rows.select("claim_id", "id", tx.lex_overlap(F.col("text"), *[F.col(f) for f in fields]).alias("overlap"))
    first = scored if mode == "any_token" else ranked(scored, ["claim_id"], [F.col("id")], limit).drop("rank")
    return ranked(first, ["claim_id"], [F.col("overlap").desc(), F.col("id").desc()], limit)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = RRF_K) -> DataFrame:
    """(claim_id, id, score, rank): weighted reciprocal ranks of ranked lists (claim_id, id, rank), ties by id."""
    weights = [1.0] * len(lists) if weights is None else weights
    if len(weights) != len(lists):
        raise ValueError("a weight for every list")
    if not lists:  # nothing to fuse
        from pyspark.sql import SparkSession

        return SparkSession.active().createDataFrame([], "claim_id string, id string, score double, rank int")
    parts = [x.select("claim_id", "id", (F.lit(float(w)) / (k + F.col("rank"))).alias("s")) for x, w in zip(lists, weights)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    scored = out.groupBy("claim_id", "id").agg(F.round(F.sum("s"), 6).alias("score"), F.sum("s").alias("exact"))
    return ranked(scored, ["claim_id"], [F.round(F.col("exact"), 12).desc(), F.col("id")]).drop("exact")


def hybrid(dense: DataFrame, lexical: DataFrame, k: int = 3) -> DataFrame:
    """Both lists fused, 0.7 and 0.3; a claim without lexical hits has its dense ranks with 0.7 alone."""
    return rrf([dense.select("claim_id", "id", "rank"), lexical.select("claim_id", "id", "rank")], [DENSE_WEIGHT, LEXICAL_WEIGHT]).where(F.col("rank") <= k)


def entity_boost(terms: Column, keywords: Column, subtopics: Column | None = None) -> Column:
    """0.15 if a term is a keyword, and 0.10 if one is a keyword of any sub-topic; compared in lower case."""
    lower = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))
    low = F.coalesce(F.arrays_overlap(terms, lower(keywords)), F.lit(False))
    out = F.when(low, 0.15).otherwise(0.0)
    if subtopics is not None:
        sub = F.coalesce(F.exists(subtopics, lambda s: F.coalesce(F.arrays_overlap(terms, lower(s["keywords"])), F.lit(False))), F.lit(False))
        out = out + F.when(sub, 0.10).otherwise(0.0)
    return out


def boosted(hits: DataFrame, claims: DataFrame, chunks: DataFrame, k: int = 3, over: int = 3) -> DataFrame:
    """(claim_id, id, score, rank) of dense hits with the boost of entity questions, fetched `over` times as far for these."""
    terms = claims.select("claim_id", tx.entity_terms(F.col("text")).alias("terms"))
    rows = hits.join(terms, "claim_id").where((F.col("rank") <= k) | ((F.size("terms") > 0) & (F.col("rank") <= k * over)))
    rows = rows.join(chunks.select("id", "keywords", "subtopics"), "id")
    score = F.col("similarity") + entity_boost(F.col("terms"), F.col("keywords"), F.col("subtopics"))
    w = Window.partitionBy("claim_id").orderBy(F.round("exact", 9).desc(), F.col("rank"))
    out = rows.withColumn("exact", score).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.select("claim_id", "id", F.round("exact", 4).alias("score"), F.col("place").alias("rank"))


def rerank(candidates: DataFrame, scorer: PairScorer | None = None, k: int = 3) -> DataFrame:
    """(claim_id, id, score, rank): candidates (claim_id, id, rank, claim, text) in the order of a pair score, ties as before.

    Without a scorer, the score is the harmonic mean of the shares of common tokens in claim and text.
    """
    a, b = tx.lex_tokens(F.col("claim")), tx.lex_tokens(F.col("text"))
    both = F.size(F.array_intersect(a, b))
    default = F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)
    rows = candidates.withColumn("score", F.round(default if scorer is None else pair_scores(F.col("claim"), F.col("text"), scorer), 6)).withColumnRenamed("rank", "before")
    return ranked(rows, ["claim_id"], [F.col("score").desc(), F.col("before"), F.col("id")], k).select("claim_id", "id", "score", "rank")


def flexible_topk(sims: DataFrame, group: str, item: str, base: int = 3, slack: float = 0.05, least: float = 0.45) -> DataFrame:
    """(group, item, similarity, rank): the first `base`, more as long as they are within `slack` of the last of these, none below `least`."""
    # what is below `least` is neither kept nor changes what is: if the last of the first `base` is, all others are kept
    near = sims.where(F.col("similarity") >= least)
    order = [F.col("similarity").desc(), F.col(item)]
    floor = ranked(near, [group], order, base).groupBy(group).agg(F.min("similarity").alias("f"), F.count("*").alias("n"))
    kept = near.join(floor, group).where((F.col("n") < base) | (F.col("similarity") >= F.col("f") - slack))
    return ranked(kept, [group], order).drop("f", "n")
