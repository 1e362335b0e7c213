"""Topics, keywords and anchor queries for a set of chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx
from siltstone.functions.models import AnchorWriter, Embedder, TemplateAnchor, embed
from siltstone.operators import keywords, retrieve, topics
from siltstone.staging import stage


@dataclass
class Enrichment:
    chunks: DataFrame
    optimal_k: int
    anchors: DataFrame  # (topic_id, core_sentences, anchor_query)


def chunk_sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sent_idx, sentence)"""
    return chunks.select("chunk_id", F.posexplode(tx.plain_sentences(F.col("text"))).alias("sent_idx", "sentence"))


def write_anchors(core: DataFrame, writer: AnchorWriter | None = None, most: int = 1000) -> DataFrame:
    """(topic_id, core_sentences, anchor_query), one per topic. Topics are few: more than `most` is an error."""
    own = writer or TemplateAnchor()
    rows = core.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} topics")
    out = []
    for r in sorted(rows, key=lambda r: r["topic_id"]):
        try:
            text = own.write(r["topic_id"], list(r["core_sentences"]))
        except Exception:  # a failing model must not stop the others
            text = TemplateAnchor().write(r["topic_id"], list(r["core_sentences"]))
        out.append((r["topic_id"], list(r["core_sentences"]), text))
    return core.sparkSession.createDataFrame(out, "topic_id int, core_sentences array<string>, anchor_query string")


def associate(chunks: DataFrame, anchors: DataFrame, embedder: Embedder | None = None, least: float = 0.45) -> DataFrame:
    """(chunk_id, synthetic_queries): for every anchor query the chunks it fits, by flexible top-k. One pass over the chunks."""
    most = 1000
    asked = embed(anchors.select("topic_id", "anchor_query"), "anchor_query", "qv", embedder).limit(most + 1).collect()
    if len(asked) > most:
        raise ValueError(f"more than {most} anchors")
    have = embed(chunks.select("chunk_id", "text"), "text", "cv", embedder)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    m = unit(np.array([r["qv"] for r in asked], np.float64)) if asked else np.zeros((0, 1))
    shared = chunks.sparkSession.sparkContext.broadcast((m, [r["topic_id"] for r in asked], [r["anchor_query"] for r in asked]))  # at most 1000 anchors
    schema = T.StructType([T.StructField("topic_id", T.IntegerType()), T.StructField("anchor_query", T.StringType()), chunks.schema["chunk_id"], T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, topic, text = shared.value
        for b in batches:
            for s in range(0, b.num_rows if len(q) else 0, 1000):
                part = b.slice(s, 1000)
                x = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
                sims = np.round(unit(x) @ q.T, 6)
                at, j = np.nonzero(sims >= least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([topic[k] for k in j], pa.int32()), pa.array([text[k] for k in j], pa.string()), part.column(0).take(pa.array(at)), pa.array(sims[at, j])], schema.fieldNames()
                )

    sims = have.select("chunk_id", "cv").mapInArrow(compare, schema)
    kept = retrieve.flexible_topk(sims, "topic_id", "chunk_id", least=least)
    item = F.struct("topic_id", F.col("anchor_query").alias("text"), F.lit("anchor").alias("typology"), F.col("topic_id").alias("subtopic_id"))
    packed = kept.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("q"))
    return packed.select("chunk_id", F.transform("q", lambda x: F.struct(x["text"].alias("text"), x["typology"].alias("typology"), x["subtopic_id"].alias("subtopic_id"))).alias("synthetic_queries"))


def append(chunks: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """chunks with the arrays of new (chunk_id, column) behind those they have; an empty array where there is neither."""
    none = F.array().cast(new.schema[column].dataType)
    old = F.coalesce(F.col(column), none) if column in chunks.columns else none
    joined = chunks.join(new.select("chunk_id", F.col(column).alias("__new")), "chunk_id", "left")
    return joined.withColumn(column, F.concat(old, F.coalesce("__new", none))).drop("__new")


def thread(chunks: DataFrame, anchors: DataFrame, k: int, embedder: Embedder | None = None) -> DataFrame:
    """chunks with the anchor queries that fit them behind the synthetic queries they have, no clusters of queries, and k topics."""
    out = append(chunks, associate(chunks, anchors, embedder), "synthetic_queries")
    return out.withColumn("query_clusters", F.array().cast("array<string>")).withColumn("optimal_k", F.lit(k))


def enrich(chunks: DataFrame, least: int = 3, most: int = 20, components: int = 15, embedder: Embedder | None = None, writer: AnchorWriter | None = None) -> Enrichment:
    """chunks with topic_id (majority of their sentences), keywords of that topic, anchor_queries of the anchors that fit."""
    sents = embed(chunk_sentences(chunks), "sentence", "vector", embedder)
    labelled, k = topics.gaussian_topics(sents, "vector", components, least, most)
    labelled = stage(labelled, "labelled")
    main = keywords.majority(labelled, "chunk_id", "topic", "sent_idx")
    named = chunks.drop("topic_id", "keywords").join(main, "chunk_id", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    words = keywords.keyword_arrays(keywords.class_tfidf(named), "topic_id")
    named = named.join(F.broadcast(words), "topic_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))  # a row per component
    ident = labelled.withColumn("sid", F.concat_ws("#", "chunk_id", F.lpad(F.col("sent_idx").cast("string"), 6, "0")))
    core = topics.core_items(ident.select("sid", "topic", "vector"), "sid", "topic", "vector")
    core = core.join(ident.select("sid", "sentence"), "sid").groupBy(F.col("topic").alias("topic_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("s"))
    anchors = write_anchors(core.select("topic_id", F.transform("s", lambda x: x["sentence"]).alias("core_sentences")), writer)
    linked = associate(named, anchors, embedder).select("chunk_id", F.transform("synthetic_queries", lambda q: q["text"]).alias("anchor_queries"))
    out = append(named, linked, "anchor_queries")
    return Enrichment(out, k, anchors)


def attach_metadata(chunks: DataFrame, words: DataFrame, subtopics: DataFrame, topics_: DataFrame, labels: DataFrame) -> DataFrame:
    """Chunks in the older enriched form: keywords (chunk_id, keywords), subtopics (chunk_id, subtopics), topics_ (chunk_id, topic_id,
    confidence) and labels (topic_id, terms) joined to them; absent ones are empty, -1 and 0.0; confidence is rounded to 4 places."""
    base = chunks.select("chunk_id", "doc_ids", "text", "token_count")
    out = base.join(topics_.select("chunk_id", "topic_id", "confidence"), "chunk_id", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1)))
    out = out.join(words, "chunk_id", "left").join(subtopics, "chunk_id", "left").join(labels.select("topic_id", "terms"), "topic_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(
        "chunk_id", "doc_ids", "text", "token_count", "topic_id", none("keywords"), none("subtopics"),
        tx.topic_label(F.col("topic_id"), F.col("terms")).alias("topic_label"), F.round(F.coalesce("confidence", F.lit(0.0)), 4).alias("confidence_score"),
    )
