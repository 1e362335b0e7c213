"""Keywords of topics and of chunks, sub-topics, majorities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.staging import stage

def library_stop_words() -> list[str]:
    """Spark's English stop words, which keyword lists leave out."""
    return StopWordsRemover.loadDefaultStopWords("english")


def tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case runs of letters, digits and _ of ASCII, at least two long, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{2,})"), 1)
    return F.filter(found, lambda w: ~w.isin(library_stop_words() if stop is None else stop))


def top(df: DataFrame, keys: list[str], by: str, tie: str, n: int | None) -> DataFrame:
    """The n rows of each key with the greatest `by`, all for None; ties by `tie`. New column: rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), tie)
    out = df.withColumn("rank", F.row_number().over(w))
    return out if n is None else out.where(F.col("rank") <= n)


def class_tfidf(chunks: DataFrame, topic: str = "topic_id", text: str = "text", n: int | None = 5, stop: list[str] | None = None, all_or_none: bool = False) -> DataFrame:
    """(topic, term, weight, rank): the first n terms (None: all) of each topic >= 0 by share in the topic times ln(1 + words per topic / total).

    all_or_none: no rows if any chunk has a negative topic.
    """
    if all_or_none and chunks.where(F.col(topic) < 0).limit(1).count():
        chunks = chunks.limit(0)
    one = chunks.where(F.col(topic) >= 0).select(F.col(topic).alias("topic_id"), F.explode(tokens(F.col(text), stop)).alias("term"))
    tf = one.groupBy("topic_id", "term").agg(F.count("*").alias("tf"))
    size = tf.groupBy("topic_id").agg(F.sum("tf").alias("size"))
    total = tf.groupBy("term").agg(F.sum("tf").alias("total"))
    mean = size.agg(F.floor(F.avg("size")).cast("double").alias("mean"))
    w = F.col("tf") / F.col("size") * F.log(1 + F.col("mean") / F.col("total"))
    scored = tf.join(total, "term").join(size, "topic_id").crossJoin(F.broadcast(mean))  # mean is one number
    return top(scored.select("topic_id", "term", F.round(w, 9).alias("weight")), ["topic_id"], "weight", "term", n)


def chunk_tfidf(chunks: DataFrame, key: str = "chunk_id", text: str = "text", n: int = 10, features: int = 5000, stop: list[str] | None = None) -> DataFrame:
    """(key, term, weight, rank): words and pairs of neighbours by tf-idf over the `features` commonest, rows of length one."""
    words = chunks.select(F.col(key), tokens(F.col(text), stop).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).otherwise(F.array().cast("array<string>"))
    tf = words.select(key, F.explode(F.concat("w", pairs)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    kept = stats.orderBy(F.col("total").desc(), "term").limit(features)  # at most `features` rows
    count = chunks.agg(F.count("*").alias("n"))
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = tf.join(F.broadcast(kept), "term").crossJoin(F.broadcast(count)).select(key, "term", (F.col("tf") * idf).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))
    return top(raw.select(key, "term", F.round(F.col("x") / length, 9).alias("weight")).where("weight > 0"), [key], "weight", "term", n)


def topic_keywords(ranked: DataFrame, topics: DataFrame, n: int = 10) -> DataFrame:
    """(topic_id, keywords): the first n terms of each of `topics`, an empty list for -1 and for topics without terms."""
    found = keyword_arrays(ranked.where((F.col("rank") <= n) & (F.col("topic_id") != -1)), "topic_id")
    return topics.select("topic_id").distinct().join(found, "topic_id", "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def keyword_arrays(ranked: DataFrame, key: str) -> DataFrame:
    packed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
    return packed.select(key, F.transform("k", lambda x: x["term"]).alias("keywords"))


def majority(df: DataFrame, key: str, value: str, position: str, out: str = "topic_id") -> DataFrame:
    """(key, out): the commonest value of each key, the earliest of equals. Keys without rows don't occur; see coalesce to -1."""
    each = df.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("at"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "at")
    return each.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, F.col(value).alias(out))


def subtopics(
    chunks: DataFrame, terms: DataFrame, labels: DataFrame, window: int = 4, similar: float = 0.1, least: float = 0.01, per: int = 1000
) -> DataFrame:
    """(chunk_id, subtopics): topics that windows of `window` tokens resemble, with their share, greatest first.

    terms: (topic_id, term, weight) of all topics; labels: (topic_id, label, keywords). A window is the bag of its terms'
    weights; its cosine with a topic's weights counts if at least `similar`; sums over windows are divided by their total.
    About `per` chunks at a time meet the weights of the terms they contain, once each, so that no row per window is shuffled.
    """
    toks = stage(chunks.select("chunk_id", tokens(F.col("text")).alias("w")).where(F.size("w") > 0), "tokens")
    blocks = max(1, -(-toks.count() // per))
    toks = toks.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)))
    length = terms.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tl"))
    unit = terms.join(length, "topic_id").where("tl > 0").withColumn("u", F.col("weight") / F.col("tl"))
    vectors = unit.groupBy("term").agg(F.max("weight").alias("g"), F.collect_list(F.struct("topic_id", "u")).alias("v"))
    met = toks.select(F.col("block").alias("b"), F.explode("w").alias("term")).distinct().join(vectors, "term").select("b", "term", "g", "v")
    schema = T.StructType([T.StructField("chunk_id", chunks.schema["chunk_id"].dataType), T.StructField("topic_id", terms.schema["topic_id"].dataType), T.StructField("s", T.DoubleType())])

    def resemble(texts: pa.Table, known: pa.Table) -> pa.Table:
        kinds = [texts.schema.field("chunk_id").type, known.schema.field("v").type.value_type.field("topic_id").type, pa.float64()]
        number = {t: i for i, t in enumerate(known.column("term").to_pylist())}
        g = np.append(np.array(known.column("g").to_pylist(), np.float64), 0.0)  # the last one stands for terms of no topic
        lists = known.column("v").combine_chunks()
        own = np.repeat(np.arange(len(number)), np.array(lists.value_lengths(), np.int64))
        flat = lists.flatten()
        ids, at = np.unique(np.array(flat.field("topic_id"), np.int64), return_inverse=True)
        weight = np.zeros((len(g), len(ids)))
        weight[own, at] = np.array(flat.field("u"), np.float64) * g[own]
        rows: list[tuple[object, int, float]] = []
        for c, w in zip(texts.column("chunk_id").to_pylist(), texts.column("w").to_pylist()):
            n = np.array([number.get(t, len(number)) for t in w])
            wins, total = np.lib.stride_tricks.sliding_window_view(n, min(window, len(n))), np.zeros(len(ids))
            for k in range(0, len(wins), 4096):
                x = wins[k : k + 4096]
                # a term that occurs c times in a window has (c * g) ** 2 of its squared length
                long = np.sqrt(((x[:, :, None] == x[:, None, :]) * (g[x] ** 2)[:, :, None]).sum((1, 2)))
                cos = sum(weight[x[:, j]] for j in range(x.shape[1])) / np.maximum(long, 1e-300)[:, None]
                total += np.where(cos >= similar, cos, 0.0).sum(0)
            rows += [(c, int(ids[j]), float(total[j])) for j in np.flatnonzero(total)]
        cols = list(zip(*rows)) or [(), (), ()]
        return pa.table([pa.array(x, t) for x, t in zip(cols, kinds)], names=schema.fieldNames())

    sims = toks.groupBy("block").cogroup(met.groupBy("b")).applyInArrow(resemble, schema)
    sums = sims.groupBy("chunk_id", "topic_id").agg(F.sum("s").alias("s"))
    share = F.round(F.col("s") / F.sum("s").over(Window.partitionBy("chunk_id")), 4)
    found = sums.withColumn("confidence", share).where(F.col("confidence") > least).join(labels, "topic_id")
    item = F.struct((-F.col("confidence")).alias("o"), "topic_id", "label", "keywords", "confidence")
    packed = found.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    out = packed.select("chunk_id", F.transform("s", lambda x: F.struct(x["topic_id"].alias("topic_id"), x["label"].alias("label"), x["keywords"].alias("keywords"), x["confidence"].alias("confidence"))).alias("subtopics"))
    return chunks.select("chunk_id").distinct().join(out, "chunk_id", "left").select("chunk_id", F.coalesce("subtopics", F.array().cast(out.schema["subtopics"].dataType)).alias("subtopics"))
