"""Four ways to cut documents into chunks.

The order-dependent ones run over one document at a time inside an Arrow batch: a document's sentences live in one row, so
nothing is shuffled. Chunks have a position inside their document; `number` turns positions into the running ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx
from siltstone.functions.models import Embedder, HashEmbedder, TokenCounter, token_counts

#: How ids begin, and what joins sentences.
PREFIX = {"baseline_char": "bl", "sentence_window": "sw", "llm_boundary": "sem", "semantic_gmm": "chunk"}
JOINED = "\n\n"
_PIECE = T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("topic_id", T.IntegerType())])


def count_words(text: str) -> int:
    return len(text.split())


def _one(counter: TokenCounter | None) -> Callable[[str], int]:
    return count_words if counter is None else lambda t: counter.count([t])[0]


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sentence) of title and text."""
    parts = tx.plain_sentences(tx.title_and_body(F.col("title"), F.col("text")))
    return docs.select("doc_id", F.posexplode(parts).alias("sent_idx", "sentence"))


def sentence_lists(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", tx.plain_sentences(tx.title_and_body(F.col("title"), F.col("text"))).alias("sents"))


def split_recursively(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters where the separators allow it: the first separator that occurs cuts, a separator
    stays with the piece behind it, neighbours are joined again up to `size`, and pieces still longer are cut by the next."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    if sep == "":
        parts = list(text)
    else:
        first, *rest = text.split(sep)
        parts = [p for p in [first, *(sep + r for r in rest)] if p]
    out: list[str] = []
    run: list[str] = []
    for p in parts:
        if len(p) < size:
            run.append(p)
            continue
        out += _join_up(run, size, overlap)
        run = []
        out += split_recursively(p, size, overlap, finer) if finer else [p]
    return out + _join_up(run, size, overlap)


def _join_up(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            if joined := "".join(held).strip():
                out.append(joined)
            while held and (total > overlap or total + len(p) > size):
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    if joined := "".join(held).strip():
        out.append(joined)
    return out


def pack_words(text: str, most: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Words filled up greedily to `most` tokens; a longer word stays whole."""
    out: list[str] = []
    held: list[str] = []
    for w in text.split():
        if held and count(" ".join([*held, w])) > most:
            out.append(" ".join(held))
            held = []
        held.append(w)
    return [*out, " ".join(held)] if held else out


def fit_sentences(sents: list[str], most: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Sentences above `most` tokens cut by characters, four to a token, and what is still longer by words."""
    out: list[str] = []
    for s in sents:
        if count(s) <= most:
            out.append(s)
            continue
        for p in split_recursively(s, 4 * most, 64, ("\n\n", "\n", ". ", " ", "")):
            out += [p] if count(p) <= most else pack_words(p, most, count)
    return out


def _per_document(df: DataFrame, cut: Callable[[list[str], list | None], list[tuple[str, int]]], *extra: str) -> DataFrame:
    """(doc_id, pos, text, topic_id) of cut(sentences, extra column) for each row of (doc_id, sents, extra)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 64):
                part = b.slice(s, 64).to_pylist()
                rows = [(r["doc_id"], i, t, topic) for r in part for i, (t, topic) in enumerate(cut(r["sents"] or [], *(r[e] for e in extra)))]
                cols = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.int32()))], _PIECE.fieldNames())

    return df.select("doc_id", "sents", *extra).mapInArrow(run, _PIECE)


def char_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """Recursive cutting by characters; the title isn't stripped here."""
    whole = docs.select("doc_id", F.array(tx.title_and_body(F.col("title"), F.col("text"), stripped=False)).alias("sents"))
    return _per_document(whole, lambda s: [(p, -1) for p in split_recursively(s[0], size, overlap)] if s[0] else [])


def window_bounds(n: Column, tokens: Column, size: int, overlap: int, most: int) -> Column:
    """Array of (first, length) windows over `n` sentences with the token counts `tokens`, in the JVM.

    Windows begin every size - overlap sentences as long as sentences beyond the overlap are left; trailing sentences are
    dropped down to `most` tokens, but one stays; a window that ends no later than an earlier one is left out.
    """
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1 - overlap, F.lit(0)), F.lit(size - overlap)), lambda s: s < n)

    def kept(s: Column) -> Column:
        span = F.slice(tokens, s + 1, F.least(F.lit(size), n - s))
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("len"), F.lit(True).alias("on"))

        def step(a: Column, t: Column) -> Column:
            go = a["on"] & ((a["len"] == 0) | (a["sum"] + t <= most))
            return F.struct((a["sum"] + t).alias("sum"), F.when(go, a["len"] + 1).otherwise(a["len"]).alias("len"), go.alias("on"))

        return F.aggregate(span, zero, step)["len"]

    windows = F.transform(starts, lambda s: F.struct(s.cast("int").alias("first"), kept(s).cast("int").alias("len")))
    none = F.struct(F.array().cast("array<struct<first:int,len:int>>").alias("out"), F.lit(-1).alias("end"))

    def take(a: Column, w: Column) -> Column:
        end = w["first"] + w["len"]
        return F.when(end > a["end"], F.struct(F.array_append(a["out"], w).alias("out"), end.alias("end"))).otherwise(a)

    return F.aggregate(windows, none, take)["out"]


def window_chunks(docs: DataFrame, size: int = 6, overlap: int = 2, most: int = 512, whole_sentences: bool = False, counter: TokenCounter | None = None) -> DataFrame:
    """Windows of sentences. whole_sentences: sentences above `most` tokens aren't cut before."""
    lists = sentence_lists(docs)
    if not whole_sentences:
        fitted = _per_document(lists, lambda s: [(x, -1) for x in fit_sentences(s, most, _one(counter))])
        grouped = fitted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("s"))
        lists = grouped.select("doc_id", F.transform("s", lambda x: x["text"]).alias("sents"))
    tokens = token_counts(F.col("sents"), counter)
    cut = lists.where(F.size("sents") > 0).withColumn("tok", tokens).withColumn("n", F.size("sents"))
    wins = cut.select("doc_id", "sents", F.posexplode(window_bounds(F.col("n"), F.col("tok"), size, overlap, most)).alias("pos", "w"))
    text = F.array_join(F.slice("sents", F.col("w.first") + 1, F.col("w.len")), JOINED)
    return wins.select("doc_id", "pos", tx.strip(text).alias("text"), F.lit(-1).alias("topic_id"))


def is_boundary(before: np.ndarray, vector: np.ndarray, least: float) -> bool:
    """Is the unit vector less similar than `least` to the normalized mean of the unit vectors before it?"""
    m = before.mean(0)
    return float(m @ vector) / (float(np.linalg.norm(m)) or 1.0) < least


def boundary_chunks(docs: DataFrame, most: int = 512, least: float = 0.55, lookback: int = 4, ready: int = 2, embedder: Embedder | None = None, counter: TokenCounter | None = None) -> DataFrame:
    """A new chunk where the next sentence would go beyond the cap, or is unlike the last sentences of the chunk."""
    model = embedder or HashEmbedder()

    def cut(sents: list[str]) -> list[tuple[str, int]]:
        sents = fit_sentences(sents, most, _one(counter))
        if not sents:
            return []
        x = model.encode(sents).astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x /= np.where(length == 0, 1, length)
        sizes = counter.count(sents) if counter else [count_words(s) for s in sents]
        out, first, held = [], 0, 0
        for i, s in enumerate(sents):
            n = sizes[i]
            if i > first and held + n > most or i - first >= ready and is_boundary(x[max(first, i - lookback) : i], x[i], least):
                out.append((JOINED.join(sents[first:i]).strip(), -1))
                first, held = i, 0
            held += n
        return [*out, (JOINED.join(sents[first:]).strip(), -1)]

    return _per_document(sentence_lists(docs), cut)


def topic_islands(labelled: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, sentence, topic, island): neighbours of one topic are an island, counted from 0 in a document."""
    w = Window.partitionBy("doc_id").orderBy("sent_idx")
    changed = F.coalesce((F.col("topic") != F.lag("topic").over(w)).cast("int"), F.lit(0))
    return labelled.withColumn("__c", changed).withColumn("island", F.sum("__c").over(w).cast("int")).drop("__c")


def topic_chunks(labelled: DataFrame, most: int = 512, counter: TokenCounter | None = None) -> DataFrame:
    """Neighbouring sentences of one topic, up to the cap. labelled: (doc_id, sent_idx, sentence, topic).

    A buffer only ever holds one topic, as another one ends it; so an island is filled up greedily.
    """
    lists = labelled.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_idx", "sentence", "topic"))).alias("s"))
    lists = lists.select("doc_id", F.transform("s", lambda x: x["sentence"]).alias("sents"), F.transform("s", lambda x: x["topic"].cast("int")).alias("topics"))

    def cut(sents: list[str], topics: list[int]) -> list[tuple[str, int]]:
        out: list[tuple[str, int]] = []
        held: list[str] = []
        size, topic, count = 0, None, _one(counter)
        for s, t in zip(sents, topics):
            for p in [s] if count(s) <= most else pack_words(s, most, count):
                n = count(p)
                if held and (t != topic or size + n > most):
                    out.append((JOINED.join(held).strip(), topic))
                    held, size = [], 0
                held.append(p)
                size, topic = size + n, t
        return [*out, (JOINED.join(held).strip(), topic)] if held else out

    return _per_document(lists, cut, "topics")


def number(pieces: DataFrame, method: str, counter: TokenCounter | None = None) -> DataFrame:
    """Chunks with running ids in the order of documents: chunks are counted per document, and only the counts are ordered.

    doc_id is ordered as a number where it is one. The order of counts is by ranges, so no task sees all documents.
    """
    order = [F.col("doc_id").try_cast("bigint"), F.col("doc_id")]
    counts = pieces.groupBy("doc_id").agg(F.count("*").alias("n")).repartitionByRange(*order)
    from siltstone.staging import stage

    counts = stage(counts.withColumn("p", F.spark_partition_id()), "counts")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = counts.groupBy("p").agg(F.sum("n").alias("pn")).withColumn("base", F.coalesce(F.sum("pn").over(before), F.lit(0)))
    inside = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("o", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts.select("p", "base")), "p")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    out = pieces.withColumn("__r", rank).join(first.select("doc_id", (F.col("base") + F.col("o")).alias("__b")), "doc_id")
    return out.select(
        tx.chunk_id(PREFIX[method], F.col("__b") + F.col("__r")).alias("chunk_id"), F.array("doc_id").alias("doc_ids"), "text",
        F.get(token_counts(F.array("text"), counter), 0).alias("token_count"), "topic_id", F.array().cast("array<string>").alias("keywords"),
    )


def chunk(docs: DataFrame, method: str, labelled: DataFrame | None = None, counter: TokenCounter | None = None) -> DataFrame:
    """Numbered chunks by one of the four methods; semantic_gmm needs sentences with topics. counter: what a token is."""
    if method == "semantic_gmm":
        if labelled is None:
            raise ValueError("semantic_gmm needs labelled sentences")
        return number(topic_chunks(labelled, counter=counter), method, counter)
    make = {"baseline_char": char_chunks, "sentence_window": window_chunks, "llm_boundary": boundary_chunks}
    if method not in make:
        raise ValueError(method)
    more = {} if method == "baseline_char" else {"counter": counter}
    return number(make[method](docs, **more), method, counter)
