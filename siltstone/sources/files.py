"""JSON and CSV files, staged tables, their names."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import text as tx

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
STRINGS = T.ArrayType(S)
SUBTOPIC = T.StructType([T.StructField("topic_id", I), T.StructField("label", S), T.StructField("keywords", STRINGS), T.StructField("confidence", D)])
QUERY = T.StructType([T.StructField("text", S), T.StructField("typology", S), T.StructField("subtopic_id", I)])
CHUNK = T.StructType([T.StructField("chunk_id", S), T.StructField("doc_ids", STRINGS), T.StructField("doc_id", S), T.StructField("text", S)] + [T.StructField("token_count", I), T.StructField("topic_id", I), T.StructField("keywords", STRINGS)])
ENRICHED = T.StructType(CHUNK.fields + [T.StructField("subtopics", T.ArrayType(SUBTOPIC)), T.StructField("topic_label", S), T.StructField("confidence_score", D), T.StructField("anchor_queries", STRINGS)])
THREADED = T.StructType(ENRICHED.fields + [T.StructField("synthetic_queries", T.ArrayType(QUERY)), T.StructField("query_clusters", STRINGS), T.StructField("optimal_k", I)])
ANCHORS = T.StructType([T.StructField("embedding_model", S), T.StructField("k", I), T.StructField("topics", T.ArrayType(T.StructType([T.StructField("topic_id", I), T.StructField("core_sentences", STRINGS)])))])

METHODS = ("baseline_char", "sentence_window", "llm_boundary", "semantic_gmm")
_DEFAULTS = {"topic_id": -1, "topic_label": "", "confidence_score": 0.0}


def normalize_chunks(df: DataFrame) -> DataFrame:
    """Chunks with defaults in place: doc_ids from a single doc_id, absent tokens counted, topic -1, empty lists, '' and 0.0.

    Without chunk_id, text, and doc_ids or doc_id, a KeyError names the missing ones.
    """
    have = set(df.columns)
    missing = [c for c in ("chunk_id", "text") if c not in have] + ([] if have & {"doc_ids", "doc_id"} else ["doc_ids"])
    if missing:
        raise KeyError(", ".join(missing))
    ids = F.col("doc_ids") if "doc_ids" in have else F.lit(None).cast("array<string>")
    out = df.withColumn("doc_ids", tx.doc_id_list(ids, F.col("doc_id") if "doc_id" in have else None)).drop("doc_id")
    counted = tx.word_count(F.col("text"))
    out = out.withColumn("token_count", F.coalesce(F.col("token_count"), counted) if "token_count" in have else counted)
    for c, value in _DEFAULTS.items():
        if c in have or c == "topic_id":
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in have else F.lit(value))
    for f in ENRICHED.fields:
        if f.name in have and isinstance(f.dataType, T.ArrayType) and f.name != "doc_ids":
            out = out.withColumn(f.name, F.coalesce(F.col(f.name), F.array().cast(df.schema[f.name].dataType)))
    return out.withColumn("keywords", F.array().cast("array<string>")) if "keywords" not in have else out


def read_chunks(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """A JSON array of chunks, or lines of JSON. Fields that the file lacks have their defaults."""
    return normalize_chunks(spark.read.schema(schema).option("multiLine", True).json(path))


def read_list(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """A file that must be a JSON array: ValueError if it begins otherwise."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head or not head[0][0].lstrip("\ufeff \t").startswith("["):
        raise ValueError(f"not a JSON array: {path}")
    return read_chunks(spark, path, schema)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The same, but an absent or broken file is an empty table."""
    try:
        df = spark.read.schema(T.StructType([*schema.fields, T.StructField("__bad", S)])).option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(path)
        return df.where(F.col(schema.fieldNames()[0]).isNotNull()).drop("__bad")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(embedding_model, k, topic_id, core_sentences) of an anchors file."""
    return spark.read.schema(ANCHORS).option("multiLine", True).json(path).select("embedding_model", "k", F.explode("topics").alias("t")).select("embedding_model", "k", "t.*")


def anchors_document(anchors: DataFrame) -> DataFrame:
    """One row as in an anchors file; topics sorted by id. Topics are few."""
    topics = F.array_sort(F.collect_list(F.struct("topic_id", "core_sentences")))
    return anchors.groupBy("embedding_model", "k").agg(topics.alias("topics"))


def write_json(df: DataFrame, path: str) -> None:
    """Lines of JSON in UTF-8; fields that are null stay as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> int:
    """One file with a JSON array, indented by 2, for readers that want one; rows pass the driver one by one. Returns their number."""
    import json
    from pathlib import Path

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator(prefetchPartitions=True):
            f.write(("," if n else "") + "\n  " + json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2).replace("\n", "\n  "))
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_example(spark: SparkSession, path: str, query_id: str | None = None, claim: str | None = None) -> dict:
    """One row of a pairs file: by id (trimmed), by text (any case), or the first. LookupError if there is none."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if query_id is not None:
        rows = rows.where(F.trim("Query_ID") == query_id.strip())
    elif claim is not None:
        rows = rows.where(F.lower(F.trim("Claim_Text")) == claim.strip().lower())
    got = rows.limit(1).collect()
    if not got:
        raise LookupError("no such example")
    return got[0].asDict()


def stage_path(root: str, kind: str, method: str) -> str:
    """Where a stage of the ablation keeps a method's table: kind is raw, enriched or anchors."""
    if kind not in ("raw", "enriched", "anchors"):
        raise ValueError(kind)
    return f"{root.rstrip('/')}/{kind}/{method}"


def validate_methods(methods: list[str]) -> list[str]:
    unknown = [m for m in methods if m not in METHODS]
    if unknown or not methods:
        raise ValueError(f"methods must be some of {METHODS}: {unknown}")
    return list(dict.fromkeys(methods))
