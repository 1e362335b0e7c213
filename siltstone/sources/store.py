"""Collections of vectors with their payload, kept as Parquet tables."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions.models import Embedder, embed
from siltstone.staging import stage

MANDATORY = ("chunk_id", "text", "doc_ids")
OPTIONAL = ("token_count", "topic_id", "keywords", "anchor_queries")


def payload(chunks: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Mandatory fields, a single doc_id where there is exactly one, and those of `fields` that the table has."""
    asked = list(dict.fromkeys([*MANDATORY, *(OPTIONAL if fields is None else fields)]))
    ids = tx.doc_id_list(F.col("doc_ids"))
    cols: list[Column] = ["chunk_id", "text", ids.alias("doc_ids"), F.when(F.size(ids) == 1, ids[0]).alias("doc_id")]
    return chunks.select(*cols, *[c for c in asked if c not in MANDATORY and c in chunks.columns])


def legacy_payload(chunks: DataFrame) -> DataFrame:
    """The older form: defaults for missing values, doc_id the first of several, anchor queries of typology anchor."""
    ids = tx.doc_id_list(F.col("doc_ids"))
    have = set(chunks.columns)
    get = lambda c, d: F.coalesce(F.col(c), d).alias(c) if c in have else d.alias(c)
    cols = ["chunk_id", "text", ids.alias("doc_ids"), F.get(ids, 0).alias("doc_id"), get("token_count", F.lit(0)), get("topic_id", F.lit(-1))]
    cols += [get("keywords", F.array().cast("array<string>")), get("topic_label", F.lit("")), get("confidence_score", F.lit(0.0))]
    if "subtopics" in have:
        cols.append(get("subtopics", F.array().cast(chunks.schema["subtopics"].dataType)))
    if "synthetic_queries" in have:
        anchors = F.filter("synthetic_queries", lambda q: (F.lower(q["typology"]) == "anchor") & (tx.strip(q["text"]) != ""))
        cols.append(F.when(F.size(anchors) > 0, F.transform(anchors, lambda q: tx.strip(q["text"]))).alias("anchor_queries"))
    return chunks.select(*cols)


def payload_doc_ids(df: DataFrame) -> Column:
    """A payload's documents as strings: of doc_ids, Docs, docs and doc_id the first that is there; scalars become lists."""
    out = []
    for c in ("doc_ids", "Docs", "docs", "doc_id"):
        if c in df.columns:
            many = df.schema[c].dataType.typeName() == "array"
            ids = F.filter(F.col(f"`{c}`").cast("array<string>"), lambda x: x.isNotNull()) if many else F.array(F.col(f"`{c}`").cast("string"))
            out.append(F.when(F.col(f"`{c}`").isNotNull() & (F.size(ids) > 0), ids))
    return F.coalesce(*out, F.array().cast("array<string>"))


def path_of(root: str, collection: str) -> str:
    return f"{root.rstrip('/')}/collections/{collection}"


def _files(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _current(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest manifest of a collection: its number, and the folder of each part of the points; -1 without one."""
    fs, p = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    done = max((int(n.split("-")[1]) for n in names if n.startswith("manifest-")), default=-1)
    if done < 0:
        return -1, {}
    rows = spark.read.text(f"{path}/manifest-{done:09d}").collect()  # a line per part
    return done, dict((int(k), v) for k, v in (r[0].split(" ", 1) for r in rows))


def collection_exists(spark: SparkSession, root: str, collection: str) -> bool:
    return _current(spark, path_of(root, collection))[0] >= 0


def collections(spark: SparkSession, root: str) -> list[str]:
    fs, p = _files(spark, f"{root.rstrip('/')}/collections")
    names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
    return [n for n in names if collection_exists(spark, root, n)]


def validate(spark: SparkSession, root: str, names: list[str]) -> None:
    missing = [n for n in names if not collection_exists(spark, root, n)]
    if missing or not names:
        raise ValueError(f"missing collections: {missing}")


def points(chunks: DataFrame, embedder: Embedder | None = None, legacy: bool = False) -> DataFrame:
    """(point_id, vector, payload): one per chunk_id, the last row of repeated ones. legacy: the older form of the payload."""
    w = Window.partitionBy("chunk_id").orderBy(F.col("__at").desc())
    last = chunks.withColumn("__at", F.monotonically_increasing_id()).withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__at")
    one = legacy_payload(last) if legacy else payload(last)
    return embed(one.withColumn("point_id", tx.point_id(F.col("chunk_id"))), "text", "vector", embedder)


def index_chunks(chunks: DataFrame, root: str, collection: str, recreate: bool = True, embedder: Embedder | None = None, parts: int = 64, legacy: bool = False) -> int:
    """Write a collection; without `recreate`, points with the same id are replaced. Returns how many points it got.

    Points are kept in `parts` parts by a hash of their id. A version of the collection is a manifest that names each part's
    folder; writing makes new folders of the parts it touches and then a new manifest, in one step, so readers always find a
    whole version and a lost job leaves the old one. Folders of older versions stay until vacuum.
    """
    spark, path = chunks.sparkSession, path_of(root, collection)
    number, known = _current(spark, path)
    if recreate or number < 0:
        known = {}
    elif known:
        parts = max(known) + 1
    at = F.pmod(F.xxhash64("point_id"), F.lit(parts)).cast("int").alias("part")
    new = stage(points(chunks, embedder, legacy).select("*", at), "points")
    count = new.count()
    if not count and not recreate:
        return 0
    touched = [r[0] for r in new.select("part").distinct().collect()]  # at most `parts`
    old = [known[k] for k in touched if known.get(k)]
    whole = new
    if old:
        whole = spark.read.parquet(*old).withColumn("part", at).join(new.select("point_id"), "point_id", "left_anti").unionByName(new, allowMissingColumns=True)
    folder = f"{path}/data-{uuid.uuid4().hex}"
    whole.repartition("part").write.partitionBy("part").parquet(folder)
    known = {**{k: known.get(k, "") for k in range(parts)}, **{k: f"{folder}/part={k}" for k in touched}}
    lines = spark.createDataFrame([(f"{k} {v}",) for k, v in sorted(known.items())], "value string")
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/.new-{number + 1}")
    fs, source = _files(spark, f"{path}/.new-{number + 1}")
    target = _files(spark, f"{path}/manifest-{number + 1:09d}")[1]
    if fs.exists(target) or not fs.rename(source, target):
        raise RuntimeError(f"{collection} was written by another job at the same time")
    return count


def vacuum(spark: SparkSession, root: str, collection: str) -> None:
    """Remove the manifests and folders that the newest version doesn't use. No job may read an older one meanwhile."""
    path = path_of(root, collection)
    number, known = _current(spark, path)
    used = {v.rsplit("/", 2)[-2] for v in known.values() if v} | {f"manifest-{number:09d}"}
    fs, p = _files(spark, path)
    for s in fs.listStatus(p):
        if number >= 0 and s.getPath().getName() not in used:
            fs.delete(s.getPath(), True)


def index_file(spark: SparkSession, file: str, root: str, collection: str, **more) -> int:
    """Index the chunks of a JSON file."""
    from siltstone.sources.files import ENRICHED, read_list

    return index_chunks(read_list(spark, file, ENRICHED), root, collection, **more)


def read_collection(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """The points of the newest version; ValueError without one."""
    validate(spark, root, [collection])
    folders = [v for _, v in sorted(_current(spark, path_of(root, collection))[1].items()) if v]
    if not folders:
        return spark.createDataFrame([], "chunk_id string, text string, doc_ids array<string>, doc_id string, point_id string, vector array<float>")
    return spark.read.option("mergeSchema", True).parquet(*folders)


def has_anchor_queries(points_: DataFrame, probe: int = 32) -> bool:
    """Has any of the first `probe` points by id a non-blank anchor query? False if the field is absent or unreadable."""
    if "anchor_queries" not in points_.columns:
        return False
    try:
        first = points_.select("point_id", "anchor_queries").orderBy("point_id").limit(probe)
        return bool(first.where(F.exists("anchor_queries", lambda x: tx.strip(x) != "")).limit(1).count())
    except AnalysisException:
        return False
