"""The queries of this subpackage, over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, cluster, distinct, fusion, lookalike, neardup, packing, sentences, splitting
from siltstone.staging import latest, spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim's hits with its three scores, each counted alike."""
    hits = _table(spark, sf_dir, "retrieval_results").select("claim_id", "chunk_id", "score", "confidence_score", F.array_join("doc_ids", "|").alias("docs"), "ingested_at")
    hits = hits.groupBy("claim_id", "chunk_id").agg(F.max_by(F.struct("score", "confidence_score", "docs"), F.struct("ingested_at", "score", "confidence_score", "docs")).alias("h"))
    hits = hits.select("claim_id", "chunk_id", "h.*")
    runs = latest(_table(spark, sf_dir, "eval_results").select("claim_id", "enriched_top_doc_ids", "enriched_scores", "evaluated_at"), "claim_id", "evaluated_at")
    entries = runs.select("claim_id", F.posexplode(F.arrays_zip("enriched_top_doc_ids", "enriched_scores")).alias("at", "e"))
    entries = entries.groupBy("claim_id", F.col("e.enriched_top_doc_ids").alias("docs")).agg(F.min_by("e.enriched_scores", "at").alias("enriched"))
    scored = hits.join(entries, ["claim_id", "docs"], "left")
    return fusion.fuse(scored, "claim_id", "chunk_id", {"score": 1.0, "confidence_score": 1.0, "enriched": 1.0})


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).where("place <= 3").select("claim_id", "chunk_id")


def p1_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).withColumn("fused", F.round("fused", 6))


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = spread(_table(spark, sf_dir, "chunks").select("chunk_id", "text", "ingested_at"))
    return neardup.near_duplicates(chunks, "chunk_id", "text", by="ingested_at", threshold=0.6)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = _near(spark, sf_dir)
    return neardup.expand(members, links).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its class of equal texts and the number of links that the class has to different texts."""
    members, links = _near(spark, sf_dir)
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    out = members.join(ends, "rep", "left")
    return out.select(F.col("id").alias("chunk_id"), F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _clustered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, cluster of each, description of each cluster)"""
    columns = ["chunk_id", "text", "topic_id", "topic_label"]
    records = latest(spread(_table(spark, sf_dir, "enriched_chunks").select(*columns, "ingested_at")), "chunk_id", "ingested_at").where("text is not null").select(*columns)
    assigned = cluster.clusters(records, "chunk_id", "text")
    # one spelling of a label: lower case, single spaces, parts in order
    parts = F.array_sort(F.transform(F.split(F.lower("topic_label"), r"\|"), lambda x: F.trim(x)))
    said = F.when(F.lower("topic_label").rlike(r"^(topic_\d+|outlier)?$"), None).otherwise(F.array_join(parts, " | "))
    labels = records.select("chunk_id", "topic_id", said.alias("topic_label"))
    return records, assigned, cluster.describe(assigned, "chunk_id", labels, ["topic_id", "topic_label"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, assigned, about = _clustered(spark, sf_dir)
    fits = assigned.where("cluster is not null").join(about.select("cluster", F.col("topic_id").alias("fit")), "cluster").where("fit is not null")
    out = records.select("chunk_id", "topic_id").join(fits, "chunk_id").where(~F.col("topic_id").eqNullSafe(F.col("fit")))
    return out.select("chunk_id", F.col("fit").cast("int").alias("topic_id"))


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir)[2]


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.split(spread(_table(spark, sf_dir, "chunks").select("chunk_id", "text", "ingested_at")), "chunk_id", "text", by="ingested_at")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir).select("chunk_id", "start_char", "end_char")


def p4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sentences(spark, sf_dir)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks above 512 tokens in pieces."""
    chunks = _table(spark, sf_dir, "chunks").select("chunk_id", "doc_ids", "text", "ingested_at")
    model = sentences.train(spread(chunks.select("text")))
    version = F.xxhash64("text", "doc_ids")
    newest = latest(chunks.select("chunk_id", "ingested_at", version.alias("v")), "chunk_id", "ingested_at").select("chunk_id", "v")
    # a text has at least as many characters as tokens
    long = chunks.where((F.length("text") > 512) & (splitting.count_tokens(F.col("text")) > 512)).withColumn("v", version)
    held = long.join(newest, ["chunk_id", "v"]).dropDuplicates(["chunk_id"]).select("chunk_id", "doc_ids", "text")
    return splitting.split_oversized(held, "text", model, 512, 64)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece = 0").select("chunk_id", "cut_at")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).withColumnRenamed("piece_tokens", "token_count")


def _distinctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = latest(_table(spark, sf_dir, "enriched_chunks").select("chunk_id", "text", "keywords", "ingested_at"), "chunk_id", "ingested_at")
    words = distinct.terms(F.col("text"), F.array_join("keywords", " "))
    return distinct.ppmi(rows.select("chunk_id", words.alias("terms")), "chunk_id", "terms")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinctive(spark, sf_dir).where("tf >= 3 and df between 2 and 8").select("chunk_id", "term")


def p6_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinctive(spark, sf_dir).withColumn("ppmi", F.round("ppmi", 6))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(bpe.count_tokens(docs), "doc_id", "n_tokens", 4096)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _packed(spark, sf_dir)
    return placed.where("piece = 1 and container is not null").select(F.col("id").alias("doc_id")).distinct()


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p9_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.normalize(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that looks like one of other characters, with the smallest id of its look and its number of such documents."""
    rows = lookalike.same_look_classes(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), F.col("first").alias("copy_of"), (F.col("rows") - F.col("copies")).alias("n_links"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ranking, p2_found, p2_classes, p3_found, p3_clusters, p4_found, p4_sentences, p5_found, p5_pieces, p6_found, p6_scores, p7_ids, p8_found, p8_packing, p9_found, p9_normalized, p9_classes)}

_RICH = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) rn FROM enriched_chunks) WHERE rn = 1)"

_LAST = _RICH.replace("enriched_chunks", "chunks")
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_P1 = f"""WITH h AS (SELECT * FROM (SELECT claim_id, chunk_id, score, confidence_score, array_to_string(doc_ids, '|') AS docs, row_number() OVER (PARTITION BY claim_id, chunk_id ORDER BY ingested_at DESC) AS rn FROM retrieval_results) WHERE rn = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY evaluated_at DESC) AS rn FROM eval_results) WHERE rn = 1),
e AS (SELECT claim_id, unnest(enriched_top_doc_ids) AS docs, unnest(enriched_scores) AS enriched FROM r),
w AS (SELECT h.claim_id, chunk_id, score, confidence_score, enriched FROM h LEFT JOIN e USING (claim_id, docs)),
l AS (SELECT claim_id, chunk_id, 1 AS k, score AS x FROM w UNION ALL SELECT claim_id, chunk_id, 2, confidence_score FROM w UNION ALL SELECT claim_id, chunk_id, 3, enriched FROM w),
n AS (SELECT *, rank() OVER v AS lo, count(*) OVER (PARTITION BY claim_id, k, x) AS ties, count(*) OVER (PARTITION BY claim_id, k) AS n FROM l WHERE x IS NOT NULL WINDOW v AS (PARTITION BY claim_id, k ORDER BY x)),
p AS (SELECT claim_id, chunk_id, (lo + (ties - 1) / 2.0 - 0.5) / n AS p FROM n),
z AS (SELECT claim_id, chunk_id, {fusion.probit_sql("CAST(p AS DOUBLE)", "::DOUBLE")} AS z FROM p),
f AS (SELECT w.claim_id, w.chunk_id, round(avg(z), 9) AS fused, CAST(count(z) AS INT) AS n_scores FROM w LEFT JOIN z USING (claim_id, chunk_id) GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY fused DESC NULLS LAST, chunk_id) AS INT) AS place FROM f)"""

_P6 = f"""WITH t AS (SELECT chunk_id AS r, unnest(regexp_extract_all(lower(coalesce(text, '') || ' ' || coalesce(array_to_string(keywords, ' '), '')), '[a-z0-9]{{2,}}')) AS term FROM {_RICH}),
j AS (SELECT r, term, count(*) AS tf FROM t GROUP BY 1, 2), s AS (SELECT r, sum(tf) AS size FROM j GROUP BY 1), m AS (SELECT sum(size ** 0.75) AS mass FROM s),
c AS (SELECT term, sum(tf) AS total, count(*) AS df FROM j GROUP BY 1)"""

_TEXT = f"trim(regexp_replace(lower(text), '{_S}+', ' ', 'g'))"
#: Pairs of at least 0.6 share one of the rarest pieces of either: so many are left when the shared ones it needs are taken off, and 20
#: more, of which 20 are shared (fewer in short texts). Exact for every pair.
_P2 = f"""WITH held AS (SELECT chunk_id, {_TEXT} AS t FROM {_LAST} WHERE text IS NOT NULL AND {_TEXT} <> ''),
cls AS (SELECT t, min(chunk_id) AS rep, count(*) AS copies, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS pieces FROM held GROUP BY t),
pc AS (SELECT rep, len(pieces) AS n, unnest(pieces) AS p FROM cls), fr AS (SELECT p, count(*) AS f FROM pc GROUP BY 1),
pre AS (SELECT rep, p, n FROM (SELECT rep, p, n, f, row_number() OVER (PARTITION BY rep ORDER BY f, p) AS k FROM pc JOIN fr USING (p)) WHERE f > 1 AND k <= n - ceil(0.6 * n) + least(20, ceil(0.6 * n))),
cand AS (SELECT a.rep AS a, b.rep AS b FROM pre a JOIN pre b ON a.p = b.p AND a.rep < b.rep AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY 1, 2 HAVING count(*) >= least(20, ceil(0.6 * max(a.n)), ceil(0.6 * max(b.n)))),
link AS (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.pieces, y.pieces)) AS same, len(x.pieces) + len(y.pieces) AS n FROM cand JOIN cls x ON x.rep = a JOIN cls y ON y.rep = b) WHERE same / (n - same) >= 0.6),
mem AS (SELECT chunk_id, rep, copies FROM held JOIN cls USING (t))"""

#: The other problems aren't expressed in SQL; their tests hold them against brute force, round trips or known answers.
ORACLE_SQL: dict[str, str] = {
    "p2_found": _P2+""" SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM mem a JOIN mem b USING (rep) WHERE a.chunk_id < b.chunk_id
UNION ALL SELECT least(x.chunk_id, y.chunk_id), greatest(x.chunk_id, y.chunk_id) FROM link JOIN mem x ON x.rep = a JOIN mem y ON y.rep = b""",
    "p2_classes": _P2+" SELECT chunk_id, rep AS class_id, copies AS n_copies, coalesce(k, 0) AS n_links FROM mem LEFT JOIN (SELECT r, count(*) AS k FROM (SELECT a AS r FROM link UNION ALL SELECT b FROM link) GROUP BY 1) ON r = rep",
    "p1_found": _P1 + " SELECT claim_id, chunk_id FROM o WHERE place <= 3",
    "p1_ranking": _P1 + " SELECT claim_id, chunk_id, round(fused, 6) AS fused, n_scores, place FROM o",
    "p6_found": _P6 + " SELECT r AS chunk_id, term FROM j JOIN c USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 8",
    "p6_scores": _P6 + " SELECT r AS chunk_id, term, tf, df, round(greatest(0, ln(tf * mass / (total * size ** 0.75))), 6) AS ppmi FROM j JOIN c USING (term) JOIN s USING (r), m",
}
