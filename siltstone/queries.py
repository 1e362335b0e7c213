"""The queries over the library's operators, and what they equal in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions.models import TemplateAnchor, embed
from siltstone.functions.vector import mean_by
from siltstone.operators import chunkers, enrich, evaluate, keywords, retrieve, topics
from siltstone.plans import ablation, trace
from siltstone.sources import corpus, files, store
from siltstone.staging import latest, spread, stage

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{_S}+'), lambda w: w <> '')"


def _lex(x: str, least: int = 2) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda w: length(w) >= {least}))"


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) rn FROM {t}) WHERE rn = 1)"
_CHUNKS, _RICH = _LATEST.format(t="chunks"), _LATEST.format(t="enriched_chunks")
_TRUTH = """SELECT query_id, list_sort(list_distinct(list(doc_id))) AS gt FROM qrels WHERE relevance > 0 AND doc_id IS NOT NULL GROUP BY 1"""
_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(title, '') AS title, coalesce(text, '') AS text FROM documents"
_SENTS = f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS sent_idx, unnest(s) AS sentence FROM (
  SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM (
    SELECT doc_id, CASE WHEN {_strip('title')} <> '' THEN {_strip('title')} || chr(10) || chr(10) || {_strip('text')} ELSE {_strip('text')} END AS t FROM ({_DOCS})))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _newest(spark: SparkSession, d: str, name: str) -> DataFrame:
    return latest(_t(spark, d, name), "chunk_id", "ingested_at")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.load_corpus(_t(spark, d, "documents"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return corpus.claims(_t(spark, d, "queries"), _t(spark, d, "qrels"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    cols = ["claim_id", "collection", "rank", "score", "chunk_id", "doc_ids", "topic_id"]
    return _t(spark, d, "retrieval_results").select(*cols).distinct()


# ---- sources


@query(f"SELECT doc_id, length(text) AS n FROM ({_DOCS}) WHERE doc_id IN (SELECT doc_id FROM qrels WHERE relevance > 0)")
def evidence_docs(spark, d):
    return corpus.load_corpus(_t(spark, d, "documents"), _t(spark, d, "qrels")).select("doc_id", F.length("text").alias("n"))


@query("""SELECT p.query_id AS "Query_ID", coalesce(q.claim, '') AS "Claim_Text", p.doc_id AS "Evidence_Doc_ID", coalesce(d.text, '') AS "Evidence_Text"
FROM (SELECT DISTINCT query_id, doc_id FROM qrels WHERE relevance > 0) p
LEFT JOIN (SELECT query_id, min(text) AS claim FROM queries GROUP BY 1) q USING (query_id) LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = p.doc_id""")
def qrels_pairs(spark, d):
    return corpus.qa_pairs(_t(spark, d, "qrels"), _t(spark, d, "queries"), _t(spark, d, "documents"))


@query(f"SELECT q.query_id AS claim_id, coalesce(min(q.text), '') AS text, array_to_string(any_value(t.gt), ',') AS ground_truth FROM queries q JOIN ({_TRUTH}) t USING (query_id) GROUP BY 1")
def claims(spark, d):
    return _claims(spark, d).select("claim_id", "text", F.array_join("ground_truth_doc_ids", ",").alias("ground_truth"))


@query()
def sampled_claims(spark, d):
    return corpus.sample_claims(_claims(spark, d), 20).select("claim_id", "text")


@query(f"""SELECT chunk_id, text, array_to_string(coalesce(doc_ids, []), '|') AS doc_ids, CASE WHEN len(coalesce(doc_ids, [])) = 1 THEN doc_ids[1] END AS doc_id,
token_count, topic_id, array_to_string(keywords, '|') AS keywords FROM {_CHUNKS}""")
def payload(spark, d):
    out = store.payload(_newest(spark, d, "chunks"))
    return out.withColumn("doc_ids", F.array_join("doc_ids", "|")).withColumn("keywords", F.array_join("keywords", "|"))


@query(f"""SELECT chunk_id, coalesce(doc_ids[1], NULL) AS doc_id, coalesce(token_count, 0) AS token_count, coalesce(topic_id, -1) AS topic_id,
coalesce(topic_label, '') AS topic_label, coalesce(confidence_score, 0.0) AS confidence_score, len(coalesce(keywords, [])) AS n_keywords, len(coalesce(subtopics, [])) AS n_subtopics FROM {_RICH}""")
def legacy_payload(spark, d):
    out = store.legacy_payload(_newest(spark, d, "enriched_chunks"))
    return out.select("chunk_id", "doc_id", "token_count", "topic_id", "topic_label", "confidence_score", F.size("keywords").alias("n_keywords"), F.size("subtopics").alias("n_subtopics"))


@query("""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT DISTINCT chunk_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM chunks)""")
def point_ids(spark, d):
    return _t(spark, d, "chunks").select("chunk_id").distinct().select("chunk_id", tx.point_id(F.col("chunk_id")).alias("point_id"))


@query(f"""SELECT DISTINCT w AS token, chunk_id, 'keywords' AS field FROM (
SELECT chunk_id, unnest(string_split_regex(lower(array_to_string(keywords, ' ')), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {_CHUNKS}) WHERE length(w) BETWEEN 2 AND 20""")
def inverted_index(spark, d):
    return retrieve.inverted_index(_newest(spark, d, "chunks"))


# ---- text functions


@query(_SENTS)
def sentences(spark, d):
    return chunkers.sentences(_docs(spark, d))


@query(f"SELECT doc_id, count(*) AS n, max(length(sentence)) AS longest FROM ({_SENTS}) GROUP BY 1")
def sentence_counts(spark, d):
    return chunkers.sentences(_docs(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


@query(f"SELECT DISTINCT query_id, array_to_string(list_sort({_lex('text')}), ' ') AS tokens FROM queries")
def lex_tokens(spark, d):
    return _t(spark, d, "queries").select("query_id", F.array_join(F.array_sort(tx.lex_tokens(F.col("text"))), " ").alias("tokens")).distinct()


@query(f"""SELECT r.claim_id, r.chunk_id, CAST(len(list_intersect({_lex('q.text')}, {_lex("array_to_string(c.keywords, ' ')")})) AS INT) AS overlap
FROM (SELECT DISTINCT claim_id, chunk_id FROM retrieval_results) r JOIN (SELECT query_id, min(text) AS text FROM queries GROUP BY 1) q ON q.query_id = r.claim_id JOIN {_RICH} c USING (chunk_id)""")
def lex_overlap(spark, d):
    q = _t(spark, d, "queries").groupBy(F.col("query_id").alias("claim_id")).agg(F.min("text").alias("claim"))
    pairs = _t(spark, d, "retrieval_results").select("claim_id", "chunk_id").distinct()
    rows = pairs.join(q, "claim_id").join(_newest(spark, d, "enriched_chunks").select("chunk_id", "keywords"), "chunk_id")
    return rows.select("claim_id", "chunk_id", tx.lex_overlap(F.col("claim"), F.col("keywords")).alias("overlap"))


@query(f"""SELECT r.claim_id, r.chunk_id, round(len(list_intersect({_lex('q.text', 1)}, {_lex('c.text', 1)})) / greatest(1, least(len({_lex('q.text', 1)}), len({_lex('c.text', 1)}))), 6) AS ratio
FROM (SELECT DISTINCT claim_id, chunk_id FROM retrieval_results) r JOIN (SELECT query_id, min(text) AS text FROM queries GROUP BY 1) q ON q.query_id = r.claim_id JOIN {_RICH} c USING (chunk_id)""")
def lex_ratio(spark, d):
    q = _t(spark, d, "queries").groupBy(F.col("query_id").alias("claim_id")).agg(F.min("text").alias("claim"))
    pairs = _t(spark, d, "retrieval_results").select("claim_id", "chunk_id").distinct()
    rows = pairs.join(q, "claim_id").join(_newest(spark, d, "enriched_chunks").select("chunk_id", "text"), "chunk_id")
    return rows.select("claim_id", "chunk_id", F.round(tx.lex_ratio(F.col("claim"), F.col("text")), 6).alias("ratio"))


@query(f"SELECT chunk_id, chunk_id || ':' || substr(sha1(coalesce(text, '')), 1, 12) AS signature FROM {_CHUNKS}")
def signatures(spark, d):
    return _newest(spark, d, "chunks").select("chunk_id", tx.signature(F.col("chunk_id"), F.col("text")).alias("signature"))


@query("""SELECT DISTINCT source, CASE WHEN digits <> '' THEN regexp_replace(digits, '^0+(.)', '\\1') ELSE lower(coalesce(source, '')) END AS norm
FROM (SELECT source, regexp_replace(coalesce(source, ''), '[^0-9]', '', 'g') AS digits FROM (SELECT source FROM documents UNION ALL SELECT chunk_id FROM chunks UNION ALL SELECT '000'))""")
def norm_ids(spark, d):
    names = _t(spark, d, "documents").select("source").union(_t(spark, d, "chunks").select("chunk_id")).union(spark.createDataFrame([("000",)], "source string"))
    return names.distinct().select("source", tx.norm_id(F.col("source")).alias("norm"))


@query(f"""SELECT DISTINCT query_id, CASE WHEN regexp_matches(q, '(?i)^(who is|what is|what are|who are|define|describe|explain)\\s+')
THEN array_to_string(list_filter({_words("lower(regexp_replace(regexp_replace(q, '(?i)^(who is|what is|what are|who are|define|describe|explain)\\s+', ''), '[?., ]+$', ''))")}, lambda w: length(w) >= 2), ' ') ELSE '' END AS terms
FROM (SELECT query_id, {_strip("coalesce(text, '')")} AS q FROM queries UNION ALL SELECT query_id, 'What is ' || {_strip("coalesce(text, '')")} FROM queries)""")
def entity_terms(spark, d):
    q = _t(spark, d, "queries").select("query_id", tx.strip(F.coalesce("text", F.lit(""))).alias("q"))
    q = q.union(q.select("query_id", F.concat(F.lit("What is "), "q")))
    return q.select("query_id", F.array_join(tx.entity_terms(F.col("q")), " ").alias("terms")).distinct()


@query(f"""SELECT DISTINCT chunk_id, CASE WHEN topic_id = -1 THEN 'outlier' WHEN len(coalesce(keywords, [])) = 0 THEN 'topic_' || topic_id ELSE array_to_string(keywords[1:4], ' | ') END AS label FROM {_RICH}""")
def topic_labels(spark, d):
    return _newest(spark, d, "enriched_chunks").select("chunk_id", tx.topic_label(F.col("topic_id"), F.col("keywords")).alias("label"))


@query(f"""SELECT topic_id, 'What findings relate to: ' || CASE WHEN length(h) <= 120 THEN h ELSE regexp_extract(h, '^(.{{1,118}}) ', 1) || ' …' END || ' (global topic ' || topic_id || ')?' AS anchor_query FROM (SELECT topic_id, trim(regexp_replace(core_sentences[1], '\\s+', ' ', 'g')) AS h FROM topic_anchors)""")
def anchor_texts(spark, d):
    rows = _t(spark, d, "topic_anchors").select("topic_id", "core_sentences")
    return enrich.write_anchors(rows, TemplateAnchor()).select("topic_id", "anchor_query")


# ---- chunking


@query()
def char_chunks_500_50(spark, d):
    return chunkers.number(chunkers.char_chunks(spread(_docs(spark, d))), "baseline_char").select("chunk_id", F.element_at("doc_ids", 1).alias("doc_id"), "text", "token_count")


@query(f"""WITH s AS (SELECT doc_id, list(sentence ORDER BY sent_idx) AS sents, count(*) AS n FROM ({_SENTS}) GROUP BY 1),
w AS (SELECT doc_id, sents, CAST(n AS INT) AS n, CAST(unnest(range(0, greatest(n - 2, 1), 4)) AS INT) AS first FROM s),
k AS (SELECT doc_id, first, n, (SELECT greatest(1, count(*)) FROM range(1, least(6, n - first) + 1) m(x) WHERE list_sum(list_transform(sents[first + 1:first + x], lambda t: len({_words('t')}))) <= 512) AS len FROM w),
e AS (SELECT *, max(first + len) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)
SELECT doc_id, first, CAST(len AS INT) AS len FROM e WHERE before IS NULL OR first + len > before""")
def window_geometry(spark, d):
    lists = chunkers.sentence_lists(_docs(spark, d)).where(F.size("sents") > 0).withColumn("tok", F.transform("sents", tx.word_count)).withColumn("n", F.size("sents"))
    wins = lists.select("doc_id", F.explode(chunkers.window_bounds(F.col("n"), F.col("tok"), 6, 2, 512)).alias("w"))
    return wins.select("doc_id", "w.first", "w.len")


@query(f"""WITH s AS (SELECT doc_id, list(sentence ORDER BY sent_idx) AS sents, count(*) AS n FROM ({_SENTS}) GROUP BY 1),
w AS (SELECT doc_id, sents, CAST(n AS INT) AS n, CAST(unnest(range(0, greatest(n - 2, 1), 4)) AS INT) AS first FROM s),
k AS (SELECT doc_id, sents, first, n, (SELECT greatest(1, count(*)) FROM range(1, least(6, n - first) + 1) m(x) WHERE list_sum(list_transform(sents[first + 1:first + x], lambda t: len({_words('t')}))) <= 512) AS len FROM w),
e AS (SELECT *, max(first + len) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
c AS (SELECT doc_id, {_strip("array_to_string(sents[first + 1:first + len], chr(10) || chr(10))")} AS text, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), first) - 1 AS k FROM e WHERE before IS NULL OR first + len > before)
SELECT 'sw-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS chunk_id, doc_id, text, CAST(len({_words('text')}) AS INT) AS token_count FROM c""")
def window_chunks_6_2(spark, d):
    return chunkers.number(chunkers.window_chunks(spread(_docs(spark, d))), "sentence_window").select("chunk_id", F.element_at("doc_ids", 1).alias("doc_id"), "text", "token_count")


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, sent_idx AS i, sentence, CAST(len({_words('sentence')}) AS INT) AS n FROM ({_SENTS})),
b AS (SELECT doc_id, i, p, count(*) AS n FROM (SELECT doc_id, i, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 768 AS p FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[a-z0-9]+')) AS w FROM s)) GROUP BY 1, 2, 3),
l AS (SELECT doc_id, i, sqrt(sum(n * n)) AS l FROM b GROUP BY 1, 2), u AS (SELECT doc_id, i, p, n / l AS x FROM b JOIN l USING (doc_id, i)),
d AS (SELECT a.doc_id, a.i, c.i AS j, sum(a.x * c.x) AS x FROM (SELECT *, unnest(range(0, 5)) AS o FROM u) a JOIN u c ON a.doc_id = c.doc_id AND a.p = c.p AND c.i = a.i - a.o GROUP BY 1, 2, 3),
g AS (SELECT doc_id, i, unnest(range(1, 5)) AS k FROM s),
t AS (SELECT doc_id, i, k, sum(x) AS dot FROM (SELECT doc_id, i, k, 0.0 AS x FROM g UNION ALL SELECT doc_id, i, unnest(range(i - j, 5)) AS k, x FROM d WHERE j < i) GROUP BY 1, 2, 3),
m AS (SELECT doc_id, i, k, sum(x) AS sq FROM (SELECT doc_id, i, k, 0.0 AS x FROM g UNION ALL SELECT doc_id, n AS i, unnest(range(n - j, 5)) AS k, x FROM (
SELECT doc_id, i, j, CASE WHEN i = j THEN x ELSE 2 * x END AS x, unnest(range(i + 1, j + 5)) AS n FROM d)) GROUP BY 1, 2, 3),
f AS (SELECT doc_id, i, list(dot / CASE WHEN sq = 0 THEN 1 ELSE sqrt(sq) END < 0.55 ORDER BY k) AS cut FROM t JOIN m USING (doc_id, i, k) WHERE k <= i GROUP BY 1, 2),
w AS (SELECT s.doc_id, s.i, s.n, f.cut FROM s LEFT JOIN f USING (doc_id, i)),
r AS (SELECT doc_id, i, 0 AS first, n AS held, 0 AS pos FROM w WHERE i = 0 UNION ALL
SELECT doc_id, i, CASE WHEN new THEN i ELSE first END, CASE WHEN new THEN n ELSE held + n END, pos + CAST(new AS INT) FROM (
SELECT w.doc_id, w.i, r.first, r.held, r.pos, w.n, r.held + w.n > 512 OR (w.i - r.first >= 2 AND w.cut[least(4, w.i - r.first)]) AS new
FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1)),
c AS (SELECT doc_id, pos, {_strip("string_agg(sentence, chr(10) || chr(10) ORDER BY i)")} AS text FROM r JOIN s USING (doc_id, i) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), pos) - 1 AS k FROM c)
SELECT 'sem-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS chunk_id, doc_id, text, CAST(len({_words('text')}) AS INT) AS token_count FROM k""")
def boundary_chunks(spark, d):
    return chunkers.number(chunkers.boundary_chunks(spread(_docs(spark, d))), "llm_boundary").select("chunk_id", F.element_at("doc_ids", 1).alias("doc_id"), "text", "token_count")


_TOPICS = f"SELECT doc_id, sent_idx, sentence, CAST(CAST(('0x' || substr(md5(sentence), 1, 6)) AS BIGINT) % 3 AS INT) AS topic FROM ({_SENTS})"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a stand-in topic: a third of the hash values each."""
    s = chunkers.sentences(_docs(spark, d))
    return s.withColumn("topic", (F.conv(F.substring(F.md5("sentence"), 1, 6), 16, 10).cast("long") % 3).cast("int"))


@query(f"""SELECT doc_id, island, min(topic) AS topic, count(*) AS n_sentences, min(sent_idx) AS first FROM (
SELECT *, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS INT) AS island FROM (
SELECT *, coalesce(CAST(topic <> lag(topic) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS INT), 0) AS c FROM ({_TOPICS}))) GROUP BY 1, 2""")
def topic_islands(spark, d):
    return chunkers.topic_islands(_labelled(spark, d)).groupBy("doc_id", "island").agg(F.min("topic").alias("topic"), F.count("*").alias("n_sentences"), F.min("sent_idx").alias("first"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, sent_idx, sentence, topic, CAST(len({_words('sentence')}) AS INT) AS n FROM ({_TOPICS})),
r AS (SELECT doc_id, sent_idx, topic, n AS size, 0 AS pos FROM s WHERE sent_idx = 0 UNION ALL
SELECT s.doc_id, s.sent_idx, s.topic, CASE WHEN s.topic <> r.topic OR r.size + s.n > 512 THEN s.n ELSE r.size + s.n END, r.pos + CASE WHEN s.topic <> r.topic OR r.size + s.n > 512 THEN 1 ELSE 0 END
FROM r JOIN s ON s.doc_id = r.doc_id AND s.sent_idx = r.sent_idx + 1),
c AS (SELECT doc_id, pos, min(r.topic) AS topic_id, {_strip("string_agg(sentence, chr(10) || chr(10) ORDER BY sent_idx)")} AS text FROM r JOIN s USING (doc_id, sent_idx) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), pos) - 1 AS k FROM c)
SELECT 'chunk-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS chunk_id, doc_id, topic_id, text, CAST(len({_words('text')}) AS INT) AS token_count FROM k""")
def topic_chunks(spark, d):
    return chunkers.number(chunkers.topic_chunks(_labelled(spark, d)), "semantic_gmm").select("chunk_id", F.element_at("doc_ids", 1).alias("doc_id"), "topic_id", "text", "token_count")


# ---- aggregations


@query("""SELECT claim_id, topic_id FROM (SELECT claim_id, topic_id, row_number() OVER (PARTITION BY claim_id ORDER BY count(*) DESC, min(rank)) AS rn
FROM (SELECT DISTINCT claim_id, collection, rank, score, chunk_id, doc_ids, topic_id FROM retrieval_results) WHERE topic_id IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def majority_topic(spark, d):
    return keywords.majority(_hits(spark, d).where("topic_id is not null"), "claim_id", "topic_id", "rank")


_LONG = "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"


@query(f"SELECT label, CAST(d AS INT) AS d, round(avg(x), 6) AS mean, count(*) AS n FROM ({_LONG}) GROUP BY 1, 2")
def centroids(spark, d):
    m = mean_by(_t(spark, d, "embeddings"), "label", "embedding")
    return m.select("label", "n", F.posexplode("centroid").alias("d", "m")).select("label", "d", F.round("m", 6).alias("mean"), "n")


@query(f"""WITH c AS (SELECT label, list(m ORDER BY d) AS c FROM (SELECT label, d, avg(x) AS m FROM ({_LONG}) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT e.label, vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 6) AS similarity FROM embeddings e JOIN c USING (label))
SELECT label, vec_id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 8""")
def core_vectors(spark, d):
    return topics.core_items(_t(spark, d, "embeddings"), "vec_id", "label", "embedding")


@query("""SELECT claim_id, chunk_id, similarity, CAST(rank AS INT) AS rank FROM (
SELECT *, min(CASE WHEN rank <= 3 THEN similarity END) OVER (PARTITION BY claim_id) AS f FROM (
SELECT claim_id, chunk_id, similarity, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
SELECT claim_id, chunk_id, max(score) AS similarity FROM retrieval_results GROUP BY 1, 2))) WHERE (rank <= 3 OR similarity >= f - 0.05) AND similarity >= 0.45""")
def flexible_topk(spark, d):
    sims = _t(spark, d, "retrieval_results").groupBy("claim_id", "chunk_id").agg(F.max("score").alias("similarity"))
    return retrieve.flexible_topk(sims, "claim_id", "chunk_id")


#: The published English stop words of Spark's feature library, written out so that the SQL stands for itself.
_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs "
    "themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under "
    "again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've "
    "we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't "
    "cannot could here's how's let's ought that's there's what's when's where's who's why's would "
).split()
_STOP = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in _STOP_WORDS) + ")"
_TOK = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}'), lambda w: w NOT IN {_STOP})"


@query(f"""WITH tf AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, unnest({_TOK}) AS term FROM {_RICH} WHERE topic_id >= 0) GROUP BY 1, 2),
s AS (SELECT topic_id, sum(tf) AS size FROM tf GROUP BY 1), t AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1), m AS (SELECT floor(avg(size)) AS mean FROM s),
w AS (SELECT topic_id, term, round(tf / size * ln(1 + mean / total), 9) AS weight FROM tf JOIN s USING (topic_id) JOIN t USING (term), m)
SELECT topic_id, term, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 5""")
def ctfidf_top5(spark, d):
    return keywords.class_tfidf(_newest(spark, d, "enriched_chunks")).withColumn("weight", F.round("weight", 6))


@query(f"""WITH w AS (SELECT chunk_id, {_TOK} AS w FROM {_RICH}),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM w) GROUP BY 1, 2),
f AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000),
x AS (SELECT chunk_id, term, tf * (ln((1 + (SELECT count(*) FROM w)) / (1 + df)) + 1) AS x FROM tf JOIN f USING (term)),
s AS (SELECT chunk_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY chunk_id)), 9) AS weight FROM x)
SELECT chunk_id, term, round(weight, 6) AS weight, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY weight DESC, term) AS rank FROM s) WHERE rank <= 10""")
def tfidf_top10(spark, d):
    return keywords.chunk_tfidf(_newest(spark, d, "enriched_chunks")).withColumn("weight", F.round("weight", 6))


_CTFIDF = f"""tf AS (SELECT topic_id, term, count(*) AS tf FROM (SELECT topic_id, unnest({_TOK}) AS term FROM {_RICH} WHERE topic_id >= 0) GROUP BY 1, 2),
s AS (SELECT topic_id, sum(tf) AS size FROM tf GROUP BY 1), t AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1), m AS (SELECT floor(avg(size)) AS mean FROM s),
w AS (SELECT topic_id, term, round(tf / size * ln(1 + mean / total), 9) AS weight FROM tf JOIN s USING (topic_id) JOIN t USING (term), m)"""


@query(f"""WITH {_CTFIDF}, l AS (SELECT topic_id, sqrt(sum(weight * weight)) AS tl FROM w GROUP BY 1), g AS (SELECT term, max(weight) AS g FROM w GROUP BY 1),
u AS (SELECT topic_id, term, weight / tl AS u, g FROM w JOIN l USING (topic_id) JOIN g USING (term)),
c AS (SELECT chunk_id, {_TOK} AS toks FROM {_RICH}), p AS (SELECT chunk_id, i, toks[i + 1:i + 4] AS x FROM (SELECT chunk_id, toks, unnest(range(0, greatest(len(toks) - 3, 1))) AS i FROM c WHERE len(toks) > 0)),
e AS (SELECT chunk_id, i, term, count(*) AS n FROM (SELECT chunk_id, i, unnest(x) AS term FROM p) GROUP BY 1, 2, 3),
n AS (SELECT chunk_id, i, sqrt(sum(e.n * e.n * g * g)) AS len FROM e JOIN g USING (term) GROUP BY 1, 2),
d AS (SELECT chunk_id, i, topic_id, sum(e.n * u * g) AS dot FROM e JOIN u USING (term) GROUP BY 1, 2, 3),
q AS (SELECT chunk_id, topic_id, sum(dot / len) AS s FROM d JOIN n USING (chunk_id, i) WHERE dot / len >= 0.1 GROUP BY 1, 2),
r AS (SELECT chunk_id, topic_id, round(s / sum(s) OVER (PARTITION BY chunk_id), 4) AS confidence FROM q),
b AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY confidence DESC, topic_id) AS k, count(*) OVER (PARTITION BY chunk_id) AS n FROM r WHERE confidence > 0.01)
SELECT c.chunk_id, CAST(coalesce(b.n, 0) AS INT) AS n, b.topic_id AS first, b.confidence FROM c LEFT JOIN b ON b.chunk_id = c.chunk_id AND b.k = 1""")
def subtopics(spark, d):
    rich = _newest(spark, d, "enriched_chunks").select("chunk_id", "text", "topic_id")
    terms = stage(keywords.class_tfidf(rich, n=None), "terms")
    names = keywords.keyword_arrays(terms.where("rank <= 4"), "topic_id").select("topic_id", F.array_join("keywords", " | ").alias("label"), "keywords")
    out = keywords.subtopics(rich, terms.select("topic_id", "term", "weight"), names)
    return out.select("chunk_id", F.size("subtopics").alias("n"), F.get("subtopics", 0)["topic_id"].alias("first"), F.get("subtopics", 0)["confidence"].alias("confidence"))


@query(f"""SELECT count(*) AS n, min(token_count) AS least, max(token_count) AS greatest, round(avg(token_count), 4) AS mean, median(token_count) AS median,
round(coalesce(stddev_samp(token_count), 0), 4) AS deviation, round(avg(CAST(token_count BETWEEN 256 AND 512 AS INT)) * 100, 4) AS in_range FROM {_CHUNKS} WHERE token_count IS NOT NULL""")
def token_stats(spark, d):
    return evaluate.token_stats(_newest(spark, d, "chunks"))


@query(f"""SELECT chunker, count(*) AS n_chunks, round(avg(t), 1) AS avg_tokens, CAST(floor(median(t)) AS INT) AS median_tokens FROM (
SELECT regexp_extract(chunk_id, '^[a-z]+') AS chunker, coalesce(nullif(token_count, 0), len({_words('text')})) AS t FROM {_CHUNKS}) GROUP BY 1""")
def aux_stats(spark, d):
    return evaluate.auxiliary_stats(_newest(spark, d, "chunks").withColumn("chunker", F.regexp_extract("chunk_id", "^[a-z]+", 0)), "chunker")


@query(f"SELECT topic_id, count(*) AS n, arg_min(nullif(topic_label, ''), CASE WHEN topic_label <> '' THEN chunk_id END) AS label, min(chunk_id) AS first_chunk FROM {_RICH} GROUP BY 1")
def topic_histogram(spark, d):
    return evaluate.topic_histogram(_newest(spark, d, "enriched_chunks"))


@query(f"""WITH c AS (SELECT DISTINCT topic_id FROM {_RICH} WHERE topic_id >= 0), a AS (SELECT DISTINCT topic_id FROM topic_anchors)
SELECT topic_id, 'anchors' AS side FROM a WHERE topic_id NOT IN (SELECT topic_id FROM c) UNION ALL SELECT topic_id, 'chunks' AS side FROM c WHERE topic_id NOT IN (SELECT topic_id FROM a)""")
def orphan_topics(spark, d):
    return evaluate.orphans(_t(spark, d, "topic_anchors"), _newest(spark, d, "enriched_chunks"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE len(keywords) > 0) AS with_keywords, count(*) FILTER (WHERE len(subtopics) > 0) AS with_subtopics FROM {_RICH}")
def keyword_coverage(spark, d):
    return evaluate.coverage(_newest(spark, d, "enriched_chunks"), "keywords", "subtopics")


# ---- search


@query("""SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0)) WHERE rank <= 3""")
def dense_top3(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.dense_topk(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows, 3)


@query("""SELECT q.vec_id AS query_id, c.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q, embeddings c
WHERE q.vec_id % 50 = 0 AND round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) >= 0.3
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY similarity DESC, c.vec_id) <= 20""")
def score_threshold(spark, d):
    rows = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieve.dense_topk(rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), rows, 20, threshold=0.3).drop("rank")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every claim whose id is divisible by 50."""
    q = _t(spark, d, "queries").where(F.col("query_id").try_cast("bigint") % 50 == 0)
    return q.groupBy(F.col("query_id").alias("claim_id")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))


def _points(spark: SparkSession, d: str) -> DataFrame:
    rich = _newest(spark, d, "enriched_chunks").select("chunk_id", "text", "doc_ids", "keywords", "subtopics")
    labelled = rich.withColumn("anchor_queries", F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit("What about "), k, F.lit("?"))))
    return embed(spread(labelled.where("text is not null")), "text")


def _dense(spark: SparkSession, d: str, k: int) -> DataFrame:
    rows = _points(spark, d).select(F.col("chunk_id").alias("id"), "vector")
    return retrieve.dense_topk(embed(_asked(spark, d).withColumnRenamed("claim_id", "query_id"), "text"), rows, k)


_BAG = "SELECT {k}, b, count(*) AS n FROM (SELECT {k}, CAST(('0x' || substr(md5(w), 1, 6)) AS BIGINT) % 768 AS b FROM (SELECT {k}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {t})) GROUP BY 1, 2"
_ASKED = "(SELECT query_id, coalesce(min(text), '') AS text FROM queries WHERE TRY_CAST(query_id AS BIGINT) % 50 = 0 GROUP BY 1)"
_SIM = f"""WITH q AS ({_BAG.format(k="query_id", t=_ASKED)}), c AS ({_BAG.format(k="chunk_id", t=_RICH)}),
ql AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM q GROUP BY 1), cl AS (SELECT chunk_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1),
dots AS (SELECT query_id, chunk_id, sum(q.n * c.n) AS x FROM q JOIN c USING (b) GROUP BY 1, 2),
sims AS (SELECT query_id, chunk_id AS id, round(x / (ql.l * cl.l), 6) AS similarity FROM dots JOIN ql USING (query_id) JOIN cl USING (chunk_id))"""


@query(_SIM + " SELECT query_id, id, similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= 3")
def dense_text_top3(spark, d):
    return _dense(spark, d, 3)


@query(f"""WITH q AS (SELECT claim_id, w FROM (SELECT query_id AS claim_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) BETWEEN 2 AND 20)) AS w FROM {_ASKED})),
i AS (SELECT DISTINCT chunk_id, unnest(string_split_regex(lower(array_to_string(keywords, ' ')), '[^\\p{{L}}\\p{{N}}]+')) AS t FROM {_RICH}),
m AS (SELECT DISTINCT claim_id, chunk_id FROM (SELECT claim_id, unnest(w) AS t FROM q) JOIN i USING (t) WHERE length(t) BETWEEN 2 AND 20),
o AS (SELECT claim_id, chunk_id AS id, CAST(len(list_intersect({_lex('q.text')}, {_lex("array_to_string(c.keywords, ' ')")})) AS INT) AS overlap FROM m JOIN (SELECT query_id AS claim_id, text FROM {_ASKED}) q USING (claim_id) JOIN {_RICH} c USING (chunk_id))
SELECT claim_id, id, overlap, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY overlap DESC, id DESC) AS rank FROM o) WHERE rank <= 60""")
def lexical_rank(spark, d):
    q = _asked(spark, d)
    rows = _newest(spark, d, "enriched_chunks").select(F.col("chunk_id").alias("id"), "keywords")
    return retrieve.lexical_hits(q, rows, ("keywords",), mode="any_token")


@query("""WITH r AS (SELECT DISTINCT claim_id, chunk_id, rank, score, confidence_score FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, chunk_id ORDER BY ingested_at DESC) AS n FROM retrieval_results) WHERE n = 1),
a AS (SELECT claim_id, chunk_id AS id, 0.7 / (60 + rank) AS s FROM r),
b AS (SELECT claim_id, chunk_id AS id, 0.3 / (60 + row_number() OVER (PARTITION BY claim_id ORDER BY confidence_score DESC, chunk_id)) AS s FROM r WHERE confidence_score IS NOT NULL),
f AS (SELECT claim_id, id, sum(s) AS e FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
SELECT claim_id, id, round(e, 6) AS score, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY round(e, 12) DESC, id) AS INT) AS rank FROM f""")
def rrf(spark, d):
    rows = corpus.first_by(_t(spark, d, "retrieval_results").select("claim_id", F.col("chunk_id").alias("id"), "rank", "confidence_score", "ingested_at"), ["claim_id", "id"], [F.col("ingested_at").desc()])
    sure = rows.where("confidence_score is not null").drop("rank")
    return retrieve.rrf([rows, retrieve.ranked(sure, ["claim_id"], [F.col("confidence_score").desc(), F.col("id")])], [0.7, 0.3])


def _top(k: int) -> str:
    return f"dense AS (SELECT query_id AS claim_id, id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM sims) WHERE rank <= {k})"


_FIELDS = f"""anch AS (SELECT chunk_id AS id, coalesce(keywords, []) AS kw, list_transform(coalesce(keywords, []), lambda k: 'What about ' || k || '?') AS aq FROM {_RICH} WHERE text IS NOT NULL),
fld AS (SELECT id, 'k' AS field, array_to_string(kw, ' ') AS t FROM anch UNION ALL SELECT id, 'a', array_to_string(aq, ' ') FROM anch),
idx AS (SELECT DISTINCT id, field, tok FROM (SELECT id, field, unnest(string_split_regex(lower(t), '[^\\p{{L}}\\p{{N}}]+')) AS tok FROM fld) WHERE length(tok) BETWEEN 2 AND 20),
cw AS (SELECT claim_id, text, w, len(w) AS need FROM (SELECT query_id AS claim_id, text, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) BETWEEN 2 AND 20)) AS w FROM {_ASKED})),
met AS (SELECT claim_id, id, field, need, count(*) AS have FROM (SELECT claim_id, need, unnest(w) AS tok FROM cw) JOIN idx USING (tok) GROUP BY 1, 2, 3, 4),
over AS (SELECT claim_id, id, all_of, len(list_intersect({_lex('text')}, {_lex("array_to_string(list_concat(aq, kw), ' ')")})) AS overlap
FROM (SELECT claim_id, id, max(have) = max(need) OR bool_or(have = need) AS all_of FROM met GROUP BY 1, 2) JOIN cw USING (claim_id) JOIN anch USING (id))"""
_FUSE = """fz AS (SELECT claim_id, id, sum(s) AS e FROM (SELECT claim_id, id, 0.7 / (60 + rank) AS s FROM dense UNION ALL SELECT claim_id, id, 0.3 / (60 + rank) FROM lex) GROUP BY 1, 2),
hyb AS (SELECT claim_id, id, round(e, 6) AS score, row_number() OVER (PARTITION BY claim_id ORDER BY round(e, 12) DESC, id) AS rank FROM fz)"""


@query(f"""{_SIM}, {_top(60)}, {_FIELDS},
lex AS (SELECT * FROM (SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY overlap DESC, id DESC) AS rank FROM over) WHERE rank <= 60), {_FUSE}
SELECT claim_id, id, score, CAST(rank AS INT) AS rank FROM hyb WHERE rank <= 3""")
def hybrid_top3(spark, d):
    rows = _points(spark, d).withColumnRenamed("chunk_id", "id")
    lexical = retrieve.lexical_hits(_asked(spark, d), rows.select("id", "anchor_queries", "keywords"), mode="any_token")
    return retrieve.hybrid(_dense(spark, d, 60).withColumnRenamed("query_id", "claim_id"), lexical, 3)


_ASKS = "(?i)^(who is|what is|what are|who are|define|describe|explain)\\s+"


@query(f"""{_SIM}, {_top(9)}, term AS (SELECT query_id AS claim_id, list_filter({_words(f"lower(regexp_replace(regexp_replace({_strip('text')}, '{_ASKS}', ''), '[?., ]+$', ''))")}, lambda w: length(w) >= 2) AS terms
FROM (SELECT query_id, 'What is ' || text AS text FROM {_ASKED})),
z AS (SELECT claim_id, id, rank, similarity + CASE WHEN list_has_any(terms, list_transform(coalesce(keywords, []), lambda x: lower(x))) THEN 0.15 ELSE 0 END
+ CASE WHEN list_has_any(terms, list_transform(flatten(list_transform(coalesce(subtopics, []), lambda s: coalesce(s.keywords, []))), lambda x: lower(x))) THEN 0.10 ELSE 0 END AS exact
FROM dense JOIN term USING (claim_id) JOIN {_RICH} c ON c.chunk_id = id WHERE rank <= 3 OR len(terms) > 0)
SELECT claim_id, id, round(exact, 4) AS score, CAST(place AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY round(exact, 9) DESC, rank) AS place FROM z) WHERE place <= 3""")
def entity_boost_search(spark, d):
    asked = _asked(spark, d).withColumn("text", F.concat(F.lit("What is "), "text"))
    rows = _newest(spark, d, "enriched_chunks").select(F.col("chunk_id").alias("id"), "keywords", "subtopics")
    return retrieve.boosted(_dense(spark, d, 9).withColumnRenamed("query_id", "claim_id"), asked, rows)


@query(f"""{_SIM}, {_top(40)}, z AS (SELECT claim_id, id, rank AS before, {_lex('q.text')} AS a, {_lex('c.text')} AS b FROM dense JOIN (SELECT query_id AS claim_id, text FROM {_ASKED}) q USING (claim_id) JOIN {_RICH} c ON c.chunk_id = id),
y AS (SELECT claim_id, id, before, round(CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0 END, 6) AS score FROM z)
SELECT claim_id, id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, before, id) AS rank FROM y) WHERE rank <= 3""")
def rerank(spark, d):
    pairs = _dense(spark, d, 40).withColumnRenamed("query_id", "claim_id").join(_asked(spark, d).withColumnRenamed("text", "claim"), "claim_id")
    pairs = pairs.join(_newest(spark, d, "enriched_chunks").select(F.col("chunk_id").alias("id"), "text"), "id")
    return retrieve.rerank(pairs)


# ---- evaluation

_PER = f"""WITH r AS (SELECT DISTINCT claim_id, collection, rank, chunk_id, doc_ids FROM retrieval_results), c AS (SELECT q.query_id AS claim_id, any_value(t.gt) AS gt FROM queries q JOIN ({_TRUTH}) t USING (query_id) GROUP BY 1),
p AS (SELECT c.claim_id, min(CASE WHEN list_has_any(doc_ids, gt) THEN rank END) AS first_rank, coalesce(sum(CAST(coalesce(list_has_any(doc_ids, gt), false) AS INT)), 0) AS n_rel FROM c LEFT JOIN (SELECT * FROM r WHERE rank <= 3) r ON r.claim_id = c.claim_id GROUP BY 1)"""


@query(_PER + " SELECT claim_id, first_rank IS NOT NULL AS hit, first_rank, round(coalesce(1.0 / first_rank, 0), 6) AS rr, round(n_rel / 3.0, 6) AS precision FROM p")
def hit_mrr_p(spark, d):
    out = evaluate.per_claim(_hits(spark, d).drop("topic_id", "score"), _claims(spark, d))
    return out.withColumn("rr", F.round("rr", 6)).withColumn("precision", F.round("precision", 6))


@query(_PER + """ SELECT count(*) AS total_claims, CAST(sum(CAST(first_rank IS NOT NULL AS INT)) AS BIGINT) AS hits, round(avg(CAST(first_rank IS NOT NULL AS INT)), 6) AS hit_at_k,
round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr, round(avg(n_rel / 3.0), 6) AS precision_at_k FROM p""")
def metrics(spark, d):
    return evaluate.summary(evaluate.per_claim(_hits(spark, d).drop("topic_id", "score"), _claims(spark, d)))


_RUNS = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY evaluated_at DESC NULLS LAST) rn FROM eval_results) WHERE rn = 1)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return latest(_t(spark, d, "eval_results"), "claim_id", "evaluated_at")


@query(f"""SELECT count(*) AS claims, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE NOT a AND b) AS only_b, count(*) FILTER (WHERE NOT a AND NOT b) AS neither,
round((avg(CAST(b AS INT)) - avg(CAST(a AS INT))) * 100, 4) AS delta_points FROM (SELECT baseline_hit AS a, enriched_hit AS b FROM {_RUNS} WHERE enriched_hit IS NOT NULL)""")
def contingency(spark, d):
    return _runs(spark, d).where("enriched_hit is not null").agg(*evaluate.contingency(F.col("baseline_hit"), F.col("enriched_hit")))


@query(f"""SELECT claim_id, example FROM (SELECT claim_id, example, row_number() OVER (PARTITION BY example ORDER BY claim_id) AS n FROM (
SELECT claim_id, 'gained' AS example FROM {_RUNS} WHERE NOT baseline_hit AND enriched_hit UNION ALL SELECT claim_id, 'hit' FROM {_RUNS} WHERE enriched_hit UNION ALL SELECT claim_id, 'miss' FROM {_RUNS} WHERE NOT enriched_hit)) WHERE n = 1""")
def first_examples(spark, d):
    return evaluate.first_examples(_runs(spark, d).select("claim_id", "baseline_hit", "enriched_hit")).select("claim_id", "example")


@query(f"""WITH c AS (SELECT q.query_id AS claim_id, any_value(t.gt) AS gt FROM queries q JOIN ({_TRUTH}) t USING (query_id) GROUP BY 1),
p AS (SELECT collection, r.claim_id, max(CAST(coalesce(list_has_any(doc_ids, gt), false) AS INT)) AS hit FROM (SELECT DISTINCT claim_id, collection, rank, doc_ids FROM retrieval_results WHERE rank <= 3) r JOIN c USING (claim_id) GROUP BY 1, 2)
SELECT collection, count(*) AS claims, round(avg(hit), 6) AS hit_at_3 FROM p GROUP BY 1""")
def collection_hits(spark, d):
    rows = evaluate.per_claim(_hits(spark, d).drop("topic_id", "score"), _claims(spark, d), keys=("collection",))
    return rows.groupBy("collection").agg(F.count("*").alias("claims"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_at_3"))


@query(f"""{_SIM}, {_top(60)}, {_FIELDS},
lex AS (SELECT * FROM (SELECT claim_id, id, row_number() OVER (PARTITION BY claim_id ORDER BY overlap DESC, id DESC) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY id) AS k FROM over WHERE all_of) WHERE k <= 60)), {_FUSE},
hits AS (SELECT 'dense_only' AS mode, claim_id, id, rank FROM dense WHERE rank <= 3 UNION ALL SELECT 'hybrid', claim_id, id, rank FROM hyb WHERE rank <= 3),
truth AS (SELECT a.query_id AS claim_id, gt, mode FROM {_ASKED} a JOIN ({_TRUTH}) USING (query_id), (SELECT unnest(['dense_only', 'hybrid']) AS mode)),
per AS (SELECT mode, claim_id, min(CASE WHEN list_has_any(doc_ids, gt) THEN rank END) AS first_rank, coalesce(sum(CAST(list_has_any(doc_ids, gt) AS INT)), 0) AS n FROM truth LEFT JOIN hits USING (mode, claim_id) LEFT JOIN {_RICH} c ON c.chunk_id = id GROUP BY 1, 2)
SELECT 'enriched' AS collection, m.mode, false AS fell_back, count(claim_id) AS total_claims, CAST(count(first_rank) AS BIGINT) AS hits, round(coalesce(count(first_rank) / nullif(count(claim_id), 0), 0), 6) AS hit_at_k,
round(coalesce(avg(CASE WHEN claim_id IS NOT NULL THEN coalesce(1.0 / first_rank, 0) END), 0), 6) AS mrr, round(coalesce(avg(n / 3.0), 0), 6) AS precision_at_k FROM (SELECT unnest(['dense_only', 'hybrid']) AS mode) m LEFT JOIN per USING (mode) GROUP BY m.mode""")
def ablation_matrix(spark, d):
    """Dense and hybrid search of one collection of chunks for the stated claims."""
    points = _points(spark, d).withColumn("point_id", tx.point_id(F.col("chunk_id")))
    claims_ = corpus.claims(_t(spark, d, "queries").where(F.col("query_id").try_cast("bigint") % 50 == 0), _t(spark, d, "qrels"))
    cells = [ablation.evaluate_cell(points, claims_, "enriched", m) for m in ablation.MODES]
    return cells[0].unionByName(cells[1])


# ---- topics


@query(f"""WITH l AS ({_LONG}), t AS (SELECT count(*) AS total FROM embeddings)
SELECT label, CAST(d AS INT) AS d, n, round(n / total, 6) AS weight, round(mean, 6) AS mean, round(sq - mean * mean + 1e-6, 6) AS variance FROM (SELECT label, d, count(*) AS n, avg(x) AS mean, avg(x * x) AS sq FROM l GROUP BY 1, 2), t""")
def gmm_mstep(spark, d):
    out = topics.mixture_step(_t(spark, d, "embeddings"), "vec_id", "label", "embedding")
    return out.select("label", "d", "n", *[F.round(c, 6).alias(c) for c in ("weight", "mean", "variance")])


_PARAMS = f"""p AS (SELECT label, d, n / total AS weight, mean, sq - mean * mean + 1e-6 AS variance FROM (SELECT label, d, count(*) AS n, avg(x) AS mean, avg(x * x) AS sq FROM ({_LONG}) GROUP BY 1, 2), (SELECT count(*) AS total FROM embeddings)),
e AS (SELECT l.vec_id, p.label, ln(any_value(weight)) - 0.5 * sum(ln(2 * pi() * variance) + (x - mean) ** 2 / variance) AS ld FROM ({_LONG}) l JOIN p USING (d) GROUP BY 1, 2)"""


@query(f"WITH {_PARAMS} SELECT vec_id, label, round(ld, 4) AS log_density FROM e")
def gmm_estep(spark, d):
    e = _t(spark, d, "embeddings")
    params = topics.mixture_step(e, "vec_id", "label", "embedding").select("label", "d", "weight", "mean", "variance")
    return topics.expectation_step(e, "vec_id", "embedding", params, "label").withColumn("log_density", F.round("log_density", 4))


@query(f"""WITH {_PARAMS}, m AS (SELECT vec_id, max(ld) AS top FROM e GROUP BY 1), s AS (SELECT vec_id, any_value(top) + ln(sum(exp(ld - top))) AS ll FROM e JOIN m USING (vec_id) GROUP BY 1)
SELECT k, round(-2 * ll + (2 * k * 64 + k - 1) * ln(n), 2) AS bic FROM (SELECT sum(ll) AS ll, count(*) AS n FROM s), (SELECT count(DISTINCT label) AS k FROM embeddings)""")
def gmm_bic(spark, d):
    e = _t(spark, d, "embeddings")
    params = topics.mixture_step(e, "vec_id", "label", "embedding").select("label", "d", "weight", "mean", "variance")
    ld = topics.expectation_step(e, "vec_id", "embedding", params, "label")
    top = F.max("log_density").over(Window.partitionBy("vec_id"))
    ll = ld.withColumn("top", top).groupBy("vec_id").agg((F.max("top") + F.log(F.sum(F.exp(F.col("log_density") - F.col("top"))))).alias("ll"))
    k = e.agg(F.countDistinct("label").alias("k"))
    out = ll.agg(F.sum("ll").alias("ll"), F.count("*").alias("n")).crossJoin(F.broadcast(k))  # one row each
    return out.select("k", F.round(-2 * F.col("ll") + (2 * F.col("k") * 64 + F.col("k") - 1) * F.log("n"), 2).alias("bic"))


@query()
def pca_gmm_topics(spark, d):
    found, _ = topics.gaussian_topics(_t(spark, d, "embeddings"), "embedding")
    return found.select("vec_id", "label", "topic")


@query()
def granular_topics(spark, d):
    return topics.granular_topics(_t(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", outlier=0.2)


@query()
def stage_files(spark, d):
    """The normalized chunks that every stage begins with."""
    return files.normalize_chunks(_newest(spark, d, "chunks").select("chunk_id", "doc_ids", "text", "token_count", "topic_id", "keywords")).select("chunk_id", "token_count", "topic_id", F.size("doc_ids").alias("n_docs"))


ORACLE_SQL["stage_files"] = f"SELECT chunk_id, CAST(coalesce(token_count, len({_words('text')})) AS INT) AS token_count, coalesce(topic_id, -1) AS topic_id, CAST(len(coalesce(doc_ids, [])) AS INT) AS n_docs FROM {_CHUNKS}"


# ---- enrichment and comparison of runs

_FIT = f"""WITH a AS (SELECT DISTINCT topic_id, core_sentences[1] AS text FROM topic_anchors), q AS ({_BAG.format(k="topic_id", t="a")}), c AS ({_BAG.format(k="chunk_id", t=_RICH)}),
ql AS (SELECT topic_id, sqrt(sum(n * n)) AS l FROM q GROUP BY 1), cl AS (SELECT chunk_id, sqrt(sum(n * n)) AS l FROM c GROUP BY 1),
dots AS (SELECT topic_id, chunk_id, sum(q.n * c.n) AS x FROM q JOIN c USING (b) GROUP BY 1, 2),
r AS (SELECT topic_id, chunk_id, similarity, row_number() OVER (PARTITION BY topic_id ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT topic_id, chunk_id, round(x / (ql.l * cl.l), 6) AS similarity FROM dots JOIN ql USING (topic_id) JOIN cl USING (chunk_id))),
k AS (SELECT topic_id, chunk_id FROM (SELECT *, min(CASE WHEN rank <= 3 THEN similarity END) OVER (PARTITION BY topic_id) AS f FROM r) WHERE (rank <= 3 OR similarity >= f - 0.05) AND similarity >= 0.2)"""


def _fitting(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    anchors = _t(spark, d, "topic_anchors").select("topic_id", F.get("core_sentences", 0).alias("anchor_query")).distinct()
    return spread(_newest(spark, d, "enriched_chunks").select("chunk_id", "text")), anchors


@query(f"{_FIT} SELECT chunk_id, count(*) AS n, array_to_string(list(CAST(topic_id AS VARCHAR) ORDER BY topic_id), ',') AS topics FROM k GROUP BY 1")
def associations(spark, d):
    """Chunks that fit the first core sentence of a topic; words of other topics share little, hence the lower least similarity."""
    rich, anchors = _fitting(spark, d)
    out = enrich.associate(rich, anchors, least=0.2)
    return out.select("chunk_id", F.size("synthetic_queries").cast("long").alias("n"), F.array_join(F.transform("synthetic_queries", lambda q: q["subtopic_id"].cast("string")), ",").alias("topics"))


@query(f"""{_FIT}, w AS (SELECT chunk_id, list(text ORDER BY topic_id) AS new FROM k JOIN a USING (topic_id) GROUP BY 1)
SELECT c.chunk_id, array_to_string(list_concat(list_transform(coalesce(keywords, []), lambda x: 'What about ' || x || '?'), coalesce(new, [])), ' / ') AS anchor_queries FROM {_RICH} c LEFT JOIN w USING (chunk_id)""")
def appended_anchors(spark, d):
    """Anchor queries that fit a chunk behind those that it has."""
    rich, anchors = _fitting(spark, d)
    old = F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.concat(F.lit("What about "), k, F.lit("?")))
    chunks = _newest(spark, d, "enriched_chunks").select("chunk_id", old.alias("anchor_queries"))
    new = enrich.associate(rich, anchors, least=0.2).select("chunk_id", F.transform("synthetic_queries", lambda q: q["text"]).alias("anchor_queries"))
    return enrich.append(chunks, new, "anchor_queries").select("chunk_id", F.array_join("anchor_queries", " / ").alias("anchor_queries"))


_BASE = "(SELECT * FROM " + _CHUNKS + " WHERE chunk_id LIKE 'bl-%' AND text IS NOT NULL)"


def _bag_sims(table: str, name: str) -> str:
    """The similarities of _SIM for another table of chunks."""
    return f"""{name}c AS ({_BAG.format(k="chunk_id", t=table)}), {name}l AS (SELECT chunk_id, sqrt(sum(n * n)) AS l FROM {name}c GROUP BY 1),
{name}s AS (SELECT query_id AS claim_id, chunk_id AS id, round(sum(q.n * c.n) / (any_value(ql.l) * any_value(cl.l)), 6) AS similarity FROM q JOIN {name}c c USING (b) JOIN ql USING (query_id) JOIN {name}l cl USING (chunk_id) GROUP BY 1, 2),
{name}h AS (SELECT claim_id, list_has_any(flatten(list(coalesce(doc_ids, []))), any_value(gt)) AS hit, array_to_string(list(array_to_string(doc_ids, '|') ORDER BY rank), ' / ') AS top FROM (
SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY similarity DESC, id) AS rank FROM {name}s) JOIN truth USING (claim_id) JOIN {table} c ON c.chunk_id = id WHERE rank <= 3 GROUP BY 1)"""


@query(f"""{_SIM}, truth AS (SELECT a.query_id AS claim_id, gt FROM {_ASKED} a JOIN ({_TRUTH}) USING (query_id)), {_bag_sims(_BASE, "b")}, {_bag_sims("(SELECT * FROM " + _RICH + " WHERE text IS NOT NULL)", "e")}
SELECT t.claim_id, array_to_string(gt, ',') AS ground_truth, coalesce(b.hit, false) AS baseline_hit, coalesce(b.top, '') AS baseline_top, coalesce(e.hit, false) AS enriched_hit, coalesce(e.top, '') AS enriched_top
FROM truth t LEFT JOIN bh b USING (claim_id) LEFT JOIN eh e USING (claim_id)""")
def baseline_against_enriched(spark, d):
    """Hits of the stated claims in the chunks by characters and in the enriched ones, by dense search of both."""
    claims_ = corpus.claims(_t(spark, d, "queries").where(F.col("query_id").try_cast("bigint") % 50 == 0), _t(spark, d, "qrels"))
    base = embed(spread(_newest(spark, d, "chunks").where("chunk_id like 'bl-%' and text is not null").select("chunk_id", "text", "doc_ids")), "text")
    runs = ablation.two_runs(base, _points(spark, d), claims_, mode="dense_only")
    top = lambda c: F.array_join(f"{c}_top_doc_ids", " / ").alias(f"{c}_top")
    return runs.select("claim_id", F.array_join("ground_truth_doc_ids", ",").alias("ground_truth"), "baseline_hit", top("baseline"), "enriched_hit", top("enriched"))


class QuarterCounter:
    """Four characters to a token."""

    def count(self, texts: list[str]) -> list[int]:
        return [(len(t) + 3) // 4 for t in texts]


@query(f"""WITH s AS (SELECT doc_id, list(sentence ORDER BY sent_idx) AS sents, count(*) AS n FROM ({_SENTS}) GROUP BY 1),
w AS (SELECT doc_id, sents, CAST(n AS INT) AS n, CAST(unnest(range(0, greatest(n - 2, 1), 4)) AS INT) AS first FROM s),
k AS (SELECT doc_id, sents, first, n, (SELECT greatest(1, count(*)) FROM range(1, least(6, n - first) + 1) m(x) WHERE list_sum(list_transform(sents[first + 1:first + x], lambda t: (length(t) + 3) // 4)) <= 100) AS len FROM w),
e AS (SELECT *, max(first + len) OVER (PARTITION BY doc_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
c AS (SELECT doc_id, {_strip("array_to_string(sents[first + 1:first + len], chr(10) || chr(10))")} AS text, row_number() OVER (ORDER BY CAST(doc_id AS BIGINT), first) - 1 AS k FROM e WHERE before IS NULL OR first + len > before)
SELECT 'sw-' || lpad(CAST(k AS VARCHAR), CAST(greatest(5, length(CAST(k AS VARCHAR))) AS INT), '0') AS chunk_id, doc_id, text, CAST((length(text) + 3) // 4 AS INT) AS token_count FROM c""")
def window_chunks_counted(spark, d):
    """Windows under 100 tokens of a given counter."""
    own = QuarterCounter()
    cut = chunkers.window_chunks(spread(_docs(spark, d)), most=100, whole_sentences=True, counter=own)
    return chunkers.number(cut, "sentence_window", own).select("chunk_id", F.element_at("doc_ids", 1).alias("doc_id"), "text", "token_count")


_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


@query(f"SELECT chunk_id, array_to_string(list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda x: {_strip('x')} <> '')[1:3], chr(10)) AS lines FROM {_CHUNKS}")
def first_lines(spark, d):
    return _newest(spark, d, "chunks").select("chunk_id", tx.first_lines(F.col("text")).alias("lines"))


_FLAT = _strip(f"regexp_replace(coalesce(text, ''), '{_S}+', ' ', 'g')")


@query(f"SELECT chunk_id, {_strip("regexp_replace(" + _FLAT + ", '^[\"'']|[\"'']$', '', 'g')")} AS line FROM {_CHUNKS}")
def single_lines(spark, d):
    return _newest(spark, d, "chunks").select("chunk_id", tx.single_line(F.col("text")).alias("line"))


@query(f"SELECT c.chunk_id, substr(sha1(coalesce(c.text, '')), 1, 12) AS sign FROM {_RICH} c JOIN {_CHUNKS} r USING (chunk_id) WHERE sha1(coalesce(c.text, '')) = sha1(coalesce(r.text, ''))")
def traced_chunks(spark, d):
    """Enriched chunks whose text is still that of the chunk."""
    out = trace.same_chunks(_newest(spark, d, "enriched_chunks").select("chunk_id", "text"), _newest(spark, d, "chunks").select("chunk_id", "text"))
    return out.select("chunk_id", F.substring_index("signature", ":", -1).alias("sign"))


@query(f"""WITH c AS (SELECT topic_id, row_number() OVER (ORDER BY topic_id) - 1 AS col FROM (SELECT DISTINCT topic_id FROM {_RICH} WHERE topic_id IS NOT NULL AND topic_id <> -1)),
p AS (SELECT chunk_id, topic_id, list_transform(coalesce(subtopics, []), lambda s: s.confidence) AS p FROM {_RICH} WHERE topic_id IS NOT NULL)
SELECT chunk_id, topic_id, CAST(col AS INT) AS col, round(coalesce(p[col + 1], CASE WHEN topic_id <> -1 THEN list_max(p) ELSE 0.0 END, 0.0), 4) AS confidence FROM p LEFT JOIN c USING (topic_id)""")
def topic_confidence(spark, d):
    """Confidences with the recorded shares of sub-topics as rows of probabilities."""
    rich = _newest(spark, d, "enriched_chunks").where("topic_id is not null")
    p = F.transform(F.coalesce("subtopics", F.array().cast(rich.schema["subtopics"].dataType)), lambda s: s["confidence"])
    out = rich.select("chunk_id", "topic_id", p.alias("p")).join(F.broadcast(topics.topic_columns(rich)), "topic_id", "left")  # a row per topic
    return out.select("chunk_id", "topic_id", F.col("column").alias("col"), F.round(topics.confidence(F.col("topic_id"), F.col("column"), F.col("p")), 4).alias("confidence"))


@query(f"""SELECT c.chunk_id, coalesce(r.topic_id, -1) AS topic_id, CASE WHEN coalesce(r.topic_id, -1) = -1 THEN 'outlier' WHEN l.terms IS NULL THEN 'topic_' || r.topic_id ELSE array_to_string(l.terms[1:4], ' | ') END AS topic_label,
round(coalesce(r.confidence_score, 0.0), 4) AS confidence_score, array_to_string(coalesce(r.keywords, []), '|') AS keywords, CAST(len(coalesce(r.subtopics, [])) AS INT) AS n_subtopics
FROM {_CHUNKS} c LEFT JOIN {_RICH} r USING (chunk_id) LEFT JOIN (SELECT topic_id, list(DISTINCT k ORDER BY k) AS terms FROM (SELECT topic_id, unnest(keywords) AS k FROM {_RICH}) WHERE topic_id >= 0 GROUP BY 1) l ON l.topic_id = r.topic_id""")
def attached_metadata(spark, d):
    rich = _newest(spark, d, "enriched_chunks")
    labels = rich.where("topic_id >= 0").select("topic_id", F.explode("keywords").alias("k")).groupBy("topic_id").agg(F.array_sort(F.collect_set("k")).alias("terms"))
    out = enrich.attach_metadata(
        _newest(spark, d, "chunks"), rich.select("chunk_id", "keywords"), rich.select("chunk_id", "subtopics"), rich.select("chunk_id", "topic_id", F.col("confidence_score").alias("confidence")), labels
    )
    return out.select("chunk_id", "topic_id", "topic_label", "confidence_score", F.array_join("keywords", "|").alias("keywords"), F.size("subtopics").alias("n_subtopics"))
