"""Small cases worked out by hand."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as tx
from siltstone.functions import models
from siltstone.functions.models import HashEmbedder, TemplateAnchor
from siltstone.operators import chunkers, enrich, evaluate, keywords, retrieve, topics
from siltstone.plans import ablation, report, trace
from siltstone.sources import corpus, files, store


def one(spark, expr_of, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr_of.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "title,text,expected",
    [("", "A b. C d!  E?\nF", ["A b.", "C d!", "E?", "F"]), ("T", "A b.", ["T\n\nA b."]), ("", "", []), ("", " 　 ", [])],
)
def test_sentences(spark, title, text, expected):
    docs = spark.createDataFrame([("1", title, text)], "doc_id string, title string, text string")
    assert [r.sentence for r in chunkers.sentences(docs).orderBy("sent_idx").collect()] == expected


@pytest.mark.parametrize("n,expected", [(10, [(0, 6), (4, 6)]), (11, [(0, 6), (4, 6), (8, 3)]), (2, [(0, 2)]), (1, [(0, 1)])])
def test_windows(spark, n, expected):
    docs = spark.createDataFrame([("1", "", " ".join(f"s{i}." for i in range(n)))], "doc_id string, title string, text string")
    lists = chunkers.sentence_lists(docs).withColumn("tok", F.transform("sents", tx.word_count))
    got = lists.select(F.explode(chunkers.window_bounds(F.size("sents"), F.col("tok"), 6, 2, 512))).collect()
    assert [(r[0].first, r[0].len) for r in got] == expected


def test_windows_lose_what_is_trimmed(spark):
    docs = spark.createDataFrame([("1", "", " ".join("a b c d e." for _ in range(6)))], "doc_id string, title string, text string")
    got = chunkers.window_chunks(docs, most=10).collect()
    assert len(got) == 1 and got[0].text.count("a b c d e.") == 2


def test_packing_and_islands(spark):
    assert chunkers.pack_words("a b c d e", 2) == ["a b", "c d", "e"]
    rows = [("1", i, f"s{i}", t) for i, t in enumerate([1, 1, 2, 2, 1])]
    df = spark.createDataFrame(rows, "doc_id string, sent_idx int, sentence string, topic int")
    got = chunkers.topic_chunks(df).orderBy("pos").collect()
    assert [(r.text, r.topic_id) for r in got] == [("s0\n\ns1", 1), ("s2\n\ns3", 2), ("s4", 1)]
    assert [r.island for r in chunkers.topic_islands(df).orderBy("sent_idx").collect()] == [0, 0, 1, 1, 2]


def test_recursive_split():
    text = "\n\n".join(" ".join(f"w{i}{j}" for j in range(30)) for i in range(5))
    out = chunkers.split_recursively(text, 100, 20)
    assert all(0 < len(p) <= 100 for p in out)
    joined = " ".join(out)
    assert all(f"w{i}{j}" in joined for i in range(5) for j in range(30))
    assert chunkers.split_recursively("x" * 250, 100, 0) == ["x" * 100, "x" * 100, "x" * 50]
    assert chunkers.split_recursively("short", 100, 10) == ["short"]


def test_boundaries():
    v = np.eye(3)
    assert chunkers.is_boundary(v[:1], v[1], 0.55) and not chunkers.is_boundary(v[:1], v[0], 0.55)


def test_running_ids_follow_documents(spark):
    docs = spark.createDataFrame([("10", "", "A."), ("9", "", "B. C."), ("2", "", "")], "doc_id string, title string, text string")
    got = chunkers.number(chunkers.char_chunks(docs), "baseline_char").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.doc_ids) for r in got] == [("bl-00000", ["9"]), ("bl-00001", ["10"])]


def test_text_functions(spark):
    assert one(spark, tx.point_id(F.lit("chunk-00000"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-00000")) == "a8fa007a-f597-56d4-8f93-7438068074b0"
    assert sorted(one(spark, tx.lex_tokens(F.lit("A DNA-2 x9")))) == ["dna", "x9"]
    assert one(spark, tx.lex_ratio(F.lit("a b c"), F.lit("b c d e"))) == pytest.approx(2 / 3)
    assert [one(spark, tx.norm_id(F.lit(x))) for x in ("doc-0012", "ABC", "", None)] == ["12", "abc", "", ""]
    assert one(spark, tx.entity_terms(F.lit("What is BC1 RNA?"))) == ["bc1", "rna"]
    assert one(spark, tx.entity_terms(F.lit("define x"))) == one(spark, tx.entity_terms(F.lit("How does it work"))) == []
    label = lambda t, k: one(spark, tx.topic_label(F.lit(t), F.array(*[F.lit(x) for x in k]).cast("array<string>")))
    assert (label(-1, []), label(7, []), label(1, "abcde")) == ("outlier", "topic_7", "a | b | c | d")
    assert one(spark, tx.single_line(F.lit(' "a  b\n c" '))) == "a b c"
    assert one(spark, tx.first_lines(F.lit("a\n\n b\nc\nd"))) == "a\n b\nc"
    assert one(spark, tx.chunk_id("sw", F.lit(123456))) == "sw-123456"
    assert TemplateAnchor().write(3, []) == "What findings relate to: biomedical evidence (global topic 3)?"


def test_majority_takes_the_earliest_of_equals(spark):
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate([2, 1, 1, 2])], "k string, t int, i int")
    assert keywords.majority(df, "k", "t", "i").collect()[0].topic_id == 2


@pytest.mark.parametrize("sims,expected", [([0.8, 0.7, 0.6, 0.56, 0.54, 0.4], [0, 1, 2, 3]), ([0.5, 0.44, 0.43, 0.42], [0]), ([0.9], [0])])
def test_flexible_topk(spark, sims, expected):
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate(sims)], "g string, i int, similarity double")
    assert [r.i for r in retrieve.flexible_topk(df, "g", "i").orderBy("rank").collect()] == expected


def test_rrf(spark):
    rows = lambda ids: spark.createDataFrame([("c", x, i + 1) for i, x in enumerate(ids)], "claim_id string, id string, rank int")
    got = retrieve.rrf([rows("ab"), rows("bc")], [0.7, 0.3]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [("b", 0.016208), ("a", 0.011475), ("c", 0.004839)]
    with pytest.raises(ValueError):
        retrieve.rrf([rows("a")], [1.0, 2.0])


def test_dense_topk_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    for size in (64_000_000, 8 * 4 * 10):  # one block, and several
        got = retrieve.dense_topk(df.where("id < 40").withColumnRenamed("id", "query_id"), df, 4, block_bytes=size).collect()
        u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
        sims = np.round(u @ u.T, 6)
        want = {(q, int(i)) for q in range(40) for i in sorted(range(300), key=lambda i: (-sims[q, i], i))[:4]}
        assert {(r.query_id, r.id) for r in got} == want
    assert retrieve.dense_topk(df.limit(0).withColumnRenamed("id", "query_id"), df, 4).count() == 0


def test_entity_boost(spark):
    terms, kw = F.array(F.lit("rna")), F.array(F.lit("RNA"))
    sub = F.array(F.struct(F.array(F.lit("rna")).alias("keywords")))
    assert one(spark, retrieve.entity_boost(terms, kw, sub)) == pytest.approx(0.25)
    assert one(spark, retrieve.entity_boost(F.array().cast("array<string>"), kw, sub)) == 0.0


def test_metrics(spark):
    claims = spark.createDataFrame([("q", ["d2"]), ("none", ["d9"])], "claim_id string, ground_truth_doc_ids array<string>")
    hits = spark.createDataFrame([("q", 1, ["d1"]), ("q", 2, ["d2", "d3"]), ("q", 3, ["d2"])], "claim_id string, rank int, doc_ids array<string>")
    rows = {r.claim_id: r for r in evaluate.per_claim(hits, claims).collect()}
    assert (rows["q"].hit, rows["q"].first_rank, rows["q"].rr, rows["q"].precision) == (True, 2, 0.5, pytest.approx(2 / 3))
    assert (rows["none"].hit, rows["none"].rr) == (False, 0.0)
    empty = evaluate.summary(evaluate.per_claim(hits.limit(0), claims.limit(0))).collect()[0]
    assert (empty.total_claims, empty.hits, empty.mrr) == (0, 0, 0.0)


def test_mixture(spark):
    mix = topics.Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1)))
    _, ll = topics._responsibilities(mix, np.array([[-1.0], [1.0]]))
    assert ll == pytest.approx(-2.837877, abs=1e-6) and mix.bic(ll, 2) == pytest.approx(-2 * ll + 2 * math.log(2))
    assert topics.k_range(2) == [2] and topics.k_range(0) == [] and topics.k_range(50)[0] == 3
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.3, (80, 3)) for m in (-4, 0, 4)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    found, k = topics.gaussian_topics(df, "v", least=1, most=5)
    assert k == 3
    by = {}
    for r in found.collect():
        by.setdefault(r.i // 80, set()).add(r.topic)
    assert sorted(len(s) for s in by.values()) == [1, 1, 1] and len(set.union(*by.values())) == 3


def test_sampling(spark):
    df = spark.createDataFrame([(str(i), "t") for i in range(5)], "claim_id string, text string")
    assert corpus.sample_claims(df, None).count() == corpus.sample_claims(df, 5).count() == 5
    assert corpus.sample_claims(df, 0).count() == 0
    assert {r.claim_id for r in corpus.sample_claims(df, 2).collect()} == {r.claim_id for r in corpus.sample_claims(df.repartition(3), 2).collect()}


def test_collections(spark, tmp_path):
    root = str(tmp_path)
    rows = [("c1", ["1"], "alpha beta", 2, 0, ["alpha"]), ("c2", None, "gamma", 1, 1, None)]
    chunks = files.normalize_chunks(spark.createDataFrame(rows, "chunk_id string, doc_ids array<string>, text string, token_count int, topic_id int, keywords array<string>"))
    assert store.index_chunks(chunks, root, "x", embedder=HashEmbedder(16)) == 2
    again = spark.createDataFrame([("c1", ["1"], "delta", 1, 0, ["d"])], chunks.schema)
    assert store.index_chunks(again, root, "x", recreate=False, embedder=HashEmbedder(16)) == 1  # points it got
    assert store.read_collection(spark, root, "x").count() == 2
    got = {r.chunk_id: r for r in store.read_collection(spark, root, "x").collect()}
    assert got["c1"].text == "delta" and got["c1"].doc_id == "1" and got["c2"].doc_ids == []
    assert store.collections(spark, root) == ["x"] and not store.has_anchor_queries(store.read_collection(spark, root, "x"))
    with pytest.raises(ValueError):
        store.validate(spark, root, ["y"])
    with pytest.raises(KeyError):
        files.normalize_chunks(chunks.drop("text"))


def test_files(spark, tmp_path):
    p = tmp_path / "chunks.json"
    p.write_text('[{"chunk_id": "a", "text": "x", "doc_id": "7"}, {"chunk_id": "b", "text": "y", "doc_ids": ["1", "2"], "topic_id": 3}]', encoding="utf-8")
    got = {r.chunk_id: r for r in files.read_chunks(spark, str(p)).collect()}
    assert got["a"].doc_ids == ["7"] and got["a"].topic_id == -1 and got["b"].topic_id == 3
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), files.CHUNK).count() == 0
    with pytest.raises(ValueError):
        files.validate_methods(["nothing"])


def test_trace(spark):
    df = spark.createDataFrame([("c1", ["doc-1"], "a b c"), ("c2", ["2"], "x y z")], "chunk_id string, doc_ids array<string>, text string")
    assert [r.chunk_id for r in trace.matching_chunks(df, "1", "").collect()] == ["c1"]
    assert [r.chunk_id for r in trace.matching_chunks(df, "99", "y z w").collect()] == ["c2"]
    assert trace.same_chunks(df, df.limit(1)).count() == 1
    stages = trace.trace("2", "", df, {"enriched": df.withColumn("topic_id", F.lit(1)), "changed": df.withColumn("text", F.lit("other"))})
    assert {k: v.count() for k, v in stages.items()} == {"raw": 1, "enriched": 1, "changed": 0}
    assert trace.render(stages) == "== raw: 1 chunks\nc2: x y z\n== enriched: 1 chunks\nc2: x y z\n== changed: 0 chunks\n"


def test_ablation_and_reports(spark, tmp_path):
    text = "The alpha gene raises beta. The beta gene lowers gamma. A gamma cell dies. " * 3
    docs = spark.createDataFrame([(str(i), f"t{i}", text.replace("alpha", f"alpha{i}")) for i in range(6)], "doc_id string, title string, text string")
    claims = spark.createDataFrame([("q1", "alpha1 gene raises beta", ["1"]), ("q2", "alpha4 gene", ["4"])], "claim_id string, text string, ground_truth_doc_ids array<string>")
    got = ablation.run(spark, docs, claims, str(tmp_path), ["sentence_window"], embedder=HashEmbedder(64))
    rows = {r["mode"]: r for r in got.collect()}
    assert set(rows) == set(ablation.MODES) and rows["dense_only"]["hits"] == 2
    text = report.comparison_markdown(got, str(tmp_path / "r.md"))
    assert "sentence_window" in text and report.comparison_json(got, str(tmp_path / "r.json"))["cells"]


def test_versions_of_a_collection(spark, tmp_path):
    root, own = str(tmp_path), HashEmbedder(16)
    rows = spark.createDataFrame([(f"c{i}", ["1"], f"text {i}") for i in range(50)], "chunk_id string, doc_ids array<string>, text string")
    twice = rows.coalesce(1).unionByName(rows.where("chunk_id = 'c7'").withColumn("text", F.lit("last")))
    store.index_chunks(twice, root, "x", embedder=own, parts=8)
    before = store.read_collection(spark, root, "x")
    assert before.where("text = 'last'").count() == 1 and before.count() == 50
    new = spark.createDataFrame([("c7", ["2"], "newer", 1), ("n1", ["3"], "new", 2)], "chunk_id string, doc_ids array<string>, text string, topic_id int")
    store.index_chunks(new, root, "x", recreate=False, embedder=own)
    assert before.count() == 50  # a reader of the older version keeps it
    now = {r.chunk_id: r for r in store.read_collection(spark, root, "x").collect()}
    assert len(now) == 51 and now["c7"].text == "newer" and now["c1"].topic_id is None and now["n1"].topic_id == 2
    store.vacuum(spark, root, "x")
    assert store.read_collection(spark, root, "x").count() == 51
    with pytest.raises(ValueError):
        store.read_collection(spark, root, "y")


def test_topic_keywords(spark):
    df = spark.createDataFrame([(0, "alpha beta alpha"), (1, "gamma delta"), (-1, "alpha")], "topic_id int, text string")
    assert keywords.class_tfidf(df, all_or_none=True).count() == 0
    ranked = keywords.class_tfidf(df)
    assert {r.topic_id: r.keywords for r in keywords.topic_keywords(ranked, df, 1).collect()} == {0: ["alpha"], 1: ["delta"], -1: []}


def test_legacy_points(spark):
    rows = [("a", ["1", "2"], "x", [(" q ", "Anchor", 1), ("r", "other", 1)])]
    df = spark.createDataFrame(rows, "chunk_id string, doc_ids array<string>, text string, synthetic_queries array<struct<text string, typology string, subtopic_id int>>")
    got = store.points(df, HashEmbedder(4), legacy=True).collect()[0]
    assert got.doc_id == "1" and got.topic_id == -1 and got.anchor_queries == ["q"] and len(got.vector) == 4


def test_payload_doc_ids(spark):
    df = spark.createDataFrame([(["a"], None, "z"), ([], ["b", None], "z"), (None, None, "z"), (None, None, None)], "doc_ids array<string>, Docs array<string>, doc_id string")
    assert [r[0] for r in df.select(store.payload_doc_ids(df)).collect()] == [["a"], ["b"], ["z"], []]


def test_counters_and_scorers(spark, tmp_path):
    import base64

    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)) + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    counter = models.RanksCounter(str(path), r"\S+|\s+")
    df = spark.createDataFrame([(["abab", "", "x y"],), ([],), (None,)], "t array<string>")
    assert [r[0] for r in df.select(models.token_counts(F.col("t"), counter)).collect()] == [[2, 0, 3], [], None]
    assert [r[0] for r in df.select(models.token_counts(F.col("t"))).collect()] == [[1, 0, 2], [], None]

    class Longest:
        def score(self, pairs):
            return [len(b) for _, b in pairs]

    rows = spark.createDataFrame([("1", "a", 1, "q", "xx"), ("1", "b", 2, "q", "xxxx"), ("1", "c", 3, "q", None)], "claim_id string, id string, rank int, claim string, text string")
    assert [(r.id, r.score, r.rank) for r in retrieve.rerank(rows, Longest(), 2).orderBy("rank").collect()] == [("b", 4.0, 1), ("a", 2.0, 2)]


def test_runs_reports_and_commands(spark, tmp_path, small):
    from siltstone import __main__ as command

    root, own = str(tmp_path), HashEmbedder(64)
    rows = spark.createDataFrame([(f"c{i}", [str(i)], f"word{i} text") for i in range(6)], "chunk_id string, doc_ids array<string>, text string")
    claims = spark.createDataFrame([("1", "word1 text", ["1"]), ("2", "word2 text", ["9"])], "claim_id string, text string, ground_truth_doc_ids array<string>")
    with pytest.raises(ValueError):
        ablation.compare_runs(spark, root, claims, "rich", "base")
    store.index_chunks(rows, root, "rich", embedder=own)
    runs, compared = ablation.compare_runs(spark, root, claims, "rich", "base", mode="dense_only", embedder=own)
    got = {r.claim_id: r for r in runs.collect()}
    assert not compared and got["1"].enriched_hit and not got["2"].enriched_hit and not got["1"].baseline_hit and got["1"].enriched_top_doc_ids[0] == "1"
    store.index_chunks(rows, root, "base", embedder=own)
    runs, compared = ablation.compare_runs(spark, root, claims, "rich", "base", mode="dense_only", embedder=own)
    text = report.run_report(runs, 3, compared)
    assert compared and "both 1, only baseline 0, only enriched 0, neither 1" in text and "Example (hit): claim 1" in text
    cell = ablation.evaluate_cell(store.read_collection(spark, root, "rich"), claims, "rich", "dense_only", embedder=own)
    details = evaluate.details(ablation.search(store.read_collection(spark, root, "rich"), claims, "dense_only", embedder=own), claims)
    out = report.comparison_json(cell, f"{root}/r.json", {"rich": {"n_chunks": 6}}, {("rich", "dense_only"): details}, {"k": 3}, {"rich": 4})
    assert out["metadata"] == {"k": 3} and out["cells"][0]["optimal_k"] == 4 and len(out["cells"][0]["detailed_results"]) == 2
    assert "| rich | 6 | - | - | 4 |" in report.comparison_markdown(cell, f"{root}/r.md", {"rich": {"n_chunks": 6}}, {"k": 3}, {"rich": 4})
    assert files.write_json_array(rows, f"{root}/chunks.json") == 6
    assert command.main(["index", "--root", root, "--file", f"{root}/chunks.json"], spark) == "6 points\n"
    (tmp_path / "lines.json").write_text('{"chunk_id": "a"}\n')
    with pytest.raises(ValueError):
        files.read_list(spark, f"{root}/lines.json")
    with pytest.raises(SystemExit):
        command.main(["run", "--root", root, "--skip-corpus", "--queries", "q", "--qrels", "q"], spark)
    run = ["run", "--root", f"{root}/all", "--methods", "sentence_window", "--mode", "dense_only", "--sample", "5", *(x for n in ("documents", "queries", "qrels") for x in (f"--{n}", f"{small}/{n}.parquet"))]
    assert "## sentence_window, dense_only" in command.main(run, spark)


def test_thread_appends(spark):
    old = "array<struct<text string, typology string, subtopic_id int>>"
    chunks = spark.createDataFrame([("a", "one two", [("was", "anchor", 9)]), ("b", "three", None)], f"chunk_id string, text string, synthetic_queries {old}")
    anchors = spark.createDataFrame([(1, "one two")], "topic_id int, anchor_query string")
    got = {r.chunk_id: r for r in enrich.thread(chunks, anchors, 5).collect()}
    assert [q.text for q in got["a"].synthetic_queries] == ["was", "one two"] and got["b"].synthetic_queries == [] and got["b"].optimal_k == 5


def test_frequent_keys_are_joined_apart(spark):
    from siltstone.staging import join_spread, often, positions

    big = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(200)], "k int, v int")
    other = spark.createDataFrame([(i, f"n{i}") for i in range(0, 200, 3)] + [(1, "one")], "k int, n string")
    hot = often(big, ["k"], least=20)
    assert [r.k for r in hot.collect()] == [1]
    assert sorted(join_spread(big, other, ["k"], hot).collect()) == sorted(big.join(other, "k").collect())
    assert [r.at for r in positions(big, [F.col("v")], "at").orderBy("v").collect()] == list(range(200))
