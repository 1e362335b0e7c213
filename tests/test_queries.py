"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import os
import random
from collections import Counter

import duckdb
import pytest

from siltstone.operators import chunkers
from siltstone.queries import ORACLE_SQL, QUERIES
from siltstone.sources import corpus


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, float):
        return round(v, 5)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_what_has_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"char_chunks_500_50", "sampled_claims", "pca_gmm_topics", "granular_topics"}


def test_char_chunks_equal_one_by_one(spark, small):
    docs = corpus.load_corpus(spark.read.parquet(f"{small}/documents.parquet")).collect()
    want = []
    for r in sorted(docs, key=lambda r: int(r.doc_id)):
        whole = f"{r.title}\n\n{r.text}" if r.title else r.text
        want += [(r.doc_id, p) for p in chunkers.split_recursively(whole, 500, 50)]
    got = sorted(QUERIES["char_chunks_500_50"](spark, small).collect(), key=lambda r: r.chunk_id)
    assert [(r.doc_id, r.text) for r in got] == want and [r.chunk_id for r in got] == [f"bl-{i:05d}" for i in range(len(want))]


def test_sampled_claims_equal_one_by_one(spark, small):
    ids = sorted(r.claim_id for r in QUERIES["claims"](spark, small).collect())
    got = {r.claim_id for r in QUERIES["sampled_claims"](spark, small).collect()}
    assert got == ({ids[i] for i in random.Random(42).sample(range(len(ids)), 20)} if len(ids) > 20 else set(ids))


def test_topics_of_vectors(spark, small):
    rows = QUERIES["pca_gmm_topics"](spark, small).collect()
    assert len({r.vec_id for r in rows}) == len(rows) and len({r.topic for r in rows}) >= 3
    fine = QUERIES["granular_topics"](spark, small).collect()
    assert len(fine) == len(rows) and all(0 <= r.probability <= 1 and (r.topic_id >= 0 or r.probability == 0) for r in fine)


def test_subtopics_use_all_terms(spark, tmp_path):
    common = " ".join(f"word{i:02}" for i in range(60))
    rows = [("a", f"{common} {common}", 0), ("b", "rare1 rare2 rare3 rare4", 0), ("c", "other things entirely here", 1)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "chunk_id string, text string, topic_id int, ingested_at long")
    table.write.parquet(f"{tmp_path}/enriched_chunks.parquet")
    got = {r.chunk_id: r for r in QUERIES["subtopics"](spark, str(tmp_path)).collect()}
    assert (got["b"].n, got["b"].first, got["b"].confidence) == (1, 0, 1.0)  # its terms are beyond the 50 strongest of topic 0
