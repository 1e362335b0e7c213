"""Chunks that arrive in files are indexed batch by batch; a later version of a chunk replaces the earlier."""

import json

from siltstone.functions.models import HashEmbedder
from siltstone.sources import store
from siltstone.streaming.indexing import index_stream, late_counts

SCHEMA = "chunk_id string, doc_ids array<string>, text string, token_count int, topic_id int, keywords array<string>, ingested_at timestamp"


def put(path, name, rows):
    (path / name).write_text("\n".join(json.dumps(dict(zip(("chunk_id", "doc_ids", "text", "ingested_at"), r))) for r in rows), encoding="utf-8")


def test_index_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    root, check = str(tmp_path / "root"), str(tmp_path / "check")
    run = lambda: index_stream(spark.readStream.schema(SCHEMA).json(str(source)), root, "live", check, HashEmbedder(16)).awaitTermination()
    put(source, "a.json", [("c1", ["1"], "alpha", "2024-01-01T00:00:00"), ("c2", ["2"], "beta", "2024-01-01T01:10:00")])
    run()
    put(source, "b.json", [("c1", ["1"], "gamma", "2024-01-01T02:00:00")])
    run()
    assert {r.chunk_id: r.text for r in store.read_collection(spark, root, "live").collect()} == {"c1": "gamma", "c2": "beta"}


def test_late_counts(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, "a.json", [("c1", ["1"], "x", "2024-01-01T00:00:00"), ("c2", ["1"], "y", "2024-01-01T00:20:00")])
    q = late_counts(spark.readStream.schema(SCHEMA).json(str(source))).writeStream.format("memory").queryName("late").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.sql("SELECT n FROM late").collect()] == [2]
