"""python -m siltstone: the stages over Parquet tables of documents, queries and judgements.

run      chunk, enrich, index and evaluate by several methods; skipped stages are read from --root
compare  baseline against enriched collection of --root, for all claims
index    the chunks of a JSON file into a collection of --root
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from siltstone.plans import ablation, report
from siltstone.sources import corpus, files, store
from siltstone.staging import ship


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["run", "compare", "index"])
    p.add_argument("--root", required=True, help="folder of stages and collections")
    for x in ("documents", "queries", "qrels"):
        p.add_argument(f"--{x}", help=f"Parquet table of {x}")
    p.add_argument("--methods", nargs="+", default=list(files.METHODS))
    p.add_argument("--mode", default="both", choices=["both", *ablation.MODES])
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--sample", type=int, help="so many claims, drawn with --seed")
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--limit", type=int, help="so many documents")
    p.add_argument("--rerank-candidates", type=int)
    p.add_argument("--baseline", default="baseline_char")
    p.add_argument("--enriched", default="semantic_gmm")
    p.add_argument("--file", help="JSON array of chunks")
    p.add_argument("--report", help="path without ending for the reports")
    for x in ("corpus", "chunking", "enrichment", "indexing"):
        p.add_argument(f"--skip-{x}", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    """Runs a command and returns what it printed."""
    p = parser()
    a = p.parse_args(argv)
    if a.skip_corpus and not a.skip_chunking:
        p.error("--skip-corpus requires --skip-chunking")
    needed = {"index": ["file"], "compare": ["queries", "qrels"], "run": ["queries", "qrels"] + ([] if a.skip_corpus else ["documents"])}[a.command]
    if missing := [x for x in needed if getattr(a, x) is None]:
        p.error("missing: " + ", ".join(f"--{x}" for x in missing))
    spark = spark or SparkSession.builder.getOrCreate()
    ship(spark)
    if a.command == "index":
        out = f"{store.index_file(spark, a.file, a.root, a.enriched)} points\n"
    else:
        read = spark.read.parquet
        qrels = read(a.qrels)
        docs = None if a.skip_corpus or a.documents is None else corpus.load_corpus(read(a.documents), qrels, a.limit)
        claims = corpus.sample_claims(corpus.claims(read(a.queries), qrels, docs), a.sample, a.seed)
        if a.command == "compare":
            runs, compared = ablation.compare_runs(spark, a.root, claims, a.enriched, a.baseline, a.top_k, candidates=a.rerank_candidates)
            out = report.run_report(runs, a.top_k, compared)
        else:
            matrix = ablation.run(
                spark, docs, claims, a.root, a.methods, a.mode, a.top_k, a.skip_chunking, a.skip_enrichment, a.skip_indexing, candidates=a.rerank_candidates
            )
            known = {m: files.stage_path(a.root, "anchors", m) for m in a.methods}
            topics = {m: r[0]["k"] for m, f in known.items() if (r := read(f).select("k").limit(1).collect())}
            stats = {m: ablation.chunk_stats(spark, a.root, m) for m in a.methods}
            meta = {"methods": ", ".join(a.methods), "mode": a.mode, "top_k": a.top_k, "claims": claims.count()}
            matrix = matrix.persist()
            out = report.comparison_markdown(matrix, (a.report or f"{a.root}/comparison") + ".md", stats, meta, topics)
            report.comparison_json(matrix, (a.report or f"{a.root}/comparison") + ".json", stats, None, meta, topics)
    print(out, end="")
    return out


if __name__ == "__main__":
    main()
