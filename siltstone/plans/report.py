"""Reports of an evaluation as JSON, Markdown and text. They render a few rows of metrics."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.plans.ablation import MODES

_METRICS = ("hit_at_k", "mrr", "precision_at_k")


def _cells(matrix: DataFrame, most: int = 10_000) -> list[dict]:
    rows = [r.asDict(True) for r in matrix.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError("not a matrix of metrics")
    return sorted(rows, key=lambda r: (r["collection"], MODES.index(r["mode"])))


def _write(out: dict, path: str) -> dict:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    return out


def _claims(details: DataFrame, most: int) -> list[dict]:
    """A row per claim; claims beyond `most` belong into a table, so there it is an error."""
    rows = [r.asDict(True) for r in details.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} claims: write the details as a table")
    return sorted(rows, key=lambda r: str(r["claim_id"]))


def comparison_json(
    matrix: DataFrame, path: str, stats: dict[str, dict] | None = None, details: dict[tuple[str, str], DataFrame] | None = None, metadata: dict | None = None,
    topics: dict[str, int] | None = None, most: int = 100_000,
) -> dict:
    """Metadata, and of each cell its metrics, the statistics of its chunks, its number of topics and a row per claim (evaluate.details)."""
    cells = []
    for r in _cells(matrix):
        found = (details or {}).get((r["collection"], r["mode"]))
        rows = [] if found is None else _claims(found, most)
        cells.append({**r, "chunk_stats": (stats or {}).get(r["collection"], {}), "optimal_k": (topics or {}).get(r["collection"]), "detailed_results": rows})
    return _write({"metadata": metadata or {}, "cells": cells}, path)


def format_metric(value: float | None) -> str:
    return "-" if value is None else f"{value:.4f}"


def comparison_markdown(matrix: DataFrame, path: str, stats: dict[str, dict] | None = None, metadata: dict | None = None, topics: dict[str, int] | None = None) -> str:
    """Metadata, a table with a line per collection and a column per mode and metric, one of chunk statistics and numbers of
    topics, and a part per cell; '-' for what is missing."""
    cells = _cells(matrix)
    by = {(r["collection"], r["mode"]): r for r in cells}
    names = list(dict.fromkeys(r["collection"] for r in cells))
    head = [f"{m} {x}" for m in MODES for x in _METRICS]
    lines = ["# Comparison", "", *[f"- {k}: {v}" for k, v in (metadata or {}).items()], *([""] if metadata else [])]
    lines += ["| collection | " + " | ".join([*head, "fell back"]) + " |", "|" + " --- |" * (len(head) + 2)]
    for n in names:
        values = [format_metric((by.get((n, m)) or {}).get(x)) for m in MODES for x in _METRICS]
        lines.append(f"| {n} | " + " | ".join([*values, "yes" if (by.get((n, "hybrid")) or {}).get("fell_back") else "no"]) + " |")
    lines += ["", "| collection | chunks | mean tokens | median tokens | topics |", "| --- | --- | --- | --- | --- |"]
    for n in names:
        s = (stats or {}).get(n, {})
        lines.append(f"| {n} | " + " | ".join([*(str(s.get(c, "-")) for c in ("n_chunks", "avg_tokens", "median_tokens")), str((topics or {}).get(n, "-"))]) + " |")
    for r in cells:
        lines += ["", f"## {r['collection']}, {r['mode']}", "", f"Claims {r['total_claims']}, hits {r['hits']}, " + ", ".join(f"{x} {format_metric(r[x])}" for x in _METRICS)]
    text = "\n".join(lines) + "\n"
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
    return text


def evaluation_json(summary: DataFrame, details: DataFrame, path: str, most: int = 100_000, metadata: dict | None = None) -> dict:
    """Metrics and a row per claim, with the configuration of the run if given."""
    return _write({**({"metadata": metadata} if metadata else {}), "summary_metrics": summary.collect()[0].asDict(), "detailed_results": _claims(details, most)}, path)


def run_report(runs: DataFrame, k: int = 3, compared: bool = True, width: int = 300) -> str:
    """The two runs of ablation.two_runs for a reader: hits, reciprocal ranks and precision of each, their overlap, and the first
    claim that only the enriched one hits (else its first hit, else its first miss)."""
    from siltstone.operators import evaluate

    def measured(name: str) -> dict:
        slot = runs.select("claim_id", "ground_truth_doc_ids", F.posexplode(f"{name}_top_doc_ids").alias("at", "d"))
        slot = slot.select("claim_id", (F.col("at") + 1).alias("rank"), F.split("d", r"\|").alias("doc_ids"))
        return evaluate.summary(evaluate.per_claim(slot, runs.select("claim_id", "ground_truth_doc_ids"), k)).collect()[0].asDict()

    names = ["baseline", "enriched"] if compared else ["enriched"]
    got = {n: measured(n) for n in names}
    total = got["enriched"]["total_claims"]
    if not total:
        return "No claims were evaluated.\n"
    lines = [f"Claims {total}, first {k} hits", "", f"{'run':<10}{'hits':>8}{'misses':>8}{'hit rate':>10}{'MRR':>10}{'precision':>11}"]
    lines += [f"{n:<10}{m['hits']:>8}{total - m['hits']:>8}{m['hit_at_k']:>10.4f}{m['mrr']:>10.4f}{m['precision_at_k']:>11.4f}" for n, m in got.items()]
    if compared:
        both = runs.agg(*evaluate.contingency(F.col("baseline_hit"), F.col("enriched_hit"))).collect()[0]
        better = "enriched" if both.delta_points > 0 else "baseline" if both.delta_points < 0 else "none"
        lines += ["", f"both {both.both}, only baseline {both.only_a}, only enriched {both.only_b}, neither {both.neither}", f"difference {both.delta_points:+.2f} points; better: {better}"]
    first = {r["example"]: r for r in evaluate.first_examples(runs).collect()}
    shown = next((first[x] for x in (("gained",) if compared else ()) + ("hit", "miss") if x in first), None)
    if shown is not None:
        cut = shown["claim_text"] if len(shown["claim_text"]) <= width else shown["claim_text"][: width - 1] + "…"
        lines += ["", f"Example ({shown['example']}): claim {shown['claim_id']}: {cut}", f"  truth: {', '.join(shown['ground_truth_doc_ids'])}"]
        lines += [f"  {n}: {', '.join(shown[f'{n}_top_doc_ids']) or '-'}" for n in names]
    return "\n".join(lines) + "\n"


def format_results(rows: list[dict], keywords: int = 8, width: int = 300) -> str:
    """Search results for a reader: the first keywords, and the text cut at a word."""
    import textwrap

    lines = []
    for r in rows:
        lines.append(f"#{r['rank']}  score {r['score']:.4f}  {r['id']}  docs {', '.join(r.get('doc_ids') or [])}")
        if r.get("keywords"):
            lines.append("    keywords: " + ", ".join(r["keywords"][:keywords]))
        lines.append("    " + textwrap.shorten(r.get("text") or "", width, placeholder=" …"))
    return "\n".join(lines)
