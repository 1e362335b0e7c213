"""One example followed through the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text as tx


def matching_chunks(chunks: DataFrame, evidence_id: str, evidence: str, least: float = 0.25) -> DataFrame:
    """Chunks with the document's id; if there is none, those that share at least `least` of their words with the evidence."""
    wanted = tx.norm_id(F.lit(evidence_id))
    rows = chunks.withColumn("by_id", F.exists("doc_ids", lambda d: tx.norm_id(d) == wanted)).withColumn("ratio", tx.lex_ratio(F.col("text"), F.lit(evidence)))
    any_id = rows.agg(F.coalesce(F.bool_or("by_id"), F.lit(False)).alias("any_id"))
    out = rows.crossJoin(F.broadcast(any_id)).where(F.col("by_id") | (~F.col("any_id") & (F.col("ratio") >= least)))  # one row
    return out.withColumn("signature", tx.signature(F.col("chunk_id"), F.col("text"))).drop("any_id")


def same_chunks(later: DataFrame, earlier: DataFrame) -> DataFrame:
    """Rows of a later stage with the id and the text of one of the earlier."""
    sign = tx.signature(F.col("chunk_id"), F.col("text")).alias("signature")
    return later.withColumn("signature", sign).join(earlier.select("chunk_id", sign), ["chunk_id", "signature"], "left_semi")


def trace(evidence_id: str, evidence: str, raw: DataFrame, later: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """One example through the stages: the raw chunks of its evidence, and of each later table, in order, the rows that are still
    these chunks. A stage without the text (a collection's payload has it) can't be matched."""
    out = {"raw": matching_chunks(raw, evidence_id, evidence)}
    for name, table in later.items():
        out[name] = same_chunks(table, out["raw"])
    return out


def render(stages: dict[str, DataFrame], most: int = 5, lines: int = 3) -> str:
    """The stages for a reader: the first `most` chunks of each by id, with their first lines."""
    text = []
    for name, rows in stages.items():
        shown = rows.select("chunk_id", tx.first_lines(F.col("text"), lines).alias("head")).orderBy("chunk_id").limit(most).collect()
        text += [f"== {name}: {rows.count()} chunks", *(f"{r.chunk_id}: {r['head']}" for r in shown)]
    return "\n".join(text) + "\n"
