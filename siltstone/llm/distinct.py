"""How much a term sets its record apart from the whole collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.staging import join_spread, often, stage


def terms(*parts: Column, pattern: str = "[a-z0-9]{2,}") -> Column:
    """All runs of the pattern in the lower-cased parts, one after another; null parts have none."""
    found = [F.coalesce(F.regexp_extract_all(F.lower(p), F.lit(f"({pattern})"), 1), F.array().cast("array<string>")) for p in parts]
    return F.concat(*found)


def ppmi(df: DataFrame, record: str, term_array: str, alpha: float = 0.75, hot: int = 100_000) -> DataFrame:
    """Rows (record, term, tf, df, ppmi): positive pointwise mutual information of term and record.

    ppmi = max(0, ln(tf * S / (total(term) * size(record)^alpha))), S = sum over records of size^alpha: the record's share
    is smoothed by `alpha`, so very short records don't score high for being short. tf counts a term in a record, size all
    terms of a record, df the records of a term. Records that share an id are one record. Null terms, null arrays and a
    null record id give no rows. Other columns are not carried.

    Counts are taken within records first and staged, so terms are found once and only distinct terms of a record are
    shuffled. Terms and records with more than a ten-thousandth of all these counts, and more than `hot`, are joined apart from the rest, so that
    no task gets all rows of one and what is broadcast has under 10,000 rows.
    """
    one = df.where(F.col(f"`{record}`").isNotNull()).select(F.col(f"`{record}`").alias("r"), F.explode(F.col(f"`{term_array}`")).alias("t")).where("t is not null")
    joint = stage(one.groupBy("r", "t").agg(F.count("*").alias("tf")), "joint")
    size = joint.groupBy("r").agg(F.sum("tf").alias("size"))
    mass = size.agg(F.sum(F.pow(F.col("size").cast("double"), F.lit(alpha))).alias("mass"))
    total = joint.groupBy("t").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    both = join_spread(join_spread(joint, total, ["t"], often(joint, ["t"], least=hot)), size, ["r"], often(joint, ["r"], least=hot))
    score = F.log(F.col("tf") * F.col("mass") / (F.col("total") * F.pow(F.col("size").cast("double"), F.lit(alpha))))
    out = both.crossJoin(F.broadcast(mass))  # mass is one number
    return out.select(F.col("r").alias(record), F.col("t").alias("term"), "tf", "df", F.greatest(F.lit(0.0), score).alias("ppmi"))
