"""Vectors as arrays of doubles: similarity, normalization, means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """Of length one; a vector without length stays."""
    n = norm(a)
    return F.transform(doubles(a), lambda x: x / F.when(n > 0, n).otherwise(F.lit(1.0)))


def mean_by(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, n, centroid): the mean vector of each key, summed before the shuffle."""
    long = df.select(F.col(key), F.posexplode(doubles(F.col(vector))).alias("d", "x"))
    each = long.groupBy(key, "d").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = each.groupBy(key).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c"))
    return packed.select(key, "n", F.transform("c", lambda x: x["m"]).alias("centroid"))
