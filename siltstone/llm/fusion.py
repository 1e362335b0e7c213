"""One ranking from several scores whose scales and distributions differ."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.staging import stage

# Coefficients of Acklam's rational approximation of the inverse normal distribution (relative error 1.15e-9).
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_LOW = 0.02425


def _poly(coefs: tuple[float, ...], x: str) -> str:
    s = f"{coefs[0]!r}D"
    for c in coefs[1:]:
        s = f"({s} * {x} + {c!r}D)"
    return s


def probit_sql(p: str, suffix: str = "D") -> str:
    """SQL for the inverse normal distribution of p in (0, 1); suffix marks literals as doubles."""
    q, r, t = f"({p} - 0.5D)", f"(({p} - 0.5D) * ({p} - 0.5D))", f"sqrt(-2D * ln({p}))"
    u = f"sqrt(-2D * ln(1D - {p}))"
    sql = (
        f"CASE WHEN {p} < {_LOW!r}D THEN {_poly(_C, t)} / {_poly(_D, t)} "
        f"WHEN {p} > {1 - _LOW!r}D THEN -{_poly(_C, u)} / {_poly(_D, u)} "
        f"ELSE {q} * {_poly(_A, r)} / {_poly(_B, r)} END"
    )
    return re.sub(r"(?<=\d)D\b", suffix, sql)


def probit(p: Column, name: str) -> Column:
    """The same as a column; `name` is the name of p's column."""
    return F.expr(probit_sql(f"`{name}`"))


def _pieces(df: DataFrame, by: list[str], x: str, cuts: int = 256) -> DataFrame:
    """df with b, the number of quantiles of x in its group that aren't above x: equal values share a piece."""
    parts = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    q = df.groupBy(*by).agg(F.percentile_approx(x, parts, F.lit(1000)).alias("cuts")).select(*[F.col(c).alias(f"q{c}") for c in by], "cuts")
    same = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"q{c}"))
        same = one if same is None else same & one
    here = F.size(F.filter("cuts", lambda c: c <= F.col(x)))
    return df.join(q, same).withColumn("b", F.when(F.col(x).isNull() | F.col("cuts").isNull(), -1).otherwise(here)).drop("cuts", *[f"q{c}" for c in by])


def _with_counts(df: DataFrame, by: list[str], descending: bool = False) -> DataFrame:
    """df with `before`, the rows of the group in the pieces before its piece, and n, those of the group."""
    order = Window.partitionBy(*by).orderBy(F.col("b").desc() if descending else F.col("b")).rowsBetween(Window.unboundedPreceding, -1)
    counted = df.groupBy(*by, "b").agg(F.count("*").alias("m"))
    counted = counted.select(*[F.col(c).alias(f"q{c}") for c in by], F.col("b").alias("qb"), F.coalesce(F.sum("m").over(order), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy(*by)).alias("n"))
    same = F.col("b") == F.col("qb")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"q{c}"))
    return df.join(counted, same).drop("qb", *[f"q{c}" for c in by])


def _mean(z: list[Column], weights: list[float]) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    top, low, n = zero, zero, F.lit(0)
    for c, w in zip(z, weights):
        top, low, n = top + F.coalesce(c * w, zero), low + F.when(c.isNotNull(), w).otherwise(0.0), n + c.isNotNull().cast("int")
    return F.round(top / F.when(low != 0, low), 9), n


def _ordinary(wide: DataFrame, weights: list[float]) -> DataFrame:
    """(g, i, fused, n_scores, place) with all of a group in one place: one shuffle, one sort for each score and for the result."""
    g, z, out = Window.partitionBy("g"), [], wide
    for k in range(len(weights)):
        w = g.orderBy(F.col(f"v{k}").asc_nulls_last())
        ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
        p = (F.rank().over(w) + (ties - 1) / 2 - 0.5) / F.count(f"v{k}").over(g)
        out = out.withColumn(f"p{k}", F.when(F.col(f"v{k}").isNotNull(), p))
        z.append(probit(F.col(f"p{k}"), f"p{k}"))
    z = [F.when(F.col(f"p{k}").isNotNull(), c) for k, c in enumerate(z)]
    fused, n = _mean(z, weights)
    rows = out.select("g", "i", fused.alias("fused"), n.alias("n_scores"))
    return rows.withColumn("place", F.row_number().over(g.orderBy(F.col("fused").desc_nulls_last(), "i")).cast("long"))


def _hot(wide: DataFrame, weights: list[float]) -> DataFrame:
    """The same for groups too large for one task: each score, and the result, is ranked piece by piece."""
    rows = wide.withColumn("u", F.monotonically_increasing_id())
    rows = stage(rows, "hot")  # so that the numbers stay
    long = rows.select("g", "u", F.posexplode(F.array(*[F.col(f"v{k}") for k in range(len(weights))])).alias("k", "x")).where("x is not null")
    cut = _with_counts(_pieces(long, ["g", "k"], "x"), ["g", "k"])
    w = Window.partitionBy("g", "k", "b").orderBy("x")
    ties = F.count("*").over(w.rangeBetween(Window.currentRow, Window.currentRow))
    ranked = cut.withColumn("p", (F.col("before") + F.rank().over(w) + (ties - 1) / 2 - 0.5) / F.col("n"))
    each = ranked.select("u", "k", probit(F.col("p"), "p").alias("z")).groupBy("u").agg(*[F.max(F.when(F.col("k") == k, F.col("z"))).alias(f"z{k}") for k in range(len(weights))])
    fused, n = _mean([F.col(f"z{k}") for k in range(len(weights))], weights)
    scored = rows.select("g", "i", "u").join(each, "u", "left").select("g", "i", fused.alias("fused"), n.alias("n_scores"))
    placed = _with_counts(_pieces(scored, ["g"], "fused"), ["g"], descending=True)
    by = Window.partitionBy("g", "b").orderBy(F.col("fused").desc_nulls_last(), "i")
    return placed.select("g", "i", "fused", "n_scores", (F.col("before") + F.row_number().over(by)).alias("place"))


def fuse(df: DataFrame, group: str, item: str, scores: dict[str, float], hot_rows: int = 500_000) -> DataFrame:
    """Rows (group, item, fused, n_scores, place), one per row of df.

    Each score becomes its percentile within the group, (average rank - 0.5) / n over the items that have it, then the
    normal deviate of that; `fused` is the mean over the scores an item has, weighted by `scores`. Higher is better; place
    counts from 1 by fused (rounded to 9 digits), descending, then item. Null and NaN scores count neither for nor against
    an item; an item without any score has fused null and comes last. A score that all items share gives 0 to all. Ties
    share their average rank. Repeated items are ranked each. A null group is a group. Other columns are not carried.

    Groups of more than `hot_rows` rows are cut at quantiles and ranked piece by piece; ranks stay exact, as equal values
    fall into one piece and the pieces' counts are added.
    """
    names = list(scores)
    # -0.0 and 0.0 are one value
    value = [F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double") + F.lit(0.0)).alias(f"v{k}") for k, c in enumerate(names)]
    wide = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), *value)
    hot = wide.groupBy("g").agg(F.count("*").alias("m")).where(F.col("m") > hot_rows).select(F.col("g").alias("hg"))
    same, weights = F.col("g").eqNullSafe(F.col("hg")), [float(scores[c]) for c in names]
    found = _ordinary(wide.join(hot, same, "left_anti"), weights)
    if hot.limit(1).count():
        found = found.unionByName(_hot(wide.join(hot, same, "left_semi"), weights))
    return found.select(F.col("g").alias(group), F.col("i").alias(item), "fused", "n_scores", F.col("place").cast("int").alias("place"))
