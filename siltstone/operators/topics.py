"""Topics by principal components and mixtures of diagonal Gaussians, typical sentences of a topic."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.vector import cosine, doubles, mean_by

_FLOOR = 1e-6


def _matrix(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    n = len(col)
    return np.asarray(col.flatten(), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _sum_rows(df: DataFrame, stats: str, width: int) -> np.ndarray:
    """Sum of the binary vectors that each partition made; one vector of `width` numbers per partition comes in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], [stats])

    parts = df.rdd.getNumPartitions()
    while parts > 32:  # sum them as a tree
        parts = math.ceil(parts / 32)
        df = df.repartition(parts).mapInArrow(add, f"{stats} binary")
    return sum((np.frombuffer(r[0]) for r in df.collect()), np.zeros(width))


def pca(df: DataFrame, vector: str, out: str = "reduced", components: int = 15) -> DataFrame:
    """df with the centred vector on its leading components: min(components, rows, dimensions), at least one.

    One pass sums moments (of the size of the dimension squared), one projects.
    """
    first = df.where(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).limit(1).collect()
    d = first[0][0] if first else 1
    x = df.where(F.col(vector).isNotNull()).select(doubles(F.col(vector)).alias("v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            m = _matrix(b.column(0))
            if len(m):
                n, s, q = n + len(m), s + m.sum(0), q + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[n], s, q.reshape(-1)]).tobytes()], pa.binary())], ["m"])

    total = _sum_rows(x.mapInArrow(moments, "m binary"), "m", 1 + d + d * d)
    n, mean = total[0], total[1 : 1 + d] / max(total[0], 1)
    values, vectors = np.linalg.eigh(total[1 + d :].reshape(d, d) / max(n, 1) - np.outer(mean, mean))
    k = max(1, int(min(components, n, d)))
    axes = vectors[:, np.argsort(-values)[:k]]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(k)])  # the largest part of an axis is positive
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mu, a = shared.value
        for b in batches:
            y = (_matrix(b.column(len(keep))) - mu) @ a if b.num_rows else np.zeros((0, a.shape[1]))
            at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * a.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.ListArray.from_arrays(at, pa.array(y.reshape(-1)))], [*keep, out])

    return df.where(F.col(vector).isNotNull()).select(*keep, doubles(F.col(vector)).alias("__v")).mapInArrow(project, schema)


class Mixture:
    """Weights, means and variances of a mixture of diagonal Gaussians."""

    def __init__(self, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.weight, self.mean, self.var = weight, mean, var

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        inv = 1 / self.var
        q = (x * x) @ inv.T - 2 * x @ (self.mean * inv).T + (self.mean**2 * inv).sum(1)
        return np.log(np.maximum(self.weight, 1e-300)) - 0.5 * (np.log(2 * np.pi * self.var).sum(1) + q)

    def labels(self, x: np.ndarray) -> np.ndarray:
        return self.log_parts(x).argmax(1)

    def bic(self, loglik: float, n: int) -> float:
        k, d = self.mean.shape
        return -2 * loglik + (2 * k * d + k - 1) * math.log(n)


def _responsibilities(mix: Mixture, x: np.ndarray) -> tuple[np.ndarray, float]:
    lp = mix.log_parts(x)
    top = lp.max(1, keepdims=True)
    e = np.exp(lp - top)
    s = e.sum(1, keepdims=True)
    return e / s, float((top + np.log(s)).sum())


def _start(sample: np.ndarray, k: int, seed: int) -> Mixture:
    """Means by k-means++ and a few rounds of k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = [sample[rng.integers(len(sample))]]
    for _ in range(k - 1):
        d = np.min([((sample - m) ** 2).sum(1) for m in c], axis=0)
        c.append(sample[rng.choice(len(sample), p=d / d.sum())] if d.sum() > 0 else sample[rng.integers(len(sample))])
    m = np.array(c)
    for _ in range(20):
        own = ((sample[:, None, :] - m[None]) ** 2).sum(2).argmin(1) if len(sample) * k < 4_000_000 else np.argmin(-2 * sample @ m.T + (m * m).sum(1), 1)
        m = np.array([sample[own == i].mean(0) if (own == i).any() else m[i] for i in range(k)])
    n = np.bincount(own, minlength=k)
    var = np.array([sample[own == i].var(0) if n[i] > 1 else sample.var(0) for i in range(k)]) + _FLOOR
    return Mixture(np.maximum(n, 1) / np.maximum(n, 1).sum(), m, var)


def fit_mixtures(df: DataFrame, vector: str, ks: list[int], seed: int = 42, rounds: int = 200, tol: float = 1e-3, start_rows: int = 20_000) -> dict[int, tuple[Mixture, float]]:
    """{k: (mixture, BIC)} by expectation maximization. One pass over all rows does a round for every k that still changes.

    The starting means come from a sample of at most `start_rows` rows; every round sees all rows.
    """
    x = df.where(F.col(vector).isNotNull()).select(doubles(F.col(vector)).alias("v")).cache()
    n = x.count()
    if n == 0:
        raise ValueError("no rows")
    rows = x.sample(min(1.0, 1.2 * start_rows / n), seed).limit(start_rows).collect() if n > start_rows else x.collect()
    sample = np.array(sorted(r[0] for r in rows))
    d = sample.shape[1]
    live = {k: _start(sample, k, seed) for k in sorted({max(1, min(k, n)) for k in ks})}
    last, done = dict.fromkeys(live, -math.inf), {}
    for _ in range(rounds):
        shared = df.sparkSession.sparkContext.broadcast(dict(live))
        width = sum(1 + k * (1 + 2 * d) for k in live)

        def step(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                m = _matrix(b.column(0))
                if not len(m):
                    continue
                at = 0
                for k, mix in shared.value.items():
                    r, ll = _responsibilities(mix, m)
                    for part in ([ll], r.sum(0), (r.T @ m).reshape(-1), (r.T @ (m * m)).reshape(-1)):
                        total[at : at + len(part)] += part
                        at += len(part)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

        total, at = _sum_rows(x.mapInArrow(step, "m binary"), "m", width), 0
        for k, mix in list(live.items()):
            ll, size = total[at], total[at + 1 : at + 1 + k]
            mean = total[at + 1 + k : at + 1 + k + k * d].reshape(k, d)
            square = total[at + 1 + k + k * d : at + 1 + k + 2 * k * d].reshape(k, d)
            at += 1 + k * (1 + 2 * d)
            if abs(ll - last[k]) / n < tol:
                done[k] = (mix, mix.bic(ll, n))
                del live[k]
                continue
            last[k] = ll
            size = np.maximum(size, 1e-12)[:, None]
            mu = mean / size
            live[k] = Mixture(size[:, 0] / n, mu, np.maximum(square / size - mu * mu, 0) + _FLOOR)
        if not live:
            break
    done |= {k: (mix, mix.bic(last[k], n)) for k, mix in live.items()}
    x.unpersist()
    return done


def k_range(n: int, least: int = 3, most: int = 20) -> list[int]:
    upper = min(most, n)
    return list(range(max(1, min(least, upper)), upper + 1)) if n > 0 else []


def best_k(fits: dict[int, tuple[Mixture, float]]) -> int:
    """The k of the smallest BIC, the smallest k of equals; 1 without fits."""
    return min(fits, key=lambda k: (fits[k][1], k)) if fits else 1


def label(df: DataFrame, vector: str, mix: Mixture, out: str = "topic") -> DataFrame:
    """df with the likeliest component of each vector."""
    shared = df.sparkSession.sparkContext.broadcast(mix)
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value.labels(_matrix(b.column(len(keep)))) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(own.astype(np.int32))], [*keep, out])

    return df.where(F.col(vector).isNotNull()).select(*keep, doubles(F.col(vector)).alias("__v")).mapInArrow(run, schema)


def gaussian_topics(df: DataFrame, vector: str, components: int = 15, least: int = 3, most: int = 20, seed: int = 42) -> tuple[DataFrame, int]:
    """df with `topic`, and the number of components chosen by BIC."""
    reduced = pca(df, vector, "__r", components)
    n = reduced.count()
    fits = fit_mixtures(reduced, "__r", k_range(n, least, most), seed) if n else {}
    k = best_k(fits)
    return (label(reduced, "__r", fits[k][0]) if fits else reduced.withColumn("topic", F.lit(0))).drop("__r"), k


def mixture_step(df: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """(group, d, n, weight, mean, variance): the maximization step for given memberships, in SQL."""
    long = df.where(F.col(group).isNotNull()).select(group, F.posexplode(doubles(F.col(vector))).alias("d", "x"))
    total = df.where(F.col(group).isNotNull()).agg(F.count("*").alias("total"))
    m = long.groupBy(group, "d").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("sq"))
    out = m.crossJoin(F.broadcast(total))  # one number
    return out.select(group, "d", "n", (F.col("n") / F.col("total")).alias("weight"), "mean", (F.col("sq") - F.col("mean") * F.col("mean") + _FLOOR).alias("variance"))


def expectation_step(df: DataFrame, key: str, vector: str, params: DataFrame, group: str, components: int = 1000) -> DataFrame:
    """(key, group, log_density) of every row under every component; there are at most `components`."""
    groups = [r[0] for r in params.select(group).distinct().limit(components + 1).collect()]
    if len(groups) > components:
        raise ValueError("too many components")
    groups.sort()
    rows = sorted(((groups.index(r[0]), r["d"], r["weight"], r["mean"], r["variance"]) for r in params.select(group, "d", "weight", "mean", "variance").collect()), key=lambda r: r[:2])
    w, mean, var = (np.array([r[i] for r in rows], np.float64).reshape(max(len(groups), 1), -1) for i in (2, 3, 4))
    shared = df.sparkSession.sparkContext.broadcast((groups, w, mean, var))  # components times dimensions
    schema = T.StructType([df.schema[key], params.schema[group], T.StructField("log_density", T.DoubleType())])
    kind = to_arrow_type(params.schema[group].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, m, v = shared.value
        for b in batches:
            for s in range(0, b.num_rows if names else 0, 2000):
                part = b.slice(s, 2000)
                x = _matrix(part.column(1))
                inv = 1 / v
                far = (x * x) @ inv.T - 2 * x @ (m * inv).T + (m * m * inv).sum(1)
                ld = np.log(weight[:, 0]) - (np.log(2 * math.pi * v).sum(1) + far) / 2
                at = np.repeat(np.arange(len(x)), len(names))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(names * len(x), kind), pa.array(ld.reshape(-1))], schema.fieldNames())

    return df.where(F.col(vector).isNotNull()).select(key, doubles(F.col(vector)).alias("v")).mapInArrow(run, schema)


def core_items(df: DataFrame, key: str, group: str, vector: str, n: int = 8) -> DataFrame:
    """(group, rank, key, similarity): the n items of each group nearest to its centroid by cosine; ties by key."""
    centre = mean_by(df, group, vector).select(group, "centroid")
    sims = df.join(centre, group).select(group, key, F.round(cosine(F.col(vector), F.col("centroid")), 6).alias("similarity"))
    w = Window.partitionBy(group).orderBy(F.col("similarity").desc(), key)
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def granular_topics(df: DataFrame, key: str, vector: str, few: int = 10, outlier: float = 0.0) -> DataFrame:
    """(key, topic_id, probability): an approximation of density clustering. Below `few` rows all are topic 0 with 1.0.

    Mixture topics stand for dense regions; the probability is the cosine to the topic's centroid within 0..1, and rows
    below `outlier` are topic -1 with 0.0.
    """
    if df.limit(few).count() < few:
        return df.select(key, F.lit(0).alias("topic_id"), F.lit(1.0).alias("probability"))
    found, _ = gaussian_topics(df.select(key, vector), vector)
    centre = mean_by(found, "topic", vector).select("topic", "centroid")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col(vector), F.col("centroid"))))
    out = found.join(centre, "topic").select(key, "topic", p.alias("p"))
    far = F.col("p") < outlier
    return out.select(key, F.when(far, -1).otherwise(F.col("topic")).alias("topic_id"), F.when(far, 0.0).otherwise(F.round("p", 4)).alias("probability"))


def topic_columns(topics: DataFrame, topic: str = "topic_id") -> DataFrame:
    """(topic_id, column): the place of each topic but -1 in a row of probabilities, in the order of ids. Topics are few."""
    ids = topics.where(F.col(topic).isNotNull() & (F.col(topic) != -1)).select(F.col(topic).alias("topic_id")).distinct()
    return ids.withColumn("column", F.row_number().over(Window.orderBy("topic_id")) - 1)  # one row per topic


def confidence(topic: Column, column: Column, probabilities: Column) -> Column:
    """The topic's probability; where it has no column, the greatest of the row, for topic -1 or without any 0.0."""
    other = F.when(topic != -1, F.array_max(probabilities)).otherwise(0.0)
    return F.coalesce(F.get(probabilities, column), other, F.lit(0.0))
