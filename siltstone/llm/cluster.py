"""Clusters of similar texts: cluster-feature trees, Ward's agglomeration of their leaves, one pass of assignment."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.staging import stage

TERMS = 1 << 14  # hashed terms
_WORD = re.compile(r"[^\W\d_]{3,}|[぀-ヿ㐀-鿿฀-๿]{2}")
_BLOCKS = 64
_COMMON = 12  # at most so many leading directions are common to large parts of the texts
_FALL = 2.0  # by so much at least strength falls behind them
_GRID = float(1 << 20)  # sums of whole numbers of this fraction don't depend on their order


class Tree:
    """A cluster-feature tree over directions. An entry is (n, sum of unit vectors); its direction is that of the sum.

    A vector goes down to the entry of the nearest direction and joins it if their cosine is at least `near`; full nodes split
    at their farthest pair. Beyond `most` leaf entries the lightest are set aside, down to three quarters of `most`, so that
    leaves stay narrow however many vectors come. Trees are merged by inserting the entries of one into the other.
    """

    WIDTH = 24

    def __init__(self, dim: int, most: int, near: float):
        self.dim, self.most, self.near = dim, most, near
        self._clear()

    def _clear(self) -> None:
        self.root, self.leaves = self._node(True), 0

    def _node(self, leaf: bool) -> dict:
        return {"leaf": leaf, "k": 0, "n": np.zeros(self.WIDTH + 1), "s": np.zeros((self.WIDTH + 1, self.dim)), "u": np.zeros((self.WIDTH + 1, self.dim)), "child": []}

    def insert_many(self, v: np.ndarray) -> None:
        """Insert unit vectors: those that join an entry side by side, the rest one by one in their order."""
        rest, _ = self._join(self.root, v, np.arange(len(v)))
        for i in np.sort(rest):
            self.insert(1.0, v[i])

    def _join(self, node: dict, v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows that join no entry below node, sum of the others)"""
        if not node["k"]:
            return rows, np.zeros(self.dim)
        cos = v[rows] @ node["u"][: node["k"]].T
        at = cos.argmax(1)
        left, total = [], np.zeros(self.dim)
        for i in np.unique(at):
            own = rows[at == i]
            if node["leaf"]:
                fits = cos[at == i, i] >= self.near
                left.append(own[~fits])
                n, s = int(fits.sum()), v[own[fits]].sum(0)
            else:
                rest, s = self._join(node["child"][i], v, own)
                left.append(rest)
                n = len(own) - len(rest)
            if n:
                self._grow(node, i, n, s)
                total += s
        return np.concatenate(left), total

    def _grow(self, node: dict, i: int, n: float, s: np.ndarray) -> None:
        node["n"][i] += n
        node["s"][i] += s
        node["u"][i] = node["s"][i] / max(np.linalg.norm(node["s"][i]), 1e-12)

    def insert(self, n: float, s: np.ndarray) -> None:
        path, node, u = [], self.root, s / max(np.linalg.norm(s), 1e-12)
        while True:
            k, i = node["k"], -1
            if k:
                cos = node["u"][:k] @ u
                i = int(np.argmax(cos))
            if node["leaf"]:
                break
            path.append((node, i))
            node = node["child"][i]
        for up, j in path:
            self._grow(up, j, n, s)
        if i >= 0 and cos[i] >= self.near:
            self._grow(node, i, n, s)
            return
        self._add(node, n, s, None)
        self.leaves += 1
        while node["k"] > self.WIDTH:
            a, b = self._split(node)
            if path:
                up, i = path.pop()
                self._set(up, i, a)
                self._add(up, float(b["n"][: b["k"]].sum()), b["s"][: b["k"]].sum(0), b)
                node = up
            else:
                self.root = self._node(False)
                for x in (a, b):
                    self._add(self.root, float(x["n"][: x["k"]].sum()), x["s"][: x["k"]].sum(0), x)
                break
        if self.leaves > self.most:
            n, s = self.entries()
            heavy = np.lexsort((np.arange(len(n)), -n))[: max(1, 3 * self.most // 4)]
            self._clear()
            for i in heavy:
                self.insert(float(n[i]), s[i])

    def _add(self, node: dict, n: float, s: np.ndarray, child: dict | None) -> None:
        k = node["k"]
        node["n"][k], node["s"][k] = 0.0, 0.0
        if child is not None:
            node["child"].append(child)
        node["k"] = k + 1
        self._grow(node, k, n, s)

    def _set(self, node: dict, i: int, child: dict) -> None:
        node["child"][i] = child
        node["n"][i], node["s"][i] = 0.0, 0.0
        self._grow(node, i, float(child["n"][: child["k"]].sum()), child["s"][: child["k"]].sum(0))

    def _split(self, node: dict) -> tuple[dict, dict]:
        k = node["k"]
        cos = node["u"][:k] @ node["u"][:k].T
        a, b = np.unravel_index(int(np.argmin(cos)), cos.shape)
        to_b = cos[:, b] > cos[:, a]
        if to_b.all() or not to_b.any():
            to_b = np.arange(k) >= k // 2
        out = self._node(node["leaf"]), self._node(node["leaf"])
        for i in range(k):
            self._add(out[int(to_b[i])], float(node["n"][i]), node["s"][i], None if node["leaf"] else node["child"][i])
        return out

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """(n, sums) of the leaf entries."""
        n, s, todo = [], [], [self.root]
        while todo:
            x = todo.pop()
            if x["leaf"]:
                n.append(x["n"][: x["k"]])
                s.append(x["s"][: x["k"]])
            else:
                todo += x["child"]
        return np.concatenate(n), np.concatenate(s)


def ward(n: np.ndarray, s: np.ndarray) -> list[tuple[int, int]]:
    """Merges (a, b) of Ward's agglomeration by nearest-neighbour chains; merge i makes number len(n) + i."""
    m = len(n)
    size, number, alive = n.astype(float).copy(), np.arange(m), np.ones(m, bool)
    c = s / n[:, None]
    q = (c * c).sum(1)
    d = np.maximum(q[:, None] + q[None] - 2 * c @ c.T, 0) * (size[:, None] * size[None] / (size[:, None] + size[None]))
    np.fill_diagonal(d, np.inf)
    out: list[tuple[int, int]] = []
    chain: list[int] = []
    while len(out) < m - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            row = np.where(alive, d[i], np.inf)
            j = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        i, j = min(i, j), max(i, j)
        out.append((int(number[i]), int(number[j])))
        t = size[i] + size[j] + size
        new = ((size[i] + size) * d[i] + (size[j] + size) * d[j] - size * d[i, j]) / t
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        alive[j] = False
        size[i] += size[j]
        number[i] = m + len(out) - 1
    return out


def cut_tree(n: np.ndarray, s: np.ndarray, merges: list[tuple[int, int]], coherence: float, least: float, sides: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, unit centroids) of the largest subtrees of at least `least` vectors that are one subject.

    Their vectors have a mean cosine of `coherence` with their centroid, and the centroids of the two sides of their last merge
    a cosine of `sides`, unless one side has under `least` vectors: else a small subject would vanish in a large one.
    """
    m = len(n)
    size, total = np.concatenate([n, np.zeros(len(merges))]), np.concatenate([s, np.zeros((len(merges), s.shape[1]))])
    for i, (a, b) in enumerate(merges):
        size[m + i], total[m + i] = size[a] + size[b], total[a] + total[b]
    norm = np.maximum(np.linalg.norm(total, axis=1), 1e-12)
    todo, taken = [m + len(merges) - 1] if m else [], []
    while todo:
        x = todo.pop()
        if size[x] < least:
            continue
        a, b = merges[x - m] if x >= m else (x, x)
        agree = min(size[a], size[b]) < least or total[a] @ total[b] >= sides * norm[a] * norm[b]
        if norm[x] >= coherence * size[x] and agree:
            taken.append(x)
        elif x >= m:
            todo += (a, b)
    taken.sort(key=lambda x: (-size[x], x))
    return size[taken], total[taken] / norm[taken][:, None]


def _term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    c = Counter(_WORD.findall(text.lower())) if text else {}
    slots: Counter = Counter()
    for w, n in c.items():
        slots[crc32(w.encode("utf-8", "surrogatepass")) % TERMS] += n
    k = np.fromiter(slots, np.int32, len(slots))
    return k, np.fromiter(slots.values(), np.float32, len(slots))


class _Rows:
    """Sparse unit rows of a batch: log counts times inverse document frequency."""

    def __init__(self, terms: list[bytes], counts: list[bytes], idf: np.ndarray):
        self.lens = np.fromiter(map(len, terms), np.int64, len(terms)) // 4
        self.k = np.frombuffer(b"".join(terms), np.int32)
        v = (1 + np.log(np.frombuffer(b"".join(counts), np.float32))) * idf[self.k]
        self.own = np.repeat(np.arange(len(terms)), self.lens)
        norm = np.sqrt(np.bincount(self.own, v * v, len(terms)))
        self.v = (v / np.maximum(norm, 1e-12)[self.own]).astype(np.float32)

    def times(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.lens), q.shape[1]), np.float32)
        some = np.flatnonzero(self.lens)
        if len(some):
            at = np.cumsum(self.lens)[some] - self.lens[some]
            out[some] = np.add.reduceat(q[self.k] * self.v[:, None], at, axis=0)
        return out

    def back(self, y: np.ndarray, out: np.ndarray) -> None:
        """Add the transposed rows times y to out, as whole numbers, so that sums are the same in any order."""
        if not len(self.k):
            return
        order = np.argsort(self.k, kind="stable")
        k = self.k[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        parts = np.rint(y[self.own[order]] * (self.v[order] * np.float32(_GRID))[:, None])
        out[k[first]] += np.add.reduceat(parts, first, axis=0, dtype=np.float64)


def _batches(batches: Iterator[pa.RecordBatch], idf: np.ndarray, at: int, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, _Rows]]:
    for b in batches:
        for s in range(0, b.num_rows, rows):
            part = b.slice(s, rows)
            yield part, _Rows(part.column(at).to_pylist(), part.column(at + 1).to_pylist(), idf)


def directions(rows: DataFrame, idf: np.ndarray, dims: int, passes: int = 4, fan: int = 32) -> np.ndarray:
    """(TERMS, dims) projection of term rows on their leading directions by subspace iteration, one pass over `rows` each.

    Directions that are much stronger than the rest tell languages and other registers apart, not subjects: those before the
    steepest fall of strength among the first ones are left out where that fall is at least twofold. Sums over rows are exact
    and so don't depend on partitions; they are added as a tree, `fan` at a time.
    """
    spark = rows.sparkSession
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((TERMS, dims + 1)))[0].astype(np.float32)
    tasks = min(rows.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism)  # of a staged table: no job
    schema = "k int, p long, z binary"
    for turn in range(passes):
        shared = spark.sparkContext.broadcast((q, idf))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            base, weight = shared.value
            z = np.zeros(base.shape)
            for _, r in _batches(batches, weight, 0):
                r.back(r.times(base), z)
            blocks = [x.astype(np.int64).tobytes() for x in np.split(z, _BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.nulls(_BLOCKS, pa.int64()), pa.array(blocks, pa.binary())], ["k", "p", "z"])

        def add(t: pa.Table) -> pa.Table:
            total = np.zeros(len(t.column("z")[0].as_py()) // 8, np.int64)
            for x in t.column("z"):
                total += np.frombuffer(x.as_buffer(), np.int64)
            return pa.table([t.column("k").slice(0, 1), t.column("p").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["k", "p", "z"])

        parts, left = rows.select("terms", "counts").coalesce(tasks).mapInArrow(run, schema).withColumn("p", F.spark_partition_id().cast("long")), tasks
        while True:
            left = math.ceil(left / fan)
            parts = parts.withColumn("p", F.floor(F.col("p") / fan) if left > 1 else F.lit(0).cast("long")).groupBy("k", "p").applyInArrow(add, schema)
            if left == 1:
                break
        got = sorted((r["k"], r["z"]) for r in parts.collect())
        z = np.concatenate([np.frombuffer(x, np.int64) for _, x in got]).reshape(TERMS, -1) / _GRID if got else np.zeros(q.shape)
        if turn < passes - 1:
            q = np.linalg.qr(z)[0].astype(np.float32)
    power, turned = np.linalg.eigh(q.T.astype(np.float64) @ z)
    order = np.argsort(-power)
    power = np.maximum(power[order], 1e-9)
    first = max(1, min(_COMMON, len(power) // 4))
    fall = power[:first] / power[1 : first + 1]
    drop = 1 + int(np.argmax(fall)) if fall.max() >= _FALL else 0
    return (q @ turned[:, order[drop:]]).astype(np.float32)


def clusters(
    df: DataFrame, id_col: str, text: str, dims: int = 64, leaves: int = 2048, near: float = 0.55, coherence: float = 0.66, least: int = 8, member: float = 0.2, fan: int = 8, per: int = 20_000
) -> DataFrame:
    """Rows (id, cluster, similarity), one per row of df with a text: its cluster, 0 the largest, and the cosine with its centroid.

    Texts become unit vectors of hashed, weighted words, projected on their leading directions. Groups of about `per` rows,
    by a hash of id and text, have a tree of at most `leaves` entries each; trees are merged `fan` at a time until one is
    left, whose entries come to the driver. Ward's agglomeration is cut where a cluster's vectors have a mean cosine of at
    least `coherence` with their centroid; of at least `least` texts. Then every row is assigned to the nearest centroid if
    its cosine with it, times the square root of the part of the text on the directions, is at least `member`. If trees had
    to set entries aside, rows that belong to none are clustered again by themselves, with numbers behind those so far, until
    no entry is set aside or no row finds a cluster; so the bound of leaves loses none.

    cluster is null for texts of no cluster and for texts without a word. Null texts have no row; repeated rows count each.
    The result doesn't depend on the order of rows, on partitions or on cores: sums are exact, groups and merges have a fixed
    order, ties between centroids go to the larger cluster. Empty tables give empty ones. Other columns are not carried.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType
    made = lambda *cols: T.StructType([T.StructField("id", kind), T.StructField("h", T.LongType()), *(T.StructField(c, t) for c, t in cols)])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_term_counts(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[i].tobytes() for x in found], pa.binary()) for i in (0, 1))], ["id", "h", "terms", "counts"])

    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    texts = texts.select("id", F.xxhash64(F.col("id").cast("string"), "text").alias("h"), "text")
    rows = stage(texts.mapInArrow(words, made(("terms", T.BinaryType()), ("counts", T.BinaryType()))), "terms")

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(TERMS, np.int64), 0
        for b in batches:
            n += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=TERMS)
            total += b.num_rows
        k = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([*k.tolist(), -1], pa.int32()), pa.array([*n[k].tolist(), total], pa.int64())], ["k", "n"])

    met = {r[0]: r[1] for r in rows.select("terms").mapInArrow(frequency, "k int, n long").groupBy("k").agg(F.sum("n")).collect()}
    n_texts, df_of = met.pop(-1, 0), np.zeros(TERMS)
    df_of[list(met)] = list(met.values())
    idf = np.log((n_texts + 1) / (df_of + 1)).astype(np.float32)
    base = directions(rows, idf, dims)
    dim = base.shape[1]
    shared = spark.sparkContext.broadcast((base, idf))  # of fixed size

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = shared.value
        for part, r in _batches(batches, weight, 2):
            y = r.times(q)
            size = np.linalg.norm(y, axis=1)
            none = size < 1e-6
            unit = y / np.maximum(size, 1e-12)[:, None]
            v = pa.array([None if x else u.tobytes() for x, u in zip(none, unit)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), v, pa.array(size.astype(np.float32))], ["id", "h", "v", "size"])

    def grow(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("v", "ascending")])
        tree = Tree(dim, leaves, near)
        v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(-1, dim).astype(np.float64)
        for s in range(0, len(v), 250):
            tree.insert_many(v[s : s + 250])
        return _entries(tree, t)

    def merge(t: pa.Table) -> pa.Table:
        n, s = np.array(t.column("n")), np.frombuffer(b"".join(t.column("s").to_pylist())).reshape(-1, dim)
        tree = Tree(dim, leaves, near)
        for i in np.lexsort((*s.T, -n)):
            tree.insert(float(n[i]), s[i])
        return _entries(tree, t)

    def _entries(tree: Tree, t: pa.Table) -> pa.Table:
        n, s = tree.entries()
        return pa.table([pa.array([t.column("p")[0].as_py()] * len(n), pa.int64()), pa.array(n), pa.array([x.tobytes() for x in s], pa.binary())], names=["p", "n", "s"])

    def leaf_entries(rows: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray]:
        parts = max(1, math.ceil(count / per))
        keyed = rows.select("h", "v", F.pmod("h", F.lit(parts)).alias("p"))
        features = keyed.groupBy("p").applyInArrow(grow, "p long, n double, s binary")
        while parts > 1:
            features = features.withColumn("p", F.floor(F.col("p") / fan)).groupBy("p").applyInArrow(merge, "p long, n double, s binary")
            parts = math.ceil(parts / fan)
        last = features.collect()  # at most `leaves` rows
        n, s = np.array([r["n"] for r in last]), np.array([np.frombuffer(r["s"]) for r in last]).reshape(len(last), dim)
        order = np.lexsort((*s.T, -n))
        return n[order], s[order]

    left = stage(rows.mapInArrow(project, made(("v", T.BinaryType()), ("size", T.FloatType()))), "vectors")
    out = made(("v", T.BinaryType()), ("size", T.FloatType()), ("cluster", T.IntegerType()), ("similarity", T.DoubleType()))
    done, first = [left.where("v is null").select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("similarity"))], 0
    left = left.where("v is not null")
    count, whole = left.count(), False
    while count and not whole:
        n, s = leaf_entries(left, count)
        _, found = cut_tree(n, s, ward(n, s) if len(n) > 1 else [], coherence, least)
        if not len(found):
            break
        whole = n.sum() == count  # nothing was set aside
        centre = spark.sparkContext.broadcast((found.astype(np.float32), first))  # at most `leaves` centroids

        def assign(batches: Iterator[pa.RecordBatch], centre=centre) -> Iterator[pa.RecordBatch]:
            c, start = centre.value
            for b in batches:
                for s in range(0, b.num_rows, 2000):
                    part = b.slice(s, 2000)
                    v = np.frombuffer(b"".join(part.column(2).to_pylist()), np.float32).reshape(-1, c.shape[1])
                    cos = v @ c.T
                    at = cos.argmax(1)
                    top = cos[np.arange(len(at)), at].astype(np.float64)
                    none = top * np.sqrt(np.array(part.column(3), np.float64)) < member
                    kept = pa.array([x if y else None for x, y in zip(part.column(2).to_pylist(), none)], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), kept, part.column(3), pa.array((start + at).astype(np.int32), mask=none), pa.array(top, mask=none)], out.fieldNames()
                    )

        met = stage(left.mapInArrow(assign, out), "assigned")
        done.append(met.where("cluster is not null").select("id", "cluster", "similarity"))
        left, first = met.where("cluster is null").select("id", "h", "v", "size"), first + len(found)
        before, count = count, 0 if whole else left.count()
        whole = whole or count == before
    done.append(left.select("id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("similarity")))
    result = done[0]
    for x in done[1:]:
        result = result.unionByName(x)
    return result.withColumnRenamed("id", id_col)


def describe(assigned: DataFrame, id_col: str, labels: DataFrame, label_cols: list[str], typical: int = 3) -> DataFrame:
    """Rows (cluster, size, typical, *label_cols): each cluster's size, its ids nearest to the centroid and its commonest labels.

    labels has id_col and the label columns. Null, empty and negative labels count together as no label; a cluster in which
    that is commoner than each label has none (null). Ties go to a label, and to the least of them.
    """
    inside = assigned.where("cluster is not null")
    near = Window.partitionBy("cluster").orderBy(F.col("similarity").desc(), id_col)
    best = inside.withColumn("rn", F.row_number().over(near)).where(F.col("rn") <= typical)
    out = inside.groupBy("cluster").agg(F.count("*").alias("size"))
    out = out.join(best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(id_col).alias("i")))), lambda x: x["i"]).alias("typical")), "cluster")
    for c in label_cols:
        real = F.col(c) >= 0 if dict(labels.dtypes)[c] in ("int", "bigint") else F.col(c) != ""
        votes = inside.join(labels.select(id_col, F.when(real, F.col(c)).alias("label")), id_col)
        counted = votes.groupBy("cluster", "label").agg(F.count("*").alias("n"))
        top = Window.partitionBy("cluster").orderBy(F.col("n").desc(), F.col("label").asc_nulls_last())
        out = out.join(counted.withColumn("rn", F.row_number().over(top)).where("rn = 1").select("cluster", F.col("label").alias(c)), "cluster", "left")
    return out
