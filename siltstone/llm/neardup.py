"""Near-duplicate texts by b-bit MinHash over character shingles."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices
from siltstone.staging import join_spread, often, stage

FUNCTIONS, BINS = 16, 16  # minima = FUNCTIONS * BINS, unless bands need more
MOST = 256  # functions
KEPT, BITS = 128, 4  # the signature has so many low bits of so many minima, those of the first functions
_LONGS = KEPT * BITS // 64
_EMPTY = np.uint32(0xFFFFFFFF)
_RNG = np.random.default_rng(20)
_ODD = (_RNG.integers(1, 1 << 62, MOST, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BAND_ODD = (_RNG.integers(1, 1 << 62, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def canonical(text: str) -> str:
    """Lower case, each run of white space one space, ends stripped."""
    return " ".join(text.lower().split())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all pieces of `width` characters, and the number of the text each is from."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(code) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(code) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * _BASE + code[i : i + n] + np.uint64(1)
    ends = np.cumsum(lens)
    owner = np.repeat(np.arange(len(texts)), lens)[:n]
    inside = np.arange(n) + width <= ends[owner]
    return _mix(h[inside]), owner[inside]


def minima(texts: list[str], width: int, functions: int = FUNCTIONS) -> np.ndarray:
    """(texts, functions * BINS) minima: each function's hashes fall into bins, of which each keeps its least; an empty bin takes the
    next filled one's with an offset, so it agrees between two texts as often as that one does. No shingle: all _EMPTY."""
    x, owner = shingle_hashes(texts, width)
    out = np.full((len(texts), functions, BINS), _EMPTY, np.uint32)
    slot = owner * BINS
    for f in range(functions):
        g = x * _ODD[f]
        g ^= g >> np.uint64(31)
        flat = np.full(len(texts) * BINS, _EMPTY, np.uint32)
        np.minimum.at(flat, slot + (g >> np.uint64(60)).astype(np.int64), (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        out[:, f] = flat.reshape(-1, BINS)
    rows = np.flatnonzero((out == _EMPTY).any((1, 2)) & (out != _EMPTY).any((1, 2)))
    if len(rows):
        some = out[rows]
        filled = some.copy()
        for d in range(1, BINS):
            hole = filled == _EMPTY
            if not hole.any():
                break
            moved = np.roll(some, -d, 2)
            filled = np.where(hole & (moved != _EMPTY), moved + np.uint32(0x9E3779B1 * d & 0xFFFFFFFF), filled)
        out[rows] = filled
    return out.transpose(0, 2, 1).reshape(len(texts), functions * BINS)


def pack_bits(m: np.ndarray) -> np.ndarray:
    """The low bits of KEPT minima (mixed first, so that low bits are fair), packed into 64-bit numbers."""
    low = (_mix(m.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(len(m), _LONGS, 64 // BITS)
    shift = (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(low << shift, axis=2).view(np.int64)


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """So many bands that a pair at the threshold shares none with a probability of at most `miss`."""
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    if bands * rows > MOST * BINS:
        raise ValueError(f"{bands} bands of {rows} minima are needed, {MOST * BINS} minima can be had: take fewer rows")
    return bands


def band_keys(m: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = m[:, : bands * rows].reshape(len(m), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _BASE, part.shape[:2]).copy()
    for r in range(rows):
        h = _mix(h ^ (part[:, :, r] + np.uint64(1)) * _BAND_ODD[r])
    return h.view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for low bits that agree by chance. Counts bits, in the JVM."""
    lanes = int("1" * (64 // BITS), 16)  # lowest bit of each group of four
    lanes = lanes - (1 << 64) if lanes >> 63 else lanes
    differ = None
    for i in range(_LONGS):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(lanes).cast("long"))
        differ = F.bit_count(x) if differ is None else differ + F.bit_count(x)
    chance = 2.0**-BITS
    return ((1 - differ / F.lit(float(KEPT))) - F.lit(chance)) / F.lit(1 - chance)


def exact_similarity(a: str, b: str, width: int) -> float:
    """Shared pieces divided by all pieces; equal texts have 1, texts too short for a piece 0."""
    if a == b:
        return 1.0
    x = {a[i : i + width] for i in range(len(a) - width + 1)}
    y = {b[i : i + width] for i in range(len(b) - width + 1)}
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


def _class_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _read(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(id, by, v, c, sig, keys) of df's (id, by, v, text): one pass over the texts.

    c is a hash of the canonical text, null for null and blank ones; sig its signature, null without a shingle; keys its bands,
    null for a text that the partition has just seen, so that copies don't fill the buckets.
    """
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([df.schema["id"], df.schema["by"], df.schema["v"], *(T.StructField(c, t) for c, t in (("c", T.LongType()), ("sig", longs), ("keys", longs)))])
    functions = max(KEPT // BINS, math.ceil(bands * rows / BINS))

    def lists(values: np.ndarray, has: np.ndarray) -> pa.Array:
        at = np.concatenate([[0], np.cumsum(np.where(has, values.shape[1], 0))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(values.reshape(-1)), mask=pa.array(~has))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            texts = [canonical(t) if t else "" for t in b.column(3).to_pylist()]
            for s, e in slices(texts, 400_000):
                part, own = b.slice(s, e - s), texts[s:e]
                cs = [_class_hash(t) if t else None for t in own]
                m = minima(own, width, functions)
                has = (m != _EMPTY).any(1)
                fresh = has.copy()
                for i, c in enumerate(cs):
                    fresh[i] = fresh[i] and c not in seen
                    seen.add(c)
                if len(seen) > 1_000_000:
                    seen = set()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(cs, pa.int64()), lists(pack_bits(m[has, :KEPT]), has), lists(band_keys(m[fresh], bands, rows), fresh)], schema.fieldNames()
                )

    return df.select("id", "by", "v", "text").mapInArrow(run, schema)


def agreeing(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b, packed signatures, whose estimated similarity is at least `least`. Counts bits."""
    most = math.floor(KEPT * (1 - (least * (1 - 2.0**-BITS) + 2.0**-BITS)) + 1e-9)
    lanes, out = np.uint64(int("1" * (64 // BITS), 16)), []
    a, b = a.view(np.uint64), b.view(np.uint64)
    for s in range(0, len(a), 256):
        differ = np.zeros((min(256, len(a) - s), len(b)), np.uint16)
        for i in range(_LONGS):
            x = a[s : s + 256, i, None] ^ b[None, :, i]
            x |= x >> np.uint64(2)
            x |= x >> np.uint64(1)
            differ += np.bitwise_count(x & lanes)
        at = np.nonzero(differ <= most)
        out.append((at[0] + s, at[1]))
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (np.zeros(0, int), np.zeros(0, int))


def _crowded(met: DataFrame, classes: DataFrame, least: float, block: int) -> DataFrame:
    """Likely pairs (x, y) of the buckets of met(key, c), any of which may be large: rows of a bucket are split into blocks
    by a hash, two blocks at a time meet in a task, and only pairs whose signatures agree leave it."""
    r, parts = F.pmod(F.xxhash64("c"), F.lit(64)).alias("r"), 64
    sizes = met.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    spreads = sizes.withColumn("s", F.ceil(F.col("m") / block).cast("int")).select("key", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("r"))
    rows = met.select("key", "c", r).join(spreads, ["key", "r"]).withColumn("i", F.pmod(F.xxhash64("c", F.lit(1)), F.col("s")).cast("int"))
    rows = rows.join(classes.select("c", "sig"), "c").where("sig is not null")
    # block i meets every block j >= i: it is there as the first and as the second
    first = rows.select("key", "c", "sig", "i", F.explode(F.sequence(F.col("i"), F.col("s") - 1)).alias("j"), F.lit(True).alias("left"))
    second = rows.select("key", "c", "sig", F.explode(F.sequence(F.lit(0), F.col("i"))).alias("k"), "i", F.lit(False).alias("left"))
    both = first.unionByName(second.select("key", "c", "sig", F.col("k").alias("i"), F.col("i").alias("j"), "left").where("i < j"))

    def compare(t: pa.Table) -> pa.Table:
        c, left = np.array(t.column("c")), np.array(t.column("left"), bool)
        sig = np.array(t.column("sig").combine_chunks().flatten(), np.int64).reshape(len(c), _LONGS)
        if t.column("i")[0].as_py() == t.column("j")[0].as_py():
            x, y = agreeing(sig, sig, least)
            a, b = c[x], c[y]
        else:
            x, y = agreeing(sig[left], sig[~left], least)
            a, b = c[left][x], c[~left][y]
        some = a != b
        a, b = np.minimum(a, b)[some], np.maximum(a, b)[some]
        pairs = np.unique(np.stack([a, b]), axis=1)
        return pa.table([pairs[0], pairs[1]], names=["x", "y"])

    return both.groupBy("key", "i", "j").applyInArrow(compare, "x long, y long")


def similarities(pairs: list[tuple[str, str]], width: int, threshold: float) -> list[float]:
    """exact_similarity of many pairs, each text's pieces hashed and sorted once. Two pieces of one hash would change a count
    by one; a similarity as near to the threshold as that is counted again on the pieces themselves."""
    number = {t: i for i, t in enumerate(dict.fromkeys(t for p in pairs for t in p))}
    h, owner = shingle_hashes(list(number), width)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[first], owner[first]
    at = np.searchsorted(owner, np.arange(len(number) + 1))
    out = []
    for a, b in pairs:
        i, j = number[a], number[b]
        x, y = h[at[i] : at[i + 1]], h[at[j] : at[j + 1]]
        if i == j or not len(x) or not len(y):
            out.append(1.0 if i == j else 0.0)
            continue
        k = np.minimum(np.searchsorted(y, x), len(y) - 1)
        both = int((y[k] == x).sum())
        total = len(x) + len(y) - both
        out.append(both / total if abs(both - threshold * total) > 4 else exact_similarity(a, b, width))
    return out


_FILTER_BITS = 1 << 24


def _only_likely(df: DataFrame, wanted: DataFrame, cols: list[str]) -> DataFrame:
    """df without most rows whose `cols` aren't in `wanted`, before a shuffle of df: a bit table of fixed size (2 MB) is sent.

    With very many wanted rows it lets more others pass; a join must follow.
    """
    spark, words = df.sparkSession, _FILTER_BITS // 64
    at = F.pmod(F.xxhash64(*cols), F.lit(_FILTER_BITS))
    bit = lambda: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    got = wanted.groupBy(F.floor(at / 64).cast("int").alias("w")).agg(F.bit_or(bit()).alias("b")).toArrow()
    table = np.zeros(words, np.int64)
    table[np.array(got.column("w"), np.int64)] = np.array(got.column("b"), np.int64)
    one = spark.createDataFrame([(table.tolist(),)], "__bits array<long>")
    hit = F.get("__bits", F.floor(at / 64).cast("int")).bitwiseAND(bit()) != 0
    return df.join(F.broadcast(one), hit).select(*df.columns)


def near_duplicates(
    df: DataFrame, id_col: str, text: str, by: str | None = None, width: int = 5, threshold: float = 0.8, rows: int = 5, miss: float = 0.02, block: int = 1000
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the texts that share at least `threshold` of their pieces of `width` characters.

    members(id, rep, n, v, first, copies): each id with visible text; rep, the smallest id of an equal text (after lower-casing
    and making white space one), stands for its n members; v is a hash of the text as it is, first the smallest of the `copies`
    ids with exactly that text. links(a, b, similarity): pairs of different representatives, a < b, with their exact
    similarity. With `by`, of the rows of an id the one with the greatest `by` holds (null least; further ties by a hash of
    the text); without, repeated rows of an id must have equal texts, or one of them is taken. Null and blank texts and null
    ids are in neither. Texts too short for a piece only have equal texts. Empty tables give empty ones.

    Bands of `rows` minima make candidates, so many that a pair at the threshold is missed with probability `miss` at most (more
    than there are minima for: ValueError); packed low bits estimate their similarity, three and a half standard errors below
    the threshold drop out, and the rest is compared exactly. Everything before that is done once for equal texts. Bands that
    may have more than `block` texts, found by counts of coarser keys, are compared in blocks by their signatures, so that no
    task gets a whole one and only likely pairs come out of it.
    """
    bands = bands_for(threshold, rows, miss)
    base = df.select(F.col(f"`{id_col}`").alias("id"), (F.col(f"`{by}`") if by else F.lit(0)).alias("by"), F.col(f"`{text}`").cast("string").alias("text"))
    base = base.where("id is not null").withColumn("v", F.xxhash64("text"))
    read = stage(_read(base, width, bands, rows), "signatures")
    newest = Window.partitionBy("id").orderBy(F.col("by").desc_nulls_last(), "v")
    held = read.select("id", "by", "v", "c", "sig").withColumn("rn", F.row_number().over(newest)).where("rn = 1 and c is not null").drop("rn", "by")
    held = stage(held, "held")
    classes = held.groupBy("c").agg(F.min("id").alias("rep"), F.min_by("v", "id").alias("v"), F.count("*").alias("n"), F.first("sig").alias("sig"))
    exact = held.groupBy("c", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    hot = often(held, ["c"])
    members = join_spread(held.select("id", "c", "v"), classes.select("c", "rep", "n"), ["c"], hot)
    members = join_spread(members, exact, ["c", "v"], often(held, ["c", "v"])).select("id", "rep", "n", "v", "first", "copies")

    keys = read.where("keys is not null").select("c", F.explode("keys").alias("key"))
    total = read.agg(F.count("keys")).first()[0] * bands
    coarse = F.pmod("key", F.lit(max(1, 8 * total // block))).alias("z")
    full = keys.groupBy(coarse).agg(F.count("*").alias("n")).where(F.col("n") > block).select("z")
    slack = 3.5 * math.sqrt(threshold * (1 - threshold) / KEPT) / (1 - 2.0**-BITS)
    side = lambda k: classes.select(F.col("c").alias(k), F.col("sig").alias(f"s{k}"), F.struct(F.col("rep").alias("id"), "v").alias(f"r{k}"))
    full = stage(full, "full")
    n_full = full.limit(1_000_001).count()
    pairs = None
    if n_full <= 1_000_000:  # a checked bound; with more, every bucket is compared in blocks
        met = keys.withColumn("z", coarse).join(F.broadcast(full), "z", "left_anti") if n_full else keys
        met = met.select("key", "c").withColumn("m", F.count("*").over(Window.partitionBy("key"))).where("m > 1").select("key", "c").distinct()
        met = stage(met, "buckets")
        both = met.withColumnRenamed("c", "x").join(met.withColumnRenamed("c", "y"), "key").where("x < y")
        pairs = both.select("x", "y").distinct()
    if n_full:
        crowd = keys.withColumn("z", coarse).join(F.broadcast(full), "z", "left_semi").select("key", "c") if pairs is not None else keys
        more = _crowded(stage(crowd.distinct(), "crowded"), classes, threshold - slack, 20 * block)
        pairs = more.distinct() if pairs is None else pairs.union(more).distinct()
    likely = pairs.join(side("x"), "x").join(side("y"), "y").where(estimate(F.col("sx"), F.col("sy")) >= threshold - slack)
    likely = stage(likely.select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")), "candidates")

    wanted = likely.select("a.*").union(likely.select("b.*")).distinct()
    likely_texts = _only_likely(base.select("id", "v", "text"), wanted, ["id", "v"])
    # wanted is distinct; a semi join would be moved below the filter
    texts = likely_texts.join(wanted, ["id", "v"]).dropDuplicates(["id", "v"])
    texts = stage(texts, "texts")
    ends = lambda k: texts.select(F.struct("id", "v").alias(k), F.col("text").alias(f"t{k}"))
    # a text with very many partners goes to all tasks: at most 1,000 of them
    full = likely
    for k in "ab":
        full = join_spread(full, ends(k), [k], often(likely, [k], most=1000))
    schema = T.StructType([T.StructField("a", df.schema[id_col].dataType), T.StructField("b", df.schema[id_col].dataType), T.StructField("similarity", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 200):
                part = b.slice(s, 200)
                pairs = list(zip(*([canonical(t) for t in part.column(i).to_pylist()] for i in (2, 3))))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(similarities(pairs, width, threshold), pa.float64())], schema.fieldNames())

    links = full.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "ta", "tb").mapInArrow(compare, schema).where(F.col("similarity") >= threshold)
    return members, links


def expand(members: DataFrame, links: DataFrame, full_copies: int = 1000, block: int = 1000) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of ids: equal texts and linked ones.

    Of exactly equal texts with more than `full_copies` copies the first one stands for them: each other copy is paired with
    it and with the first copy of every other text that is equal or linked, so a group of copies of any size adds pairs in
    proportion to its rows. All pairs of texts that differ in any character are written otherwise, block by block.
    """
    few = F.col("copies") <= full_copies
    m = stage(members, "members")
    standing = m.where(few | (F.col("id") == F.col("first"))).select("id", "rep", "n", "v")
    firsts = m.where(F.col("id") == F.col("first")).select("id", "rep", "v")
    rest = m.where(~few & (F.col("id") != F.col("first"))).select("id", "rep", "v", "first")
    equal = standing.where("n > 1").withColumn("s", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    x = equal.select("rep", F.col("id").alias("x"), "i", F.explode(F.sequence(F.col("i"), F.col("s") - 1)).alias("j"))
    y = equal.select("rep", F.col("id").alias("y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    same = x.join(y, ["rep", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("x", "y")
    left = links.select("a", "b").join(standing.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a")
    both = left.join(standing.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    star = rest.select(F.col("first").alias("x"), F.col("id").alias("y"))
    # copies beyond the first: first copies of the other texts of their class, and of linked classes
    near = links.select("a", "b").union(links.select("b", "a")).union(rest.select("rep", "rep").distinct()).toDF("rep", "to")
    near = rest.select("rep").distinct().join(near, "rep").join(firsts.select(F.col("rep").alias("to"), F.col("id").alias("y"), F.col("v").alias("w")), "to")
    more = join_spread_many(rest, near.select("rep", "y", "w")).where("v != w").select(F.col("id").alias("x"), "y")
    pairs = same.unionByName(both).unionByName(star).unionByName(more)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def join_spread_many(rest: DataFrame, near: DataFrame, salts: int = 32) -> DataFrame:
    """Copies joined with what is near their class; both only exist for large groups of copies, so copies are split by a hash."""
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")
    return rest.select("*", salt).join(near.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["rep", "salt"])
