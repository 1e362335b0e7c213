"""Encoding of texts with the ranks of a public byte-level BPE.

Every distinct pre-token is merged once. A segment tree holds, for each position of the pre-token, the rank of the pair
that starts there; its root is the leftmost lowest rank, and each merge updates three leaves in logarithmic time. The
trees of many pre-tokens live side by side in arrays, so one round merges a pair in each of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NONE = np.int64(1) << 62  # no mergeable pair
_POS_BITS = 32
_POS_MASK = (np.int64(1) << _POS_BITS) - 1


class PairRanks:
    """rank(a, b) of token pairs, for arrays: an open hash table over all pairs whose concatenation is a token."""

    def __init__(self, rank_file: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {
            (ranks[t[:i]] << 32) | ranks[t[i:]]: r
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        self.pairs = pairs
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.vals = np.zeros(1 << self.bits, np.int64)
        keys, vals = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot = self._hash(keys)
        while len(keys):  # first come, first placed; the others go one slot on
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.vals[slot[first]] = keys[first], vals[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, vals, slot = keys[rest], vals[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair; _NONE where the two don't merge."""
        keys = (a << 32) | b
        slot = self._hash(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.vals[slot], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.vals[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def _merge_one(word: bytes, table: PairRanks) -> np.ndarray:
    """One pre-token with a tree of its own; for the few very long ones."""
    get, n, none = table.pairs.get, len(word), int(_NONE)
    tok = [int(table.byte_id[b]) for b in word]
    cap = 1 << max(0, n - 1).bit_length()
    tree = [none] * (2 * cap)
    for i in range(n - 1):
        r = get((tok[i] << 32) | tok[i + 1])
        if r is not None:
            tree[cap + i] = (r << _POS_BITS) | i
    for i in range(cap - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, r: int | None) -> None:
        k = cap + i
        tree[k] = none if r is None else (r << _POS_BITS) | i
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    while tree[1] < none:
        i, rank = tree[1] & int(_POS_MASK), tree[1] >> _POS_BITS
        j = nxt[i]
        k = nxt[j]
        tok[i], nxt[i], tok[j] = rank, k, -1
        put(j, None)
        if k < n:
            prv[k] = i
        put(i, get((rank << 32) | tok[k]) if k < n else None)
        if prv[i] >= 0:
            put(prv[i], get((tok[prv[i]] << 32) | rank))
    return np.array([t for t in tok if t >= 0], np.int32)


def _merge_many(words: list[bytes], cap: int, table: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after another, and how many each has. cap: a power of two, no word is longer."""
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    blob = np.frombuffer(b"".join(words), np.uint8)
    col = np.arange(cap)
    alive = col < lens[:, None]
    tok = np.zeros((n, cap), np.int64)
    tok[alive] = table.byte_id[blob]
    nxt, prv = np.tile(col + 1, (n, 1)), np.tile(col - 1, (n, 1))
    tree = np.full((n, 2 * cap), _NONE, np.int64)
    both = alive[:, 1:]
    r = table(tok[:, :-1][both], tok[:, 1:][both])
    leaves = tree[:, cap:-1]
    leaves[both] = np.where(r < _NONE, (r << _POS_BITS) | np.broadcast_to(col[:-1], both.shape)[both], _NONE)
    k = cap >> 1
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k >>= 1
    tok, nxt, prv, alive, tree = (x.reshape(-1) for x in (tok, nxt, prv, alive, tree))
    rows = np.arange(n)
    while True:
        root = tree[rows * (2 * cap) + 1]
        go = root < _NONE
        if not go.any():
            break
        rows, root = rows[go], root[go]
        at, i, rank = rows * cap, root & _POS_MASK, root >> _POS_BITS
        j = nxt[at + i]
        k = nxt[at + j]
        last, p = k >= lens[rows], prv[at + i]
        tok[at + i], nxt[at + i], alive[at + j] = rank, k, False
        prv[(at + k)[~last]] = i[~last]
        right = np.full(len(rows), _NONE, np.int64)
        right[~last] = table(rank[~last], tok[(at + k)[~last]])
        has = p >= 0
        left = table(tok[(at + p)[has]], rank[has])
        base = rows * (2 * cap) + cap
        tree[base + j] = _NONE
        tree[base + i] = np.where(right < _NONE, (right << _POS_BITS) | i, _NONE)
        tree[(base + p)[has]] = np.where(left < _NONE, (left << _POS_BITS) | p[has], _NONE)
        node = np.concatenate([cap + i, cap + j, cap + p[has]])
        off = np.concatenate([rows, rows, rows[has]]) * (2 * cap)
        while node[0] > 1:
            node = node >> 1
            tree[off + node] = np.minimum(tree[off + 2 * node], tree[off + 2 * node + 1])
    return tok[alive].astype(np.int32), alive.reshape(n, cap).sum(1)


class Encoder:
    """Texts to ids. Keeps the ids of pre-tokens it has met, up to a number, so frequent ones are merged once per process."""

    KEEP = 300_000
    SCALAR_LEN = 512

    def __init__(self, rank_file: bytes, pattern: str = PATTERN):
        self.table, self.split = PairRanks(rank_file), regex.compile(pattern).findall
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        lens = np.fromiter(map(len, raw), np.int64, len(raw))
        parts, counts = [], np.zeros(len(raw), np.int64)
        place = np.zeros(len(raw), np.int64)
        done = 0
        order = np.argsort(lens, kind="stable")
        caps = np.where(lens[order] <= 1, 1, 1 << np.ceil(np.log2(np.maximum(lens[order], 1))).astype(np.int64))
        for cap in np.unique(caps):
            group = order[caps == cap]
            step = max(1, 1_000_000 // int(cap))
            for s in range(0, len(group), step):
                g = group[s : s + step]
                if cap == 1:
                    ids, n = self.table.byte_id[np.frombuffer(b"".join(raw[x] for x in g), np.uint8)].astype(np.int32), lens[g]
                elif cap >= self.SCALAR_LEN or len(g) < 12:
                    one = [_merge_one(raw[x], self.table) for x in g]
                    ids, n = np.concatenate(one), np.fromiter(map(len, one), np.int64, len(one))
                else:
                    ids, n = _merge_many([raw[x] for x in g], int(cap), self.table)
                counts[g] = n
                place[g] = done + np.cumsum(n) - n
                done += len(ids)
                parts.append(ids)
        self.index.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.start = np.concatenate([self.start, place + len(self.ids)])
        self.count = np.concatenate([self.count, counts])
        self.ids = np.concatenate([self.ids, *parts])

    def _lookup(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pre-tokens of all texts, and how many pre-tokens each text has."""
        if len(self.index) > self.KEEP:
            self._reset()
        split, index, flat, sizes = self.split, self.index, [], []
        for t in texts:
            w = split(t) if t else []
            flat += w
            sizes.append(len(w))
        new = [w for w in dict.fromkeys(flat) if w not in index]
        if new:
            self._add(new)
        return np.fromiter(map(index.__getitem__, flat), np.int64, len(flat)), np.array(sizes, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text); null and empty texts have none."""
        words, sizes = self._lookup(texts)
        n = self.count[words]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(self.start[words] - ends[:-1], n)
        offsets = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return self.ids[take], offsets

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """How many ids each text has, without writing them down."""
        words, sizes = self._lookup(texts)
        ends = np.concatenate([[0], np.cumsum(self.count[words])])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return ends[at[1:]] - ends[at[:-1]]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One per Python worker and vocabulary."""
    key = hash(shared.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*shared.value)
    return _ENCODERS[key]


def slices(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about so many characters; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts) or not texts:
        yield start, len(texts)


def _run(df: DataFrame, text: str, out: str, kind: T.DataType, ranks_path: str, pattern: str, make) -> DataFrame:
    with open(ranks_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast((f.read(), pattern))  # a vocabulary file: of fixed size
    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared)
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for s, e in slices(texts):
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], make(enc, texts[s:e])], [*keep, out])

    cols = [F.col(f"`{c}`") for c in keep]
    return df.select(*cols, F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", out: str = "ids", ranks_path: str = RANKS_PATH, pattern: str = PATTERN) -> DataFrame:
    """df without `text`, with the text's token ids in `out`. One pass, no shuffle.

    Null and empty texts have an empty list. Strings that look like special tokens are ordinary text. Repeated rows stay;
    other columns pass through as they are; a column that is already named `out` is replaced. Lone surrogates can't occur
    in Spark strings. An empty table gives an empty table.
    """

    def make(enc: Encoder, texts: list[str | None]) -> pa.Array:
        ids, offsets = enc.encode(texts)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))

    return _run(df, text, out, T.ArrayType(T.IntegerType(), False), ranks_path, pattern, make)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", ranks_path: str = RANKS_PATH, pattern: str = PATTERN) -> DataFrame:
    """Like encode, but with the number of ids instead of the ids; 0 for null and empty texts."""
    return _run(df, text, out, T.IntegerType(), ranks_path, pattern, lambda enc, texts: pa.array(enc.lengths(texts).astype(np.int32)))
