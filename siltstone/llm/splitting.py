"""Cutting oversized texts into overlapping pieces at natural boundaries, all cuts of a text in parallel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm import sentences

# Characters that are a token each; a run of others without white space is one token.
_SINGLE = r"฀-๿　-ヿ一-鿿豈-﫿＀-￯"
_TOKEN = re.compile(rf"[{_SINGLE}]|[^\s{_SINGLE}]+")
#: Java's \s is ASCII only; this is Python's, as both must count alike
_JAVA_SPACE = r"\t-\r\x1c-\x20\x85   -     　"
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
LEVELS = ("paragraph", "sentence", "token")


def count_tokens(text: Column) -> Column:
    """Number of tokens, in the JVM; null for null."""
    return F.regexp_count(text, F.lit(rf"[{_SINGLE}]|[^{_JAVA_SPACE}{_SINGLE}]+"))


def token_bounds(text: str) -> np.ndarray:
    """(tokens, 2) start and end of each token."""
    return np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)


def successors(n: int, strong: np.ndarray, weak: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """For every position 0..n, between tokens, the farthest cut a piece may reach whose predecessor was cut there.

    The piece begins `overlap` tokens before the position (at the text's start: there), so it may end `limit` - `overlap`
    tokens behind it. It ends at the last strong boundary if that is in the second half of the way, else at the last weak or
    strong one, else at the last token. strong, weak: sorted positions.
    """
    at = np.arange(n + 1)
    step = np.where(at <= overlap, limit - at, limit - overlap)  # a piece never begins before the text
    far = np.minimum(at + step, n)
    out = far.copy()
    for bounds, least in ((weak, at + 1), (strong, at + (far - at + 1) // 2)):
        if len(bounds):
            last = bounds[np.maximum(np.searchsorted(bounds, far, "right") - 1, 0)]
            out = np.where((last >= np.maximum(least, at + 1)) & (last <= far), last, out)
    return np.where(far == n, n, out)


def reached(successor: np.ndarray) -> np.ndarray:
    """Positions that greedy cutting from 0 comes to. The table is squared again and again: after k squarings it leads 2^k
    cuts ahead, and the positions known so far, led ahead, double."""
    known, table = np.zeros(len(successor), bool), successor
    known[0] = True
    jumps = 1
    while jumps < len(successor):
        known[table[np.flatnonzero(known)]] = True
        table = table[table]
        jumps *= 2
    return np.flatnonzero(known)


def cut(text: str, spans: list[tuple[int, int]], limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int]]]:
    """(coarsest unit that fits everywhere, pieces as (start, end, tokens)) of a text with these sentences."""
    tok = token_bounds(text)
    n = len(tok)
    if not n:
        return LEVELS[0], []

    def inner(ends: np.ndarray) -> np.ndarray:
        k = np.searchsorted(tok[:, 0], ends, "left")
        return np.unique(k[(k > 0) & (k < n)])

    paragraphs = inner(np.array([m.start() for m in _PARAGRAPH.finditer(text)], np.int64))
    ends = inner(np.array([e for _, e in spans], np.int64))
    fits = lambda b: np.diff(np.concatenate([[0], b, [n]])).max() <= limit
    longest = max((int(np.searchsorted(tok[:, 0], e, "left") - np.searchsorted(tok[:, 1], s, "right")) for s, e in spans), default=n)
    level = LEVELS[0] if fits(paragraphs) else LEVELS[1] if longest <= limit else LEVELS[2]
    if n <= limit:
        return level, [(int(tok[0, 0]), int(tok[-1, 1]), n)]
    cuts = reached(successors(n, paragraphs, np.union1d(ends, paragraphs), limit, overlap))
    starts = np.maximum(cuts[:-1] - overlap, 0)
    return level, [(int(tok[a, 0]), int(tok[b - 1, 1]), int(b - a)) for a, b in zip(starts, cuts[1:])]


def split_oversized(df: DataFrame, text: str, model: sentences.Model, limit: int = 512, overlap: int = 64) -> DataFrame:
    """df with each row's text cut into pieces of at most `limit` tokens, consecutive ones sharing `overlap` tokens.

    `text` becomes the piece; new columns: piece (from 0), n_pieces, piece_tokens, start_char, end_char (code points) and
    cut_at, the coarsest unit (paragraph, sentence, token) of which every one has at most `limit` tokens. Every other column
    is repeated; columns of df with the new names are replaced. A text within the limit is one piece without the white space
    around it; null and blank texts keep one row with piece_tokens 0. Repeated rows are cut each.
    0 <= overlap < limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("0 <= overlap < limit")
    new = {"piece": T.IntegerType(), "n_pieces": T.IntegerType(), "piece_tokens": T.IntegerType(), "start_char": T.IntegerType(), "end_char": T.IntegerType(), "cut_at": T.StringType()}
    keep = [c for c in df.columns if c != text and c not in new]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(text, T.StringType()), *(T.StructField(c, t) for c, t in new.items())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            out: list[tuple] = []
            for i, t in enumerate(b.column(len(keep)).to_pylist()):
                pieces: list[tuple[int, int, int]] = []
                level = LEVELS[0]
                if t and t.strip():
                    level, pieces = cut(t, sentences.sentences_in(shared.value, t), limit, overlap)
                pieces = pieces or [(0, 0, 0)]
                for k, (s, e, n) in enumerate(pieces):
                    rows.append(i)
                    out.append((None if t is None else t[s:e], k, len(pieces), n, s, e, level))
            cols = list(zip(*out)) or [()] * (1 + len(new))
            kinds = [pa.string(), *[pa.int32()] * 5, pa.string()]
            old = [b.column(j).take(pa.array(rows, pa.int64())) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*old, *(pa.array(c, k) for c, k in zip(cols, kinds))], schema.fieldNames())

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)
