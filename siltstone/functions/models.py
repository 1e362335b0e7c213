"""Pluggable models: embedders, token counters, pair scorers, writers of anchor queries. The defaults are deterministic."""

from __future__ import annotations

import hashlib
import re
import textwrap
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import word_count


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """(texts, dim) vectors."""


class HashEmbedder:
    """Counts of words in hashed places; any two engines that know md5 agree on it."""

    _TOKEN = re.compile("[a-z0-9]+")

    def __init__(self, dim: int = 768):
        self.dim, self._place = dim, {}

    def place(self, token: str) -> int:
        got = self._place.get(token)
        if got is None:
            if len(self._place) > 500_000:
                self._place.clear()
            got = self._place[token] = int(hashlib.md5(token.encode()).hexdigest()[:6], 16) % self.dim
        return got

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            k = [self.place(w) for w in self._TOKEN.findall((t or "").lower())]
            out[i] = np.bincount(k, minlength=self.dim) if k else 0
        return out

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "_place": {}}


class TokenCounter(Protocol):
    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""


class WordCounter:
    """White-space words; the same as functions.text.word_count, which stays in the JVM."""

    def count(self, texts: list[str]) -> list[int]:
        return [len(t.split()) for t in texts]


class RanksCounter:
    """Tokens of a byte-pair vocabulary in a file of base64 pieces and ranks, cut by `pattern` before."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def count(self, texts: list[str]) -> list[int]:
        if self._encoding is None:
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(x) for x in self._encoding.encode_ordinary_batch(texts)]

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}


def token_counts(texts: Column, counter: TokenCounter | None = None) -> Column:
    """Tokens of each string of an array column; without a counter, words, in the JVM."""
    if counter is None:
        return F.transform(texts, word_count)

    @F.pandas_udf("array<int>")
    def counted(lists: pd.Series) -> pd.Series:
        sizes = [0 if x is None else len(x) for x in lists]
        n = counter.count([t or "" for x in lists if x is not None for t in x])
        ends = np.cumsum(sizes)
        return pd.Series([None if x is None else n[e - k : e] for x, k, e in zip(lists, sizes, ends)])

    return counted(texts)


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        """A score of each (claim, text)."""


def pair_scores(claim: Column, text: Column, scorer: PairScorer) -> Column:
    """Scores of a model for pairs, batch by batch."""

    @F.pandas_udf("double")
    def scored(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(scorer.score([(x or "", y or "") for x, y in zip(a, b)]), np.float64))

    return scored(claim, text)


class AnchorWriter(Protocol):
    def write(self, topic_id: int, core_sentences: list[str]) -> str: ...


class TemplateAnchor:
    """A question made from the first core sentence."""

    def write(self, topic_id: int, core_sentences: list[str]) -> str:
        # fixed values: the form of the question and its hint without sentences
        hint = textwrap.shorten(core_sentences[0], width=120, placeholder=" …") if core_sentences else "biomedical evidence"
        return f"What findings relate to: {hint} (global topic {topic_id})?"


def embed(df: DataFrame, text: str, out: str = "vector", embedder: Embedder | None = None) -> DataFrame:
    """df with a vector of each text in `out`; a null text counts as empty. A column named `out` is replaced."""
    model = embedder or HashEmbedder()
    keep = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.FloatType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                x = model.encode([t or "" for t in part.column(len(keep)).to_pylist()]).astype(np.float32)
                at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * model.dim)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.ListArray.from_arrays(at, pa.array(x.reshape(-1)))], [*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__t")).mapInArrow(run, schema)
