"""One consistent form for texts that look the same but differ in their characters."""

from __future__ import annotations

import math
import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices
from siltstone.staging import join_spread, often, stage

# Letters of different alphabets that have one shape. The first of a group is Latin.
LOOK_ALIKE = (
    "AΑА BΒВ CϹС EΕЕ HΗН IΙІӀ JͿЈ KΚК MΜМ NΝ OΟОՕ PΡР SЅՏ TΤТ XΧХ YΥҮУ ZΖ QԚ WԜ GԌ LԼ "
    "aа cϲс eе hһհ iі jϳј oοоօ pρр qԛ sѕ uս vνѵ wԝ xх yуү dԁ nո"
).split()

_CLASS = {c: g[0] for g in LOOK_ALIKE for c in g}
_FORMS = {g[0]: tuple(g) for g in LOOK_ALIKE}
#: runs of letters (decomposed, with their accents) of the alphabets above
_TOKEN = re.compile("([A-Za-z\u00aa\u00ba\u00c0-\u024f\u0300-\u036f\u0370-\u03ff\u0400-\u052f\u0531-\u0587\u1e00-\u1fff]+)")
_SCRIPTS = (("G", 0x0370, 0x03FF), ("C", 0x0400, 0x052F), ("A", 0x0531, 0x0587), ("G", 0x1F00, 0x1FFF))
_PLAIN = re.compile(r"[\x20-\x7e\n]*\Z")
_SWITCH = -12.0  # log weight of changing the alphabet inside a token
_START, _END = "^", "$"


def _script(c: str) -> str:
    n = ord(c)
    return next((s for s, a, b in _SCRIPTS if a <= n <= b), "L")


class _Fold(dict):
    """str.translate table, filled as characters are met: what a character becomes before decomposition; None deletes it."""

    def __missing__(self, n: int) -> int | str | None:
        c = chr(n)
        cat, dec = U.category(c), U.decomposition(c)
        kind = dec[1 : dec.index(">")] if dec.startswith("<") else ""
        out: int | str | None = n
        if cat == "Zs" or c == "\t":
            out = " "
        elif c in "\n\u2028\u2029\x85\x0b\x0c":
            out = "\n"
        elif cat in ("Cc", "Cf") or n == 0x034F or 0xFE00 <= n <= 0xFE0F or 0x180B <= n <= 0x180F or 0xE0100 <= n <= 0xE01EF or n in (0x115F, 0x1160, 0x3164, 0xFFA0):
            out = None
        elif kind in ("wide", "narrow", "isolated", "initial", "medial", "final"):
            out = U.normalize("NFKC", c)
        elif kind == "compat" and cat in ("Lu", "Ll", "Lt") and all(U.category(x)[0] == "L" for x in U.normalize("NFKC", c)) and c not in "ſϐϑϕϖϰϱϵ":
            out = U.normalize("NFKC", c)
        self[n] = out
        return out


_FOLD = _Fold()
_JOINED = re.compile("(?<=[\U0001f000-\U0001faff\u2600-\u27bf\ufe0f])\u200d(?=[\U0001f000-\U0001faff\u2600-\u27bf])")
_KEPT_JOINER = "\ue000"  # stands for the joiner inside an emoji, which is visible as the emoji it makes


def fold(text: str) -> str:
    """Width, ligatures, presentation forms, spaces and invisible characters made one; accents decomposed.

    Raised digits, case, accents, punctuation and line breaks stay. A joiner between two emoji stays.
    """
    if _PLAIN.match(text):
        return text
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "\u200d" in text:
        text = _JOINED.sub(_KEPT_JOINER, text)
    return U.normalize("NFD", text.translate(_FOLD)).replace(_KEPT_JOINER, "\u200d")


def skeleton(token: str) -> str:
    """The token with every look-alike letter replaced by the first of its group."""
    return "".join([_CLASS.get(c, c) for c in token])


def pair_counts(texts: list[str | None]) -> Counter:
    """How often one letter follows another within tokens of one alphabet; ends of tokens are ^ and $."""
    words: Counter = Counter()
    for t in texts:
        if t:
            words.update(_TOKEN.findall(fold(t)))
    out: Counter = Counter()
    for w, n in words.items():
        letters = [c for c in w if not "\u0300" <= c <= "\u036f"]
        if letters and len({_script(c) for c in letters}) == 1:
            script = _script(letters[0])
            for a, b in zip([_START, *letters], [*letters, _END]):
                out[(script, a, b)] += n
    return out


class Speller:
    """Chooses, for a token's shape, the letters that are likeliest together."""

    KEEP = 300_000

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.pair = {(s, a, b): n for (s, a, b), n in counts.items()}
        self.one: Counter = Counter()
        for (s, a, _), n in counts.items():
            self.one[(s, a)] += n
        total = sum(counts.values()) or 1
        per = Counter()
        for (s, _, _), n in counts.items():
            per[s] += n
        self.prior = {s: math.log((per[s] + 1) / (total + 4)) for s in "LCGA"}
        self.known: dict[str, str] = {}

    def _step(self, script: str, a: str, b: str) -> float:
        return math.log((self.pair.get((script, a, b), 0) + 0.05) / (self.one.get((script, a), 0) + 5.0))

    def best(self, token: str) -> str:
        """Viterbi over the lattice of look-alike letters of a folded token; all tokens of one shape have one result."""
        shape = skeleton(token)
        if shape in self.known:
            return self.known[shape]
        if len(self.known) > self.KEEP:
            self.known.clear()
        # a state is the last letter; accents belong to the letter before them
        states: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for c in shape:
            if "\u0300" <= c <= "\u036f":
                states = {s: (v, way + c) for s, (v, way) in states.items()}
                continue
            new: dict[str, tuple[float, str]] = {}
            for form in _FORMS.get(c, (c,)):
                script = _script(form)
                top = None
                for last, (v, way) in states.items():
                    if not last:
                        v += self.prior[script] + self._step(script, _START, form)
                    elif _script(last) == script:
                        v += self._step(script, last, form)
                    else:
                        v += _SWITCH + self._step(script, _START, form)
                    if top is None or (v, way) > top:
                        top = (v, way)
                new[form] = (top[0], top[1] + form)
            states = new
        ends = [(v + (self._step(_script(s), s, _END) if s else 0.0), way) for s, (v, way) in states.items()]
        out = self.known[shape] = U.normalize("NFC", max(ends)[1])
        return out

    def text(self, text: str | None, memo: dict[str, str]) -> str | None:
        if text is None:
            return None
        parts = _TOKEN.split(fold(text))
        for i in range(1, len(parts), 2):
            w = parts[i]
            got = memo.get(w)
            if got is None:
                got = memo[w] = self.best(w)
            parts[i] = got
        return U.normalize("NFC", "".join(parts))


def letter_pairs(df: DataFrame, text: str) -> dict[tuple[str, str, str], int]:
    """Counts of letter pairs over all texts; their number is bounded by the alphabets, not by the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            texts = b.column(0).to_pylist()
            for s, e in slices(texts):
                total.update(pair_counts(texts[s:e]))
        keys = list(total)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(total.values()), pa.int64())], ["s", "a", "b", "n"])

    parts = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "s string, a string, b string, n long")
    return {(r[0], r[1], r[2]): r[3] for r in parts.groupBy("s", "a", "b").agg(F.sum("n")).collect()}


_SPELLER: list = [None, None, {}]  # of this Python worker: the counts, their speller, tokens met


def normalize(df: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """df without `text`, with its consistent form in `out`. Texts have equal forms exactly when they look the same.

    Two passes over the texts and no shuffle of them: letter pairs are counted over all, then every token's lattice of
    look-alike letters is searched. Null stays null; a text without visible characters keeps only its spaces and line
    breaks. Repeated rows stay, other columns pass through, a column already named `out` is replaced.
    """
    counts = letter_pairs(df, text)
    shared = df.sparkSession.sparkContext.broadcast(counts)  # bounded by the alphabets
    keep = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _SPELLER[0] is not shared.value:
            _SPELLER[:] = [shared.value, Speller(shared.value), {}]
        _, speller, memo = _SPELLER
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for s, e in slices(texts):
                if len(memo) > Speller.KEEP:
                    memo.clear()
                part = b.slice(s, e - s)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([speller.text(t, memo) for t in texts[s:e]], pa.string())], [*keep, out])

    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(text)).mapInArrow(run, schema)


def same_look_classes(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, g, c, rep, rows, kinds, first, copies) of the rows with visible text that look like a row of other characters.

    g and c are hashes of the look and of the characters; rep is the smallest id of the look and rows its number of rows, of
    `kinds` different texts; first is the smallest id of exactly this text and copies their number.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    two = lambda c: F.struct(F.xxhash64(c).alias("a"), F.hash(F.reverse(c), c).alias("b"))  # noqa: E731 96 bits
    forms = normalize(rows.withColumn("c", two(F.col("text"))), "text", "form")
    keyed = forms.where(F.col("form").isNotNull() & F.col("form").rlike(r"[^\s]")).select("id", two(F.col("form")).alias("g"), "c")
    keyed = stage(keyed, "forms")  # ids and hashes; they are read several times
    exact = keyed.groupBy("g", "c").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    looks = exact.groupBy("g").agg(F.min("first").alias("rep"), F.sum("copies").alias("rows"), F.count("*").alias("kinds")).where("kinds > 1")
    hot = often(keyed, ["g"])
    return join_spread(join_spread(keyed, looks, ["g"], hot), exact, ["g", "c"], often(keyed, ["g", "c"]))


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text: str = "text", block: int = 1000) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of rows whose texts look the same but aren't the same characters.

    Every such pair is given; groups of one look of more than `block` rows are paired block by block, so that no task gets
    a whole one. Exact copies are no pair. Null texts and texts without a visible character have no pairs. A row's number of
    pairs is rows - copies in same_look_classes, which needs no pairs.
    """
    few = stage(same_look_classes(df, id_col, text).select("id", "g", "c", "rows"), "looks")
    few = few.withColumn("s", F.ceil(F.col("rows") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    a = few.select("g", F.col("id").alias("x"), F.col("c").alias("c_x"), "i", F.explode(F.sequence(F.col("i"), F.col("s") - 1)).alias("j"))
    b = few.select("g", F.col("id").alias("y"), F.col("c").alias("c_y"), F.col("i").alias("j"), F.explode(F.sequence(F.lit(0), F.col("i"))).alias("i"))
    met = a.join(b, ["g", "i", "j"]).where((F.col("c_x") != F.col("c_y")) & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    pairs = met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    return pairs.where("id_a < id_b").distinct()
