"""Sentence boundaries in any language and script by a hidden-event language model.

Between two words there may be a boundary event that isn't written. The model gives the chance of the event after what is
on the left (the word and the marks behind it, or a line break) and the chance of the word on the right after a boundary and
inside a sentence. Both are learnt from the texts themselves: words after sure boundaries, inside sentences and behind
abbreviations are counted, and the chances of the event are fitted by expectation maximization over all open places.
Forward-backward posteriors decide, as a short line is a heading only if a boundary comes before it too.

In a text with marks the places are its marks, its line breaks and the spaces beside Thai letters; the words between them count
as inside. In a text without any mark, whatever its script, every gap between two words (ideographs, where there are no gaps) is
a place, with a chance of the event of its own, learnt from such texts, and a sentence of one word is unlikely.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices
from siltstone.staging import stage

WORDS, DOTTED = 1 << 19, 1 << 18  # sizes of the hashed tables of right words and of words before a full stop
BINS = 33  # bins of the right word's log odds, half a unit each

# Marks that may end a sentence, marks that close and that open.
_ENDS = ".!?…。！？．｡।॥؟۔"
_WIDE = "。！？．｡"
_CLOSE = ")\\]}\"”’»›」』】）〕〉》'“‘"
_OPEN = "\"“”‘’«»„‚'(\\[（「『【¿¡"

_GAP = re.compile(
    rf"(?P<end>[{_ENDS}]+)(?P<close>[{_CLOSE}]*(?:[ \u00a0\u202f]»(?=[\s,;.]|\Z))?)(?P<gap>\s*)"
    r"|(?P<line>[^\S\n]*\n\s*)"
    r"|(?P<thai>(?<=[\u0e00-\u0e7f])\s+|\s+(?=[\u0e00-\u0e7f]))"
)
_RIGHT = re.compile(rf"([{_OPEN}]*)[ \u00a0\u202f]?(\w[\w\-]*|.)", re.S)
_MARKER = re.compile(r"(?:\d{1,3}[.)]|[-–—•*])[^\S\n]+(?=\S)")
_LAST = re.compile(r"[^\s(\[{\"“”‘’«»„‚'（「]{1,24}\Z")
_INSIDE = re.compile(r"(?<=[^\s.!?…:;\"”’»)\]]) ([\"“‘«„(]*\w[\w\-]*)(?![\w\-]|\.\w)")
#: gaps of a text without marks: between words of a line, and between ideographs
_BETWEEN = re.compile("(?<=\\S)[^\\S\n]+(?=\\S)|(?<=[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])(?=[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])")
_IDEOGRAPH = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")

#: Kinds of places: a word and a full stop; a number; an ellipsis; another mark; a wide mark; a mark and a closing quote; no
#: space behind; the end of a line of its own, of another line, of a list entry; settled; a gap of a text without marks. With the chance of an event to begin with.
_KINDS = {"w": 0.97, "d": 0.95, "e": 0.5, "x": 0.99, "z": 0.98, "q": 0.6, "n": 0.3, "h": 0.7, "r": 0.1, "i": 0.9, "1": 0.999, "p": 0.05}
_KIND = {k: i for i, k in enumerate(_KINDS)}
_ABBREVIATION = 0.1  # the same for a word that is hardly ever seen without its full stop
_SUB = 32  # kinds of closing marks, lengths of lines
_SCRIPTS, _OPENED, _CASES = "LGCADTJHO", ("", "q", "("), "UClmdx"
SHAPES = len(_SCRIPTS) * len(_OPENED) * len(_CASES)
#: what is kept of a place: end of the left and begin of the right text, kind, sub-kind, whether a line of its own ends here,
#: hashed word before the full stop (with closing marks, and alone), hashed right word and its shape
PLACE = np.dtype([("left", "<i4"), ("right", "<i4"), ("kind", "u1"), ("sub", "u1"), ("line", "u1"), ("dotted", "<u4"), ("plain", "<u4"), ("word", "<u4"), ("shape", "u1")])


def _script(c: str) -> str:
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "L"
    for name, a, b in (("C", 0x400, 0x52F), ("A", 0x600, 0x6FF), ("D", 0x900, 0x97F), ("T", 0xE00, 0xE7F), ("J", 0x3040, 0x30FF), ("H", 0x3400, 0xFAFF)):
        if a <= n <= b:
            return name
    return "O"


def _slot(key: str, size: int) -> int:
    return crc32(key.encode("utf-8", "surrogatepass")) & (size - 1)


_MEMO: dict[tuple[str, str, bool], tuple[int, int]] = {}


def _word(opened: str, word: str, nouns: bool) -> tuple[int, int]:
    """(hashed word, shape) of the word right of a gap. nouns: the text writes nouns with capitals, so capitals say less."""
    key = (opened, word, nouns)
    got = _MEMO.get(key)
    if got is None:
        if len(_MEMO) > 400_000:
            _MEMO.clear()
        c = word[0]
        s = _script(c)
        if s in "JH":
            word = c
        elif s == "L" and nouns:
            s = "G"
        if c.isdigit():
            case, word = "d", "0"
        elif c.isupper():
            case = "U" if len(word) > 1 and word.isupper() else "C"
        elif c.islower():
            case = "l" if word.islower() else "m"
        else:
            case = "x"
        o = "" if not opened else "(" if opened[-1] in "([（【" else "q"
        shape = (_SCRIPTS.index(s) * len(_OPENED) + _OPENED.index(o)) * len(_CASES) + _CASES.index(case)
        got = _MEMO[key] = (_slot(f"{s}{o}|{word}", WORDS), shape)
    return got


def places(text: str, nouns: bool = False) -> list[tuple]:
    """All places of a text (as in PLACE) where a sentence may end, but its own end."""
    out: list[tuple] = []
    begin, stop = len(text) - len(text.lstrip()), len(text.rstrip())
    m = _MARKER.match(text, begin)
    listed, skip = m is not None, m.end() if m else -1  # the line is a list entry; its marker's full stop ends nothing
    fresh = begin  # where the line began; -1 once it has a place inside
    marked, markers = False, [(m.start(), m.end())] if m else []
    for m in _GAP.finditer(text, begin, stop):
        at, right = m.start(), m.end()
        if right >= stop or at < skip:
            marked |= right >= stop and m.group("end") is not None
            continue
        kind, sub, line, dotted, plain = "1", 0, False, 0, 0
        if m.group("end"):
            marks, close, gap = m.group("end", "close", "gap")
            left, wide = m.end("close"), marks[-1] in _WIDE
            if not gap and not wide:
                ahead = text[right : right + 2]
                if not (ahead[0].isupper() and (len(ahead) < 2 or ahead[1].islower() or ahead[1] == " ")):
                    continue
                if not close and not (text[at - 1 : at].islower() or text[at - 1 : at] == "%"):
                    continue
                last = _LAST.search(text, max(begin, at - 24), at)
                w = last.group() if last else ""
                if not close and marks[0] == "." and (len(w.rstrip("%")) < 2 or "." in w and not w[0].isdigit()):
                    continue
                kind, sub = "n", 0
            else:
                sub = 2 if close.strip(")]}）〕】 ") else 1 if close else 0
                if marks == "…" or len(marks) > 1 and set(marks) <= {".", "…"}:
                    kind = "e"
                elif marks[-1] == ".":
                    last = _LAST.search(text, max(begin, at - 24), at)
                    w = last.group().lower() if last else ""
                    if not w or w[-1].isdigit() or w[-1] == "%":
                        kind = "d"
                    else:
                        kind, plain = "w", _slot(w, DOTTED)
                        dotted = _slot(f"{w}{sub}", DOTTED)
                else:
                    kind = "z" if wide else "x"
                if sub == 2 and kind != "w":
                    kind, sub = "q", "exzd".index(kind)
        elif m.group("line") is not None:
            left, gap, kind = at, m.group("line"), "r"
            if listed:
                kind = "i"
            elif fresh >= 0:
                kind, sub, line = "h", min((left - fresh) // 12, 6) + 8 * (text[left - 1] == ":"), True
        else:
            left, gap = at, m.group("thai")
        fresh, marked = -1, marked or m.group("end") is not None
        if "\n" in gap:
            marker = _MARKER.match(text, right)
            markers += [(right, marker.end())] if marker else []
            fresh, listed, skip = right, marker is not None, marker.end() if marker else -1
            if listed or gap.count("\n") > 1 or _script(text[left - 1]) == "T":
                kind, sub = "1", 0
        r = _RIGHT.match(text, right)
        out.append((left, right, _KIND[kind], sub, line, dotted, plain, *_word(r.group(1), r.group(2), nouns)))
    return out if marked else sorted([*out, *_unmarked(text, begin, stop, markers, nouns)])


def _unmarked(text: str, begin: int, stop: int, markers: list[tuple[int, int]], nouns: bool) -> list[tuple]:
    """Places between the words of a text without marks, but behind the marker of a list entry and beside Thai letters."""
    out = []
    inside = {e for _, e in markers}
    for m in _BETWEEN.finditer(text, begin, stop):
        left, right = m.span()
        if right in inside or left < right and "T" in (_script(text[left - 1]), _script(text[right])):
            continue
        r = _RIGHT.match(text, right)
        out.append((left, right, _KIND["p"], 0, False, 0, 0, *_word(r.group(1), r.group(2), nouns)))
    return out


def scan(texts: list[str | None]) -> tuple[list[bytes], dict[str, np.ndarray]]:
    """Places of each text, and counts by hash: words inside sentences (`inside`, and by shape), lower-cased (`seen`), words before a full stop (`dotted`)."""
    found: list[bytes] = []
    words: tuple[Counter, Counter] = (Counter(), Counter())
    stats = {"inside": np.zeros(WORDS, np.int64), "shape": np.zeros(SHAPES, np.int64), "seen": np.zeros(DOTTED, np.int64), "dotted": np.zeros(DOTTED, np.int64)}
    for t in texts:
        if not t:
            found.append(b"")
            continue
        inner = _INSIDE.findall(t)
        nouns = sum([w[0].isupper() for w in inner]) > 0.2 * len(inner)
        a = np.array(places(t, nouns), PLACE)
        if not (a["kind"] == _KIND["p"]).any():  # else a sentence may begin at any of these words
            words[nouns].update(inner)
            words[nouns].update(_IDEOGRAPH.findall(t))
        np.add.at(stats["dotted"], a["plain"][a["kind"] == _KIND["w"]], 1)
        found.append(a.tobytes())
    for nouns in (False, True):
        for w, n in words[nouns].items():
            bare = w.lstrip("\"“‘«„(")
            k, shape = _word(w[: len(w) - len(bare)], bare, nouns)
            stats["inside"][k] += n
            stats["shape"][shape] += n
            stats["seen"][_slot(bare.lower(), DOTTED)] += n
    return found, stats


@dataclass
class Model:
    """Tables of fixed size."""

    inside: np.ndarray  # by hashed word
    start: np.ndarray
    behind: np.ndarray  # behind abbreviations
    shape_inside: np.ndarray  # by shape
    shape_start: np.ndarray
    abbreviation: np.ndarray  # by hashed word before a full stop
    event: np.ndarray  # by left key
    case: np.ndarray  # by left key and case of the right word: ln of how much rarer that case is without an event than elsewhere

    def log_odds(self, p: np.ndarray) -> np.ndarray:
        """ln P(word | a boundary before) / P(word | none). A rare word leans on its shape; all within its script."""
        per = lambda x: np.repeat(x.reshape(len(_SCRIPTS), -1).sum(1), len(_OPENED) * len(_CASES))
        all_s, all_i = per(self.shape_start) + 1, per(self.shape_inside) + 1
        share = (self.shape_start + 0.5 * all_s / (all_s + all_i)) / (self.shape_start + self.shape_inside + 0.5)
        w, s = p["word"], p["shape"]
        after = np.where(self._abbreviated(p), self.behind[w], 0)
        # ideographs are counted inside wherever they are; without marks, those that begin a sentence are taken off
        wide = (p["kind"] == _KIND["p"]) & np.isin(s // (len(_OPENED) * len(_CASES)), [_SCRIPTS.index(x) for x in "JH"])
        inside = np.where(wide, np.maximum(self.inside[w] - self.start[w], 0), self.inside[w])
        odds = ((self.start[w] + share[s]) / all_s[s]) / ((inside + after + 1 - share[s]) / all_i[s])
        return np.clip(np.log(np.maximum(odds, 1e-9)), np.where(self._abbreviated(p), -8.0, -5.0), 8.0)

    def _abbreviated(self, p: np.ndarray) -> np.ndarray:
        return (p["kind"] == _KIND["w"]) & self.abbreviation[p["plain"]]

    def left(self, p: np.ndarray) -> np.ndarray:
        """Keys of the left side: abbreviations each, other words together, the other kinds by sub-kind."""
        return np.where(self._abbreviated(p), p["dotted"].astype(np.int64), DOTTED + p["kind"].astype(np.int64) * _SUB + p["sub"])

    def prior(self, p: np.ndarray) -> np.ndarray:
        return np.where(self._abbreviated(p), _ABBREVIATION, np.array(list(_KINDS.values()))[p["kind"]])

    def decide(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For the places of texts with so many places each: is an event likelier than none there?"""
        c = self.event[self.left(p)].astype(np.float64)
        c = np.where(c < 0, self.prior(p), c)
        log = np.log(c / (1 - c)) + self.log_odds(p) + self.case[self.left(p), p["shape"] % len(_CASES)]
        log[p["kind"] == _KIND["1"]] = 20.0
        out = log >= 0
        ends = np.cumsum(sizes)
        plain = p["kind"] == _KIND["p"]
        near = np.zeros(len(p), bool)  # one word from the place before
        near[1:] = plain[1:] & (p["right"][:-1] <= p["left"][1:])
        for i in np.unique(np.searchsorted(ends, np.flatnonzero((p["line"] > 0) | plain), "right")):  # elsewhere places don't depend on each other
            a, b = ends[i] - sizes[i], ends[i]
            out[a:b] = forward_backward(np.exp(log[a:b]).tolist(), p["line"][a:b].tolist(), near[a:b].tolist())
        return out


def forward_backward(odds: list[float], line: list[int], near: list[int] | None = None) -> list[bool]:
    """Where the posterior of an event is at least a half. odds of an event if one comes before; a line without one before
    it, which then goes on from the text above, has a tenth of that; so has a place one word behind an event (near). The
    text's start counts as an event."""
    pair = [(0.1 * o if h else o, 0.1 * o if x else o) for o, h, x in zip(odds, line, near or [0] * len(odds))]
    forward, f = [], 1.0
    for a, b in pair:
        f = (1 - f) * a / (1 + a) + f * b / (1 + b)
        forward.append(f)
    out, none, one = [False] * len(pair), 1.0, 1.0
    for i in range(len(pair) - 1, -1, -1):
        out[i] = forward[i] * one >= (1 - forward[i]) * none
        a, b = pair[i]
        none, one = (none + a * one) / (1 + a), (none + b * one) / (1 + b)
        top = max(none, one)
        none, one = none / top, one / top
    return out


def fit_events(cells: np.ndarray, n: np.ndarray, prior: np.ndarray, cases: np.ndarray, rounds: int = 40, weight: float = 3.0, lean: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Chance of the event by left key, -1 where none was met, and the log factor by left key and case of the right word.

    cells: (left key * cases + case) * BINS + bin of the word's log odds; n: how often; prior: chance by left key to begin
    with; cases: shares of the cases inside sentences. Words of scripts without case have no factor.
    """
    size, k = len(prior), len(cases)
    side, ratio = cells // BINS, np.exp((cells % BINS - BINS // 2) / 2.0)
    left, usual = side // k, np.where(np.arange(k) == _CASES.index("x"), 0.0, cases)
    total = np.bincount(left, n, size)
    c, factor = prior.copy(), np.ones(size * k)
    for _ in range(rounds):
        on = c[left] * ratio * factor[side]
        post = on / (on + 1 - c[left])
        c = np.clip((np.bincount(left, n * post, size) + weight * prior) / (total + weight), 1e-4, 1 - 1e-4)
        without = np.bincount(side, n * (1 - post), size * k).reshape(size, k) * (usual > 0)
        share = (without + lean * usual / usual.sum()) / (without.sum(1, keepdims=True) + lean)
        factor = np.where(usual > 0, np.clip(usual / usual.sum() / np.maximum(share, 1e-9), 1 / 30, 30), 1.0).reshape(-1)
    return np.where(total > 0, c, -1.0), np.log(factor).reshape(size, k)


def abbreviations(dotted: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Words that are seldom without a full stop, against ordinary words, of which about one in eight ends a sentence."""
    bare = np.maximum(seen - dotted, 0)
    return math.log(1 / 300) + dotted * math.log(1 / 0.12) - bare * math.log(0.88 / 0.02) > 0


def _sparse(tables: dict[str, np.ndarray]) -> pa.RecordBatch:
    names, keys, counts = [], [], []
    for name, x in tables.items():
        k = np.flatnonzero(x)
        names += [name] * len(k)
        keys.append(k)
        counts.append(x[k])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(counts).astype(np.int64))], ["name", "k", "n"])


def _gather(df: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """Sum tables (name, k, n) of fixed size on the cluster and fetch them."""
    got = df.groupBy("name", "k").agg(F.sum("n").alias("n")).toArrow()
    name, k, n = np.array(got.column("name").to_pylist(), object), np.array(got.column("k"), np.int64), np.array(got.column("n"), np.float64)
    return {x: np.bincount(k[name == x], n[name == x], size) for x, size in sizes.items()}


_BATCH = "name string, k long, n long"


def read_places(df: DataFrame, id_col: str, text: str, by: str | None = None) -> DataFrame:
    """Staged rows (id, by, v, blank bounds a and b, places) for each row of df, and rows with the counts of a slice of rows (stats).

    One pass over the texts; everything later reads these rows only.
    """
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), T.StructField("by", df.schema[by].dataType if by else T.IntegerType()), T.StructField("v", T.LongType())]
        + [T.StructField(c, T.IntegerType()) for c in "ab"] + [T.StructField(c, T.BinaryType()) for c in ("places", "keys", "counts")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = {"inside": 0, "shape": WORDS, "seen": WORDS + 256, "dotted": WORDS + 256 + DOTTED}
        for b in batches:
            texts = b.column(3).to_pylist()
            for s, e in slices(texts):
                part, own = b.slice(s, e - s), texts[s:e]
                found, stats = scan(own)
                keys = np.concatenate([np.flatnonzero(stats[x]) + o for x, o in base.items()]).astype("<i4").tobytes()
                counts = np.concatenate([x[x > 0] for x in stats.values()]).astype("<i4").tobytes()
                first = [len(t) - len(t.lstrip()) if t else 0 for t in own]
                last = [len(t.rstrip()) if t else 0 for t in own]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(found, pa.binary()), pa.nulls(len(own), pa.binary()), pa.nulls(len(own), pa.binary())],
                    schema.fieldNames(),
                )
                none = [pa.nulls(1, t) for t in (*part.schema.types[:3], pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array([keys], pa.binary()), pa.array([counts], pa.binary())], schema.fieldNames())

    by_col = F.col(f"`{by}`") if by else F.lit(0)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), by_col.alias("by"), F.xxhash64(text).alias("v"), F.col(f"`{text}`").cast("string").alias("text"))
    return stage(rows.mapInArrow(run, schema), "places")


def fit(read: DataFrame) -> Model:
    """The model of the texts of read_places. Only counts in tables of fixed size are gathered."""
    spark = read.sparkSession

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(WORDS + 256 + 2 * DOTTED, np.int64)
        for b in batches:
            for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                flat[np.frombuffer(k, "<i4")] += np.frombuffer(n, "<i4")
        cut = np.split(flat, [WORDS, WORDS + 256, WORDS + 256 + DOTTED])
        yield _sparse(dict(zip(("inside", "shape", "seen", "dotted"), cut)))

    got = _gather(read.where("keys is not null").select("keys", "counts").mapInArrow(sums, _BATCH), {"inside": WORDS, "shape": SHAPES, "seen": DOTTED, "dotted": DOTTED})
    size = DOTTED + len(_KINDS) * _SUB
    zero = np.zeros(WORDS)
    model = Model(got["inside"], zero, zero, got["shape"], np.zeros(SHAPES), abbreviations(got["dotted"], got["seen"]), np.zeros(0), np.zeros(0))
    found = read.where("places is not null and octet_length(places) > 0").select("places")

    first = spark.sparkContext.broadcast(model)

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = first.value
        t = {"start": np.zeros(WORDS, np.int64), "behind": np.zeros(WORDS, np.int64), "shape": np.zeros(SHAPES, np.int64)}
        for b in batches:
            p = np.frombuffer(b"".join(b.column(0).to_pylist()), PLACE)
            ab = own._abbreviated(p)
            sure = (np.isin(p["kind"], [_KIND["x"], _KIND["z"]]) | ((p["kind"] == _KIND["w"]) & ~ab)) & (p["sub"] == 0)
            t["start"] += np.bincount(p["word"][sure], minlength=WORDS)
            t["shape"] += np.bincount(p["shape"][sure], minlength=SHAPES)
            t["behind"] += np.bincount(p["word"][ab], minlength=WORDS)
        yield _sparse(t)

    got = _gather(found.mapInArrow(starts, _BATCH), {"start": WORDS, "behind": WORDS, "shape": SHAPES})
    narrow = lambda x: x.astype(np.float32)
    model = Model(narrow(model.inside), narrow(got["start"]), narrow(got["behind"]), model.shape_inside, got["shape"], model.abbreviation, model.event, model.case)
    second = spark.sparkContext.broadcast(model)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cells = second.value, Counter()
        for b in batches:
            p = np.frombuffer(b"".join(b.column(0).to_pylist()), PLACE)
            p = p[p["kind"] != _KIND["1"]]
            side = own.left(p) * len(_CASES) + p["shape"] % len(_CASES)
            keys, n = np.unique(side * BINS + np.round(own.log_odds(p) * 2).astype(np.int64) + BINS // 2, return_counts=True)
            cells.update(dict(zip(keys.tolist(), n.tolist())))
        yield pa.RecordBatch.from_arrays([pa.array(["cells"] * len(cells), pa.string()), pa.array(list(cells), pa.int64()), pa.array(list(cells.values()), pa.int64())], ["name", "k", "n"])

    # at most as many rows as there are hashed left words, cases and bins; in texts a few thousand
    got = found.mapInArrow(meet, _BATCH).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").toArrow()
    prior = np.concatenate([np.full(DOTTED, _ABBREVIATION), np.repeat(list(_KINDS.values()), _SUB)])
    cases = model.shape_inside.reshape(-1, len(_CASES)).sum(0) + 1
    event, case = fit_events(np.array(got.column("k"), np.int64), np.array(got.column("n"), np.float64), prior, cases / cases.sum())
    model.event, model.case = event.astype(np.float32), case.astype(np.float32)
    return model


def train(df: DataFrame, text: str = "text") -> Model:
    """The model of all texts of df."""
    return fit(read_places(df.withColumn("__id", F.lit(0)), "__id", text))


def spans_of(model: Model, p: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, sentences of each text) from the places of texts whose visible part is first..last; none where that is empty."""
    on = model.decide(p, sizes) if len(p) else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)[on]
    some = last > first
    texts = np.flatnonzero(some)
    start = np.concatenate([first[some], p["right"][on]])
    end = np.concatenate([last[some], p["left"][on]])
    by_start = np.lexsort((start, np.concatenate([texts, owner])))
    by_end = np.lexsort((end, np.concatenate([texts, owner])))
    return start[by_start], end[by_end], np.bincount(owner, minlength=len(sizes)) + some


def sentences_in(model: Model, text: str) -> list[tuple[int, int]]:
    """The sentences of one text as (start, end)."""
    found, _ = scan([text])
    p = np.frombuffer(found[0], PLACE)
    a, b = len(text) - len(text.lstrip()), len(text.rstrip())
    s, e, _ = spans_of(model, p, np.array([len(p)]), np.array([a]), np.array([b]))
    return list(zip(s.tolist(), e.tolist()))


def split(df: DataFrame, id_col: str, text: str = "text", by: str | None = None, read: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """Rows (id, sentence, start_char, end_char), a row per sentence: sentence counts from 0, offsets count code points from 0.

    The model is trained on df's own texts unless one is given. With `by`, of the rows of an id the one with the greatest
    `by` is split (null least; further ties by a hash of the text), and null ids are left out; without, every row is split.
    White space around sentences belongs to none, all else to exactly one. Null, empty and blank texts have no rows; a text
    without any sentence end is one. Other columns are not carried. The texts are read once and not shuffled.
    """
    read = read if read is not None else read_places(df, id_col, text, by)
    shared = df.sparkSession.sparkContext.broadcast(model or fit(read))  # of fixed size
    rows = read.where("places is not null")
    if by:
        newest = Window.partitionBy("id").orderBy(F.col("by").desc_nulls_last(), "v")
        rows = rows.where("id is not null").withColumn("rn", F.row_number().over(newest)).where("rn = 1")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.IntegerType()) for c in ("sentence", "start_char", "end_char"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            raw = b.column(3).to_pylist()
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // PLACE.itemsize
            start, end, n = spans_of(own, np.frombuffer(b"".join(raw), PLACE), sizes, np.array(b.column(1), np.int32), np.array(b.column(2), np.int32))
            number = np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(raw)), n)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int32)) for x in (number, start, end))], schema.fieldNames())

    return rows.select("id", "a", "b", "places").mapInArrow(run, schema)
