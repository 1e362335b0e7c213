"""Operators for training text against brute force, known answers and awkward tables."""

import base64
import math
import random
import statistics
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siltstone.llm")
from siltstone.llm import bpe, cluster, distinct, fusion, lookalike, neardup, packing, sentences, splitting  # noqa: E402

LONG = "Every trial raised the dose of 4.5 mg. " * 3000


def texts(spark, rows, schema="id long, text string"):
    return spark.createDataFrame(rows, schema)


# ---- p1


def test_probit(spark):
    ps = [1e-9, 1e-4, 0.02, 0.02425, 0.3, 0.5, 0.77, 0.98, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", fusion.probit(F.col("p"), "p").alias("z")).collect()
    assert all(abs(r.z - statistics.NormalDist().inv_cdf(r.p)) < 1e-7 for r in got)


def ranked_by_hand(rows):
    out = {}
    for k in (2, 3):
        have = sorted(r[k] for r in rows if r[k] is not None)
        for r in rows:
            if r[k] is not None:
                lo, same = sum(x < r[k] for x in have), have.count(r[k])
                out.setdefault(r[1], []).append(statistics.NormalDist().inv_cdf((lo + (same + 1) / 2 - 0.5) / len(have)))
    return {r[1]: statistics.mean(out[r[1]]) if r[1] in out else None for r in rows}


@pytest.mark.parametrize("hot", [500_000, 10])
def test_fusion(spark, hot):
    rng = random.Random(3)
    rows = [("g", f"i{i:03}", rng.choice([None, rng.gauss(0, 1), 1e9, 0.5]), rng.randint(0, 9) / 3) for i in range(300)] + [("g", "none", None, None)]
    df = spark.createDataFrame(rows, "g string, i string, a double, b double").withColumn("place", F.lit(7)).withColumn("n", F.lit(1))
    got = fusion.fuse(df, "g", "i", {"a": 1.0, "b": 1.0}, hot_rows=hot).collect()
    want = ranked_by_hand(rows)
    assert len(got) == 301
    assert all((r.fused is None) == (want[r.i] is None) and (r.fused is None or abs(r.fused - want[r.i]) < 1e-6) for r in got)
    assert [r.i for r in sorted(got, key=lambda r: r.place)][-1] == "none"


def test_fusion_awkward(spark):
    df = spark.createDataFrame([(None, "x", float("nan")), (None, "y", 1.0), ("g", "x", 1.0), ("g", "x", 1.0)], "g string, i string, a double")
    got = fusion.fuse(df, "g", "i", {"a": 1.0}).collect()
    assert len(got) == 4 and sorted(r.place for r in got if r.g == "g") == [1, 2]
    assert {r.i: r.fused for r in got if r.g is None} == {"x": None, "y": 0.0}
    assert fusion.fuse(df.limit(0), "g", "i", {"a": 1.0}).count() == 0


# ---- p2


def brute_pairs(rows, threshold):
    sets = {i: (neardup.canonical(t)) for i, t in rows if t and t.strip()}
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if neardup.exact_similarity(sets[a], sets[b], 5) >= threshold}


def noisy(rng, t):
    w = t.split()
    for _ in range(rng.randint(1, 4)):
        w[rng.randrange(len(w))] = rng.choice(["new", "other", "words"])
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    rows = [(f"c{i:03}", " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 60)))) for i in range(120)]
    rows += [(f"d{i:03}", noisy(rng, rows[i][1])) for i in range(80)] + [(f"e{i}", rows[0][1].upper() + "  ") for i in range(30)]
    rows += [("n1", None), ("n2", ""), ("n3", "  \n"), ("s1", "abc"), ("s2", "ABC"), ("s3", "abd"), ("l1", LONG), ("l2", LONG + "end")]
    df = texts(spark, rows, "id string, text string").withColumn("n", F.lit(0)).withColumn("rep", F.lit("x"))
    members, links = neardup.near_duplicates(df, "id", "text", threshold=0.6)
    got = {(r.id_a, r.id_b) for r in neardup.expand(members, links).collect()}
    assert got == brute_pairs(rows, 0.6)
    assert members.count() == len([1 for _, t in rows if t and t.strip()])


def test_near_duplicates_blocks_and_newest(spark):
    base = [f"word{i}" for i in range(40)]
    rows = [(f"c{i:02}", " ".join([*base, f"tail{i}"]), 1) for i in range(40)] + [("c00", "something else entirely here", 0), ("c00", None, None), (None, "x y z", 1)]
    df = texts(spark, rows, "id string, text string, at int")
    members, links = neardup.near_duplicates(df, "id", "text", by="at", threshold=0.8, block=7)
    assert links.count() == 40 * 39 // 2 and members.count() == 40
    none = neardup.near_duplicates(df.limit(0), "id", "text", by="at")
    assert none[0].count() == none[1].count() == 0


def test_large_groups_of_copies_are_stars(spark):
    rows = [(f"a{i:02}", "the same text here") for i in range(20)] + [("b", "the same text here!"), ("c1", "The same text here"), ("c2", "The same text here")]
    members, links = neardup.near_duplicates(texts(spark, rows, "id string, text string"), "id", "text", threshold=0.6)
    got = [(r.id_a, r.id_b) for r in neardup.expand(members, links, full_copies=5, block=2).collect()]
    every = [(f"a{i:02}", x) for i in range(20) for x in ("b", "c1")] + [("a00", f"a{i:02}") for i in range(1, 20)] + [("a00", "c2"), ("b", "c1"), ("b", "c2"), ("c1", "c2")]
    assert sorted(got) == sorted(every)
    whole = [(r.id_a, r.id_b) for r in neardup.expand(members, links, block=2).collect()]
    assert len(whole) == len(set(whole)) == 23 * 22 // 2


@pytest.mark.parametrize("threshold", [0.5, 0.6])
def test_crowded_bands_are_compared_in_blocks(spark, threshold):
    rng = random.Random(9)
    plate = "this notice was made by a machine and may be read by all who care to do so at any time of day or night"
    rows = [(f"p{i:03}", plate + " " + " ".join(f"{rng.randrange(10**5)}" for _ in range(rng.choice([2, 9, 12])))) for i in range(300)]
    members, links = neardup.near_duplicates(texts(spark, rows, "id string, text string"), "id", "text", threshold=threshold, block=4)
    got, true = {(r.id_a, r.id_b) for r in neardup.expand(members, links).collect()}, brute_pairs(rows, threshold)
    assert got <= true and len(got) >= 0.98 * len(true) > 1000


def test_bands_never_fall_short():
    assert neardup.bands_for(0.5, 5, 0.02) * 5 > 256
    with pytest.raises(ValueError):
        neardup.bands_for(0.1, 5, 0.02)


def test_signature_estimates():
    rng = random.Random(1)
    w = [f"{rng.randrange(10**6)}" for _ in range(300)]
    for share in (0.5, 0.8, 0.95):
        a, b = " ".join(w), " ".join(w[: int(300 * share)] + [f"z{i}{rng.random()}" for i in range(300 - int(300 * share))])
        m = neardup.minima([a, b], 5)
        assert abs((m[0] == m[1]).mean() - neardup.exact_similarity(a, b, 5)) < 0.15


# ---- p3


def test_clusters_find_subjects(spark):
    rng = random.Random(2)
    common = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(200)]
    subject = [["".join(rng.choice("qrstuvwx") for _ in range(8)) for _ in range(12)] for _ in range(5)]
    rows = [(f"{s}-{i}", " ".join(rng.sample(common, 25) + rng.sample(subject[s], 8))) for s in range(5) for i in range(60)]
    rows += [(f"out-{i}", " ".join(rng.sample(common, 33))) for i in range(10)] + [("null", None), ("blank", " "), ("0-0", rows[0][1])]
    df = texts(spark, rows, "id string, text string").withColumn("cluster", F.lit(1))
    got = cluster.clusters(df.repartition(3), "id", "text", dims=12, leaves=64).collect()
    assert len(got) == len(rows) - 1
    by: dict = {}
    for r in got:
        if r.cluster is not None and "-" in r.id and not r.id.startswith("out"):
            by.setdefault(r.cluster, []).append(r.id[0])
    assert sum(map(len, by.values())) > 285
    assert all(max(map(v.count, set(v))) / len(v) > 0.95 for v in by.values()) and {max(set(v), key=v.count) for v in by.values()} == set("01234")
    assert next(r.cluster for r in got if r.id == "blank") is None


def test_rows_of_entries_set_aside_are_clustered(spark):
    rows = [(i, f"subject{chr(97 + i % 20) * 3} matter{chr(97 + i % 20) * 3} theme{chr(97 + i % 20) * 3}") for i in range(400)]
    got = cluster.clusters(texts(spark, rows, "id long, text string").repartition(2), "id", "text", dims=32, leaves=8, coherence=0.8).collect()
    assert len(got) == 400 and all(r.cluster is not None for r in got)
    assert len({(r.id % 20, r.cluster) for r in got}) == 20 and len({r.cluster for r in got}) > 8  # no more than the leaves without further passes


def test_clusters_do_not_depend_on_order_or_partitions(spark):
    rng = random.Random(5)
    subject = [["".join(rng.choice("qrstuvwx") for _ in range(8)) for _ in range(12)] for _ in range(6)]
    rows = [(i, " ".join(rng.sample(subject[i % 6], 7) + [f"noise{rng.randint(0, 50)}x"])) for i in range(600)]
    run = lambda df: sorted(cluster.clusters(df, "id", "text", dims=16, leaves=20, per=100).collect())
    first = run(texts(spark, rows).repartition(2))
    assert run(texts(spark, rows[::-1]).repartition(7, "id")) == first and len({r.cluster for r in first}) >= 6


def test_small_subject_beside_a_large_one():
    u = np.eye(4)
    n, s = np.array([1000.0, 1000.0, 9.0]), np.array([1000 * u[0], 1000 * (u[0] + 0.1 * u[1]), 9 * u[2]])
    size, centre = cluster.cut_tree(n, s, cluster.ward(n, s), 0.66, 8)
    assert size.tolist() == [2000, 9] and abs(centre[1] @ u[2]) > 0.99


def test_no_label_wins_where_it_is_commonest(spark):
    got = spark.createDataFrame([(i, i // 10, 0.5) for i in range(20)], "id long, cluster int, similarity double")
    labels = spark.createDataFrame([(i, -1 if i < 6 else None if i < 8 else 3, "x" if i != 11 else "") for i in range(20)], "id long, t int, l string")
    out = {r.cluster: r for r in cluster.describe(got, "id", labels, ["t", "l"]).collect()}
    assert out[0].t is None and out[1].t == 3 and out[1].l == "x" and out[0]["size"] == 10 and out[0].typical == [0, 1, 2]


def test_clusters_of_nothing(spark):
    assert cluster.clusters(texts(spark, []), "id", "text", dims=4).count() == 0
    assert cluster.clusters(texts(spark, [(1, None), (2, "")]), "id", "text", dims=4).collect()[0].cluster is None


def test_tree_keeps_counts_and_ward_orders():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for many in (False, True):
        tree = cluster.Tree(6, 400, 0.8)
        for i in range(0, 500, 50):
            if many:
                tree.insert_many(x[i : i + 50])
            else:
                [tree.insert(1.0, v) for v in x[i : i + 50]]
        n, s = tree.entries()
        assert len(n) == tree.leaves <= 400 and n.sum() == 500 and np.allclose(s.sum(0), x.sum(0))
    tight = cluster.Tree(6, 20, 0.9)
    tight.insert_many(x)
    assert tight.leaves <= 20 and tight.entries()[0].sum() < 500
    merges = cluster.ward(np.ones(4), np.array([[0.0], [0.1], [5.0], [5.1]]))
    assert {frozenset(m) for m in merges[:2]} == {frozenset((0, 1)), frozenset((2, 3))}


# ---- p4

def trained(spark, extra=()):
    names, verbs = ["Gidon", "Nalur", "Tema", "Cavo"], ["raised", "fell", "showed", "ended"]
    rng = random.Random(4)
    many = []
    for _ in range(400):
        s = [f"The {rng.choice(['dose', 'trial', 'group'])} {rng.choice(verbs)} with Dr. {rng.choice(names)} in Fig. {rng.randint(1, 9)} today{rng.choice('.!?')}"]
        s += [f"{rng.choice(['It', 'Then another', 'See', 'Each', 'The'])} {rng.choice(['dose', 'trial'])} {rng.choice(verbs)} soon{rng.choice('.!?')}"]
        s += [f"“It {rng.choice(verbs)}!” said the {rng.choice(['trial', 'group'])}.", "今天下雨。他说「你好！」这样。"]
        many.append(" ".join(s))
    return texts(spark, [(i, t) for i, t in enumerate([*many, *extra])])


@pytest.fixture(scope="module")
def model(spark):
    return sentences.train(trained(spark))


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The dose fell. It rose.", ["The dose fell.", "It rose."]),
        ("Dr. Gidon raised 4.5 mg today. See Fig. 3 for more.", ["Dr. Gidon raised 4.5 mg today.", "See Fig. 3 for more."]),
        ("“It ended!” said the trial. The group fell.", ["“It ended!” said the trial.", "The group fell."]),
        ("(Each dose fell today.) The trial ended.", ["(Each dose fell today.)", "The trial ended."]),
        ("Background\nThe dose fell.", ["Background", "The dose fell."]),
        ("The list.\n1. one dose\n2. another dose\n- third", ["The list.", "1. one dose", "2. another dose", "- third"]),
        ("The dose rose in the\ntrial today. It fell.", ["The dose rose in the\ntrial today.", "It fell."]),
        ("今天下雨。他说「你好！」这样。", ["今天下雨。", "他说「你好！」这样。"]),
        ("นินวันชู กีกุมจุม\nวันชู", ["นินวันชู", "กีกุมจุม", "วันชู"]),
        ("no end here", ["no end here"]),
        ("  ", []),
        ("and the rest of it. The dose fell.\n\nNext block", ["and the rest of it.", "The dose fell.", "Next block"]),
    ],
)
def test_boundaries(model, text, expected):
    assert [text[a:b] for a, b in sentences.sentences_in(model, text)] == expected


def test_sentences_cover_the_text(spark):
    extra = [None, "", " \n ", LONG, "a" * 5000, "...", "?!", "　。", "1.", "- ", "\n\n\n", "A.\x00B"]
    df = trained(spark, extra).withColumn("sentence", F.lit(9)).withColumn("at", F.lit(1))
    rows = {r.id: r.text for r in df.collect()}
    by: dict = {}
    for r in sentences.split(df, "id").collect():
        by.setdefault(r.id, []).append((r.start_char, r.end_char))
    for i, t in rows.items():
        spans = sorted(by.get(i, []))
        assert bool(spans) == bool(t and t.strip())
        at = 0
        for a, b in spans:
            assert a < b and not t[at:a].strip() and t[a:b] == t[a:b].strip()
            at = b
        assert not (t or "")[at:].strip()
    assert sentences.split(df.limit(0), "id").count() == 0
    assert sentences.split(df.unionByName(df), "id", by="at").count() == sum(map(len, by.values()))


def test_text_without_marks(spark):
    rng, starts, inner = random.Random(6), ["it", "then", "each", "see", "now"], ["dose", "trial", "group", "fell", "rose", "showed", "again", "more", "soon", "there"]
    sentence = lambda: [rng.choice(starts), *rng.choices(inner, k=rng.randint(4, 8))]
    marked = [" ".join(" ".join(sentence()) + "." for _ in range(8)) for _ in range(200)]
    wide = ["".join("今" + "".join(rng.choices("天下雨他说这样子", k=6)) + "。" for _ in range(6)) for _ in range(100)]
    bare, true = [], []
    for i in range(60):
        parts = [" ".join(sentence()) if i % 3 else "今" + "".join(rng.choices("天下雨他说这样子", k=6)) for _ in range(6)]
        bare.append((" " if i % 3 else "").join(parts))
        true.append(parts)
    got: dict = {}
    df = texts(spark, list(enumerate([*marked, *wide, *bare])))
    for r in sentences.split(df, "id").collect():
        got.setdefault(r.id, []).append((r.start_char, r.end_char))
    found = [[t[a:b] for a, b in sorted(got[300 + i])] for i, t in enumerate(bare)]
    right = sum(x in y for x, parts in zip(found, true) for y in [parts] for x in x)
    assert right / sum(map(len, true)) > 0.95 and right / sum(map(len, found)) > 0.95


def test_forward_backward_equals_enumeration():
    rng = random.Random(8)
    for _ in range(50):
        n = rng.randint(1, 6)
        odds, line, near = [math.exp(rng.uniform(-3, 3)) for _ in range(n)], [rng.random() < 0.5 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        on = [0.0] * n
        total = 0.0
        for k in range(2**n):
            p, last = 1.0, True
            for i in range(n):
                o = odds[i] * (0.1 if line[i] and not last or near[i] and last else 1)
                last = bool(k >> i & 1)
                p *= o / (1 + o) if last else 1 / (1 + o)
            total += p
            for i in range(n):
                on[i] += p * (k >> i & 1)
        assert all(abs(x / total - 0.5) < 1e-9 or (x / total >= 0.5) == y for x, y in zip(on, sentences.forward_backward(odds, line, near)))


# ---- p5


def greedy(succ):
    out = [0]
    while out[-1] < len(succ) - 1:
        out.append(int(succ[out[-1]]))
    return out


def test_pointer_doubling_equals_greedy():
    rng = random.Random(6)
    for _ in range(60):
        n, limit = rng.randint(1, 300), rng.randint(5, 60)
        overlap = rng.randrange(limit // 2)
        pick = lambda k: np.array(sorted(rng.sample(range(1, n), min(n - 1, k))), np.int64)
        succ = splitting.successors(n, pick(3), pick(20), limit, overlap)
        cuts = splitting.reached(succ)
        assert cuts.tolist() == greedy(succ)
        assert all(b - max(a - overlap, 0) <= limit for a, b in zip(cuts, cuts[1:]))


def test_split_oversized(spark, model):
    rows = [(1, "a b c", ["x"]), (2, None, None), (3, " ", None), (4, LONG, ["y"]), (5, "一" * 1200, []), (6, "\n\n".join(["w " * 300] * 4), ["z"]), (6, "a", None)]
    df = spark.createDataFrame(rows, "id long, text string, doc_ids array<string>").withColumn("piece", F.lit("clash"))
    got: dict = {}
    for r in splitting.split_oversized(df, "text", model).collect():
        got.setdefault((r.id, r.n_pieces), []).append(r)
    for (i, n), ps in got.items():
        ps.sort(key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(n))
        for p in ps:
            if p.text and p.text.strip():
                assert len(splitting.token_bounds(p.text)) == p.piece_tokens <= 512
        source = next(t for j, t, _ in rows if j == i and (n == 1 or t and len(t) > 5))
        for a, b in zip(ps, ps[1:]):
            assert len(splitting.token_bounds(source[b.start_char : a.end_char])) == 64
    level = {i: ps[0].cut_at for (i, n), ps in got.items() if n > 1}
    assert level == {4: "sentence", 5: "token", 6: "paragraph"}
    assert splitting.split_oversized(df.limit(0), "text", model).count() == 0
    assert df.select(splitting.count_tokens(F.lit("ab cd一二 ไท x")).alias("n")).first().n == len(splitting.token_bounds("ab cd一二 ไท x")) == 7


# ---- p6


@pytest.mark.parametrize("hot", [100_000, 2])
def test_ppmi(spark, hot):
    rows = [("a", ["x", "x", "y"]), ("b", ["x", "z"]), ("c", []), ("d", None), (None, ["x"]), ("a", ["y", None]), ("e", ["x"] * 5)]
    df = spark.createDataFrame(rows, "id string, ts array<string>").withColumn("tf", F.lit(1)).withColumn("r", F.lit(1))
    counts = {"a": {"x": 2, "y": 2}, "b": {"x": 1, "z": 1}, "e": {"x": 5}}
    total, size = {"x": 8, "y": 2, "z": 1}, {k: sum(v.values()) for k, v in counts.items()}
    mass = sum(s**0.75 for s in size.values())
    want = {(k, t): max(0.0, math.log(n * mass / (total[t] * size[k] ** 0.75))) for k, v in counts.items() for t, n in v.items()}
    got = distinct.ppmi(df, "id", "ts", hot=hot).collect()
    assert {(r.id, r.term): pytest.approx(r.ppmi, abs=1e-8) for r in got} == want and len(got) == len(want)
    assert distinct.ppmi(df.limit(0), "id", "ts").count() == 0


# ---- p7


def test_encoding(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS_PATH, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(0)
    rows = [(1, None), (2, ""), (3, "<|endoftext|> it's  \t\n"), (4, "q" * 20000 + "aab" * 900), (5, LONG), (6, "é" * 700 + "語" * 900 + " 👩🏽‍🔬")]
    rows += [(i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x400, 0x460), rng.randrange(0x4E00, 0x4F00), 32])) for _ in range(200))) for i in range(7, 60)]
    df = texts(spark, rows).withColumn("ids", F.lit("clash")).withColumn("other", F.array(F.lit(1)))
    got = {r.id: r for r in bpe.encode(df).collect()}
    assert all(list(got[i].ids) == enc.encode_ordinary(t or "") and got[i].other == [1] for i, t in rows)
    assert all(enc.decode(got[i].ids) == (t or "") for i, t in rows)
    assert {r.id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(enc.encode_ordinary(t or "")) for i, t in rows}
    assert bpe.encode(df.limit(0)).count() == 0


# ---- p8


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_on_counts_equals_best_fit_on_items(seed):
    rng = random.Random(seed)
    cap = 50
    hist = {n: rng.randint(1, 30) for n in rng.sample(range(1, cap + 1), 20)}
    rows, total = packing.best_fit_plan(hist, cap)
    free: list[int] = []
    for n in sorted(hist, reverse=True):
        for _ in range(hist[n]):
            fit = [f for f in free if f >= n]
            if fit:
                free[free.index(min(fit))] -= n
            else:
                free.append(cap - n)
    assert total == len(free)


@pytest.mark.parametrize("group", [1_000_000, 7])
def test_packing(spark, group):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 5, 5, 5, rng.randint(1, 100), 250, None, -3])) for i in range(400)] + [(1, 5), (1, 5)]
    got = packing.pack(spark.createDataFrame(rows, "id long, size int").withColumn("container", F.lit("x")), "id", "size", 100, group).collect()
    assert len([r for r in got if r.piece == 0]) == len(rows)
    assert sum(r.piece_size for r in got) == sum(max(0, s or 0) for _, s in rows)
    by: dict = {}
    for r in got:
        assert (r.container is None) == (r.piece_size == 0) and (r.n_pieces == 1 or r.size > 100)
        if r.container is not None:
            by.setdefault(r.container, []).append((r.start, r.start + r.piece_size))
    for spans in by.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    need = math.ceil(sum(r.piece_size for r in got) / 100)
    assert len(by) <= 1.15 * need + 2
    assert packing.pack(spark.createDataFrame([], "id long, size int"), "id", "size").count() == 0


# ---- p9

SAME = [("cope", "соре"), ("ﬁne", "fine"), ("é", "é"), ("ＡＢ１", "AB1"), ("a b", "a b"), ("a​b", "ab"), ("金", "金"), ("very", "νery"), ("﻿x", "x"), ("ё1", "ë1")]
OTHER = [("a", "A"), ("e", "é"), ("m2", "m²"), ("a,b", "a;b"), ("a\nb", "a b"), ("и", "й"), ("a b", "ab")]


def test_look_alike(spark):
    rows = [(2 * i + k, p[k] + " text") for i, p in enumerate(SAME + OTHER) for k in (0, 1)]
    rows = [(i, f"{i // 2} {t}") for i, t in rows] + [(1000, None), (1001, ""), (1002, " ​"), (1003, "　"), (1004, LONG), (1005, LONG + "​"), (1006, LONG)]
    df = texts(spark, rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    got = {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(len(SAME))} | {(1004, 1005), (1005, 1006)}
    links = {r.id: r.rows - r.copies for r in lookalike.same_look_classes(df).collect()}
    assert links == {i: sum(i in p for p in got) for i in {x for p in got for x in p}}
    forms = {r.doc_id: r.form for r in lookalike.normalize(df).collect()}
    assert forms[1000] is None and forms[1001] == "" and all(f is None or f == unicodedata.normalize("NFC", f) for f in forms.values())
    assert lookalike.same_look_pairs(df.limit(0)).count() == 0


def test_large_look_groups_are_whole(spark):
    rows = [(i, "case") for i in range(1200)] + [(2000, "саsе"), (2001, "сase"), (2002, "cаse"), (2003, "casе")]
    df = texts(spark, rows, "doc_id long, text string")
    got = [(r.id_a, r.id_b) for r in lookalike.same_look_pairs(df).collect()]
    true = {(i, v) for i in range(1200) for v in range(2000, 2004)} | {(v, w) for v in range(2000, 2004) for w in range(v + 1, 2004)}
    assert len(got) == len(true) and set(got) == true


def test_speller_keeps_to_one_alphabet():
    many = ["the same case of soap", "copy the paper"] * 50 + ["сорока поёт рано", "народ и река"] * 50
    counts = dict(lookalike.pair_counts(many))
    s = lookalike.Speller(counts)
    assert s.text("thе pаper", {}) == "the paper"
    assert s.text("cорока", {}) == "сорока"
    assert lookalike.fold("👩‍🔬 a‍b") == "👩‍🔬 ab"
