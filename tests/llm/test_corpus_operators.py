"""Mixing, Jaccard join, fingerprints, top-k, suffix dedup, pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frontwave.llm import fingerprints, jaccard_join, mixing, suffix_dedup, topk
from frontwave.llm.common import parts, table_of_texts
from frontwave.llm.components import components

DOC = "doc_id long, text string"
FULL = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, texts, **extra):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOC)
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


# ---- mixing


def mixing_docs(spark, n=400):
    rng = random.Random(1)
    return spark.createDataFrame([(i, "word " * rng.randint(1, 40), rng.choice(["en", "en", "de", None]), "hot" if i % 3 else f"s{i % 5}", 0) for i in range(n)], FULL)


@pytest.mark.parametrize("small_cells", [100_000, 0])
def test_mixing_margins_and_budget(spark, small_cells):
    docs = mixing_docs(spark)
    got = mixing.mix(docs, budget=0.5, rounds=16, small_cells=small_cells).withColumn("raked", F.col("mix_tokens") * F.col("mix_weight")).toPandas()
    assert len(got) == docs.count()
    total = got.mix_tokens.sum()
    for m, p in (("source", 0.5), ("lang", 0.7)):
        have = got.groupby(got[m].fillna("(none)")).agg(t=("mix_tokens", "sum"), r=("raked", "sum"))
        want = have.t**p / (have.t**p).sum()
        assert np.allclose(have.r / total, want, atol=1e-6)
    assert (got.mix_tokens * got.mix_probability).sum() == pytest.approx(0.5 * total, rel=1e-6)
    assert got.mix_probability.between(0, 1).all() and 0.35 < got[got.mix_sampled].mix_tokens.sum() / total < 0.65


@pytest.mark.parametrize("budget", [0.0, 0.3, 0.8, 0.97, 1.0])
def test_calibration_by_sums_equals_that_by_order(spark, budget):
    rng = random.Random(2)
    cells = spark.createDataFrame([(f"s{i}", "en", "prose", rng.choice([0, 5, 100, 4000]), rng.choice([0.0, 1.0, 50.0, 9000.0])) for i in range(40)], "source string, lang string, topic string, tokens long, raked double")
    one, two = ({r.source: r.probability for r in mixing.calibrate(cells, budget, by).collect()} for by in (True, False))
    assert one == pytest.approx(two, abs=1e-9)


def test_mixing_targets_and_edges(spark):
    docs = mixing_docs(spark, 60)
    got = mixing.mix(docs, targets={"lang": {"en": 3.0, "de": 1.0}}).toPandas()
    assert (got[got.lang.isna()].mix_probability == 0).all() and not got[got.lang.isna()].mix_sampled.any()
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "x" * 100_000, "en", "a", 0)], FULL).withColumn("mix_sampled", F.lit("clash"))
    assert mixing.mix(odd, budget=1.0).count() == 4
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r[0] for r in spark.createDataFrame([(t,) for t in ("a | b | c", "A B C", "1 2 3 4", "$ % & x", "plain", None)], "t string").select(mixing.topic(F.col("t"))).collect()] == ["tabular", "emphatic", "numeric", "marked", "prose", "(none)"]


# ---- Jaccard join


def brute_components(texts, size, num, den):
    def grams(t):
        w = (t or "").encode().lower().split()
        return frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])

    sets = [grams(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [len(s) for s in sets], label


def near_copies(rng, n, edits):
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 99)) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 999)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("settings", "seed"), [(jaccard_join.CONTRACT, 1), (jaccard_join.JoinSettings(short=2, window=3, part=8, heavy=64, heavy_least=2), 2), (jaccard_join.JoinSettings(words=2, num=60, den=100, short=1, window=1, looser=0, part=5, heavy=16, heavy_least=2), 3)])
def test_jaccard_components(spark, settings, seed):
    rng = random.Random(seed)
    texts = [None, "", " \t", "one", "One", "two words", "TWO  words", "a b c", "x" * 100_000, "é É", "É é"]
    for edits in (1, 3, 6, 12):
        texts += near_copies(rng, 14, edits)
    texts += ["common passage that many share " * 3 + " ".join(f"q{rng.randint(0, 5)}" for _ in range(12)) for _ in range(30)]
    texts += [texts[20]] * 12
    n, label = brute_components(texts, settings.words, settings.num, settings.den)
    got = {r.doc_id: r for r in jaccard_join.similar_classes(rows_of(spark, texts, row=1, n=2), settings).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == n
    assert [got[i].component_id for i in range(len(texts))] == label


def brute_links(texts, settings):
    """The number of other sets that each text's set links with."""
    sets = [frozenset(jaccard_join.gram_set(t, settings.words).tolist()) for t in texts]
    different = [s for s in set(sets) if s]
    links = {s: sum(settings.den * len(s & o) >= settings.num * len(s | o) for o in different if o != s) for s in different}
    return [links.get(s, 0) for s in sets]


@pytest.mark.parametrize("settings", [jaccard_join.CONTRACT, jaccard_join.JoinSettings(words=2, num=60, den=100, short=1, window=1, looser=0, part=5, heavy=16, heavy_least=2)])
def test_jaccard_counts_the_links_of_long_lists(spark, settings):
    rng = random.Random(11)
    texts = near_copies(rng, 130, 2) + near_copies(rng, 20, 3) + ["", None, "other words", "Other words"]
    texts += texts[:5]
    got = {r.doc_id: r.n_links for r in jaccard_join.similar_classes(rows_of(spark, texts), settings).collect()}
    assert [got[i] for i in range(len(texts))] == brute_links(texts, settings)


def test_jaccard_of_large_sets(spark):
    # sets that must share several grams of their prefixes, in short lists and in longer ones
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    texts = []
    for copies, size in ((2, 600), (3, 1500), (25, 700), (4, 2600)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, size // 30)):
                own[rng.randrange(size)] = word()
            texts.append(" ".join(own))
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.similar_classes(rows_of(spark, texts), jaccard_join.CONTRACT).collect()}
    _, label = brute_components(texts, 3, 90, 100)
    assert [got[i] for i in range(len(texts))] == list(zip(label, brute_links(texts, jaccard_join.CONTRACT), strict=True))
    assert len(set(label)) < len(texts)


def test_jaccard_goes_on_past_neighbours(spark):
    # x links with y3 only, and y1 and y2, which are nearer by their ranges, do not link with it
    settings = jaccard_join.JoinSettings(words=1, num=80, den=100, short=2, window=1, looser=0)
    hashed = sorted((int(jaccard_join.gram_set(f"w{i}", 1)[0]), f"w{i}") for i in range(4000))
    of = lambda r: [w for h, w in hashed if h >> 58 == r]
    base = [w for h, w in hashed[:35]]  # the least hashes: the prefixes are theirs
    out = [of(r)[0] for r in range(50, 55)]
    put = [of(r)[1] for r in range(51, 55)]
    sets = {"x": base + out, "y1": base + put + [of(50)[2]], "y2": base + put + [of(50)[3]], "y3": base + put + [out[4]]}
    for seed in range(3):
        ids = dict(zip(sets, random.Random(seed).sample(range(1000), 4), strict=True))
        rows = spark.createDataFrame([(ids[name], " ".join(words)) for name, words in sets.items()], DOC)
        got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.similar_classes(rows, settings).collect()}
        assert got == {ids[name]: (min(ids.values()), n) for name, n in (("x", 1), ("y1", 2), ("y2", 2), ("y3", 3))}


def test_cross_edges_join_groups_that_no_window_met(spark):
    # groups a and c pass the filters in the list of gram 5, b (another group) lies between them by size
    settings = jaccard_join.JoinSettings(words=1, num=80, den=100, window=1)
    ranges = lambda k: bytearray([0] * k + [10] + [0] * (15 - k))
    long = spark.createDataFrame([(5, 1, 10, 0, ranges(0)), (5, 2, 10, 0, ranges(7)), (5, 3, 10, 0, ranges(0)), (6, 8, 10, 0, ranges(1)), (6, 9, 10, 0, ranges(1))], "gram long, node long, n long, pos int, ranges binary")
    labels = spark.createDataFrame([(8, 8), (9, 8)], "node long, label long")
    got = {tuple(sorted(r)) for r in jaccard_join.cross_edges(long, labels, settings, side=1).collect()}
    assert got == {(1, 3)}
    assert jaccard_join.cross_edges(long.where("gram = 6"), labels, settings) is None


def test_link_counts_in_blocks(spark):
    rng = random.Random(12)
    settings = jaccard_join.JoinSettings(words=3, num=70, den=100)
    texts = list(dict.fromkeys(near_copies(rng, 60, 8) + near_copies(rng, 30, 8)))
    made = spark.createDataFrame([(i, bytearray(jaccard_join.gram_set(t, 3).tobytes())) for i, t in enumerate(texts)], "node long, grams binary")
    members = spark.createDataFrame([(i, 0, len(jaccard_join.gram_set(t, 3))) for i, t in enumerate(texts)], "node long, label long, n long")
    made = made.unionByName(made.where("node % 3 = 0"))
    _, want = brute_components(texts, 3, 70, 100)
    for sizes in ({}, {"side": 20, "tile": 7}, {"most": 1500}, {"side": 50, "tile": 30}):
        found = jaccard_join.block_links(made, members, settings, **sizes)
        got = {r.a: r.s for r in found.where("b is null").groupBy("a").agg(F.sum("links").alias("s")).collect()}
        assert [got.get(i, 0) for i in range(len(texts))] == brute_links(texts, settings)
        label = {r.node: r.label for r in components(found.where("b is not null")).collect()}
        assert [label.get(i, i) for i in range(len(texts))] == want


def test_gram_sets(spark):
    rng = random.Random(4)
    texts = [None, "", "a", "a b", "A b", "x" * 10_000 + " y", "tab\tnew\nline\x0bvt\x0cff\rcr \xa0x", "é É"] + [" ".join("w" * rng.randint(1, 30) + str(rng.randint(0, 40)) for _ in range(rng.randint(0, 90))) for _ in range(80)]
    column = pa.array(["pad", *texts])[1:]
    for size in (1, 3, 9):
        grams, at = jaccard_join.gram_sets(*table_of_texts(column), size)
        known = {}
        for i, t in enumerate(texts):
            w = (t or "").encode().lower().split()
            want = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
            own = grams[at[i] : at[i + 1]]
            assert len(own) == len(want) and (own == jaccard_join.gram_set(t, size)).all()
            assert known.setdefault(want, own.tobytes()) == own.tobytes()
        assert len(set(known.values())) == len(known)
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    assert [x for p in parts(batch, 0, 500) for x in p.column(0).to_pylist()] == texts


def test_jaccard_edges(spark):
    assert jaccard_join.similar_classes(rows_of(spark, []).limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (4, "other words are here now"), (None, None)], DOC)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join.similar_classes(rows).collect())
    assert got == [("4", 1, "4"), ("4", 2, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 2, "4")]


def test_one_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "en", "s", 1), (2, "A b c d e f g", "en", "s", 1), (3, None, "en", "s", 1), (4, "z y x w v", "en", "s", 1), (4, "z y x w v", "en", "s", 1)], FULL)
    got = jaccard_join.one_of_each(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]


def test_one_of_each_by_row(spark):
    one, two, three = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    texts = [(1, one), (2, one), (2, two), (None, one), (None, three), (None, three + "  "), (5, "p o n m l k"), (5, "q w e r t y"), (None, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], FULL)
    got = sorted((str(r.doc_id), r.text) for r in jaccard_join.one_of_each(spark, docs, "").collect())
    assert got == [("1", one), ("2", two), ("5", "p o n m l k"), ("5", "q w e r t y"), ("None", ""), ("None", ""), ("None", three)]


def test_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == {x: find(x) for x in linked}


# ---- fingerprints


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "cd", "éf", "gh", "Ij"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 700))) for _ in range(40)] + [None, "", " ", "one two", "x y " * 30_000, "same text here", "same text here"]
    got = pd.DataFrame([r.asDict() for r in fingerprints.edited_pairs(rows_of(spark, texts, sketch="clash")).collect()]).set_index("doc_id").sort_index()
    for bucket, quantiles in ((1, 4096), (3, 4096), (2, 4), (1, 1)):
        again = fingerprints.with_next(rows_of(spark, texts), rows_per_bucket=bucket, quantiles=quantiles).collect()
        assert sum(not r._guest for r in again) == len(texts)
        after = {}
        for r in sorted(again, key=lambda r: (r._bucket, r._guest, r.doc_id or 0)):
            after.setdefault(r._bucket, []).append(r)
        assert len(after) > 10 or bucket == 3
        follows = {a.doc_id: b.text for own in after.values() for a, b in zip(own, own[1:], strict=False)}
        assert [follows[i] for i in range(len(texts))] == [texts[(i + 1) % len(texts)] or "" for i in range(len(texts))]
    errors = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got.loc[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingles(t), shingles(edited)
        errors.append(r.near_edited - (len(a & b) / len(a | b) if a | b else 1))
        assert r.distinct_shingles == pytest.approx(len(a), rel=0.35, abs=0)
        if len(a) < fingerprints.K:
            assert r.distinct_shingles == len(a)
    assert np.sqrt(np.mean(np.square(errors))) < 0.06
    assert got.fingerprint[45] == got.fingerprint[46] and got.near_next[45] == 1
    assert fingerprints.edited_pairs(rows_of(spark, ["x"]).limit(0)).count() == 0
    assert fingerprints.edited_pairs(spark.createDataFrame([(None, "a b"), (3, "c d"), (3, "c d")], DOC)).count() == 3


def test_merged_sketches(spark):
    words = [f"w{i}" for i in range(900)]
    parts = [words[:400], words[396:]]
    own = fingerprints.sketch(spark.createDataFrame([("g", " ".join(p)) for p in parts] + [("e", ""), (None, "a")], "g string, text string"))
    whole = fingerprints.sketch(spark.createDataFrame([(" ".join(words),)], "text string")).first().sketch
    got = {r.g: r.sketch for r in fingerprints.merged(own, ["g"]).collect()}
    assert got["g"] == whole and got["e"] == [] and len(got[None]) == 1
    one = fingerprints.sketch(spark.createDataFrame([(" ".join(words[:300]), " ".join(words))], "text string, other string"))
    both = fingerprints.sketch(one, "other", "wide")
    r = both.select(fingerprints.containment(F.col("sketch"), F.col("wide")).alias("c"), fingerprints.resemblance(F.col("sketch"), F.col("wide")).alias("j")).first()
    assert r.c > 0.75 and abs(r.j - 1 / 3) < 0.15


# ---- top-k


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.3, (300, 7))
    x[40:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, [0.5]), (350, []), (None, [1.0]), (7, x[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    settings = topk.TopSettings(every=10, block=16, queries=4, pivots=5, near=1)
    got = [tuple(r) for r in topk.top_k(df, settings).orderBy("query_id", "rank").collect()]
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    want = []
    for q in sorted({i for i, _ in kept if i % 10 == 0}):
        own = next(v for i, v in kept if i == q)
        scores = sorted(((-int(own[: len(v)] @ v[: len(own)]), i) for i, v in kept if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert [tuple(r) for r in topk.top_k(df.where("vec_id in (50, 3)")).collect()][0][:3] == (50, 1, 3)


@pytest.mark.parametrize("scale", [1.0, 2.0**11, 2.0**14])
def test_topk_of_long_vectors_and_ties(spark, scale):
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 40, (200, 5))) * scale
    x[100:] = x[rng.integers(0, 100, 100)]
    x[150:] = 0.5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, topk.TopSettings(block=16, queries=3, pivots=6, near=1, every=4)).orderBy("query_id", "rank").collect()]
    whole = [[int(np.floor(256 * c)) for c in v] for v in x]
    want = []
    for q in range(0, 200, 4):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in range(200) if i != q)[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == want


def test_topk_of_components_beyond_32_bits(spark):
    df = spark.createDataFrame([(0, [1e7, 0.0]), (1, [0.1, 0.0]), (2, [0.2, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r)[2:] for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(2, 130_560_000_000), (1, 64_000_000_000), (3, 0)]
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e9])], "vec_id long, embedding array<double>"))


# ---- suffix dedup


def brute_strip(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize(("hot", "segment"), [(1024, 4 << 20), (2, 4 << 20), (1024, 150)])
def test_suffix_dedup_against_brute_force(spark, hot, segment):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "abab" * 40]
    for _ in range(60):
        parts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            i = rng.randint(0, 10)
            parts += [p[i : rng.randint(i, len(p))], "".join(rng.choice("xyz") for _ in range(rng.randint(0, 9)))]
        texts.append("".join(parts))
    texts += [texts[10], texts[10]]
    settings = suffix_dedup.DedupSettings(length=24, gram=8, hot=hot, segment=segment)
    got = {r.doc_id: r for r in suffix_dedup.strip_repeats(rows_of(spark, texts, row="clash"), settings).collect()}
    for i, want in enumerate(brute_strip(texts, 24)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want, i
        assert r.kept_sha256 == hashlib.sha256(want[3]).hexdigest()


def test_suffix_dedup_of_many_near_copies(spark):
    # one passage in thousands of documents, in different surroundings and cut at different places: its anchors are hot
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(45))
    around = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    texts = [around(rng.randint(0, 12)) + passage[rng.randint(0, 14) : len(passage) - rng.randint(0, 14)] + around(rng.randint(0, 12)) for _ in range(2500)]
    settings = suffix_dedup.DedupSettings(length=24, gram=8, hot=50)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.strip_repeats(rows_of(spark, texts), settings).collect()}
    assert [got[i] for i in range(len(texts))] == brute_strip(texts, 24)


def test_suffix_dedup_of_repeated_rows_and_long_texts(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    rows = spark.createDataFrame([(1, long)] + [(2, long[1000:1500])] * 30 + [(3, long[2_999_700:] + "z")], DOC)
    got = sorted({(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.report(rows).collect()})
    assert got == [(1, 3_000_000, 800, 2), (2, 500, 500, 1), (3, 301, 300, 1)]


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.report(rows_of(spark, ["x"]).limit(0)).count() == 0
    long = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    rows = spark.createDataFrame([(None, long), (7, long), (7, long[:150]), (7, None)], DOC)
    assert sorted(r.n_removed for r in suffix_dedup.report(rows).collect()) == [0, 0, 400, 400]


@pytest.mark.parametrize("most", [1, 3, 7, 10_000])
def test_classify_holds_back_any_amount(spark, most):
    rng = random.Random(most)
    rows = [(rng.randint(0, 8), rng.randint(0, 4), i, i, i) for i in range(300)] + [(99, 1, 1000 + i, i, i) for i in range(60)] + [(100, 5, 2000, 1, 1)]
    df = spark.createDataFrame(rows, "h long, c long, row long, a int, b int").select("h", F.lit(3).cast("long").alias("c"), F.col("c").alias("d"), "row", "a", "b", F.col("row").between(1040, 1059).alias("again"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = suffix_dedup.classify(df, most).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    classes, anchors = Counter(r[:2] for r in rows), {}
    for h, c in classes:
        anchors.setdefault(h, set()).add(c)
    key = {r[2:]: r[:2] for r in rows}
    plain = Counter((r.row, r.kind) for r in got if r.kind < 2)
    want = Counter((r[2], 0 if classes[r[:2]] > 1 else 1) for r in rows if classes[r[:2]] > 1 or len(anchors[r[0]]) > 1)
    assert plain == want
    reps = Counter(key[(r.row, r.a, r.b)] for r in got if r.kind == 2)
    assert reps == Counter({k: 1 for k, n in classes.items() if n > 1 and len(anchors[k[0]]) > 1})


# ---- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    good = [" ".join(word() for _ in range(80)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!", "WIN!!"]) for _ in range(80)) for _ in range(30)]
    texts = good + bad + [good[0], good[1] + " tail", "token = abcdefgh12345 " + " ".join(word() for _ in range(80))]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], FULL)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), int(i >= 60)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, f"file://{tmp_path}")
        path = f"file://{tmp_path}/{name.replace(' ', '-')}"
        now.write.parquet(path)
        now = spark.read.parquet(path)
        seen[name] = now
        if name != "best-fit packing":
            assert now.columns == docs.columns
    ids = lambda n: {r.doc_id for r in seen[n].select("doc_id").distinct().collect()}
    assert ids("quality classifier") & set(range(60, 90)) == set() and len(ids("quality classifier") & set(range(60))) >= 58
    assert 90 not in ids("n-gram Jaccard join") or 0 not in ids("n-gram Jaccard join")
    clean = {r.doc_id: r for r in seen["secret scans"].collect()}
    assert "abcdefgh12345" not in clean[92].text and clean[92].n_chars == len(clean[92].text)
    assert ids("mixing sources") <= ids("secret scans") and ids("best-fit packing") == ids("mixing sources")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == seen["best-fit packing"].count()


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    twice, long = say(50), say(30_000)
    rows = [(None, say(40)), (None, None), (1, None), (2, ""), (3, " \n"), (4, twice), (4, twice), (4, say(50)), (5, long)]
    docs = spark.createDataFrame([(i, t, None if i == 2 else "en", "s", len(t or "")) for i, t in rows], FULL).withColumn("row", F.lit("clash")).withColumn("_tail", F.lit(1))
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    kept = jaccard_join.one_of_each(spark, docs, "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "4", "5", "None", "None"] and kept.columns == docs.columns
    plain = docs.drop("_tail")
    for stage in (corpus_pipeline.STAGES[0][1], corpus_pipeline.STAGES[2][1]):
        assert stage(spark, plain, f"file://{tmp_path}").count() == len(rows)
    drawn = corpus_pipeline.STAGES[3][1](spark, plain, "")
    assert drawn.columns == plain.columns and drawn.count() <= len(rows)
    packed = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert packed.where("length > 2048 or offset + length > 2048").isEmpty()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), f"file://{tmp_path}").count() == 0
