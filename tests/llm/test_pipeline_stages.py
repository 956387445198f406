"""Each stage of the pipeline against a plain version of it, on what the stage before it kept."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from frontwave.llm import mixing, packing, quality, secret_scan

FULL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    say = lambda n: [word() for _ in range(n)]
    texts = [say(rng.randint(20, 90)) for _ in range(110)] + [say(3000), say(2500), say(2700), say(2600)]
    for k in range(12):  # copies with changes on both sides of the bound, in chains
        own = list(texts[k])
        for _ in range(3):
            own = list(own)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = word()
            texts.append([w.upper() if rng.random() < 0.02 else w for w in own])
    texts += [["a", "b"], ["A", "b"], ["a", "b", "c"], [], []]
    texts = [" ".join(t) for t in texts]
    alnum = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    for k in range(20, 50, 2):
        found = rng.choice([f"password = {alnum(12)}", f"AKIA{alnum(18).upper()}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"x {alnum(44)}", f"token:{alnum(30)}{alnum(30)}", f"api_key={alnum(9)}AKIA{alnum(20).upper()}"])
        texts[k] = texts[k].replace(" ", f" {found} ", 1)
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "CHEAP!!", "WIN!!"]) for _ in range(rng.randint(30, 80))) for _ in range(50)]
    rows = [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["hot", "hot", "hot", "s1", "s2"]), len(t)) for i, t in enumerate(texts + bad)]
    rows.append((len(rows), None, "en", "hot", 0))
    labels = [(i, int(i < len(texts)), int(i >= len(texts))) for i in range(len(texts) + len(bad)) if i % 7]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage, then after each; the folder of each one's files; the folder of the tables."""
    folder = tmp_path_factory.mktemp("stages")
    rows, labels = corpus()
    spark.createDataFrame(rows, FULL).write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    now, seen, paths = spark.read.parquet(f"file://{folder}/documents.parquet"), [], [f"{folder}/documents.parquet"]
    seen.append(now.collect())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, f"file://{folder}").write.parquet(f"file://{folder}/{k}")
        now = spark.read.parquet(f"file://{folder}/{k}")
        seen.append(now.collect())
        paths.append(f"{folder}/{k}")
    return seen, paths, folder


def test_quality_stage(spark, stages):
    seen, _, folder = stages
    model = quality.train(spark.read.parquet(f"file://{folder}/documents.parquet"), spark.read.parquet(f"file://{folder}/labels.parquet"))
    bucket = lambda raw: xxhash.xxh3_64_intdigest(raw) >> (64 - model.bits)
    want = []
    for r in seen[0]:
        raw = (r.text or "").encode()
        at = [*{bucket(w.strip(quality.MARKS)) for w in raw.lower().split()}, *map(bucket, quality.shape(raw, raw.split()))]
        if 1 - 1 / (1 + math.exp(sum(model.weights[k] for k in at) - model.cuts[1])) >= quality.KEEP:
            want.append(r)
    assert {r.doc_id: r for r in seen[1]} == {r.doc_id: r for r in want} and len(seen[1]) == len(want)
    bad = {r.doc_id for r in seen[0] if r.text and "!!" in r.text}
    kept = {r.doc_id for r in seen[1]}
    assert not bad & kept and len(kept) >= 0.95 * (len(seen[0]) - len(bad))


def test_similarity_stage(stages):
    before, after = stages[0][1:3]
    sets = {}
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert len(linked) > 8 and {r.doc_id: r for r in after} == {r.doc_id: r for r in before if find(r.doc_id) == r.doc_id}


def secrets(text):
    """The characters of each secret, by recounting."""
    out = [m.span() for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 8]
    out += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        rule = next((r for r in secret_scan.RULES if re.fullmatch(r.member, m[0])), None)
        if rule and not any(re.fullmatch(a, m[0]) for a in secret_scan.ALLOWED):
            n = min(rule.window, len(m[0]))
            for s in range(len(m[0]) - n + 1):
                if sum(-c / n * math.log2(c / n) for c in Counter(m[0][s : s + n]).values()) >= rule.bits - 1e-9:
                    out.append((m.start() + s, m.start() + s + n))
    return out


def test_secret_stage(stages):
    before, after = stages[0][2:4]
    got, changed = {r.doc_id: r for r in after}, 0
    assert len(after) == len(before)
    for r in before:
        text = r.text
        if text is not None and (spans := secrets(text)):
            inside, on = [False] * len(text), [False] * (len(text) + 1)
            for s, e in spans:
                inside[s:e] = [True] * (e - s)
                on[s + 1 : e] = [True] * (e - s - 1)  # no gap before these characters
            text = "".join("" if h and j else "[SECRET]" if h else c for c, h, j in zip(text, inside, on, strict=False))
            changed += 1
            assert "[SECRET]" in text and got[r.doc_id].n_chars == len(text)
        assert got[r.doc_id].text == text and (got[r.doc_id].lang, got[r.doc_id].source) == (r.lang, r.source)
    assert changed >= 8


def test_mixing_stage(stages):
    seen, paths, _ = stages
    drawn = duckdb.sql(mixing.report_sql(f"read_parquet('{paths[3]}/*.parquet')")).fetchall()
    want = {r[0] for r in drawn if r[-1]}
    assert len(drawn) == len(seen[3]) and 0 < len(want) < len(drawn)
    assert {r.doc_id: r for r in seen[4]} == {r.doc_id: r for r in seen[3] if r.doc_id in want} and len(seen[4]) == len(want)


def test_packing_stage(stages):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(packing.VOCABULARY))
    docs, got = stages[0][4:6]
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    pieces, used = defaultdict(list), Counter()
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.piece == len(pieces[r.doc_id]) and r.start == sum(pieces[r.doc_id])
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append(r.length)
    assert {i: sum(n) for i, n in pieces.items()} == {i: len(n) for i, n in ids.items()}
    assert all(k == packing.CAPACITY for n in pieces.values() for k in n[1:]) and max(map(len, pieces.values())) > 1
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.CAPACITY and len(used) <= -(-sum(used.values()) // packing.CAPACITY) + 1
