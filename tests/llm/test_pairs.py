"""Decontamination, Jaccard join and substring removal against brute force on small fixtures with awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, substring_dedup

from .conftest import EDGES

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = list(EDGES)
    shared = " ".join(rng.choice(words) for _ in range(70))
    for _ in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        texts.append(" ".join(own))
        if rng.random() < 0.4:
            texts.append(texts[-1])
        if rng.random() < 0.5:
            near = list(own)
            near[rng.randrange(len(near))] = "changed"
            texts.append("  ".join(near).upper())
        if rng.random() < 0.3:
            texts.append(f"{' '.join(own[:9])} {shared} {' '.join(own[:5])}")
    rng.shuffle(texts)
    return texts


def brute_jaccard(rows, percent=75):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(docs, seed):
    texts = corpus(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(texts).withColumn("node", F.lit("x"))).collect()}
    assert found == brute_jaccard(enumerate(texts))


def test_jaccard_frequent_class(docs, monkeypatch):
    """Large groups of near copies of each other, with boilerplate: frequent tokens go through combinations."""
    rng, base = random.Random(7), [f"b{i}" for i in range(90)]
    texts = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(90)] = f"c{rng.randrange(9999)}"
        texts.append(" ".join(own))
    texts += [" ".join(base[:30]) + f" x{i} y{i} z{i} u{i}" * 3 for i in range(40)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs(texts)).collect()}
    assert found == brute_jaccard(enumerate(texts))


def test_components_of_chains_stars_and_rings(spark):
    from gridloom.llm.components import components

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(200 + i, 200 + (i + 1) % 40) for i in range(40)] + [(300, 300)]
    edges += [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(120)]
    rng.shuffle(edges)
    frame = spark.createDataFrame([*edges, *edges[:50]], "a long, b long")
    root = list(range(600))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    wanted = {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.component for r in components(frame).collect()} == wanted
    assert components(frame.where("false")).collect() == []


def brute_substrings(rows, width):
    words = {i: SPACE.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("width", [50, 12, 3])
def test_substrings(docs, width):
    texts = corpus(5)
    found = substring_dedup.remove_repeats(docs(texts).withColumn("found", F.lit(1)), width).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in found} == brute_substrings(enumerate(texts), width)
    assert all(sum(x["last"] - x["first"] + 1 for x in r.removed) == r.n_removed for r in found)


def brute_benchmark(rows, items, window):
    pats = []
    for item, t in items:
        w = ALNUM.findall(lower(t))
        k = min(window, len(w))
        pats += [(str(item), w[i : i + k]) for i in range(len(w) - k + 1)] if w else []
    out = {}
    for i, t in rows:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for item, p in pats:
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("limit", [500_000, 40])
def test_benchmark(spark, docs, monkeypatch, limit):
    """In one pass over the documents, and in several."""
    monkeypatch.setattr(decontaminate, "PASS_PATTERNS", limit)
    texts = corpus(6, 25)
    items = [(i, t) for i, t in enumerate([texts[20], texts[30], "w1 w2", "W3", "", None, "one", "changed", " ".join((texts[25] or "x").split()[:14])])]
    bench = spark.createDataFrame([*items, (None, "w5")], "item_id long, text string")
    found = decontaminate.find_benchmark(docs(texts), bench).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found} == brute_benchmark(enumerate(texts), items, 10)
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    assert all(sum(len(ALNUM.findall(lower(raw[r.doc_id][s.start : s.end].decode()))) for s in r.spans) == r.n_hit for r in found)


def test_passes_hold_the_whole_benchmark(spark, monkeypatch):
    """A block that ends at the limit is followed by no empty one; an empty benchmark is one block."""
    monkeypatch.setattr(decontaminate, "PASS_PATTERNS", 2)
    bench = spark.createDataFrame([(i, "abcd") for i in range(3)], "item_id long, text string")
    assert [ids for _, ids in decontaminate._passes(bench, "item_id", "text", 10)] == [["0"], ["1"], ["2"]]
    assert [ids for _, ids in decontaminate._passes(bench.where("false"), "item_id", "text", 10)] == [[]]


def test_texts_over_a_megabyte(docs):
    """Words that cross the edges of hashing tiles, whatever operator reads them."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(99999)}" for _ in range(400_000)]
    long = " ".join([*words, "x" * 1_500_000, *words[:60]])
    texts = [long, long + " end", " ".join(words[1000:1200]), "own " + "y" * 1_200_000]
    near = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(texts)).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3}
    kept = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs(texts), 50).collect()}
    n = len(long.split())
    assert kept == {0: (n, 0), 1: (n + 1, n), 2: (200, 200), 3: (2, 0)}


def test_null_ids_repeated_rows_and_empty_tables(spark, docs):
    frame = docs(["a b c d e f", "a b c d e f", "x y", "z"], [3, 3, None, 9])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_benchmark(frame, bench).collect()) == [3, 3, 9]
    assert sorted(r.component_id for r in jaccard_join.near_duplicates(frame).collect()) == [3, 3, 9]
    assert sorted(r.doc_id for r in substring_dedup.remove_repeats(frame).collect()) == [3, 3, 9]
    for empty in (jaccard_join.near_duplicates(docs([])), substring_dedup.remove_repeats(docs([])), decontaminate.find_benchmark(docs([]), bench)):
        assert empty.collect() == []


def test_hash_of_kept_words(docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = substring_dedup.remove_repeats(docs([text, text + " end"])).select("doc_id", F.sha2("kept", 256).alias("s")).collect()
    assert {r.doc_id: r.s for r in rows} == {0: hashlib.sha256(text.encode()).hexdigest(), 1: hashlib.sha256(b"end").hexdigest()}


def test_meetings_of_keys_are_those_of_plain_pairs():
    """Every linked pair of classes of different components meets, whatever the sizes, the bits of the sketches and the number of pairs at once."""
    rng = random.Random(5)
    base = np.array([rng.getrandbits(64) for _ in range(400)], dtype=np.uint64)
    sets, comps = [], []
    for i in range(60):
        tokens = np.array(sorted({*base[: rng.randrange(120, 400)].tolist(), *(rng.getrandbits(64) for _ in range(rng.randrange(40)))}), dtype=np.uint64)
        sets.append(tokens)
        comps.append(i % 23)
    every, df = np.unique(np.concatenate(sets), return_counts=True)
    known = [np.array([t for t in s if df[np.searchsorted(every, t)] > 1], dtype=np.uint64) for s in sets]
    keys = [jaccard_join.index_keys(len(s), k, df[np.searchsorted(every, k)], 75) for s, k in zip(sets, known, strict=True)]
    row, later = np.repeat(np.arange(60), [len(k) for k, _ in keys]), np.concatenate([x for _, x in keys])
    n, m, odd = (np.array(x) for x in ([len(s) for s in sets], [len(k) for k in known], [jaccard_join._odd(s) for s in sets]))
    found = set()
    for a, b in jaccard_join.meetings(np.concatenate([k for k, _ in keys]), row, np.array(comps)[row], n[row], m[row], later, odd[row], 75):
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    links = set()
    for i in range(60):
        for j in range(i + 1, 60):
            both = len(np.intersect1d(sets[i], sets[j]))
            if comps[i] != comps[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                links.add((i, j))
    assert len(links) > 100 and links <= found
