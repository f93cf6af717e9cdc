"""Fingerprints against a plain definition; trees, shards and components against comparing all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tidemill.llm import simhash
from tidemill.llm.simhash import Trees, fingerprint, near_copies, near_prints

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text, width=4):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius):
    """The first of the values that each one reaches."""
    label = list(range(len(values)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((top(i), top(j)))
                label[y] = x
    return [top(i) for i in range(len(values))]


def clusters(rng, groups, size, flips):
    found = set()
    for _ in range(groups):
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    return sorted(found, key=lambda x: rng.random())


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "One two", "one TWO three FOUR", "é😀 ▁ \x1e x", "ÀÉ Straße İ ß x y", "w " * 500, "a b c d e f g h " * 40, "x\x0by\x0cz\rq\nw"])
def test_fingerprint(text):
    assert fingerprint(text, 4) == plain(text)


def test_fingerprint_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    text = " ".join(random.Random(1).choices("abcdefgh", k=100))
    assert fingerprint(text, 4) == plain(text)


@pytest.mark.parametrize("step", [50, 4_000_000])
def test_trees(monkeypatch, step):
    monkeypatch.setattr(simhash, "STEP_PAIRS", step)
    rng = random.Random(2)
    sets = [clusters(rng, 3, 30, 6), clusters(rng, 40, 1, 0), [0], clusters(rng, 1, 80, 12)]
    values = np.array([x for s in sets for x in s], dtype=np.uint64)
    trees = Trees(values, np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    assert all(trees.edge[i] == int(values[i] ^ values[trees.parent[i]]).bit_count() for i in range(len(values)) if trees.parent[i] >= 0)
    below = [(trees.parent[i], trees.edge[i]) for i in range(len(values)) if trees.parent[i] >= 0]
    assert len(set(below)) == len(below)  # no two children at one distance
    a, b = trees.near(np.arange(len(values)), 4)
    start, want = 0, set()
    for s in sets:
        want |= {(start + i, start + j) for i in range(len(s)) for j in range(len(s)) if i != j and (s[i] ^ s[j]).bit_count() <= 4}
        start += len(s)
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
    start, label = 0, trees.labels(4).tolist()
    for s in sets:
        assert [x - start for x in label[start : start + len(s)]] == linked(s, 4)
        start += len(s)


@pytest.mark.parametrize("tree_nodes, blocks", [(8_192, None), (16, None), (64, 6), (16, 7)])
def test_links_connect_what_all_pairs_connect(spark, tree_nodes, blocks):
    values = clusters(random.Random(3), 6, 60, 7)
    table = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in values], "print long")
    label = {x: x for x in values}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in near_prints(table, tree_nodes=tree_nodes, blocks=blocks).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    want = linked(values, 4)
    groups = {}
    for x, w in zip(values, want):
        groups.setdefault(w, set()).add(top(x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_more_prints_are_cut_finer():
    assert [simhash._blocks(n, 4) for n in (0, 10**6, 10**9, 10**11, 10**13)] == sorted(simhash._blocks(n, 4) for n in (0, 10**6, 10**9, 10**11, 10**13))
    assert simhash._blocks(10**5, 4) == 5 < simhash._blocks(10**9, 4) == 6


def test_documents(spark):
    rng = random.Random(4)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(50)) for _ in range(400)]
    texts = [None, "", " \n", "a", "a", "one two three", "ONE two three"]
    for _ in range(60):  # a group of near copies
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "new" + str(rng.randrange(1000))
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 30
    rows = [(i * 7 % 101 if i < 90 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(500, texts[-1], "clash", "clash")] * 2
    got = near_copies(spark.createDataFrame(rows, "doc_id long, text string, print string, component string")).collect()
    prints = [plain(t) for _, t, _, _ in rows]
    label = linked(prints, 4)
    least = {}
    for (i, *_), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(g))) for (i, *_), p, g in zip(rows, prints, label))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want
    assert len({p for p, g in zip(prints, label) if g == label[-1]}) > 1  # not copies alone


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [plain(t) for _, t in rows]
    label = linked(prints, 4)
    least = {}
    for (i, _), g in zip(rows, label):
        least[g] = min(least.get(g, i), i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_copies(docs).collect()} == {i: (f"{p:016x}", least[g]) for (i, _), p, g in zip(rows, prints, label)}


def test_empty_table(spark):
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


