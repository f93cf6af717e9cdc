import random
import re

import numpy as np
import pytest

from tidemill.llm import ngram_join as nj
from tidemill.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def brute(texts, width=4):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(({tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) if w else set())
    return sets


def components(ids, sets):
    label = list(ids)
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min((x for x in (label[i], label[j]) if x is not None), default=None)
            for k in (i, j):
                if label[k] != low:
                    label[k], changed = low, True
    return label


def near_copies(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            w = rng.choice(texts[-12:]).split()
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5))):
                if w:
                    k = rng.randrange(len(w))
                    w[k : k + rng.choice((0, 1))] = [rng.choice(vocabulary)]
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice((1, 2, 3, 4, 5, 8, 20, 60, 150, 400)))]
            if kind > 0.8:
                w += passage
        texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("block", [nj.BLOCK, 7])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = [None, "", " \n", "One two", "one TWO", "x " * 20_000, *near_copies(1)]
    ids = [None, *range(len(texts), 1, -1)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in zip(ids, texts)], "doc_id long, text string, n_shingles int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(docs).collect()}
    sets = brute(texts)
    want = {i: (len(s), c) for i, s, c in zip(ids, sets, components(ids, sets))}
    assert got == want


@pytest.mark.parametrize("num", [80, 85, 95])
def test_signatures_find_every_linked_pair(num):
    texts = near_copies(5, 300)
    sets = nj.shingle_sets(texts, 4)
    assert [len(s) for s in sets] == [len(s) for s in brute(texts)]
    rng = np.random.default_rng(0)
    for share in (0.0, 0.3, 0.97):
        frequent = rng.random(1 << nj.SKETCH_BITS) < share
        signatures = [set(nj.signatures(s, frequent, num, 100).tolist()) if len(s) else set() for s in sets]
        n = 0
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if both and 100 * both >= num * (len(sets[i]) + len(sets[j]) - both) and not np.array_equal(sets[i], sets[j]):
                    n += 1
                    assert signatures[i] & signatures[j], (i, j, len(sets[i]), len(sets[j]))
        assert n > 10


def test_product_equals_sets():
    sets = [s for s in nj.shingle_sets(near_copies(9, 120), 4)]
    for left, right, same in ((sets, sets, True), (sets[:50], sets[50:], False)):
        i, j = nj.overlapping_pairs(left, right, 85, 100, same)
        want = {(a, b) for a in range(len(left)) for b in range(a + 1 if same else 0, len(right)) if 100 * (x := len(np.intersect1d(left[a], right[b]))) >= 85 * (len(left[a]) + len(right[b]) - x) and x}
        assert set(zip(i.tolist(), j.tolist())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100), (500, 499)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100, 500: 499, 499: 499, **{k: 1000 for k in range(1000, 1100)}}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    sets = brute([r.text for r in rows])
    want = dict(zip([r.doc_id for r in rows], components([r.doc_id for r in rows], sets)))
    assert {r.doc_id: r.component_id for r in nj.ngram_components(docs).collect()} == want
    assert nj.ngram_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("block", [nj.BLOCK, 7])
def test_numbers_of_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    texts = [None, "", "", "One two", "one TWO", *near_copies(1)]
    texts += texts[40:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = brute(texts)
    want = {i: sum(100 * len(a & b) >= 85 * len(a | b) for j, b in enumerate(sets) if j != i and a and b) for i, a in enumerate(sets)}
    got = nj.ngram_components(docs).collect()
    assert len(got) == len(texts) and {r.doc_id: r.n_links for r in got} == want
    size = {c: sum(r.component_id == c for r in got) for c in {r.component_id for r in got}}
    assert any(r.n_links < size[r.component_id] - 1 for r in got)


def test_query_and_its_sql(spark):
    from tests.compare import same
    from tidemill.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.001"
    same(QUERIES["op6_ngram_join"](spark, sf), sf, ORACLES["op6_ngram_join"])
