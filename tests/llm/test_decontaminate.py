import random
import tracemalloc

import pytest

from tidemill.llm import decontaminate as d

WORDS = [f"w{i}" for i in range(30)]


def brute_coverage(item, doc, least):
    """Greedy string tiling by definition: mark the longest unmarked common run, ties by place, until none is left."""
    mi, md, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return total
        mi[i : i + n] = [True] * n
        md[j : j + n] = [True] * n
        total += n


@pytest.mark.parametrize("pairs", [d.PAIRS, 0])
def test_tiling_equals_definition(monkeypatch, pairs):
    """With both ways to find matches: all pairs of a seed's places at once, and swept along the item."""
    monkeypatch.setattr(d, "PAIRS", pairs)
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.choice(WORDS[:6]) for _ in range(rng.randrange(3, 22))]
        doc = []
        while len(doc) < rng.randrange(1, 50):
            a = rng.randrange(len(item))
            doc += item[a : a + rng.randrange(1, 9)] if rng.random() < 0.6 else [rng.choice(WORDS)]
        for least in (2, 3):
            want = brute_coverage(item, doc, least)
            got = d.Passages([(7, " ".join(item))], least, 1e-9).find([" ".join(doc)])[0]
            assert (got[0]["matched"] if got else 0) == want


def test_one_word_over_and_over():
    passages = d.Passages([(1, "la " * 200), (2, "la la la la lo")], 5, 0.5)
    tracemalloc.start()
    got = passages.find(["la " * 400_000])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [{"item_id": 1, "matched": 200, "words": 200, "tiles": 1}] and peak < 500e6


def test_short_items_ties_and_null_ids():
    passages = d.Passages([(1, "one two"), (None, "three"), (3, "a b c d e f"), (4, "a b c d e f"), (5, "")], 5, 0.5)
    got = [[x["item_id"] for x in found] for found in passages.find(["one two", "two one", "(Three!)", "x a b c d e f", "", None])]
    assert got == [[1], [], [None], [3, 4], [], []]


def test_reordered_and_marked_passages(spark):
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(5000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(40))) for k in range(30)] + [(100, "too short item"), (101, None), (None, "no id here at all")]
    w = items[3][1].split()
    filler = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    docs = [
        (1, f"{filler()} {' '.join(w[20:])} {filler()} {' '.join(w[:20])} {filler()}"),  # moved about
        (2, f"{filler()}\n{items[5][1].upper().replace(' ', '!! ')} {filler()}"),
        (3, f"{filler()} {' '.join(items[6][1].split()[:18])} {filler()}"),  # under half
        (4, None), (5, ""), (6, filler() + " too short item"), (None, items[7][1]), (1, items[7][1]), (8, (items[8][1] + " ") * 2000),
    ]
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_chars in (8_000_000, 600):
        got = [(r.doc_id, [x.item_id for x in r.leaks]) for r in d.leaks(frame, bench, block_chars=block_chars).collect()]
        want = [(1, [3]), (2, [5]), (3, []), (4, []), (5, []), (6, [100]), (None, [7]), (1, [7]), (8, [8])]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert [r.leaks for r in d.leaks(frame, bench.limit(0)).collect()] == [[]] * len(docs)
    assert d.leaks(frame.limit(0), bench).count() == 0


def test_verbatim_passages_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, x.item_id) for r in d.leaks(docs, bench).collect() for x in r.leaks}
    want = {(a.doc_id, b.item_id) for a in docs.collect() for b in bench.collect() if b.text in a.text}
    assert want and want <= got and len(got) < 3 * len(want)
