"""Ranked search against a plain definition over all documents, and bounds against exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import same
from tidemill.llm import lexical_search
from tidemill.llm.lexical_search import Questions, _block, search, signatures
from tidemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, length = len(counts), sum(s for _, _, s in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(terms(text)), []
        for i, c, s in counts:
            m = 25 + (75 * s * n) // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


EDGES = [None, "", " .,;", "a", "A a a", "é😀 x1 ▁", "the-the_the", "same text here", "same text here", "Same TEXT here", "word " * 3_000, "z" * 20_000, "x\x00y\x7fz"]


@pytest.mark.parametrize("block_chars", [1_000_000, 200])
def test_edges(spark, block_chars):
    rng = random.Random(1)
    docs = [(i, t, "clash") for i, t in enumerate(EDGES)] + [(None, "same text here", "clash")] * 2 + [(7, "same text here", "clash")]
    docs += [(100 + i, " ".join(rng.choices(["the", "same", "word", "x1", "zeta", "eta", "a"], k=rng.randrange(1, 60))), "clash") for i in range(60)]
    items = [(0, "same text"), (1, "The the WORD word"), (2, None), (3, ""), (4, "unknown terms"), (None, "x1 é😀"), (0, "same text"), (5, "a zeta " * 40), (6, "z" * 20_000)]
    got = search(spark.createDataFrame(docs, "doc_id long, text string, key string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=block_chars)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == plain([d[:2] for d in docs], items)


def test_joined_by_shuffles(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SMALL", 0)
    docs = [(i, f"common w{i % 7} w{i % 11}") for i in range(200)]
    items = [(1, "w3 w5"), (2, "common")]
    assert rows(search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark"))
    assert rows(search(docs, items)) == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_query_and_its_sql(spark):
    same(QUERIES["op11_lexical_search"](spark, SF), SF, ORACLES["op11_lexical_search"])


def test_bounds_hold_and_are_near(spark):
    """No bound is below its exact score, and the sum of bounds isn't far above it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, items = [r.text for r in docs.collect()], [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    key = {r.key: n for n, r in enumerate(docs.select(lexical_search.row_key("doc_id", "text").alias("key")).collect())}
    asked = Questions(items)
    held = [Counter(terms(t)) for t in texts]
    found = {-1: sum(map(bool, held)), -2: sum(sum(c.values()) for c in held)}
    asked.learn(found | {n: sum(t in c for c in held) for n, t in enumerate(asked.terms.to_pylist())})
    exact = np.zeros((len(items), len(texts)))
    for t, i, score in asked.exact(pa.array(texts), [list(range(len(items)))] * len(texts)):
        exact[i, t] = score
    bound = np.zeros_like(exact)
    for batch in signatures(docs).toArrow().to_batches():
        for block in _block(batch):
            bound[:, [key[k] for k in np.frombuffer(block["keys"], dtype=np.int64).tolist()]] = asked.bounds(block)
    assert (bound >= exact).all() and bound.sum() < 1.25 * exact.sum()


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search(none, items).collect() == []
    assert search(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).collect() == []
