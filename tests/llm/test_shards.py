import zlib
from collections import defaultdict

import pytest

from tidemill.llm import shards
from tidemill.llm.shards import shuffled_shards

ROWS = [(i, f"text {i % 7}") for i in range(100)] + [(None, "no id"), (5, None), (5, ""), (3, "dup"), (3, "dup"), (9, "ß" * 50_000)]


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 400])
def test_all_rows_once_and_counts_even(spark, bucket_bytes):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, shard int, size string")
    got = shuffled_shards(docs, shards=16, bucket_bytes=bucket_bytes).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text or "", r.text is None) for r in got) == sorted((i is None, i, t or "", t is None) for i, t in ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r["size"] == len((r.text or "").encode()) + 1
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order, key=lambda x: (x is None, x))


def test_same_seed_same_order_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    first, again, other = (sorted(map(tuple, shuffled_shards(docs.repartition(n), bucket_bytes=2000, seed=s).select("doc_id", "text", "shard", "slot").collect()), key=str) for n, s in ((1, 1), (3, 1), (1, 2)))
    assert first == again != other
    assert shuffled_shards(docs.limit(0)).collect() == []


def test_fewer_rows_than_shards(spark):
    got = shuffled_shards(spark.createDataFrame(ROWS[:3], "doc_id long, text string")).collect()
    assert len(got) == 3 and len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)


def test_copies_larger_than_a_bucket_fall_into_many(spark, monkeypatch):
    """A third of the rows agree in id and text: the first and last places of the order hold some of them, whatever the input's parts."""
    monkeypatch.setattr("tidemill.llm.shards.COPIES", 64)
    rows = [(i, f"text {i}") for i in range(1000)] + [(None, None)] * 500 + [(7, "copy")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, again = (shuffled_shards(docs.repartition(n), bucket_bytes=400).collect() for n in (2, 5))
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    for key in ((None, None), (7, "copy")):
        held = [sum((r.doc_id, r.text) == key for r in got if r.shard == s) for s in range(16)]
        assert min(held) > 0 and max(held) < 100
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_buckets_keep_their_size_beyond_the_first_cells(spark, monkeypatch):
    """Few cells to begin with: they are counted again in more of them, and no bucket holds twice what it should."""
    monkeypatch.setattr("tidemill.llm.shards.CELLS", 16)
    monkeypatch.setattr("tidemill.llm.shards.SMALL", 8)  # and their places are joined by a shuffle
    rows = [(i, "x" * (60 + i % 80)) for i in range(4_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["sum(size)"] for r in shards._scattered(docs, 1, 20_000)[0].groupBy("bucket").sum("size").collect()]
    assert len(sizes) > 15 and max(sizes) < 2 * 20_000
    got = shuffled_shards(docs, bucket_bytes=20_000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == rows and len({(r.shard, r.slot) for r in got}) == 4_000
