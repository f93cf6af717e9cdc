import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
BASE = " ".join(f"word{i * 7919 % 1000} the" for i in range(3000))
TEXTS = [None, "", " \n ", "Don't STOP <|endoftext|>a<|endoftext|>", "x☆y ☆ é ½x\x1cy z á\ńb İ ΑΣ", BASE, BASE, "new start " + BASE, "q" * 30_000, "😀 " * 500, "tab\tand\x0bfeed\x0c"]


@pytest.fixture(scope="module")
def want():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in TEXTS]


def test_word_encoder_equals_library(want):
    encoder = ts.WordEncoder(PATH, 2)
    for _ in range(2):
        ids, counts = encoder.encode(TEXTS)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_store_round_trip(spark, want, tmp_path):
    rows = [(i * 3 if i else None, t, 5) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string, start int").repartition(3)
    got = sorted(ts.stored_documents(docs, PATH, path=f"file://{tmp_path}/store").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i * 3 if i else None for i in range(len(TEXTS))]
    start = 0
    for r, ids in zip(got, want):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    back = sorted(ts.read_documents(spark, f"file://{tmp_path}/store").collect(), key=lambda r: r.start)
    assert [r.ids for r in back] == want
    chunks = spark.read.parquet(f"file://{tmp_path}/store/chunks").collect()
    held = sum(r.n for r in chunks)
    assert len({bytes(r.digest) for r in chunks}) == len(chunks)
    assert held < sum(map(len, want)) - 1.7 * len(want[5])  # the exact copy and most of the shifted one are not kept again


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([(1, BASE)], "doc_id long, text string"), path, PATH)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    bad = [(r.digest, r.n, bytes(r.ids)[::-1] if i == 0 else bytes(r.ids)) for i, r in enumerate(chunks)]
    spark.createDataFrame(bad, "digest binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="digest"):
        ts.verified_documents(spark, path).collect()
    spark.createDataFrame([(r.digest, r.n, r.ids) for r in chunks[1:]], "digest binary, n int, ids binary").write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="missing"):
        ts.verified_documents(spark, path).collect()


def test_a_lost_recipe_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    ts.write_store(spark.createDataFrame([(1, BASE), (2, "a b"), (3, None)], "doc_id long, text string"), path, PATH)
    assert ts.verified_documents(spark, path).count() == 3
    recipes = spark.read.parquet(f"{path}/recipes")
    kept = spark.createDataFrame([r for r in recipes.collect() if r.doc_id != 2], recipes.schema)
    kept.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        ts.verified_documents(spark, path)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c")], "doc_id long, text string")
    assert sorted(r.start for r in ts.stored_documents(docs, PATH).collect()) [0] == 0
    assert ts.stored_documents(docs, PATH).count() == 3
    assert ts.stored_documents(docs.limit(0), PATH).count() == 0


def test_equal_rows_fall_into_many_parts(spark, tmp_path):
    import public_tokenizers

    from tidemill.llm.token_store import write_store

    docs = spark.createDataFrame([(None, "the same text")] * 3000 + [(1, "one")], "doc_id long, text string").repartition(3)
    write_store(docs, str(tmp_path / "store"), public_tokenizers.path("word_bpe_49k.json"), docs_per_part=300)
    parts = [r.n_docs for r in spark.read.parquet(str(tmp_path / "store" / "manifest")).collect()]
    assert sum(parts) == 3001 and max(parts) < 900
    starts = [(r.start, r.n_tokens) for r in spark.read.parquet(str(tmp_path / "store" / "recipes")).orderBy("start").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
