import random

import pytest

import corpus_pipeline
from tidemill.llm.common import written

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, key string, text_key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder whose every row has a known fate."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "mi", "st")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels, fate = [], [], {}
    for i in range(120):
        toxic = i % 3 == 0
        w = prose(80).split()
        if toxic:
            for k in range(0, 80, 9):
                w[k] = rng.choice(("vileword", "vilething", "vilemost"))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
        fate[i] = "toxic" if toxic else "kept"
    items = [(k, prose(40)) for k in range(5)]
    base = prose(200)
    near = base.split()
    near[50] = "changed"
    rows += [(200, base), (201, base), (202, " ".join(near)), (200, base)]
    fate |= {200: "kept", 201: "copy", 202: "copy"}
    moved = items[2][1].split()
    rows += [(300, f"{prose(60)} {' '.join(moved[20:])} {prose(30)} {' '.join(moved[:20])}"), (301, prose(50) + " mail me@home.org or +1 (555) 555-0199"), (302, None), (303, ""), (None, prose(30)), (None, prose(30))]
    fate |= {300: "leak", 301: "kept", 302: "kept", 303: "kept"}
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, None, "s", 1, "k", "t") for i, t in rows], DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, fate


def test_stages(spark, folder):
    path, rows, fate = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, path), name)
        assert docs.columns == columns
        counts.append(docs.count())
    kept = sorted((r.doc_id for r in docs.collect() if r.doc_id is not None))
    assert kept == sorted(i for i, f in fate.items() if f == "kept")
    assert sum(r.doc_id is None for r in docs.collect()) == 2
    assert counts == [len(rows) - 40, len(rows) - 43, len(rows) - 44, len(rows) - 44]
    (r,) = docs.where("doc_id = 301").collect()
    assert r.text.endswith(" mail <EMAIL> or <PHONE>") and r.n_chars == len(r.text)
    found = corpus_pipeline.run(spark, path).collect()
    assert sorted({r.doc_id for r in found if r.doc_id is not None}) == kept and {r["rank"] for r in found} == {0, 1}


def test_empty(spark, folder, tmp_path):
    path, _, _ = folder
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
