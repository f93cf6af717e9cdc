import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import quality_rules as q
from tidemill.llm.common import words

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x1cé|#😀", max_size=80))
def test_base_counts_equal_brute_force(text):
    assert q.statistics([text, "between", text])[:, :5].tolist() == [brute(text), [1, 7, 0, 0, 0], brute(text)]
    assert words(text) == re.findall(r"[^\x20\x09-\x0D]+", text)


def features(text):
    """The features by the words of their names, one text at a time."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars, symbols, dup, repeat = brute(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    per, letters = 1 / max(n, 1), max(chars, 1)
    return [
        np.log1p(n), chars * per, symbols * per, dup / max(len(lines), 1), repeat * per, sum(a == b for a, b in zip(w, w[1:])) * per, sum(c.isupper() for c in text) / letters,
        sum(c in "0123456789" for c in text) / letters, text.count("!!") * per, len(set(w)) * per, sum(c in ".,;:?" for c in text) * per, n / max(len(lines), 1),
    ]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t!?.7É|é😀Ⅷ", max_size=60)), max_size=5))
def test_features_equal_brute_force(texts):
    assert np.allclose(q.statistics(texts), np.array([[*brute(t), *features(t)] for t in texts], dtype=float).reshape(len(texts), 17), rtol=1e-12, atol=0)


def test_trees_keep_signs_and_learn():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 3))
    y = (x[:, 0] - 2 * x[:, 1] + 0.3 * rng.normal(size=3000) > 0).astype(float)
    trees = q.grow(x, y, [0, -1, 1])
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.93
    for f, sign in ((1, -1), (2, 1)):
        line = np.repeat(rng.normal(size=(50, 3)), 40, axis=0).reshape(50, 40, 3)
        line[:, :, f] = np.linspace(-3, 3, 40)
        assert (sign * np.diff(trees.raw(line.reshape(-1, 3)).reshape(50, 40), axis=1) >= -1e-9).all()
    assert len(q.grow(x[:5], np.ones(5), [0, 0, 0]).probability(x)) == 3000


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = q.judged(docs, labels, held_out=(3, 1)).join(labels.withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    from tidemill.llm.common import fold

    out = got[[fold(i, 3) == 1 for i in got.doc_id]]
    assert ((out.quality >= 0.5) == out.truth).mean() > 0.95


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "one " * 50, 5), (2, "one " * 50, 5), (3, "x" * 100_000, 6)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = q.judged(docs, labels).collect()
    assert len(got) == 5 and not any(r.kept for r in got)
    assert q.judged(docs.limit(0), labels).count() == 0
