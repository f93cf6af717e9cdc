import itertools

import numpy as np

from tidemill.llm import line_crf as c
from tidemill.llm.common import fold

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([1, 4, 3, 6])
    x = rng.normal(size=(counts.sum(), 5))
    crf = c.Crf(rng.normal(size=5), rng.normal(size=(2, 2)))
    p, moves = crf.marginals(x, counts)
    want_moves, at = np.zeros((2, 2)), 0
    for n in counts:
        u = x[at : at + n] @ crf.weights
        total, bad, steps = 0.0, np.zeros(n), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[i] * s[i] for i in range(n)) + sum(crf.moves[a, b] for a, b in zip(s, s[1:])))
            total += w
            bad += w * np.array(s)
            for a, b in zip(s, s[1:]):
                steps[a, b] += w
        assert np.allclose(p[at : at + n], bad / total)
        want_moves += steps / total
        at += n
    assert np.allclose(moves, want_moves)


def test_line_features_see_their_own_lines():
    texts = ["AB!! c\n\nAB!! c", "", "é1\n"]
    f, weight, counts = c.line_features(texts)
    assert counts.tolist() == [3, 1, 2] and weight.tolist() == [7, 1, 7, 1, 3, 1]
    for i, line in enumerate("\n".join(texts[:1]).split("\n")):
        own = c.line_features([line])[0][0]
        assert np.allclose(np.delete(f[i], 15), np.delete(own, 15))
    assert f[2, 15] == 1 and f[0, 15] == 0
    near = c.with_neighbours(f, counts)
    assert np.allclose(near[1, c.N_LINE : 2 * c.N_LINE], f[0]) and not near[0, c.N_LINE : 2 * c.N_LINE].any() and not near[3, c.N_LINE :].any()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = c.scored(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert set(out.doc_id) == {i for i in got.doc_id if fold(i, 3) == 1}
    bad = out[out.quality == 0]
    print((out.predicted == out.quality).mean(), (bad.predicted == 0).mean())
    assert (out.predicted == out.quality).mean() > 0.95 and (bad.predicted == 0).mean() > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "one " * 50, 5), (2, "one " * 50, 5), (3, "x\n" * 50_000, 6)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = c.scored(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert c.scored(docs.limit(0), labels).count() == 0
