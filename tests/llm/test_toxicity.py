import numpy as np

from tidemill.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


def test_gradients_equal_differences():
    net = tox.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    vocabulary = ["", "ab", "über", "cde", "x"]
    at = rng.integers(0, 5, (4, tox.WINDOW))
    mask = (np.arange(tox.WINDOW) < np.array([[3], [64], [1], [10]])).astype(np.float64)
    y, weight = np.array([1.0, 0, 1, 0]), np.array([0.1, 0.4, 0.2, 0.3])
    _, g = net.gradients(vocabulary, at, mask, y, weight)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for i in np.argsort(-np.abs(g[k].reshape(-1)))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = net.gradients(vocabulary, at, mask, y, weight)[0]
            flat[i] = old - 1e-3
            down = net.gradients(vocabulary, at, mask, y, weight)[0]
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[k].reshape(-1)[i]) < 2e-4 + 0.03 * abs(g[k].reshape(-1)[i]), k


def test_windows_cover_all_words_and_overlap():
    first, size, doc = tox.windows(np.array([0, 1, 64, 65, 1000]))
    assert (doc == 0).sum() == (doc == 1).sum() == (doc == 2).sum() == 1 and size[0] == 0
    own = doc == 4
    covered = {i for f, n in zip(first[own], size[own]) for i in range(f, f + n)}
    assert covered == set(range(130, 1130)) and (size[own][:-1] == 64).all() and (np.diff(first[own]) == tox.STRIDE).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = tox.held_out_scores(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    toxic = out.toxic == 1
    print("recall", (out.predicted[toxic] == 1).mean(), "false alarms", (out.predicted[~toxic] == 1).mean(), len(out))
    assert (out.predicted[toxic] == 1).mean() > 0.7 and (out.predicted[~toxic] == 1).mean() < 0.03  # some 300 toxic documents to learn from


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (None, "", 4), (2, "one " * 50, 5), (2, "one " * 50, 5), (3, "x " * 50_000, 6)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    got = tox.held_out_scores(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert tox.held_out_scores(docs.limit(0), labels).count() == 0
