import math
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import pitman_yor as py
from tidemill.llm.common import fold

LAYOUT = py.Layout(8, 40)
SF = "/root/testdata/sf0.01"


def brute(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")), None] for _, t in rows]
    counts = Counter(w for (i, _), ws in zip(rows, tokens) if fold(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(fold(i, 10) == 0, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _), ws in zip(rows, tokens)]


def test_base_equals_brute_force_and_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(py, "CHUNK_CHARS", 300_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "Null Id"), (5000, None), (5001, ""), (5002, "Zzz! unknown\x0bwords"), (5003, "same row"), (5003, "same row")], docs.schema)
    rows = docs.union(extra)
    got = sorted(py.scored(rows.withColumn("count", rows["doc_id"]).repartition(3)).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.score))
    all_rows = sorted([(r.doc_id, r.text) for r in rows.collect()], key=lambda r: (r[0] is None, r[0]))
    assert len(got) == len(all_rows)
    for r, want, (i, _) in zip(got, brute(all_rows), all_rows):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, *want[:4])
        assert abs(r.base_score - want[4]) < 1e-6 * abs(want[4]) + 1e-9
    out = [r for r in got if r.held_out]
    model, base = (sum(getattr(r, k) for r in out) / sum(r.n_tokens for r in out) for k in ("score", "base_score"))
    print("log10 a token", model, base)
    assert model > base


def test_distribution_sums_to_one():
    rng = np.random.default_rng(0)
    words = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    row = np.repeat(np.arange(300), 3)
    context = np.tile([1, 4, 7], 300)
    customers = rng.zipf(1.6, 900).clip(max=5000)
    base = py.Totals(np.bincount(context, customers, py.CLASSES).astype(float), np.bincount(context, minlength=py.CLASSES).astype(float), 300.0, 300, int(customers.sum()), 0.7, 0.5)
    for tables, below, root in py.sweeps(words, row, context, customers, base, 1, 2):
        assert (tables >= 1).all() and (tables <= customers).all() and (root >= 1).all() and (root <= below).all()
        t = py.Totals(base.customers, np.bincount(context, tables, py.CLASSES), float(root.sum()), 300, base.tokens, 0.7, 0.5)
        parent = (below - t.root_discount * root + (t.strength + t.root_discount * t.root) / 301) / (t.strength + t.tables.sum())
        assert abs(parent.sum() + t.unseen() - 1) < 1e-9
        for k in (1, 4, 7):
            own = (customers - t.discount * tables)[context == k] + t.spare()[k] * parent
            assert abs((own.sum() + t.spare()[k] * t.unseen()) / (t.strength + t.customers[k]) - 1) < 1e-9


def weights(c, mass, d):
    """The chances of 1 to c tables by the recurrence of the generalised Stirling numbers."""
    logs = np.full(c + 1, -np.inf)
    logs[1] = 0
    for n in range(1, c):
        t, new = np.arange(1, n + 2), np.full(c + 1, -np.inf)
        with np.errstate(divide="ignore"):
            new[1 : n + 2] = np.logaddexp(logs[t - 1], logs[t] + np.log(np.maximum(n - d * t, 1e-300)))
        logs = new
    p = logs + np.arange(c + 1) * math.log(mass)
    p = np.exp(p - p.max())
    return p / p.sum()


def drawn(c, mass, d, n=40_000):
    key = np.arange(n, dtype=np.uint64) * np.uint64(977)
    return py.draw_tables(np.full(n, c), np.full(n, float(mass)), d, key, 3)


@pytest.mark.parametrize("c, mass, d", [(2, 0.8, 0.6), (5, 0.8, 0.6), (5, 50, 0.9), (25, 5, 0.8), (30, 100, 0.3)])
def test_tables_follow_their_exact_conditional(c, mass, d):
    got = np.bincount(drawn(c, mass, d), minlength=c + 1) / 40_000
    assert np.abs(got - weights(c, mass, d)).max() < 0.01


@pytest.mark.parametrize("c", [100, 400, 5_000])
@pytest.mark.parametrize("mass, d", [(5, 0.5), (5, 0.8), (50, 0.8), (50, 0.5), (20, 0.3), (300, 0.95), (2_000, 0.5), (0.01, 0.1), (100_000, 0.2)])
def test_mean_and_spread_at_any_count(c, mass, d):
    p, got = weights(c, mass, d), drawn(c, mass, d)
    mean = (p * np.arange(c + 1)).sum()
    spread = math.sqrt((p * (np.arange(c + 1) - mean) ** 2).sum())
    assert abs(got.mean() - mean) < 0.01 * mean and abs(got.std() - spread) < 0.05 * spread
    assert got.min() >= 1 and got.max() <= c


def test_no_bound_on_customers():
    """Far above the rows kept one by one, tables come to one and a Poisson number of mean mass / discount."""
    for c in (10**6, 10**12, 10**15):
        got = drawn(c, 5, 0.8)
        assert abs(got.mean() - 7.25) < 0.1 and abs(got.std() - 2.5) < 0.1


def test_nothing_learnt_and_empty(spark):
    held = next(i for i in range(1000) if fold(i, 10) == 0)
    docs = spark.createDataFrame([(held, "two words")], "doc_id long, text string")
    (r,) = py.scored(docs).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == pytest.approx(0) and r.score == pytest.approx(0)
    assert py.scored(docs.limit(0)).count() == 0


def test_word_before_counts_within_its_class(spark):
    """Words before of one class (same last two letters) have followers of their own."""
    taught, held = ([i for i in range(2000) if (fold(i, 10) == 0) == h] for h in (False, True))
    rows = [(i, "bald gold" if i % 2 else "mild silver") for i in taught[:400]]
    rows += [(held[0], "bald gold"), (held[1], "bald silver"), (held[2], "mild gold"), (held[3], "mild silver")]
    got = {r.doc_id: r.score for r in py.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out}
    assert got[held[0]] > got[held[1]] + 1 and got[held[3]] > got[held[2]] + 1


def test_word_restaurants_sum_to_one():
    """The chunk's formula over all words: seated pairs less the discount, and the spare's share of the class."""
    rng = np.random.default_rng(1)
    words = np.sort(rng.integers(1, 1 << 62, 200).astype(np.uint64))
    names = LAYOUT.named(rng.integers(1, 1 << 40, 6).astype(np.uint64), np.array([1, 1, 2, 2, 3, 3]))
    listed = [(w, k) for w in range(200) for k in rng.choice(6, 3, replace=False)]
    w, k = (np.array(x) for x in zip(*sorted(listed, key=lambda x: (x[0], names[x[1]]))))
    customers = 2 + rng.zipf(1.7, len(w)).clip(max=300)
    classes, cell = np.unique(w * py.CLASSES + (names[k] >> np.uint64(LAYOUT.bits)).astype(np.int64), return_inverse=True)
    table = py.Table(words, classes // py.CLASSES, classes % py.CLASSES, np.zeros(len(classes), dtype=np.int64), cell, names[k], customers, np.bincount(k, minlength=6)[k])
    start = py.Totals(np.bincount(table.context, np.bincount(cell), py.CLASSES), np.bincount(table.context, minlength=py.CLASSES), 200.0, 200, int(customers.sum()), 0.6, 0.5, pair_discount=0.7)
    for pairs, seated, tables, below, root in table.sweeps(start, 1, 2):
        assert (pairs >= 1).all() and (pairs <= customers).all() and (tables <= seated).all() and (root <= below).all()
        t = py.Totals(np.bincount(table.context, seated, py.CLASSES), np.bincount(table.context, tables, py.CLASSES), float(root.sum()), 200, start.tokens, 0.6, 0.5)
        parent = (below - t.root_discount * root + (t.strength + t.root_discount * t.root) / 201) / (t.strength + t.tables.sum())
        for r in range(6):
            kind = int(names[r] >> np.uint64(LAYOUT.bits))
            of_class = t.spare()[kind] * np.append(parent, t.unseen())
            at = table.context == kind
            of_class[table.row[at]] += (seated - t.discount * tables)[at]
            of_class /= t.strength + t.customers[kind]
            own = np.bincount(w[k == r], (customers - 0.7 * pairs)[k == r], 201) + (1 + 0.7 * pairs[k == r].sum()) * of_class
            assert abs(own.sum() / (1 + customers[k == r].sum()) - 1) < 1e-9
