"""Phrases and scores against a plain definition; the double array against a dictionary."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tests.compare import same
from tidemill.llm import collocations as module
from tidemill.llm.collocations import Texts, Trie, collocations, phrase_counts
from tidemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def pieces(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", text)]


def counts(docs):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in docs:
        for ws in pieces(text):
            n[lang or "und"] += len(ws)
            for k in range(1, 6):
                f[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return n, f


def plain(docs, least, top):
    n, f = counts(docs)
    out = []
    for lang, c in f.items():
        wide = {p for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q for p in wide for k in range(2, len(p)) for i in range(len(p) - k + 1) if c[q := p[i : i + k]] <= c[p]}
        ranked = []
        for p in wide - inside:
            score, _, l, r = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -c[p], " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, n[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def made(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "é😀", "x-y", "New", "York", "City", "hall", "z"]
    docs = [(None, None), ("en", ""), ("en", " \t\n"), ("en", "One"), ("und", "the of the of"), ("en", "the the the the the the the"), ("de", "a.b"), ("en", "z " * 4_000)]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(1, 40))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = ["New", "York", "City", "hall"]
        docs.append((rng.choice(["en", "de", None, "und"]), "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; "]) for w in words)))
    return docs


def rows(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("least, top, trie_phrases, set_bits, tries", [(5, 50, 1 << 18, 1 << 26, 16), (3, 2_000, 40, 1 << 26, 16), (3, 2_000, 40, 1 << 26, 2), (4, 2_000, 1 << 18, 64, 16)])
def test_phrases(spark, monkeypatch, least, top, trie_phrases, set_bits, tries):
    """Also with many tries, with more candidates than all tries take, and with sets so small that they let every pair through."""
    monkeypatch.setattr(module, "TRIES", tries)
    docs = made()
    table = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "lang string, text string, phrase string, n string").repartition(5)
    assert rows(collocations(table, least=least, top=top, trie_phrases=trie_phrases, set_bits=set_bits)) == plain(docs, least, top)


def test_all_frequent_phrases_are_counted(spark):
    docs = made(2, 60)
    totals, counted = phrase_counts(spark.createDataFrame([(lang or "und", t) for lang, t in docs], "lang string, text string"), 3)
    n, f = counts(docs)
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}
    assert {(r.lang, r.phrase): r.n for r in counted.collect()} == {(lang, " ".join(p)): a for lang, c in f.items() for p, a in c.items() if a >= 3}


def test_trie():
    rng = random.Random(3)
    phrases = sorted({(rng.choice(["en", "de"]), " ".join(rng.choices("abcdefghijkl", k=rng.randrange(1, 6)))) for _ in range(900)}, key=lambda _: rng.random())
    trie = Trie(phrases)
    docs = [(rng.choice(["en", "de", "fr"]), " ".join(rng.choices("abcdefghijklm.", k=300))) for _ in range(20)]
    _, f = counts(docs)
    got = trie.count(Texts(pa.array([lang for lang, _ in docs]), pa.array([t for _, t in docs])))
    assert got.tolist() == [f[lang][tuple(p.split(" "))] for lang, p in phrases]


def test_trie_of_one_phrase():
    trie = Trie([("en", "a b")])
    assert trie.count(Texts(pa.array(["en", "de"]), pa.array(["a b a b. a, b", "a b"]))).tolist() == [2]
    assert trie.count(Texts(pa.array([], pa.string()), pa.array([], pa.string()))).tolist() == [0]


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([("en", "a b c")], "lang string, text string")).collect() == []


def test_query_and_its_sql(spark):
    same(QUERIES["op12_phrase_tries"](spark, SF), SF, ORACLES["op12_phrase_tries"])
