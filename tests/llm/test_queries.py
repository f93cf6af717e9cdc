"""The registered queries over a small folder, held against plain Python column by column."""

import hashlib
import math
import re
import struct
from collections import Counter
from zlib import crc32

import pandas as pd
import pytest

from tests.llm.test_collocations import plain as phrases
from tests.llm.test_lexical_search import plain as ranked
from tests.llm.test_lexical_search import rows as ranks
from tests.llm.test_ngram_join import brute as shingle_sets
from tests.llm.test_ngram_join import components
from tests.llm.test_pii import BASE
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_quality_rules import brute as statistics
from tests.llm.test_simhash import linked
from tests.llm.test_simhash import plain as print_of
from tidemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
EDGES = [
    None, "", " \n\t", "a", "One two", "one TWO", "é😀 ▁ \x1e x", "same line\nsame line\n\nsame line", "w " * 3_000, "z" * 30_000, "# * $ % & | < >",
    "mail a@b.com, 1.2.3.4, 4111 1111 1111 1111 and +1 (988) 555-2485", "mail a@b.com, 1.2.3.4, 4111 1111 1111 1111 and +1 (988) 555-2485", "the " * 12 + "end",
]
#: Names that operators use themselves, as columns of the table.
CLASHES = ("print", "component", "phrase", "word", "key", "item", "rank", "row", "text_key", "part", "sig", "set_id", "score", "toxicity", "kept", "label", "quality", "root", "start", "salt", "bucket", "size", "n", "row_key", "hits")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """All documents of the smallest table, edge cases behind them, and columns with clashing names."""
    path = tmp_path_factory.mktemp("queries")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    first = int(docs["doc_id"].max()) + 1
    docs = pd.concat([docs, pd.DataFrame({"doc_id": range(first, first + len(EDGES)), "text": EDGES})], ignore_index=True)
    docs = docs.assign(n_chars=docs["n_chars"].astype("Int64"), **{c: "clash" for c in CLASHES})
    docs.sample(frac=1, random_state=3).to_parquet(path / "documents.parquet")
    for name in ("labels", "benchmark"):
        pd.read_parquet(f"{SF}/{name}.parquet").to_parquet(path / f"{name}.parquet")
    return str(path), dict(zip(docs["doc_id"].tolist(), (t if isinstance(t, str) else None for t in docs["text"])))


def result(spark, folder, name):
    rows = QUERIES[name](spark, folder[0]).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(found) == len(folder[1]) and set(found) == set(folder[1])
    return found


def fold(doc_id, n):
    return crc32(str(doc_id).encode()) % n


def test_op1(spark, folder):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = result(spark, folder, "op1_token_store"), 0
    for i in sorted(folder[1]):
        ids = [*library.encode(folder[1][i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc32(struct.pack(f"<{len(ids)}I", *ids))), i
        start += len(ids)


def test_op2(spark, folder):
    rows = QUERIES["op2_gumbel_pieces"](spark, folder[0]).collect()
    assert {r.doc_id for r in rows if r["rank"] == 0} == set(folder[1]) and len({(r.doc_id, r["rank"]) for r in rows}) == len(rows)
    for r in rows:
        assert r.decoded_crc32 == crc32((folder[1][r.doc_id] or "").encode()) and r.log_probability <= 0
        assert -math.inf < r.log_inclusion <= 0 and math.isclose(r.inclusion, math.exp(r.log_inclusion), rel_tol=1e-9, abs_tol=1e-300)
    assert len({(r.doc_id, r.ids_hash) for r in rows}) == len(rows)


def test_op4(spark, folder):
    for i, r in result(spark, folder, "op4_quality_rules").items():
        want = statistics(folder[1][i])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == want, i
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)


def test_op5(spark, folder):
    got = result(spark, folder, "op5_two_pass_shards")
    slots = {k: sorted(r.slot for r in got.values() if r.shard == k) for k in range(16)}
    assert all(s == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for i, r in got.items():
        raw = (folder[1][i] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, crc32(raw), "rows", None)


def test_op6(spark, folder):
    ids = list(folder[1])
    sets = shingle_sets([folder[1][i] for i in ids])
    label = dict(zip(ids, components(ids, sets)))
    for (i, r), s in zip(sorted(result(spark, folder, "op6_ngram_join").items()), (s for _, s in sorted(zip(ids, sets), key=lambda x: x[0]))):
        assert (r.n_shingles, r.component_id) == (len(s), label[i]), i


@pytest.mark.parametrize("name, folds, rest", [("op7_toxicity", 5, 0), ("op9_line_crf", 3, 1)])
def test_op7_op9(spark, folder, name, folds, rest):
    got = result(spark, folder, name)
    for i, r in got.items():
        assert r.held_out == (fold(i, folds) == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    twins = [r.score for i, r in got.items() if folder[1][i] == EDGES[-3]]
    assert len(twins) > 1 and math.isclose(min(twins), max(twins), abs_tol=1e-6)  # equal texts score alike


def test_op8(spark, folder):
    for i, r in result(spark, folder, "op8_context_pii").items():
        want = base_spans(folder[1][i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("context")] == want


def test_op10(spark, folder):
    tokens = {i: re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) + [None] for i, t in folder[1].items()}
    counts = Counter(w for i, ws in tokens.items() if fold(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, r in result(spark, folder, "op10_pitman_yor").items():
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 10) == 0, len(tokens[i]), sum(counts[w] > 0 for w in tokens[i]), n)
        assert math.isclose(r.base_score, want, rel_tol=1e-9) and r.score < 0


def test_op11(spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder[0]}/benchmark.parquet").collect()]
    assert ranks(QUERIES["op11_lexical_search"](spark, folder[0])) == ranked(list(folder[1].items()), items)


def test_op12(spark, folder):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder[0]}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op12_phrase_tries"](spark, folder[0]).collect()
    want = phrases([(langs[i], t) for i, t in folder[1].items()], 100, 2_000)
    assert sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == want and {r.lang for r in got} >= {"en", "und"}


def test_op13(spark, folder):
    ids = sorted(folder[1])
    prints = [print_of(folder[1][i]) for i in ids]
    want = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, linked(prints, 4))}  # of ascending ids, the first reached is the smallest
    assert {i: (r.fingerprint, r.component_id) for i, r in result(spark, folder, "op13_simhash_trees").items()} == want
