import hashlib
import re

from tidemill.llm.pii import find_pii, joined, redact
from tidemill.llm.queries import _pii_columns

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


TEXTS = [
    None, "", "a@b.com.x@y.com_d@e.f a@b.c.", "ß 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.0255 é😀 4111 1111 1111 1111, 4111111111111112",
    "+1 (988) 555-2485. +1 (9 x +44 20 7946 0018 5", "x@y @z a@b. a@-.-", "1" * 60_000, "a" * 60_000 + "@b.c", "9 " * 30_000, "me@x.org " * 2_000,
    "4111-1111-1111-1111 +4111111111111111", "hi.5@mail.com", "hi.5@mail.com", "..@..@a.b.c-d..e 0.0.0.0 256.1.1.1.1",
]


def test_base_spans_equal_brute_force(spark):
    docs = spark.createDataFrame([(i if i else None, t, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, kind string")
    got = _pii_columns(find_pii(docs)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute(TEXTS[r.doc_id or 0])
        assert r.spans.split(",") == want or (r.spans == "" and not want), r.doc_id
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in BASE]
    assert _pii_columns(find_pii(docs.limit(0))).collect() == []


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"Please note my contact is user{i}@mail.org for now") for i in range(8)]
    rows += [(100, "Well my contact is zq-4471-9920 ok"), (101, "the build used part zq-8888-1111 ok"), (102, "Well my contact is zq-4471-9920 ok")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.all for r in find_pii(docs).select("doc_id", joined("added").alias("all")).collect()}
    assert got[100] == got[102] == "context:19:31" and got[101] == "" and got[0] == ""


def test_redaction_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, 1.2.3.4!", "x"), (2, None, "y"), (3, "plain", "z"), (1, "é a@b.co, 1.2.3.4!", "x"), (4, "+4111111111111111 ok", "w")], "doc_id long, text string, row string")
    got = redact(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(
        [(1, "é <EMAIL>, <IP>!", "x"), (2, None, "y"), (3, "plain", "z"), (1, "é <EMAIL>, <IP>!", "x"), (4, "+<CARD> ok", "w")], docs.schema).collect()))


def test_places_of_very_many_matches(spark):
    """Places are summed in blocks; a text with more matches than a block, beside a text with none."""
    text = " ".join(f"é{i} user{i}@mail{i % 7}.example.org or 10.0.{i % 256}.{i % 250}," for i in range(1500))
    rows = {r.doc_id: r for r in find_pii(spark.createDataFrame([(1, text), (2, "nothing")], "doc_id long, text string")).collect()}
    want = {(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)}
    want |= {(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)}
    assert {(s.kind, s.start, s.end) for s in rows[1].base} == want and len(rows[1].base) == 3000
    assert rows[2].base == []


def test_values_of_one_shape_are_seeds_too(spark):
    """Secrets behind one context, none of which a base pattern knows; numbers in a row and dates behind another aren't any."""
    secrets = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    rows = [(i, f'config token = "{s}" end') for i, s in enumerate(secrets)]
    rows += [(50 + i, f"released on day 2024-01-{i:02d} of it") for i in range(10, 28)]
    rows += [(100 + i, f"look at item part-number-{i:06d}-of-it there") for i in range(12)]
    rows += [(200, f"elsewhere {secrets[3]} alone"), (201, 'config token = "none" end')]
    got = {r.doc_id: r.all for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("added").alias("all")).collect()}
    assert all(got[i] == "context:16:56" for i in range(12)) and not any(got[i] for i in got if i >= 12)


def graph(pairs, seeds, rounds=2, support=3):
    """Scores of contexts by the docstring's definition; pairs of context and value."""
    values = {v: 1.0 if v in seeds else 0.0 for _, v in pairs}
    for _ in range(rounds):
        score = {}
        for c in {c for c, _ in pairs}:
            mine = [values[v] for x, v in pairs if x == c]
            if sum(x > 0 for x in mine) >= support:
                score[c] = sum(mine) / (len(mine) + 1)
        for v in values:
            if v not in seeds:
                doubt = 1.0
                for c, x in pairs:
                    if x == v:
                        doubt *= 1 - min(score.get(c, 0.0), 0.999999)
                values[v] = 1 - doubt
    return score


def test_graph_against_brute_force(spark):
    import random

    rng = random.Random(4)
    contexts = [f"ctx{i} says" for i in range(12)]
    mails, codes = [f"user{i}@mail.org" for i in range(9)], [f"zq-{1000 + i}-77" for i in range(14)]
    rows, pairs = [], set()
    for i in range(90):
        c, v = rng.choice(contexts), rng.choice(mails + codes)
        pairs.add((f"of {'x' * (contexts.index(c) + 1)} ", v))  # two words and what touches the mark, which is nothing
        rows.append((i, f"Well {c} of {'x' * (contexts.index(c) + 1)} {v} ok"))
    score = graph(sorted(pairs), set(mails))
    trusted = {c for c, s in score.items() if s >= 0.5}
    got = {r.doc_id: bool(r.added) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0 < len(trusted) < 12
    for i, text in rows:
        context, value = re.search(r"(of x+ )(\S+)", text).groups()
        assert got[i] == (value in codes and context in trusted), (i, text)


def test_redaction_of_very_many_spans_is_linear(spark):
    import time

    def text(n):
        return " ".join(f"é{i} user{i}@mail{i % 7}.example.org or" for i in range(n))

    took = {}
    for n in (2_500, 20_000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id long, text string")
        began = time.perf_counter()
        (got,) = redact(docs).collect()
        took[n] = time.perf_counter() - began
        assert got.text == re.sub(r"user\d+@mail\d\.example\.org", "<EMAIL>", text(n))
    assert took[20_000] < 4 * took[2_500] + 30


def test_copies_without_ids_are_dealt_out(spark):
    rows = [(None, "call a@b.co or 1.2.3.4 now")] * 3_000 + [(1, "x")]
    got = redact(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).groupBy("text").count().collect()
    assert {r.text: r["count"] for r in got} == {"call <EMAIL> or <IP> now": 3_000, "x": 1}
