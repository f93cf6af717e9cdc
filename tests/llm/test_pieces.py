import itertools
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm import pieces as p

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "a", "the cat  sat", "Zürich\n\n wir ☃▁ und 😀\x1e x\ty ", "x" * 300, "the " * 400, "  lead and trail  ", "\n", "日本語 text\x00"]


@pytest.fixture(scope="module")
def vocabulary():
    return p.Vocabulary(MODEL)


def every_path(vocabulary, text):
    """All segmentations of a short text by brute force, with their probability."""
    codes = "▁" + text.replace(" ", "▁")
    known = {vocabulary.pieces[i]: (int(i), log) for i, log in zip(vocabulary.ids, vocabulary.logs)}
    out = {}

    def walk(at, ids, log):
        if at == len(codes):
            out[tuple(ids)] = log
        for n in range(1, min(vocabulary.longest, len(codes) - at) + 1):
            piece = codes[at : at + n]
            if piece in known and not ("▁" in piece and piece.rstrip("▁") and "▁" in piece.lstrip("▁")):
                walk(at + n, [*ids, known[piece][0]], log + known[piece][1])

    walk(0, [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: v - total for k, v in out.items()}


def sample(vocabulary, texts, k, seed=0):
    keys = np.arange(len(texts), dtype=np.uint64) * np.uint64(1000003) + np.uint64(seed)
    return list(p.sample_texts(p.Lattices(vocabulary), texts, keys, k))


def test_round_trip_and_distinct(vocabulary):
    found = sample(vocabulary, TEXTS, 4)
    for d, rank, ids, log, inclusion in found:
        assert p.decode_ids(vocabulary, ids, np.array([len(ids)])) == [TEXTS[d]]
        assert log <= 1e-9 and 0 < inclusion <= 1
    per = Counter(x[0] for x in found)
    assert per[3] == per[5] == per[6] == 4 and all(per[d] >= 1 for d in range(len(TEXTS)))
    assert len({(x[0], x[2].tobytes()) for x in found}) == len(found)


def test_library_decodes_the_same(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for d, _, ids, _, _ in sample(vocabulary, ["the cat sat", "Zürich ☃ x\ty"], 3):
        assert model.decode(ids.tolist()) == ["the cat sat", "Zürich ☃ x\ty"][d]


def test_log_probabilities_and_exhaustion(vocabulary):
    for text in ("a", "of a", "tin"):
        want = every_path(vocabulary, text)
        found = {tuple(x[2].tolist()): x[3] for x in sample(vocabulary, [text], len(want) + 3)}
        assert set(found) <= set(want) and len(found) >= min(len(want), 3)
        for ids, log in found.items():
            assert abs(want[ids] - log) < 1e-6


@pytest.mark.parametrize("alpha", [0.25, 6.0, 12.0])
def test_the_rarest_segmentations_are_given_too(alpha):
    """All of them, though with a steep law of pieces their shares go down to 1e-90 and less."""
    steep = p.Vocabulary(MODEL, alpha=alpha)
    for text in ("thin", "of a", "cats"):
        want = every_path(steep, text)
        found = sample(steep, [text], len(want) + 3, seed=5)
        assert {tuple(x[2].tolist()) for x in found} == set(want) and len(found) == len(want)
        assert all(abs(want[tuple(x[2].tolist())] - x[3]) < 1e-6 * max(1, abs(x[3])) for x in found)
        assert alpha < 1 or -600 < min(want.values()) < -50


def test_what_paths_leave():
    steep = p.Vocabulary(MODEL, alpha=12.0)
    lattices, want = p.Lattices(steep), every_path(steep, "thin")
    distinct, at, counts = p.segments(["thin"])
    number = int(lattices.places(distinct)[at[0]])
    assert counts.tolist() == [1]
    paths = {}
    for seed in range(300):
        edges, _, _, rest = lattices.draw(np.array([number]), np.array([seed], dtype=np.uint64), np.array([1], dtype=np.uint64))
        ids = tuple(lattices.ids(edges)[0].tolist())
        paths[ids] = edges.astype(np.int32)
        others = np.exp(np.logaddexp.reduce([v for k, v in want.items() if k != ids]))
        assert rest[0] == pytest.approx(others, rel=1e-9)
    most = sorted(paths, key=lambda x: -want[x])[:3]
    for n in range(1, len(most) + 1):
        others = np.exp(np.logaddexp.reduce([v for k, v in want.items() if k not in most[:n]]))
        assert lattices.left_by(number, [paths[x].tobytes() for x in most[:n]]) == pytest.approx(others, rel=1e-9)


def test_first_draw_and_inclusion_follow_the_probabilities(vocabulary):
    want, n = every_path(vocabulary, "thin"), 4000
    keys = np.arange(n, dtype=np.uint64) * np.uint64(7919)
    found = list(p.sample_texts(p.Lattices(vocabulary), ["thin"] * n, keys, 2))
    first = Counter(tuple(x[2].tolist()) for x in found if x[1] == 0)
    for ids, log in want.items():
        assert abs(first[ids] / n - np.exp(log)) < 4 * np.sqrt(np.exp(log) / n) + 0.002
    pairs = Counter()
    for a, b in itertools.pairwise(found):
        if a[0] == b[0]:
            pairs[tuple(a[2].tolist()), tuple(b[2].tolist())] += 1
    for (a, b), times in pairs.most_common(5):  # without replacement: p(a) p(b) / (1 - p(a))
        q = np.exp(want[a] + want[b]) / (1 - np.exp(want[a]))
        assert abs(times / n - q) < 5 * np.sqrt(q / n) + 0.002
    weights = Counter()
    for x in found:  # each segmentation's mean of 1 / inclusion, times its share, estimates its probability without bias
        weights[tuple(x[2].tolist())] += np.exp(x[3]) / x[4]
    for ids, total in weights.most_common(4):
        assert abs(total / n - np.exp(want[ids])) < 0.05


def test_operator(spark):
    rows = [(i if i else None, t, "r") for i, t in enumerate([*TEXTS, None, "again", "again"])]
    docs = spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, rank string")
    got = p.sampled_pieces(docs, MODEL, k=3)
    got = got.select("*", p.decoded(got["ids"], MODEL).alias("text")).collect()
    again = {(r.doc_id, r["rank"], tuple(r.ids)) for r in p.sampled_pieces(docs.repartition(3), MODEL, k=3).collect()}
    assert again == {(r.doc_id, r["rank"], tuple(r.ids)) for r in got}
    for r in got:
        assert r.text == ([*TEXTS, "", "again", "again"][r.doc_id or 0])
    assert {r.doc_id for r in got} == {None, *range(1, len(rows))}
    for r in p.sampled_pieces(docs, MODEL, k=2, decode=True).collect():
        assert r.decoded == ([*TEXTS, "", "again", "again"][r.doc_id or 0])
    assert p.sampled_pieces(docs.limit(0), MODEL).count() == 0
