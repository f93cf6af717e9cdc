"""Quality from lines: a linear-chain conditional random field calls every line good or bad.

A line's features are its own statistics and those of the lines next to it. Forward-backward over all lines of a text
gives each line's marginal; weighted by length, the marginals give the text's share of bad text, and a logistic curve
of that share is the score. Labels are of documents: lines of good documents are good; those of bad ones start as bad
and are then called by the model itself, with at least one bad line each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import slices, words
from tidemill.llm.samples import chosen_labels, labelled

CLASSES = ("upper", "lower", "digit", "mark", "symbol", "other", "shout")
N_LINE = 17


def _table() -> np.ndarray:
    """Character class of each code below 65536: upper, lower, digit, punctuation, symbol, other, exclamation."""
    out = np.full(1 << 16, 1, dtype=np.int8)
    out[:128] = 5
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else "x" for c in range(0x3000)]
    out[:0x3000] = [0 if c.isupper() else 1 if c.isalpha() else 2 if c.isdigit() else 5 for c in chars]
    for kind, members in ((3, ".,;:?'\"()-"), (4, "#*$%&|<>=_{}[]\\/~^@+"), (6, "!")):
        out[[ord(c) for c in members]] = kind
    return out


_CLASS = _table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' lengths in characters (and one), and the lines of each text."""
    lines = [t.split("\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for own in lines for x in own]
    lengths = np.array([len(x) for x in flat])
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = _CLASS[np.minimum(codes, 0xFFFF)]
    starts = np.minimum(np.cumsum(lengths + 1) - lengths - 1, max(len(codes) - 1, 0))
    share = np.zeros((len(flat), len(CLASSES)))
    if len(codes):
        for k in range(len(CLASSES)):
            ends = np.concatenate([[0], np.cumsum(kinds == k)])
            share[:, k] = ends[np.minimum(starts + lengths, len(codes))] - ends[starts]
    split = [words(x) for x in flat]
    n = np.array([len(w) for w in split])
    distinct = np.array([len(set(w)) for w in split])
    same = np.array([sum(map(str.__eq__, w, w[1:])) for w in split])
    repeated = np.zeros(len(flat))
    i = 0
    for own in lines:
        seen: set[str] = set()
        for x in own:
            repeated[i] = x in seen and bool(x)
            seen.add(x)
            i += 1
    per, chars = 1 / np.maximum(n, 1), np.maximum(lengths, 1)
    rate = share / chars[:, None]
    f = np.stack([
        np.ones(len(flat)), lengths == 0, np.log1p(n) / 4, np.minimum(lengths * per / 12, 3), rate[:, 0], rate[:, 0] > 0.4, rate[:, 2], rate[:, 3],
        np.minimum(share[:, 4] * per, 4), share[:, 4] * per > 0.5, np.minimum(share[:, 6] * per, 2), share[:, 6] * per > 0.5,
        np.where(n > 3, 1 - distinct * per, 0), same * per, same * per > 0.4, repeated, n < 4,
    ], axis=1)
    return f, lengths + 1, counts


def with_neighbours(f: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, then those of the line before and after; zeros beyond the text's ends."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    before[1:], after[:-1] = f[:-1], f[1:]
    ends = np.cumsum(counts)
    before[np.concatenate([[0], ends[:-1]])[counts > 0]] = 0
    after[ends[counts > 0] - 1] = 0
    return np.concatenate([f, before, after], axis=1)


@dataclass
class Crf:
    """Two states, good and bad; `weights` give a line's bad-against-good score, `moves` that of each step."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float] = (0.0, 0.0)

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of bad for each line, and the expected steps between states; all texts at once, line by line."""
        unary = x @ self.weights
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        longest = int(counts.max()) if len(counts) else 0
        alive = np.searchsorted(-counts[order], -np.arange(longest), side="left")  # texts with more than t lines
        ahead, behind = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        up = np.exp(self.moves - self.moves.max())
        score = np.stack([np.zeros(len(x)), unary], axis=1)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        for t in range(longest):
            at = starts[: alive[t]] + t
            a = score[at] * (ahead[at - 1] @ up if t else 1)
            ahead[at] = a / a.sum(axis=1, keepdims=True)
        last = (starts + counts[order] - 1)[counts[order] > 0]
        behind[last] = 1
        for t in range(longest - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            b = (behind[at + 1] * score[at + 1]) @ up.T
            behind[at] = b / b.sum(axis=1, keepdims=True)
        both = ahead * behind
        p = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
        inner = np.ones(len(x), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        pair = ahead[at][:, :, None] * up[None] * (behind[at + 1] * score[at + 1])[:, None, :] if len(at) else np.zeros((0, 2, 2))
        return p, (pair / np.maximum(pair.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)

    def bad_share(self, x: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The length-weighted mean of the marginals of each text."""
        p, _ = self.marginals(x, counts)
        starts = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, texts: list[str]) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        if not texts:
            return np.zeros(0)
        f, weight, counts = line_features(texts)
        a, b = self.curve
        return 1 / (1 + np.exp(np.clip(a * self.bad_share(with_neighbours(f, counts), counts, weight) + b, -40, 40)))


def _fit_lines(crf: Crf, x: np.ndarray, counts: np.ndarray, bad: np.ndarray, importance: np.ndarray, steps: int) -> None:
    """Adam on the chain's log likelihood of the given line states."""
    state = [np.zeros_like(crf.weights), np.zeros_like(crf.weights), np.zeros_like(crf.moves), np.zeros_like(crf.moves)]
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(counts) - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[at].astype(int), bad[at + 1].astype(int)), 1)
    for step in range(1, steps + 1):
        p, moves = crf.marginals(x, counts)
        g = [x.T @ ((bad - p) * importance) / importance.sum() - 1e-4 * crf.weights, (seen - moves) / max(len(at), 1) - 1e-3 * crf.moves]
        for k, value in enumerate((crf.weights, crf.moves)):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g[k] - m)
            v += 0.01 * (g[k] ** 2 - v)
            value += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def fit(texts: list[str], good: np.ndarray, rounds: int = 3, steps: int = 80) -> Crf:
    """A field from texts and their labels (1 good). With one class only, the score is that class's smoothed share."""
    crf = Crf(np.zeros(3 * N_LINE), np.zeros((2, 2)))
    prior = (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5
    if not 0 < good.sum() < len(good):
        crf.curve = (0.0, float(np.log(1 - prior) - np.log(prior)))
        return crf
    f, weight, counts = line_features(texts)
    x = with_neighbours(f, counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    of_bad = good[doc] == 0
    bad = of_bad.astype(float)
    starts = np.cumsum(counts) - counts
    for _ in range(rounds):
        importance = np.where(bad == 1, 0.5 / max(bad.sum(), 1), 0.5 / max((1 - bad).sum(), 1))
        _fit_lines(crf, x, counts, bad, importance, steps)
        p, _ = crf.marginals(x, counts)
        worst = np.maximum.reduceat(p, starts)[doc]
        bad = (of_bad & ((p > 0.5) | (p >= worst))).astype(float)
    share = crf.bad_share(x, counts, weight)
    a, b, y = 0.0, 0.0, 1.0 - good
    for _ in range(100):  # Newton for the curve, ridged
        q = 1 / (1 + np.exp(-(a * share + b)))
        w = np.maximum(q * (1 - q), 1e-9)
        g = np.array([((y - q) * share).sum() - 0.01 * a, (y - q).sum()])
        h = np.array([[(w * share**2).sum() + 0.01, (w * share).sum()], [(w * share).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -5, 5)), b + float(np.clip(step[1], -5, 5))
    crf.curve = (a, b)
    return crf


def scored(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, sample_chars: int = 20_000) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: better) and predicted of every row's whole text.

    The field learns from labelled documents of the other folds, at most `per_class` of each class by seeded hash, with
    texts up to `sample_chars`; `labels` needs doc_id and quality. Null texts count as empty (one empty line). Null ids
    are of the fold of the empty string; repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = chosen_labels(labels, "quality", per_class, folds, held_out)
    sample = labelled(rows.where(F.length("text") <= sample_chars), chosen).toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text")
    crf = docs.sparkSession.sparkContext.broadcast(fit(sample["text"].tolist(), sample["label"].to_numpy(float)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in slices(texts, 1_500_000):
                yield pd.DataFrame({"doc_id": frame["doc_id"].iloc[a:b].astype("Int64"), "held_out": frame["held_out"].iloc[a:b], "score": crf.value.score(texts[a:b])})

    from tidemill.llm.common import fold_column

    folded = rows.select("doc_id", "text", (fold_column(F.col("doc_id"), folds) == held_out).alias("held_out"))
    return folded.mapInPandas(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
