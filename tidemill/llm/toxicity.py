"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word enters as two vectors: one of the word itself, and the mean of its character n-grams. The network reads all
overlapping windows of a text in both directions, attention pools the states of a window, and a text's score is that of
its worst window. Labels are of documents, so training picks each document's worst window anew in every epoch.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fold_column, lower_ascii, slices, words
from tidemill.llm.samples import chosen_labels, labelled

WINDOW, STRIDE = 64, 48
BUCKETS = 1 << 15
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 8
GRAMS = (3, 4, 5)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int64)


def word_inputs(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word, buckets of its character n-grams (of `<word>`), one after the other, and where each starts."""
    vocabulary = [w or "\x00" for w in vocabulary]  # so that no word is without n-grams
    joined = "".join(f"<{w}>" for w in vocabulary)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(w) + 2 for w in vocabulary], dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters from here to the word's end
    with np.errstate(over="ignore"):
        place = np.arange(len(codes), dtype=np.int64) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        power = (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX
        word = np.add.reduceat(codes * (power ^ power >> np.uint64(17)), np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, np.uint64)
        grams, owners = [], []
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), np.uint64(n))
            for k in range(n):
                h = (h ^ codes[at + k]) * _MIX
                h ^= h >> np.uint64(32)
            grams.append(_bucket(h))
            owners.append(owner[at])
        grams, owners = np.concatenate(grams), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        return _bucket(word), grams[order], np.searchsorted(owners[order], np.arange(len(sizes)))


def windows(counts: np.ndarray, width: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of all overlapping windows; a text without words has one empty window."""
    per = 1 + np.maximum(0, -(-(counts - width) // stride))
    doc = np.repeat(np.arange(len(counts)), per)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    first = k * stride
    return (np.cumsum(counts) - counts)[doc] + first, np.minimum(width, counts[doc] - first), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, scoring and training."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.open: dict[str, np.ndarray] = {}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        w = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {
            "word": w(BUCKETS, WORD_DIM) * 0.1, "char": w(BUCKETS, CHAR_DIM) * 0.1,
            **{f"{name}{side}": value for side in "fb" for name, value in (("in", w(d, 3 * h)), ("bias", np.zeros(3 * h, np.float32)), ("gate", w(h, 2 * h)), ("new", w(h, h)))},
            "attend": w(2 * h, h), "attend_bias": np.zeros(h, np.float32), "query": w(h), "out": w(2 * h), "out_bias": np.zeros(1, np.float32),
        }

    def embed(self, vocabulary: list[str]) -> tuple[np.ndarray, tuple]:
        word, grams, starts = word_inputs(vocabulary)
        sizes = np.diff(np.append(starts, len(grams)))
        sums = np.add.reduceat(self.p["char"][grams], starts) if len(grams) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][word], sums / sizes[:, None].astype(np.float32)], axis=1), (word, grams, sizes)

    def _read(self, side: str, gx: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction; gx: input terms of each word."""
        n, steps = at.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.zeros((steps, n, HIDDEN), np.float32)
        gate, new = self.p[f"gate{side}"], self.p[f"new{side}"]
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, m = gx[at[:, t]], mask[:, t : t + 1]
            zr = _sigmoid(x[:, : 2 * HIDDEN] + h @ gate)
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            hn = h @ new
            c = np.tanh(x[:, 2 * HIDDEN :] + r * hn)
            after = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, hn, c))
            h = out[t] = after
        return out

    def forward(self, gx: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        sides = {s: [] for s in "fb"} if keep is not None else dict.fromkeys("fb")
        states = np.concatenate([self._read(s, gx[s], at, mask, sides[s]) for s in "fb"], axis=2)
        a = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        weight = np.where(mask.T > 0, a @ self.p["query"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep.update(sides=sides, states=states, a=a, weight=weight, pooled=pooled)
        return pooled @ self.p["out"] + self.p["out_bias"][0]

    def _terms(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: (x @ self.p[f"in{s}"] + self.p[f"bias{s}"]).astype(np.float32) for s in "fb"}

    @staticmethod
    def _grid(ids: np.ndarray, first: np.ndarray, size: np.ndarray, empty: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(WINDOW)
        inside = t < size[:, None]
        at = np.where(inside, ids[np.minimum(first[:, None] + t, max(len(ids) - 1, 0))] if len(ids) else empty, empty)
        mask = inside.astype(np.float32)
        mask[size <= 0, 0] = 1  # the one state of a window without words
        return at, mask

    def window_logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all windows, and the text of each."""
        vocabulary: dict[str, int] = {"": 0}
        ids, counts = [], []
        for text in texts:
            own = [vocabulary.setdefault(w, len(vocabulary)) for w in words(lower_ascii(text))]
            ids += own
            counts.append(len(own))
        gx = self._terms(self.embed(list(vocabulary))[0])
        ids, (first, size, doc) = np.array(ids, dtype=np.int64), windows(np.array(counts, dtype=np.int64))
        logits = [self.forward(gx, *self._grid(ids, first[i : i + 2048], size[i : i + 2048], 0)) for i in range(0, len(first), 2048)]
        return np.concatenate(logits) if logits else np.zeros(0), doc

    def score(self, texts: list[str]) -> np.ndarray:
        """Highest window probability of each text."""
        if not texts:
            return np.zeros(0)
        logits, doc = self.window_logits(texts)
        return _sigmoid(np.maximum.reduceat(logits, np.searchsorted(doc, np.arange(len(texts)))))

    def gradients(self, vocabulary: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of the windows and its gradient by backpropagation through time."""
        x, (word, grams, sizes) = self.embed(vocabulary)
        gx, keep, p = self._terms(x), {}, self.p
        logit = self.forward(gx, at, mask, keep)
        q = _sigmoid(logit)
        loss = float((-weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum())
        d = (weight * (q - y)).astype(np.float32)
        states, a, attention, pooled = (keep[k] for k in ("states", "a", "weight", "pooled"))
        g = {"out": pooled.T @ d, "out_bias": np.array([d.sum()])}
        d_pooled = d[:, None] * p["out"]
        d_states = attention[:, :, None] * d_pooled
        d_attention = np.einsum("tnh,nh->tn", states, d_pooled)
        d_energy = attention * (d_attention - (attention * d_attention).sum(axis=0))
        g["query"] = np.einsum("tn,tnk->k", d_energy, a)
        d_a = d_energy[:, :, None] * p["query"] * (1 - a**2)
        g["attend"], g["attend_bias"] = np.einsum("tnh,tnk->hk", states, d_a), d_a.sum(axis=(0, 1))
        d_states = d_states + d_a @ p["attend"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            gate, new = p[f"gate{s}"], p[f"new{s}"]
            d_gate, d_new, d_gx, d_h = np.zeros_like(gate), np.zeros_like(new), np.zeros_like(gx[s]), np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, hn, c in reversed(keep["sides"][s]):
                d_h = d_h + d_states[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t : t + 1]
                d_c = d_h * m * (1 - z) * (1 - c**2)
                d_z = -d_h * m * (c - h) * z * (1 - z)
                d_r = d_c * hn * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], axis=1)
                d_hn = d_c * r
                np.add.at(d_gx, at[:, t], np.concatenate([d_zr, d_c], axis=1))
                d_gate += h.T @ d_zr
                d_new += h.T @ d_hn
                d_h = d_h * (1 - m * (1 - z)) + d_zr @ gate.T + d_hn @ new.T
            g |= {f"gate{s}": d_gate, f"new{s}": d_new, f"in{s}": x.T @ d_gx, f"bias{s}": d_gx.sum(axis=0)}
            d_x += d_gx @ p[f"in{s}"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], word, d_x[:, :WORD_DIM])
        np.add.at(g["char"], grams, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        return loss, g


def _start_from_odds(net: Network, texts: list[str], y: np.ndarray, least: int = 4) -> None:
    """First coordinates of words and n-grams: how surely they speak for toxic documents (a cautious log odds).

    What fewer than `least` documents hold stays zero, in training too, so that no document is learnt by its rare words.
    """
    for name, of in (("word", lambda w: w[0]), ("char", lambda w: w[1])):
        seen = np.zeros((2, BUCKETS))
        for text, label in zip(texts, y):
            own = sorted(set(words(lower_ascii(text))))
            if own:
                seen[int(label), np.unique(of(word_inputs(own)))] += 1
        n = np.array([(y == 0).sum(), (y == 1).sum()])
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        net.open[name] = (seen.sum(axis=0) >= least)[:, None].astype(np.float32)
        net.p[name] *= net.open[name]
        net.p[name][:, 0] = net.open[name][:, 0] * np.clip(odds - 2 * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0, 6)


def train(texts: list[str], y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """A network from texts and labels (1 toxic). With one class only, a constant score: that class's smoothed share."""
    net = Network(seed)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.p["out"][:] = 0
        net.p["out_bias"][0] = np.log(share) - np.log(1 - share)
        return net
    _start_from_odds(net, texts, y)
    rng, step = np.random.default_rng(seed), 0
    m, v = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    split = [words(lower_ascii(t)) for t in texts]
    first, size, doc = windows(np.array([len(w) for w in split], dtype=np.int64))
    first -= (np.cumsum([len(w) for w in split]) - [len(w) for w in split])[doc]
    for _ in range(epochs):
        logits, owner = net.window_logits(texts)
        order = np.lexsort((logits, owner))
        worst = order[np.append(np.flatnonzero(np.diff(owner[order])), len(order) - 1)]
        shuffled = rng.permutation(len(texts))
        for i in range(0, len(texts), batch):
            chosen = shuffled[i : i + batch]
            vocabulary: dict[str, int] = {"": 0}
            at, mask = np.zeros((len(chosen), WINDOW), np.int64), np.zeros((len(chosen), WINDOW), np.float32)
            for row, k in enumerate(chosen):
                own = split[k][first[worst[k]] : first[worst[k]] + size[worst[k]]]
                at[row, : len(own)] = [vocabulary.setdefault(w, len(vocabulary)) for w in own]
                mask[row, : max(len(own), 1)] = 1
            label = y[chosen]
            weight = np.where(label == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9)) / len(chosen)
            _, g = net.gradients(list(vocabulary), at, mask, label, weight)
            step += 1
            norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
            for k, x in g.items():
                x = x * net.open.get(k, np.float32(1)) * min(1.0, 5 / (norm + 1e-9))
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.01 * (x**2 - v[k])
                net.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int | None = 0, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500, sample_chars: int = 8_000, score_col: str = "toxicity") -> DataFrame:
    """All columns of docs, and `score_col`: the score (0 to 1) of each row's whole text.

    The network learns from labelled documents outside the held-out fold, at most `per_class` of each class by seeded
    hash, with texts up to `sample_chars`; `labels` needs doc_id and toxic. Null texts count as empty: one window with
    no words. Null ids and repeated rows stay. A column of that name gives way.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chosen = chosen_labels(labels, "toxic", per_class, folds, held_out)
    sample = labelled(rows.where(F.length("text") <= sample_chars), chosen).toPandas().sort_values(["doc_id", "text"]).drop_duplicates("text")
    net = docs.sparkSession.sparkContext.broadcast(train(sample["text"].tolist(), sample["label"].to_numpy(float)))

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in texts]
        return pd.Series(np.concatenate([net.value.score(texts[a:b]) for a, b in slices(texts, 1_500_000)]) if texts else [], dtype=float)

    return docs.withColumn(score_col, toxicity(text_col))


def held_out_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if the score is 0.5 or more), row for row."""
    rows = docs.select("doc_id", "text", (fold_column(F.col("doc_id").cast("long"), folds) == held_out).alias("held_out"))
    got = scored(rows, labels, folds, held_out)
    return got.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
