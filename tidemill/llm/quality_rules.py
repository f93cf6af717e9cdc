"""Quality rules: gradient-boosted trees over statistics of documents.

The trees are grown in numpy from a bounded sample and flattened into arrays of nodes, so a batch is scored level by
level. On features with a sign, a tree may only move the score that way: more symbols never raise the quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MIX_A, SPACES, mixed, slices, word_column, written
from tidemill.llm.samples import chosen_labels, labelled

SYMBOLS = "#*$%&|<>"  # fixed value
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature and the direction in which it may move the quality (0: any).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1, "same_as_last": -1,
    "upper": -1, "digits": 0, "shouts": -1, "distinct": 0, "punctuation": 0, "words_per_line": 0,
}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point, a bit for each kind of character that is counted: symbols, capitals, digits, marks, exclamation marks."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[[c for c in range(0x110000) if chr(c).isupper()]] = 2
    for bit, characters in ((1, SYMBOLS), (4, "0123456789"), (8, ".,;:?"), (16, "!")):
        out[[ord(c) for c in characters]] |= bit
    return out


def repeated_words(at: np.ndarray, text: np.ndarray, texts: int, width: int = 5) -> np.ndarray:
    """Of each text, words that lie in a window of `width` words found twice or more in it, the first find included."""
    n = max(len(at) - width + 1, 0)
    windows = np.flatnonzero(text[:n] == text[width - 1 : width - 1 + n])
    h = text[windows].astype(np.uint64)
    for k in range(width):
        with np.errstate(over="ignore"):
            h = mixed(h * MIX_A + at[windows + k].astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.bincount(windows[twice], minlength=len(at) + 1) - np.bincount(windows[twice] + width, minlength=len(at) + 1)
    return np.bincount(text[np.cumsum(edges)[: len(at)] > 0], minlength=texts)


def _distinct(text: np.ndarray, code: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct codes each text has."""
    base = int(code.max()) + 1 if len(code) else 1
    both = np.sort(text * base + code)
    return np.bincount(both[np.diff(both, prepend=-1) != 0] // base, minlength=texts)


def statistics(texts: list[str | None]) -> np.ndarray:
    """The base counts and then the features, a row for each text; all texts of a slice are counted at once."""
    texts = [t or "" for t in texts]
    size = len(texts)
    distinct, at, n = word_column(texts)
    text = np.repeat(np.arange(size), n)
    chars = np.bincount(text, pc.utf8_length(distinct).to_numpy(zero_copy_only=False)[at], size)
    kinds = _kinds()[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")]
    place = np.flatnonzero(kinds)  # few characters are of any kind
    kinds, owner = kinds[place], np.searchsorted(np.cumsum([len(t) for t in texts]), place, side="right")
    n_symbols, capitals, digits, marks = (np.bincount(owner[kinds & bit > 0], minlength=size) for bit in (1, 2, 4, 8))
    bang = kinds & 16 > 0
    place, owner = place[bang], owner[bang]
    starts = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    shouts = np.bincount(owner[starts], np.diff(np.append(starts, len(place))) // 2, size)
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    coded = lists.flatten().dictionary_encode()
    full = pc.binary_length(pc.utf8_trim(coded.dictionary, characters=SPACES)).to_numpy(zero_copy_only=False) > 0
    line = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_text = np.repeat(np.arange(size), np.diff(lists.offsets.to_numpy()))[full[line]]
    line = line[full[line]]
    lines = np.bincount(line_text, minlength=size)
    n_dup, n_repeat = lines - _distinct(line_text, line, size), repeated_words(at, text, size)
    same = np.bincount(text[1:][(at[1:] == at[:-1]) & (text[1:] == text[:-1])], minlength=size)
    per, per_char, per_line = 1 / np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    columns = [
        n, chars, n_symbols, n_dup, n_repeat,
        np.log1p(n), chars * per, n_symbols * per, n_dup / per_line, n_repeat * per, same * per,
        capitals / per_char, digits / per_char, shouts * per, _distinct(text, at, size) * per, marks * per, n / per_line,
    ]
    return np.array(columns, dtype=float).T


def _statistics(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        texts = [t if isinstance(t, str) else None for t in frame["text"]]
        parts = [statistics(texts[a:b]) for a, b in slices(texts, 1_000_000)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(BASE) + len(FEATURES)))
        out = pd.DataFrame(rows, columns=[*BASE, *FEATURES])
        yield out.astype(dict.fromkeys(BASE, "int64")).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))


@dataclass
class Trees:
    """All trees' nodes in one set of arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    prior: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 2.0, bins: int = 64, least: float = 5.0) -> Trees:
    """Newton boosting of the log loss over binned features; splits that break a feature's sign are not taken.

    Children of a split on a signed feature are bounded by the middle of their values, so no split below can undo it.
    With one class only (or no rows) the trees are empty and the prior decides.
    """
    up = y.sum() if len(y) else 1.0
    prior = float(np.log((up + 0.5) / (max(len(y), 1) - min(up, len(y)) + 0.5)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    if len(y) and 0 < up < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        raw = np.full(len(y), prior)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)

            def build(rows: np.ndarray, lo: float, hi: float, level: int) -> int:
                value = float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
                at = len(nodes)
                nodes.append([0, np.inf, at, at, rate * value])
                best = (1e-6, None)
                if level < depth and len(rows) > 1:
                    sg, sh = g[rows].sum(), h[rows].sum()
                    for f, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(c) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(c) + 1))[:-1]
                        wl, wr = (np.clip(-a / (b + ridge), lo, hi) for a, b in ((gl, hl), (sg - gl, sh - hl)))
                        loss = gl * wl + 0.5 * (hl + ridge) * wl**2 + (sg - gl) * wr + 0.5 * (sh - hl + ridge) * wr**2
                        gain = sg * value + 0.5 * (sh + ridge) * value**2 - loss
                        gain[(hl < least * 0.1) | (sh - hl < least * 0.1) | (signs[f] * (wr - wl) < 0)] = -np.inf
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
                if best[1] is not None:
                    f, k, wl, wr = best[1]
                    goes, mid = binned[rows, f] <= k, (wl + wr) / 2
                    bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[signs[f]]
                    nodes[at][:2] = [f, cuts[f][k]]
                    nodes[at][2] = build(rows[goes], *bounds[0], level + 1)
                    nodes[at][3] = build(rows[~goes], *bounds[1], level + 1)
                return at

            roots.append(build(np.arange(len(y)), -np.inf, np.inf, 0))
            flat = np.array(nodes, dtype=float).reshape(-1, 5)
            raw += Trees(np.array(roots[-1:]), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], depth, 0.0).raw(x)
    flat = np.array(nodes, dtype=float).reshape(-1, 5)
    return Trees(np.array(roots, dtype=int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4], depth, prior)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 10_000, held_out: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (0 to 1) and kept, row for row.

    base_failed: under 10 words, or over 20 % of the words in repeated windows of five. kept: not base_failed, and the
    trees put the quality at 0.5 or more. They learn from at most `per_class` labelled documents of each class (outside
    fold held_out[1] of held_out[0], if given). Null texts have no words. Without labels of both classes the prior
    decides. Null ids and repeated rows stay; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fields = ", ".join(["doc_id long", *(f"{c} long" for c in BASE), *(f"{c} double" for c in FEATURES)])
    stats = written(rows.mapInPandas(_statistics_columns, fields), "document-statistics")
    folds, out = held_out or (1, None)
    sample = labelled(stats, chosen_labels(labels, "quality", per_class, folds, out)).toPandas().sort_values(["doc_id", *FEATURES])
    trees = grow(sample[list(FEATURES)].to_numpy(float), sample["label"].to_numpy(float), list(FEATURES.values()))
    spread = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def quality(*columns: pd.Series) -> pd.Series:
        return pd.Series(spread.value.probability(np.stack([c.to_numpy(float) for c in columns], axis=1)))

    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.select("doc_id", *BASE, failed.alias("base_failed"), quality(*FEATURES).alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def _statistics_columns(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in _statistics(frames):
        yield frame[["doc_id", *BASE, *FEATURES]]
