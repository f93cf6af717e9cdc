"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on the seeds (runs of `least` words, by a Karp-Rabin hash) that they share.
For each pair whose seeds could cover enough of the item, the longest common runs are marked one after the other, never
over each other, on both sides; the item's share of marked words is its coverage. Runs may come in any order, so passages
with their parts moved about are caught too.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import slices, word_column, written

MARKS = ".,;:!?\"'()[]{}<>#*$%&|-_~`"
#: Pairs of a seed's places in a document and in the items up to which they are held at once.
PAIRS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
LEAK = "struct<item_id:bigint,matched:int,words:int,tiles:int>"


def tokens(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words in lower case (A-Z) without marks at their ends, each word's place among them, words per text."""
    column, at, counts = word_column(texts, lower=True)
    coded = pc.utf8_trim(column, characters=MARKS).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at]
    if "" in distinct:
        there = at != distinct.index("")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
        at = at[there]
    return distinct, at, counts


def _seeds(ids: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash of every run of `least` words that lies in one text, all words known (0 or more), and its place."""
    n = max(len(ids) - least + 1, 0)
    h, fine = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
    with np.errstate(over="ignore"):
        for k in range(least):
            h = h * _BASE + (ids[k : k + n] + 1).astype(np.uint64)
            fine &= ids[k : k + n] >= 0
    text = np.repeat(np.arange(len(counts)), counts)
    fine &= text[:n] == text[least - 1 : least - 1 + n]
    at = np.flatnonzero(fine)
    return h[at], at


Matches = tuple[np.ndarray, np.ndarray, np.ndarray]


def matches(item_at: np.ndarray, doc_at: np.ndarray, least: int) -> Matches:
    """Longest common runs (place in item, place in document, length) from the places of all common runs of `least` words.

    Runs on one diagonal that follow each other are one match.
    """
    order = np.lexsort((item_at, doc_at - item_at))
    i, d = item_at[order], doc_at[order]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(d - i) != 0) | (np.diff(i) != 1)]))
    return i[starts], d[starts], np.diff(np.append(starts, len(i))) + least - 1


def swept_matches(item_at: np.ndarray, slots: np.ndarray, places: list[np.ndarray], least: int) -> Matches:
    """The same where seeds repeat in both texts, without ever holding all pairs: one place of the item after the other.

    item_at: ascending places of the item's seeds; slots: the seed at each; places: ascending places of each seed in the
    document. What is held is one entry for each diagonal.
    """
    none = np.zeros(0, dtype=np.int64)
    diagonal, since, last, out = none, none, -2, []
    for at, seed in zip([*item_at.tolist(), -1], [*slots.tolist(), -1]):
        now = places[seed] - at if seed >= 0 else none
        slot = np.minimum(np.searchsorted(now, diagonal), max(len(now) - 1, 0))
        goes_on = now[slot] == diagonal if at == last + 1 and len(now) else np.zeros(len(diagonal), dtype=bool)
        if not goes_on.all():
            ended = ~goes_on
            out.append((since[ended], diagonal[ended] + since[ended], last - since[ended] + least))
        first = np.full(len(now), at)
        first[slot[goes_on]] = since[goes_on]
        diagonal, since, last = now, first, at
    return tuple(np.concatenate([x[k] for x in out]) if out else none for k in range(3))


def tile(found: Matches, n_item: int, n_doc: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of the matches: tiles (place in item, place in document, length), longest first, ties by place."""
    heap = [(-int(n), int(a), int(b)) for a, b, n in zip(*found)]
    heapq.heapify(heap)
    item_marks, doc_marks, tiles, left = np.zeros(n_item, dtype=bool), np.zeros(n_doc, dtype=bool), [], n_item
    while heap and left >= least:
        n, a, b = heapq.heappop(heap)
        taken = item_marks[a : a - n] | doc_marks[b : b - n]
        if not taken.any():
            item_marks[a : a - n] = doc_marks[b : b - n] = True
            tiles.append((a, b, -n))
            left += n
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
        for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if hi - lo >= least:
                heapq.heappush(heap, (lo - hi, a + lo, b + lo))
    return tiles


class Passages:
    """A block of benchmark items, with their words numbered and their seeds sorted."""

    def __init__(self, items: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage = least, coverage
        self.item_ids = [i for i, _ in items]
        distinct, at, self.sizes = tokens([t for _, t in items])
        self.numbers = {w: k for k, w in enumerate(distinct) if w}
        seeds, place = _seeds(at, self.sizes, least)
        order = np.argsort(seeds, kind="stable")
        self.place, self.item = place[order], np.repeat(np.arange(len(items)), self.sizes)[place[order]]
        self.place = self.place - (np.cumsum(self.sizes) - self.sizes)[self.item]
        self.seeds, self.first = np.unique(seeds[order], return_index=True)
        self.times = np.diff(np.append(self.first, len(place)))
        self.short: dict[int, dict[int, list[int]]] = {}  # items of fewer words, by their number and the hash of all of them
        starts = np.cumsum(self.sizes) - self.sizes
        for k in np.flatnonzero((self.sizes > 0) & (self.sizes < least)).tolist():
            n = int(self.sizes[k])
            (h,), _ = _seeds(at[starts[k] : starts[k] + n], self.sizes[k : k + 1], n)
            self.short.setdefault(n, {}).setdefault(int(h), []).append(k)

    def _short(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
        """Text and item where all words of a short item stand together."""
        found: set[tuple[int, int]] = set()
        for n, known in self.short.items():
            h, place = _seeds(ids, counts, n)
            hit = np.flatnonzero(np.isin(h, np.array(list(known), dtype=np.uint64)))
            doc = np.searchsorted(np.cumsum(counts), place[hit], side="right")
            for d, x in set(zip(doc.tolist(), h[hit].tolist())):
                found |= {(d, k) for k in known[x]}
        return sorted(found)

    def _heavy(self, slot: np.ndarray, doc_at: np.ndarray, n_doc: int) -> Iterator[tuple[int, int, int]]:
        """Item, matched words and tiles of one document whose seeds and an item's repeat so often that pairs are too many."""
        order = np.lexsort((doc_at, slot))
        slots, first = np.unique(slot[order], return_index=True)
        places = np.split(doc_at[order], first[1:])
        rows = np.concatenate([np.arange(self.first[x], self.first[x] + self.times[x]) for x in slots])
        of = np.repeat(np.arange(len(slots)), self.times[slots])
        order = np.lexsort((self.place[rows], self.item[rows]))
        rows, of = rows[order], of[order]
        items, starts = np.unique(self.item[rows], return_index=True)
        for k, lo, hi in zip(items.tolist(), starts.tolist(), [*starts[1:].tolist(), len(rows)]):
            item_at, least = self.place[rows[lo:hi]], self.least
            if np.minimum(np.diff(item_at, append=item_at[-1] + least), least).sum() >= np.ceil(self.coverage * self.sizes[k]):
                tiles = tile(swept_matches(item_at, of[lo:hi], places, least), int(self.sizes[k]), n_doc, least)
                yield k, sum(t[2] for t in tiles), len(tiles)

    def find(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text, the items whose coverage reaches the threshold."""
        out: list[list[dict]] = [[] for _ in texts]
        if not len(self.seeds) and not self.short:
            return out
        distinct, at, counts = tokens(texts)
        known = np.fromiter((self.numbers.get(w, -1) for w in distinct), dtype=np.int64, count=len(distinct))
        ids = known[at] if len(distinct) else at
        need = np.ceil(self.coverage * self.sizes).astype(np.int64)

        def leak(d: int, k: int, matched: int, tiles: int) -> None:
            if matched >= need[k]:
                out[d].append({"item_id": self.item_ids[k], "matched": matched, "words": int(self.sizes[k]), "tiles": tiles})

        for d, k in self._short(ids, counts):
            leak(d, k, int(self.sizes[k]), 1)
        if not len(self.seeds):
            return out
        seeds, place = _seeds(ids, counts, self.least)
        slot = np.minimum(np.searchsorted(self.seeds, seeds), len(self.seeds) - 1)
        hit = self.seeds[slot] == seeds
        slot, place = slot[hit], place[hit]
        doc = np.repeat(np.arange(len(counts)), counts)[place]
        doc_at = place - (np.cumsum(counts) - counts)[doc]
        n = self.times[slot]
        pairs = np.bincount(doc, n, minlength=len(counts))
        for d in np.flatnonzero(pairs > PAIRS).tolist():
            own = doc == d
            for k, matched, tiles in self._heavy(slot[own], doc_at[own], int(counts[d])):
                leak(d, k, matched, tiles)
        light = pairs[doc] <= PAIRS
        slot, doc, doc_at, n = slot[light], doc[light], doc_at[light], n[light]
        ends = np.cumsum(n)
        which = np.repeat(self.first[slot] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        doc, doc_at, item, item_at = np.repeat(doc, n), np.repeat(doc_at, n), self.item[which], self.place[which]
        order = np.lexsort((item_at, item, doc))
        doc, doc_at, item, item_at = doc[order], doc_at[order], item[order], item_at[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(item) != 0)])) if len(doc) else []
        bounds = np.append(starts, len(doc)).astype(np.int64)
        reach = np.minimum(np.diff(item_at, append=0), self.least)
        reach[bounds[1:] - 1] = self.least
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            k = int(item[lo])
            if reach[lo:hi].sum() < need[k]:
                continue
            tiles = tile(matches(item_at[lo:hi], doc_at[lo:hi], self.least), int(self.sizes[k]), int(counts[doc[lo]]), self.least)
            leak(int(doc[lo]), k, sum(t[2] for t in tiles), len(tiles))
        return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark, a bounded block at a time."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        block.append((row.i, row.t))
        held += len(row.t)
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def _finder(block: Broadcast):
    @F.pandas_udf(f"array<{LEAK}>")
    def find(texts: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else None for t in texts]
        return pd.Series([x for a, b in slices(texts) for x in block.value.find(texts[a:b])], dtype=object)

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", least: int = 5, coverage: float = 0.5, block_chars: int = 8_000_000, leak_col: str = "leaks") -> DataFrame:
    """All rows and columns of docs, and `leak_col`: array of item_id, matched and all words of the item, tiles.

    An item leaks into a document if tiles of at least `least` words cover `coverage` of its words or more. The benchmark is
    a stated query set: it meets the documents in blocks of about `block_chars` characters, each sent to all executors.
    Between two blocks the rows are written, so that a worker holds one block at a time. An item of fewer than `least`
    words leaks where all of them stand together. Items with a null id keep it; those with a null text or without words match nothing;
    null and empty documents hold nothing; an empty benchmark gives empty arrays. A column of the name `leak_col` gives way.
    """
    out, sent = docs.withColumn(leak_col, F.array().cast(f"array<{LEAK}>")), None
    for items in _blocks(benchmark, item_id_col, item_text_col, block_chars):
        if sent is not None:
            out = written(out, "leaks")
            sent.unpersist()
        sent = docs.sparkSession.sparkContext.broadcast(Passages(items, least, coverage))
        out = out.withColumn(leak_col, F.concat(leak_col, _finder(sent)(F.col(text_col))))
    return out
