"""Ranked lexical search over bit-sliced Bloom signatures.

A document's signature holds its terms, and again those that occur twice, three times, five times and so on. Documents of
like size are kept in blocks, by bit: a slice says which documents of the block have that bit set. ANDing the slices of a
term gives a bitmap of all documents that may hold it, so weighted sums of such bitmaps are upper bounds of scores. The
best bounds are scored exactly first; then every document whose bound reaches the last place of that list is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import MIX_A, dropped, mixed, slices, word_hashes, written
from tidemill.llm.textbytes import Runs, lowered

#: Letters and digits of ASCII, and all bytes of other characters.
INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: A term's entry at level k says that it occurs at least so often.
LEVELS = (1, 2, 3, 5, 9, 17, 33, 65, 129, 257, 513, 1025)
#: Bits that each entry sets, and bits of a signature for each entry, at least (a power of two in all).
PROBES, ROOM = 4, 8
#: Bits of a block, at most (eight documents at least), and its documents, at most.
BLOCK_BITS, BLOCK_DOCS = 1 << 25, 1_024
#: Rows of a table of keys up to which it is broadcast.
SMALL = 1_000_000


def row_key(id_col: str, text_col: str) -> Column:
    """What stands for a row between the index and the table; rows that agree in it are all scored."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def _counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; then by text and term: text, term, how often; and each text's number of terms."""
    runs = Runs(*lowered(texts), INSIDE)
    coded = runs.strings.dictionary_encode()
    distinct = coded.dictionary
    pair, often = np.unique(runs.text * max(len(distinct), 1) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return distinct, pair // max(len(distinct), 1), pair % max(len(distinct), 1), often, np.bincount(runs.text, minlength=len(texts))


def _places(hashes: np.ndarray, level: np.ndarray | int, width: int) -> np.ndarray:
    """The bits of entries, one row for each."""
    with np.errstate(over="ignore"):
        first = hashes + np.asarray(level).astype(np.uint64) * MIX_A
        probes = np.arange(1, PROBES + 1, dtype=np.uint64)
        return (mixed(first[:, None] + probes) & np.uint64(width - 1)).astype(np.int64)


def _blocks_of(keys: np.ndarray, texts: pa.Array) -> Iterator[dict]:
    """Index rows of some texts; texts without terms have no place in it."""
    distinct, text, term, often, sizes = _counted(texts)
    hashes, level = word_hashes(distinct), np.searchsorted(LEVELS, often, side="right")
    entries, most = np.bincount(text, weights=level, minlength=len(texts)), np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(most, text, often)
    widths = 1 << np.ceil(np.log2(np.maximum(entries * ROOM, 64))).astype(np.int64)
    for width in np.unique(widths[sizes > 0]).tolist():
        chosen = np.flatnonzero((widths == width) & (sizes > 0))
        step = min(max(BLOCK_BITS // width // 8 * 8, 8), BLOCK_DOCS)
        for docs in (chosen[i : i + step] for i in range(0, len(chosen), step)):
            place = np.full(len(texts), -1)
            place[docs] = np.arange(len(docs))
            mine = np.flatnonzero(place[text] >= 0)
            rows = np.repeat(mine, level[mine])
            k = np.arange(len(rows)) - np.repeat(np.cumsum(level[mine]) - level[mine], level[mine])
            bits = np.zeros((width, -(-len(docs) // 8) * 8), dtype=bool)
            bits[_places(hashes[term[rows]], k, width), place[text[rows]][:, None]] = True
            yield {"width": width, "keys": keys[docs].tobytes(), "sizes": sizes[docs].tobytes(), "most": most[docs].tobytes(), "slices": np.packbits(bits, axis=1).tobytes()}


INDEX = "width int, keys binary, sizes binary, most binary, slices binary"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: one row for each block of documents that were read together and have signatures of one width.

    width, then as bytes of numpy arrays: the documents' row keys, numbers of terms and largest counts of one term (64-bit),
    and `width` slices of one bit a document. Nothing in it depends on what is asked.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(1)):
                for block in _blocks_of(keys[a:b], batch.column(1)[a:b]):
                    yield pa.RecordBatch.from_pylist([block], schema=schema)

    schema = pa.schema([("width", pa.int32()), *((c, pa.binary()) for c in ("keys", "sizes", "most", "slices"))])
    return docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(of, INDEX)


class Questions:
    """Items of a block and their terms. `terms`: distinct ones; `of[i]`, `times[i]`: those of item i, and how often it has them."""

    def __init__(self, texts: list[str | None]):
        distinct, text, term, often, _ = _counted(pa.array(texts, pa.large_string()))
        self.terms = distinct
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        self.of = [term[a:b] for a, b in pairwise(bounds)]
        self.times = [often[a:b] for a, b in pairwise(bounds)]
        self.weight, self.docs, self.words = np.zeros(len(distinct), dtype=np.int64), 0, 0

    def learn(self, found: dict[int, int]) -> None:
        """Takes the counts of `term_counts`."""
        self.docs, self.words = found.get(-1, 0), found.get(-2, 0)
        n = [found.get(i, 0) for i in range(len(self.terms))]
        self.weight = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1))) if df else 0 for df in n], dtype=np.int64)

    def length(self, sizes: np.ndarray) -> np.ndarray:
        """What a document's length makes of m."""
        return 25 + (75 * sizes * self.docs) // self.words

    def bounds(self, block: dict) -> np.ndarray:
        """Upper bounds of the scores, one row for each item, of all documents of a block."""
        keys = len(block["keys"]) // 8
        if not len(self.terms):
            return np.zeros((len(self.of), keys), dtype=np.int64)
        sizes, most = (np.frombuffer(block[c], dtype=np.int64) for c in ("sizes", "most"))
        bits = np.frombuffer(block["slices"], dtype=np.uint8).reshape(block["width"], -1)
        hashes, m, out = word_hashes(self.terms), self.length(sizes), np.zeros((len(self.of), keys), dtype=np.int64)
        some, has, before = np.arange(len(hashes)), None, np.zeros(keys, dtype=np.int64)
        for k, (least, above) in enumerate(zip(LEVELS, [*LEVELS[1:], None])):
            now = np.bitwise_and.reduce(bits[_places(hashes[some], k, block["width"])], axis=1)
            has = now if has is None else now & has  # who lacks a level lacks those above it
            held = has.any(axis=1)
            some, has = some[held], has[held]
            if not len(some):
                break
            often = np.maximum(np.minimum(most, above - 1 if above else most), least)
            gain = (1_000_000_000 * often) // (1000 * often + 8 * m)
            flags = np.unpackbits(has, axis=1, count=keys)
            row = np.full(len(hashes), -1)
            row[some] = np.arange(len(some))
            for i, (terms, times) in enumerate(zip(self.of, self.times)):
                at = row[terms]
                mine = at >= 0
                if mine.any():
                    sums = (self.weight[terms[mine]] * times[mine]).astype(np.float64) @ flags[at[mine]]
                    out[i] += sums.astype(np.int64) * (gain - before)
            before = gain
        return out

    def exact(self, texts: pa.Array, asked: list[list[int]]) -> Iterator[tuple[int, int, int]]:
        """Text, item and score above 0 of some texts and the items asked for each."""
        distinct, text, term, often, sizes = _counted(texts)
        mine = pc.fill_null(pc.index_in(distinct, value_set=self.terms), -1).to_numpy(zero_copy_only=False)[term]
        text, mine, often = text[mine >= 0], mine[mine >= 0], often[mine >= 0]
        m = self.length(sizes) if self.words else sizes
        parts = self.weight[mine] * ((1_000_000_000 * often) // (1000 * often + 8 * m[text]))
        bounds = np.searchsorted(text, np.arange(len(texts) + 1))
        value = np.zeros(len(self.terms), dtype=np.int64)
        for t, items in enumerate(asked):
            here = slice(bounds[t], bounds[t + 1])
            value[mine[here]] = parts[here]
            for i in items:
                score = int((value[self.of[i]] * self.times[i]).sum())
                if score > 0:
                    yield t, i, score
            value[mine[here]] = 0


def term_counts(docs: DataFrame, asked: Broadcast, text_col: str = "text") -> DataFrame:
    """term and n: in how many documents each asked term (by number) is; -1: documents with terms; -2: all their terms."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = asked.value.terms
        total = np.zeros(len(terms) + 2, dtype=np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                distinct, _, term, _, sizes = _counted(batch.column(0)[a:b])
                mine = pc.fill_null(pc.index_in(distinct, value_set=terms), -1).to_numpy(zero_copy_only=False)[term]
                total[:-2] += np.bincount(mine[mine >= 0], minlength=len(terms))
                total[-1] += np.count_nonzero(sizes)
                total[-2] += sizes.sum()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.where(some < len(terms), some, some - len(total))), pa.array(total[some])], names=["term", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(of, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _block(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {c: batch.column(c)[i].as_py() for c in ("width", "keys", "sizes", "most", "slices")}


def _best_bounds(index: DataFrame, asked: Broadcast, k: int) -> DataFrame:
    """item, key and bound of the k largest bounds of each item in each task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = asked.value
        best, keys = np.zeros((len(questions.of), 0), dtype=np.int64), np.zeros((len(questions.of), 0), dtype=np.int64)
        for batch in batches:
            for block in _block(batch):
                bounds = questions.bounds(block)
                best = np.concatenate([best, bounds], axis=1)
                keys = np.concatenate([keys, np.broadcast_to(np.frombuffer(block["keys"], dtype=np.int64), bounds.shape)], axis=1)
                if best.shape[1] > k:
                    top = np.argpartition(best, best.shape[1] - k, axis=1)[:, -k:]
                    best, keys = np.take_along_axis(best, top, axis=1), np.take_along_axis(keys, top, axis=1)
        item, at = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(keys[item, at]), pa.array(best[item, at])], names=["item", "key", "bound"])

    return index.mapInArrow(of, "item long, key long, bound long")


def _reaching(index: DataFrame, asked: Broadcast, floor: np.ndarray) -> DataFrame:
    """item and key of all documents whose bound is at least the item's floor."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _block(batch):
                item, at = np.nonzero(asked.value.bounds(block) >= floor[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.frombuffer(block["keys"], dtype=np.int64)[at])], names=["item", "key"])

    return index.mapInArrow(of, "item long, key long")


def _scored(docs: DataFrame, wanted: DataFrame, asked: Broadcast, small: bool) -> DataFrame:
    """item, doc_id and score of documents (key, doc_id, text) for wanted items (item, key), scores above 0 alone."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = list(asked.value.exact(batch.column(1)[a:b], batch.column(2)[a:b].to_pylist()))
                text, item, score = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else (np.zeros(0, dtype=np.int64),) * 3
                yield pa.RecordBatch.from_arrays([pa.array(item), batch.column(0)[a:b].take(pa.array(text)), pa.array(score)], names=["item", "doc_id", "score"])

    items = wanted.groupBy("key").agg(F.collect_set("item").alias("items"))  # a set of items of one block
    joined = docs.join(F.broadcast(items) if small else items, "key").select("doc_id", "text", "items")
    return joined.mapInArrow(of, "item long, doc_id long, score long")


def _top(scored: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scored.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _asked_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int | None, str | None]]]:
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        held += len(row.t or "") + 64
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_chars: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k documents with the highest scores above 0, equal ones by ascending id.

    The items are a stated query set: they meet the index in blocks of about `block_chars` characters, each sent to all
    executors. Texts are read for what the bounds don't exclude; which rows those are is broadcast up to SMALL rows of keys,
    and joined by shuffles beyond. Null texts and those without terms have no score; an item without terms gives no rows; a
    null doc_id stays null and comes last among equal scores; repeated rows and repeated items each have ranks of their own;
    empty tables give no rows. Other columns aren't looked at.
    """
    spark = docs.sparkSession
    index = written(signatures(docs, id_col, text_col), "search-index")
    table = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in _asked_blocks(items, item_id_col, item_text_col, block_chars):
        questions = Questions([t for _, t in block])
        first = spark.sparkContext.broadcast(questions)
        questions.learn({r.term: r.n for r in term_counts(docs, first, text_col).toLocalIterator()})
        first.unpersist()
        asked = spark.sparkContext.broadcast(questions)
        best = _best_bounds(index, asked, k)
        ahead = best.withColumn("place", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "key"))).where(F.col("place") <= k)
        floor = np.ones(len(block), dtype=np.int64)  # the last place of what is scored first: no more than the last place of all
        for r in _top(_scored(table, ahead, asked, small=len(block) * k <= SMALL), k).where(F.col("rank") == k).select("item", "score").toLocalIterator():
            floor[r.item] = r.score
        wanted = written(_reaching(index, asked, floor).distinct(), "search-wanted")
        found = written(_top(_scored(table, wanted, asked, small=wanted.count() <= SMALL), k), "search-found")
        dropped(wanted)
        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item long, item_id long")
        named = found.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
