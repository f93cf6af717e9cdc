"""Phrase collocation mining: candidates in double-array tries, counted over all texts by advancing all positions at once.

A phrase occurs no more often than any part of it. So windows of frequent neighbouring words, each pair of which is frequent,
hold every frequent phrase; those that occur often enough are the candidates. Tries of bounded size hold them, and each task
moves the states of all positions of its texts one word on at a time and counts where states accept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import MIX_A, MIX_B, dropped, mixed, slices, word_hashes, written
from tidemill.llm.textbytes import Runs, lowered

BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.isin(np.arange(256), np.frombuffer(BREAKS, dtype=np.uint8))
_INSIDE = ~(_BREAK | np.isin(np.arange(256), [9, 32]))
#: Longest phrase in words.
LONGEST = 5
#: Bits of a broadcast set of hashes (8 MB). More entries than it has room for let more candidates through, never fewer.
SET_BITS = 1 << 26
#: Phrases of one trie, about, and tries, each of which is counted in a pass over the texts. Candidates beyond all tries keep the
#: sums of their windows, which are exact as well, so passes don't grow with the corpus.
TRIE_PHRASES, TRIES = 1 << 18, 16
#: Phrases of a trie whose counts travel as one row; blocks of windows, at least; windows held before they are summed up.
BLOCK, LEAST_BLOCKS, HELD = 4_096, 64, 1_000_000


class Texts:
    """The words of some texts. `distinct`, `at`: words and each place's word; `lang`, each place's number in `langs`;
    `joined[i]`: the next place lies in the same piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = lowered(texts)
        runs = Runs(data, offsets, _INSIDE)
        coded = runs.strings.dictionary_encode()
        self.distinct, self.at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.cumsum(_BREAK[data])[runs.start] if len(runs.start) else runs.start
        self.joined = np.zeros(len(self.at), dtype=bool)
        self.joined[:-1] = (piece[1:] == piece[:-1]) & (runs.text[1:] == runs.text[:-1])
        coded = langs.take(pa.array(np.arange(len(langs)))).cast(pa.large_string()).dictionary_encode()
        self.langs, self.lang = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[runs.text]

    def keys(self) -> np.ndarray:
        """A 64-bit hash of each place's language and word."""
        return mixed(word_hashes(self.distinct)[self.at] ^ mixed(word_hashes(self.langs) + MIX_B)[self.lang])


def _pairs(keys: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring keys."""
    with np.errstate(over="ignore"):
        return mixed(keys[:-1] * MIX_A + mixed(keys[1:] + MIX_B))


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def _set(hashes: DataFrame, set_bits: int) -> np.ndarray:
    """The hashes of the one column (longs) as a set of bits; Spark ORs them, so no more than set_bits / 64 rows come back."""
    h = F.col(hashes.columns[0]).bitwiseAND(F.lit(set_bits - 1))
    masks = hashes.select(F.shiftright(h, 6).alias("at"), F.expr(f"shiftleft(1L, cast({hashes.columns[0]} & 63 AS int))").alias("mask"))
    bits = np.zeros(set_bits // 64, dtype=np.uint64)
    for batch in masks.groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow().to_batches():
        bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
    return bits


def _each(docs: DataFrame, of, schema: str) -> DataFrame:
    """Rows that `of` gives for the words of each slice of the texts (columns lang and text of docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                yield of(Texts(batch.column(0)[a:b], batch.column(1)[a:b]))

    return docs.mapInArrow(run, schema)


def _words(texts: Texts) -> pa.RecordBatch:
    d = max(len(texts.distinct), 1)
    code, n = np.unique(texts.lang * d + texts.at, return_counts=True)
    key = mixed(word_hashes(texts.distinct)[code % d] ^ mixed(word_hashes(texts.langs) + MIX_B)[code // d]).view(np.int64)
    return pa.RecordBatch.from_arrays([texts.langs.take(pa.array(code // d)).cast(pa.string()), texts.distinct.take(pa.array(code % d)).cast(pa.string()), pa.array(key), pa.array(n)], names=["lang", "word", "key", "n"])


def _pair_counts(words: Broadcast):
    def of(texts: Texts) -> pa.RecordBatch:
        keys = texts.keys()
        often = _in(words.value, keys)
        pairs, n = np.unique(_pairs(keys)[texts.joined[:-1] & often[:-1] & often[1:]], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(n)], names=["pair", "n"])

    return of


def _windows(texts: Texts, pairs: np.ndarray, blocks: int) -> pa.Table:
    """Phrases all of whose pairs are in the set, how often they occur, and the block that each belongs to."""
    keys = texts.keys()
    code = keys.copy()
    fine = np.zeros(len(keys), dtype=bool)
    fine[:-1] = texts.joined[:-1] & _in(pairs, _pairs(keys))
    starts, phrases, langs, counts, block = np.arange(len(keys)), [], [], [], []
    words = texts.distinct.to_pylist()
    for k in range(2, LONGEST + 1):
        starts = starts[starts + k - 1 < len(keys)]
        starts = starts[fine[starts + k - 2]]  # pairs before that one were seen to be fine
        with np.errstate(over="ignore"):
            code[starts] = mixed(code[starts] * MIX_A + keys[starts + k - 1])
        _, first, which, n = np.unique(code[starts], return_index=True, return_inverse=True, return_counts=True)
        # equal codes of different words, if there are any, are told apart here
        same = np.all([texts.at[starts + j] == texts.at[starts[first][which] + j] for j in range(k)] + [texts.lang[starts] == texts.lang[starts[first][which]]], axis=0)
        n = n - np.bincount(which[~same], minlength=len(n))
        at, n = np.concatenate([starts[first], starts[~same]]), np.concatenate([n, np.ones(np.count_nonzero(~same), dtype=np.int64)])
        phrases += [" ".join([words[w] for w in row]) for row in texts.at[at[:, None] + np.arange(k)].tolist()]
        langs.append(texts.lang[at])
        counts.append(n)
        block.append((code[at] % np.uint64(blocks)).astype(np.int64))
    return pa.table({"block": np.concatenate(block), "lang": texts.langs.take(pa.array(np.concatenate(langs))), "phrase": pa.array(phrases, pa.large_string()), "n": np.concatenate(counts)})


def _summed(parts: list[pa.Table], *keys: str) -> pa.Table:
    return pa.concat_tables(parts).group_by(list(keys)).aggregate([("n", "sum")]).rename_columns([*keys, "n"])


def _window_counts(docs: DataFrame, pairs: Broadcast, blocks: int, least: int) -> DataFrame:
    """lang, phrase and n of the windows that occur `least` times. A task gives one packed row for each block of phrases, which are summed as rows stream by."""

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("block")
        found, first = np.unique(table.column("block").to_numpy(), return_index=True)
        rows, blobs = table.drop_columns(["block"]).combine_chunks(), []
        for a, b in pairwise([*first.tolist(), len(rows)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.take(pa.array(np.arange(a, b))))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for a, b in slices(batch.column(1)):
                parts.append(_windows(Texts(batch.column(0)[a:b], batch.column(1)[a:b]), pairs.value, blocks))
                held += len(parts[-1])
                if held > HELD:
                    parts, held = [_summed(parts, "block", "lang", "phrase")], 0
                    if len(parts[0]) > HELD // 2:
                        yield packed(parts.pop())
        if parts:
            yield packed(_summed(parts, "block", "lang", "phrase"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            table = _summed(parts, "lang", "phrase")
            table = table.filter(pc.greater_equal(table.column("n"), least))
            yield from table.cast(pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])).to_batches()

        open_, parts, held = None, [], 0
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != open_ and parts:
                    yield from told()
                    parts, held = [], 0
                open_ = block
                parts.append(pa.ipc.open_stream(blob.as_buffer()).read_all())
                held += len(parts[-1])
                if held > HELD:
                    parts, held = [_summed(parts, "lang", "phrase")], 0
        if parts:
            yield from told()

    rows = docs.mapInArrow(of, "block long, counts binary")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(sums, "lang string, phrase string, n long")


class Trie:
    """Phrases of languages in a double array: a state's child by a symbol is at base[state] + symbol if that slot's check is the state."""

    def __init__(self, phrases: list[tuple[str, str]]):
        rows = [(lang, *phrase.split(" ")) for lang, phrase in phrases]
        self.langs = pa.array(sorted({r[0] for r in rows}), pa.large_string())
        seen = Counter(w for r in rows for w in r[1:])
        self.words = pa.array(sorted(seen, key=lambda w: (-seen[w], w)), pa.large_string())  # the commonest first, so that children lie close
        of_lang, of_word = ({x: i for i, x in enumerate(c.to_pylist())} for c in (self.langs, self.words))
        paths = np.full((len(rows), LONGEST + 1), -1, dtype=np.int64)
        for i, r in enumerate(rows):
            paths[i, : len(r)] = [of_lang[r[0]], *(of_word[w] for w in r[1:])]
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        # nodes: the root, then level by level; each with its parent, the symbol that leads to it
        node, parents, symbols, ends = np.zeros(len(rows), dtype=np.int64), [np.array([-1])], [np.array([-1])], np.zeros(len(rows), dtype=np.int64)
        count, width = 1, max(len(self.words), len(self.langs)) + 1
        for depth in range(LONGEST + 1):
            on = np.flatnonzero(lengths > depth)
            step, which = np.unique(node[on] * width + paths[on, depth], return_inverse=True)
            parents.append(step // width)
            symbols.append(step % width)
            node[on] = count + which
            ends[on[lengths[on] == depth + 1]] = node[on[lengths[on] == depth + 1]]
            count += len(step)
        parent, symbol = np.concatenate(parents), np.concatenate(symbols)
        slot = np.zeros(count, dtype=np.int64)
        order = np.argsort(parent[1:], kind="stable") + 1
        children = np.bincount(parent[1:], minlength=count)
        first = np.concatenate([[0], np.cumsum(children)])
        base_of = np.zeros(count, dtype=np.int64)
        used = np.zeros(2 * count + 2 * width, dtype=bool)
        used[0] = True
        at = 1  # only goes on; what is left free behind it takes the nodes of one child
        for x in np.flatnonzero(children > 1)[np.argsort(-children[children > 1], kind="stable")].tolist():
            kids = order[first[x] : first[x + 1]]
            shift = symbol[kids] - symbol[kids[0]]
            look = 64
            while True:
                if at + look + width >= len(used):
                    used = np.concatenate([used, np.zeros(len(used) + look, dtype=bool)])
                places = at + np.flatnonzero(~used[at : at + look])
                fits = np.flatnonzero(~used[places[:, None] + shift].any(axis=1)) if len(places) else places
                if len(fits):
                    break
                at, look = at + look, min(look * 2, 4_096)
            at = int(places[fits[0]])
            base_of[x] = at - symbol[kids[0]]
            slot[kids] = at + shift
            used[slot[kids]] = True
        single = np.flatnonzero(children == 1)
        gaps = np.flatnonzero(~used)
        if len(gaps) < len(single):
            gaps = np.concatenate([gaps, len(used) + np.arange(len(single) - len(gaps))])
        kids = order[first[single]]
        slot[kids] = gaps[: len(single)]
        base_of[single] = slot[kids] - symbol[kids]
        size = int(slot.max()) + 1
        self.base, self.check, self.accept = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self.base[slot], self.check[slot[1:]] = base_of, slot[parent[1:]]
        self.leaf = np.zeros(size, dtype=bool)
        self.leaf[slot] = children == 0
        self.accept[slot[ends]] = np.arange(len(rows))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The states behind a symbol (-1: none the trie knows); -1 where there is none."""
        to = self.base[state] + symbol
        there = (symbol >= 0) & (to >= 0) & (to < len(self.check)) & ~self.leaf[state]
        to = np.where(there, to, 0)
        return np.where(there & (self.check[to] == state), to, -1)

    def count(self, texts: Texts) -> np.ndarray:
        """How often each phrase occurs."""
        symbol = pc.fill_null(pc.index_in(texts.distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)[texts.at]
        lang = pc.fill_null(pc.index_in(texts.langs, value_set=self.langs), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.zeros(np.count_nonzero(self.accept >= 0), dtype=np.int64), np.arange(len(symbol))
        state = self.step(np.zeros(len(lang), dtype=np.int64), lang)[texts.lang]
        for k in range(LONGEST):
            if k:
                on = (at + k < len(symbol)) & texts.joined[at + k - 1]
                at, state = at[on], state[on]
            at, state = at[state >= 0], state[state >= 0]
            state = self.step(state, symbol[at + k])
            at, state = at[state >= 0], state[state >= 0]
            accepted = self.accept[state]
            total += np.bincount(accepted[accepted >= 0], minlength=len(total))
        return total


def _trie_counts(docs: DataFrame, trie: Broadcast) -> DataFrame:
    """id and n of the trie's phrases. A task gives one packed row for each BLOCK of phrases that it has seen any of; blocks are summed as rows stream by."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                n = trie.value.count(Texts(batch.column(0)[a:b], batch.column(1)[a:b]))
                total = n if not len(total) else total + n
        some = np.flatnonzero(total)
        blocks = np.unique(some // BLOCK)
        bounds = np.searchsorted(some, np.append(blocks, blocks[-1:] + 1) * BLOCK)
        blobs = [(some[a:b] % BLOCK).astype("<u2").tobytes() + total[some[a:b]].astype("<i8").tobytes() for a, b in pairwise(bounds)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(blobs, pa.binary())], names=["block", "counts"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            at = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(open_ * BLOCK + at), pa.array(total[at])], names=["id", "n"])

        open_, total = None, np.zeros(BLOCK, dtype=np.int64)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != open_ and open_ is not None:
                    yield told()
                    total[:] = 0
                open_, n = block, len(blob) // 10
                total[np.frombuffer(blob, "<u2", n)] += np.frombuffer(blob, "<i8", n, 2 * n)
        if open_ is not None:
            yield told()

    packed = docs.mapInArrow(of, "block long, counts binary")
    return packed.repartition("block").sortWithinPartitions("block").mapInArrow(sums, "id long, n long")


def phrase_counts(docs: DataFrame, least: int, trie_phrases: int = TRIE_PHRASES, set_bits: int = SET_BITS) -> tuple[DataFrame, DataFrame]:
    """Of docs with lang and text: (lang, n) with all words counted, and (lang, phrase, n) of all phrases of 1 to 5 words that occur `least` times."""
    spark = docs.sparkSession
    words = written(_each(docs, _words, "lang string, word string, key long, n long").groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n")), "phrase-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    held = spark.sparkContext.broadcast(_set(often.select("key"), set_bits))
    pairs = _each(docs, _pair_counts(held), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = spark.sparkContext.broadcast(_set(pairs.select("pair"), set_bits))
    held.unpersist()
    blocks = max(LEAST_BLOCKS, (totals.agg(F.sum("n")).first()[0] or 0) // 500_000)  # in proportion to the corpus
    candidates = _window_counts(docs, found, blocks, least)
    candidates = written(candidates.withColumn("h", F.xxhash64("lang", "phrase")), "phrase-candidates")
    found.unpersist()
    tries = -(-candidates.count() * 5 // (trie_phrases * 4))  # a quarter of room for uneven hashes
    counted = often.select("lang", F.col("word").alias("phrase"), "n")
    if tries > TRIES:
        counted = counted.unionByName(candidates.where(F.pmod("h", F.lit(tries)) >= TRIES).select("lang", "phrase", "n"))
    for part in range(min(tries, TRIES)):
        mine = candidates.where(F.pmod("h", F.lit(tries)) == part).select("lang", "phrase").toArrow()
        phrases = list(zip(mine.column(0).to_pylist(), mine.column(1).to_pylist()))
        if not phrases:
            continue
        trie = spark.sparkContext.broadcast(Trie(phrases))
        named = spark.createDataFrame(pa.table({"id": pa.array(range(len(phrases)), pa.int64()), "lang": mine.column(0), "phrase": mine.column(1)}))
        counts = written(named.join(_trie_counts(docs, trie), "id").select("lang", "phrase", "n"), "phrase-counts")
        trie.unpersist()
        counted = counted.unionByName(counts)
    counted = written(counted.where(F.col("n") >= least), "phrase-frequent")
    dropped(candidates)
    return totals, counted


def _part(words: Column, first: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, first, length), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, top: int = 2_000, trie_phrases: int = TRIE_PHRASES, set_bits: int = SET_BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of 2 to 5 words that occur `least` times.

    The score of a cut is floor(1000 a n / (l r)), in decimals of 38 digits; a phrase has that of its lowest cut, the earliest
    of equal ones. A phrase inside a longer one that occurs as often is dropped. A null language is `und`; null and empty
    texts have no words; repeated rows count each; an empty table gives no rows. Other columns aren't looked at.
    """
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    totals, counted = phrase_counts(texts, least, trie_phrases, set_bits)
    words = F.split("phrase", " ")
    phrases = counted.withColumnRenamed("n", "a").withColumn("words", words).where(F.size("words") > 1)
    # what lies inside a longer phrase, and how often the most frequent one of those occurs
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("words") - k + 1), lambda i: F.array_join(F.slice("words", i, k), " "))))
    covered = phrases.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    alone = phrases.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = alone.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("head"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    heads, tails = (counted.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)) for side, name in (("head", "l"), ("tail", "r")))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    score = F.expr("(cast(a AS decimal(18,0)) * cast(n AS decimal(16,0)) * 1000) div (cast(l AS decimal(18,0)) * cast(r AS decimal(18,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
