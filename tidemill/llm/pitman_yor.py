"""A hierarchical Pitman-Yor language model over all words of a corpus, and the scores it gives to texts.

The root restaurant holds words; a restaurant for each class of the word before (by its last two letters) has the root as
its parent, and a restaurant of the word before has its class as its parent, so all contexts share the root. Restaurants
of words go by class and hash, one for every `chars_per_restaurant` characters of the corpus: frequent words have one
almost to themselves, rare ones of a class sit together, and their number grows with the input. Seating is
summed up by the tables of each word in each restaurant. A Gibbs sweep draws a word's tables in every restaurant given its
parent's probability (by the weights of generalised Stirling numbers, at any number of customers), from the words before up
to the root; a restaurant's customers are the tables below it. Totals of the root and the classes come from the pass before, those of a word's restaurant from the seating with one table a word.
Retained sweeps each give a seating, and their mean is the model; it sums to one over all words and an unseen one.

Distribution: texts are packed into chunks, whose words are numbered within the chunk in the order of their hashes. The
range of hashes is cut into buckets; a chunk's counts of pairs go to the bucket of the pair's second word as one packed
row, are summed there as they stream by, and the answers go back in the same way. A pair seen once has one table and needs
no draw, so a bucket's table holds such pairs as a number for each word and class, and lists only those seen more often or
asked for by a chunk that didn't learn them. What a restaurant of words holds goes from the buckets of its followers to
its own bucket and back. A task holds the distinct pairs of one bucket, and buckets grow in number with the characters of
the corpus; the distinct restaurants that one word sits in are in one bucket.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import dropped, fold, mixed, slices, uniform, word_column, word_hashes, written

#: Context classes (0: start of a text), characters of a chunk.
CLASSES, CHUNK_CHARS = 32, 14_000_000
#: Tables whose weights are summed up one by one; customers, each with weights of its own, and octaves above them.
WIDEST, ROWS, OCTAVES = 512, 2_048, 33
LOG_FACTORIALS = np.array([math.lgamma(t + 1) for t in range(WIDEST)])
#: Characters of the corpus for each bucket, where there are not more shuffle partitions.
BUCKET_CHARS = 4_000_000
#: Stands for the end of a text among the hashes of words.
END = np.uint64(0x0123456789ABCDEF)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed run of bytes, by planes of bytes of one rank: sorted hashes and small counts get short."""
    head = struct.pack(f"<{len(arrays)}q", *map(len, arrays))
    planes = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    return head + pa.compress(planes, codec="zstd", asbytes=True)


def loosened(blob: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of `squeezed`, given their types."""
    sizes, types = struct.unpack_from(f"<{len(kinds)}q", blob), [np.dtype(k) for k in kinds]
    total = sum(n * t.itemsize for n, t in zip(sizes, types))
    raw = np.frombuffer(pa.decompress(blob[8 * len(kinds) :], total, codec="zstd") if total else b"", dtype=np.uint8)
    out, at = [], 0
    for n, t in zip(sizes, types):
        out.append(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T.copy().view(t).reshape(n))
        at += n * t.itemsize
    return out


#: Types of what a chunk asks of a bucket: words, their classes, pairs of each, the restaurants, customers.
ASKED = ("<u8", "u1", "<u4", "<u8", "<u8")
#: Types of a bucket's table: words, classes of each, classes, pairs seen once, listed pairs of each class; of the listed
#: pairs, the restaurant, customers, and tables of that restaurant (0 where customers are fewer than 2).
TABLE = ("<u8", "u1", "u1", "<u8", "<u8", "<u8", "<u8", "<u8")


def rounded(x: np.ndarray) -> np.ndarray:
    """32-bit numbers to 15 bits behind the point (0.0015 %): their last byte is zero and takes no room."""
    return ((np.ascontiguousarray(x, dtype="<f4").view("<u4") + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view("<f4")


def stepped(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Steps from value to value within runs of lengths n (each of one or more, ascending); a run's first value stays."""
    out = np.diff(values, prepend=values[:1])
    starts = np.cumsum(n) - n
    out[starts] = values[starts]
    return out


def unstepped(steps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The values of `stepped`."""
    n = n.astype(np.int64)
    run = np.cumsum(steps, dtype=steps.dtype)
    starts = np.cumsum(n) - n
    return run - np.repeat(run[starts] - steps[starts], n)


@dataclass(frozen=True)
class Layout:
    """How words are dealt out: buckets by the upper `bits` of the hash; restaurants by class and the same bits."""

    buckets: int
    bits: int

    def upper(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits)

    def bucket(self, upper: np.ndarray) -> np.ndarray:
        """Number of the bucket; ascending with the hash."""
        return (upper * np.uint64(self.buckets) >> np.uint64(self.bits)).astype(np.int64)

    def named(self, upper: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Names of the restaurants of words."""
        return kinds.astype(np.uint64) << np.uint64(self.bits) | upper

    def home(self, names: np.ndarray) -> np.ndarray:
        """Number of the bucket of the words that a restaurant is named after."""
        return self.bucket(names & np.uint64((1 << self.bits) - 1))

    def kind(self, names: np.ndarray) -> np.ndarray:
        return (names >> np.uint64(self.bits)).astype(np.int64)


def layout_of(chars: int, partitions: int, chars_per_restaurant: int) -> Layout:
    """Buckets and restaurants for a corpus of so many characters."""
    buckets = max(partitions, -(-chars // BUCKET_CHARS))
    least = buckets.bit_length() + 3
    return Layout(buckets, min(40, max(least, (chars // (CLASSES * chars_per_restaurant)).bit_length())))


def pack(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct tokens, the class of each as a context; each token's number and that of the token before; tokens per text.

    The end of a text stands before the first word of the next one and of the first: as a context it is the start.
    """
    column, at, counts = word_column(texts, lower=True)
    hashes = np.concatenate([[END], word_hashes(column)])
    ending = word_hashes(pc.utf8_slice_codeunits(column, -2, None).cast(pa.large_string())) if len(column) else np.zeros(0, dtype=np.uint64)
    kinds = np.concatenate([[0], 1 + (ending % np.uint64(CLASSES - 1)).astype(np.int64)])
    order = np.argsort(hashes, kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    ids = number[np.insert(at.astype(np.int32) + 1, np.cumsum(counts), 0)]
    return hashes[order], kinds[order].astype(np.uint8), ids, before(ids, number[0]), counts + 1


def before(ids: np.ndarray, end: int) -> np.ndarray:
    """Each token's token before."""
    out = np.full(len(ids), end, dtype=ids.dtype)
    out[1:] = ids[:-1]
    return out


@dataclass
class Totals:
    """Of the upper restaurants: customers of each class, tables of each class, of the root, and the vocabulary's size."""

    customers: np.ndarray
    tables: np.ndarray
    root: float
    words: int
    tokens: int
    discount: float
    root_discount: float
    strength: float = 1.0
    pair_discount: float = 0.5

    def unseen(self) -> float:
        """The root's probability of each word it has no table for: the base is uniform over the words and one more."""
        return (self.strength + self.root_discount * self.root) / (self.words + 1) / (self.strength + self.tables.sum())

    def spare(self) -> np.ndarray:
        """What each context hands to its parent, not yet divided by its customers."""
        return self.strength + self.discount * self.tables


@lru_cache(maxsize=8)
def thinned(discount: float) -> np.ndarray:
    """Logarithms of Q(c, t), one row for each count c of customers up to ROWS and then for each quarter of an octave, t up to WIDEST.

    The generalised Stirling numbers S(c, t), which weigh the ways to seat c customers at t tables, are S(c, 1) Q(c, t) /
    (discount^(t-1) (t-1)!). Their recurrence makes Q(c + 1, t) a mean of Q(c, t) and Q(c, t - 1), the latter with weight
    a = discount (t - 1) / (c - discount): each of t - 1 things dies at a rate that falls with c. So over many customers at
    once Q(c', t) is the mean of Q(c, 1 + survivors), survivors being binomial.
    """
    t = np.arange(WIDEST + 1)
    q = np.where(t == 1, 1.0, 0.0)
    logs = np.full((ROWS + 1 + 4 * OCTAVES, WIDEST + 1), -1e30, dtype=np.float32)

    def kept(row: int) -> None:
        there = q > 0
        logs[row, there] = np.log(q[there])

    kept(1)
    for c in range(1, ROWS):
        a = discount * (t - 1) / (c - discount)
        q = q + a * (np.roll(q, 1) - q)
        q[0] = 0
        q[c + 2 :] = 0  # no more tables than customers
        kept(c + 1)
    gammas = np.array([math.lgamma(x + 1) for x in range(WIDEST + 1)])
    n, k = t[1:, None] - 1, t[None, 1:] - 1
    choose = np.where(k <= n, gammas[n] - gammas[np.minimum(k, n)] - gammas[np.maximum(n - k, 0)], -np.inf)
    c = float(ROWS)
    for step in range(1, 4 * OCTAVES + 1):
        new = ROWS * 2.0 ** (step / 4)
        # the chance to outlive all customers from c to new: a product of 1 - discount / (i - discount)
        live = discount * math.log((c - 1.5 * discount - 0.5) / (new - 1.5 * discount - 0.5))
        q = np.concatenate([[0.0], np.exp(choose + k * live + (n - k) * math.log(-math.expm1(live))) @ q[1:]])
        kept(ROWS + step)
        c = new
    return logs


def _few(customers: np.ndarray, log_mean: np.ndarray, u: np.ndarray, logs: np.ndarray, width: int) -> np.ndarray:
    """Tables by inverting the sum of the weights of 1 to `width` tables."""
    octave = 4 * np.log2(np.maximum(customers, ROWS) / ROWS)
    low = np.minimum(octave.astype(np.int64), 4 * OCTAVES - 1)
    row = np.minimum(customers, ROWS) + low
    t = np.arange(width)
    weight = logs[row, 1 : width + 1].astype(np.float64)
    far = np.flatnonzero(customers > ROWS)
    if len(far):
        part = (octave - low)[far, None]
        weight[far] = (1 - part) * weight[far] + part * logs[row[far] + 1, 1 : width + 1]
    weight = weight + log_mean[:, None] * t - LOG_FACTORIALS[:width]
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return 1 + (weight < (u * weight[:, -1])[:, None]).sum(axis=1).clip(max=width - 1)


def _many(customers: np.ndarray, mass: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the tables where they are many: a Poisson number of tables given the sum of their sizes.

    A table's size is Sibuya's, whose generating function is 1 - (1 - x)^discount; x is such that the sum's mean is the
    number of customers, the law is normal but for a shift of less than one table.
    """
    log_s = np.full(len(customers), -1e-3)  # of 1 - x, by Newton's steps on a concave function
    target = np.log(customers) - np.log(mass)
    for _ in range(60):
        s = np.exp(log_s)
        off = np.log1p(-s) - (1 - discount) * log_s - target
        log_s = np.minimum(log_s + off / (s / (1 - s) + 1 - discount), 0.5 * log_s)
    s, d = np.exp(log_s), discount
    x, f = 1 - s, -np.expm1(d * log_s)
    one, two, three = d * s ** (d - 1), d * (1 - d) * s ** (d - 2), d * (1 - d) * (2 - d) * s ** (d - 3)  # derivatives of f
    m1, m2, m3 = x * one / f, (x * one + x * x * two) / f, (x * one + 3 * x * x * two + x**3 * three) / f
    mean = mass / d * f
    return mean + np.clip((m1 * m3 / m2**2 - 1) / 2, -1, 1), np.sqrt(mean * (1 - m1 * m1 / m2))


def draw_tables(customers: np.ndarray, mass: np.ndarray, discount: float, key: np.ndarray, counter: int) -> np.ndarray:
    """Tables of one word in one restaurant given its customers; mass: (strength + discount * tables) * parent's probability.

    The chance of t tables is in proportion to S(c, t) mass^t, that of a Poisson number of mean mass / discount beside the
    first one, weighed by Q(c, t). Up to WIDEST tables the weights are summed up, for any number of customers; where 256 or
    more are to be expected and more than WIDEST possible, the law is taken as the normal one of its mean and spread.
    """
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    if not len(at):
        return tables
    n, u = customers[at], uniform(key[at], counter)
    mean = np.maximum(mass[at], 1e-300) / discount
    width = np.minimum(n, np.ceil(mean + 8 * np.sqrt(mean) + 14)).astype(np.int64)
    wide = np.flatnonzero(width > WIDEST)
    out = np.zeros(len(at), dtype=np.int64)
    if len(wide):
        most, spread = _many(n[wide], mass[at][wide], discount)
        bulk = most > 256
        normal = np.sqrt(-2 * np.log(uniform(key[at][wide], counter + (1 << 20)))) * np.cos(2 * np.pi * u[wide])
        out[wide[bulk]] = np.clip(np.rint(most + spread * normal), 1, n[wide])[bulk].astype(np.int64)
        width[wide] = np.where(bulk, 0, WIDEST)
    logs, log_mean = thinned(discount), np.log(mean)
    least = 0
    for most in (2, 4, 8, 16, 24, 32, 64, 128, 256, WIDEST):
        mine = np.flatnonzero((width > least) & (width <= most))
        for part in (mine[i : i + 200_000 // most] for i in range(0, len(mine), 200_000 // most)):
            out[part] = _few(n[part], log_mean[part], u[part], logs, most)
        least = most
    tables[at] = out
    return tables


def sweeps(words: np.ndarray, row: np.ndarray, context: np.ndarray, customers: np.ndarray, totals: Totals, burn: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Retained seatings: tables of each (word, context), customers and tables of each word at the root."""
    key, root_key = mixed(words[row] + context.astype(np.uint64)), mixed(words ^ END)
    spare, all_tables = totals.spare(), totals.tables.sum()
    parent = np.bincount(row, customers, len(words)) / max(totals.tokens, 1)
    for sweep in range(burn + keep):
        tables = draw_tables(customers, spare[context] * parent[row], totals.discount, key, sweep)
        below = np.bincount(row, tables, len(words)).astype(np.int64)
        root_mass = (totals.strength + totals.root_discount * totals.root) / (totals.words + 1)
        root = draw_tables(below, np.full(len(words), root_mass), totals.root_discount, root_key, sweep)
        parent = (below - totals.root_discount * root + root_mass) / (totals.strength + all_tables)
        if sweep >= burn:
            yield tables, below, root


@dataclass
class Table:
    """One bucket: words; their classes (row, context, pairs seen once); listed pairs (place of the class, restaurant, customers, its tables)."""

    words: np.ndarray
    row: np.ndarray
    context: np.ndarray
    singles: np.ndarray
    cell: np.ndarray
    names: np.ndarray
    customers: np.ndarray
    tables: np.ndarray

    @classmethod
    def unpacked(cls, blob: bytes) -> Table:
        words, n, context, singles, listed, names, customers, tables = loosened(blob, *TABLE)
        return cls(words, np.repeat(np.arange(len(words)), n), context.astype(np.int64), singles.astype(np.int64), np.repeat(np.arange(len(context)), listed.astype(np.int64)), names, customers.astype(np.int64), tables.astype(np.int64))

    def packed(self) -> bytes:
        n, listed = np.bincount(self.row, minlength=len(self.words)), np.bincount(self.cell, minlength=len(self.context))
        return squeezed(*(np.asarray(x).astype(k) for x, k in zip((self.words, n, self.context, self.singles, listed, self.names, self.customers, self.tables), TABLE)))

    def drawn(self) -> np.ndarray:
        """Places of the listed pairs with more than one customer."""
        return np.flatnonzero(self.customers > 1)

    def whole(self) -> np.ndarray:
        """Customers of each word in all."""
        at = self.drawn()
        return (np.bincount(self.row, self.singles, len(self.words)) + np.bincount(self.row[self.cell[at]], self.customers[at], len(self.words))).astype(np.int64)

    def wanted(self, layout: Layout) -> np.ndarray:
        """Names of the restaurants whose tables the draws need, by their bucket."""
        names = np.unique(self.names[self.drawn()])
        return names[np.argsort(layout.home(names), kind="stable")]

    def sweeps(self, totals: Totals, burn: int, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Retained seatings: tables of each drawn pair; customers and tables of each class; customers and tables of each word at the root."""
        at = self.drawn()
        cell, customers = self.cell[at], self.customers[at]
        pair_key, key, root_key = mixed(self.words[self.row[cell]] ^ mixed(self.names[at])), mixed(self.words[self.row] + self.context.astype(np.uint64)), mixed(self.words ^ END)
        own_spare, spare, all_tables = totals.strength + totals.pair_discount * self.tables[at], totals.spare(), totals.tables.sum()
        parent = self.whole() / max(totals.tokens, 1)
        of_class = parent[self.row]
        for sweep in range(burn + keep):
            pairs = draw_tables(customers, own_spare * of_class[cell], totals.pair_discount, pair_key, sweep)
            seated = self.singles + np.bincount(cell, pairs, len(self.context)).astype(np.int64)
            tables = draw_tables(seated, spare[self.context] * parent[self.row], totals.discount, key, sweep)
            below = np.bincount(self.row, tables, len(self.words)).astype(np.int64)
            root_mass = (totals.strength + totals.root_discount * totals.root) / (totals.words + 1)
            root = draw_tables(below, np.full(len(self.words), root_mass), totals.root_discount, root_key, sweep)
            parent = (below - totals.root_discount * root + root_mass) / (totals.strength + all_tables)
            of_class = (seated - totals.discount * tables + spare[self.context] * parent[self.row]) / (totals.strength + totals.customers[self.context])
            if sweep >= burn:
                yield pairs, seated, tables, below, root


def _numbered(upper: np.ndarray, kinds: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Distinct names of the restaurants of a chunk's words, and each word's place among them."""
    return np.unique(layout.named(upper, kinds), return_inverse=True)


def _chunks(folds: int, held_out: int, layout: Layout):
    """Rows of two kinds: a chunk's texts (bucket -1), and what it counts and asks of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            ids, part = batch["doc_id"].to_pylist(), batch["part"][0].as_py() if len(batch) else 0
            for a, b in slices(batch["text"], CHUNK_CHARS):
                hashes, kinds, tokens, last, counts = pack(batch["text"].slice(a, b - a))
                upper = layout.upper(hashes)
                names, place = _numbered(upper, kinds, layout)
                held = np.array([fold(i, folds) == held_out for i in ids[a:b]])
                known = np.array([i is not None for i in ids[a:b]])
                steps = np.diff(upper, prepend=np.uint64(0))
                head = squeezed(np.array([i or 0 for i in ids[a:b]], dtype="<i8"), known.astype("u1"), held.astype("u1"), counts.astype("<i8"), tokens.astype("<u4"), kinds, steps)
                pairs = tokens.astype(np.int64) * len(names) + place[last]
                del tokens, last
                taught = np.sort(pairs[~np.repeat(held, counts)])
                pair = np.unique(pairs)
                del pairs
                learnt = (np.searchsorted(taught, pair, side="right") - np.searchsorted(taught, pair, side="left")).astype("<u8")
                del taught
                word, own = np.divmod(pair, len(names))
                n = np.bincount(word, minlength=len(hashes)).astype("<u4")
                cuts = np.searchsorted(layout.bucket(upper), np.arange(layout.buckets + 1))
                edges = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[cuts]
                full = np.flatnonzero(np.diff(cuts))
                blobs = []
                for k in full.tolist():
                    w, c = slice(cuts[k], cuts[k + 1]), slice(edges[k], edges[k + 1])
                    blobs.append(squeezed(hashes[w], kinds[w], n[w], stepped(names[own[c]], n[w].astype(np.int64)), learnt[c]))
                yield pa.record_batch({
                    "chunk": np.full(len(full) + 1, part << 32 | number), "bucket": np.concatenate([[-1], full]).astype(np.int32), "at": np.concatenate([[0], edges[full]]).astype(np.int64), "blob": pa.array([head, *blobs], pa.binary()),
                })
                number += 1

    return run


def _compact(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, names, customers and whether a chunk asks without having learnt, over equal words and names, in order."""
    words, names, customers, open_ = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((names, words))
    words, names, customers, open_ = words[order], names[order], customers[order], open_[order]
    heads = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (names[1:] != names[:-1])]))
    return words[heads], names[heads], np.add.reduceat(customers, heads), np.logical_or.reduceat(open_, heads)


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"bucket": pa.array([r[0] for r in rows], pa.int32()), "peer": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _posted(names: np.ndarray, values: list[np.ndarray], layout: Layout, sender: int) -> list[tuple[int, int, bytes]]:
    """One row for each bucket that names are at home in; names come sorted by it."""
    cuts = np.searchsorted(layout.home(names), np.arange(layout.buckets + 1))
    return [(k, sender, squeezed(names[cuts[k] : cuts[k + 1]], *(v[cuts[k] : cuts[k + 1]] for v in values))) for k in np.flatnonzero(np.diff(cuts)).tolist()]


def _summed(layout: Layout):
    """A table for each bucket (peer -1), and to the bucket of every restaurant: its distinct words and customers here, and whether its tables are wanted."""

    def result(bucket: int, parts: list) -> pa.RecordBatch:
        words, names, customers, open_ = _compact(parts)
        seen = customers > 0
        words, names, customers, open_ = words[seen], names[seen], customers[seen], open_[seen]
        context = layout.kind(names)
        distinct, at = np.unique(words, return_inverse=True)
        classes, cell = np.unique(at * CLASSES + context, return_inverse=True)
        singles = np.bincount(cell, customers == 1, len(classes)).astype(np.int64)
        listed = (customers > 1) | open_
        table = Table(distinct, classes // CLASSES, classes % CLASSES, singles, cell[listed], names[listed], customers[listed], np.zeros(int(listed.sum())))
        order = np.argsort(names, kind="stable")
        restaurants, first, types = np.unique(names[order], return_index=True, return_counts=True)
        here = np.add.reduceat(customers[order], first) if len(first) else first
        want = np.isin(restaurants, table.wanted(layout))
        order = np.argsort(layout.home(restaurants), kind="stable")
        return _rows([(bucket, -1, table.packed()), *_posted(restaurants[order], [types[order].astype("<u8"), here[order].astype("<u8"), want[order].astype("u1")], layout, bucket)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bucket, parts, held, limit = None, [], 0, 2_000_000
        for batch in batches:
            for bucket, blob in zip(batch["bucket"].to_pylist(), batch["blob"]):
                if bucket != open_bucket and open_bucket is not None:
                    yield result(open_bucket, parts)
                    parts, held, limit = [], 0, 2_000_000
                open_bucket = bucket
                words, _, n, names, customers = loosened(blob.as_py(), *ASKED)
                parts.append((np.repeat(words, n), unstepped(names, n), customers.astype(np.int64), customers == 0))
                held += len(names)
                if held > limit:
                    parts = [_compact(parts)]
                    held = len(parts[0][0])
                    limit = 2_000_000 + 2 * held
        if open_bucket is not None:
            yield result(open_bucket, parts)

    return run


def _by_bucket(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The rows of each bucket, from rows that come sorted by it."""
    open_bucket, held = None, []
    for bucket, peer, blob in rows:
        if bucket != open_bucket and held:
            yield open_bucket, held
            held = []
        open_bucket = bucket
        held.append((peer, blob))
    if held:
        yield open_bucket, held


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        for bucket, peer, blob in zip(batch["bucket"].to_pylist(), batch["peer"].to_pylist(), batch["blob"]):
            yield bucket, peer, blob.as_py()


def _restaurants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Customers of each restaurant of a bucket, and its tables with one table a word (peer -2), and for each bucket that wants some, those tables."""
    for bucket, held in _by_bucket(_each(batches)):
        parts = [(peer, *loosened(blob, "<u8", "<u8", "<u8", "u1")) for peer, blob in held]
        names, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        tables, customers = np.zeros(len(names), dtype="<u8"), np.zeros(len(names), dtype="<u8")
        np.add.at(tables, place, np.concatenate([p[2] for p in parts]))
        np.add.at(customers, place, np.concatenate([p[3] for p in parts]))
        rows = [(bucket, -2, squeezed(names, tables, customers))]
        for peer, asked, _, _, want in parts:
            if want.any():
                rows.append((peer, bucket, squeezed(tables[np.searchsorted(names, asked[want > 0])])))
        yield _rows(rows)


def _seated(layout: Layout):
    """Each bucket's table with the tables of the restaurants that its draws need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(_each(batches)):
            table = Table.unpacked(held[0][1])
            names, at = table.wanted(layout), table.drawn()
            if len(at):
                found = np.concatenate([loosened(blob, "<u8")[0] for _, blob in held[1:]])
                order = np.argsort(names)
                table.tables[at] = found[order[np.searchsorted(names[order], table.names[at])]]
            yield _rows([(bucket, -1, table.packed())])

    return run


def _gathered(counts: DataFrame, totals: Totals, burn: int, keep: int) -> list[Totals]:
    """Totals of each retained sweep, summed over all words; each task gives one row for a sweep and restaurant."""
    width = 2 * CLASSES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((keep, width))
        for blob in (x for batch in batches for x in batch["blob"]):
            table = Table.unpacked(blob.as_py())
            for s, (_, seated, tables, _, root) in enumerate(table.sweeps(totals, burn, keep)):
                sums[s, :CLASSES] += np.bincount(table.context, seated, CLASSES)
                sums[s, CLASSES : 2 * CLASSES] += np.bincount(table.context, tables, CLASSES)
                sums[s, -1] += root.sum()
        sweep, place = np.divmod(np.arange(sums.size), width)
        yield pa.record_batch({"sweep": sweep.astype(np.int32), "place": place.astype(np.int32), "n": sums.reshape(-1)})

    sums = np.zeros((keep, width))
    for r in counts.mapInArrow(run, "sweep int, place int, n double").groupBy("sweep", "place").agg(F.sum("n").alias("n")).collect():
        sums[r.sweep, r.place] = r.n
    return [replace(totals, customers=s[:CLASSES], tables=s[CLASSES : 2 * CLASSES], root=float(s[-1])) for s in sums]


def _start(counts: DataFrame) -> Totals:
    """Totals before any seating: one table a word everywhere; discounts from the words with one and two customers then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 2))
        rest = np.zeros(8)
        for blob in (x for batch in batches for x in batch["blob"]):
            table = Table.unpacked(blob.as_py())
            at = table.drawn()
            types = table.singles + np.bincount(table.cell[at], minlength=len(table.context))
            below = np.bincount(table.row, minlength=len(table.words))
            sums += np.stack([np.bincount(table.context, types, CLASSES), np.bincount(table.context, minlength=CLASSES)], axis=1)
            rest += [table.whole().sum(), len(table.words), table.singles.sum(), (table.customers[at] == 2).sum(), (types == 1).sum(), (types == 2).sum(), (below == 1).sum(), (below == 2).sum()]
        n = np.concatenate([sums.reshape(-1), rest])
        yield pa.record_batch({"place": np.arange(len(n), dtype=np.int32), "n": n})

    sums = np.zeros(2 * CLASSES + 8)
    for r in counts.mapInArrow(run, "place int, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
        sums[r.place] = r.n
    discount = lambda one, two: float(np.clip((one + 1) / (one + 2 * two + 2), 0.1, 0.95))
    classes, (tokens, words, *seen) = sums[: 2 * CLASSES].reshape(CLASSES, 2), sums[2 * CLASSES :].tolist()
    return Totals(classes[:, 0], classes[:, 1], words, int(words), int(round(tokens)), discount(*seen[2:4]), discount(*seen[4:6]), pair_discount=discount(*seen[:2]))


def scored(docs: DataFrame, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", passes: int = 2, burn: int = 2, keep: int = 3, chars_per_restaurant: int = 8192) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are the words in lower case (A-Z) and one end. The model learns from all rows outside the held-out fold.
    base_score: sum of log10((c + 0.1) / (N + 0.1 * (V + 1))); score: the model's log10 probability of the tokens, all
    words that training doesn't know sharing the place of one. Null texts count as empty; null ids are of the fold of the
    empty string; repeated rows stay and each counts. If nothing is learnt, V and N are 0 and each token gets the
    uniform base. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))
    layout = layout_of(rows.agg(F.sum(F.length("text"))).first()[0] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars_per_restaurant)
    fields = "chunk long, bucket int, at long, blob binary"
    chunks = written(rows.mapInArrow(_chunks(folds, held_out, layout), fields), "model-chunks")

    asked = chunks.where("bucket >= 0")
    mail = "bucket int, peer int, blob binary"
    by_bucket = asked.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
    counts = written(by_bucket.mapInArrow(_summed(layout), mail), "model-counts")
    posted = counts.where("peer >= 0").repartition("bucket").sortWithinPartitions("bucket", "peer")
    restaurants = written(posted.mapInArrow(_restaurants, mail), "model-restaurants")
    joined = counts.where("peer = -1").unionByName(restaurants.where("peer >= 0")).repartition("bucket").sortWithinPartitions("bucket", "peer")
    summed, counts = counts, written(joined.mapInArrow(_seated(layout), mail), "model-tables")
    dropped(summed)
    totals = _start(counts)
    for _ in range(passes):
        totals = _gathered(counts, totals, burn, 1)[0]
    retained = _gathered(counts, totals, burn, keep)

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To the bucket of each word before: its restaurant's tables beyond one a word, over the retained sweeps."""
        for bucket, _, blob in _each(batches):
            table = Table.unpacked(blob)
            at = table.drawn()
            extra = sum(pairs - 1 for pairs, *_ in table.sweeps(totals, burn, keep))
            names, place = np.unique(table.names[at], return_inverse=True)
            extra = np.bincount(place, extra, len(names))
            order = np.argsort(layout.home(names), kind="stable")
            order = order[extra[order] > 0]
            rows = _posted(names[order], [extra[order].astype("<u8")], layout, bucket)
            if rows:
                yield _rows(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each chunk asks; a bucket's table, restaurants and what is added to them come before the chunks' rows.

        Of each word: customers, and tables and customers of its restaurant; of each pair: what is seated, less the
        discount; of each word and class: the class's probability.
        """
        open_bucket = None
        for batch in batches:
            out: list[tuple[int, int, bytes]] = []
            for bucket, chunk, at, blob in zip(*(batch[c].to_pylist() for c in ("bucket", "chunk", "at")), batch["blob"]):
                blob = blob.as_py()
                if bucket != open_bucket:
                    open_bucket, table = bucket, Table.unpacked(Table(*(np.zeros(0, dtype=np.int64) for _ in range(8))).packed())
                    names, own_tables, own_customers = np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype="<u8")
                    roots, of_class, left, keys, ready = None, None, None, None, False
                if chunk == -3:
                    table = Table.unpacked(blob)
                    continue
                if chunk == -2:
                    names, own_tables, own_customers = loosened(blob, "<u8", "<u8", "<u8")
                    own_tables = own_tables.astype(np.float64)
                    continue
                if chunk == -1:
                    added, extra = loosened(blob, "<u8", "<u8")
                    own_tables[np.searchsorted(names, added)] += extra / keep
                    continue
                if not ready:
                    ready, whole, drawn = True, table.whole(), table.drawn()
                    sat, p, r = np.zeros(len(drawn)), np.zeros(len(table.context)), np.zeros((keep, len(table.words)))
                    for s, ((pairs, seated, tables, below, root), t) in enumerate(zip(table.sweeps(totals, burn, keep), retained)):
                        sat += pairs / keep
                        r[s] = (below - t.root_discount * root + (t.strength + t.root_discount * t.root) / (t.words + 1)) / (t.strength + t.tables.sum())
                        p += (seated - t.discount * tables) / (t.strength + t.customers[table.context]) / keep
                    of_class, roots, unseen = p, r, np.array([t.unseen() for t in retained])
                    left = np.where(table.customers > 0, 1 - totals.pair_discount, 0.0)
                    left[drawn] = table.customers[drawn] - totals.pair_discount * sat
                    keys = mixed(table.words[table.row[table.cell]] ^ mixed(table.names))
                    order = np.argsort(keys)
                    keys, left = keys[order], left[order]
                    codes = table.row * CLASSES + table.context
                words, kinds, n, before_, learnt = loosened(blob, *ASKED)
                before_ = unstepped(before_, n)
                slot, has = found(table.words, words)
                count = np.where(has, whole[slot] if len(whole) else 0, 0)
                place, known = found(names, layout.named(layout.upper(words), kinds))
                own, guests = (np.where(known, x[place] if len(names) else 0, 0) for x in (own_tables, own_customers))
                row = np.repeat(np.arange(len(words)), n)
                place, listed = found(keys, mixed(words[row] ^ mixed(before_)))
                seat = np.where(listed, left[place] if len(keys) else 0, np.where(learnt > 0, 1 - totals.pair_discount, 0.0))
                asked_classes = np.unique(row * CLASSES + layout.kind(before_))
                w, k = asked_classes // CLASSES, asked_classes % CLASSES
                place, there = found(codes, np.where(has[w], slot[w] * CLASSES + k, -1))
                root = np.where(has[w], roots[:, slot[w]] if len(whole) else 0, unseen[:, None])
                p = np.where(there, of_class[place] if len(codes) else 0, 0) + (handed[:, k] * root).mean(axis=0)
                out.append((chunk, at, squeezed(count.astype("<u8"), rounded(own), guests.astype("<u8"), rounded(seat), rounded(p))))
            yield pa.record_batch({"asker": pa.array([x[0] for x in out], pa.int64()), "at": pa.array([x[1] for x in out], pa.int64()), "answer": pa.array([x[2] for x in out], pa.binary())})

    def found(inside: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the sought values among sorted ones, and whether they are there."""
        place = np.minimum(np.searchsorted(inside, sought), max(len(inside) - 1, 0))
        return place, inside[place] == sought if len(inside) else np.zeros(len(sought), dtype=bool)

    handed = np.stack([t.spare() / (t.strength + t.customers) for t in retained])  # sweep, class: the root's weight
    told = [
        frame.select("bucket", F.lit(order).cast("long").alias("chunk"), F.lit(0).cast("long").alias("at"), "blob")
        for order, frame in ((-3, counts), (-2, restaurants.where("peer = -2")), (-1, counts.mapInArrow(more, mail)))
    ]
    met = reduce(DataFrame.unionByName, [*told, asked]).repartition("bucket").sortWithinPartitions("bucket", "chunk")
    answers = met.mapInArrow(answer, "asker long, at long, answer binary")

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        result = {"doc_id": [], "held_out": [], "n_tokens": [], "n_known": [], "train_tokens": [], "base_score": [], "score": []}
        for blob in chunk["blob"].to_pylist():
            ids, known, held, sizes, tokens, kinds, steps = loosened(blob, "<i8", "u1", "u1", "<i8", "<u4", "u1", "<u8")
            parts = sorted(zip(answers["at"].to_pylist(), answers["answer"].to_pylist()))
            counts, tables, guests, seat, of_class = (np.concatenate(x) for x in zip(*(loosened(x, "<u8", "<f4", "<u8", "<f4", "<f4") for _, x in parts)))
            tokens = tokens.astype(np.int64)
            names, place = _numbered(np.cumsum(steps, dtype=np.uint64), kinds, layout)
            starts = np.cumsum(sizes) - sizes
            last = before(tokens, tokens[sizes[0] - 1])
            pairs, classes = tokens * len(names) + place[last], tokens * CLASSES + kinds[last]
            c = counts[tokens].astype(np.int64)
            known_words, base = (np.add.reduceat(x, starts) for x in ((c > 0).astype(np.int64), np.log10((c + 0.1) / (totals.tokens + 0.1 * (totals.words + 1)))))
            del c, counts
            spare = totals.strength + totals.pair_discount * tables.astype(np.float64)
            own = spare[last] * of_class[np.unique(classes, return_inverse=True)[1]]
            del classes
            own += seat[np.unique(pairs, return_inverse=True)[1]]
            del pairs
            own = np.log10(own / (totals.strength + guests[last]))
            rows = [pa.array(ids, mask=known == 0), held.astype(bool), sizes, known_words, np.full(len(sizes), totals.tokens), base, np.add.reduceat(own, starts)]
            for values, column in zip(result.values(), rows):
                values.append(pa.array(column))
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table({k: pa.chunked_array(v, t) for (k, v), t in zip(result.items(), kinds)})

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    heads = chunks.where("bucket = -1").select("chunk", "blob")
    return heads.groupBy("chunk").cogroup(answers.groupBy("asker")).applyInArrow(score, out)
