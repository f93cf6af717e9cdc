"""SimHash near-duplicates: 64-bit fingerprints, linked where few bits differ by Burkhard-Keller trees.

Of fingerprints that differ in at most `radius` bits, cut into more blocks than that, some blocks are equal. Each distinct
fingerprint therefore goes to the shard of every choice of such blocks, and shards are cut into trees of bounded size. In
a tree, a child hangs below its parent by their Hamming distance, so a search with a radius follows only the edges whose
distance is within that radius of the searched fingerprint's own distance to the parent. A tree is sent to the tasks that
hold fingerprints of its shard: a broadcast of all trees to all executors would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import dropped, slices, written
from tidemill.llm.components import connected_components

SEED = 42
BITS = 64
#: Nodes of a shard's tree up to which it isn't cut; two parts of a cut shard meet in one task.
TREE_NODES = 8_192
#: Mean nodes of a shard up to which blocks are cut no finer.
SHARD_NODES = 2_048
#: Pairs of a searched fingerprint and a node of its tree that one step of a search may look at.
STEP_PAIRS = 4_000_000
#: Shingles hashed at once.
SHINGLES = 200_000


def fingerprint(text: str | None, width: int) -> int:
    """Bits set in more than half of the hashes of the shingles of `width` words; fewer words are one shingle, none give 0."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six white space characters
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = max(len(words) - width + 1, 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    counts, of = np.zeros(BITS, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SHINGLES):
        hashes = np.array([of(joined[a:b], SEED) for a, b in zip(starts[at : at + SHINGLES].tolist(), ends[at : at + SHINGLES].tolist())], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and fingerprint (`print`, a long of the same bits) of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = [fingerprint(t, width) for t in batch.column(1)[a:b].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, print long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Trees:
    """One Burkhard-Keller tree for each group of fingerprints, all grown and searched level by level.

    `values` are unsigned 64-bit, `groups` ascending; the first value of a group is its root. A value goes down from the root
    along the edges of its distances until no child has its distance, and becomes that child.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        n = len(values)
        self.sizes = np.bincount(groups)[groups] if n else np.zeros(0, dtype=np.int64)
        first = np.flatnonzero(np.diff(groups, prepend=-1))
        self.root = first[groups] if n else first
        self.parent, self.edge = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        self.levels = [first]
        down = np.setdiff1d(np.arange(n), first, assume_unique=True)
        at = self.root[down]
        while len(down):
            edge = distances(values[down], values[at])
            _, new, which = np.unique(at * (BITS + 1) + edge, return_index=True, return_inverse=True)
            child = down[new]
            self.parent[child], self.edge[child] = at[new], edge[new]
            self.levels.append(child)
            rest = np.ones(len(down), dtype=bool)
            rest[new] = False
            down, at = down[rest], child[which[rest]]
        below = np.flatnonzero(self.parent >= 0)
        code = self.parent[below] * (BITS + 1) + self.edge[below]
        order = np.argsort(code)
        self.children, self.codes = below[order], code[order]

    def near(self, asked: np.ndarray, radius: int, label: np.ndarray | None = None, least: np.ndarray | None = None, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of asked nodes and nodes of their tree within the radius; with labels, subtrees wholly of one's own label are passed by."""
        who, node, hits = asked, self.root[asked], []
        while len(who):
            if label is not None:
                new = (least[node] != most[node]) | (least[node] != label[who])
                who, node = who[new], node[new]
            d = distances(self.values[who], self.values[node])
            hit = (d <= radius) & (who != node)
            hits.append((who[hit], node[hit]))
            lo = np.searchsorted(self.codes, node * (BITS + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.codes, node * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = hi - lo
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            node = self.children[np.repeat(lo - (ends - n), n) + np.arange(total)]
            who = np.repeat(who, n)
        return (np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])) if hits else (asked[:0], asked[:0])

    def labels(self, radius: int) -> np.ndarray:
        """Of every node, the first node that it reaches by links within the radius.

        Nodes search in steps. What a step links is known to the next one, which passes by subtrees that hold nothing but the
        asking node's own component, so a dense group of near copies isn't compared pair by pair.
        """
        label = np.arange(len(self.values))
        ends = np.cumsum(self.sizes)
        start = 0
        while start < len(label):
            stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + STEP_PAIRS, side="right")), start + 1)
            asked = np.arange(start, stop)
            if start:
                least, most = label.copy(), label.copy()
                for level in self.levels[:0:-1]:
                    np.minimum.at(least, self.parent[level], least[level])
                    np.maximum.at(most, self.parent[level], most[level])
                a, b = self.near(asked, radius, label, least, most)
            else:
                a, b = self.near(asked, radius)
            while len(a):
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
                open_ = label[a] != label[b]
                a, b = a[open_], b[open_]
            start = stop
        return label


def _blocks(n: int, radius: int) -> int:
    """Blocks to cut fingerprints into, so that n of them, spread evenly, leave shards of no more than SHARD_NODES."""
    blocks = radius + 1
    while n / 2.0 ** ((blocks - radius) * (BITS // blocks)) > SHARD_NODES and blocks < radius + 8:
        blocks += 1
    return blocks


def _shard_keys(radius: int, blocks: int):
    """Of the column `print`: one long for each choice of blocks, the choice's number before the bits of its blocks."""
    cuts = np.linspace(0, BITS, blocks + 1).round().astype(int).tolist()
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for k in chosen:
            width = cuts[k + 1] - cuts[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("print", cuts[k]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.explode(F.array(*keys))


def _links(radius: int):
    """Rows of shard, i, j and print, sorted by the first three, to edges a, b that connect what is linked within each."""

    def solved(columns: list[np.ndarray]) -> pa.RecordBatch:
        group = np.cumsum(np.any([np.diff(c, prepend=c[:1]) != 0 for c in columns[:3]], axis=0))
        trees = Trees(columns[3].view(np.uint64), group)
        label = trees.labels(radius)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(columns[3][linked]), pa.array(columns[3][label[linked]])], names=["a", "b"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 16 * TREE_NODES:
                continue
            all_ = [np.concatenate(c) for c in zip(*held)]
            last = np.flatnonzero(np.any([c != c[-1] for c in all_[:3]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last unit may go on
            if cut:
                yield solved([c[:cut] for c in all_])
            held = [[c[cut:] for c in all_]]
        if held:
            yield solved([np.concatenate(c) for c in zip(*held)])

    return of


def near_prints(prints: DataFrame, radius: int = 4, tree_nodes: int = TREE_NODES, blocks: int | None = None) -> DataFrame:
    """Edges a, b that connect all distinct values of `print` (long) that links of at most `radius` differing bits connect.

    Not one row for each link: each tree gives one edge for each node that it links. A shard above `tree_nodes` is cut into parts
    by hash, and every two parts meet in one tree, so no task holds more than two parts.
    """
    n = prints.count()
    routed = written(prints.select("print", _shard_keys(radius, blocks or _blocks(n, radius)).alias("shard")), "simhash-routed")
    large = routed.groupBy("shard").count().where(F.col("count") > tree_nodes).select("shard", F.ceil(F.col("count") / tree_nodes).cast("int").alias("parts"))
    dealt = routed.join(large, "shard", "left").withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: j != F.col("part")))
    part = F.coalesce("part", F.lit(0))
    units = dealt.select("shard", F.explode(other).alias("other"), part.alias("part"), "print").select("shard", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "print")
    edges = written(units.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j").mapInArrow(_links(radius), "a long, b long"), "simhash-links")
    dropped(routed)
    return edges


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    The component is the smallest id that links of at most `radius` differing bits reach, the row's own included. Null and
    empty texts and those without words have the fingerprint zero and are linked like any other. Equal fingerprints are one
    node, so copies cost nothing but their rows. Repeated rows stay; a null id stays null and never names a component unless
    all its ids are null, when the component is null. Other columns are dropped, so their names clash with nothing.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "simhash-prints")
    unique = written(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-unique")
    component = connected_components(near_prints(unique.select("print"), radius), "simhash-components")
    named = unique.join(component.select(F.col("node").alias("print"), "component"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    named = written(named, "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = written(named.join(least, "component").select("print", "component_id"), "simhash-of-print")
    return rows.join(of_print, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
