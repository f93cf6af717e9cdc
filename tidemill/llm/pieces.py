"""Encoding into pieces by sampled segmentations without replacement, and decoding.

A piece vocabulary gives a lattice over a text. Each piece has the probability that Zipf's law gives its rank, so each path
(a segmentation) has one too. Pieces never cross the start of a word, nor a line end, nor the step from a letter to a mark
that no piece of the vocabulary has behind a letter; so the lattice is a chain of small lattices of segments, which a
Python worker builds once and remembers.

Distinct segmentations come from a perturbed A* search (Gumbel top-k): the root of the search holds all paths and a Gumbel
value; the best node on the heap gives its best path, and is split into the sets of paths that leave that path first at
each segment, with Gumbel values bounded by the node's. Paths come out in the order of their perturbed log probability;
the value of the next node is the threshold that sets their inclusion scores.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import MIX_A, slices, uniform

_SPACE, _CUT = "▁", "\x1e"
_OUTSIDE = 0x10FFFE  # stands for a U+2581 of the text itself, which no piece holds
_A = MIX_A


class Vocabulary:
    """Pieces of a SentencePiece model file, with hashes for look-up and log probabilities: `alpha` times the logarithm of
    Zipf's law for the piece's rank (and `flatten`); a smaller alpha draws more varied segmentations."""

    def __init__(self, path: str, flatten: float = 100.0, alpha: float = 0.25):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = np.zeros(256, dtype=np.int64)
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
        logs = -np.log(np.arange(len(plain) + 256) + flatten)
        logs = alpha * (logs - np.log(np.exp(logs).sum()))
        self.byte_log = logs[-1]
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.longest = max(len(self.pieces[i]) for i in plain)
        hashes = np.array([self._hash(np.array([ord(c) for c in self.pieces[i]], dtype=np.uint64)) for i in plain], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain)[order]
        self.logs = np.array([logs[rank[i]] for i in self.ids])
        self.lengths = np.array([len(self.pieces[i]) for i in self.ids])
        # marks that no piece has right behind a letter: lattices fall apart there
        marks = "".join(c for c in ".,;:!?" if not any(re.search(f"[^\\W\\d_]{re.escape(c)}", self.pieces[i]) for i in plain))
        self.split = f"^(?P<base> *[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)(?P<tail>[{marks}]+)$" if marks else None
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        text = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.text, self.text_sizes = np.frombuffer(b"".join(text), dtype=np.uint8), np.array([len(x) for x in text])

    @staticmethod
    def _hash(codes: np.ndarray) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = (h + c + np.uint64(1)) * _A
                h ^= h >> np.uint64(29)
        return int(h)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in the codes: start, length, id (-1: the bytes of one character no piece holds) and log probability.

        left: characters from each place to its segment's end."""
        starts, lengths, slots = [], [], []
        at, h = np.arange(len(codes)), np.zeros(len(codes), dtype=np.uint64)
        single = np.zeros(len(codes), dtype=bool)
        with np.errstate(over="ignore"):
            for n in range(1, self.longest + 1):
                go = left[at] >= n
                at, h = at[go], h[go]
                if not len(at):
                    break
                h = (h + codes[at + n - 1] + np.uint64(1)) * _A
                h ^= h >> np.uint64(29)
                maybe = np.flatnonzero(self.filter[(h >> np.uint64(44)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = (self.hashes[slot] == h[maybe]) & (self.lengths[slot] == n)
                starts.append(at[maybe[hit]])
                slots.append(slot[hit])
                lengths.append(np.full(hit.sum(), n))
                if n == 1:
                    single[at[maybe[hit]]] = True
        start, slot, length = (np.concatenate(x[::-1]) for x in (starts, slots, lengths))  # long pieces first
        none = np.flatnonzero(~single)
        true = np.where(codes[none] == _OUTSIDE, 0x2581, codes[none])
        n_bytes = 1 + (true >= 0x80) + (true >= 0x800) + (true >= 0x10000)
        return np.concatenate([start, none]), np.concatenate([length, np.ones(len(none), dtype=np.int64)]), np.concatenate([self.ids[slot], np.full(len(none), -1)]), np.concatenate([self.logs[slot], n_bytes * self.byte_log])


def segments(texts: list[str], split: str | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct segments (spaces as they are), each one's place, and the segments of each text.

    A text begins with the space that encoding puts before it. A segment is a run of spaces and what follows up to the
    next space, or one line end. What matches `split` is two segments, its base and its tail.
    """
    column = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), pa.array(texts, pa.large_string()), pa.scalar(" ", pa.large_string()))
    if pc.any(pc.match_substring(column, "  ")).as_py():
        column = pc.replace_substring_regex(column, "([^ \n]) ", f"\\1{_CUT} ")
    else:
        column = pc.replace_substring(column, " ", f"{_CUT} ")
    column = pc.replace_substring(column, "\n", f"{_CUT}\n{_CUT}")
    lists = pc.split_pattern(column, _CUT)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    odd = [i for i, t in enumerate(texts) if _CUT in t]
    if odd:  # texts that hold the cutting character themselves
        ends, parts = np.cumsum(counts), []
        numbers = {s: i for i, s in enumerate(distinct.to_pylist())}
        for i in range(len(texts)):
            own = at[ends[i] - counts[i] : ends[i]]
            if _CUT in texts[i]:
                own = np.array([numbers.setdefault(s, len(numbers)) for s in re.findall("\n| *[^ \n]+| +", " " + texts[i])], dtype=np.int64)
            parts.append(own)
        distinct, at, counts = pa.array(list(numbers), pa.large_string()), np.concatenate(parts), np.array([len(p) for p in parts])
    empty = pc.index(distinct, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        there = at != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
        at = at[there]
    if split is None:
        return distinct, at, counts
    parts = pc.extract_regex(distinct, split)
    two = parts.is_valid()
    coded = pa.concat_arrays([pc.if_else(two, parts.field("base"), distinct), parts.field("tail").filter(two)]).dictionary_encode()
    number, two = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), two.to_numpy(zero_copy_only=False)
    both = np.full((len(distinct), 2), -1)
    both[:, 0], both[two, 1] = number[: len(distinct)], number[len(distinct) :]
    more = np.concatenate([[0], np.cumsum(two[at])])[np.concatenate([[0], np.cumsum(counts)])]
    at = both[at].reshape(-1)
    return coded.dictionary, at[at >= 0], counts + np.diff(more)


class Lattices:
    """Lattices of distinct segments, with forward sums; paths are drawn backwards from each segment's end.

    Nodes and edges of all segments lie one after the other, and `places` adds those of segments that are new. An edge
    has its source, its piece (or, below 0, -2 less the character that no piece holds), its log probability among the
    edges that end where it does, and the running sum of theirs. A segment has whether it is `single`, of one path alone.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.known = vocabulary, pa.array([], pa.large_string())
        self.room: dict[str, np.ndarray] = {}
        for name, kind in (("first", "i4"), ("last", "i4"), ("source", "i4"), ("head", "i4"), ("tail", "i4"), ("piece", "i4"), ("log", "f8"), ("ladder", "f8"), ("single", "?")):
            self._append(name, np.zeros(0, dtype=kind))

    def _append(self, name: str, new: np.ndarray) -> None:
        """Arrays grow within room that is a quarter more than they need."""
        n = len(getattr(self, name, ()))
        if n + len(new) > len(self.room.get(name, ())) or name not in self.room:
            room = np.zeros(max(1024, (n + len(new)) * 5 // 4), dtype=self.room[name].dtype if name in self.room else new.dtype)
            room[:n] = getattr(self, name, new[:0])
            self.room[name] = room
        self.room[name][n : n + len(new)] = new
        setattr(self, name, self.room[name][: n + len(new)])

    def places(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of segments other than empty ones."""
        place = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero((place < 0) & (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > 0))
        if len(new):
            fresh = distinct.take(pa.array(new))
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._grow(fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
        return place

    def _grow(self, distinct: list[str]) -> None:
        size = np.array([len(s) for s in distinct], dtype=np.int64)
        codes = np.frombuffer("".join(distinct).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        codes = np.where(codes == 0x2581, np.uint64(_OUTSIDE), np.where(codes == 0x20, np.uint64(0x2581), codes))
        segment = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        start, length, piece, log = self.vocabulary.edges(codes, size[segment] - place)
        outside = np.flatnonzero(piece < 0)
        piece[outside] = -2 - np.where(codes[start[outside]] == _OUTSIDE, 0x2581, codes[start[outside]]).astype(np.int64)
        first = np.cumsum(size + 1) - size - 1  # a segment of n characters has n + 1 nodes
        source = first[segment[start]] + place[start]
        target = source + length
        order = np.argsort(target, kind="stable")  # a few sorted runs; within a node long pieces, the likely ones, stay first
        source, target, piece, log, start = (x[order] for x in (source, target, piece, log, start))
        depth = target - first[segment[start]]
        depth = depth.astype(np.uint16 if len(depth) and depth.max() < 1 << 16 else np.int64)
        by_depth = np.argsort(depth, kind="stable")
        steps = np.searchsorted(depth[by_depth], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        total = np.full(int((size + 1).sum()), -np.inf)
        total[first] = 0
        for lo, hi in zip(steps[:-1].tolist(), steps[1:].tolist()):
            own = by_depth[lo:hi]
            value, ends = total[source[own]] + log[own], target[own]
            heads = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            most = np.maximum.reduceat(value, heads)
            total[ends[heads]] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, np.diff(np.append(heads, hi - lo)))), heads))
        log = total[source] + log - total[target]
        share = np.exp(log)
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, dtype=np.int64)
        bounds = np.append(heads, len(target))
        run = np.cumsum(share)
        ladder = run - np.repeat(run[heads] - share[heads], np.diff(bounds))
        ladder[bounds[1:] - 1] = 1.0  # the last edge of a node takes what rounding leaves
        head, tail = np.full(len(total), -1), np.full(len(total), -1)  # the edges that end in a node
        head[target[heads]], tail[target[heads]] = heads, bounds[1:]
        nodes, edges = len(self.head), len(self.source)
        for name, new in (("first", first + nodes), ("last", first + size + nodes), ("source", source + nodes), ("head", head + edges), ("tail", tail + edges), ("piece", piece), ("log", log), ("ladder", ladder), ("single", np.bincount(segment[start], minlength=len(size)) == size)):
            self._append(name, new)

    def draw(self, which: np.ndarray, key: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One path for each segment number: edges of all paths (segment after segment, in order), edges of each, log p, and the probability of all other paths."""
        node, log = self.last[which], np.zeros(len(which))
        active, step, taken = np.arange(len(which)), 0, []
        while len(active):
            u = uniform(key[active], counter[active] * np.uint64(1 << 20) + np.uint64(step))
            edge = self.head[node[active]]
            on = np.flatnonzero(self.ladder[edge] < u)
            while len(on):
                edge[on] += 1
                on = on[self.ladder[edge[on]] < u[on]]
            taken.append((active, edge))
            log[active] += self.log[edge]
            node[active] = self.source[edge]
            active = active[node[active] > self.first[which[active]]]
            step += 1
        owner, edge = (np.concatenate([t[k] for t in taken]) if taken else np.zeros(0, dtype=np.int32) for k in (0, 1))
        order = np.argsort(owner, kind="stable")
        owner, edge = owner[order], edge[order]
        n = np.bincount(owner, minlength=len(which))
        ends = np.cumsum(n)
        edge = edge[np.repeat(ends - 1, n) - (np.arange(len(edge)) - np.repeat(ends - n, n))]
        rest = np.where(self.single[which], 0.0, -np.expm1(log))
        for x in np.flatnonzero((rest < 1e-6) & ~self.single[which]).tolist():  # a difference would have lost its digits
            rest[x] = self.left_by(int(which[x]), [edge[ends[x] - n[x] : ends[x]].tobytes()])
        return edge, n, log, rest

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids along the edges, bytes for what no piece holds, and how many each edge gives."""
        piece = self.piece[edges]
        n, outside = np.ones(len(piece), dtype=np.int64), np.flatnonzero(piece < 0)
        if not len(outside):
            return piece, n
        raw = [self.vocabulary.bytes[list(chr(-2 - code).encode())] for code in piece[outside].tolist()]
        n[outside] = [len(r) for r in raw]
        out = np.repeat(piece, n)
        out[out < 0] = np.concatenate(raw)
        return out, n

    def remaining(self, segment: int, paths: list[np.ndarray]) -> tuple[dict[tuple[int, int], float], list[list[int]]]:
        """What distinct paths (edges from the segment's end on) leave to others, of each step and group of them that agree so far.

        Also each path's group by step; the one of step 0 is 0. Sums of what isn't taken, never differences.
        """
        groups = [[0] * len(paths)]
        for step in range(max(map(len, paths))):
            seen: dict[tuple[int, int], int] = {}
            groups.append([seen.setdefault((g, int(path[step])), len(seen)) if step < len(path) else -1 for g, path in zip(groups[-1], paths)])
        left: dict[tuple[int, int], float] = {}
        for step in range(len(groups) - 1, -1, -1):
            taken: dict[int, dict[int, float]] = {}
            for path, own, after in zip(paths, groups[step], groups[min(step + 1, len(groups) - 1)]):
                if step < len(path):
                    taken.setdefault(own, {})[int(path[step])] = left[step + 1, after]
                elif step == len(path):
                    left[step, own] = 0.0
            for own, edges in taken.items():
                node = self.last[segment] if step == 0 else self.source[next(path[step - 1] for path, g in zip(paths, groups[step]) if g == own)]
                share = np.exp(self.log[self.head[node] : self.tail[node]])
                for edge, below in edges.items():
                    share[edge - self.head[node]] *= below
                left[step, own] = float(share.sum())
        return left, groups

    def draw_other(self, segment: int, barred: dict[bytes, float], key: np.uint64, turn: int) -> tuple[np.ndarray | None, float]:
        """A path of one segment that isn't barred, drawn by the share of each edge less what barred paths take of it; None if there is none."""
        bars = [np.frombuffer(path, dtype=np.int32)[::-1] for path in barred]
        left, groups = self.remaining(segment, bars)
        live, node, step, path = range(len(bars)), self.last[segment], 0, []
        while node > self.first[segment]:
            edges = np.arange(self.head[node], self.tail[node])
            free = np.exp(self.log[edges])
            below = {int(bars[i][step]): left[step + 1, groups[step + 1][i]] for i in live}
            for edge, share in below.items():
                free[edge - edges[0]] *= share
            if not free.sum() > 0:
                return None, 0.0
            with np.errstate(over="ignore"):
                u = uniform(np.array([key], dtype=np.uint64) + np.uint64(turn) * _A, np.array([step + 1]))[0]
            edge = int(edges[min(np.searchsorted(np.cumsum(free), u * free.sum()), np.flatnonzero(free)[-1])])
            path.append(edge)
            live = [i for i in live if bars[i][step] == edge]
            node, step = self.source[edge], step + 1
        path = np.array(path[::-1], dtype=np.int32)
        return path, float(self.log[path].sum())

    def left_by(self, segment: int, paths: list[bytes]) -> float:
        """The probability of all paths of a segment but these."""
        return self.remaining(segment, [np.frombuffer(path, dtype=np.int32)[::-1] for path in paths])[0][0, 0]


@dataclass(order=True)
class _Node:
    """A set of paths: `prefix` up to segment t, any but the barred ones there, all after it. Best value first."""

    cost: float
    t: int
    prefix: np.ndarray = field(compare=False)
    prefix_log: float = field(compare=False)
    barred: dict[bytes, float] = field(compare=False)


def _log_inclusion(x: float) -> float:
    """The logarithm of 1 - exp(-exp(x)), which is x itself where that is too small for a float."""
    return float(x if x < -37 else np.log(-np.expm1(-np.exp(min(x, 50.0)))))


def sample_texts(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """As log_sample_texts, with the inclusion score itself in place of its logarithm."""
    for d, rank, ids, log, log_inclusion in log_sample_texts(lattices, texts, keys, k):
        yield d, rank, ids, log, float(np.exp(log_inclusion))


def log_sample_texts(lattices: Lattices, texts: list[str], keys: np.ndarray, k: int) -> Iterator[tuple[int, int, np.ndarray, float, float]]:
    """text number, rank, piece ids, log probability and log inclusion score of up to k distinct segmentations of each text.

    A text with fewer segmentations gives them all. An empty text has the one piece of the space before it.
    """
    distinct, at, counts = segments(texts, lattices.vocabulary.split)
    at = lattices.places(distinct)[at]
    first, none = np.cumsum(counts) - counts, np.zeros(0, dtype=np.int32)
    heaps = [[_Node(float(c), 0, none, 0.0, {})] for c in np.log(-np.log(uniform(keys, 0)))]
    done: list[list[tuple[np.ndarray, float]]] = [[] for _ in texts]
    for turn in range(1, k + 1):
        nodes = [(d, heapq.heappop(heap)) for d, heap in enumerate(heaps) if heap]
        if not nodes:
            break
        skip = np.array([node.t for _, node in nodes])
        sizes = np.array([counts[d] for d, _ in nodes], dtype=np.int64) - skip
        ends = np.cumsum(sizes)
        spot = np.arange(ends[-1]) - np.repeat(ends - sizes - skip, sizes)  # number of the segment in its text
        doc = np.repeat(np.array([d for d, _ in nodes]), sizes)
        which, bounds = at[first[doc] + spot], list(zip((ends - sizes).tolist(), ends.tolist()))
        edges, n, log, rest = lattices.draw(which, keys[doc], (spot * (k + 1) + turn).astype(np.uint64))
        cuts = np.concatenate([[0], np.cumsum(n)])
        other: dict[int, np.ndarray | None] = {}
        for x, ((d, node), (lo, _)) in enumerate(zip(nodes, bounds)):
            if node.barred and edges[cuts[lo] : cuts[lo + 1]].tobytes() in node.barred:
                other[x], log[lo] = lattices.draw_other(int(which[lo]), node.barred, keys[d], turn)
        before = np.empty(len(log))  # rest: of each segment's probability, what the path leaves
        for x, ((_, node), (lo, hi)) in enumerate(zip(nodes, bounds)):
            before[lo] = node.prefix_log
            np.cumsum(log[lo : hi - 1], out=before[lo + 1 : hi])
            before[lo + 1 : hi] += node.prefix_log
            if node.barred and not (x in other and other[x] is None):
                own = other[x] if x in other else edges[cuts[lo] : cuts[lo + 1]]
                rest[lo] = -np.expm1(log[lo]) - sum(map(np.exp, node.barred.values()))
                if rest[lo] < 1e-6:  # a difference would have lost its digits
                    rest[lo] = lattices.left_by(int(which[lo]), [own.tobytes(), *node.barred])
        noise = -np.log(-np.log(uniform(keys[doc], spot * (k + 1) + turn + (1 << 40))))
        mass = before + np.log(np.maximum(rest, 1e-300)) + noise
        value = np.where(rest <= 0, -np.inf, -np.logaddexp(np.repeat([node.cost for _, node in nodes], sizes), -mass))  # at most this node's own
        for x, ((d, node), (lo, hi)) in enumerate(zip(nodes, bounds)):
            own, starts = edges[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo]
            if x in other:
                if other[x] is None:
                    continue
                own, starts = np.concatenate([other[x], own[starts[1] :]]), starts + (len(other[x]) - starts[1])
                starts[0] = 0
            done[d].append((np.concatenate([node.prefix, own]), float(before[hi - 1] + log[hi - 1])))
            values = value[lo:hi]
            for _ in range(k - turn + 1):
                i = int(np.argmax(values))
                best = float(values[i])
                if not np.isfinite(best):
                    break
                barred = {own[starts[i] : starts[i + 1]].tobytes(): float(log[lo + i])} | (node.barred if i == 0 else {})
                heapq.heappush(heaps[d], _Node(-best, node.t + i, np.concatenate([node.prefix, own[: starts[i]]]), float(before[lo + i]), barred))
                values[i] = -np.inf
            heaps[d] = heapq.nsmallest(k - turn + 1, heaps[d])
    paths = [path for found in done for path, _ in found]
    ids, n = lattices.ids(np.concatenate([none, *paths]))
    cuts = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum([len(path) for path in paths])]).astype(np.int64)].tolist()
    at = 0
    for d, found in enumerate(done):
        threshold = -heaps[d][0].cost if heaps[d] else -np.inf
        for rank, (_, log) in enumerate(found):
            yield d, rank, ids[cuts[at] : cuts[at + 1]], log, _log_inclusion(log - threshold)
            at += 1


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of runs of ids: pieces and bytes joined, without the space that encoding puts first."""
    sizes = vocabulary.text_sizes[ids]
    ends = np.cumsum(sizes)
    starts = (np.cumsum(vocabulary.text_sizes) - vocabulary.text_sizes)[ids]
    raw = vocabulary.text[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]
    return [t[1:] if t.startswith(" ") else t for t in texts]


#: Characters of texts that are drawn at once.
SLICE = 300_000
#: Edges of lattices that a Python worker remembers; some 30 bytes each.
REMEMBERED = 700_000
_vocabularies: dict[str, Vocabulary] = {}
_lattices: dict[str, Lattices] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def lattices_of(path: str) -> Lattices:
    """The lattices that a Python worker has built so far; new ones when they have grown too many."""
    if path not in _lattices or len(_lattices[path].source) > REMEMBERED:
        _lattices[path] = Lattices(vocabulary_of(path))
    return _lattices[path]


def sampled_pieces(docs: DataFrame, model: str, k: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """doc_id, rank (0 to k - 1), ids, log_probability, inclusion and log_inclusion of up to k distinct segmentations of each row's text.

    With `decode`, also `decoded`: the text that the ids give, decoded where they were drawn.

    inclusion: the chance that the segmentation is among the k, given the threshold 1 - exp(-exp(log p - threshold)). Long
    texts have so many segmentations that it is too small for a double, hence 0; log_inclusion is its logarithm. However rare a
    segmentation is, it is given where k asks for it, down to what a double holds (1e-300 of its segment's).
    The draw depends on the seed, the id and the text alone. Null texts count as empty; null ids and repeated rows stay
    (repeated rows draw alike). Texts without other segmentations give fewer than k rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64(F.lit(seed), "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys, ids = batch["text"].to_pylist(), batch["row_key"].to_numpy().view(np.uint64), batch["doc_id"]
            for a, b in slices(texts, SLICE):
                found = list(log_sample_texts(lattices_of(model), texts[a:b], keys[a:b], k))
                offsets = np.concatenate([[0], np.cumsum([len(x[2]) for x in found])])
                drawn = np.concatenate([x[2] for x in found])
                columns = {
                    "doc_id": ids.take(pa.array([a + x[0] for x in found], pa.int64())),
                    "rank": pa.array([x[1] for x in found], pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(drawn.astype(np.int32))),
                    "log_probability": pa.array([x[3] for x in found], pa.float64()),
                    "inclusion": pa.array(np.exp([x[4] for x in found]), pa.float64()),
                    "log_inclusion": pa.array([x[4] for x in found], pa.float64()),
                }
                if decode:
                    columns["decoded"] = pa.array(decode_ids(vocabulary_of(model), drawn.astype(np.int64), np.diff(offsets)), pa.string())
                del found
                yield pa.record_batch(columns)

    return rows.mapInArrow(run, "doc_id long, rank int, ids array<int>, log_probability double, inclusion double, log_inclusion double" + (", decoded string" if decode else ""))


def decoded(ids: Column, model: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        vocabulary = vocabulary_of(model)
        counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends, texts, row = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(counts), [], 0
        while row < len(counts):  # some 200,000 ids at a time
            before = int(ends[row] - counts[row])
            until = max(row + 1, int(np.searchsorted(ends, before + 200_000, side="right")))
            texts += decode_ids(vocabulary, flat[before : ends[until - 1]].astype(np.int64), counts[row:until])
            row = until
        texts = pa.array(texts, pa.string())
        return pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))

    return run(ids)
