"""Exact Jaccard self-join on word n-grams, and the components of its links.

Candidates: the n-grams of a set lie in the order of their hashes, and each run of w neighbours is a window. If a set of n
n-grams reaches similarity s with another, at most x <= n * (1 - s) - s * y of its n-grams are not in the other, where y of
the other's are not in it; the first spoil w windows each, the others w - 1, so at most w * n * (1 - s) windows are not
the other's. Hence the lowest w * n * (1 - s) + 1 windows, by another hash, hold one that both sets have there: they are
the set's signatures, and sets with a common signature belong to one candidate group. N-grams that a counting sketch of
all texts calls frequent are left out of the order (on both sides, which can only shrink the difference), so a passage
that many texts share doesn't put them together; sets with too few rare ones have signatures of all n-grams as well.

Verification: each candidate group is a product of its sparse document by n-gram matrix with its own transpose, in blocks
of documents and of n-grams. Overlap counts add up block by block, and pairs that can't reach the bound which their
sizes set are dropped on the way. Every link between different sets is found; nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import MIX_B, mixed, slices, word_column, word_hashes, written
from tidemill.llm.components import connected_components

SKETCH_BITS = 20
#: Documents on each side of a block of the product, and n-grams in one step of it.
BLOCK, STEP = 768, 2048
#: Neighbours in a window: with more, fewer sets meet by chance, and more signatures are needed.
WINDOW = 3
_B = MIX_B


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams; with fewer words the whole sequence is one; without words, none."""
    column, at, counts = word_column(texts, lower=True)
    h = word_hashes(column)[at]
    out, ends = [], np.cumsum(counts)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
        for k in range(width):
            grams = mixed(grams + h[k : k + len(grams)] * np.uint64(2 * k + 3))
        for end, n in zip(ends.tolist(), counts.tolist()):
            if n >= width:
                out.append(np.unique(grams[end - n : end - width + 1]))
            elif n:
                short = np.array([n], dtype=np.uint64)
                for k in range(n):
                    short = mixed(short * _B + h[end - n + k])
                out.append(short)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def _set_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(shingles: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """All signatures of a set (sorted hashes) for a similarity of num/den.

    Level 0 takes windows of WINDOW neighbours among the rare n-grams, level 1 among all, level 2 all single n-grams. A set
    goes on to the next level while it has no more windows than could all differ. Of two sets, the one that stops first
    shares a window with the other among the lowest ones of that level.
    """
    n, out = len(shingles), []
    rare = shingles[~frequent[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]]
    for level, (members, width) in enumerate(((rare, WINDOW), (shingles, WINDOW), (shingles, 1))):
        h = np.full(max(len(members) - width + 1, 0), np.uint64(level))
        for k in range(width):
            h = mixed(h + members[k : k + len(h)] * np.uint64(2 * k + 3))
        most = width * n * (den - num) // den + 1
        out.append(np.sort(h)[:most])
        if len(h) >= most:
            break
    return np.concatenate(out)


def overlapping_pairs(left: list[np.ndarray], right: list[np.ndarray], num: int, den: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in left, in right) of all pairs whose sets reach num/den; with `same`, only pairs i < j.

    The product goes over the n-grams that two sets or more hold, STEP at a time, common ones first. A pair is dropped as
    soon as its count and what either set still has to offer stay below ceil(num * (a + b) / (num + den)).
    """
    sets = left if same else [*left, *right]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(values), dtype=np.int64)
    rank[order] = np.arange(len(values))
    shared = int((df > 1).sum())
    column = rank[column]
    keep = column < shared
    row, column = row[keep], column[keep]
    n_left = len(left)
    a, b = sizes[:n_left], sizes if same else sizes[n_left:]
    need = -(-num * (a[:, None] + b[None, :]) // (num + den))
    alive = (np.minimum(a[:, None], b[None, :]) >= need) & (a[:, None] > 0) & (b[None, :] > 0)
    if same:
        alive &= np.arange(n_left)[:, None] < np.arange(n_left)[None, :]
    counts = np.zeros(need.shape, dtype=np.float32)
    rest = np.bincount(row, minlength=len(sets))
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    for start in range(0, shared, STEP):
        lo, hi = np.searchsorted(column, [start, start + STEP])
        block = np.zeros((len(sets), min(STEP, shared - start)), dtype=np.float32)
        block[row[lo:hi], column[lo:hi] - start] = 1
        counts += block[:n_left] @ (block if same else block[n_left:]).T
        rest = rest - np.bincount(row[lo:hi], minlength=len(sets))
        open_left, open_right = rest[:n_left], rest if same else rest[n_left:]
        alive &= counts + np.minimum(open_left[:, None], open_right[None, :]) >= need
        if not alive.any():
            break
    return np.nonzero(alive & (counts >= need))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all links: each place to the smallest of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each value of `grp`, from rows that come sorted by it."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        grp = frame["grp"].to_numpy()
        cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
        for a, b in zip(cuts, cuts[1:]):
            if held and len(grp) and held[-1]["grp"].iloc[-1] != grp[a]:
                yield pd.concat(held)
                held = []
            if b > a:
                held.append(frame.iloc[a:b])
    if held:
        yield pd.concat(held)


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), n_links (other rows linked with it) of every row.

    Texts in lower case (A-Z) give word n-grams; two sets link at num/den Jaccard similarity or more. Null texts and texts
    without words have empty sets and link with nothing: component_id is their own id, n_links 0. Fewer than `width` words are one
    n-gram. Equal sets (repeated rows, copies) are one set with many ids from the first step on. Null ids stay, and don't
    count as smallest. Ids may be of any integer type (returned as long) or strings. 64-bit hashes stand for n-grams and sets. Other columns are not read.
    """
    spark = docs.sparkSession
    kind = "string" if docs.schema[id_col].dataType.typeName() == "string" else "long"
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))

    def first_pass(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, part = np.zeros(1 << SKETCH_BITS, dtype=np.int64), 0
        for frame in frames:
            texts, ids, ns = frame["text"].tolist(), [], []
            part = int(frame["part"].iloc[0]) if len(frame) else part
            for a, b in slices(texts):
                for s in shingle_sets(texts[a:b], width):
                    np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
                    ids.append(_set_id(s))
                    ns.append(len(s))
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64") if kind == "long" else frame["doc_id"], "text_hash": frame["text_hash"], "set_id": np.array(ids, dtype=np.int64), "n": ns, "part": part, "block": None, "counts": None})
        blocks = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, 1 << 16)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"doc_id": None, "text_hash": None, "set_id": None, "n": None, "part": part, "block": full, "counts": [blocks[k].tobytes() for k in full]})

    fields = f"doc_id {kind}, text_hash long, set_id long, n long, part int, block int, counts binary"
    seen = written(rows.withColumn("part", F.spark_partition_id()).mapInPandas(first_pass, fields), "ngram-sets")
    sets = seen.where(F.col("set_id").isNotNull()).select("doc_id", "text_hash", "set_id", F.col("n").alias("n_shingles"))

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(x, dtype=np.uint8 if len(x) == 1 << 16 else np.uint32).astype(np.uint32) for x in frame["counts"]))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "salt": frame["salt"].iloc[:1], "counts": [total.tobytes()]})

    sketches = seen.where(F.col("block").isNotNull()).select("block", "counts", (F.col("part") / 256).cast("int").alias("salt"))
    for _ in range(2):  # a tree of fixed fan-in, so that no task holds more than 256 parts' counts
        sketches = sketches.groupBy("block", "salt").applyInPandas(added, "block int, salt int, counts binary").withColumn("salt", (F.col("salt") / 256).cast("int"))
    sketches = sketches.groupBy("block").applyInPandas(added, "block int, salt int, counts binary").collect()  # at most 2**(SKETCH_BITS - 16) rows
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for r in sketches:
        counts[r.block << 16 : (r.block + 1) << 16] = np.frombuffer(r.counts, dtype=np.uint32)
    frequent = spark.sparkContext.broadcast(counts >= max(256, 8 * counts.mean()))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for a, b in slices(texts, 2_000_000):
                own = [(_set_id(s), signatures(s, frequent.value, num, den)) for s in shingle_sets(texts[a:b], width) if len(s)]
                own = list({k: v for k, v in own}.items())
                n = np.array([len(v) for _, v in own], dtype=np.int64)
                values = np.concatenate([np.zeros(0, dtype=np.uint64), *(v for _, v in own)])
                yield pa.record_batch({"sig": values.view(np.int64), "set_id": np.repeat(np.array([k for k, _ in own], dtype=np.int64), n)})

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links each set of a signature to the first one; rows come sorted by signature and set."""
        last_sig, first = None, 0
        for batch in batches:
            sig, own = batch["sig"].to_numpy(), batch["set_id"].to_numpy()
            if not len(sig):
                continue
            fresh = np.concatenate([[last_sig is None or sig[0] != last_sig], sig[1:] != sig[:-1]])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), -1))
            head = np.where(at >= 0, own[np.maximum(at, 0)], first)
            last_sig, first = sig[-1], head[-1]
            differ = head != own
            pairs = np.unique(np.stack([head[differ], own[differ]], axis=1), axis=0)
            yield pa.record_batch({"a": pairs[:, 0], "b": pairs[:, 1]})

    by_signature = rows.select("text").mapInArrow(signed, "sig long, set_id long").repartition("sig").sortWithinPartitions("sig", "set_id")
    groups = written(connected_components(by_signature.mapInArrow(stars, "a long, b long"), "ngram-groups"), "ngram-groups")

    # one row for each set, found again by id and text, so that neither null nor repeated ids meet each other
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    chosen = sets.join(groups.withColumnRenamed("node", "set_id"), "set_id").groupBy("set_id", "component").agg(first, F.first("n_shingles").alias("n"), F.count("*").alias("docs"))
    chosen = chosen.select("set_id", "component", "n", "docs", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("text_hash"))
    # id and text are the key together, so copies of one text, of which one row alone is chosen, don't meet in one task
    same = (rows["text_hash"] == chosen["text_hash"]) & rows["doc_id"].eqNullSafe(chosen["first_id"])
    members = rows.join(chosen, same).select("set_id", "component", "n", "docs", "text")

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sets of the members; rows that share a doc_id with a member but hold another set go."""
        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["set_id"].to_pylist()
            for a, b in slices(texts):
                found = [_set_id(s) == k and s.astype("<u8").tobytes() or None for s, k in zip(shingle_sets(texts[a:b], width), ids[a:b])]
                out = pa.record_batch({"set_id": batch["set_id"].slice(a, b - a), "component": batch["component"].slice(a, b - a), "n": batch["n"].slice(a, b - a), "docs": batch["docs"].slice(a, b - a), "shingles": pa.array(found, pa.binary())})
                yield out.filter(pc.is_valid(out["shingles"]))

    members = written(members.mapInArrow(reread, "set_id long, component long, n long, docs long, shingles binary"), "ngram-members")
    spots = members.select("set_id", "component", "n").distinct()
    sizes = spots.groupBy("component").agg(F.count("*").alias("members"), F.min("n").alias("least"))
    blocked = spots.join(sizes, "component").select(
        "set_id", "component", "n", F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK)).cast("int").alias("blocks"), F.pmod(F.xxhash64("set_id"), F.greatest(F.lit(1), F.ceil(F.col("members") / BLOCK))).cast("int").alias("block")
    )
    # block i of a group meets every block j: a set goes to (block, j) for all j from its own on, and to (i, block) before it
    cells = blocked.select("set_id", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("set_id", F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("grp"), (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("own"))

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(frames):
            group = group.drop_duplicates("set_id")
            held = [np.frombuffer(x, dtype="<u8") for x in group["shingles"]]
            ids, left, own = group["set_id"].to_numpy(), group["left"].to_numpy(), group["own"].to_numpy()
            if own.all():
                i, j = overlapping_pairs(held, held, num, den, same=True)
            else:
                one, two = np.flatnonzero(left), np.flatnonzero(~left)
                i, j = overlapping_pairs([held[k] for k in one], [held[k] for k in two], num, den, same=False)
                i, j = one[i], two[j]
            docs = group["docs"].to_numpy()
            linked = (np.bincount(i, docs[j], len(ids)) + np.bincount(j, docs[i], len(ids))).astype(np.int64)
            some = np.flatnonzero(linked)
            i, j = _forest(i, j, len(ids))
            yield pd.DataFrame({"a": ids[i], "b": ids[j], "linked": pd.array([None] * len(i), "Int64")})
            yield pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), "Int64"), "linked": linked[some]})

    work = cells.join(members.select("set_id", "docs", "shingles").dropDuplicates(["set_id"]), "set_id").repartition("grp").sortWithinPartitions("grp")
    found = written(work.select("grp", "set_id", "left", "own", "docs", "shingles").mapInPandas(verify, "a long, b long, linked long"), "ngram-verified")
    links = connected_components(found.where("b is not null").select("a", "b"), "ngram-links")
    # each pair of sets meets in one cell, so the cells' numbers add up
    linked = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("linked").alias("linked"))
    known = sets.groupBy("set_id").agg(F.count("*").alias("docs")).join(links.withColumnRenamed("node", "set_id"), "set_id", "left").join(linked, "set_id", "left")
    known = known.select("set_id", F.coalesce("component", "set_id").alias("label"), (F.col("docs") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))

    labelled = sets.join(known, "set_id").select("doc_id", "n_shingles", "label", "n_links")
    filled = labelled.where("n_shingles > 0")
    least = filled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    alone = labelled.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return filled.join(least, "label").select("doc_id", "n_shingles", "component_id", "n_links").unionByName(alone)


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows and columns of docs, one row of each component of `ngram_components`: that of the smallest id.

    Nulls come after all ids, and rows of one id are told apart by their text; of rows that agree in both, one stays. Rows
    without words are linked with nothing and stay. Only keys of kept rows meet the documents again, in one join.
    """
    number = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(str(2**63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    key = F.concat(F.coalesce(number, F.lit("~")), F.lit("-"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")))
    found = ngram_components(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", width, num, den)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key.alias("key"), F.struct("*").alias("row")).join(kept, "key", "left_semi")
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.withColumn("place", first).where("place = 1").select("row.*")
