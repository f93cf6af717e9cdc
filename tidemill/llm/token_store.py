"""Token ids of a corpus in a content-addressed store.

Layout of a store (all Parquet, ids little-endian, 2 or 4 bytes wide):

- `chunks`: digest (blake2b, 16 bytes), n, ids. A rolling hash over the last 16 ids cuts each document's ids, so an
  insertion moves only the cuts near it; a chunk that many documents share is kept once.
- `recipes`: part, doc_id, start, n_tokens, digests (the document's chunks in order), root (Merkle root of digests). Parts
  follow each other in ascending doc_id order, and so do the rows of a part.
- `manifest`: part, offset, n_docs, n_tokens, root (Merkle root of the part's document roots).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import scratch, slices, word_column, written

#: Chunks have 64 ids at least but for a document's last, 2048 at most, and some 512 on average.
LEAST, MOST, AVERAGE, WINDOW = 64, 2048, 512, 16
#: Distinct words whose ids a Python worker remembers.
REMEMBERED = 1_000_000
_SEPARATOR = "☆"
#: Letters up to U+00FF (composed as they are, with one lower case) and the marks behind them, one run each.
_RUNS = "^(?P<base>[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)(?P<tail>[.,;:!?#*$%&|<>]*)$"


class WordEncoder:
    """Ids of whole texts by a tokenizer whose normaliser and splitter never look across white space.

    For such a tokenizer (`word_bpe_49k.json` is one), a text's ids are its words' ids in order, so each distinct word
    goes through the library once. It splits letters from marks, so letters with marks behind them are looked up as
    two runs; runs go in together, and each one's ids end with the one id that ends a word. All other words go in with
    a separator of one known id between them.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        (separator,) = self._encode([_SEPARATOR])
        assert len(separator) == 1, "the separator has to be one token"
        self.separator = separator[0]
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self._forget()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.flat, self.sizes = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.words = {whole: pa.array([""], pa.large_string()) for whole in (True, False)}
        self.at = {whole: np.zeros(1, dtype=np.int64) for whole in (True, False)}

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        self.flat, self.sizes = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.sizes, sizes])
        return np.arange(len(self.sizes) - len(sizes), len(self.sizes))

    def _learn(self, new: list[str], whole: bool) -> np.ndarray:
        """Puts the ids of new words into the table, and gives their places. whole: the splitter keeps each in one run, so one id ends each."""
        size, at, again, plain, odd = 2000 if whole else 1000, np.zeros(len(new), dtype=np.int64), [], [], []
        for i, w in enumerate(new):
            (odd if _SEPARATOR in w else plain).append(i)
        groups = [plain[i : i + size] for i in range(0, len(plain), size)]
        for group, ids in zip(groups, self._encode([(" " if whole else f" {_SEPARATOR} ").join([new[i] for i in g]) for g in groups])):
            ids = np.array(ids, dtype=np.int64)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1 if whole else np.append(np.flatnonzero(ids == self.separator), len(ids))
            if len(cuts) != len(group):
                again += group
            elif whole:
                at[group] = self._add(ids, np.diff(cuts, prepend=0))
            else:
                at[group] = self._add(np.delete(ids, cuts[:-1]), np.diff(cuts, prepend=-1) - 1)
        for i, ids in zip(odd, self._encode([new[i] for i in odd])):
            at[i] = self._add(np.array(ids, dtype=np.int64), np.array([len(ids)]))[0]
        if again:
            at[again] = self._learn([new[i] for i in again], whole=False)
        return at

    def _places(self, column: pa.Array, whole: bool) -> np.ndarray:
        """The table's places of all words of a column; new ones are learnt."""
        coded, known = column.dictionary_encode(), self.words[whole]
        place = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            self.at[whole] = np.concatenate([self.at[whole], self._learn(fresh.to_pylist(), whole)])
            self.words[whole] = pa.concat_arrays([known, fresh])
            place[new] = np.arange(len(known), len(known) + len(new))
        return self.at[whole][place][coded.indices.to_numpy(zero_copy_only=False)]

    @staticmethod
    def _gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs number `at` of a ragged array, one after the other, and the length of each."""
        n = sizes[at]
        ends = np.cumsum(n)
        starts = (np.cumsum(sizes) - sizes)[at]
        return flat[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the number of ids of each text."""
        if len(self.sizes) > REMEMBERED:
            self._forget()
        column, at, counts = word_column(texts)
        parts = pc.extract_regex(column, _RUNS)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        base, tail = (parts.filter(plain).field(k) for k in ("base", "tail"))
        first, second = np.zeros(len(column), dtype=np.int64), np.zeros(len(column), dtype=np.int64)
        first[plain] = self._places(pc.utf8_lower(base), whole=True)
        second[plain] = self._places(tail, whole=True)
        first[~plain] = self._places(column.filter(pa.array(~plain)), whole=False)
        flat, sizes = self._gather(self.flat, self.sizes, np.stack([first, second], axis=1).reshape(-1))
        ids, n = self._gather(flat, sizes[0::2] + sizes[1::2], at)
        before = np.concatenate([[0], np.cumsum(n)])
        ends = before[np.cumsum(counts)]
        return np.insert(ids, ends, self.end_id), np.diff(ends, prepend=0) + 1


def _gear(size: int = 1 << 16) -> np.ndarray:
    """A fixed table of 64-bit words (splitmix64 of 1, 2, ...) for the rolling hash."""
    with np.errstate(over="ignore"):
        z = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def cut_points(ids: np.ndarray, starts: np.ndarray, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks, and the chunks of each document; ids holds the documents from `starts` on, one after the other."""
    with np.errstate(over="ignore"):
        h = gear[ids & (len(gear) - 1)]
        step = 1
        while step < WINDOW:  # the hash of the last 2*step ids from two of the last step ids
            h[step:] += h[:-step] << np.uint64(step) if len(h) > step else 0
            step *= 2
    marks = np.flatnonzero((h >> np.uint64(40)) % np.uint64(AVERAGE - LEAST) == 0) + 1
    bounds = np.append(starts, len(ids))
    slots = np.searchsorted(marks, bounds)
    cuts, per = [], []
    for d in range(len(starts)):
        last, end, before = int(bounds[d]), int(bounds[d + 1]), len(cuts)
        for m in [*marks[slots[d] : slots[d + 1]].tolist(), end]:
            while m - last > MOST:
                last += MOST
                cuts.append(last)
            if m - last >= LEAST or (m == end and m > last):
                cuts.append(m)
                last = m
        per.append(len(cuts) - before)
    return np.array(cuts, dtype=np.int64), np.array(per, dtype=np.int64)


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over the leaves; an odd one moves up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\x01" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _digest(ids: bytes) -> bytes:
    return hashlib.blake2b(b"\x00" + ids, digest_size=16).digest()


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _lists(items: pa.Array, per: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), items)


def _encoded(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoders.setdefault((path, end_id), None) or WordEncoder(path, end_id)
        _encoders[path, end_id] = encoder
        gear = _gear()
        for batch in batches:
            for a, b in slices(batch["text"], 8_000_000):
                ids, counts = encoder.encode(batch["text"].slice(a, b - a))
                ends, per = cut_points(ids, np.cumsum(counts) - counts, gear)
                packed, width = ids.astype(encoder.dtype).tobytes(), encoder.dtype.itemsize
                edges = [0, *(ends * width).tolist()]
                digests = [_digest(packed[i:j]) for i, j in zip(edges, edges[1:])]
                stops = [0, *np.cumsum(per).tolist()]
                payloads = pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(np.array(edges, dtype=np.int32)), pa.py_buffer(packed)])
                yield pa.record_batch({
                    "doc_id": batch["doc_id"].slice(a, b - a), "n_tokens": counts, "digests": _lists(pa.array(digests, pa.binary()), per),
                    "root": pa.array([merkle_root(digests[i:j]) for i, j in zip(stops, stops[1:])], pa.binary()), "payloads": _lists(payloads, per),
                })

    return run


def _running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the ids before each document in its part."""
    before = 0
    for frame in frames:
        n = frame["n_tokens"].to_numpy()
        yield frame.assign(start=before + np.cumsum(n) - n)
        before += int(n.sum())


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", docs_per_part: int = 200_000) -> None:
    """Encodes all texts and writes the store to `path`.

    Null and empty texts have the end id alone. Rows with equal or null ids all stay (nulls first, equal ids by root).
    An empty table gives empty tables. Columns other than the two named ones are not read.
    """
    encoded = written(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
            _encoded(tokenizer, end_id), "doc_id long, n_tokens long, digests array<binary>, root binary, payloads array<binary>"
        ).withColumn("tie", F.monotonically_increasing_id()),  # written, so that rows with equal ids and texts can be cut apart
        "token-ids",
    )
    width = 2 if _encoder_dtype(tokenizer, end_id).itemsize == 2 else 4
    chunks = encoded.select(F.explode(F.arrays_zip("digests", "payloads")).alias("x")).select("x.digests", "x.payloads")
    (
        chunks.groupBy(F.col("digests").alias("digest")).agg(F.first("payloads").alias("ids"))
        .select("digest", F.expr(f"length(ids) div {width}").cast("int").alias("n"), "ids")
        .write.option("compression", "zstd").parquet(f"{path}/chunks")
    )
    n_parts = max(1, -(-encoded.count() // docs_per_part), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = (
        encoded.select("doc_id", "n_tokens", "digests", "root", "tie")
        .repartitionByRange(n_parts, F.asc_nulls_first("doc_id"), "root", "tie")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "root", "tie")
        .drop("tie")
        .withColumn("part", F.spark_partition_id())
    )
    fields = "doc_id long, n_tokens long, digests array<binary>, root binary, part int, start long"
    ordered = written(ordered.mapInPandas(_running, fields), "token-recipes")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    _parts(ordered).select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"), "n_docs", "n_tokens", "root").write.parquet(f"{path}/manifest")
    offsets = docs.sparkSession.read.parquet(f"{path}/manifest").select("part", "offset")  # one row for each part
    ordered.join(F.broadcast(offsets), "part").select("part", "doc_id", (F.col("offset") + F.col("start")).alias("start"), "n_tokens", "digests", "root").write.parquet(f"{path}/recipes")


def _parts(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens and root (over the document roots in the order of `start`) of the parts of recipes."""

    @F.pandas_udf("binary")
    def part_root(docs: pd.Series) -> pd.Series:
        return pd.Series([merkle_root([bytes(d["root"]) for d in x]) for x in docs])

    parts = recipes.groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("start", "root"))).alias("docs"))
    return parts.select("part", "n_docs", "n_tokens", part_root("docs").alias("root"))


def _encoder_dtype(tokenizer: str, end_id: int) -> np.dtype:
    return WordEncoder(tokenizer, end_id).dtype


def _bound(spark: SparkSession, path: str, chunks: DataFrame) -> DataFrame:
    """Each document with its chunks' fields in order; fails on a chunk that is missing."""
    recipes = spark.read.parquet(f"{path}/recipes")
    refs = recipes.select("start", F.posexplode("digests").alias("seq", "digest"))
    fields = [c for c in chunks.columns if c != "digest"]
    held = refs.join(chunks, "digest", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("seq", *fields))).alias("chunks"))
    held = held.withColumn("chunks", F.when(F.exists("chunks", lambda c: c["n"].isNull()), F.raise_error(F.lit("a chunk is missing"))).otherwise(F.col("chunks")))
    return recipes.drop("part").join(held, "start")


def _verified(width: int):
    """The store's chunks, with crc32 of their ids as 32-bit integers; fails on a chunk whose digest doesn't hold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for digest, ids, n in zip(frame["digest"], frame["ids"], frame["n"]):
                if _digest(ids) != digest or len(ids) != n * width:
                    raise ValueError(f"chunk {digest.hex()} doesn't hold what its digest says")
            wide = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes() for x in frame["ids"]]
            yield pd.DataFrame({"digest": frame["digest"], "n": frame["n"], "crc": np.fromiter(map(zlib.crc32, wide), dtype=np.int64, count=len(wide))})

    return run


def _shift_tables() -> np.ndarray:
    """For each k, 4 tables of 256: what 2**k zero bytes behind it make of a crc32's four bytes."""
    table = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\x00") for i in range(256)], dtype=np.uint32)
    unit = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):  # one zero byte: crc' = (crc >> 8) ^ table[crc & 255]
        values = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        unit[byte] = (values >> np.uint32(8)) ^ (table[np.arange(256)] if byte == 0 else np.uint32(0))
    out = [unit]
    for _ in range(47):
        out.append(_shift(_shift_values(), out[-1], out[-1]))
    return np.stack(out)


def _shift_values() -> np.ndarray:
    return np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)])


def _shift(values: np.ndarray, *tables: np.ndarray) -> np.ndarray:
    for t in tables:
        values = t[0][values & 255] ^ t[1][values >> 8 & 255] ^ t[2][values >> 16 & 255] ^ t[3][values >> 24]
    return values


def joined_crc32(crcs: np.ndarray, lengths: np.ndarray, starts: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """crc32 of each document from the crc32s and byte lengths of its pieces: each crc moves past the bytes behind it."""
    if not len(crcs):
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    per = np.diff(np.append(starts, len(crcs)))
    behind = np.repeat(ends[np.append(starts[1:], len(crcs)) - 1], per) - ends
    values = crcs.astype(np.uint32)
    for k in range(int(behind.max()).bit_length()):
        at = np.flatnonzero(behind >> k & 1)
        values[at] = _shift(values[at], tables[k])
    return np.bitwise_xor.reduceat(values, starts).astype(np.int64)


def verified_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of each document, from the store's files.

    The recipes are held against the manifest first: every part with its documents, ids and root. Each chunk's bytes are held against its digest where they are read, and each document's digests against its Merkle
    root; the document's crc32 is put together from its chunks' crc32s, so no ids move between tasks.
    """
    listed = spark.read.parquet(f"{path}/manifest").select("part", F.struct("n_docs", "n_tokens", "root").alias("listed"))
    there = _parts(spark.read.parquet(f"{path}/recipes")).select("part", F.struct("n_docs", "n_tokens", "root").alias("there"))
    if not listed.join(there, "part", "full").where(~F.col("listed").eqNullSafe(F.col("there"))).isEmpty():
        raise ValueError("the recipes aren't those of the manifest")
    first = spark.read.parquet(f"{path}/chunks").select(F.expr("length(ids) div n").alias("width")).first()
    width = first["width"] if first else 2
    chunks = spark.read.parquet(f"{path}/chunks").mapInPandas(_verified(width), "digest binary, n int, crc long")
    rows = _bound(spark, path, chunks)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _shift_tables()
        for batch in batches:
            held, n_tokens = batch["chunks"], batch["n_tokens"].to_numpy()
            starts, per = held.offsets.to_numpy()[:-1] - held.offsets[0].as_py(), np.diff(held.offsets.to_numpy())
            n, crc = (held.flatten().field(k).to_numpy().astype(np.int64) for k in ("n", "crc"))
            if len(per) and (np.add.reduceat(n, starts) != n_tokens).any():
                raise ValueError("a document's chunks don't hold its number of ids")
            for digests, root in zip(batch["digests"].to_pylist(), batch["root"].to_pylist()):
                if merkle_root(digests) != root:
                    raise ValueError("a document's recipe doesn't match its root")
            yield pa.record_batch({"doc_id": batch["doc_id"], "start": batch["start"], "n_tokens": batch["n_tokens"], "ids_crc32": joined_crc32(crc, 4 * n, starts, tables), "n_chunks": per.astype(np.int32)})

    return rows.mapInArrow(check, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks int")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int): the documents put together again from their chunks."""
    first = spark.read.parquet(f"{path}/chunks").select(F.expr("length(ids) div n").alias("width")).first()
    width = first["width"] if first else 2

    @F.pandas_udf("array<int>")
    def ids(chunks: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(bytes(c["ids"]) for c in x), dtype=f"<u{width}").astype(np.int32) for x in chunks])

    rows = _bound(spark, path, spark.read.parquet(f"{path}/chunks"))
    return rows.select("doc_id", "start", "n_tokens", ids("chunks").alias("ids"))


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes a store (to a new shared folder if no path is given) and returns what reading it back verifies."""
    path = path or scratch(docs.sparkSession, "token-store")
    write_store(docs, path, tokenizer, end_id)
    return verified_documents(docs.sparkSession, path)
