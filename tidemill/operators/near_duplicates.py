"""Near-duplicate texts by MinHash and banding, out of md5 and built-in functions, so that any SQL engine gives the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.components import connected_components
from tidemill.sources.tables import through

#: Rows of a signature in each band, and bands: texts alike at 0.8 share a band with a chance of 0.9998.
ROWS, BANDS = 4, 16
#: Hashes of which a task takes minima at once.
HELD = 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def masks() -> list[int]:
    """One 60-bit number for each row of a signature: the first 15 hexadecimal digits of the md5 of its number."""
    return [int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16) for i in range(ROWS * BANDS)]


def md5_number(x: Column) -> Column:
    """The first 60 bits of a string's md5."""
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("bigint")


def words(text: Column) -> Column:
    """The runs of characters other than white space (six ASCII ones), A-Z in lower case."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), r"[ \t-\r]+"), lambda w: w != "")


def shingles(words: Column, width: int) -> Column:
    """The distinct runs of `width` words; fewer words are one run, no words none. `words` must be a plain column, as each run reads it anew."""
    last = F.greatest(F.size(words) - width + 1, F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.array_distinct(F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>")))


def _hashed(width: int):
    table = bytes.maketrans(_UPPER.encode() + b"\t\n\x0b\x0c\r", _LOWER.encode() + b" " * 5)  # bytes of other UTF-8 characters are none of these

    def of(text: str | None) -> np.ndarray:
        ws = [w for w in (text or "").encode().translate(table).split(b" ") if w]
        runs = {b" ".join(ws[i : i + width]) for i in range(max(len(ws) - width + 1, 1))} if ws else ()
        heads = np.frombuffer(b"".join([hashlib.md5(r, usedforsecurity=False).digest() for r in runs]), dtype=">u8")[::2]
        return np.sort((heads >> np.uint64(4)).astype(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, found, held = 0, [], 0
            for i, text in enumerate(batch.column(1)):
                found.append(of(text.as_py()))
                held += len(found[-1]) + 1
                if held >= HELD or i + 1 == batch.num_rows:  # some texts at a time
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(found)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found)))], names=["doc_id", "hashes"])
                    lo, found, held = i + 1, [], 0

    return run


def hashed_shingles(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and hashes: `md5_number` of each of `shingles`, in order; text by text in Python, as Spark interprets functions on arrays row by row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_hashed(width), "doc_id long, hashes array<long>")


def shingle_sets(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(doc_id, set_id, n_shingles) of every row, and (set_id, hashes) of every distinct set that isn't empty.

    A set's id is the smallest id of the rows that have it: copies are one set from here on. Rows of a null id have sets, too.
    """
    rows = hashed_shingles(docs, width, id_col, text_col)
    rows = through(rows.withColumn("mark", F.md5(F.concat_ws(",", F.col("hashes").cast("array<string>")).cast("binary"))), "parquet")
    sets = rows.where(F.size("hashes") > 0).groupBy("mark").agg(F.min("doc_id").alias("set_id"), F.any_value("hashes").alias("hashes"))
    sets = through(sets, "parquet")
    named = rows.select("doc_id", "mark", F.size("hashes").cast("long").alias("n_shingles")).join(sets.select("mark", "set_id"), "mark", "left")
    return named.select("doc_id", "set_id", "n_shingles"), sets.where("set_id IS NOT NULL").select("set_id", "hashes")


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            hi = max(int(np.searchsorted(ends, ends[lo] - sizes[lo] + HELD, side="right")), lo + 1)
            flat, starts = batch.column(1).slice(lo, hi - lo).flatten().to_numpy(), ends[lo:hi] - sizes[lo:hi] - (ends[lo] - sizes[lo])
            least = np.stack([np.minimum.reduceat(flat ^ m, starts) for m in masks()], axis=1)
            offsets = pa.array(np.arange(hi - lo + 1) * least.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))], names=["set_id", "minima"])
            lo = hi


def signatures(sets: DataFrame) -> DataFrame:
    """set_id and minima (of the hashes XOR each mask) of each set that isn't empty, set by set: no row for each hash, and no shuffle."""
    return sets.where(F.size("hashes") > 0).select("set_id", "hashes").mapInArrow(_minima, "set_id long, minima array<long>")


def star_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, common and either: each set of a bucket against the bucket's smallest one, kept if den common >= num either.

    A bucket is a band and its value. One that a third of all rows share gives a link for each row, not one for each pair.
    Signatures are minima of hashes XOR a mask: of a random order of all hashes, each mask picks another first one.
    """
    bands = F.array(*(F.concat_ws(",", F.lit(b), *(F.col("minima")[b * ROWS + r].cast("string") for r in range(ROWS))) for b in range(BANDS)))
    buckets = through(signatures(sets).select("set_id", F.explode(F.transform(bands, lambda x: F.md5(x.cast("binary")))).alias("bucket")), "parquet")
    least = buckets.groupBy("bucket").agg(F.min("set_id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = through(buckets.join(least, "bucket").where("set_id <> a").select("a", F.col("set_id").alias("b")).distinct(), "parquet")
    left, right = (sets.select(F.col("set_id").alias(x), F.col("hashes").alias(f"of_{x}")) for x in ("a", "b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    checked = pairs.join(right, "b").join(left, "a").select("a", "b", common.cast("long").alias("common"), (F.size("of_a") + F.size("of_b") - common).cast("long").alias("either"))
    return checked.where(den * F.col("common") >= num * F.col("either"))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and group_id (the smallest id that star links reach) of every row.

    Texts without words have no shingles and are in a group of their own; rows with a null id stay and take the group of their
    text, or null. Repeated rows stay. Links that no star has are missed: the recall is measured in the tests.
    """
    rows, sets = shingle_sets(docs, width, id_col, text_col)
    of_set = connected_components(star_links(sets, num, den)).select(F.col("node").alias("set_id"), F.col("component"))
    return rows.join(of_set, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "set_id", "doc_id").alias("group_id"))
