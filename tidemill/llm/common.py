"""What the corpus operators share: scratch tables, words, and fingerprints."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
_TO_SPACE = str.maketrans(dict.fromkeys(SPACES, " "))
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    """The runs of characters other than white space; none for null."""
    if not text:
        return []
    for space in "\n\t\r\x0b\x0c":
        if space in text:
            text = text.replace(space, " ")
    return [word for word in text.split(" ") if word]


def lower_ascii(text: str) -> str:
    """A-Z in lower case; all else as it is."""
    return text.lower() if text.isascii() else text.translate(_TO_LOWER)


def word_column(texts: list[str | None] | pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts (Arrow strings), each word's place among them, text after text, and their counts.

    The same words as `words` gives, split and numbered by Arrow; with `lower`, A-Z are in lower case.
    """
    if isinstance(texts, pa.Array):  # taken, as kernels on slices of a column read from its start
        column = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())
    else:
        column = pa.array(texts, pa.large_string(), from_pandas=True)
    column = column.fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    coded = lists.flatten().dictionary_encode()
    distinct, at = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    empty = pc.index(distinct, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:  # white space at a text's end leaves an empty word
        there = at != empty
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there], minlength=len(counts))
        at = at[there]
        at -= at > empty
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return distinct, at, counts


def word_ids(texts: list[str | None], lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As `word_column`, with the distinct words as Python strings."""
    distinct, at, counts = word_column(texts, lower)
    return distinct.to_pylist(), at, counts


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, well mixed (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, counter: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on key and counter alone."""
    with np.errstate(over="ignore"):
        return ((mixed(key + mixed(np.asarray(counter).astype(np.uint64) + MIX_B)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def word_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hashes of Arrow strings (large_string), from a sum over their bytes with their places."""
    out = np.zeros(len(column), dtype=np.uint64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    sizes = np.diff(offsets)
    some = np.flatnonzero(sizes)
    with np.errstate(over="ignore"):
        if len(some):
            data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
            starts = offsets[:-1] - offsets[0]
            place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
            terms = mixed(data.astype(np.uint64) + np.uint64(257) * (place.astype(np.uint64) + np.uint64(1)))
            out[some] = np.add.reduceat(terms, starts[some])
        return mixed(out + sizes.astype(np.uint64) * MIX_A)


def fold(doc_id: object, modulus: int) -> int:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(int(doc_id)).encode()) % modulus


def fold_column(doc_id: Column, modulus: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; one of our own only where none is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to a shared folder and read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table of `written` that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def slices(texts: list | pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many characters (bytes of an Arrow column), or one text."""
    start, held = 0, 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist() if isinstance(texts, pa.Array) else [len(text or "") for text in texts]
    for i, size in enumerate(sizes):
        held += size + 64
        if held > most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
