"""Nearest vectors by inner product: all rows in blocks of queries, and an inverted-file index that looks at the nearest cells.

Equal vectors are one entry with its smallest ids: of a group of copies no more than those can be among the nearest, so a
group that holds a third of all rows costs no more than a single row, as an answer and as a question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import through

#: Questions that are sent to all executors at once, vectors that the cells are fitted to at most, and cells at most.
BLOCK, SAMPLE, CELLS = 4_096, 16_384, 4_096
#: Vectors of a cell, on average, and how many times that a cell may hold before it is cut.
PER_CELL, HOT = 256, 4
#: Questions of which the exact neighbours say how many cells to probe.
TRIALS = 128
#: Vectors and questions of one piece of a cell.
PIECE = 8_192
#: Scores or distances that a task holds at once (eight bytes each, a few times over).
HELD = 1 << 20
FOUND = "question string, vec_id long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length as the rows of a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row, equal ones by ascending id (ids: of all rows, or one row for each)."""
    width, rows = score.shape[1], np.arange(len(score))[:, None]
    ids = np.broadcast_to(ids, score.shape)
    near = np.broadcast_to(np.arange(width), score.shape)
    if width > 4 * k:  # no more than what reaches the k-th largest is sorted
        edge = np.partition(score, width - k, axis=1)[:, width - k]
        most = int((score >= edge[:, None]).sum(axis=1).max())
        if most < width:
            near = np.argpartition(score, width - most, axis=1)[:, width - most :]
    return near[rows, np.lexsort((ids[rows, near], -score[rows, near]), axis=1)[:, :k]]


def _found(keys: list[str], ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Rows of FOUND from one row of ids and scores for each key."""
    who = pa.array(np.repeat(np.arange(len(keys)), ids.shape[1]))
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(who), pa.array(ids.ravel()), pa.array(score.ravel())], names=["question", "vec_id", "score"])


def entries(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """key (of the vector), vec_id and vector of the k + 1 smallest ids of each group of equal vectors; rows without an id or vector have no place."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where("vec_id IS NOT NULL AND vector IS NOT NULL")
    rows = rows.withColumn("key", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256))
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    return rows.withColumn("place", place).where(F.col("place") <= k + 1).select("key", "vec_id", "vector")


def _questions(vectors: DataFrame, asked, id_col: str, vector_col: str) -> DataFrame:
    """key and vec_id of each row that asks."""
    rows = vectors.where(asked).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vector")).where("query_id IS NOT NULL AND vector IS NOT NULL")
    return rows.select("query_id", F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256).alias("key"), "vector")


def _answers(found: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id and score, from the nearest of each distinct question (its key); a row isn't its own neighbour."""
    first = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    nearest = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).drop("place")
    rows = questions.select("query_id", F.col("key").alias("question")).join(nearest, "question").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(index: DataFrame, block: list, k: int) -> DataFrame:
    """The k + 1 nearest entries of each question (rows of key and vector) in each task."""
    sent = index.sparkSession.sparkContext.broadcast(([r.key for r in block], np.array([r.vector for r in block], dtype=np.float64)))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wanted = sent.value
        step = max(HELD // 4_096, 1)
        best = [(np.zeros((len(keys[lo : lo + step]), 0)), np.zeros((len(keys[lo : lo + step]), 0), dtype=np.int64)) for lo in range(0, len(keys), step)]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for start in range(0, len(ids), 1_024):
                new, rows = ids[start : start + 1_024], _matrix(batch.column(1)[start : start + 1_024]).T
                for part, (best_score, best_id) in enumerate(best):  # some questions at a time, so scores stay small
                    score = np.concatenate([best_score, np.round(wanted[part * step : (part + 1) * step] @ rows, 6)], axis=1)
                    all_ids = np.concatenate([best_id, np.broadcast_to(new, (len(best_id), len(new)))], axis=1)
                    at = _best(score, all_ids, k + 1)
                    best[part] = np.take_along_axis(score, at, axis=1), np.take_along_axis(all_ids, at, axis=1)
        for part, (best_score, best_id) in enumerate(best):
            yield _found(keys[part * step : (part + 1) * step], best_id, best_score)

    return index.select("vec_id", "vector").mapInArrow(of, FOUND)


def exact_neighbours(vectors: DataFrame, asked, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest other rows of each row for which `asked` holds.

    Scores are inner products in doubles, rounded to six digits; equal ones go by ascending id. The rows that ask are a stated set:
    distinct ones meet all entries in blocks of BLOCK vectors, each sent to all executors; a task keeps k + 1 rows a question.
    """
    spark = vectors.sparkSession
    index = through(entries(vectors, k, id_col, vector_col), "parquet")
    questions = through(_questions(vectors, asked, id_col, vector_col), "parquet")
    found, block = None, []
    for row in questions.dropDuplicates(["key"]).select("key", "vector").toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            part = through(_scan(index, block, k), "parquet")
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = _scan(index, block, k) if block else spark.createDataFrame([], FOUND)
        found = part if found is None else found.unionByName(part)
    return _answers(found, questions, k)


def fitted(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most so many centres of a sample, by Lloyd's iterations; empty cells take the vectors farthest from their centres."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = distinct[rng.permutation(len(distinct))[:cells]]
    for _ in range(rounds):
        cell, near = _nearest(distinct, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, distinct)
        n = np.bincount(cell, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = distinct[np.argsort(-near)[: len(empty)]]
    return centres


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row by Euclid, and the distance (squared, without the row's own norm)."""
    cell, near, norms, step = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows)), (centres**2).sum(axis=1), max(HELD // max(len(centres), 1), 1)
    for lo in range(0, len(rows), step):  # so many rows at a time that the distances to all centres stay few
        distance = norms - 2 * rows[lo : lo + step] @ centres.T
        own = cell[lo : lo + step] = distance.argmin(axis=1)
        near[lo : lo + step] = distance[np.arange(len(own)), own]
    return cell, near + (rows**2).sum(axis=1)


def _assigned(rows: DataFrame, sent: Broadcast) -> DataFrame:
    """key, vec_id, vector and the cell of each entry."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_nearest(_matrix(batch.column(2)[i : i + 4_096]), sent.value)[0] for i in range(0, batch.num_rows, 4_096)]
            cell = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["key", "vec_id", "vector", "cell"])

    return rows.mapInArrow(of, "key string, vec_id long, vector array<float>, cell int")


def inverted_file(index: DataFrame, n: int, sample: int = SAMPLE, per_cell: int = PER_CELL) -> tuple[DataFrame, np.ndarray]:
    """Every entry with its cell, and the cells' centres.

    Centres are fitted to `sample` entries at most, taken by the hash of their vectors; there is one for `per_cell` entries, CELLS
    at most. A cell of more than HOT times its share is fitted again by itself, to a sample of its own entries and up to three
    times over, so dense parts of the space get more cells; what stays larger (copies don't: they are one entry) is cut into pieces when searched.
    """
    spark = index.sparkSession
    rows = index.orderBy(F.xxhash64("key", "vec_id")).limit(sample).select("vector").toArrow()
    cells = max(min(n // per_cell, CELLS), 1)
    centres = fitted(np.array(rows.column(0).to_pylist(), dtype=np.float64), cells) if rows.num_rows else np.zeros((1, 0))
    limit = HOT * max(n // cells, per_cell)
    for _ in range(3):
        held = through(_assigned(index, spark.sparkContext.broadcast(centres)), "parquet")
        hot = {r.cell: r["count"] for r in held.groupBy("cell").count().where(F.col("count") > limit).collect()}  # no more rows than cells
        if not hot or len(centres) >= 4 * CELLS:
            break
        share = max(sample // len(hot), 64)
        place = Window.partitionBy("cell").orderBy(F.xxhash64("key", "vec_id"))
        mine = held.where(F.col("cell").isin(list(hot))).withColumn("place", F.row_number().over(place)).where(F.col("place") <= share).select("cell", "vector").toArrow()
        cell, rows = mine.column(0).to_numpy(), np.array(mine.column(1).to_pylist(), dtype=np.float64)
        more = [fitted(rows[cell == c], -(-HOT * count // limit) * 2) for c, count in hot.items()]
        centres = np.concatenate([np.delete(centres, list(hot), axis=0), *more])
    else:
        held = through(_assigned(index, spark.sparkContext.broadcast(centres)), "parquet")
    return held, centres


def _probing(sent: Broadcast, probes: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = sent.value
        n = min(probes, len(centres))
        for whole in batches:
            step = max(min(HELD // len(centres), HELD // 16 // n), 1)  # each row's vector goes out n times
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                distance = (centres**2).sum(axis=1) - 2 * _matrix(batch.column(1)) @ centres.T
                near = np.argpartition(distance, n - 1, axis=1)[:, :n] if n < len(centres) else np.broadcast_to(np.arange(len(centres)), distance.shape)
                at = pa.array(np.repeat(np.arange(batch.num_rows), n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["question", "asked", "cell"])

    return of


def _piece(k: int):
    def of(key: tuple, questions: pa.Table, rows: pa.Table) -> pa.Table:
        if not questions.num_rows or not rows.num_rows:
            return pa.table({"question": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, vectors = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks())
        keys, wanted = questions.column("question").to_pylist(), _matrix(questions.column("asked").combine_chunks())
        out, step = [], max(HELD // len(ids), 1)
        for start in range(0, len(keys), step):
            score = np.round(wanted[start : start + step] @ vectors.T, 6)
            at = _best(score, ids, k + 1)
            out.append(_found(keys[start : start + step], ids[at], np.take_along_axis(score, at, axis=1)))
        return pa.Table.from_batches(out)

    return of


def _probes(index: DataFrame, held: DataFrame, centres: np.ndarray, distinct: DataFrame, k: int, target: float) -> int:
    """How many of the nearest cells hold `target` of the neighbours of TRIALS questions, by the exact way."""
    block = distinct.orderBy(F.xxhash64("key")).limit(TRIALS).collect()
    if not block:
        return 1
    first = Window.partitionBy("question").orderBy(F.desc("score"), "vec_id")
    true = _scan(index, block, k).withColumn("place", F.row_number().over(first)).where(F.col("place").between(2, k + 1))  # the first is its own
    cells = {}
    for r in held.join(F.broadcast(true), "vec_id").select("question", "cell").toLocalIterator():
        cells.setdefault(r.question, []).append(r.cell)
    ranks = []
    for row in block:
        place = np.argsort(np.argsort((centres**2).sum(axis=1) - 2 * np.array(row.vector, dtype=np.float64) @ centres.T))
        ranks += (place[cells.get(row.key, [])] + 1).tolist()
    return int(np.quantile(ranks, target, method="higher")) if ranks else 1


def index_neighbours(vectors: DataFrame, asked, k: int = 10, probes: int | None = None, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, per_cell: int = PER_CELL) -> DataFrame:
    """As `exact_neighbours`, but each question looks at its `probes` nearest cells alone; every row is in a cell.

    Without `probes`, so many are looked at as hold `target` of the exact neighbours of TRIALS questions. Cells and questions meet
    by shuffle on cell and piece: a cell above PIECE entries is cut by hash and its questions go to every piece, and questions
    of one cell above PIECE are cut too. Neighbours in farther cells are missed; `recall` measures how many.
    """
    spark = vectors.sparkSession
    index = through(entries(vectors, k, id_col, vector_col), "parquet")
    questions = through(_questions(vectors, asked, id_col, vector_col), "parquet")
    held, centres = inverted_file(index, index.count(), sample, per_cell)
    if not centres.shape[1]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = questions.dropDuplicates(["key"]).select("key", "vector")
    probes = probes or _probes(index, held, centres, distinct, k, target)
    probed = distinct.mapInArrow(_probing(spark.sparkContext.broadcast(centres), probes), "question string, asked array<float>, cell int")
    probed = through(probed, "parquet")

    def pieces(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.count("*") / PIECE).cast("long").alias(name))

    cut = F.broadcast(pieces(held, "rows").join(pieces(probed, "asks"), "cell"))  # no more rows than cells
    left = probed.join(cut, "cell").withColumn("ask", F.pmod(F.xxhash64("question"), F.col("asks"))).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    right = held.join(cut, "cell").withColumn("row", F.pmod(F.xxhash64("vec_id"), F.col("rows"))).withColumn("ask", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asks") - 1)))
    keys = ("cell", "row", "ask")
    both = left.select(*keys, "question", "asked").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "vector").groupBy(*keys))
    return _answers(both.applyInArrow(_piece(k), FOUND), questions, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """hits and wanted: of the neighbours by the exact way, how many the other found (or others with the same score)."""
    edge = exact.groupBy("query_id").agg(F.min("score").alias("edge"), F.count("*").alias("wanted"))
    hits = found.join(edge, "query_id").where(F.col("score") >= F.col("edge")).groupBy("query_id").agg(F.count("*").alias("hits"))
    return edge.join(hits, "query_id", "left").agg(F.coalesce(F.sum(F.least("hits", "wanted")), F.lit(0)).alias("hits"), F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"))
