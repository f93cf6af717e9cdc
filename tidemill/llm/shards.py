"""Two-pass external shuffle of a corpus into shards of equal row counts.

Pass one scatters the records by a seeded hash into buckets that fit into a task's memory; the scatter is one Spark
exchange. Pass two applies Spark's Fisher-Yates array shuffle to each bucket and writes the records. Buckets follow
each other in one global order, and shard s takes the places floor(s*N/S) to floor((s+1)*N/S), so shards differ by
at most one row and no second exchange is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import scratch, written

#: Cells of the hash in which rows and bytes are counted before buckets are drawn, at least; a corpus of more than a quarter as
#: many buckets is counted again in more of them.
CELLS = 1 << 20
#: Buckets up to which the table of their places is broadcast.
SMALL = 1 << 20
#: Copies of a row that one task's row gives at a time where a cell is too full.
COPIES = 1024


def _spread(rows: DataFrame, full: DataFrame, seed: int, n_cells: int) -> DataFrame:
    """The rows, where those of full cells have the number of the copy in their hash too.

    Rows of a full cell are mostly copies: they meet as counts, go out as blocks of copies, and become rows again there.
    """
    spark = rows.sparkSession
    n = F.col("n")
    copies = rows.join(full, "cell", "left_semi").groupBy("doc_id", "text", "size").agg(F.count("*").alias("n"))
    blocks = copies.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))))
    blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "text", "block")
    copy = F.explode(F.sequence(F.col("block") * COPIES, F.least(n, (F.col("block") + 1) * COPIES) - 1))
    cell = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "copy"), F.lit(n_cells)).alias("cell")
    apart = blocks.withColumn("copy", copy).select("doc_id", "text", "size", cell)
    return rows.join(full, "cell", "left_anti").select("doc_id", "text", "size", "cell").unionByName(apart)


def _scattered(read: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, DataFrame, int, int]:
    """doc_id, text, size and bucket of all rows; rows and bytes of each bucket's cells; numbers of rows and of buckets."""
    sums = F.count("*").alias("n"), F.sum("size").alias("bytes")

    def celled(n_cells: int) -> DataFrame:
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
        return read.select("doc_id", "text", size, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(n_cells)).alias("cell"))

    def counted(rows: DataFrame) -> tuple[DataFrame, int, int]:
        cells = written(rows.groupBy("cell").agg(*sums), "shard-cells")
        total = cells.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
        return cells, total["n"] or 0, max(1, -(-(total["bytes"] or 0) // bucket_bytes))

    n_cells = CELLS
    rows = celled(n_cells)
    cells, n_rows, n_buckets = counted(rows)
    if 4 * n_buckets > n_cells:
        n_cells = 1 << (16 * n_buckets - 1).bit_length()
        rows = celled(n_cells)
        cells, n_rows, n_buckets = counted(rows)
    full = cells.where((F.col("bytes") > bucket_bytes) & (F.col("n") > 1)).select("cell")
    if not full.isEmpty():
        rows = _spread(rows, full, seed, n_cells)
        cells, n_rows, n_buckets = counted(rows)

    bucket = F.floor(F.col("cell") * (n_buckets / n_cells)).cast("int")
    return rows.withColumn("bucket", bucket), cells.withColumn("bucket", bucket), n_rows, n_buckets


def shuffled_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20240229, bucket_bytes: int = 32 << 20, path: str | None = None) -> DataFrame:
    """Writes all records to `path` (partitioned by shard) in shuffled order and returns them as read back.

    Columns: doc_id, text, size (UTF-8 bytes and one), text_crc32, shard, slot (0 to the shard's rows less one).
    The order depends on seed, ids and texts alone, and on how many buckets the input's size gives. Cells are at least four times as
    many as buckets at any size, so a bucket holds about bucket_bytes, or one row that is larger.

    Null texts count as empty in size and crc32 and stay null; null ids are kept. Rows that agree in id and text fall
    into one bucket as long as they are smaller than it, else each copy has a place of its own. An empty table gives no rows. Columns other than the two named ones are not read.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, sizes, n_rows, n_buckets = _scattered(read, seed, bucket_bytes)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    record = F.struct("doc_id", "text", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    piles = (
        rows.repartitionById(n_buckets, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(record)).alias("pile"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("pile", F.lit(seed)).alias("pile"))
    )
    places = (
        piles.select("bucket", F.posexplode("pile").alias("pos", "record"))
        .join(F.broadcast(offsets) if n_buckets <= SMALL else offsets, "bucket")
        .select("record.*", (F.col("offset") + F.col("pos")).alias("place"))
    )
    shard = F.expr(f"((place + 1) * {shards} - 1) div {max(1, n_rows)}")
    out = places.withColumn("shard", shard.cast("int")).select(
        "doc_id", "text", "size", "text_crc32",
        (F.col("place") - F.expr(f"(cast(shard as bigint) * {n_rows}) div {shards}")).alias("slot"), "shard",
    )
    path = path or scratch(spark, "shards")
    out.write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
