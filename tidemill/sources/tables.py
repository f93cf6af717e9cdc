"""Reading the tables of a data folder, and round trips through other file formats."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that isn't set and all runs on this machine, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read again: cuts the lineage and outlives executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def through(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """The rows, written in a format and read again with the same schema: never inferred, so nothing is read twice."""
    path = shared_folder(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def partitioned(df: DataFrame, *columns: str) -> DataFrame:
    """The rows, written in a folder for each value of the columns; filters on them then skip whole folders."""
    path = shared_folder(df.sparkSession, "partitioned")
    df.write.partitionBy(*columns).parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, by: str, buckets: int = 8) -> DataFrame:
    """The rows as a table of files bucketed and sorted by a column: joins of two such tables on it move no rows.

    The files lie in the shared folder, and the catalog of the session knows the table by a name of its own.
    """
    spark = df.sparkSession
    path = shared_folder(spark, "bucketed")
    name = "bucketed_" + path.rpartition("-")[2]
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).sortBy(by).saveAsTable(name)
    return spark.table(name)


def overwritten(df: DataFrame, path: str, *columns: str) -> None:
    """Writes rows over those partitions of a table of files that they belong to; other partitions stay. Doing it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)
