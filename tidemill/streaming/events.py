"""Structured Streaming over the events table, read as a stream of files and run until all of it has come.

Each query ends in Parquet in the shared folder, so that the result outlives the stream. Windows use complete mode, which
keeps the windows that the watermark has not yet closed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.sources.tables import shared_folder, table


def stream(spark: SparkSession, sf_dir: str, watermark: str = "10 minutes") -> DataFrame:
    """events as a stream with a watermark on ts, which has to be a timestamp with a zone for that."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run_to_end(df: DataFrame, mode: str, progress: list | None = None) -> DataFrame:
    """Runs the stream over all there is, then returns what it wrote; the run's progress reports are added to `progress`."""
    spark = df.sparkSession
    path = shared_folder(spark, "stream")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else number}")  # noqa: E731  a batch that is tried again writes its folder anew
    started = df.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark, "stream-state")).foreachBatch(write).trigger(availableNow=True).start()
    started.awaitTermination()
    if progress is not None:
        progress += started.recentProgress
    return spark.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(path)


def _bounds(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), *(c for c in df.columns if c != "window"))


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and users of each day."""
    days = stream(spark, sf_dir).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return _bounds(run_to_end(days, "complete"))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type in windows of two days that start every day."""
    windows = stream(spark, sf_dir).groupBy(F.window("ts", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return _bounds(run_to_end(windows, "complete"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user's sessions, which end after six hours without an event."""
    gaps = stream(spark, sf_dir).groupBy(F.session_window("ts", "6 hours").alias("window"), "user_id").agg(F.count("*").alias("n"))
    return _bounds(run_to_end(gaps, "complete"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though the stream brings each twice."""
    twice = stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id", "event_type")
    return run_to_end(once, "append")


def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a click and a purchase of one user within ten minutes, joined stream to stream."""
    clicks = stream(spark, sf_dir).where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    buys = stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id"))
    near = F.expr("user_id = buyer AND buy_ts > click_ts AND buy_ts <= click_ts + INTERVAL 10 MINUTES")
    return run_to_end(clicks.join(buys, near).select("user_id", "click_id", "buy_id"), "append")


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and the largest value of each user so far, kept as state of our own."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for frame in frames:
            n, top = n + len(frame), max(top, float(frame["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    kept = stream(spark, sf_dir).select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double", "update", GroupStateTimeout.NoTimeout)
    seen = run_to_end(kept, "update")
    return seen.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


class _Totals(StatefulProcessor):
    """Events and the largest value of a user, in a value state that has a schema and outlives restarts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.total = handle.getValueState("total", "n long, top double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark gives
        n, top = self.total.get() if self.total.exists() else (0, float("-inf"))
        for frame in rows:
            n, top = n + len(frame), max(top, float(frame["value"].max()))
        self.total.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    def close(self) -> None:
        pass


def transformed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """running_totals by a stateful processor, whose state needs the RocksDB store; the session's own store is put back."""
    name, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, rocks)
    try:
        rows = stream(spark, sf_dir).select("user_id", "value").groupBy("user_id")
        seen = run_to_end(rows.transformWithStateInPandas(_Totals(), "user_id long, n long, top double", "update", "none"), "update")
    finally:
        spark.conf.set(name, before)
    return seen.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


def late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day as a watermark of ten minutes closes it, when every fiftieth event comes after all others.

    The events come in two deliveries to one folder, and the stream takes up its checkpoint for the second. Late events
    of a day that the watermark has closed are dropped; those of the day still open count. Days still open at the end
    aren't given out.
    """
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    source, state, path = (shared_folder(spark, name) for name in ("stream-late", "stream-state", "stream"))
    late = F.col("event_id") % 50 == 0
    for rows in (events.where(~late | late.isNull()), events.where(late)):
        rows.write.mode("append").parquet(source)
        days = spark.readStream.schema(events.schema).parquet(source).withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
        write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{number}")
        days.writeStream.outputMode("append").option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return _bounds(spark.read.schema(days.schema).option("recursiveFileLookup", "true").parquet(path))


QUERIES = {
    "stream_tumbling": tumbling, "stream_sliding": sliding, "stream_session": sessions,
    "stream_dedup": deduplicated, "stream_join_interval": purchases_after_clicks, "stream_state": running_totals,
    "stream_transform_state": transformed_totals, "stream_late": late_dropped,
}
ORACLES = {
    "stream_tumbling": """SELECT date_trunc('day', ts)::TIMESTAMP AS "start", (date_trunc('day', ts) + INTERVAL 1 DAY)::TIMESTAMP AS "end",
        count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""",
    "stream_sliding": """SELECT (date_trunc('day', ts) - INTERVAL (k) DAY)::TIMESTAMP AS "start", (date_trunc('day', ts) + INTERVAL (2 - k) DAY)::TIMESTAMP AS "end",
        event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL""",
    "stream_session": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT min(ts)::TIMESTAMP AS "start", (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", user_id, count(*) AS n FROM b GROUP BY user_id, s""",
    "stream_dedup": "SELECT event_id, user_id, event_type FROM events",
    "stream_join_interval": """SELECT c.user_id, c.event_id AS click_id, p.event_id AS buy_id FROM events c JOIN events p ON c.user_id = p.user_id
        AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 10 MINUTE""",
    "stream_transform_state": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id",
    "stream_late": """WITH e AS (SELECT *, coalesce(event_id % 50 = 0, false) AS late, date_trunc('day', ts) + INTERVAL 1 DAY AS closing FROM events),
        w AS (SELECT max(ts) FILTER (WHERE NOT late) - INTERVAL 10 MINUTE AS first, max(ts) - INTERVAL 10 MINUTE AS second FROM e)
        SELECT date_trunc('day', ts)::TIMESTAMP AS "start", closing::TIMESTAMP AS "end", count(*) AS n FROM e, w
        WHERE closing <= second AND (NOT late OR closing > first) GROUP BY ALL""",
    "stream_state": "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id",
}
