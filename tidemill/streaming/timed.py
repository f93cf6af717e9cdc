"""Streams with timers: sessions kept as state of our own and given out when event time has passed them, and an outer join of two streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemill.sources.tables import shared_folder, table
from tidemill.streaming.events import run_to_end

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SESSION = "user_id long, start long, end long, n long"


class Sessions(StatefulProcessor):
    """Open sessions of one key as a list state of (start, last event, events), in microseconds, and one timer at the end of the first to end.

    An event joins all sessions within `gap` of it, so rows may come in any order. When the watermark passes the timer, all sessions
    that it has passed are given out and forgotten, and the timer is set for the next: the state holds what is still open and no
    more, and a key costs a call for each advance of the watermark, not one for each session.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", "start long, last long, n long")

    def _due(self, last: int) -> int:
        """Milliseconds at which a session has ended."""
        return -(-(last + self.gap) // 1_000)

    def _first(self, sessions: list[tuple[int, int, int]]) -> int | None:
        return min((self._due(last) for _, last, _ in sessions), default=None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names that Spark gives
        before = [tuple(s) for s in self.open.get()]
        parts = before + [(t, t, 1) for frame in rows for t in frame["us"].tolist()]
        merged: list[tuple[int, int, int]] = []
        for start, last, n in sorted(parts):
            if merged and start < merged[-1][1] + self.gap:
                merged[-1] = (merged[-1][0], max(merged[-1][1], last), merged[-1][2] + n)
            else:
                merged.append((start, last, n))
        old, new = self._first(before), self._first(merged)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        self.open.put(merged)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        sessions = [tuple(s) for s in self.open.get()]
        over, still = ([s for s in sessions if (self._due(s[1]) <= now) == done] for done in (True, False))
        if still:
            self.open.put(still)
            self.handle.registerTimer(self._first(still))
        else:
            self.open.clear()
        yield pd.DataFrame([(key[0], s, last + self.gap, n) for s, last, n in over], columns=["user_id", "start", "end", "n"], dtype="int64")

    def close(self) -> None:
        pass


def timed_sessions(spark: SparkSession, source: str, path: str, checkpoint: str, gap_seconds: int = 6 * 3600, delay: str = "10 minutes") -> list[dict]:
    """Runs sessions over the events (event_id, user_id, ts) in the folder `source` as far as they have come, to `path`; takes up `checkpoint` where it stopped.

    Rows of a null user or time belong to no session. The state store of RocksDB, which list states and timers need, is set in a session
    of its own, so other streams keep theirs. A batch that is tried again writes its folder anew. Returns the run's progress reports.
    """
    own = spark.newSession()
    own.conf.set(*ROCKS)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    events = own.readStream.schema("event_id long, user_id long, ts timestamp").parquet(source).where("user_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    keyed = events.select("user_id", F.unix_micros("ts").alias("us"), "ts").groupBy("user_id")
    found = keyed.transformWithStateInPandas(Sessions(gap_seconds * 1_000_000), SESSION, "append", "eventTime")
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/{number}")
    query = found.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p if isinstance(p, dict) else p.jsonValue() for p in query.recentProgress]


def sessions_read(spark: SparkSession, path: str) -> DataFrame:
    """What `timed_sessions` has given out."""
    found = spark.read.schema(SESSION).option("recursiveFileLookup", "true").parquet(path)
    return found.select("user_id", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n")


def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, given out once the watermark has passed their end; those still open at the end of the stream aren't.

    The events come in two deliveries, and the second run takes up the state of the first.
    """
    source, path, checkpoint = (shared_folder(spark, name) for name in ("timed-source", "timed", "timed-state"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    middle = events.select(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.expr("a + (b - a) / 2").alias("middle"))
    for early in (True, False):
        part = events.crossJoin(F.broadcast(middle)).where((F.col("ts") <= F.col("middle")) == F.lit(early)).drop("middle")  # one row
        part.write.mode("append").parquet(source)
        timed_sessions(spark, source, path, checkpoint)
    return sessions_read(spark, path)


def clicks_with_purchases(spark: SparkSession, sf_dir: str, progress: list | None = None) -> DataFrame:
    """Clicks with each purchase of the same user within ten minutes, and those that none followed as soon as the watermark says so.

    Both sides' state is bounded: a purchase can't meet clicks more than ten minutes before it, nor a click purchases after that.
    """
    raw = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    clicks = raw.where("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id")).withWatermark("click_ts", "10 minutes")
    buys = raw.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts"), F.col("event_id").alias("buy_id")).withWatermark("buy_ts", "10 minutes")
    near = F.expr("user_id = buyer AND buy_ts > click_ts AND buy_ts <= click_ts + INTERVAL 10 MINUTES")
    return run_to_end(clicks.join(buys, near, "left_outer").select("user_id", "click_id", "buy_id"), "append", progress)


QUERIES = {"stream_timers": stream_timers, "stream_join_outer": clicks_with_purchases}
ORACLES = {
    "stream_timers": """WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
        SELECT user_id, min(ts)::TIMESTAMP AS "start", (max(ts) + INTERVAL 6 HOUR)::TIMESTAMP AS "end", count(*) AS n FROM b GROUP BY user_id, s
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "stream_join_outer": """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
        w AS (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
        SELECT c.user_id, c.event_id AS click_id, p.event_id AS buy_id FROM c LEFT JOIN p ON c.user_id = p.user_id AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 10 MINUTE, w
        WHERE p.event_id IS NOT NULL OR c.ts + INTERVAL 10 MINUTE < mark""",
}
