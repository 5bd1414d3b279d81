"""Capture from a stream of hook events, and windowed rates of a stream.

Each micro-batch goes through the batch captures. A batch's episodes are written
under the query's id and its number and overwritten when the batch is run again, so a
restart neither loses nor doubles them. Sweeps that take messages a second time
are kept: their event tells them apart.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.config import DEFAULT, Config
from memloom.operators import capture
from memloom.sources import store

#: Hook event -> capture of messages.
CAPTURES = {"ingest": capture.single, "ingest_batch": capture.batch, "compact": capture.compact, "before_compaction": capture.before_compaction, "before_reset": capture.before_reset}


def captured(rows: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Episodes of rows (event, session_key, idx, role, content, before), each by the capture of its event."""
    made = [f(rows.where(F.col("event") == event), now, now_ms, config) for event, f in CAPTURES.items()]
    turns = rows.where("event = 'after_turn'")
    counts = turns.groupBy("session_key").agg(F.max("before").alias("before"))
    made.append(capture.after_turn(turns.drop("before"), counts, now, now_ms, config))
    return reduce(DataFrame.unionByName, (m.select(*capture.COLUMNS) for m in made))


def capture_stream(rows: DataFrame, path: str, checkpoint: str, config: Config = DEFAULT, now: str | None = None) -> StreamingQuery:
    """Starts the capture of all rows that are there; episodes go to path. now: a fixed ISO time, for replays."""

    def write(batch: DataFrame, number: int) -> None:
        at = datetime.fromisoformat(now) if now else datetime.now(UTC)
        stamp = at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
        # The query's id, which a checkpoint keeps: another stream counts its batches from 0 too.
        query = json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        batch = batch.persist()  # six captures read it
        try:
            store.write_batch(captured(batch, stamp, int(at.timestamp() * 1000), config), path, f"{query}-{number}", config)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, most): count and largest value by event time window and type; a stream drops rows later than `late`."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "most")
