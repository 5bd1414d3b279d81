"""Progress of streams in the log, in the order in which it arrives."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from memloom.functions import text as T
from memloom.sources import store


class LogListener(StreamingQueryListener):
    """Writes a line for each start, each micro-batch with rows and each end of the session's streams.

        spark.streams.addListener(LogListener(spark, "FOLDER/log"))
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _write(self, event: str, stamp: str, **fields: object) -> None:
        pairs = [(k, F.lit(None if v is None else str(v)).cast("string")) for k, v in fields.items()]
        store.append_log(self.spark.range(1).select(T.log_line(F.lit(stamp), F.lit(event), pairs).alias("line")), self.path)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802 (names of the interface)
        self._write("start", event.timestamp, query=event.name or event.id)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        if p.numInputRows:
            self._write("batch", p.timestamp, query=p.name or p.id, batch=p.batchId, rows=p.numInputRows, ms=p.batchDuration)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        now = datetime.now(UTC)
        self._write("end", now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z", query=event.id, error=event.errorClassOnException)
