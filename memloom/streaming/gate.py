"""The recall gate over a stream: the state machine of operators.recall.gate, kept by session.

A stateful processor holds one typed value for each session in RocksDB: the epoch,
whether its event is pending, and whether the session was recalled. With `idle_ms` the store
drops a session's state so long after its last event, and the session then starts
anew. Such a stream runs on until it is stopped; only without `idle_ms` a run over what is
there (availableNow) ends by itself.
Rows of one micro-batch are taken in order of seq; rows of a later batch count as
later whatever their seq. A session's rows of one micro-batch are sorted together; the
source's limits (files or bytes for each trigger) bound them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "session_key string, seq long, epoch long, fire boolean, injected boolean"
STATE = "epoch long, pending boolean, recalled boolean"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Gate(StatefulProcessor):
    """Answers each event of a session from its state."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("gate", STATE, **({"ttlDurationMs": self.idle_ms} if self.idle_ms else {}))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803 (names of the interface)
        epoch, pending, recalled = self.state.get() if self.state.exists() else (0, False, False)
        for row in sorted(rows, key=lambda r: r.seq):
            if row.kind != "assemble":
                epoch, pending, recalled = epoch + 1, True, False
                yield Row(session_key=key[0], seq=row.seq, epoch=epoch, fire=None, injected=None)
                continue
            fire = bool(pending or row.deictic or (row.gap and not recalled))
            injected = fire and bool(row.nonempty)
            pending, recalled = False, recalled or injected
            yield Row(session_key=key[0], seq=row.seq, epoch=epoch, fire=fire, injected=injected)
        self.state.update((epoch, pending, recalled))

    def close(self) -> None:
        pass


def gate(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(session_key, seq, epoch, fire, injected) for streamed events (session_key, seq, kind, gap, deictic, nonempty).

    Sets the session's state store to RocksDB, which such state needs.
    """
    events.sparkSession.conf.set(PROVIDER, ROCKSDB)
    rows = events.select("session_key", "seq", "kind", "gap", "deictic", "nonempty")
    return rows.groupBy("session_key").transformWithState(Gate(idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None")
