"""Index episodes of note files as they change."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from memloom.config import DEFAULT, Config
from memloom.operators import memory_files
from memloom.sources import changed, store


def index_stream(spark: SparkSession, folder: str, root: str, checkpoint: str, prefix: str = "memory", config: Config = DEFAULT) -> StreamingQuery:
    """Starts the index of what is new or has changed below a folder: episodes and state below root, as the command line's index writes them.

    A batch that runs again replaces its own episodes, and its state tells the files as unchanged only once they are written.
    """
    spark.dataSource.register(changed.ChangedFiles)
    files = spark.readStream.format("changed_files").option("folder", folder).option("prefix", prefix).option("headBytes", config.file_head_bytes).option("maxBytes", config.file_max_bytes).load()

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
        rows = batch.select("path", "last_modified", "size", memory_files.excerpt(batch["head"], config).alias("excerpt"))
        state = store.current(spark, f"{root}/state", store.STATE)
        found = memory_files.classify(rows, state, config).persist()
        try:
            store.write_batch(memory_files.episodes(found, config), f"{root}/episodes", f"{query}-{number}", config)
            now = datetime.now(UTC)
            store.replace(memory_files.next_state(found, state, now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z"), f"{root}/state")
        finally:
            found.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
