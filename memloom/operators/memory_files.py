"""Memory files: which to index, what changed, and the episodes and state that follow.

files: (path, last_modified, size, excerpt); a null last_modified means unreadable.
state: (path, last_modified, last_indexed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.config import DEFAULT, Config
from memloom.functions import provenance
from memloom.functions import text as T


def excerpt(content: Column, config: Config = DEFAULT) -> Column:
    """The first characters of a file's head; a character that the head cuts becomes a replacement mark."""
    return F.left(F.make_valid_utf8(F.substring(content, 1, config.file_head_bytes).cast("string")), F.lit(config.excerpt_chars))


def classify(files: DataFrame, state: DataFrame, config: Config = DEFAULT, dry_run: bool = False) -> DataFrame:
    """files with status. A run tells indexed, unchanged, unreadable and filtered; a dry run tells new, updated, unchanged and filtered."""
    rows = files.join(state.select("path", F.col("last_modified").alias("_known")), "path", "left")
    known, read = F.col("_known").isNotNull(), F.col("last_modified").isNotNull()
    status = F.when(~T.is_indexable(F.col("path"), config.index_extensions), "filtered")
    if dry_run:
        status = status.when(~known, "new").when(read & (F.col("_known") != F.col("last_modified")), "updated").otherwise("unchanged")
    else:
        status = status.when(~read, "unreadable").when(known & (F.col("_known") == F.col("last_modified")), "unchanged").otherwise("indexed")
    return rows.withColumn("status", status).drop("_known")


def counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("status").agg(F.count("*").alias("files"))


def episodes(classified: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The index episodes of the files to be indexed."""
    kind = F.coalesce(F.nullif(T.file_extension(F.col("path")), F.lit("")), F.lit("unknown"))
    described = provenance.build("memory_index", F.col("last_modified"), config, file=F.col("path"), file_type=kind)
    return classified.where("status = 'indexed'").select("path", T.index_content(F.col("path"), F.col("last_modified"), F.col("excerpt"), F.col("size")).alias("content"), F.lit("system").alias("role_type"), F.lit("memory-index").alias("role"), T.index_name(F.col("path")).alias("name"), F.col("last_modified").alias("timestamp"), described.alias("source_description"))


def next_state(classified: DataFrame, state: DataFrame, now: str) -> DataFrame:
    """The state after the run: changed paths replaced, all others as they were."""
    changed = classified.where("status = 'indexed'").select("path", "last_modified", F.lit(now).alias("last_indexed"))
    return state.join(changed, "path", "left_anti").select("path", "last_modified", "last_indexed").unionByName(changed)


def written(calls: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(path) of memory files that tool calls (tool, params, error) without error wrote and that are indexable."""
    ok = calls.where(F.coalesce(F.col("error"), F.lit("")) == "")
    paths = ok.select(T.memory_path(F.col("tool"), F.col("params")).alias("path")).where("path is not null").distinct()
    return paths.where(T.is_indexable(F.col("path"), config.index_extensions))


def auto_index(calls: DataFrame, files: DataFrame, state: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """files (classified) that tool calls have written: what the hook after a tool call indexes; none with auto_index off."""
    paths = written(calls, config).where(F.lit(config.auto_index))
    return classify(files.join(paths, "path", "left_semi"), state, config)
