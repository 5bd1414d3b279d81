"""Conversation messages (session_key, idx, role, content[, blocks]) to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.config import DEFAULT
from memloom.functions import text as T

SPEAKERS = ("user", "assistant")


def speakers(messages: DataFrame) -> DataFrame:
    return messages.where(F.col("role").isin(*SPEAKERS))


def extract_texts(messages: DataFrame, cap: int = DEFAULT.message_cap, least: int = DEFAULT.min_text) -> DataFrame:
    """(session_key, idx, block, text): one row for a string content or for each text block; `role: ` comes before the cut text."""
    content = F.when(F.col("content").isNotNull(), F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))))
    parts = F.coalesce(content, F.col("blocks")) if "blocks" in messages.columns else content
    rows = speakers(messages).select("session_key", "idx", "role", F.posexplode(parts).alias("block", "part"))
    rows = rows.where((F.col("part.type") == "text") & (F.length("part.text") > least))
    return rows.select("session_key", "idx", "block", F.concat("role", F.lit(": "), F.left("part.text", F.lit(cap))).alias("text"))


def joined(texts: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(session_key, text, n_texts): the texts of a session in order. A session's texts are one aggregate value, as an episode needs."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "block", "text")))
    return texts.groupBy("session_key").agg(F.array_join(F.transform(rows, lambda x: x["text"]), separator).alias("text"), F.count("*").alias("n_texts"))


def joined_head(texts: DataFrame, cap: int, separator: str = "\n\n", step: int = 1000) -> DataFrame:
    """(session_key, text): the first cap characters of a session's joined texts.

    Texts are joined by runs of `step` message numbers, each cut to cap, and only runs that start before cap come together,
    so a session of any size is never one value.
    """
    runs = joined(texts.withColumn("session_key", F.struct("session_key", F.floor(F.col("idx") / step).alias("run"))), separator)
    runs = runs.select("session_key.*", F.left("text", F.lit(cap)).alias("text"), F.length("text").alias("_length"))
    before = F.sum(F.col("_length") + len(separator)).over(Window.partitionBy("session_key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < cap)
    rows = F.array_sort(F.collect_list(F.struct("run", "text")))
    return runs.groupBy("session_key").agg(F.left(F.array_join(F.transform(rows, lambda x: x["text"]), separator), F.lit(cap)).alias("text"))


def last_per_session(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The last n rows of each session by order."""
    newest = Window.partitionBy("session_key").orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n).drop("_rn")


def numbered(rows: DataFrame, name: str, run: Column, order: list[str]) -> DataFrame:
    """rows with their place in the session, from 0, in order of run and then of `order`.

    Rows are numbered inside each run, and only the runs' counts are summed up by session, so no task sorts a whole session.
    """
    rows = rows.withColumn("_run", run)
    runs = rows.groupBy("session_key", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("session_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("session_key", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("session_key", "_run").orderBy(*order))
    return rows.withColumn("_inside", inside).join(runs, ["session_key", "_run"]).withColumn(name, F.col("_before") + F.col("_inside") - 1).drop("_run", "_before", "_inside")


def new_of_turn(messages: DataFrame, counts: DataFrame) -> DataFrame:
    """Messages of the turn, with sweep: all of them where the count before the prompt exceeds what is left, else those after it.

    counts: (session_key, before) with a null for an unknown count.
    """
    sizes = messages.groupBy("session_key").agg(F.count("*").alias("_n"))
    rows = numbered(messages, "_at", F.floor(F.col("idx") / 1000), ["idx"]).join(sizes.join(counts, "session_key", "left"), "session_key")
    sweep = F.coalesce(F.col("before") > F.col("_n"), F.lit(False))
    rows = rows.withColumn("sweep", sweep)
    return rows.where(F.col("_at") >= F.when(F.col("sweep"), 0).otherwise(F.coalesce("before", F.lit(0)))).drop("_at", "_n", "before")


def query_window(messages: DataFrame, n: int = DEFAULT.memory_query_messages, cap: int = DEFAULT.message_cap) -> DataFrame:
    """(session_key, idx, role, content): the last n messages first, then those of the speakers with more than one character."""
    recent = speakers(last_per_session(messages, n, "idx"))
    return recent.where(F.length("content") > 1).select("session_key", "idx", "role", F.left("content", F.lit(cap)).alias("content"))


def last_user_text(messages: DataFrame) -> DataFrame:
    """(session_key, last_user_text): the latest user message's text, null if that one has none; earlier ones don't stand in."""
    latest = messages.where("role = 'user'").groupBy("session_key").agg(F.max_by(F.struct("content"), "idx").alias("m"))
    return latest.select("session_key", F.when(F.length("m.content") > 1, F.col("m.content")).alias("last_user_text"))
