"""Capture: messages to episodes (session_key, content, role_type, role, name, timestamp, source_description).

Every function is extract, join, sanitize, cut, name, provenance; what differs is
the gates and the order. `now` is an ISO string and `now_ms` its milliseconds, so
that results repeat. Where is_heartbeat is a column, heartbeat rows are left out of
the captures that skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.config import DEFAULT, Config
from memloom.functions import provenance
from memloom.functions import text as T
from memloom.operators import messages as M
from memloom.operators import pieces
from memloom.sources import shared

COLUMNS = ("session_key", "content", "role_type", "role", "name", "timestamp", "source_description")


def _episodes(rows: DataFrame, content: Column, prefix: str, event: str | Column, now: str, now_ms: int, config: Config, role_type: str = "user", role: str = "conversation") -> DataFrame:
    optional = {k: F.col(k) for k in ("thread_id", "agent", "channel", "session_start") if k in rows.columns}
    described = provenance.build(event, F.lit(now), config, session_key=F.col("session_key"), **optional)
    return rows.select("session_key", content.alias("content"), F.lit(role_type).alias("role_type"), F.lit(role).alias("role"), T.episode_name(prefix, F.col("session_key"), F.lit(now_ms)).alias("name"), F.lit(now).alias("timestamp"), described.alias("source_description"))


def _awake(messages: DataFrame) -> DataFrame:
    return messages.where(~F.coalesce("is_heartbeat", F.lit(False))) if "is_heartbeat" in messages.columns else messages


def single(messages: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """An episode for each message: sanitized before the role is put in front, and at least 20 characters then."""
    if not config.auto_capture:
        messages = messages.limit(0)
    rows = M.speakers(_awake(messages))
    rows = rows.withColumn("_clean", T.sanitize(T.extract_content(F.col("content"), F.col("blocks") if "blocks" in rows.columns else None, config.min_text), config))
    rows = rows.where(F.length("_clean") >= config.min_text)
    content = F.concat("role", F.lit(": "), F.left("_clean", F.lit(config.message_cap)))
    thread = {"thread_id": F.col("thread_id")} if "thread_id" in rows.columns else {}
    described = provenance.build("ingest", F.lit(now), config, session_key=F.col("session_key"), **thread)
    name = F.concat_ws("-", F.lit("ingest"), F.col("session_key"), F.lit(now_ms).cast("string"))
    return rows.select("session_key", "idx", content.alias("content"), F.col("role").alias("role_type"), "role", name.alias("name"), F.lit(now).alias("timestamp"), described.alias("source_description"))


def batch(messages: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """An episode for each session: every text sanitized by itself, empty ones dropped, then joined and cut."""
    if not config.auto_capture:
        messages = messages.limit(0)
    texts = M.extract_texts(_awake(messages), config.message_cap, config.min_text).withColumn("text", T.sanitize(F.col("text"), config)).where("text != ''")
    return _episodes(M.joined_head(texts, config.episode_cap), F.col("text"), "batch", "ingest_batch", now, now_ms, config)


def after_turn(messages: DataFrame, counts: DataFrame, now: str, now_ms: int, config: Config = DEFAULT, step: int = pieces.RUN) -> DataFrame:
    """An episode of each session's new messages; a sweep keeps the tail and has an event of its own."""
    if not config.auto_capture:
        messages = messages.limit(0)
    new = M.new_of_turn(_awake(messages), counts)
    sweeps = shared.settled(new.groupBy("session_key").agg(F.bool_or("sweep").alias("sweep")), "sweeps")
    texts = M.extract_texts(new, config.message_cap, config.min_text)
    rows = pieces.sanitized(texts, config.episode_cap, config, sweeps.where("sweep"), step).where("text != ''").join(sweeps, "session_key")
    event = F.when(F.col("sweep"), "after_turn_sweep").otherwise("after_turn")
    return _episodes(rows, F.col("text"), "turn", event, now, now_ms, config)


def compact(messages: DataFrame, now: str, now_ms: int, config: Config = DEFAULT, step: int = pieces.RUN) -> DataFrame:
    """An episode of each session that is about to be compacted, whether or not capture is on."""
    rows = pieces.sanitized(M.extract_texts(messages, config.message_cap, config.min_text), config.episode_cap, config, step=step)
    return _episodes(rows, F.col("text"), "compact", "compact", now, now_ms, config)


def _long_enough(messages: DataFrame, texts: DataFrame, config: Config) -> DataFrame:
    enough = messages.groupBy("session_key").agg(F.count("*").alias("_n")).where(F.col("_n") >= config.hook_min_messages)
    some = texts.groupBy("session_key").agg(F.count("*").alias("_t")).where(F.col("_t") >= config.hook_min_texts)
    return texts.join(enough.join(some, "session_key").select("session_key"), "session_key", "left_semi")


def _started(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """rows (session_key) with the session_start that messages carry, if they do."""
    if "session_start" not in messages.columns:
        return rows
    return rows.join(messages.groupBy("session_key").agg(F.max("session_start").alias("session_start")), "session_key", "left")


def before_compaction(messages: DataFrame, now: str, now_ms: int, config: Config = DEFAULT, step: int = pieces.RUN) -> DataFrame:
    """As compact, for sessions with at least 4 messages and 2 texts."""
    texts = _long_enough(messages, M.extract_texts(messages, config.message_cap, config.min_text), config)
    rows = pieces.sanitized(texts, config.episode_cap, config, step=step)
    return _episodes(_started(rows, messages), F.col("text"), "compaction", "before_compaction", now, now_ms, config)


def before_reset(messages: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """As before_compaction with shorter messages and the last 20 texts."""
    texts = _long_enough(messages, M.extract_texts(messages, config.reset_message_cap, config.min_text), config)
    last = M.last_per_session(texts, config.reset_sample, "idx", "block")
    return _episodes(_started(M.joined(last), messages), F.left(T.sanitize(F.col("text"), config), F.lit(config.episode_cap)), "session-reset", "before_reset", now, now_ms, config)


def subagent_ended(messages: DataFrame, summaries: DataFrame, now: str, now_ms: int, config: Config = DEFAULT, step: int = pieces.RUN) -> DataFrame:
    """An episode of each ended subagent: its summary of 20 characters or more, else its messages. summaries: (session_key, summary)."""
    texts = pieces.sanitized(M.extract_texts(messages, config.message_cap, config.min_text), config.episode_cap, config, step=step)
    summary = F.when(F.length("summary") >= config.min_text, F.left(T.sanitize(F.col("summary"), config), F.lit(config.episode_cap)))
    rows = texts.join(summaries, "session_key", "full").withColumn("text", F.coalesce(summary, "text")).where("text is not null")
    return _episodes(rows, F.col("text"), "subagent", "subagent_ended", now, now_ms, config, "system", "subagent-result")


def _given(rows: DataFrame, column: str) -> Column:
    return F.col(column) if column in rows.columns else F.lit(None).cast("string")


def manual(rows: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Episodes of texts as given (session_key, content[, name, source, agent, channel, session_start]), not sanitized.

    A null name is made from the time, a null source is `manual`; an empty one stands, and is left out of the provenance.
    """
    known = {k: F.col(k) for k in ("agent", "channel", "session_start") if k in rows.columns}
    described = provenance.build("manual", F.lit(now), config, session_key=F.col("session_key"), source=F.coalesce(_given(rows, "source"), F.lit("manual")), **known)
    name = F.coalesce(_given(rows, "name"), F.lit(f"manual-{now_ms}"))
    return rows.select("session_key", "content", F.lit("system").alias("role_type"), F.lit("manual").alias("role"), name.alias("name"), F.lit(now).alias("timestamp"), described.alias("source_description"))


def cli_ingest(rows: DataFrame, now: str, now_ms: int, config: Config = DEFAULT) -> DataFrame:
    """Episodes of whole files (path, content[, name]), cut to an episode's length, or of texts without a path as they are.

    Named as given, else by the file, else by the time; the provenance has a file's name without its folders. The path
    and the truncated mark (files), or the other columns (texts), stay in front.
    """
    file = T.basename(F.col("path")) if "path" in rows.columns else None
    described = provenance.build("cli_ingest", F.lit(now), config, **({} if file is None else {"file": file}))
    name = F.coalesce(_given(rows, "name"), F.lit(f"cli-{now_ms}") if file is None else file)
    kept = [c for c in rows.columns if c not in ("content", "name")]
    content = [F.col("content")] if file is None else [F.left("content", F.lit(config.episode_cap)).alias("content"), (F.length("content") > config.episode_cap).alias("truncated")]
    return rows.select(*kept, *content, F.lit("system").alias("role_type"), F.lit("manual").alias("role"), name.alias("name"), F.lit(now).alias("timestamp"), described.alias("source_description"))


def compaction(sessions: DataFrame, messages: DataFrame, healthy: bool = True, config: Config = DEFAULT) -> DataFrame:
    """(session_key, compacted, reason, event, recalled): what compaction answers each of sessions (session_key), given the messages that came along.

    event and recalled are signals for `recall.due`; only sessions whose compaction writes an episode (`compact`) have them.
    """
    texts = M.extract_texts(messages, config.message_cap, config.min_text)
    rows = sessions.select("session_key").distinct()
    for part, mark in ((messages, "_given"), (texts, "_texts")):
        rows = rows.join(part.select("session_key").distinct().withColumn(mark, F.lit(True)), "session_key", "left")
    given, written = F.coalesce("_given", F.lit(False)), F.coalesce("_texts", F.lit(False)) & F.lit(healthy)
    reason = F.when(~given, "no-messages").when(~F.lit(healthy), "server-unhealthy")
    return rows.select("session_key", (given & F.lit(healthy)).alias("compacted"), reason.alias("reason"), F.when(written, "compact").alias("event"), F.when(written, False).alias("recalled"))


def start_as_of(captures: DataFrame, starts: DataFrame) -> DataFrame:
    """captures (session_key, captured_at, ...) with session_start: the last of starts (session_key, session_start) at or before them, else null.

    Times are ISO stamps of one form, so their order is that of their texts. Captures and starts are put in one order of
    time and the last start is carried on, within days first and then from the days before, so that a session with very
    many captures isn't one task. Rows without a session or a time get a null.
    """
    columns, day = captures.columns, F.left("_at", F.lit(10)).alias("_day")
    known = starts.where("session_key is not null and session_start is not null").select("session_key", F.col("session_start").alias("_at")).distinct()
    days = known.select("session_key", "_at", day).groupBy("session_key", "_day").agg(F.max("_at").alias("_last"))
    asked = captures.select("session_key", F.left("captured_at", F.lit(10)).alias("_day")).distinct()
    order = Window.partitionBy("session_key").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    every = days.unionByName(asked, allowMissingColumns=True).groupBy("session_key", "_day").agg(F.max("_last").alias("_last"))
    before = every.select("session_key", "_day", F.last("_last", ignorenulls=True).over(order).alias("_before"))
    marked = known.select("session_key", "_at", day, F.lit(0).alias("_order"), F.col("_at").alias("_start"), F.lit(None).cast(captures.select(F.struct(*columns)).schema[0].dataType).alias("_row"))
    rows = captures.select("session_key", F.col("captured_at").alias("_at"), F.struct(*columns).alias("_row")).select("session_key", "_at", day, F.lit(1).alias("_order"), F.lit(None).cast("string").alias("_start"), "_row")
    within = Window.partitionBy("session_key", "_day").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.union(rows).withColumn("_within", F.last("_start", ignorenulls=True).over(within)).where("_order = 1")
    rows = rows.join(before, ["session_key", "_day"], "left")
    return rows.select("_row.*", F.coalesce("_within", "_before").alias("session_start"))


def with_session_start(messages: DataFrame, starts: DataFrame, now: str) -> DataFrame:
    """Adds session_start (null where unknown) for the provenance of hook captures: the last of starts (session_key, session_start) at or before `now`."""
    captures = messages.select("session_key").distinct().withColumn("captured_at", F.lit(now))
    return messages.join(start_as_of(captures, starts).drop("captured_at"), "session_key", "left")
