"""Provenance: the JSON object that an episode carries in source_description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.config import DEFAULT, Config

#: Optional keys in their order, and the events.
OPTIONAL = ("session_key", "thread_id", "file", "file_type", "source", "agent", "channel", "session_start")
EVENTS = ("ingest", "ingest_batch", "after_turn", "after_turn_sweep", "compact", "subagent_ended", "before_compaction", "before_reset", "manual", "cli_ingest", "memory_index")


def build(event: str | Column, ts: Column, config: Config = DEFAULT, **optional: Column) -> Column:
    """JSON with the fixed keys first; optional keys that are null or empty are left out."""
    event = F.lit(event) if isinstance(event, str) else event
    fields = [F.lit(config.label).alias("plugin"), event.alias("event"), ts.alias("ts"), F.lit(config.group).alias("group_id")]
    fields += [F.nullif(optional[k], F.lit("")).alias(k) for k in OPTIONAL if k in optional]
    return F.to_json(F.struct(*fields))


def is_object(text: Column) -> Column:
    """Whether the text parses as JSON other than a literal null."""
    parsed = F.try_parse_json(text)
    return F.coalesce(parsed.isNotNull() & ~F.is_variant_null(parsed), F.lit(False))


def field(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def of_session(description: Column, name: Column, session_key: Column) -> Column:
    """Whether an episode belongs to a session: by its provenance, or by older plain-text marks."""
    legacy = F.coalesce(description.contains(F.concat(F.lit("session="), session_key)), F.lit(False)) | F.coalesce(name.contains(session_key), F.lit(False))
    return F.when(is_object(description), F.coalesce(field(description, "session_key") == session_key, F.lit(False))).otherwise(legacy)


def score(description: Column, session_key: Column, thread_id: Column | None = None) -> Column:
    """2 for the same session and thread, 1 for the session, else 0."""
    same = F.coalesce(field(description, "session_key") == session_key, F.lit(False))
    thread = F.lit(False) if thread_id is None else F.coalesce((field(description, "thread_id") == thread_id) & (thread_id != ""), F.lit(False))
    return F.when(same & thread, 2).when(same, 1).otherwise(0)
