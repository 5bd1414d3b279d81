"""Named queries over the driver tables, each beside its DuckDB twin.

QUERIES: name -> (spark, sf_dir) -> DataFrame. ORACLES: name -> SQL for DuckDB over the same tables.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from memloom.config import DEFAULT
from memloom.functions import text as T
from memloom.operators import capture, continuity, episodes, memory_files, recall, search, textindex
from memloom.operators import messages as M
from memloom.plans import relations as R
from memloom.sources import shared
from memloom.streaming import capture as streamed

NOW, NOW_MS = "2026-07-01T00:00:00.000Z", 1_782_864_000_000
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return add


# --- texts ---------------------------------------------------------------------------------------------------------

_M = f"WITH messages AS ({R.MESSAGES})"
_TEXTS = f"{_M}, texts AS (SELECT session_key, idx, role || ': ' || left(content, 2000) AS text FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 20)"


def _clean(x: str) -> str:
    """The sanitizer for DuckDB; the step with look-ahead is written as both orders of its two keys, which the relations' blocks have inside."""
    for tag in ("memory-context", "memory-continuity", "relevant-memories"):
        x = f"regexp_replace({x}, '(?s)<{tag}>.*?</{tag}>', '', 'g')"
    x = f"""regexp_replace({x}, '(?s)```json\\s*\\n\\s*\\{{["\\s]*schema["\\s]*:\\s*"inbound_meta.*?```', '', 'g')"""
    x = f"""regexp_replace({x}, '```json\\s*\\n\\s*\\{{([^`]*"label"[^`]*"sender"|[^`]*"sender"[^`]*"label")[^`]*```', '', 'g')"""
    x = f"regexp_replace({x}, '(?m)^\\[Subagent Context\\][^\\n\\r]*', '', 'g')"
    x = f"regexp_replace({x}, '(?m)^\\[(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\\s+\\d{{4}}-\\d{{2}}-\\d{{2}}\\s+\\d{{2}}:\\d{{2}}\\s+[A-Za-z]{{2,5}}\\][ \\t]*', '', 'g')"
    x = f"regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _described(event: str, session: str = "session_key") -> str:
    return f"""'{{"plugin":"memloom","event":"' || {event} || '","ts":"{NOW}","group_id":"core","session_key":"' || {session} || '"}}'"""


def _episode(rows: str, content: str, prefix: str, event: str, role_type: str = "user", role: str = "conversation") -> str:
    return f"SELECT session_key, {content} AS content, '{role_type}' AS role_type, '{role}' AS role, '{prefix}-' || session_key || '-{NOW_MS}' AS name, '{NOW}' AS \"timestamp\", {_described(event)} AS source_description FROM {rows}"


_JOINED = "SELECT session_key, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text, count(*) AS n FROM texts GROUP BY session_key"


@_query(f"{_TEXTS} SELECT session_key, idx, CAST(0 AS BIGINT) AS block, text FROM texts")
def extract_texts(spark, sf_dir):
    """Labelled texts of all messages."""
    return M.extract_texts(R.messages(spark, sf_dir)).withColumn("block", F.col("block").cast("long"))


@_query(f"{_M} SELECT session_key, idx, {_clean('content')} AS text FROM messages")
def sanitize_messages(spark, sf_dir):
    """The sanitizer on every message."""
    return R.messages(spark, sf_dir).select("session_key", "idx", T.sanitize(F.col("content")).alias("text"))


_NOISY = "CASE doc_id % 4 WHEN 0 THEN '<memory-context>' || chr(10) || 'f' || chr(10) || '</memory-context>' || text WHEN 1 THEN text || chr(10) || '[Subagent Context] x' || chr(10) || chr(10) || chr(10) || 'z ' WHEN 2 THEN '[Fri 2026-01-02 03:04 UTC] ' || text ELSE text END"


@_query(f"SELECT doc_id, md5(clean) AS digest, CAST(length(clean) AS BIGINT) AS n FROM (SELECT doc_id, {_clean(_NOISY)} AS clean FROM documents)")
def sanitize_documents(spark, sf_dir):
    """The sanitizer on whole documents with noise."""
    rows = R.table(spark, sf_dir, "documents").select("doc_id", T.sanitize(F.expr(_NOISY)).alias("clean"))
    return rows.select("doc_id", F.md5("clean").alias("digest"), F.length("clean").cast("long").alias("n"))


# --- capture -------------------------------------------------------------------------------------------------------


@_query(
    f"{_M}, c AS (SELECT session_key, idx, role, {_clean('content')} AS clean FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 20) "
    f"SELECT session_key, idx, role || ': ' || left(clean, 2000) AS content, role AS role_type, role, 'ingest-' || session_key || '-{NOW_MS}' AS name, '{NOW}' AS \"timestamp\", {_described(chr(39) + 'ingest' + chr(39))} AS source_description FROM c WHERE length(clean) >= 20"
)
def capture_single(spark, sf_dir):
    """An episode for each message."""
    return capture.single(R.messages(spark, sf_dir), NOW, NOW_MS)


@_query(f"{_TEXTS}, clean AS (SELECT session_key, idx, {_clean('text')} AS text FROM texts), j AS (SELECT session_key, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM clean WHERE text <> '' GROUP BY session_key) " + _episode("j", "left(text, 12000)", "batch", "'ingest_batch'"))
def capture_batch(spark, sf_dir):
    """An episode of each session's messages, each sanitized by itself."""
    return capture.batch(R.messages(spark, sf_dir), NOW, NOW_MS)


@_query(f"{_TEXTS}, j AS ({_JOINED}) " + _episode("j", f"left({_clean('text')}, 12000)", "compact", "'compact'"))
def capture_compact(spark, sf_dir):
    """An episode of each session before compaction."""
    return capture.compact(R.messages(spark, sf_dir), NOW, NOW_MS)


_SMALL = 700


@_query(f"{_TEXTS}, j AS ({_JOINED}) " + _episode("j", f"left({_clean('text')}, {_SMALL})", "compact", "'compact'"))
def capture_compact_capped(spark, sf_dir):
    """As capture_compact with a cap that binds."""
    return capture.compact(R.messages(spark, sf_dir), NOW, NOW_MS, replace(DEFAULT, episode_cap=_SMALL))


@_query(f"{_TEXTS}, j AS ({_JOINED}) " + _episode("j", f"left({_clean('text')}, {_SMALL})", "compact", "'compact'"))
def capture_compact_pieces(spark, sf_dir):
    """As capture_compact_capped, every session in pieces of two message numbers, as sessions of any size are."""
    return capture.compact(R.messages(spark, sf_dir), NOW, NOW_MS, replace(DEFAULT, episode_cap=_SMALL), step=2)


_BEFORE = "CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 50 ELSE 0 END"
_TURN = f"""{_M}, n AS (SELECT *, count(*) OVER (PARTITION BY session_key) AS n, row_number() OVER (PARTITION BY session_key ORDER BY idx) - 1 AS place, {_BEFORE} AS before FROM messages),
kept AS (SELECT *, coalesce(before > n, false) AS sweep FROM n),
texts AS (SELECT session_key, idx, sweep, role || ': ' || left(content, 2000) AS text FROM kept WHERE place >= CASE WHEN sweep THEN 0 ELSE coalesce(before, 0) END AND role IN ('user', 'assistant') AND length(content) > 20),
j AS (SELECT session_key, bool_or(sweep) AS sweep, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM texts GROUP BY session_key),
c AS (SELECT session_key, sweep, {_clean("text")} AS text FROM j) """


@_query(_TURN + _episode("c", f"CASE WHEN sweep THEN right(text, {_SMALL}) ELSE left(text, {_SMALL}) END", "turn", "CASE WHEN sweep THEN 'after_turn_sweep' ELSE 'after_turn' END") + " WHERE text <> ''")
def capture_after_turn(spark, sf_dir):
    """An episode of each session's new messages, sweeps included, with a cap that binds."""
    messages = R.messages(spark, sf_dir)
    counts = messages.select("session_key", F.expr(_BEFORE).alias("before")).distinct()
    return capture.after_turn(messages, counts, NOW, NOW_MS, replace(DEFAULT, episode_cap=_SMALL))


@_query(_TURN + _episode("c", "CASE WHEN sweep THEN right(text, 12000) ELSE left(text, 12000) END", "turn", "CASE WHEN sweep THEN 'after_turn_sweep' ELSE 'after_turn' END") + " WHERE text <> ''")
def capture_after_turn_whole(spark, sf_dir):
    """As capture_after_turn with the default cap, in pieces of three message numbers."""
    messages = R.messages(spark, sf_dir)
    counts = messages.select("session_key", F.expr(_BEFORE).alias("before")).distinct()
    return capture.after_turn(messages, counts, NOW, NOW_MS, step=3)


_HOOK = "enough AS (SELECT session_key FROM messages GROUP BY session_key HAVING count(*) >= 4)"


@_query(f"{_TEXTS}, {_HOOK}, j AS ({_JOINED} HAVING count(*) >= 2) " + _episode("j", f"left({_clean('text')}, 12000)", "compaction", "'before_compaction'") + " WHERE session_key IN (SELECT session_key FROM enough)")
def capture_before_compaction(spark, sf_dir):
    """The compaction hook with its least counts."""
    return capture.before_compaction(R.messages(spark, sf_dir), NOW, NOW_MS)


@_query(
    f"{_M}, {_HOOK}, texts AS (SELECT session_key, idx, role || ': ' || left(content, 1000) AS text FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 20), "
    "few AS (SELECT *, count(*) OVER (PARTITION BY session_key) AS n, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM texts), "
    "j AS (SELECT session_key, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM few WHERE n >= 2 AND rn <= 3 GROUP BY session_key) "
    + _episode("j", f"left({_clean('text')}, 12000)", "session-reset", "'before_reset'") + " WHERE session_key IN (SELECT session_key FROM enough)"
)
def capture_before_reset(spark, sf_dir):
    """The reset hook, with a sample of the last 3 texts."""
    return capture.before_reset(R.messages(spark, sf_dir), NOW, NOW_MS, replace(DEFAULT, reset_sample=3))


_SUMMARY = "CASE conv_id % 3 WHEN 0 THEN 'summary of the child session ' || CAST(conv_id AS STRING) WHEN 1 THEN 'too short' ELSE NULL END"


@_query(f"{_TEXTS}, s AS (SELECT DISTINCT session_key, {_SUMMARY} AS summary FROM messages), j AS ({_JOINED}), k AS (SELECT session_key, CASE WHEN length(summary) >= 20 THEN summary ELSE text END AS text FROM j FULL JOIN s USING (session_key)) " + _episode("k", f"left({_clean('text')}, 12000)", "subagent", "'subagent_ended'", "system", "subagent-result") + " WHERE text IS NOT NULL")
def capture_subagent(spark, sf_dir):
    """An episode of each ended subagent."""
    messages = R.messages(spark, sf_dir)
    return capture.subagent_ended(messages, messages.select("session_key", F.expr(_SUMMARY).alias("summary")).distinct(), NOW, NOW_MS)


_GIVEN = "CASE WHEN idx % 3 = 0 THEN 'note ' || CAST(idx AS STRING) WHEN idx % 3 = 1 THEN '' END"
_SOURCE = "CASE WHEN idx % 4 = 0 THEN 'review' WHEN idx % 4 = 1 THEN '' END"
_AGENT, _CHANNEL = "CASE WHEN conv_id % 2 = 0 THEN 'agent-1' END", "CASE WHEN conv_id % 3 = 0 THEN 'web' ELSE '' END"
_BEGAN = "CASE WHEN conv_id % 5 < 2 THEN '2026-06-30T00:00:00.000Z' END"


def _key(name: str, value: str) -> str:
    """An optional key of the provenance: left out where null or empty."""
    return f"""CASE WHEN coalesce({value}, '') = '' THEN '' ELSE ',"{name}":"' || ({value}) || '"' END"""


@_query(f"""{_M} SELECT session_key, content, 'system' AS role_type, 'manual' AS role, coalesce({_GIVEN}, 'manual-{NOW_MS}') AS name, '{NOW}' AS "timestamp",
  '{{"plugin":"memloom","event":"manual","ts":"{NOW}","group_id":"core","session_key":"' || session_key || '"' || {_key("source", f"coalesce({_SOURCE}, 'manual')")} || {_key("agent", _AGENT)} || {_key("channel", _CHANNEL)} || {_key("session_start", _BEGAN)} || '}}' AS source_description FROM messages""")
def capture_manual(spark, sf_dir):
    """Texts taken as they are, with the caller's name and source and what is known of the session."""
    parts = {"name": _GIVEN, "source": _SOURCE, "agent": _AGENT, "channel": _CHANNEL, "session_start": _BEGAN}
    return capture.manual(R.messages(spark, sf_dir).select("session_key", "content", *[F.expr(e).alias(k) for k, e in parts.items()]), NOW, NOW_MS)


_LABEL = "CASE WHEN doc_id % 3 = 0 THEN 'label ' || CAST(doc_id AS STRING) END"
_BASE = "'my notes #' || CAST(doc_id AS STRING) || '.md'"


@_query(f"""SELECT 'notes/' || source || '/' || {_BASE} AS path, left(text, 12000) AS content, length(text) > 12000 AS truncated, 'system' AS role_type, 'manual' AS role, coalesce({_LABEL}, {_BASE}) AS name, '{NOW}' AS "timestamp",
  '{{"plugin":"memloom","event":"cli_ingest","ts":"{NOW}","group_id":"core","file":"' || {_BASE} || '"}}' AS source_description FROM documents""")
def capture_cli(spark, sf_dir):
    """Whole files cut to an episode's length, named by the caller or by the file."""
    files = R.table(spark, sf_dir, "documents").select(F.expr(f"'notes/' || source || '/' || {_BASE}").alias("path"), F.col("text").alias("content"), F.expr(_LABEL).alias("name"))
    return capture.cli_ingest(files, NOW, NOW_MS)


@_query(f"""SELECT CAST(doc_id AS STRING) AS id, left(text, 50) AS content, 'system' AS role_type, 'manual' AS role, coalesce({_LABEL}, 'cli-{NOW_MS}') AS name, '{NOW}' AS "timestamp",
  '{{"plugin":"memloom","event":"cli_ingest","ts":"{NOW}","group_id":"core"}}' AS source_description FROM documents""")
def capture_cli_text(spark, sf_dir):
    """Texts given on the command line: no file in their provenance, and a name by the time."""
    rows = R.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.left("text", F.lit(50)).alias("content"), F.expr(_LABEL).alias("name"))
    return capture.cli_ingest(rows, NOW, NOW_MS)


@_query(
    f"{_M}, c AS (SELECT session_key, idx, role, conv_id, {_clean('content')} AS clean FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 20) "
    f"SELECT session_key, idx, role || ': ' || left(clean, 2000) AS content, role AS role_type, role, 'ingest-' || session_key || '-{NOW_MS}' AS name, '{NOW}' AS \"timestamp\", "
    f"""'{{"plugin":"memloom","event":"ingest","ts":"{NOW}","group_id":"core","session_key":"' || session_key || '"' || {_key("thread_id", "CASE WHEN conv_id % 2 = 0 THEN 'thread-' || CAST(conv_id % 7 AS STRING) END")} || '}}' AS source_description FROM c WHERE length(clean) >= 20"""
)
def capture_single_thread(spark, sf_dir):
    """An episode for each message of sessions that belong to a thread or to none."""
    rows = R.messages(spark, sf_dir).withColumn("thread_id", F.expr("CASE WHEN conv_id % 2 = 0 THEN 'thread-' || CAST(conv_id % 7 AS STRING) END"))
    return capture.single(rows, NOW, NOW_MS)


_ASKED = "CASE conv_id % 4 WHEN 0 THEN false ELSE true END"


@_query(f"""{_M}, t AS (SELECT session_key, count(*) AS n FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 20 GROUP BY session_key),
s AS (SELECT DISTINCT session_key, {_ASKED} AS given FROM messages)
SELECT s.session_key, given AS compacted, CASE WHEN NOT given THEN 'no-messages' END AS reason, CASE WHEN given AND n > 0 THEN 'compact' END AS event, CASE WHEN given AND n > 0 THEN false END AS recalled FROM s LEFT JOIN t USING (session_key)""")
def compaction_results(spark, sf_dir):
    """What compaction answers each session, and the signal for recall of those with a new episode; some come without messages."""
    rows = R.messages(spark, sf_dir)
    return capture.compaction(rows.select("session_key").distinct(), rows.where(_ASKED))


# --- continuity and recall -----------------------------------------------------------------------------------------

_LABELLED = f"{_M}, l AS (SELECT session_key, idx, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content AS text FROM messages WHERE role IN ('user', 'assistant') AND length(content) > 0)"


def _tail(budget: int) -> str:
    return f"{_LABELLED}, w AS (SELECT *, sum(length(text)) OVER (PARTITION BY session_key ORDER BY idx DESC) AS total, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM l), tail AS (SELECT session_key, string_agg(text, chr(10) ORDER BY idx) AS text FROM w WHERE total <= {budget} OR rn = 1 GROUP BY session_key)"


@_query(f"{_tail(1500)} SELECT session_key, text FROM tail")
def session_tail(spark, sf_dir):
    """The newest messages of each session within 1500 characters."""
    return continuity.session_tail(R.messages(spark, sf_dir), 1500)


@_query(f"{_tail(8000)} SELECT session_key, text FROM tail")
def session_tail_whole(spark, sf_dir):
    """As session_tail with the default budget."""
    return continuity.session_tail(R.messages(spark, sf_dir))


def _continued(budget: int) -> str:
    return f"""WITH e AS ({R.EPISODES}), p AS (SELECT *, CASE WHEN json_valid(source_description) THEN json_extract_string(source_description, '$.session_key') END AS session_key, CASE WHEN json_valid(source_description) THEN json_extract_string(source_description, '$.thread_id') END AS thread FROM e WHERE content <> ''),
s AS (SELECT *, CASE WHEN thread = 't1' THEN 2 ELSE 1 END AS score FROM p WHERE session_key IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS rn, sum(length(content)) OVER w + 2 * (row_number() OVER w - 1) AS total FROM s WINDOW w AS (PARTITION BY session_key ORDER BY score DESC, created_at DESC, uuid)),
k AS (SELECT session_key, rn, CASE WHEN total <= {budget} THEN content ELSE left(content, CAST({budget} - (total - length(content)) AS BIGINT)) END AS content FROM o WHERE total <= {budget} OR {budget} - (total - length(content)) > 100)
SELECT session_key, string_agg(content, chr(10) || chr(10) ORDER BY rn) AS text FROM k GROUP BY session_key"""


def _with_threads(rows):
    sessions = rows.select(F.get_json_object("source_description", "$.session_key").alias("session_key")).where("session_key is not null")
    return sessions.distinct().withColumn("thread_id", F.lit("t1"))


@_query(_continued(8000))
def episode_continuity_whole(spark, sf_dir):
    """As episode_continuity with the default budget."""
    rows = R.episodes(spark, sf_dir)
    return continuity.episode_continuity(rows, _with_threads(rows))


@_query(_continued(1200))
def episode_continuity(spark, sf_dir):
    """Each session's episodes within 1200 characters, thread t1 first."""
    rows = R.episodes(spark, sf_dir)
    return continuity.episode_continuity(rows, _with_threads(rows), 1200)


_DEICTIC_SQL = "regexp_matches({x}, '(?i)\\b(" + "|".join(T.DEICTIC) + ")\\b')"
_CALLS = "SELECT session_key, idx AS seq, CASE WHEN role = 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'bootstrap' ELSE 'compact' END ELSE 'assemble' END AS kind, idx < 3 AS gap, {d} AS deictic, (conv_id + idx) % 4 <> 0 AS nonempty FROM messages"


@_query(
    f"""WITH RECURSIVE messages AS ({R.MESSAGES}), calls AS ({_CALLS.format(d=_DEICTIC_SQL.format(x="content"))}),
r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY seq) AS rn FROM calls),
run AS (
  SELECT session_key, seq, rn, CAST(0 AS BIGINT) AS epoch, false AS pending, false AS recalled, CAST(NULL AS BOOLEAN) AS fire, CAST(NULL AS BOOLEAN) AS injected FROM (SELECT session_key, CAST(-1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS rn FROM r GROUP BY session_key)
  UNION ALL
  SELECT session_key, seq, rn, epoch + CASE WHEN life THEN 1 ELSE 0 END, CASE WHEN life THEN true WHEN go THEN false ELSE pending END, CASE WHEN life THEN false ELSE recalled OR (go AND nonempty) END, CASE WHEN NOT life THEN go END, CASE WHEN NOT life THEN go AND nonempty END
  FROM (SELECT r.session_key, r.seq, r.rn, s.epoch, s.pending, s.recalled, r.nonempty, r.kind <> 'assemble' AS life, r.kind = 'assemble' AND NOT (s.recalled AND NOT s.pending AND NOT r.deictic) AND (s.pending OR r.gap OR r.deictic) AS go FROM run s JOIN r ON r.session_key = s.session_key AND r.rn = s.rn + 1)
) SELECT session_key, seq, epoch, fire, injected FROM run WHERE rn > 0"""
)
def recall_gate(spark, sf_dir):
    """The gate over every call and lifecycle event; the twin steps through the state machine row by row."""
    calls = R.messages(spark, sf_dir).selectExpr(*[c.strip() for c in ("session_key", "idx AS seq", "CASE WHEN role = 'system' THEN CASE WHEN conv_id % 2 = 0 THEN 'bootstrap' ELSE 'compact' END ELSE 'assemble' END AS kind", "idx < 3 AS gap", "(conv_id + idx) % 4 <> 0 AS nonempty", "content")])
    calls = calls.withColumn("deictic", T.has_deictic(F.col("content")))
    return recall.gate(calls).select("session_key", "seq", "epoch", "fire", "injected")


@_query(f"{_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM messages) SELECT session_key, idx, role, left(content, 200) AS content FROM r WHERE rn <= 3 AND role IN ('user', 'assistant') AND length(content) > 1")
def memory_query_window(spark, sf_dir):
    """The last 3 messages of each session, then the speakers' among them."""
    return M.query_window(R.messages(spark, sf_dir), 3, 200)


@_query(f"{_M}, r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM messages) SELECT session_key, idx, role, left(content, 2000) AS content FROM r WHERE rn <= 10 AND role IN ('user', 'assistant') AND length(content) > 1")
def memory_query_window_whole(spark, sf_dir):
    """As memory_query_window with the default number of messages and length."""
    return M.query_window(R.messages(spark, sf_dir))


@_query(f"{_M}, u AS (SELECT session_key, arg_max(content, idx) AS c FROM messages WHERE role = 'user' GROUP BY session_key) SELECT session_key, CASE WHEN length(c) > 1 THEN c END AS last_user_text FROM u")
def last_user_text(spark, sf_dir):
    """The latest user text of each session."""
    return M.last_user_text(R.messages(spark, sf_dir))


@_query(f"{_M} SELECT session_key, idx, {_DEICTIC_SQL.format(x='content')} AS deictic, coalesce(length(content) >= 10 AND NOT contains(content, 'HEARTBEAT') AND NOT contains(content, 'boot check'), false) AS passes, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens FROM messages")
def prompt_flags(spark, sf_dir):
    """References back, the prompt gate and the token estimate of every message."""
    c = F.col("content")
    return R.messages(spark, sf_dir).select("session_key", "idx", T.has_deictic(c).alias("deictic"), T.prompt_passes(c).alias("passes"), T.tokens_estimate(c).alias("tokens"))


@_query(f"{_TEXTS.replace('FROM messages WHERE', 'FROM messages WHERE conv_id % 5 <> 0 AND')}, clean AS (SELECT session_key, idx, {_clean('text')} AS text FROM texts), j AS (SELECT session_key, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM clean WHERE text <> '' GROUP BY session_key) " + _episode("j", "left(text, 12000)", "batch", "'ingest_batch'"))
def capture_awake(spark, sf_dir):
    """The batch capture of all but heartbeat messages."""
    return capture.batch(R.messages(spark, sf_dir).withColumn("is_heartbeat", F.col("conv_id") % 5 == 0), NOW, NOW_MS)


_STARTED = "SELECT session_key, '2026-01-0' || CAST(1 + (conv_id + idx) % 5 AS STRING) || 'T00:00:00.000Z' AS session_start FROM messages WHERE conv_id % 2 = 0"


_HOOKED = _described("'before_compaction'")


@_query(
    f"""{_TEXTS}, {_HOOK}, j AS ({_JOINED} HAVING count(*) >= 2), st AS (SELECT session_key, max(session_start) AS start FROM ({_STARTED}) GROUP BY session_key)
SELECT session_key, CASE WHEN start IS NULL THEN {_HOOKED} ELSE left({_HOOKED}, length({_HOOKED}) - 1) || ',"session_start":"' || start || '"}}' END AS source_description
FROM j LEFT JOIN st USING (session_key) WHERE session_key IN (SELECT session_key FROM enough)"""
)
def session_start(spark, sf_dir):
    """The provenance of hook captures with the latest start of their session."""
    rows = R.messages(spark, sf_dir)
    return capture.before_compaction(capture.with_session_start(rows, R._select(spark, _STARTED, messages=rows), NOW), NOW, NOW_MS).select("session_key", "source_description")


_CAUGHT = "SELECT session_key, idx, '2026-01-0' || CAST(1 + (conv_id + 3 * idx) % 6 AS STRING) || CASE WHEN idx % 2 = 0 THEN 'T00:00:00.000Z' ELSE 'T12:00:00.000Z' END AS captured_at FROM messages"


@_query(f"{_M}, c AS ({_CAUGHT}), s AS ({_STARTED}) SELECT c.session_key, c.idx, c.captured_at, s.session_start FROM c ASOF LEFT JOIN (SELECT DISTINCT * FROM s) s ON c.session_key = s.session_key AND c.captured_at >= s.session_start")
def session_start_as_of(spark, sf_dir):
    """The start of its session that was the last one at each of several captures."""
    rows = R.messages(spark, sf_dir)
    return capture.start_as_of(R._select(spark, _CAUGHT, messages=rows), R._select(spark, _STARTED, messages=rows))


# --- search --------------------------------------------------------------------------------------------------------

_BM25 = """asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM queries),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM docs),
size AS (SELECT count(*) AS n, sum(len(w)) AS total FROM words WHERE len(w) > 0),
post AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM words) GROUP BY ALL),
idf AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, size WHERE term IN (SELECT term FROM asked) GROUP BY term, n),
scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len * n / total))), 6) AS score FROM post JOIN idf USING (term) JOIN asked USING (term), size GROUP BY query_id, doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""
_BY_TEXT = f"docs AS (SELECT doc_id, text FROM documents), queries AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 50 = 0), {_BM25}"
_BY_VECTOR = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 50 = 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near)"""


def _text_search(spark, sf_dir):
    queries = R.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(R.table(spark, sf_dir, "documents").select("doc_id", "text"), queries)


def _vector_search(spark, sf_dir):
    rows = R.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return search.cosine_top(rows, rows.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q")))


@_query(f"WITH {_BY_TEXT} SELECT query_id, doc_id, score, rank FROM best WHERE rank <= 10")
def bm25_search(spark, sf_dir):
    """The 10 best documents for every 50th benchmark item."""
    return _text_search(spark, sf_dir)


_EVERY_TEXT = f"docs AS (SELECT doc_id, text FROM documents), queries AS (SELECT item_id AS query_id, text AS query FROM benchmark), {_BM25}"


@_query(f"WITH {_EVERY_TEXT} SELECT query_id, doc_id, score, rank FROM best WHERE rank <= 10")
def bm25_indexed(spark, sf_dir):
    """The 10 best documents for every benchmark item, over a stored index that leaves out ranges of documents."""
    path = f"{shared.folder(spark)}/index-{uuid.uuid4().hex}"
    textindex.build(R.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return textindex.top(spark, path, R.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")))


@_query(f"WITH {_BY_VECTOR} SELECT query_id, doc_id, score, rank FROM nearest WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    """The 10 nearest vectors for every 50th one."""
    return _vector_search(spark, sf_dir)


@_query(f"WITH {_BY_TEXT}, {_BY_VECTOR}, f AS (SELECT query_id, doc_id, round(sum(s), 6) AS score FROM (SELECT query_id, doc_id, 1.0 / (60 + rank) AS s FROM best WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, 1.0 / (60 + rank) FROM nearest WHERE rank <= 10) GROUP BY query_id, doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10")
def hybrid_rrf(spark, sf_dir):
    """Both searches fused."""
    return search.fuse(_text_search(spark, sf_dir), _vector_search(spark, sf_dir))


_ASSEMBLE = f"""{_tail(1500)}, last AS (SELECT session_key, count(*) AS n, arg_max(content, idx) FILTER (WHERE role = 'user') AS c FROM messages GROUP BY session_key),
due AS (SELECT session_key FROM last WHERE n <= 3 OR coalesce({_DEICTIC_SQL.format(x="c")}, false)),
facts AS (SELECT * FROM ({R.FACTS}) WHERE group_id = 'core'), docs AS (SELECT uuid AS doc_id, name || ' ' || fact AS text FROM facts),
queries AS (SELECT session_key AS query_id, right(text, 200) AS query FROM tail WHERE session_key IN (SELECT session_key FROM due)), {_BM25},
b AS (SELECT query_id AS session_key, '<memory-context>' || chr(10) || 'Relevant knowledge graph facts (auto-recalled):' || chr(10) || string_agg('- **' || name || '**: ' || fact, chr(10) ORDER BY rank) || chr(10) || '</memory-context>' AS facts FROM best JOIN facts ON uuid = doc_id WHERE rank <= 5 GROUP BY query_id),
t AS (SELECT session_key, '<memory-continuity>' || chr(10) || 'Recent session context (recovered from transcript):' || chr(10) || text || chr(10) || '</memory-continuity>' AS continuity FROM tail WHERE session_key IN (SELECT session_key FROM due))"""


@_query(f"{_ASSEMBLE} SELECT session_key, md5(continuity) AS continuity, md5(facts) AS facts, CAST(ceil(length(concat_ws(chr(10) || chr(10), continuity, facts)) / 4.0) AS BIGINT) AS tokens FROM t LEFT JOIN b USING (session_key)")
def assemble_context(spark, sf_dir):
    """What each session in need of context gets: its tail and the facts found by the tail's last 200 characters."""
    config = replace(DEFAULT, semantic_query_chars=200, recall_max_facts=5, auto_recall=True)
    out = recall.assemble(R.messages(spark, sf_dir), R.facts(spark, sf_dir), config, 1500)
    return out.select("session_key", F.md5("continuity").alias("continuity"), F.md5("facts").alias("facts"), "tokens")


_FOUND = f"SELECT query_id, '<memory-context>' || chr(10) || 'Relevant knowledge graph facts (auto-recalled):' || chr(10) || string_agg('- **' || name || '**: ' || fact, chr(10) ORDER BY rank) || chr(10) || '</memory-context>' AS addition FROM best JOIN facts ON uuid = doc_id WHERE rank <= 10 GROUP BY query_id"
_FACT_DOCS = f"facts AS (SELECT * FROM ({R.FACTS}) WHERE group_id = 'core'), docs AS (SELECT uuid AS doc_id, name || ' ' || fact AS text FROM facts)"


@_query(
    f"{_M}, {_FACT_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_key ORDER BY idx DESC) AS rn FROM messages WHERE conv_id % 50 = 0), "
    f"queries AS (SELECT session_key AS query_id, string_agg(left(content, 200), chr(10) ORDER BY idx) AS query FROM r WHERE rn <= 3 AND role IN ('user', 'assistant') AND length(content) > 1 GROUP BY session_key), {_BM25} "
    "SELECT query_id AS session_key, uuid, name, fact, score, rank FROM best JOIN facts ON uuid = doc_id WHERE rank <= 10"
)
def memory_search(spark, sf_dir):
    """The facts that fit the last 3 messages of every 50th session."""
    asked = R.messages(spark, sf_dir).where("conv_id % 50 = 0")
    return recall.memory_search(asked, R.facts(spark, sf_dir), replace(DEFAULT, memory_query_messages=3, message_cap=200))


@_query(f"WITH {_FACT_DOCS}, queries AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id % 50 = 0), {_BM25} SELECT query_id, md5(addition) AS addition FROM ({_FOUND})")
def spawn_context(spark, sf_dir):
    """The facts that a task, every 50th benchmark item, is given."""
    tasks = R.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return recall.spawn_context(tasks, R.facts(spark, sf_dir)).select("query_id", F.md5("addition").alias("addition"))


_ITEMS = "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN left(text, 9) WHEN 1 THEN 'HEARTBEAT ' || text ELSE text END AS query FROM benchmark"


@_query(f"WITH {_FACT_DOCS}, queries AS (SELECT * FROM ({_ITEMS}) WHERE query_id % 50 IN (0, 1, 2) AND length(query) >= 10 AND NOT contains(query, 'HEARTBEAT')), {_BM25} SELECT query_id, md5(addition) AS addition FROM ({_FOUND})")
def hook_recall(spark, sf_dir):
    """The facts that prompts get before they are answered; short ones and heartbeats get none."""
    prompts = R._select(spark, _ITEMS, benchmark=R.table(spark, sf_dir, "benchmark")).where("query_id % 50 IN (0, 1, 2)")
    return recall.hook_recall(prompts, R.facts(spark, sf_dir), replace(DEFAULT, auto_recall=True)).select("query_id", F.md5("addition").alias("addition"))


@_query(
    f"WITH facts AS ({R.FACTS}), docs AS (SELECT uuid AS doc_id, name || ' ' || fact AS text FROM facts WHERE group_id IN ('core', 'other')), queries AS (SELECT item_id AS query_id, CASE WHEN item_id = 0 THEN '' ELSE text END AS query FROM benchmark WHERE item_id % 50 = 0 OR item_id = 7), {_BM25}, "
    "t AS (SELECT query_id, count(*) AS n, string_agg(rank || '. **' || name || '**: ' || fact || ' [' || coalesce(valid_at, 'ongoing') || ']', chr(10) ORDER BY rank) AS lines, string_agg(uuid, ',' ORDER BY rank) AS uuids FROM best JOIN facts ON uuid = doc_id WHERE rank <= 5 GROUP BY query_id) "
    "SELECT query_id, md5(CASE WHEN n IS NULL THEN 'No relevant facts found in the knowledge graph.' ELSE 'Found ' || n || ' facts:' || chr(10) || chr(10) || lines END) AS text, coalesce(n, 0) AS count, uuids FROM queries LEFT JOIN t USING (query_id)"
)
def search_tool(spark, sf_dir):
    """The search tool's answer over two groups: a numbered listing and its details."""
    queries = R.table(spark, sf_dir, "benchmark").where("item_id % 50 = 0 OR item_id = 7").select(F.col("item_id").alias("query_id"), F.expr("CASE WHEN item_id = 0 THEN '' ELSE text END AS query"))
    out = recall.search_tool(queries, R.facts(spark, sf_dir), 5, ("core", "other"))
    return out.select("query_id", F.md5("text").alias("text"), "count", F.array_join(F.transform("details", lambda d: d["uuid"]), ",").alias("uuids"))


_SIGNAL = "CASE conv_id % 4 WHEN 0 THEN 'compact' WHEN 1 THEN 'bootstrap' END"


@_query(
    f"""{_M}, last AS (SELECT session_key, any_value(conv_id) AS conv_id, count(*) AS n, arg_max(content, idx) FILTER (WHERE role = 'user') AS c FROM messages GROUP BY session_key),
s AS (SELECT session_key, n, coalesce(length(c) > 1 AND {_DEICTIC_SQL.format(x="c")}, false) AS deictic, {_SIGNAL} AS event, conv_id % 3 = 0 AS recalled FROM last)
SELECT session_key FROM s WHERE NOT (recalled AND event IS NULL AND NOT deictic) AND (event IN ('bootstrap', 'compact') OR n <= 3 OR deictic)"""
)
def recall_due(spark, sf_dir):
    """The sessions that get context back, by pending events, earlier recall, gap and last user text."""
    rows = R.messages(spark, sf_dir)
    signals = rows.select("session_key", F.expr(f"{_SIGNAL} AS event"), F.expr("conv_id % 3 = 0 AS recalled")).distinct()
    return recall.due(rows, replace(DEFAULT, auto_recall=True), signals)


@_query(f"{_M}, e AS ({R.EPISODES}), n AS (SELECT least(count(*), 10000) AS episode_count FROM e WHERE group_id = 'core') SELECT session_key, true AS bootstrapped, 'bootstrap' AS event, false AS recalled, episode_count FROM (SELECT DISTINCT session_key FROM messages), n")
def session_bootstrap(spark, sf_dir):
    """What every session gets at its start."""
    return recall.bootstrap(R.messages(spark, sf_dir).select("session_key").distinct(), R.episodes(spark, sf_dir)).drop("reason")


# --- episodes and facts --------------------------------------------------------------------------------------------

_OF = "CASE WHEN json_valid(source_description) AND trim(source_description) <> 'null' THEN coalesce(json_extract_string(source_description, '$.session_key') = 's7', false) ELSE coalesce(contains(source_description, 'session=s7'), false) OR coalesce(contains(name, 's7'), false) END"
_E = f"WITH e AS ({R.EPISODES})"


@_query(f"{_E}, l AS (SELECT * FROM e WHERE group_id = 'core' ORDER BY created_at DESC, uuid LIMIT 50) SELECT uuid, created_at, name FROM l WHERE {_OF} ORDER BY created_at DESC, uuid LIMIT 10")
def episodes_limit_then_filter(spark, sf_dir):
    """A session's episodes among the newest 50 of the group."""
    return episodes.listed(R.episodes(spark, sf_dir), "s7", 10).select("uuid", "created_at", "name")


@_query(f"{_E}, l AS (SELECT * FROM e WHERE group_id = 'core' ORDER BY created_at DESC, uuid LIMIT 50) SELECT uuid, created_at, name FROM l WHERE {_OF}")
def episodes_cli(spark, sf_dir):
    """The same without a wider fetch, as the command line does."""
    return episodes.listed(R.episodes(spark, sf_dir), "s7", 50, overfetch=False).select("uuid", "created_at", "name")


@_query(f"{_E} SELECT uuid, created_at, name FROM e WHERE {_OF} ORDER BY created_at DESC, uuid LIMIT 10")
def episodes_filter_then_limit(spark, sf_dir):
    """A session's newest 10 episodes."""
    return episodes.of_session(R.episodes(spark, sf_dir), "s7", 10).select("uuid", "created_at", "name")


@_query(f"{_E} SELECT group_id, least(count(*), 100) AS episodes, max(created_at) AS latest, CAST(least(count(*), 100) AS VARCHAR) || CASE WHEN count(*) >= 100 THEN '+' ELSE '' END AS label FROM e GROUP BY group_id")
def episode_stats(spark, sf_dir):
    """Counts up to a ceiling and latest times by group."""
    return episodes.stats(R.episodes(spark, sf_dir), replace(DEFAULT, count_ceiling=100)).withColumn("episodes", F.col("episodes").cast("long"))


def _part(label: str, key: str) -> str:
    return f"'{label}=' || nullif(json_extract_string(source_description, '$.{key}'), '')"


_AGO = f"CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END"
_AGED = f"{_E}, a AS (SELECT *, CAST(floor(epoch(TIMESTAMP '2026-07-01') - epoch(CAST(replace(replace(created_at, 'T', ' '), 'Z', '') AS TIMESTAMP))) AS BIGINT) AS s, json_valid(source_description) AND source_description <> 'null' AS ok FROM e)"


@_query(
    f"""{_AGED} SELECT uuid,
'**uuid: ' || uuid || '** ' || CASE WHEN coalesce(name, '') <> '' THEN '**' || name || '**' ELSE '(unnamed)' END || ' ' || CASE WHEN ok THEN concat_ws(' ', {_part("event", "event")}, {_part("session", "session_key")}, {_part("file", "file")}) ELSE coalesce(source_description, '') END || ' (' || {_AGO} || ')' || CASE WHEN coalesce(content, '') <> '' THEN chr(10) || '   ' || left(content, 100) ELSE '' END AS tool,
'• ' || coalesce(name, uuid) || '  ' || CASE WHEN ok THEN concat_ws(' ', '[' || json_extract_string(source_description, '$.event') || ']', {_part("source", "source")}, {_part("file", "file")}, {_part("session", "session_key")}, {_part("agent", "agent")}, {_part("channel", "channel")}) ELSE coalesce(source_description, '') END || '  ' || {_AGO} AS cli FROM a"""
)
def episode_lines(spark, sf_dir):
    """Every episode as the tool and as the command line print it."""
    now = F.lit("2026-07-01 00:00:00").cast("timestamp")
    return R.episodes(spark, sf_dir).select("uuid", episodes.tool_line(now).alias("tool"), episodes.cli_line(now).alias("cli"))


_F = f"WITH facts AS ({R.FACTS})"


@_query(f"{_F} SELECT uuid, '**' || name || '**: ' || fact || ' [' || coalesce(valid_at, 'ongoing') || ']' AS tool, '• **' || name || '**: ' || fact || ' [' || coalesce(valid_at, 'ongoing') || coalesce(' → ' || invalid_at, '') || ']' AS cli, '[' || uuid || '] **' || name || '**: ' || fact AS candidate, CASE WHEN length(fact) > 100 THEN left(fact, 100) || '...' ELSE fact END AS preview FROM facts")
def fact_lines(spark, sf_dir):
    """Every fact as the search tool, the command line and the delete list print it."""
    return R.facts(spark, sf_dir).select("uuid", episodes.search_line().alias("tool"), episodes.cli_search_line().alias("cli"), episodes.candidate_line().alias("candidate"), T.preview(F.col("fact")).alias("preview"))


@_query(
    f"""{_F}, p AS (SELECT *, split_part(uuid, '-', 2) AS session, CAST(split_part(uuid, '-', 3) AS BIGINT) // {DEFAULT.list_max} AS page FROM facts),
b AS (SELECT group_id, session, page, '<memory-context>' || chr(10) || 'Relevant knowledge graph facts (auto-recalled):' || chr(10) || string_agg('- **' || name || '**: ' || replace(fact, chr(10), ' '), chr(10) ORDER BY uuid) || chr(10) || '</memory-context>' AS block, count(*) AS n FROM p GROUP BY group_id, session, page)
SELECT group_id, session, page, md5(block) AS block, CAST(n AS BIGINT) AS n FROM b"""
)
def format_facts(spark, sf_dir):
    """The facts of each group as blocks, one for a page of at most 50 turns of a session, and their number read off the block.

    A block goes into one prompt, so it is bounded; a group or session of any size is many pages.
    """
    rows = R.facts(spark, sf_dir).withColumn("line", T.fact_line(F.col("name"), F.replace("fact", F.lit("\n"), F.lit(" "))))
    turn = F.split_part("uuid", F.lit("-"), F.lit(3)).cast("long")
    rows = rows.withColumn("session", F.split_part("uuid", F.lit("-"), F.lit(2))).withColumn("page", F.floor(turn / DEFAULT.list_max))
    parts = F.array_sort(F.collect_list(F.struct("uuid", "line")))
    blocks = rows.groupBy("group_id", "session", "page").agg(T.context_block(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("block"))
    return blocks.select("group_id", "session", "page", F.md5("block").alias("block"), T.count_facts(F.col("block")).cast("long").alias("n"))


@_query(f"{_F} SELECT uuid, name, group_id FROM facts WHERE group_id IN ('core') AND uuid NOT IN (SELECT uuid FROM facts WHERE valid_at IS NULL)")
def delete_facts(spark, sf_dir):
    """What is left of a group once facts without a start are deleted."""
    rows = R.facts(spark, sf_dir)
    return episodes.delete(episodes.in_groups(rows), rows.where("valid_at is null")).select("uuid", "name", "group_id")


_REQUESTS = "SELECT conv_id * 100 + turn AS request_id, CASE WHEN turn % 3 = 0 THEN NULL ELSE 'q' END AS query, CASE WHEN turn % 5 = 0 THEN '0123abcd-0000-4000-8000-00000000000' || CAST(conv_id % 10 AS STRING) WHEN turn % 5 = 1 THEN 'fact-1' ELSE '' END AS uuid, CASE WHEN turn % 4 = 0 THEN 'episode' WHEN turn % 4 = 1 THEN NULL ELSE 'fact' END AS type, conv_id % 4 AS hits FROM conversations"


@_query(
    f"""WITH r AS ({_REQUESTS}), d AS (SELECT *, CASE WHEN coalesce(query, '') = '' AND coalesce(uuid, '') = '' THEN 'missing_params' WHEN coalesce(uuid, '') <> '' AND NOT regexp_matches(lower(uuid), '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') THEN 'invalid_uuid' WHEN coalesce(uuid, '') <> '' THEN NULL WHEN coalesce(type, 'fact') = 'episode' THEN 'episode_query_not_supported' WHEN hits = 0 THEN 'no_matches' WHEN hits > 1 THEN 'multiple_matches' END AS reason FROM r)
SELECT request_id, reason IS NULL AS deleted, reason, CASE WHEN reason IS NULL THEN coalesce(nullif(uuid, ''), 'm0') END AS target FROM d"""
)
def forget_decision(spark, sf_dir):
    """The decision on every delete request."""
    rows = R._select(spark, _REQUESTS, conversations=R.table(spark, sf_dir, "conversations"))
    matches = rows.where("hits > 0").select("request_id", F.explode(F.expr("transform(sequence(0L, hits - 1), i -> concat('m', i))")).alias("uuid"))
    return episodes.forget(rows.drop("hits"), matches)


@_query("SELECT 'fact-' || event_id AS uuid, upper(event_type) AS name, 'user ' || user_id || ' did ' || event_type AS fact, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to, 'g' || (user_id % 4) AS group_id FROM events")
def fact_intervals(spark, sf_dir):
    """Facts with the time until the next of their kind."""
    return episodes.intervals(R.table(spark, sf_dir, "events")).drop("user_id", "event_type")


@_query("WITH i AS (SELECT event_id, user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events), m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events) SELECT 'fact-' || event_id AS uuid, user_id, event_type, valid_from FROM i, m WHERE valid_from <= date_trunc('second', middle) AND (valid_to IS NULL OR valid_to > date_trunc('second', middle))")
def fact_as_of(spark, sf_dir):
    """The facts that hold in the middle of the time covered."""
    events = R.table(spark, sf_dir, "events")
    middle = events.select(F.date_trunc("second", F.timestamp_micros(F.floor((F.min(F.unix_micros(F.col("ts").cast("timestamp"))) + F.max(F.unix_micros(F.col("ts").cast("timestamp")))) / 2).cast("long"))).alias("at"))
    return episodes.as_of(episodes.intervals(events).crossJoin(F.broadcast(middle)), F.col("at")).select("uuid", "user_id", "event_type", "valid_from")  # one row


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def event_rates(spark, sf_dir):
    """Events by hour and type, as the stream of them counts."""
    return streamed.rates(R.table(spark, sf_dir, "events"))


# --- memory files and the log --------------------------------------------------------------------------------------

_FS = f"WITH files AS ({R.FILES_SQL}), state AS ({R.STATE}), x AS (SELECT f.*, s.last_modified AS known, lower(regexp_extract(f.path, '[^/]+?(\\.[^./]*)?$', 1)) AS ext FROM files f LEFT JOIN state s USING (path))"
_RUN = "CASE WHEN ext NOT IN ('.md', '.txt') THEN 'filtered' WHEN last_modified IS NULL THEN 'unreadable' WHEN known = last_modified THEN 'unchanged' ELSE 'indexed' END"


@_query(f"{_FS} SELECT path, CASE WHEN ext NOT IN ('.md', '.txt') THEN 'filtered' WHEN known IS NULL THEN 'new' WHEN last_modified IS NOT NULL AND known <> last_modified THEN 'updated' ELSE 'unchanged' END AS status FROM x")
def index_classify(spark, sf_dir):
    """The dry run over every file."""
    return memory_files.classify(R.files(spark, sf_dir), R.state(spark, sf_dir), dry_run=True).select("path", "status")


@_query(f"{_FS} SELECT {_RUN} AS status, count(*) AS files FROM x GROUP BY 1")
def index_counts(spark, sf_dir):
    """Counters of a run."""
    return memory_files.counts(memory_files.classify(R.files(spark, sf_dir), R.state(spark, sf_dir)))


@_query(
    f"""{_FS} SELECT path, md5('---' || chr(10) || 'type: memory-index' || chr(10) || 'file: ' || path || chr(10) || 'last_modified: ' || last_modified || chr(10) || 'size: ' || size || chr(10) || '---' || chr(10) || excerpt) AS content, 'memory-index::' || path AS name, last_modified AS "timestamp",
'{{"plugin":"memloom","event":"memory_index","ts":"' || last_modified || '","group_id":"core","file":"' || path || '","file_type":"' || ext || '"}}' AS source_description FROM x WHERE {_RUN} = 'indexed'"""
)
def index_episodes(spark, sf_dir):
    """The index episodes of new and changed files."""
    out = memory_files.episodes(memory_files.classify(R.files(spark, sf_dir), R.state(spark, sf_dir)))
    return out.select("path", F.md5("content").alias("content"), "name", "timestamp", "source_description")


@_query(f"{_FS}, c AS (SELECT path, last_modified FROM x WHERE {_RUN} = 'indexed') SELECT path, last_modified, '{NOW}' AS last_indexed FROM c UNION ALL SELECT path, last_modified, last_indexed FROM state WHERE path NOT IN (SELECT path FROM c)")
def index_state(spark, sf_dir):
    """The state after a run."""
    state = R.state(spark, sf_dir)
    return memory_files.next_state(memory_files.classify(R.files(spark, sf_dir), state), state, NOW)


_CALLED = "SELECT conv_id * 100 + turn AS id, CASE turn % 4 WHEN 0 THEN 'Write' WHEN 1 THEN 'edit' WHEN 2 THEN 'read' ELSE 'create_file' END AS tool, CASE WHEN conv_id % 3 = 0 THEN '/home/u/notes/x.md' WHEN conv_id % 3 = 1 THEN '/w/memory/a/memory/' || CAST(conv_id AS STRING) || '.md' END AS file_path, CASE WHEN turn % 2 = 0 THEN 'memory/p' || CAST(turn AS STRING) || '.png' END AS path FROM conversations"


@_query(f"WITH c AS ({_CALLED}) SELECT id, CASE WHEN tool <> 'read' THEN coalesce(CASE WHEN strpos(file_path, '/memory/') > 0 THEN substr(file_path, strpos(file_path, '/memory/') + 1) WHEN starts_with(file_path, 'memory/') THEN file_path END, CASE WHEN strpos(path, '/memory/') > 0 THEN substr(path, strpos(path, '/memory/') + 1) WHEN starts_with(path, 'memory/') THEN path END) END AS memory_path FROM c")
def memory_path(spark, sf_dir):
    """The memory file that each tool call names."""
    rows = R._select(spark, _CALLED, conversations=R.table(spark, sf_dir, "conversations"))
    params = F.create_map(F.lit("file_path"), F.col("file_path"), F.lit("path"), F.col("path"), F.lit("filePath"), F.lit(None).cast("string"), F.lit("target_file"), F.lit(None).cast("string"))
    return rows.select("id", T.memory_path(F.col("tool"), params).alias("memory_path"))


@_query(
    """SELECT event_id, '2026 [memloom] ' || CASE WHEN length(event_type) < 12 THEN rpad(event_type, 12, ' ') ELSE event_type END || ' ' || concat_ws(' ', 'user=' || user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'props=' || CASE WHEN contains(props, ' ') THEN '"' || replace(props, '"', '\\"') || '"' ELSE replace(props, '"', '\\"') END END) AS line FROM events"""
)
def log_format(spark, sf_dir):
    """Every event as a log line."""
    rows = R.table(spark, sf_dir, "events")
    fields = [("user", F.col("user_id")), ("props", F.when(F.col("user_id") % 3 != 0, F.col("props")))]
    return rows.select("event_id", T.log_line(F.lit("2026"), F.col("event_type"), fields).alias("line"))


@_query("SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM (SELECT event_id, CAST(floor((epoch_us(m) - epoch_us(ts)) / 1000000) AS BIGINT) AS s FROM events, (SELECT max(ts) AS m FROM events))")
def time_ago(spark, sf_dir):
    """The age of every event at the time of the last."""
    events = R.table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("m"))  # one row
    return events.crossJoin(F.broadcast(last)).select("event_id", T.time_ago(F.col("ts"), F.col("m")).alias("age"))


_WROTE = "SELECT CASE WHEN doc_id % 3 = 0 THEN 'read' ELSE 'Write' END AS tool, map('path', '/home/' || path) AS params, CASE WHEN doc_id % 5 = 0 THEN 'denied' WHEN doc_id % 5 = 1 THEN '' END AS error FROM noted"


@_query(f"{_FS}, d AS (SELECT *, CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS doc_id FROM x) SELECT path, {_RUN} AS status FROM d WHERE ext IN ('.md', '.txt') AND doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def auto_index(spark, sf_dir):
    """What is indexed of the files that tool calls without an error wrote."""
    files = R.files(spark, sf_dir)
    noted = files.withColumn("doc_id", F.regexp_extract("path", "([0-9]+)[^0-9]*$", 1).cast("long"))
    calls = R._select(spark, _WROTE, noted=noted)
    return memory_files.auto_index(calls, files, R.state(spark, sf_dir)).select("path", "status")
