"""Recall: when a session gets context back, and what it gets.

The gate is a state machine per session; in batch its state is a matter of
running counts within the session: epochs start at lifecycle events, the first
call of an epoch has the event pending, and a session counts as recalled once a
call of the epoch was a candidate and found something.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.config import DEFAULT, Config
from memloom.functions import text as T
from memloom.operators import continuity, episodes, search, textindex
from memloom.operators import messages as M


def gate(events: DataFrame) -> DataFrame:
    """Adds epoch, fire and injected to events (session_key, seq, kind, gap, deictic, nonempty); kind is assemble, bootstrap or compact.

    Lifecycle rows keep nulls in fire and injected. Calls while unhealthy or with recall off are to be left out before.
    """
    order = Window.partitionBy("session_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    call = F.col("kind") == "assemble"
    rows = events.withColumn("epoch", F.sum(F.when(call, 0).otherwise(1)).over(order))
    inside = Window.partitionBy("session_key", "epoch").orderBy("seq")
    nth = F.sum(F.when(call, 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("pending", call & (F.col("epoch") > 0) & (nth == 1))
    rows = rows.withColumn("candidate", call & (F.col("pending") | F.col("gap") | F.col("deictic")))
    before = F.max(F.when(F.col("candidate") & F.col("nonempty"), 1).otherwise(0)).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("recalled", F.coalesce(before, F.lit(0)) == 1)
    fire = F.col("candidate") & (F.col("pending") | F.col("deictic") | ~F.col("recalled"))
    rows = rows.withColumn("fire", F.when(call, fire)).withColumn("injected", F.when(call, fire & F.col("nonempty")))
    return rows.drop("pending", "candidate", "recalled")


def _fact_texts(facts: DataFrame) -> DataFrame:
    return facts.select(F.col("uuid").alias("doc_id"), F.concat_ws(" ", "name", "fact").alias("text"))


def index_facts(facts: DataFrame, path: str, groups: tuple[str, ...] = (DEFAULT.group,)) -> None:
    """Stores the search index of the groups' facts, for `found_facts`."""
    textindex.build(_fact_texts(episodes.in_groups(facts, groups)), path)


def found_facts(queries: DataFrame, facts: DataFrame, k: int, groups: tuple[str, ...] = (DEFAULT.group,), index: str | None = None) -> DataFrame:
    """(query_id, uuid, name, fact, score, rank): the k best facts of the groups for each of queries (query_id, query).

    index: the folder of an index of the same facts and groups; only the postings that can matter are read from it.
    """
    facts = episodes.in_groups(facts, groups)
    found = search.bm25(_fact_texts(facts), queries, k) if index is None else textindex.top(facts.sparkSession, index, queries, k)
    return found.withColumnRenamed("doc_id", "uuid").join(facts.select("uuid", "name", "fact"), "uuid")


def fact_blocks(queries: DataFrame, facts: DataFrame, config: Config = DEFAULT, index: str | None = None) -> DataFrame:
    """(query_id, block): the facts found for each query as a tagged block; queries that find none have no row."""
    parts = F.array_sort(F.collect_list(F.struct("rank", T.fact_line(F.col("name"), F.col("fact")).alias("line"))))
    block = T.context_block(F.array_join(F.transform(parts, lambda x: x["line"]), "\n"), config)
    return found_facts(queries, facts, config.recall_max_facts, (config.group,), index).groupBy("query_id").agg(block.alias("block"))


def memory_queries(messages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, query): the messages of each session's query window, in order, as one query."""
    rows = M.query_window(messages, config.memory_query_messages, config.message_cap)
    rows = rows.select("session_key", "idx", F.lit(0).alias("block"), F.col("content").alias("text"))
    return M.joined(rows, "\n").select(F.col("session_key").alias("query_id"), F.col("text").alias("query"))


def memory_search(messages: DataFrame, facts: DataFrame, config: Config = DEFAULT, index: str | None = None) -> DataFrame:
    """(session_key, uuid, name, fact, score, rank): the facts that fit each session's last messages."""
    return found_facts(memory_queries(messages, config), facts, config.recall_max_facts, (config.group,), index).withColumnRenamed("query_id", "session_key")


def due(messages: DataFrame, config: Config = DEFAULT, signals: DataFrame | None = None) -> DataFrame:
    """(session_key) of sessions in a gap or whose last user text refers back; none with recall off.

    signals: (session_key, event, recalled), the pending lifecycle event or null, and whether the session was recalled
    since the last one. A recalled session is passed over unless an event is pending or its last user text refers back.
    """
    asked = M.last_user_text(messages).select("session_key", T.has_deictic(F.col("last_user_text")).alias("deictic"))
    rows = messages.groupBy("session_key").agg(F.count("*").alias("n")).join(asked, "session_key", "left")
    rows = rows.withColumns({"event": F.lit(None).cast("string"), "recalled": F.lit(False)}) if signals is None else rows.join(signals, "session_key", "left")
    deictic, pending = F.coalesce("deictic", F.lit(False)), F.coalesce(F.col("event") != "", F.lit(False))
    open_ = ~F.coalesce("recalled", F.lit(False)) | pending | deictic
    rows = rows.where(open_ & (T.is_gap(F.col("n"), F.col("event"), config.gap_threshold) | deictic))
    return rows.where(F.lit(config.auto_recall)).select("session_key")


def bootstrap(sessions: DataFrame, stored: DataFrame, healthy: bool = True, config: Config = DEFAULT) -> DataFrame:
    """(session_key, bootstrapped, reason, event, recalled, episode_count) for sessions that start: each gets the event and may recall again.

    The columns event and recalled are signals for `due`. Without a healthy store nothing is signalled.
    """
    if not healthy:
        return sessions.select("session_key", F.lit(False).alias("bootstrapped"), F.lit("server-unhealthy").alias("reason"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("boolean").alias("recalled"), F.lit(None).cast("long").alias("episode_count"))
    n = episodes.in_groups(stored, (config.group,)).agg(F.least(F.count("*"), F.lit(config.count_ceiling)).cast("long").alias("episode_count"))
    return sessions.select("session_key", F.lit(True).alias("bootstrapped"), F.lit(None).cast("string").alias("reason"), F.lit("bootstrap").alias("event"), F.lit(False).alias("recalled")).crossJoin(F.broadcast(n))  # one row


def search_tool(queries: DataFrame, facts: DataFrame, limit: int = DEFAULT.recall_max_facts, groups: tuple[str, ...] | None = None, config: Config = DEFAULT) -> DataFrame:
    """(query_id, text, count, details): what the search tool answers each of queries; limit is 1 to the listing's most, groups the own one by default."""
    if not 1 <= limit <= config.list_max:
        raise ValueError(f"limit must be 1 to {config.list_max}")
    groups = groups or (config.group,)
    found = found_facts(queries, facts, limit, groups).select("query_id", "uuid", "rank").join(episodes.in_groups(facts, groups), "uuid")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), episodes.search_line())
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), F.struct("uuid", "name", "fact", "valid_at").alias("fact"))))  # limit rows at most
    rows = found.groupBy("query_id").agg(F.count("*").alias("count"), parts.alias("parts"))
    rows = queries.select("query_id").distinct().join(rows, "query_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    listing = F.concat(F.lit("Found "), F.col("count").cast("string"), F.lit(" facts:\n\n"), F.array_join(F.transform("parts", lambda p: p["line"]), "\n"))
    text = F.when(F.col("count") == 0, "No relevant facts found in the knowledge graph.").otherwise(listing)
    return rows.select("query_id", text.alias("text"), "count", F.transform("parts", lambda p: p["fact"]).alias("details"))


def assemble(messages: DataFrame, facts: DataFrame, config: Config = DEFAULT, budget: int | None = None, tails: DataFrame | None = None, stored: DataFrame | None = None, signals: DataFrame | None = None, index: str | None = None) -> DataFrame:
    """(session_key, continuity, facts, addition, tokens) for sessions that are due, as of their last message.

    The continuity comes from tails (session_key, text), the transcripts' ends, or from the messages themselves if not
    given; with stored episodes (as in continuity.episode_continuity, with group_id) sessions without a tail take theirs
    of the newest ones of the own group. signals are those of `due`. Facts are searched by the continuity's last
    characters, or by the message window where there is none, over an index of them if one is given. Sessions for
    which nothing is found have no row.
    """
    budget = budget or config.continuity_budget
    wanted = due(messages, config, signals)
    asked = messages.join(wanted, "session_key", "left_semi")
    tail = continuity.session_tail(asked, budget) if tails is None else tails.join(wanted, "session_key", "left_semi").select("session_key", "text")
    if stored is not None:
        without = wanted.join(tail, "session_key", "left_anti").withColumn("thread_id", F.lit(None).cast("string"))
        newest = episodes.last(stored, config.continuity_episodes, config.group)
        tail = tail.unionByName(continuity.episode_continuity(newest, without, budget))
    queries = tail.select(F.col("session_key").alias("query_id"), F.right("text", F.lit(config.semantic_query_chars)).alias("query"))
    if tails is not None:
        queries = queries.unionByName(memory_queries(asked.join(tail, "session_key", "left_anti"), config))
    found = fact_blocks(queries, facts, config, index).withColumnsRenamed({"query_id": "session_key", "block": "facts"})
    rows = tail.select("session_key", T.continuity_block(F.col("text"), config).alias("continuity"))
    rows = rows.join(found, "session_key", "left" if tails is None else "full")
    addition = F.concat_ws("\n\n", "continuity", "facts")
    return rows.select("session_key", "continuity", "facts", addition.alias("addition"), T.tokens_estimate(addition).alias("tokens"))


def hook_recall(prompts: DataFrame, facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, addition) for prompts (query_id, query) that pass the prompt gate and find facts; none with recall off."""
    return spawn_context(prompts.where(F.lit(config.auto_recall) & T.prompt_passes(F.col("query"), config)), facts, config)


def spawn_context(tasks: DataFrame, facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, addition) for tasks (query_id, query) with a text that find facts, whether or not recall is on."""
    asked = tasks.where(F.coalesce("query", F.lit("")) != "")
    return fact_blocks(asked, facts, config).withColumnRenamed("block", "addition")
