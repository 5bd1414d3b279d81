"""Continuity: what of a conversation or of its episodes fits a budget of characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.config import DEFAULT
from memloom.functions import provenance
from memloom.operators import messages as M


#: Numbers of a run, and parts that a session's rows are dealt to, so that no task sorts a whole session.
RUN, PARTS = 1000, 64


def budget_suffix(rows: DataFrame, keys: list[str], order: str, text: str, budget: int) -> DataFrame:
    """The newest rows whose lengths sum up to at most budget; the newest one always stays. `order` is a whole number; rows without a key go.

    Lengths are summed by runs of RUN numbers, and the sums from the newest run on. Only runs that begin within the budget
    are looked into, so at most about the budget's rows and one run come together.
    """
    rows = rows.withColumn("_run", F.floor(F.col(order) / RUN))
    runs = rows.groupBy(*keys, "_run").agg(F.sum(F.length(text)).alias("_size"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_later", F.sum("_size").over(later)).where(F.coalesce("_later", F.lit(0)) <= budget)
    rows = rows.join(runs.select(*keys, "_run"), [*keys, "_run"])
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    total = F.sum(F.length(text)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_sum", total).withColumn("_rn", F.row_number().over(newest)).where((F.col("_sum") <= budget) | (F.col("_rn") == 1)).drop("_sum", "_rn", "_run")


def budget_prefix(rows: DataFrame, keys: list[str], order: list[Column], text: str, budget: int, joiner: int = 2, least: int = DEFAULT.least_remainder) -> DataFrame:
    """The first rows by order that fit the budget with joiners between; of the first that doesn't, what fits if that is more than least. Adds _rn.

    Rows are dealt to PARTS parts first. What fills the budget in its part alone is out, since the rows before it in the whole
    order are at least those; what is left of all parts is ordered together.
    """
    part = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys and rows.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(PARTS))
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = F.sum(F.length(text) + joiner).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_part", part).withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= budget).drop("_part", "_before")
    first = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("_rn", F.row_number().over(first))
    total = F.sum(F.length(text)).over(first.rowsBetween(Window.unboundedPreceding, 0)) + joiner * (F.col("_rn") - 1)
    rows = rows.withColumn("_end", total).withColumn("_room", budget - (F.col("_end") - F.length(text)))
    whole, cut = F.col("_end") <= budget, (F.col("_room") > least) & (F.col("_room") < F.length(text))
    # Every row before one that fits, or is cut, fits: the sums only grow.
    return rows.where(whole | cut).withColumn(text, F.when(whole, F.col(text)).otherwise(F.left(text, F.col("_room").cast("int")))).drop("_end", "_room")


def session_tail(messages: DataFrame, budget: int = DEFAULT.continuity_budget) -> DataFrame:
    """(session_key, text): the newest labelled messages of each session that fit the budget, in order, by line."""
    rows = M.speakers(messages).where(F.length("content") > 0)
    label = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    rows = rows.select("session_key", "idx", F.lit(0).alias("block"), F.concat(label, "content").alias("text"))
    return M.joined(budget_suffix(rows, ["session_key"], "idx", "text", budget), "\n").select("session_key", "text")


def episode_continuity(episodes: DataFrame, sessions: DataFrame, budget: int = DEFAULT.continuity_budget) -> DataFrame:
    """(session_key, text) for each of sessions (session_key, thread_id): its episodes, same thread first, newest first, within the budget.

    episodes: (uuid, content, source_description, created_at). The session is matched by an equi-join on the provenance's key.
    """
    rows = episodes.where("content is not null and content != ''").withColumn("session_key", provenance.field(F.col("source_description"), "session_key"))
    rows = rows.join(sessions, "session_key").withColumn("score", provenance.score(F.col("source_description"), F.col("session_key"), F.col("thread_id")))
    rows = rows.where("score >= 1").withColumn("created_at", F.coalesce("created_at", F.lit("")))
    kept = budget_prefix(rows, ["session_key"], [F.desc("score"), F.desc("created_at"), F.asc("uuid")], "content", budget)
    parts = F.array_sort(F.collect_list(F.struct("_rn", "content")))
    return kept.groupBy("session_key").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "\n\n").alias("text"))
