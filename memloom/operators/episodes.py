"""Episodes and facts: listings, filters, counts, deletion, validity in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.config import DEFAULT, Config
from memloom.functions import provenance
from memloom.functions import text as T



def in_groups(rows: DataFrame, groups: tuple[str, ...] = (DEFAULT.group,)) -> DataFrame:
    """Rows of the groups asked for; with group_id as partition column only their files are read."""
    return rows.where(F.col("group_id").isin(*groups))


def last(episodes: DataFrame, n: int = DEFAULT.list_limit, group: str = DEFAULT.group) -> DataFrame:
    """The n newest episodes of a group."""
    return in_groups(episodes, (group,)).orderBy(F.desc_nulls_last("created_at"), "uuid").limit(n)


def listed(episodes: DataFrame, session_key: str, limit: int = DEFAULT.list_limit, overfetch: bool = True, config: Config = DEFAULT) -> DataFrame:
    """A session's episodes among the newest: first a limit (widened with overfetch), then the filter, then the limit again."""
    if not 1 <= limit <= config.list_max:
        raise ValueError(f"limit must be 1 to {config.list_max}")
    fetched = last(episodes, min(limit * config.overfetch, config.overfetch_max) if overfetch else limit, config.group)
    found = fetched.where(provenance.of_session(F.col("source_description"), F.col("name"), F.lit(session_key)))
    return found.orderBy(F.desc_nulls_last("created_at"), "uuid").limit(limit)


def of_session(episodes: DataFrame, session_key: str, limit: int = DEFAULT.list_limit) -> DataFrame:
    """A session's newest episodes: filter first."""
    found = episodes.where(provenance.of_session(F.col("source_description"), F.col("name"), F.lit(session_key)))
    return found.orderBy(F.desc_nulls_last("created_at"), "uuid").limit(limit)


def stats(episodes: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(group_id, episodes, label, latest) for each group; the count stops at a ceiling."""
    n = F.least(F.count("*"), F.lit(config.count_ceiling))
    out = episodes.groupBy("group_id").agg(n.alias("episodes"), F.max("created_at").alias("latest"))
    return out.withColumn("label", F.concat(F.col("episodes").cast("string"), F.when(F.col("episodes") >= config.count_ceiling, "+").otherwise("")))


def tool_line(now: Column) -> Column:
    """An episode as the listing tool prints it, without its number."""
    d = F.col("source_description")
    part = lambda label, key: F.concat(F.lit(f"{label}="), F.nullif(provenance.field(d, key), F.lit("")))
    described = F.when(provenance.is_object(d), F.concat_ws(" ", part("event", "event"), part("session", "session_key"), part("file", "file"))).otherwise(F.coalesce(d, F.lit("")))
    name = F.when(F.coalesce("name", F.lit("")) != "", F.concat(F.lit("**"), "name", F.lit("**"))).otherwise("(unnamed)")
    content = F.left(F.coalesce("content", F.lit("")), F.lit(100))
    age = T.time_ago(F.try_to_timestamp("created_at"), now)
    return F.concat(F.lit("**uuid: "), "uuid", F.lit("** "), name, F.lit(" "), described, F.lit(" ("), age, F.lit(")"), F.when(content != "", F.concat(F.lit("\n   "), content)).otherwise(""))


def cli_line(now: Column) -> Column:
    """An episode as the command line prints it."""
    d = F.col("source_description")
    part = lambda label, key: F.concat(F.lit(f"{label}="), F.nullif(provenance.field(d, key), F.lit("")))
    parts = F.concat_ws(" ", F.concat(F.lit("["), F.coalesce(provenance.field(d, "event"), F.lit("undefined")), F.lit("]")), *[part(label, key) for label, key in (("source", "source"), ("file", "file"), ("session", "session_key"), ("agent", "agent"), ("channel", "channel"))])
    described = F.when(provenance.is_object(d), parts).otherwise(F.coalesce(d, F.lit("")))
    return F.concat(F.lit("• "), F.coalesce("name", "uuid"), F.lit("  "), described, F.lit("  "), T.time_ago(F.try_to_timestamp("created_at"), now))


def search_line() -> Column:
    """A fact as the search tool prints it, without its number."""
    return F.concat(F.lit("**"), "name", F.lit("**: "), "fact", F.lit(" ["), F.coalesce(F.nullif("valid_at", F.lit("")), F.lit("ongoing")), F.lit("]"))


def cli_search_line() -> Column:
    until = F.when(F.coalesce("invalid_at", F.lit("")) != "", F.concat(F.lit(" → "), "invalid_at")).otherwise("")
    return F.concat(F.lit("• **"), "name", F.lit("**: "), "fact", F.lit(" ["), F.coalesce(F.nullif("valid_at", F.lit("")), F.lit("ongoing")), until, F.lit("]"))


def candidate_line() -> Column:
    return F.concat(F.lit("["), "uuid", F.lit("] **"), "name", F.lit("**: "), "fact")


def numbered(rows: DataFrame, line: Column, order: list[Column], limit: int = DEFAULT.list_max) -> DataFrame:
    """(n, line): the first rows (at most limit, a listing's length) with their numbers in front."""
    first = rows.orderBy(*order).limit(limit)
    n = F.row_number().over(Window.orderBy(*order))  # over at most limit rows
    return first.select(n.alias("n"), F.concat(n.cast("string"), F.lit(". "), line).alias("line"))


def delete(rows: DataFrame, uuids: DataFrame) -> DataFrame:
    """rows without those whose uuid is in uuids (uuid)."""
    return rows.join(uuids.select("uuid").distinct(), "uuid", "left_anti")


def forget(requests: DataFrame, matches: DataFrame) -> DataFrame:
    """(request_id, deleted, reason, target) for requests (request_id, query, uuid, type).

    matches: (request_id, uuid), the search results (at most 10) of requests with a query.
    """
    found = matches.groupBy("request_id").agg(F.count("*").alias("n"), F.min("uuid").alias("match"))
    rows = requests.join(found, "request_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    kind = F.coalesce("type", F.lit("fact"))
    reason = (
        F.when(~has("query") & ~has("uuid"), "missing_params")
        .when(has("uuid") & ~T.is_uuid(F.col("uuid")), "invalid_uuid")
        .when(has("uuid"), F.lit(None))
        .when(kind == "episode", "episode_query_not_supported")
        .when(F.col("n") == 0, "no_matches")
        .when(F.col("n") > 1, "multiple_matches")
    )
    rows = rows.withColumn("reason", reason).withColumn("deleted", F.col("reason").isNull())
    return rows.select("request_id", "deleted", "reason", F.when(F.col("deleted"), F.coalesce(F.nullif("uuid", F.lit("")), "match")).alias("target"))


def intervals(events: DataFrame) -> DataFrame:
    """Facts from events (event_id, ts, user_id, event_type, value): valid until the next of the same user and type."""
    nxt = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return events.select(
        F.concat(F.lit("fact-"), F.col("event_id").cast("string")).alias("uuid"), F.upper("event_type").alias("name"),
        F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" did "), "event_type").alias("fact"),
        F.col("ts").alias("valid_from"), nxt.alias("valid_to"), F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("group_id"), "user_id", "event_type",
    )


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that are valid at a time."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
