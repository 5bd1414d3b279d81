"""Command line over the stores below one folder: episodes, facts, index state and log.

    python -m memloom.cli --root FOLDER search TEXT | episodes | status | ingest | index | delete | logs
"""

from __future__ import annotations

import argparse
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.config import DEFAULT
from memloom.functions import text as T
from memloom.operators import capture, episodes, memory_files, recall
from memloom.sources import store


def _show(rows: DataFrame, column: str, none: str) -> list[str]:
    """The lines of a listing, whose length the command's limit bounds."""
    lines = [r[0] for r in rows.select(column).collect()]
    print("\n".join(lines) if lines else none)
    return lines


def search(spark: SparkSession, root: str, text: str, limit: int) -> list[str]:
    asked = spark.createDataFrame([(0, text)], "query_id long, query string")
    facts = store.current(spark, f"{root}/facts", store.FACT)
    if not 1 <= limit <= DEFAULT.list_max:
        raise SystemExit(f"--limit must be 1 to {DEFAULT.list_max}")
    found = recall.found_facts(asked, facts, limit).select("uuid", "rank").join(facts, "uuid")
    return _show(found.orderBy("rank").select(episodes.cli_search_line().alias("line")), "line", "No facts found.")


def list_episodes(spark: SparkSession, root: str, session: str | None, limit: int, as_json: bool) -> list[str]:
    rows = store.read(spark, f"{root}/episodes", store.EPISODE)
    rows = episodes.listed(rows, session, limit, overfetch=False) if session else episodes.last(rows, limit)
    line = F.to_json(F.struct("*")) if as_json else episodes.cli_line(F.current_timestamp())
    return _show(rows.select(line.alias("line")), "line", "No episodes found.")


def status(spark: SparkSession, root: str) -> list[str]:
    rows = episodes.stats(store.read(spark, f"{root}/episodes", store.EPISODE))
    return _show(rows.select(F.concat_ws(" ", "group_id", F.concat(F.lit("episodes="), "label"), F.concat(F.lit("latest="), "latest")).alias("line")), "line", "No episodes.")


def ingest(spark: SparkSession, root: str, path: str | None, content: str | None, name: str | None, now: datetime) -> int:
    """A file's text, cut to an episode's length, or a text as it is."""
    stamp, ms = _stamp(now)
    rows = store.whole_files(spark, path) if path else spark.createDataFrame([(content,)], "content string")
    made = capture.cli_ingest(rows.withColumn("name", F.lit(name).cast("string")), stamp, ms)
    store.append_episodes(made, f"{root}/episodes")
    _log(spark, root, stamp, "ingest", "cli")
    if path and made.where("truncated").count():
        print(f"File content truncated to {DEFAULT.episode_cap:,} characters")
    for row in made.select("name", F.length("content").alias("n")).collect():  # the files that were named
        print(f'Ingested "{row["name"]}" ({row["n"]} chars)')
    return 0


def index(spark: SparkSession, root: str, folder: str, dry_run: bool, now: datetime) -> dict[str, int]:
    """Files below a folder that are new or have changed become episodes; the state follows once they are written."""
    stamp, _ = _stamp(now)
    state = store.current(spark, f"{root}/state", store.STATE)
    found = memory_files.classify(store.memory_folder(spark, folder), state, dry_run=dry_run)
    counts = {r["status"]: r["files"] for r in memory_files.counts(found).collect()}  # four rows at most
    if not dry_run:
        store.append_episodes(memory_files.episodes(found), f"{root}/episodes")
        store.replace(memory_files.next_state(found, state, stamp), f"{root}/state")
        _log(spark, root, stamp, "index", folder)
    print(" ".join(f"{k}={v}" for k, v in sorted(counts.items())))
    return counts


def delete(spark: SparkSession, root: str, uuid: str, kind: str) -> bool:
    """Deletes one fact or episode by its uuid."""
    if not spark.range(1).select(T.is_uuid(F.lit(uuid))).first()[0]:
        print("Not a uuid.")
        return False
    gone = spark.createDataFrame([(uuid,)], "uuid string")
    if kind == "fact":
        store.replace(episodes.delete(store.current(spark, f"{root}/facts", store.FACT), gone), f"{root}/facts")
    else:
        store.delete_episodes(spark, f"{root}/episodes", gone)
    print("Deleted.")
    return True


def logs(spark: SparkSession, root: str, n: int, clear: bool) -> list[str]:
    if clear:
        store.clear_log(spark, f"{root}/log")
        print("Log cleared.")
        return []
    return _show(store.tail_log(spark, f"{root}/log", n), "line", "(no log)")


def _stamp(now: datetime) -> tuple[str, int]:
    return now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z", int(now.timestamp() * 1000)


def _log(spark: SparkSession, root: str, stamp: str, event: str, source: str) -> None:
    line = T.log_line(F.lit(stamp), F.lit(event), [("source", F.lit(source))])
    store.append_log(spark.range(1).select(line.alias("line")), f"{root}/log")


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    parser = argparse.ArgumentParser(prog="memloom", description=__doc__)
    parser.add_argument("--root", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("search")
    p.add_argument("text")
    p.add_argument("--limit", type=int, default=DEFAULT.recall_max_facts)
    p = sub.add_parser("episodes")
    p.add_argument("--session")
    p.add_argument("--limit", type=int, default=DEFAULT.list_limit)
    p.add_argument("--json", action="store_true")
    sub.add_parser("status")
    p = sub.add_parser("ingest")
    p.add_argument("path", nargs="?")
    p.add_argument("--content")
    p.add_argument("--name")
    p = sub.add_parser("index")
    p.add_argument("folder")
    p.add_argument("--dry-run", action="store_true")
    p = sub.add_parser("delete")
    p.add_argument("uuid")
    p.add_argument("--type", choices=("fact", "episode"), default="fact")
    p = sub.add_parser("logs")
    p.add_argument("--tail", type=int, default=100)
    p.add_argument("--clear", action="store_true")
    a = parser.parse_args(args)
    if a.command == "ingest" and not (a.path or a.content):
        parser.error("a file or --content is needed")
    spark = spark or SparkSession.builder.appName("memloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = datetime.now(UTC)
    run = {
        "search": lambda: search(spark, a.root, a.text, a.limit),
        "episodes": lambda: list_episodes(spark, a.root, a.session, a.limit, a.json),
        "status": lambda: status(spark, a.root),
        "ingest": lambda: ingest(spark, a.root, a.path, a.content, a.name, now),
        "index": lambda: index(spark, a.root, a.folder, a.dry_run, now),
        "delete": lambda: delete(spark, a.root, a.uuid, a.type),
        "logs": lambda: logs(spark, a.root, a.tail, a.clear),
    }
    return run[a.command]()


if __name__ == "__main__":
    main()
