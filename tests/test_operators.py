"""Budgets, the gate, recall, stores, streams and the command line against plain Python."""

import json
import random
import time
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memloom import cli
from memloom.config import DEFAULT
from memloom.operators import capture, continuity, episodes, memory_files, recall
from memloom.operators import messages as M
from memloom.sources import store
from memloom.streaming import capture as streamed
from memloom.streaming import gate as streamed_gate
from memloom.streaming import index as streamed_index
from memloom.streaming import log as streamed_log

NOW, MS = "2026-07-01T00:00:00.000Z", 1
MESSAGE = "session_key string, idx long, role string, content string"
EVENT = "session_key string, seq long, kind string, gap boolean, deictic boolean, nonempty boolean"


def _texts(rnd, n):
    return ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 400))) for _ in range(n)]


@pytest.mark.parametrize("run", [1000, 3, 1])
def test_budgets_equal_a_loop(spark, monkeypatch, run):
    monkeypatch.setattr(continuity, "RUN", run)
    monkeypatch.setattr(continuity, "PARTS", run)
    rnd, given = random.Random(1), {}
    for s in range(60):
        given[f"s{s}"] = _texts(rnd, rnd.randint(1, 12))
    given["long"] = _texts(rnd, 300)
    rows = spark.createDataFrame([(s, i, t) for s, ts in given.items() for i, t in enumerate(ts)], "s string, i int, t string").cache()
    suffix, prefix = {}, {}
    for r in continuity.budget_suffix(rows, ["s"], "i", "t", 700).collect():
        suffix.setdefault(r.s, {})[r.i] = r.t
    for r in continuity.budget_prefix(rows, ["s"], [F.asc("i")], "t", 700).collect():
        prefix.setdefault(r.s, {})[r.i] = r.t
    for s, ts in given.items():
        want, total = {}, 0
        for i in range(len(ts) - 1, -1, -1):
            total += len(ts[i])
            if want and total > 700:
                break
            want[i] = ts[i]
        assert suffix[s] == want
        want, total = {}, 0
        for i, t in enumerate(ts):
            cost = len(t) + (2 if i else 0)
            if total + cost > 700:
                room = 700 - total - (2 if i else 0)
                if room > 100:
                    want[i] = t[:room]
                break
            want[i] = t
            total += cost
        assert prefix.get(s, {}) == want


def _events(rnd, sessions):
    out = []
    for s in range(sessions):
        for q in range(rnd.randint(1, 12)):
            kind = rnd.choice(["assemble"] * 4 + ["bootstrap", "compact"])
            out.append((f"s{s}", q, kind, rnd.random() < 0.4, rnd.random() < 0.2, rnd.random() < 0.7))
    return out


def _gate(events):
    state, out = {}, {}
    for s, q, kind, gap, deictic, nonempty in events:
        pending, recalled = state.get(s, (False, False))
        if kind != "assemble":
            state[s] = (True, False)
            out[s, q] = (None, None)
            continue
        if (recalled and not pending and not deictic) or not (pending or gap or deictic):
            out[s, q] = (False, False)
            continue
        state[s] = (False, recalled or nonempty)
        out[s, q] = (True, nonempty)
    return out


def test_gate_equals_the_state_machine(spark):
    events = _events(random.Random(2), 300)
    rows = recall.gate(spark.createDataFrame(events, EVENT))
    assert {(r.session_key, r.seq): (r.fire, r.injected) for r in rows.collect()} == _gate(events)


def _gate_run(spark, path, events, idle_ms=None, want=0):
    """One run of the streamed gate over what has come since the last run: a restart from its checkpoint."""
    spark.createDataFrame(events, EVENT).coalesce(1).write.mode("append").parquet(str(path / "in"))
    query = streamed_gate.gate(spark.readStream.schema(EVENT).parquet(str(path / "in")), idle_ms).writeStream.format("parquet")
    query = query.option("path", str(path / "out")).option("checkpointLocation", str(path / "check"))
    if idle_ms:  # runs until stopped
        query = query.trigger(processingTime="200 milliseconds").start()
        try:
            deadline = time.monotonic() + 60
            while not spark.read.schema(streamed_gate.OUT).parquet(str(path / "out")).count() >= want and time.monotonic() < deadline:
                time.sleep(0.3)
        finally:
            query.stop()
    else:
        query.trigger(availableNow=True).start().awaitTermination()
    return {(r.session_key, r.seq): (r.fire, r.injected) for r in spark.read.schema(streamed_gate.OUT).parquet(str(path / "out")).collect()}


def test_streamed_gate_equals_batch_across_restarts(spark, tmp_path):
    events = _events(random.Random(3), 40)
    for part in range(3):  # three runs: thirds of each session
        got = _gate_run(spark, tmp_path, [e for e in events if min(e[1] // 4, 2) == part])
    assert got == _gate(events)


def test_streamed_gate_forgets_idle_sessions(spark, tmp_path):
    """The second call is in a gap again: it fires only if the first one is forgotten."""
    call = ("s", 0, "assemble", True, False, True)
    kept, gone = tmp_path / "kept", tmp_path / "gone"
    for path, idle_ms in ((kept, 3_600_000), (gone, 2000)):
        (path / "out").mkdir(parents=True)
        assert _gate_run(spark, path, [call], idle_ms, 1)["s", 0] == (True, True)
    time.sleep(3)
    assert _gate_run(spark, kept, [("s", 1, *call[2:])], 3_600_000, 2)["s", 1] == (False, False)
    assert _gate_run(spark, gone, [("s", 1, *call[2:])], 2000, 2)["s", 1] == (True, True)


HOOKS = "event string, session_key string, idx long, role string, content string, before long"


def test_streamed_capture_equals_batch(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for s in range(12):
        event = rnd.choice([*streamed.CAPTURES, "after_turn"])
        rows += [(event, f"s{s}", i, rnd.choice(["user", "assistant", "system"]), "text number " + "x" * rnd.randint(1, 60), 1) for i in range(6)]
    given = spark.createDataFrame(rows, HOOKS)
    given.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(HOOKS).parquet(str(tmp_path / "in"))
    streamed.capture_stream(source(), str(tmp_path / "episodes"), str(tmp_path / "check"), now=NOW).awaitTermination()
    got = store.read(spark, str(tmp_path / "episodes"), store.EPISODE)
    want = store.as_episodes(streamed.captured(given, NOW, int(datetime.fromisoformat(NOW).timestamp() * 1000)))
    columns = ["uuid", "name", "content", "source_description", "group_id"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect())) != []
    # The same batch again, as after a lost checkpoint, changes nothing.
    before = got.count()
    streamed.capture_stream(source(), str(tmp_path / "episodes"), str(tmp_path / "other"), now=NOW).awaitTermination()
    assert store.read(spark, str(tmp_path / "episodes"), store.EPISODE).count() == before
    # A stream and direct appends share a store, and deletion keeps both readable.
    more = spark.createDataFrame([("own", 0, "user", "a text that is long enough")], MESSAGE)
    store.append_episodes(capture.compact(more, NOW, MS), str(tmp_path / "episodes"))
    assert store.read(spark, str(tmp_path / "episodes"), store.EPISODE).count() == before + 1
    gone = store.read(spark, str(tmp_path / "episodes"), store.EPISODE).where("content like '%long enough%'").select("uuid")
    store.delete_episodes(spark, str(tmp_path / "episodes"), spark.createDataFrame(gone.collect(), "uuid string"))
    assert store.read(spark, str(tmp_path / "episodes"), store.EPISODE).count() == before


def test_turns(spark):
    rows = spark.createDataFrame([(s, i, "user", f"message number {i:010d}") for s in ("all", "none", "some", "sweep") for i in range(4)], MESSAGE)
    counts = spark.createDataFrame([("none", None), ("some", 2), ("sweep", 10)], "session_key string, before long")
    got = {}
    for r in M.new_of_turn(rows, counts).collect():
        got.setdefault(r.session_key, []).append((r.idx, r.sweep))
    assert {s: sorted(x) for s, x in got.items()} == {"all": [(i, False) for i in range(4)], "none": [(i, False) for i in range(4)], "some": [(2, False), (3, False)], "sweep": [(i, True) for i in range(4)]}


def test_capture_gates(spark):
    rows = spark.createDataFrame([("a", i, "user", "x" * 30) for i in range(3)] + [("b", i, "user", "y" * 30) for i in range(4)] + [("c", i, "user", "short") for i in range(9)], MESSAGE)
    assert [r.session_key for r in capture.before_compaction(rows, NOW, MS).collect()] == ["b"]
    assert {r.session_key for r in capture.compact(rows, NOW, MS).collect()} == {"a", "b"}
    off = DEFAULT.__class__(auto_capture=False)
    assert capture.single(rows, NOW, MS, off).count() == capture.batch(rows, NOW, MS, off).count() == 0 < capture.compact(rows, NOW, MS, off).count()
    flagged = rows.withColumn("is_heartbeat", F.col("session_key") == "a")
    assert {r.session_key for r in capture.batch(flagged, NOW, MS).collect()} == {"b"}


def test_assemble_falls_back(spark):
    messages = spark.createDataFrame([("a", 0, "user", "tell me about whales"), ("b", 0, "user", "tell me about tigers"), ("c", 0, "user", "nothing known of it")], MESSAGE)
    facts = spark.createDataFrame([("f1", "LIKES", "whales are large"), ("f2", "LIKES", "tigers are striped"), ("f3", "OLD", "bears sleep")], "uuid string, name string, fact string").withColumn("group_id", F.lit("core"))
    facts = facts.union(spark.createDataFrame([("o1", "THEIRS", "whales tigers bears of another tenant", "other")], facts.schema))
    on = replace(DEFAULT, auto_recall=True)
    tails = spark.createDataFrame([("a", "User: bears")], "session_key string, text string")
    stored = spark.createDataFrame([("e", "earlier on tigers", '{"session_key":"z"}', "2026")], "uuid string, content string, source_description string, created_at string").withColumn("group_id", F.lit("core"))
    assert recall.assemble(messages, facts, tails=tails, stored=stored).count() == 0
    got = {r.session_key: (r.continuity, r.facts) for r in recall.assemble(messages, facts, on, tails=tails, stored=stored).collect()}
    assert "bears sleep" in got["a"][1] and "User: bears" in got["a"][0]
    assert got["b"][0] is None and "tigers are striped" in got["b"][1] and "c" not in got
    known = stored.withColumn("source_description", F.lit('{"session_key":"c"}'))
    got = {r.session_key: (r.continuity, r.facts) for r in recall.assemble(messages, facts, on, tails=tails, stored=known).collect()}
    assert "earlier on tigers" in got["c"][0] and "tigers are striped" in got["c"][1]
    tasks = spark.createDataFrame([(1, "whales"), (2, ""), (3, "HEARTBEAT whales are here")], "query_id long, query string")
    assert {r.query_id for r in recall.spawn_context(tasks, facts).collect()} == {1, 3}
    assert recall.hook_recall(tasks, facts).count() == 0
    asked = tasks.union(spark.createDataFrame([(4, "where do whales live")], tasks.schema))
    assert {r.query_id for r in recall.hook_recall(asked, facts, on).collect()} == {4}
    # The newest 20 episodes of the own group only.
    newer = spark.createDataFrame([(f"n{i}", "x", '{"session_key":"z"}', "2027", "core") for i in range(20)], known.schema)
    foreign = known.withColumn("group_id", F.lit("other")).withColumn("content", F.lit("foreign"))
    for more, found in ((newer, False), (foreign, True)):
        got = {r.session_key: r.continuity for r in recall.assemble(messages, facts, on, tails=tails, stored=known.union(more)).collect()}
        assert ("c" in got and "earlier on tigers" in got["c"]) == found and "foreign" not in str(got)
    found = {r.uuid for r in recall.memory_search(messages, facts).collect()}
    assert found == {"f1", "f2"}
    assert {r.uuid for r in recall.found_facts(asked, facts, 5, ("core", "other")).collect()} == {"f1", "f2", "o1"}
    for limit in (0, 51):
        with pytest.raises(ValueError):
            recall.search_tool(asked, facts, limit)
    assert [r.bootstrapped for r in recall.bootstrap(tails, stored, healthy=False).collect()] == [False]


def _walk(raw, budget, tail_bytes):
    """The newest messages of a transcript's end, from the last line back."""
    out, total = [], 0
    for line in reversed(raw[-tail_bytes:].decode(errors="replace").split("\n")):
        try:
            record = json.loads(line)
        except ValueError:
            continue
        message = record.get("message") if isinstance(record, dict) and record.get("type") == "message" else None
        if not message or message.get("role") not in ("user", "assistant"):
            continue
        content = message.get("content")
        if isinstance(content, list):
            content = "\n".join(b["text"] for b in content if b.get("type") == "text" and len(b.get("text") or "") > 1)
        if not content or not isinstance(content, str):
            continue
        text = f"{'User' if message['role'] == 'user' else 'Assistant'}: {content}"
        if out and total + len(text) > budget:
            break
        out.insert(0, text)
        total += len(text)
    return "\n".join(out) or None


def test_transcript_tail_is_bounded_and_equals_a_walk(spark, tmp_path):
    rnd = random.Random(12)
    for f in range(12):
        lines = []
        for i in range(rnd.choice([0, 1, 5, 200])):
            content = rnd.choice(["", "x", "wörter " * rnd.randint(1, 80), [{"type": "text", "text": "block é"}, {"type": "image"}, {"type": "text", "text": "t"}], None, 7])
            lines.append(rnd.choice(["{broken", "", "null", "[1]", json.dumps({"type": "session"}), *[json.dumps({"type": "message", "message": {"role": rnd.choice(["user", "assistant", "tool"]), "content": content}}, ensure_ascii=False)] * 5]))
        (tmp_path / f"a session #{f}.v1.jsonl").write_text("\n".join(lines) + rnd.choice(["", "\n"]))
    for budget, tail in ((8000, 128 << 10), (300, 2000), (5, 777)):
        want = {p.name.removesuffix(".jsonl"): _walk(p.read_bytes(), budget, tail) for p in tmp_path.glob("*.jsonl")}
        got = {r.session_key: r.text for r in store.transcript_tail(spark, str(tmp_path), budget, tail).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}
    for size in (10**5, 10**6, 10**7):  # what is read stays the same while the file grows
        (tmp_path / "a session #0.v1.jsonl").write_bytes(b'{"type": "custom"}\n' * (size // 19))
        assert store.file_ends(spark, str(tmp_path / "a session*0.v1.jsonl"), 50_000).agg(F.max("read")).first()[0] == 50_000


def test_transcript(spark, tmp_path):
    lines = [{"type": "session", "id": "x"}, {"type": "message", "message": {"role": "user", "content": "first"}}, {"type": "custom", "data": {}}, {"type": "message", "message": {"role": "system", "content": "no"}}, {"type": "message", "message": {"role": "assistant", "content": [{"type": "text", "text": "second"}, {"type": "image"}]}}]
    (tmp_path / "s1.jsonl").write_text("\n".join(map(json.dumps, lines[:3])) + "\n{broken\n" + "\n".join(map(json.dumps, lines[3:])) + "\n")
    got = {r.session_key: r.text for r in store.transcript_tail(spark, str(tmp_path)).collect()}
    assert got == {"s1": "User: first\nAssistant: second"}
    assert store.transcript_tail(spark, str(tmp_path), 5).first().text == "Assistant: second"
    many = [{"type": "message", "message": {"role": "user", "content": f"{i} " + "x" * (i % 50)}} for i in range(3000)]
    (tmp_path / "long.jsonl").write_text("\n".join(map(json.dumps, many)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        rows = store.transcript(spark, str(tmp_path / "long.jsonl"))
        assert rows.rdd.getNumPartitions() > 0 and [r.content.split()[0] for r in rows.orderBy("idx").collect()] == [str(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_memory_folder_paths_and_times(spark, tmp_path):
    import os

    for place in ("memory", "memory/deep/memory"):
        (tmp_path / place).mkdir(parents=True, exist_ok=True)
        (tmp_path / place / "x.md").write_text(place)
        os.utime(tmp_path / place / "x.md", (0, 0))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = sorted((r.path, r.last_modified, r.excerpt) for r in store.memory_folder(spark, str(tmp_path / "memory")).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("memory/deep/memory/x.md", "1970-01-01T00:00:00.000Z", "memory/deep/memory"), ("memory/x.md", "1970-01-01T00:00:00.000Z", "memory")]


def test_auto_index_off(spark):
    calls = spark.createDataFrame([("Write", {"path": "memory/a.md"}, None)], "tool string, params map<string,string>, error string")
    files = spark.createDataFrame([("memory/a.md", "1", 1, "x")], "path string, last_modified string, size long, excerpt string")
    state = spark.createDataFrame([], store.STATE)
    assert memory_files.auto_index(calls, files, state).first().status == "indexed"
    assert memory_files.auto_index(calls, files, state, replace(DEFAULT, auto_index=False)).count() == 0


def test_delete_and_batches_touch_only_their_folders(spark, tmp_path):
    path, at = str(tmp_path / "episodes"), {}
    rows = spark.createDataFrame([(f"s{i}", 0, "user", f"text number {i} that is long enough") for i in range(6)], MESSAGE)
    for day in ("2026-01-01", "2026-01-02", "2026-01-03"):
        stamp = f"{day}T00:00:00.000Z"
        store.write_batch(capture.compact(rows, stamp, MS), path, f"q-{day}")
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "episodes").rglob("*.parquet")}
    at, stored = files(), store.read(spark, path, store.EPISODE)
    one = stored.where("created_at like '2026-01-02%' and name like '%s3%'").select("uuid").collect()
    assert len(one) == 1 and store.delete_episodes(spark, path, spark.createDataFrame(one, "uuid string")) == 1
    now = files()
    assert {f: t for f, t in now.items() if "2026-01-02" not in str(f)} == {f: t for f, t in at.items() if "2026-01-02" not in str(f)}
    assert store.read(spark, path, store.EPISODE).count() == 17
    every = store.read(spark, path, store.EPISODE).where("created_at like '2026-01-03%'").select("uuid").collect()
    assert store.delete_episodes(spark, path, spark.createDataFrame(every, "uuid string")) == 1  # a whole folder goes
    assert store.delete_episodes(spark, path, spark.createDataFrame(every, "uuid string")) == 0
    assert store.read(spark, path, store.EPISODE).count() == 11
    # A batch of another day isn't disturbed by files it needn't read.
    broken = next((tmp_path / "episodes").glob("group_id=*/day=2026-01-01/*/*.parquet"))
    whole = broken.read_bytes()
    broken.write_bytes(b"no parquet")
    store.write_batch(capture.compact(rows, "2026-01-04T00:00:00.000Z", MS), path, "q-4")
    broken.write_bytes(whole)
    for checksum in broken.parent.glob(".*.crc"):
        checksum.unlink()
    assert store.read(spark, path, store.EPISODE).count() == 17


def test_index_runs_once(spark, tmp_path):
    notes = tmp_path / "memory"
    (notes / "deep").mkdir(parents=True)
    (notes / "a.md").write_text("alpha")
    (notes / "deep" / "b.txt").write_text("beta")
    (notes / "c.png").write_text("no")
    (notes / "big.md").write_text("x" * (DEFAULT.file_max_bytes + 1))
    root = str(tmp_path / "root")
    assert cli.main(["--root", root, "index", str(notes), "--dry-run"], spark) == {"new": 3, "filtered": 1}
    assert cli.main(["--root", root, "index", str(notes)], spark) == {"indexed": 2, "unreadable": 1, "filtered": 1}
    assert cli.main(["--root", root, "index", str(notes)], spark) == {"unchanged": 2, "unreadable": 1, "filtered": 1}
    rows = store.read(spark, f"{root}/episodes", store.EPISODE).collect()
    assert {r.name for r in rows} == {"memory-index::memory/a.md", "memory-index::memory/deep/b.txt"}


def test_index_stream_takes_changed_files_again(spark, tmp_path):
    notes, root = tmp_path / "my notes", str(tmp_path / "root")
    (notes / "deep").mkdir(parents=True)

    def run():
        streamed_index.index_stream(spark, str(notes), root, str(tmp_path / "check")).awaitTermination()
        stored = store.read(spark, f"{root}/episodes", store.EPISODE).select("name", "content").collect()
        return sorted((r.name.removeprefix("memory-index::memory/"), r.content.rsplit("---\n", 1)[1]) for r in stored)

    (notes / "a b.md").write_text("alpha")
    (notes / "deep" / "same.md").write_text("stays")
    (notes / "c.png").write_text("no")
    (notes / "big.md").write_text("x" * (DEFAULT.file_max_bytes + 1))
    first = [("a b.md", "alpha"), ("deep/same.md", "stays")]
    assert run() == first
    assert run() == first  # nothing has changed
    time.sleep(0.05)
    (notes / "a b.md").write_text("alpha, changed")
    (notes / "new.txt").write_text("n" * 3000)
    assert run() == sorted([*first, ("a b.md", "alpha, changed"), ("new.txt", "n" * DEFAULT.excerpt_chars)])
    state = {r.path for r in store.current(spark, f"{root}/state", store.STATE).collect()}
    assert state == {"memory/a b.md", "memory/deep/same.md", "memory/new.txt"}


def test_log_keeps_the_order_of_arrival(spark, tmp_path):
    path = str(tmp_path / "log")
    assert store.tail_log(spark, path).collect() == []
    want = [f"{NOW} [memloom] event n={n}" for n in (5, 3, 9, 1)]  # one time stamp, texts in no order
    for line in want[:2]:
        store.append_log(spark.createDataFrame([(line,)], "line string"), path)
    store.append_log(spark.createDataFrame([(1, want[3]), (0, want[2])], "nth int, line string"), path)
    assert [r.line for r in store.tail_log(spark, path).collect()] == want
    assert [r.line for r in store.tail_log(spark, path, 3).collect()] == want[1:]
    store.clear_log(spark, path)
    assert store.tail_log(spark, path).collect() == []


def test_streams_log_their_progress(spark, tmp_path):
    listener = streamed_log.LogListener(spark, str(tmp_path / "log"))
    spark.streams.addListener(listener)
    try:
        _gate_run(spark, tmp_path, _events(random.Random(5), 3))
        deadline = time.monotonic() + 40
        while time.monotonic() < deadline and len(store._appends(spark, str(tmp_path / "log"))) < 3:
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    lines = [r.line for r in store.tail_log(spark, str(tmp_path / "log")).collect()]
    assert [line.split("[memloom] ")[1].split()[0] for line in lines] == ["start", "batch", "end"] and "rows=" in lines[1]


def test_command_line(spark, tmp_path):
    root = str(tmp_path)
    assert cli.main(["--root", root, "status"], spark) == [] == cli.main(["--root", root, "logs"], spark)
    (tmp_path / "note.md").write_text("n\n" * 6_500)
    cli.main(["--root", root, "ingest", str(tmp_path / "note.md")], spark)
    cli.main(["--root", root, "ingest", "--content", "c" * 13_000], spark)
    stored = store.read(spark, f"{root}/episodes", store.EPISODE).collect()
    assert sorted(len(r.content) for r in stored) == [12_000, 13_000]
    assert [r.name == "note.md" or r.name.startswith("cli-") for r in stored] == [True, True]
    assert len(cli.main(["--root", root, "episodes", "--json"], spark)) == 2
    assert cli.main(["--root", root, "episodes", "--session", "cli"], spark) == []  # texts and files of the command line belong to no session
    assert len(cli.main(["--root", root, "logs"], spark)) == 2 and cli.main(["--root", root, "logs", "--clear"], spark) == []
    assert cli.main(["--root", root, "delete", "nope"], spark) is False
    assert cli.main(["--root", root, "delete", stored[0].uuid, "--type", "episode"], spark) is True
    assert [r.uuid for r in store.read(spark, f"{root}/episodes", store.EPISODE).collect()] == [stored[1].uuid]
    ids = ["0123abcd-0000-4000-8000-00000000000" + c for c in "12"]
    store.replace(spark.createDataFrame([(i, "N", f"fact {k} whales", None, None, NOW, None, "core") for k, i in enumerate(ids)], store.FACT), f"{root}/facts")
    assert len(cli.main(["--root", root, "search", "whales"], spark)) == 2
    cli.main(["--root", root, "delete", ids[0]], spark)
    assert cli.main(["--root", root, "search", "whales"], spark) == ["• **N**: fact 1 whales [ongoing]"]


def test_ingested_files_keep_their_names(spark, tmp_path):
    for name, text in (("a b#1.md", b"one"), ("\u00e9#.md", b"two"), ("%20.md", b"odd \xff byte")):
        (tmp_path / name).write_bytes(text)
    rows = {r.path.rsplit("/", 1)[1]: r.content for r in store.whole_files(spark, str(tmp_path / "*.md")).collect()}
    assert rows == {"a b#1.md": "one", "\u00e9#.md": "two", "%20.md": "odd \ufffd byte"}
    made = capture.cli_ingest(store.whole_files(spark, str(tmp_path / "a b*.md")), NOW, MS).first()
    assert made.name == "a b#1.md" and json.loads(made.source_description)["file"] == "a b#1.md"


def test_start_as_of_a_capture_between_two_starts(spark):
    starts = spark.createDataFrame([("s", "2026-01-01T08:00:00.000Z"), ("s", "2026-01-03T08:00:00.000Z"), ("s", "2026-01-03T08:00:00.000Z"), ("t", "2026-01-02T00:00:00.000Z"), (None, "2026-01-01T00:00:00.000Z"), ("s", None)], "session_key string, session_start string")
    captures = [("s", "2026-01-01T07:59:59.000Z", None), ("s", "2026-01-01T08:00:00.000Z", "2026-01-01T08:00:00.000Z"), ("s", "2026-01-02T23:00:00.000Z", "2026-01-01T08:00:00.000Z"), ("s", "2026-01-03T09:00:00.000Z", "2026-01-03T08:00:00.000Z"), ("t", "2026-01-01T00:00:00.000Z", None), ("u", "2026-01-05T00:00:00.000Z", None), (None, "2026-01-05T00:00:00.000Z", None), ("s", None, None), ("s", "2026-09-09T00:00:00.000Z", "2026-01-03T08:00:00.000Z")]
    got = capture.start_as_of(spark.createDataFrame(captures, "session_key string, captured_at string, want string"), starts)
    assert got.count() == len(captures) and got.where("not (want <=> session_start)").count() == 0


def test_stored_twice_has_one_uuid(spark):
    rows = spark.createDataFrame([("s", 0, "user", "a text that is long enough")], MESSAGE)
    a, b = (store.as_episodes(capture.compact(rows, NOW, MS)).first().uuid for _ in range(2))
    assert a == b
    assert episodes.delete(store.as_episodes(capture.compact(rows, NOW, MS)), spark.createDataFrame([(a,)], "uuid string")).count() == 0


def test_next_state_replaces(spark):
    files = spark.createDataFrame([("a.md", "2", 1, "x"), ("b.md", "1", 1, "x")], "path string, last_modified string, size long, excerpt string")
    state = spark.createDataFrame([("a.md", "1", "0"), ("b.md", "1", "0"), ("gone.md", "1", "0")], store.STATE)
    got = {tuple(r) for r in memory_files.next_state(memory_files.classify(files, state), state, NOW).collect()}
    assert got == {("a.md", "2", NOW), ("b.md", "1", "0"), ("gone.md", "1", "0")}


def test_facts_hold_the_whole_text(spark, sf_dir):
    from memloom.plans import relations

    texts = {f"fact-{r.conv_id}-{r.turn}": r.text for r in relations.table(spark, sf_dir, "conversations").collect()}
    got = {r.uuid: r.fact for r in relations.facts(spark, sf_dir).collect()}
    assert got == texts and max(map(len, texts.values())) > 200


def test_joined_head_equals_cut_of_the_whole(spark):
    draw = random.Random(3)
    rows = [(s, i, b, "x" * draw.randint(1, 9) + str(i)) for s, n in (("hot", 400), ("small", 2), ("one", 1)) for i in range(n) for b in range(draw.randint(1, 2))]
    texts = spark.createDataFrame(rows, "session_key string, idx long, block int, text string").repartition(5).cache()
    for cap, step in ((1, 3), (37, 1), (200, 7), (1000, 1000), (100_000, 10)):
        want = {r["session_key"]: r["text"][:cap] for r in M.joined(texts).collect()}
        assert {r["session_key"]: r["text"] for r in M.joined_head(texts, cap, step=step).collect()} == want
    assert M.joined_head(texts.limit(0), 10).count() == 0
