"""Text, JSON and predicate functions on fixed vectors."""

import pytest
from pyspark.sql import functions as F

from memloom.config import DEFAULT
from memloom.functions import provenance
from memloom.functions import text as T
from memloom.operators import memory_files


def _apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


CTX, CONT, MEM = DEFAULT.context_tag, DEFAULT.continuity_tag, DEFAULT.memories_tag
CLEAN = [
    (f"a <{CTX}>x\ny</{CTX}> b", "a  b"),
    (f"<{CONT}>x</{CONT}>hello", "hello"),
    (f"<{MEM}>1</{MEM}>mid<{MEM}>2</{MEM}>", "mid"),
    (f"<{CTX}>never closed", f"<{CTX}>never closed"),
    ('```json\n{"schema": "inbound_meta.v2", "a": 1}\n```\nhi', "hi"),
    ('```json\n{"label": "x", "sender": "y"}\n```\nhi', "hi"),
    ('```json\n{"sender": "y", "label": "x"}\n```\nhi', "hi"),
    ('```json\n{"other": 1}\n```\nhi', '```json\n{"other": 1}\n```\nhi'),
    ('```json\n{"other": 1}\n```\nthe "label" and the "sender"', 'the "label" and the "sender"'),
    ("one\n[Subagent Context] depth 2\ntwo", "one\n\ntwo"),
    ("say [Subagent Context] inside", "say [Subagent Context] inside"),
    ("[Mon 2026-03-15 14:00 UTC] go", "go"),
    ("x\n[Tue 2026-03-15 14:00 CEST]\tgo", "x\ngo"),
    ("[Mon 2026-03-15 14:00 ZONEABC] go", "[Mon 2026-03-15 14:00 ZONEABC] go"),
    ("a\x00b", "ab"),
    ("a\n\n\n\n\nb\n\nc", "a\n\nb\n\nc"),
    ("\n\t   ﻿x  \n", "x"),
    ("clean text", "clean text"),
    ("", ""),
    (None, None),
]


def test_sanitize(spark):
    assert _apply(spark, T.sanitize, [x for x, _ in CLEAN]) == [y for _, y in CLEAN]


def test_deictic(spark):
    yes = ["as I mentioned before", "What we were discussing", "please CONTINUE", "that bug again", "like we said", "remember when it broke", "back to the plan", "where we left off"]
    no = ["hello there", "discontinued", "écontinued", "that dog", "", None]
    assert _apply(spark, T.has_deictic, yes + no) == [True] * len(yes) + [False] * len(no)
    assert _apply(spark, T.has_deictic, ["écontinue"]) == [True]  # word bounds are ASCII ones


def test_gap(spark):
    rows = spark.createDataFrame([(0, None), (3, None), (4, None), (10, None), (100, "bootstrap"), (100, "compact"), (100, "other")], "n int, e string")
    assert [r[0] for r in rows.select(T.is_gap(F.col("n"), F.col("e"))).collect()] == [True, True, False, False, True, True, False]
    assert [r[0] for r in rows.where("e is null").select(T.is_gap(F.col("n"), threshold=5)).collect()] == [True, True, True, False]


def test_prompt_passes(spark):
    assert _apply(spark, T.prompt_passes, ["short", "long enough prompt", "a HEARTBEAT prompt", "run the boot check now", "heartbeat in lower case", None]) == [False, True, False, False, True, False]


def test_paths(spark):
    assert _apply(spark, T.file_extension, ["a/b.MD", "a/.hidden", "a.b/c", "x.tar.gz", "plain", "dot."]) == [".md", "", "", ".gz", "", "."]
    assert _apply(spark, T.is_indexable, ["a.md", "a.TXT", "a.json", "noext", ".md"]) == [True, True, False, False, False]
    assert _apply(spark, lambda c: T.is_indexable(c, ("rst", ".MD")), ["a.rst", "a.md", "a.txt"]) == [True, True, False]
    assert _apply(spark, T.basename, ["/a/b/c.md", "c.md", "a/b/"]) == ["c.md", "c.md", "b"]


def test_memory_path(spark):
    calls = [
        ("Write", {"file_path": "/w/memory/a.md"}, "memory/a.md"),
        ("edit", {"path": "memory/x/y.md"}, "memory/x/y.md"),
        ("write_file", {"file_path": "/notes/a.md", "path": "/q/memory/b.md"}, "memory/b.md"),
        ("Write", {"file_path": "/a/memory/b/memory/c.md"}, "memory/b/memory/c.md"),
        ("read", {"file_path": "/w/memory/a.md"}, None),
        ("Write", {"file_path": None}, None),
        ("Write", {"content": "/w/memory/a.md"}, None),
    ]
    rows = spark.createDataFrame([(i, t, p) for i, (t, p, _) in enumerate(calls)], "i int, tool string, params map<string,string>")
    assert [r[0] for r in rows.orderBy("i").select(T.memory_path(F.col("tool"), F.col("params"))).collect()] == [want for *_, want in calls]


def test_uuid(spark):
    assert _apply(spark, T.is_uuid, ["0123abcd-0000-4000-8000-0123456789AB", "fact-001", "0123abcd-0000-4000-8000-0123456789AB\n", "", None]) == [True, False, False, False, False]


def test_time_ago(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    ago = lambda c: T.time_ago(F.to_timestamp(c), now)
    given = ["2026-01-02 00:00:01", "2026-01-01 23:59:01", "2026-01-01 23:58:59", "2026-01-01 22:30:00", "2025-12-25 12:00:00", None]
    assert _apply(spark, ago, given) == ["just now", "just now", "1m ago", "1h ago", "7d ago", ""]


def test_log_line(spark):
    line = lambda event, **kv: spark.range(1).select(T.log_line(F.lit("ts"), F.lit(event), [(k, F.lit(v)) for k, v in kv.items()])).first()[0]
    assert line("search", q="a b", n=3, none=None, ok=True) == 'ts [memloom] search       q="a b" n=3 ok=true'
    assert line("a_very_long_event", x='say "hi"\n', y="back\\slash") == 'ts [memloom] a_very_long_event x="say \\"hi\\"\\n" y=back\\\\slash'


def test_small_texts(spark):
    assert _apply(spark, lambda c: T.preview(c, 3), ["abc", "abcd"]) == ["abc", "abc..."]
    assert _apply(spark, T.tokens_estimate, ["", "a", "abcd", "abcde"]) == [0, 1, 1, 2]
    block = T.context_block(F.concat_ws("\n", T.fact_line(F.lit("N"), F.lit("f")), T.fact_line(F.lit("M"), F.lit("g"))))
    assert _apply(spark, lambda c: T.count_facts(block), ["x"]) == [2]
    assert _apply(spark, lambda c: T.episode_name("turn", c, F.lit(5)), ["s", "", None]) == ["turn-s-5", "turn-5", "turn-5"]


def test_extract_content(spark):
    kind = "i int, content string, blocks array<struct<type string, text string>>"
    rows = spark.createDataFrame([(0, "x" * 20, None), (1, "x" * 21, None), (2, None, [("text", "y" * 21), ("image", "z" * 30), ("text", "short"), ("text", "w" * 22)]), (3, None, [("text", "short")]), (4, None, None)], kind)
    got = [r[0] for r in rows.orderBy("i").select(T.extract_content(F.col("content"), F.col("blocks"))).collect()]
    assert got == [None, "x" * 21, "y" * 21 + "\n" + "w" * 22, None, None]


def test_provenance(spark):
    rows = spark.createDataFrame([("k", "", None)], "session_key string, thread_id string, agent string")
    made = rows.select(provenance.build("compact", F.lit("t"), session_key=F.col("session_key"), thread_id=F.col("thread_id"), agent=F.col("agent"))).first()[0]
    assert made == '{"plugin":"memloom","event":"compact","ts":"t","group_id":"core","session_key":"k"}'
    cases = [('{"session_key":"a"}', None, True), ('{"session_key":"b"}', "a", False), ("session=a old", None, True), (None, "turn-a-1", True), ("null", "turn-a-1", True), ("{broken", "x", False)]
    rows = spark.createDataFrame([(i, d, n) for i, (d, n, _) in enumerate(cases)], "i int, d string, n string")
    got = rows.orderBy("i").select(provenance.of_session(F.col("d"), F.col("n"), F.lit("a"))).collect()
    assert [r[0] for r in got] == [want for *_, want in cases]


@pytest.mark.parametrize(("n", "want"), [(3000, 500), (100, 100)])
def test_excerpt(spark, n, want):
    rows = spark.createDataFrame([(bytearray(b"a" * n),)], "content binary")
    assert len(rows.select(memory_files.excerpt(F.col("content"))).first()[0]) == want
    cut = spark.createDataFrame([(bytearray("é".encode() * 1024 + b"x"),), (bytearray(b"a" * 2047 + "é".encode()),)], "content binary")
    wide = [r[0] for r in cut.select(F.make_valid_utf8(F.substring("content", 1, 2048).cast("string"))).collect()]
    assert wide == ["é" * 1024, "a" * 2047 + "�"]


def test_trim_is_linear(spark):
    import time

    from pyspark.sql import functions as F

    from memloom.functions import text as T

    row = spark.range(1).select(T.trim(F.concat(F.lit(" \u3000a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b\ufeff\n"))).alias("t"))
    row.collect()
    began = time.perf_counter()
    text = row.first().t
    assert time.perf_counter() - began < 5 and len(text) == 1_000_002 and text[0] == "a" and text[-1] == "b"
