"""The sanitizer in linear time, and in pieces of a session, against the plain regexes on the joined text."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import capture, pieces
from tests.test_blocked import _plan

WS = "[" + re.escape(T.SPACES) + "]"
TOKENS = [
    "<memory-context>", "</memory-context>", "<memory-continuity>", "</memory-continuity>", "<relevant-memories>", "</relevant-memories>", "<memory-con", "tinuity>",
    "```json", "```", "`", "\n", "{", '"', "schema", ":", '"inbound_meta', '"label"', '"sender"', "```json\n{", '```json \n\n {"schema": "inbound_meta.v1', '"label" "sender"',
    "[Subagent Context]", "[Mon 2026-03-15 14:00 UTC]", "[Mon", "2026-03-15 14:00 UTC] ", "x", " ", " ", "\0", "text", "\n\n\n", "\r", " ",
]
LONG = " and then follow plain words that are long enough to stand in a piece of their own, without any mark, to the End."


def plain(t):
    """The steps one after the other, each as one replacement."""
    for tag in ("memory-context", "memory-continuity", "relevant-memories"):
        t = re.sub(rf"(?s)<{tag}>.*?</{tag}>", "", t)
    t = re.sub(rf'(?s)```json{WS}*\n{WS}*\{{(?:"|{WS})*schema(?:"|{WS})*:{WS}*"inbound_meta.*?```', "", t)
    t = re.sub(rf'(?s)```json{WS}*\n{WS}*\{{(?=.*?"label")(?=.*?"sender").*?```', "", t)
    start = "(?:(?<=[\n\r  ])|\\A)"
    t = re.sub(start + "\\[Subagent Context\\][^\n\r  ]*", "", t)
    t = re.sub(start + rf"\[(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun){WS}+[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}{WS}+[0-9]{{2}}:[0-9]{{2}}{WS}+[A-Za-z]{{2,5}}\][ \t]*", "", t)
    return re.sub(r"\n{3,}", "\n\n", t.replace("\0", "")).strip(T.SPACES)


def _made(rnd, most):
    return "".join(rnd.choice(TOKENS) for _ in range(rnd.randint(0, most)))


def test_sanitizer_equals_plain_replacements(spark):
    rnd = random.Random(3)
    texts = [_made(rnd, 40) for _ in range(8000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sanitize(F.col("t")).alias("t")).collect()
    assert [r for r in rows if r.t != plain(texts[r.i])] == []
    assert spark.range(1).select(T.sanitize(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("text", ["<memory-context> text " * 50_000, '```json\n{ "schema": "inbound_meta x ' * 30_000, "```json" + "\n" * 1_000_000, "```json\n{ x " * 80_000 + '"label" "sender"', " " * 1_000_000 + "x"], ids=["tags", "fences", "line ends", "labels", "spaces"])
def test_a_megabyte_takes_about_a_second(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(F.length(T.sanitize(F.col("t"))))
    rows.collect()
    began = time.perf_counter()
    rows.collect()
    assert time.perf_counter() - began < 3  # under one as measured; the lazy regexes took minutes


@pytest.mark.parametrize(("cap", "step", "long"), [(10**6, 2, True), (200, 1, True), (60, 3, False)])
def test_pieces_equal_the_joined_text(spark, cap, step, long):
    rnd, rows = random.Random(cap + step), []
    for s in range(150):
        for i in range(rnd.randint(1, 14)):
            text = _made(rnd, 25)
            if long and rnd.random() < 0.8:  # pieces that need not be merged
                text = LONG + "\n" + text + LONG
            rows.append((f"s{s}", i, 0, text or "."))
    given = spark.createDataFrame(rows, "session_key string, idx long, block int, text string").repartition(4).cache()
    tails = spark.createDataFrame([(f"s{s}",) for s in range(0, 150, 2)], "session_key string")
    texts = {}
    for s, _, _, t in rows:
        texts.setdefault(s, []).append(t)
    want = {s: plain("\n\n".join(t)) for s, t in texts.items()}
    want = {s: t[-cap:] if int(s[1:]) % 2 == 0 else t[:cap] for s, t in want.items()}
    got = {r.session_key: r.text for r in pieces.sanitized(given, cap, tails=tails, step=step).collect()}
    assert {s: (got.get(s), t) for s, t in want.items() if got.get(s) != t} == {}


def test_blocks_over_many_pieces_and_one_that_never_closes(spark):
    own = "word " * 30
    texts = [own + "one", own + "<memory-context> opened", *[own + f"inside {k}" for k in range(20)], "closed </memory-context> after " + own, own + "<memory-context> left open", own + "the End."]
    given = spark.createDataFrame([("s", i, "user", t) for i, t in enumerate(texts)], "session_key string, idx long, role string, content string")
    out = capture.compact(given, "now", 1, step=1).first().content
    assert "inside" not in out and "one" in out and "after word" in out and "<memory-context> left open" in out and out.endswith("the End.")
    assert out == capture.compact(given, "now", 1).first().content


def test_blank_pieces_at_the_ends_and_only_blank_ones(spark):
    rows = [("a", i, 0, t) for i, t in enumerate([" " * 100, "\n" * 100, "x" * 60, " " * 100, "y" * 60, "\n " * 60])] + [("b", i, 0, " " * 60) for i in range(3)]
    given = spark.createDataFrame(rows, "session_key string, idx long, block int, text string")
    got = {r.session_key: r.text for r in pieces.sanitized(given, 10**6, step=1).collect()}
    assert got == {"a": plain("\n\n".join(t for s, _, _, t in rows if s == "a")), "b": ""}


def test_end_of_a_piece_is_judged_in_linear_time(spark):
    texts = ['"' * 150_000 + "x" * 100, '"' * 150_000 + "x" * 60 + " " * 200, "<" + ' "' * 300 + "x" * 48, "<" + "x" * 49, "<" + "x" * 48, "x" * 48 + " " * 200, "x" * 47 + " " * 200]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pieces._open_end(F.col("t")).alias("o"))
    began = time.perf_counter()
    assert [r.o for r in sorted(rows.collect())] == [False, False, True, False, True, False, True]
    assert time.perf_counter() - began < 3  # each quote looked at all behind it


def test_texts_are_worked_out_once(spark, monkeypatch):
    seen, kept, settled = spark.sparkContext.accumulator(0), [], pieces.shared.settled
    monkeypatch.setattr(pieces.shared, "settled", lambda df, name: kept.append(name) or settled(df, name))
    rows = [("a", i, "user" if i % 2 else "assistant", f"message {i} that is long enough") for i in range(12)] + [("b", 0, "user", "a session of one message only")]

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    given = spark.createDataFrame(rows, "session_key string, idx long, role string, content string").mapInArrow(counted, "session_key string, idx long, role string, content string")
    texts = capture.M.extract_texts(given)
    out = pieces.sanitized(texts, 10**6, step=2).collect()
    assert {r.session_key for r in out} == {"a", "b"} and kept[:2] == ["runs", "long"]
    assert seen.value == len(rows)


def test_episodes_of_turns_do_not_read_the_messages_again(spark):
    given = spark.createDataFrame([("a", i, "user", f"message {i} that is long enough") for i in range(12)], "session_key string, idx long, role string, content string")
    out = capture.after_turn(given, spark.createDataFrame([("a", 50)], "session_key string, before int"), "now", 1, step=3)
    assert not re.search("ExistingRDD|LocalTableScan", _plan(out))
    assert out.first().content.endswith("message 11 that is long enough")
