"""Prefix trie, line dedup and collocations against DuckDB and plain Python, odd rows included."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.llm import common, langid, lines, phrases, quality, registry, trie


def _sql(sql, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        con.execute(f"CREATE TABLE {name} ({schema})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()), key=repr)


def _rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


# --- samples -------------------------------------------------------------------------------------------------------


def test_samples_of_very_many_rows_are_never_empty(spark):
    rows = spark.range(50_000).select(F.col("id").alias("doc_id"))
    assert common.sampled(rows, 60_000, ["doc_id"]).count() == 50_000
    assert abs(common.sampled(rows, 5000, ["doc_id"]).count() - 5000) < 400
    assert common.sampled(rows, 20_000, ["doc_id"], 30_000_000_000).count() == 20_000  # a share that draws none of these
    assert common.sampled(rows.select(F.lit(1).alias("doc_id")), 100, ["doc_id"]).count() in (100, 50_000)


def test_models_learn_whatever_the_count(spark, sf_dir, monkeypatch):
    plain = common.sampled
    monkeypatch.setattr(common, "sampled", lambda rows, most, keys, count=None: plain(rows, most, keys, 30_000_000_000))
    docs = common.table(spark, sf_dir, "documents")
    assert langid.train(docs).langs == ["de", "en", "es", "fr"]
    assert len(quality.train(docs, common.table(spark, sf_dir, "labels")).leaf) > 0


# --- trie ----------------------------------------------------------------------------------------------------------

_CONV = ("conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", "conv_id long, turn long, role string, text string")


def _talks():
    rnd, rows = random.Random(5), []

    def talk(c, texts, roles=("user", "assistant")):
        rows.extend((c, i if i else None, roles[i % 2], t) for i, t in enumerate(texts))

    spine = [f"spine {i} words here" for i in range(70)]
    for c in range(0, 40):  # copies of a long talk, and a caterpillar of talks that leave it at different depths
        talk(c, spine if c < 6 else [*spine[: c + 20], f"leaves at {c}", "and goes on"])
    for c in range(100, 160):
        talk(c, [rnd.choice(["yes", "no", None, "", "a  b\tc"]) for _ in range(rnd.randint(1, 6))])
    for c in range(200, 320, 3):  # many without a base
        talk(c, [rnd.choice(["x", "y"]) for _ in range(rnd.randint(1, 3))])
    for c in (-1, -7, -20, -25):
        talk(c, ["minus", "one"], (None, "user"))
    rows.append((None, 1, "user", "of nobody"))
    rnd.shuffle(rows)
    return rows


def test_trie_equals_sql_on_long_odd_and_copied_talks(spark):
    rows = _talks()
    given = spark.createDataFrame([(*r, 0) for r in rows], _CONV[1] + ", depth int")  # an extra column with a clashing name
    assert _rows(trie.trie(given)) == _sql(registry.ORACLES["op11_trie"], conversations=(rows, _CONV[0]))


def test_trie_of_nothing_and_of_turnless_talks(spark):
    assert trie.trie(spark.createDataFrame([], _CONV[1])).count() == 0
    # 1 takes crc32("1") % 4 = 3 turns from conversation 0, which is not there, and has only two of its own.
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (None, 0, "user", "c")]
    got = trie.trie(spark.createDataFrame(rows, _CONV[1])).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves) for r in got] == [(1, 0, None, 1, 0, 1)]
    assert _rows(trie.trie(spark.createDataFrame(rows, _CONV[1]))) == _sql(registry.ORACLES["op11_trie"], conversations=(rows, _CONV[0]))


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    rounds = []
    staged = common.staged
    monkeypatch.setattr(common, "staged", lambda df, name: (rounds.append(name), staged(df, name))[1])
    n = 300  # a chain in which every node waits for its one child
    rows = [(i, i, i - 1 if i else None, i - 1 if i else None, int(i < n - 1), (i + 1) if i < n - 1 else 0, (i + 1) if i < n - 1 else 0, int(i == n - 1), 1) for i in range(n)]
    nodes = spark.createDataFrame(rows, "a long, b long, pa long, pb long, n_children long, ra long, rb long, leaves long, saved long")
    got = {r.a: (r.n_leaves, r.saved) for r in trie.peeled(nodes).collect()}
    assert got == {i: (1, n - i) for i in range(n)}
    assert rounds.count("peel") <= 12


# --- lines ---------------------------------------------------------------------------------------------------------

_DOCS = ("doc_id BIGINT, text VARCHAR", "doc_id long, text string")


def _papers():
    rnd, rows = random.Random(6), []
    pool = [f"A Line of the pool number {i} that recurs" for i in range(30)] + ["short", "", "  \t", "exactly twenty chars", "nineteen characters", "  Accents ÄÖ stay as they are here "]
    for i in range(120):
        texts = [rnd.choice(pool) if rnd.random() < 0.5 else f"own line {i} {k} of this document" for k in range(rnd.randint(0, 12))]
        texts = [rnd.choice(["", " ", "\t\r"]) + (t.upper() if rnd.random() < 0.2 else t) + rnd.choice(["", "\x0b ", "\r"]) for t in texts]
        rows.append((i, "\n".join(texts)))
    rows += [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(pool)), (None, pool[0]), (5, pool[1]), (5, pool[1])]
    rows += [(300 + i, "only in two documents, never dropped") for i in range(2)] + [(302, "twice in one document\n" * 4)]
    return rows + [(119, "\n".join(pool * 3)), (400, "\n".join(["a very long text has this line"] * 20_000)), (399, "a very long text has this line"), (398, "a VERY long text has this line")]


def test_lines_equal_sql_on_odd_rows(spark):
    rows = _papers()
    given = spark.createDataFrame([(*r, "x") for r in rows], _DOCS[1] + ", pos string")
    out = lines.drop_repeated(given)
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
    want = _sql(registry.ORACLES["op12_lines"], documents=(rows, _DOCS[0]))
    assert _rows(got) == want
    assert sum(r[3] for r in want if r[3]) > 100  # n_dropped
    assert lines.drop_repeated(spark.createDataFrame([], _DOCS[1])).count() == 0


def test_lines_joined_by_shuffle_are_the_same(spark, monkeypatch):
    given = spark.createDataFrame(_papers(), _DOCS[1])
    want = _rows(lines.drop_repeated(given))
    monkeypatch.setattr(lines, "MOST_SENT", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 5)  # and with salted keys
    assert _rows(lines.drop_repeated(given)) == want


def test_lines_use_no_python(spark, sf_dir):
    plan = registry.QUERIES["op12_lines"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- phrases -------------------------------------------------------------------------------------------------------

_TEXTS = ("lang VARCHAR, text VARCHAR", "lang string, text string")


def _prose():
    rnd, rows = random.Random(7), []
    vocabulary = ["the", "The", "of", "naïve", "x y", "straße", "a", "b", "state-of", "100%", *(f"w{i}" for i in range(40))]
    for i in range(150):
        words = []
        while len(words) < rnd.randint(0, 300):
            words += rnd.choice([["New", "york", "city", "hall"], ["new", "york"], ["red", "apple"], [rnd.choice(vocabulary)], [rnd.choice(vocabulary)]])
        text = "".join(w + rnd.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\x0b"]) for w in words)
        rows.append((rnd.choice(["en", "en", "de", None, "und"]), text))
    return rows + [("en", None), ("en", ""), (None, " .,\n"), ("fr", "the the " * 200), ("fr", "the the " * 200), ("one", "word")]


def test_phrases_equal_sql_on_odd_rows(spark):
    rows = _prose()
    given = spark.createDataFrame([(*r, 1) for r in rows], _TEXTS[1] + ", phrase int").repartition(3)
    want = _sql(registry.ORACLES["op13_phrases"], documents=(rows, _TEXTS[0]))
    assert _rows(phrases.collocations(given)) == want and len(want) > 20
    assert phrases.collocations(spark.createDataFrame([], _TEXTS[1])).count() == 0


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_intervals_equal_counting(longest):
    rnd = random.Random(longest)
    for _ in range(30):
        n = rnd.randint(0, 60)
        ids, linked = np.array([rnd.randint(0, 4) for _ in range(n)], np.int64), np.array([rnd.random() < 0.8 for _ in range(n)], bool)
        starts = rnd.randint(0, n)
        want = Counter()
        for i in range(starts):
            for k in range(1, longest + 1):
                if i + k <= n and all(ids[i : i + k] > 0) and all(linked[i + 1 : i + k]):
                    want[tuple(ids[i : i + k])] += 1
        got = Counter()
        for k, word, count in phrases.intervals(ids, linked, longest, starts):
            got.update({tuple(ids[w : w + k]): int(c) for w, c in zip(word, count, strict=True)})
        assert got == want
        some = {(k, tuple(ids[w : w + k]), int(c)) for k, word, count in phrases.intervals(ids, linked, longest, starts, longest) for w, c in zip(word, count, strict=True)}
        assert some == {(longest, p, c) for p, c in want.items() if len(p) == longest}


def test_windows_cut_a_text_anywhere(monkeypatch):
    """Counts do not depend on where shards are cut."""
    monkeypatch.setattr(phrases, "SHARD", 7)
    monkeypatch.setattr(phrases, "_ROWS", 3)
    text = " ".join(random.Random(8).choice("abcd") for _ in range(200)) + ". A b c\td"
    full = type("Sent", (), {"value": phrases.Filters([np.full(1 << 23, 255, np.uint8)] * 3)})
    batch = pa.RecordBatch.from_arrays([pa.array(["en", None]), pa.array([text, "a b"])], ["lang", "text"])
    got = Counter()
    for out in phrases._texts(full)([batch]):
        for r in out.to_pylist():
            got[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    for lang, t in (("en", text), ("und", "a b")):
        for piece in re.split(r"[.,;:!?\n-\r]", t.lower()):
            w = re.findall(r"[^ \t]+", piece)
            want.update((lang, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert got == want


@pytest.mark.parametrize("name", ["op11_trie", "op12_lines", "op13_phrases"])
def test_new_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    assert _rows(got) == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall()), key=repr) != []
