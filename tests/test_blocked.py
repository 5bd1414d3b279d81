"""Searches in cells against loops over all pairs, with blocks of a few rows."""

import contextlib
import io
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from memloom.operators import blocked, search


def _small(monkeypatch):
    monkeypatch.setattr(search, "POSTINGS", 700)
    monkeypatch.setattr(search, "LEAST", 20)
    monkeypatch.setattr(search, "CELLS", 3)
    monkeypatch.setattr(blocked, "ADDED", 50)
    monkeypatch.setattr(blocked, "WIDTH", 4)


def _bm25(docs, queries, k):
    words = [(i, re.findall("[a-z0-9]+", (t or "").lower())) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, total = len(words), sum(len(w) for _, w in words)
    post = Counter((i, len(w), x) for i, w in words for x in w)
    df = Counter(x for _, _, x in post)
    asked = defaultdict(set)
    for q, t in queries:
        asked[q] |= set(re.findall("[a-z0-9]+", (t or "").lower()))
    out = []
    for q, terms in asked.items():
        score = defaultdict(float)
        for (i, size, x), tf in post.items():
            if x in terms:
                score[i] += math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size * n / total))
        best = sorted(((round(s, 6), i) for i, s in score.items()), key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, i, s, r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out)


def _same(got, want):
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert (a[0], a[1], a[3]) == (b[0], b[1], b[3]) and abs(a[2] - b[2]) < 2e-6


def _plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def test_text_search_in_cells_equals_a_loop(spark, monkeypatch):
    _small(monkeypatch)
    rnd = random.Random(3)
    words = [f"w{min(400, int(rnd.paretovariate(0.6)))}" for _ in range(3000)]
    docs = [(f"d{i % 140:03}", " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 25)))) for i in range(150)]  # ten ids have two texts
    docs += [(f"copy{i:02}", "w1 w1 w7") for i in range(30)] + [("none", None), ("blank", "?!")]
    queries = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for q in range(60)] + [(60, "w1 w7"), (61, ""), (62, None), (63, "nowhere"), (64, "W1 w1, W2")]
    given = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(queries, "query_id int, query string")
    for most in (100_000, 1):  # with the list of terms broadcast, and without
        monkeypatch.setattr(search, "MOST_TERMS", most)
        found = search.bm25(*given, 5)
        _same(sorted(map(tuple, found.collect())), _bm25(docs, queries, 5))


def test_text_search_shuffles_no_pairs(spark):
    docs, queries = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "query_id int, query string")
    plan = _plan(search.bm25(docs, queries))
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", plan)


def test_cell_of_common_terms_only():
    post = pa.table({"doc_id": [1, 2, 2], "term": ["a", "a", "b"], "part": [1.0, 2.0, 1.0]})
    found = blocked.bm25(post, pa.table({"query_id": [7, 7, 8], "term": ["a", "b", "x"], "idf": [0.5, 1.0, 2.0]}), 5, 6)
    assert found.to_pylist() == [{"query_id": 7, "doc_id": 2, "score": 2.0}, {"query_id": 7, "doc_id": 1, "score": 0.5}]


def test_text_search_reads_each_text_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    texts = [(1, "a b"), (1, "b c"), (2, None), (3, "?"), (4, "b"), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("doc_id", F.udf(seen, "string")("text").alias("text"))
    found = search.bm25(docs, spark.createDataFrame([(1, "a b")], "query_id int, query string"))
    _same(sorted(map(tuple, found.collect())), _bm25(texts, [(1, "a b")], 10))
    assert read.value == len(texts)


def test_text_search_without_texts(spark):
    queries = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    for texts in [], [(1, None), (2, "?")]:
        assert search.bm25(spark.createDataFrame(texts, "doc_id long, text string"), queries).collect() == []
