"""The stored index against BM25 over all postings."""

import random

from pyspark.sql import functions as F

from memloom.operators import recall, search, textindex
from memloom.plans import relations as R


def _same(a, b):
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))
    assert rows(a) == rows(b) != []


def test_index_equals_bm25_with_fewer_postings(spark, tmp_path):
    rnd = random.Random(1)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(20_000)]  # a few words are everywhere, many are rare
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(3000)] + [(3000, None), (3001, "?!"), (3002, "w1 w1 w2"), (3003, "w1 w1 w2")]
    queries = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for q in range(40)] + [(40, "nowhere"), (41, ""), (42, None), (43, "w1"), (44, "W1 w1, W2")]
    docs, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id int, query string")
    path = str(tmp_path / "index")
    textindex.build(docs, path, 16)
    found = textindex.Search(spark, path, queries, 5)
    _same(found.top(), search.bm25(docs, queries, 5))
    work = found.work().agg(F.sum("postings").alias("postings"), F.sum("scored").alias("scored")).first()
    assert work.scored < 0.8 * work.postings, work


def test_index_of_few_and_of_no_documents(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a b")], "query_id int, query string")
    docs = spark.createDataFrame([(1, "a"), (2, "b b")], "doc_id long, text string")
    textindex.build(docs, str(tmp_path / "few"))
    _same(textindex.top(spark, str(tmp_path / "few"), queries), search.bm25(docs, queries))
    textindex.build(docs.limit(0), str(tmp_path / "none"))
    assert textindex.top(spark, str(tmp_path / "none"), queries).count() == 0


def test_recall_over_an_index_equals_recall_without(spark, sf_dir, tmp_path):
    facts, messages = R.facts(spark, sf_dir), R.messages(spark, sf_dir)
    recall.index_facts(facts, str(tmp_path / "facts"))
    rows = lambda df: sorted(map(tuple, df.select("session_key", "uuid", "score", "rank").collect()))
    assert rows(recall.memory_search(messages, facts, index=str(tmp_path / "facts"))) == rows(recall.memory_search(messages, facts)) != []


def test_build_reads_the_texts_once_and_shuffles_documents(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(1, "a b b"), (1, "b a a"), (2, "b"), (3, None)], "doc_id long, text string")
    kept, settled = [], textindex.shared.settled
    monkeypatch.setattr(textindex.shared, "settled", lambda df, name: kept.append(name) or settled(df, name))
    textindex.build(docs, str(tmp_path / "index"))
    assert kept == ["words"]
    found = spark.read.parquet(str(tmp_path / "index" / "postings")).selectExpr("term", "inline(docs)")
    assert sorted((r.term, r.doc_id) for r in found.collect()) == [("a", 1), ("b", 1), ("b", 2)]  # texts of one id and length count as one
