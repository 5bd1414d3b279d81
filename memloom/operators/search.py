"""Search: BM25 over texts, cosine over vectors, and their reciprocal-rank fusion.

The queries are a stated set. Where their terms are few, only postings of these are kept
(a semi-join on a broadcast list). Documents and queries are dealt to blocks; each pair of
blocks is a cell, in which all its pairs are scored, and only the k best of each query leave it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from memloom.operators import blocked
from memloom.sources import shared

K1, B, RRF = 1.2, 0.75, 60
#: Places that scores are rounded to.
PLACES = 6
#: Most distinct query terms that are broadcast, to drop the postings of others; with more, all postings are kept.
MOST_TERMS = 100_000
#: Most postings, or terms of queries, of a block; most components of a block's vectors.
POSTINGS, NUMBERS = 4_000_000, 1 << 23
#: Blocks of documents, so that all cores have work, if these have so many rows.
CELLS, LEAST = 48, 1000
#: A term: a run of ASCII letters and digits of the lower-cased text.
WORD = "[a-z0-9]+"
#: No term is like it; its postings hold the documents' sizes.
SIZE = ""


def _terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): runs of ASCII letters and digits, lower-cased."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))).alias("term"))
    return words.groupBy(key, "term").agg(F.count("*").alias("tf"))


def part(tf: Column, length: Column, n: Column, total: Column) -> Column:
    """A term's part of a document's score, without the term's weight; n documents have `total` words."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length * n / total))


def _cells(rows: DataFrame, mine: str, of_mine: int, of_other: int, own: bool) -> DataFrame:
    """rows once for each block of the other side: `cell` is the block of documents times the blocks of queries plus the block of queries."""
    block, other = F.pmod(F.xxhash64(mine), F.lit(of_mine)), F.explode(F.sequence(F.lit(0), F.lit(of_other - 1))).alias("_other")
    rows = rows.select("*", block.alias("_block"), other)
    cell = F.col("_block") * of_other + F.col("_other") if own else F.col("_other") * of_mine + F.col("_block")
    return rows.withColumn("cell", cell).drop("_block", "_other")


def _by_cell(docs: DataFrame, queries: DataFrame, blocks: tuple[int, int], best, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): best(documents, queries) gives each cell's k best of each query; the k best of these are the k best.

    docs and queries are dealt to blocks by the hashes of doc_id and query_id, so a cell is bounded by the sizes of two blocks, and
    what is shuffled is each side once for each block of the other and k rows for each query and block of documents.
    """
    left, right = _cells(docs, "doc_id", *blocks, True), _cells(queries, "query_id", *blocks[::-1], False)
    parts = 4 * blocks[0] * blocks[1]  # tasks of one cell mostly
    schema = StructType([StructField("query_id", queries.schema["query_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    found = left.repartition(parts, "cell").groupBy("cell").cogroup(right.repartition(parts, "cell").groupBy("cell")).applyInArrow(best, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    found = found.withColumn("score", F.round("score", PLACES))
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best docs (doc_id, text) for each of queries (query_id, query); ties by doc_id.

    Postings are counted and weighted by Spark. The sums by query and document, of which there may be as many as queries times
    documents, are made in cells and never leave them.
    """
    asked = shared.settled(_terms(queries, "query_id", "query").select("query_id", "term"), "asked")
    terms = asked.select("term").distinct()
    words = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)).alias("words"))
    # A document's size is a posting of the term SIZE, so texts are split once; an outer explode, as a plain one adds a filter that splits again.
    post = words.select("doc_id", F.size("words").alias("len"), F.explode_outer(F.array_append("words", F.lit(SIZE))).alias("term"))
    if terms.count() <= MOST_TERMS:
        post = post.join(F.broadcast(terms.union(terms.sparkSession.range(1).select(F.lit(SIZE)))), "term", "left_semi")
    post = shared.settled(post.groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf")), "postings").where("len > 0")
    n, total = (x or 0 for x in post.where(F.col("term") == SIZE).agg(F.sum("tf"), F.sum(F.col("tf") * F.col("len"))).first())
    post = post.where(F.col("term") != SIZE)
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = shared.settled(asked.join(weights, "term").select("query_id", "term", "idf"), "weighted")
    rows = post.select("doc_id", "term", part(F.col("tf"), F.col("len"), F.lit(n), F.lit(total)).alias("part"))
    blocks = _blocks(post.count(), POSTINGS), max(1, -(-asked.count() // POSTINGS))
    return _by_cell(rows, asked, blocks, partial(blocked.bm25, k=k, places=PLACES), k)


def _blocks(n: int, most: int) -> int:
    """Blocks for n rows: as many as keep a block within `most`, and CELLS where that leaves blocks of LEAST rows."""
    return max(1, -(-n // most), min(CELLS, n // LEAST))


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k vectors (doc_id, v) nearest to each of queries (query_id, q) by cosine.

    Vectors without a length or with a null are left out; a vector is compared with those of its dimension.
    """

    def whole(df: DataFrame, key: str, c: str) -> DataFrame:
        return df.select(key, F.transform(c, lambda x: x.cast("double")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))

    rows, asked = whole(vectors, "doc_id", "v"), whole(queries, "query_id", "q")
    sizes = lambda df: tuple(x or 0 for x in df.agg(F.count("*"), F.sum(F.size("v").cast("long"))).first())
    (n, numbers), (_, wanted) = sizes(rows), sizes(asked)
    blocks = max(_blocks(n, n or 1), -(-numbers // NUMBERS)), max(1, -(-wanted // NUMBERS))
    return _by_cell(rows, asked, blocks, partial(blocked.cosine, k=k, places=PLACES), k)


def fuse(*ranked: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank) by the sum of reciprocal ranks over several rankings."""
    rows = None
    for r in ranked:
        part = r.select("query_id", "doc_id", (1.0 / (RRF + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)
