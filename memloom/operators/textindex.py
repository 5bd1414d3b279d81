"""A stored BM25 index, and an exact top-k over it that leaves out blocks that can't reach the k best.

Documents are dealt to ranges of about RANGE by the hash of their id. The index is a
table of (term, range) rows: the documents of the range with the term, their parts
of the score (without the term's weight), and the greatest of these parts. It
is laid out by buckets of terms, so a search reads the buckets of its terms only, and of those
the narrow columns first.

A search sums the greatest parts by query and range: no document of a range can
score more. The ranges that promise most are scored first, and the k-th score found
there is a floor: of all other ranges, only those that promise as much are read
and scored. What is left out scores less than the k-th, so the result equals
scoring everything. Terms of every document are many small rows, never one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.operators import search
from memloom.sources import shared

#: Documents of a range, buckets of terms, files of a bucket that a term's ranges are spread over.
RANGE, BUCKETS, FILES = 64, 16, 4
#: Ranges that are scored first, for each of the k results asked for.
AHEAD = 2
#: Scores that differ by less count as equal when ranges are left out; results are rounded to 6 places.
SLACK = 1e-6


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, path: str, docs_of_range: int = RANGE) -> None:
    """Writes the index of docs (doc_id, text) to a folder: `postings` by bucket and `size`. Rows that share an id count as one text for each length they have."""
    wide = docs.select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(search.WORD), F.lit(0)).alias("words")).where("size(words) > 0")
    wide = shared.settled(wide.withColumn("len", F.size("words")), "words")
    size = wide.agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size.withColumn("kind", F.lit(kind)).write.mode("overwrite").parquet(f"{path}/size")
    n, total, _ = docs.sparkSession.read.parquet(f"{path}/size").first()
    ranges = max(1, (n or 0) // docs_of_range)
    # Whole documents are dealt by range; both groupings lie within ranges, so postings are not shuffled one by one.
    dealt = wide.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges))).repartition("range")
    post = dealt.select("range", "doc_id", "len", F.explode("words").alias("term")).groupBy("range", "doc_id", "len", "term").agg(F.count("*").alias("tf"))
    part = search.part(F.col("tf"), F.col("len"), F.lit(n), F.lit(total))
    post = post.select("term", "doc_id", part.alias("part"), "range")
    rows = post.groupBy("term", "range").agg(F.max("part").alias("most"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id", "part")).alias("docs"))  # a range's documents
    rows = rows.withColumn("bucket", _bucket(F.col("term")))
    rows = rows.repartition("bucket", F.pmod("range", F.lit(FILES))).sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


class Search:
    """A search of queries (query_id, query) over a stored index for the k best documents of each."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, k: int = 10):
        n, _, kind = spark.read.parquet(f"{path}/size").first()
        self.k, self.n = k, n
        schema = f"term string, range long, most double, n long, docs array<struct<doc_id:{kind},part:double>>, bucket int"
        asked = shared.settled(search._terms(queries, "query_id", "query").select("query_id", "term").withColumn("bucket", _bucket(F.col("term"))), "asked")
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
        postings = spark.read.schema(schema).parquet(f"{path}/postings").where(F.col("bucket").isin(buckets) if buckets else F.lit(False))
        terms = asked.select("term").distinct()
        few = terms.count() <= search.MOST_TERMS
        side = F.broadcast if few else (lambda df: df)
        self.postings = postings.join(side(terms), "term", "left_semi")
        df = self.postings.groupBy("term").agg(F.sum("n").alias("df"))
        weights = df.select("term", F.log(1 + (self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        self.asked = shared.settled(asked.join(weights, "term").select("query_id", "term", "idf"), "weighted")
        bounds = self.postings.select("term", "range", "most").join(side(self.asked), "term")
        self.bounds = shared.settled(bounds.groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")), "bounds")
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
        self.first = self.bounds.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= AHEAD * k).select("query_id", "range")
        floor = self._best(self.first).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        left = self.bounds.join(floor, "query_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0.0)) - SLACK)
        self.chosen = shared.settled(left.select("query_id", "range"), "ranges")

    def _postings(self, ranges: DataFrame) -> DataFrame:
        wanted = ranges.join(self.asked, "query_id")
        return wanted.join(self.postings.select("term", "range", "docs"), ["term", "range"])

    def _best(self, ranges: DataFrame) -> DataFrame:
        rows = self._postings(ranges).select("query_id", "idf", F.explode("docs").alias("d"))
        scored = rows.groupBy("query_id", F.col("d.doc_id").alias("doc_id")).agg(F.round(F.sum(F.col("idf") * F.col("d.part")), 6).alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
        return scored.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= self.k)

    def top(self) -> DataFrame:
        """(query_id, doc_id, score, rank), as `search.bm25` gives."""
        return self._best(self.chosen)

    def work(self) -> DataFrame:
        """(query_id, postings, scored): postings of each query's terms, and how many of them were scored, those for the floor included."""
        size = lambda rows: rows.groupBy("query_id").agg(F.sum("n").alias("n"))
        wanted = lambda ranges: ranges.join(self.asked, "query_id").join(self.postings.select("term", "range", "n"), ["term", "range"])
        every = size(self.asked.join(self.postings.select("term", "n"), "term")).withColumnRenamed("n", "postings")
        return every.join(size(wanted(self.first.union(self.chosen))).withColumnRenamed("n", "scored"), "query_id")


def top(spark: SparkSession, path: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of the index for each of queries (query_id, query); ties by doc_id."""
    return Search(spark, path, queries, k).top()
