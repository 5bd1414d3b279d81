"""Line dedup, in DataFrame functions only: lines that recur across documents stay in one of them.

Normalised lines are exploded and hashed (two 64-bit hashes), documents are counted
by hash, and lines over the threshold go from all but the greatest doc_id that holds
them; what is left is put together by position. Only hashes are shuffled to find
the repeated lines; the texts move once, with the positions to drop.

1. `_repeated`: hashes found at least `documents` times and under two ids or more.
   Counting combines before its shuffle, so a line of a third of all documents is a
   few rows for the task that gets it.
2. The lines with such a hash, by document and position, are written to the shared folder.
3. Documents are counted exactly on those: distinct (hash, doc_id) first, dealt by
   both, then by hash, again combined before the shuffle.
4. The positions to drop are gathered by document (at most its lines) and joined with its lines.

Lists of hashes are broadcast up to MOST_SENT keys; beyond that, keys with many rows
are joined over salted copies.

Defined cases: a null text is one empty line; a null doc_id counts as no document,
and loses every line that is over the threshold; rows that share a doc_id are one
document for the count and are cut each by itself, with repeated rows giving equal
results; of a key held by the greatest doc_id, all its lines there stay; keys
shorter than `least` stay everywhere; an empty table gives no rows; extra columns
are not read. A text of any length is one row, whose lines are one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common

#: Code points that a key has at least, and documents that hold a repeated one.
LEAST, DOCUMENTS = 20, 3
#: White space that is stripped from a line's ends, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Repeated keys (16 bytes each) up to which their list is broadcast.
MOST_SENT = 500_000


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2): the hashes of every line whose key is long enough; t1 and t2 tell the rows of an id apart."""
    rows = docs.select("doc_id", *_marks(), F.posexplode(_split(F.col("text"))).alias("pos", "line"))
    rows = rows.select("doc_id", "t1", "t2", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= least)
    key = F.translate("key", UPPER, LOWER)
    return rows.select("doc_id", "t1", "t2", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _marks() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2")


def _repeated(lines: DataFrame, documents: int) -> DataFrame:
    """(h1, h2, n): hashes that may be in enough documents, with the rows that have them."""
    counts = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    many = F.col("n") >= documents
    return counts.where(many & (F.col("lo") < F.col("hi")) if documents > 1 else many).select("h1", "h2", "n")


def drop_repeated(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for each row of docs (doc_id, text): its text without lines that other documents keep."""
    docs = docs.select("doc_id", "text")
    lines = _keyed(docs, least)
    repeated = common.staged(_repeated(lines, documents), "repeated-lines")
    sent = repeated.count() <= MOST_SENT

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        if sent:
            return left.join(F.broadcast(right), ["h1", "h2"])
        return common.salted_join(left, right, ["h1", "h2"], repeated, ["doc_id", "t1", "pos"])

    found = common.staged(join(lines, repeated.drop("n")), "found-lines")
    held = found.select("h1", "h2", "doc_id").where("doc_id is not null").distinct()
    over = held.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper")).where(F.col("documents") >= documents)
    lost = join(found, over.select("h1", "h2", "keeper")).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("t1").alias("lost_1"), F.col("t2").alias("lost_2")).agg(F.collect_set("pos").alias("lost"))  # at most the lines of a text
    whole = docs.select("doc_id", *_marks(), _split(F.col("text")).alias("lines"))
    same = F.col("doc_id").eqNullSafe(F.col("lost_id")) & F.col("t1").eqNullSafe(F.col("lost_1")) & F.col("t2").eqNullSafe(F.col("lost_2"))
    rows = whole.join(lost, same, "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.when(F.col("lost").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(F.transform(left, lambda p: F.get("lines", p)), "\n"))
    return rows.select("doc_id", kept.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that recur, with a digest of what is kept."""
    rows = drop_repeated(common.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
over AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= {LEAST} GROUP BY key HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
j AS (SELECT k.*, keeper IS NOT NULL AND coalesce(doc_id < keeper, true) AS dropped FROM k LEFT JOIN over USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM j GROUP BY rid, doc_id
"""
