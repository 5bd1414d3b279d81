"""Sharding along a Hilbert curve, in DataFrame functions only.

Three metadata dimensions (source, language, size) are quantised to 16 levels
each, source and language by the exact 16-quantiles of all their distinct values. The curve index of the three levels (a table of 4096 entries made from the
curve's rule) orders the documents, so that a run of the order covers a small
box in all three dimensions and file statistics prune on any of them. Runs of
equal row counts become the shards (law `rows`: counts at most one apart).

The order needs no global sort: rows are numbered within small groups (curve
cell, leading bits of the text's checksum, a salt of the id), group counts are
summed up within each cell and over the 4096 cells, and a row's rank is its
number plus its group's offset. Equal texts of a cell share the checksum bits and
so lie close together, while the salt splits a group of copies over many tasks.

Defined cases: a null text has size 16 and checksum 0; null source or lang take
level 0; repeated rows get ranks of their own; an empty table gives no rows;
extra columns are not read. With fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import common
from memloom.sources import shared

SHARDS = 40
BITS = 4
#: Ranges that a dimension's distinct values are dealt to, to find its cut points.
RANGES = 64
#: Leading checksum bits, least salts, and rows for which one more salt is added.
SUM_BITS, LEAST_SALTS, ROWS_PER_SALT = 6, 8, 4_000_000


def curve_index(x: list[int], bits: int) -> int:
    """The Hilbert index of a point (Skilling's transform of axes to the transposed index)."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ t) >> bit) & 1)
    return index


def _cuts(df: DataFrame, name: str) -> list[str]:
    """The values at 1/16 to 15/16 of all distinct values of a column in their order.

    Values are dealt to ranges in order (where these end has no effect); their counts tell in which range a place lies, and
    only in those ranges values are numbered, each by itself.
    """
    most = (1 << BITS) - 1
    values = df.select(F.col(name).alias("value")).where("value is not null").distinct()
    ranges = shared.settled(values.repartitionByRange(RANGES, "value").select("value", F.spark_partition_id().alias("part")), "values")
    counts = sorted(map(tuple, ranges.groupBy("part").agg(F.count("*")).collect()))  # RANGES rows
    total, before, places = sum(n for _, n in counts), 0, []
    for part, n in counts:
        places += [(part, at - before + 1) for at in sorted({0} | {(k + 1) * total // (most + 1) for k in range(most)}) if before <= at < before + n]
        before += n
    if not places:
        return []
    numbered = ranges.where(F.col("part").isin([p for p, _ in places])).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("value")))
    wanted = df.sparkSession.createDataFrame(places, "part int, at int")
    found = sorted(r[0] for r in numbered.join(F.broadcast(wanted), ["part", "at"]).select("value").collect())  # 16 at most
    return found[1:]  # the least value is no cut


def _levels(df: DataFrame, name: str) -> Column:
    """The level (0..15) of a text column: how many of 15 cut points, taken from all distinct values, are at most the value."""
    level = F.lit(0)
    for k, cut in enumerate(_cuts(df, name)):
        level = F.when(F.col(name) >= F.lit(cut), F.lit(k + 1)).otherwise(level)
    return F.coalesce(level, F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    most = (1 << BITS) - 1
    size_level = F.least(F.lit(most), F.greatest(F.lit(0), F.floor(F.log2(F.col("size").cast("double"))) - 4)).cast("int")
    table = F.array(*[F.lit(curve_index([i >> 2 * BITS, i >> BITS & most, i & most], BITS)) for i in range(1 << 3 * BITS)])
    place = _levels(docs, "source") * (1 << 2 * BITS) + _levels(docs, "lang") * (1 << BITS) + size_level
    total = docs.count()
    salts = max(LEAST_SALTS, -(-total // ROWS_PER_SALT))
    rows = rows.withColumn("cell", F.element_at(table, (place + 1).cast("int")))
    sub = F.shiftrightunsigned("text_crc32", 32 - SUM_BITS) * salts + F.pmod(F.xxhash64("doc_id"), F.lit(salts))
    rows = rows.withColumn("sub", sub).select("doc_id", "size", "text_crc32", "cell", "sub")
    groups = rows.groupBy("cell", "sub").agg(F.count("*").alias("n"))
    inside = F.sum("n").over(Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    cells = groups.groupBy("cell").agg(F.sum("n").alias("n"))  # 4096 rows at most
    before = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select("cell", F.coalesce(before, F.lit(0)).alias("start"))
    groups = groups.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(cells), "cell")
    groups = groups.select("cell", "sub", (F.col("start") + F.col("inside")).alias("start"))
    number = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("text_crc32", "doc_id", "size"))
    ranked = rows.withColumn("number", number).join(groups, ["cell", "sub"]).withColumn("rank", F.col("start") + F.col("number") - 1)
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")  # the least rank of the shard
    out = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return out.select("doc_id", "size", "text_crc32", F.col("shard").cast("int"), F.col("slot").cast("long"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 runs of the Hilbert order."""
    out = hilbert_shards(common.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
