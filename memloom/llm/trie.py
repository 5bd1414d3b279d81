"""Conversation prefix trie with subtree totals, by leaf-peeling message passing.

Rebuilding. Turns are put in order and numbered without any conversation coming
together in one task: rows (two hashes of role and text, and a word count; no
texts) are dealt by ranges of (conv_id, turn) and numbered inside their range, and
only the ranges' counts are summed up by conversation. A node's identity is two
64-bit XORs over hash(depth, role, text) of its turns: each depth occurs once in a
sequence, and XOR needs no order, so prefixes too are taken range by range.

Peeling. Nodes with one member form chains that end a conversation; such a chain
has one leaf and saves nothing, so its head alone sends a message, at once. Every
other node holds the number of its remaining children, the XOR of their ids and the
totals received so far. In each round completed nodes send their totals to their
parents; nodes that got all become complete. A node that waits for one child only
reads from it instead: it takes the total of a completed child, or else adds what a
child in the same state has and waits for that one's child in its place. Waiting
chains so halve in each round, and the rounds grow with the logarithm of the
nodes, not with the depth. Rounds are written to the shared folder.

SHA-256 takes bytes one after another, so the ends of one node pass through one
task in the last step, as blocks of at most about BLOCK bytes that were made in
parallel, in constant memory.

Defined cases: turns of one number are ordered by the hashes of role and text;
rows without a conv_id belong to no conversation; repeated rows are turns of
their own; a negative conv_id has the remainder that truncation gives; an empty
table gives no rows, not even a root; extra columns are not read; texts are hashed
whole, so sequences differ if any byte does.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import common

#: Conversations that share a base, and the rest that sets how many turns are taken from it.
FAMILY, HEADS = 20, 4
#: Rows of a range when turns are dealt out, and bytes of a block of ends.
RANGE_ROWS, BLOCK = 500_000, 1 << 16


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h1, h2, words) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    h1, h2 = F.xxhash64(role, text), F.xxhash64(F.lit(1), text, role)
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"), words.cast("long").alias("words"))


def _heads(conv_id: Column) -> Column:
    """How many turns a conversation takes from its base."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with part and idx from 1 in their conversation; (part, conv_id, n, before, n_own))."""
    order = ["turn", "h1", "h2"]
    parts = max(8, turns.count() // RANGE_ROWS)
    dealt = turns.repartitionByRange(parts, "conv_id", F.asc_nulls_first("turn"), "h1", "h2")
    dealt = common.staged(dealt.withColumn("part", F.spark_partition_id()), "turns")
    counts = common.staged(dealt.groupBy("part", "conv_id").agg(F.count("*").alias("n")), "turn-counts")
    # A conversation has one row for each range that it reaches into.
    of = Window.partitionBy("conv_id").orderBy("part")
    before = F.coalesce(F.sum("n").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("before", before).withColumn("n_own", F.sum("n").over(Window.partitionBy("conv_id")))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first(order[0]), *order[1:]))
    rows = dealt.join(counts.select("part", "conv_id", "before"), ["part", "conv_id"])
    return common.staged(rows.withColumn("idx", F.col("before") + inside).drop("before", "turn"), "numbered"), counts


def occurrences(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, words, last): every prefix of every rebuilt conversation; (a, b) is its node, (pa, pb) its parent."""
    rows, counts = _numbered(_turns(conversations))
    ids = counts.groupBy("conv_id").agg(F.max("n_own").alias("n_own")).withColumn("h", _heads(F.col("conv_id")))
    ids = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    first = rows.where((F.col("idx") < HEADS) & (F.col("conv_id") % FAMILY == 0))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "h1", "h2", "words"))).alias("head"))  # HEADS - 1 turns at most
    info = ids.join(first, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<idx:bigint,h1:bigint,h2:bigint,words:bigint>>")), F.lit(1), F.col("h").cast("int")))
    info = info.withColumn("k", F.size("head").cast("long")).withColumn("length", F.col("k") + F.greatest(F.lit(0), F.col("n_own") - F.col("h")))

    def mark(depth: Column, h1: Column, h2: Column) -> tuple[Column, Column]:
        return F.xxhash64(depth, h1, h2), F.xxhash64(F.lit(1), h2, depth, h1)

    # The turns from the base: running XORs over an array of HEADS - 1 turns at most.
    def run(x: Column, t: Column) -> Column:
        depth = F.size(x).cast("long") + 1
        z1, z2 = mark(depth, t["h1"], t["h2"])
        pa_, pb_ = (F.when(F.size(x) > 0, F.element_at(x, -1)[c]).otherwise(F.lit(0).cast("long")) for c in ("a", "b"))
        one = F.struct(depth.alias("depth"), pa_.bitwiseXOR(z1).alias("a"), pb_.bitwiseXOR(z2).alias("b"), pa_.alias("pa"), pb_.alias("pb"), t["words"].alias("words"))
        return F.concat(x, F.array(one))

    none = F.array().cast("array<struct<depth:bigint,a:bigint,b:bigint,pa:bigint,pb:bigint,words:bigint>>")
    info = info.withColumn("taken", F.aggregate("head", none, run))
    info = common.staged(info.select("conv_id", "h", "k", "length", "taken"), "rebuilt")
    taken = info.select("conv_id", "length", F.explode("taken").alias("t")).select("conv_id", "t.*", "length")

    # Own turns: XORs inside a range, then over the ranges before it and the turns from the base.
    by_part = counts.select("part", "conv_id").join(info, "conv_id")
    start = [F.when(F.col("k") > 0, F.get("taken", F.col("k") - 1)[c]).otherwise(F.lit(0).cast("long")).alias(f"{c}0") for c in ("a", "b")]
    by_part = by_part.select("part", "conv_id", "h", "k", "length", *start)
    own = rows.join(by_part, ["part", "conv_id"]).where(F.col("idx") > F.col("h")).withColumn("depth", F.col("idx") - F.col("h") + F.col("k"))
    z1, z2 = mark(F.col("depth"), F.col("h1"), F.col("h2"))
    own = own.withColumns({"z1": z1, "z2": z2})
    own = own.select("part", "conv_id", "depth", "words", "length", "a0", "b0", "z1", "z2")
    running = Window.partitionBy("part", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({"x1": F.bit_xor("z1").over(running), "x2": F.bit_xor("z2").over(running)})
    own = common.staged(own, "own-turns")
    sums = own.groupBy("part", "conv_id").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", "conv_id", *[F.bit_xor(f"s{i}").over(earlier).alias(f"s{i}") for i in (1, 2)])
    sums = sums.where("s1 is not null")  # conversations over several ranges: fewer rows than ranges
    own = own.join(sums, ["part", "conv_id"], "left")
    parts = {}
    for i, c in ((1, "a"), (2, "b")):
        parts[c] = F.col(f"x{i}").bitwiseXOR(F.coalesce(f"s{i}", F.lit(0).cast("long"))).bitwiseXOR(F.col(f"{c}0"))
    own = own.withColumns(parts).withColumns({"pa": F.col("a").bitwiseXOR(F.col("z1")), "pb": F.col("b").bitwiseXOR(F.col("z2"))})
    columns = ["conv_id", "depth", "a", "b", "pa", "pb", "words", "length"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = info.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("pa"), none.alias("pb"), zero.alias("words"), "length")
    every = root.union(taken.select(*columns)).union(own.select(*columns))
    return every.withColumn("last", F.col("depth") == F.col("length")).drop("length")


def peeled(nodes: DataFrame) -> DataFrame:
    """(a, b, n_leaves, saved) of every node of nodes (a, b, pa, pb, n, own, n_children, ra, rb), a forest without its single-member nodes.

    Children that are not among nodes have been received already: leaves and saved start with their totals, and n_children, ra, rb (the XOR
    of the remaining children's ids) count only those that are.
    """
    left = F.col("n_children")
    state = nodes.select("a", "b", "pa", "pb", left.alias("left"), "ra", "rb", "leaves", "saved", F.when(left == 0, 0).alias("done"))
    state = common.staged(state, "peel")
    turn = 0
    while True:
        waiting = state.agg(F.count(F.when(F.col("done").isNull(), 1))).first()[0]
        if not waiting:
            return state.select("a", "b", F.col("leaves").alias("n_leaves"), "saved")
        turn += 1
        sent = state.where((F.col("done") == turn - 1) & F.col("pa").isNotNull())
        sent = sent.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("m_n"), F.bit_xor("a").alias("m_a"), F.bit_xor("b").alias("m_b"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
        # Nodes that wait for several children receive.
        many = state.where(F.col("done").isNull() & (F.col("left") > 1)).join(sent, ["a", "b"], "left")
        got = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        rest = F.col("left") - got("m_n")
        many = many.select(
            "a", "b", "pa", "pb", rest.alias("left"), F.col("ra").bitwiseXOR(got("m_a")).alias("ra"), F.col("rb").bitwiseXOR(got("m_b")).alias("rb"),
            (F.col("leaves") + got("m_leaves")).alias("leaves"), (F.col("saved") + got("m_saved")).alias("saved"), F.when(rest == 0, turn).alias("done"),
        )
        # Nodes that wait for one read; several of a chain may look at the same one, so that join splits such keys.
        one = state.where(F.col("done").isNull() & (F.col("left") == 1)).withColumnsRenamed({"ra": "t_a", "rb": "t_b"})
        seen = state.select(F.col("a").alias("t_a"), F.col("b").alias("t_b"), *[F.col(c).alias(f"t_{c}") for c in ("left", "leaves", "saved", "done")], F.col("ra").alias("n_a"), F.col("rb").alias("n_b"))
        one = common.salted_join(one, seen, ["t_a", "t_b"], one.groupBy("t_a", "t_b").agg(F.count("*").alias("n")), ["a", "b"])
        ready = F.col("t_done").isNotNull()
        take = ready | (F.col("t_left") == 1)
        more = lambda c: F.col(c) + F.when(take, F.col(f"t_{c}")).otherwise(0)
        one = one.select(
            "a", "b", "pa", "pb", F.when(ready, 0).otherwise(F.col("left")).alias("left"), *[F.when(take & ~ready, F.col(f"n_{c}")).otherwise(F.col(f"t_{c}")).alias(f"r{c}") for c in ("a", "b")],
            more("leaves").alias("leaves"), more("saved").alias("saved"), F.when(ready, turn).alias("done"),
        )
        state = common.staged(state.where("done is not null").union(many).union(one), "peel")


def _blocks(batches):
    """Sorted (a, b, conv_id) to (a, b, first, last, bytes): comma-joined ids by node, in blocks; `first` orders a node's blocks."""
    out, node, ids, size = [], None, [], 0

    def close():
        out.append((node[0], node[1], ids[0], ",".join(map(str, ids)).encode()))
        ids.clear()

    def batch():
        a, b, first, raw = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(raw, pa.binary())], ["a", "b", "first", "ids"])

    for given in batches:
        for a, b, i in zip(*(given.column(c).to_pylist() for c in ("a", "b", "conv_id")), strict=True):
            if node != (a, b) or size > BLOCK:
                if ids:
                    close()
                node, size = (a, b), 0
            ids.append(i)
            size += 12
        if len(out) > 1000:
            yield batch()
    if ids:
        close()
    if out:
        yield batch()


def _digests(batches):
    """Sorted (a, b, first, ids) to (a, b, ends_sha256), with one running hash."""
    node, running, out = None, None, []

    def batch():
        a, b, digest = zip(*out, strict=True)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], ["a", "b", "ends_sha256"])

    for given in batches:
        for a, b, ids in zip(*(given.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if node == (a, b):
                running.update(b"," + ids)
                continue
            if node is not None:
                out.append((*node, running.hexdigest()))
            node, running = (a, b), hashlib.sha256(ids)
        if len(out) > 1000:
            yield batch()
    if node is not None:
        out.append((*node, running.hexdigest()))
    if out:
        yield batch()


def ends(found: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the nodes that conversations end at."""
    last = found.where("last").select("a", "b", "conv_id")
    ranged = last.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    blocks = ranged.mapInArrow(_blocks, "a long, b long, first long, ids binary")
    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    found = common.staged(occurrences(conversations), "prefixes")
    nodes = found.groupBy("a", "b").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.bool_or("last").alias("ended"))
    nodes = common.staged(nodes.withColumn("own", (F.col("n") - 1) * F.col("words")), "nodes")
    shared, single = nodes.where((F.col("n") > 1) | (F.col("depth") == 0)), nodes.where((F.col("n") == 1) & (F.col("depth") > 0))
    # The first single-member node of a conversation heads its chain: one leaf, nothing saved, complete from the start.
    heads = single.groupBy("conv_id").agg(F.min_by(F.struct("a", "b", "pa", "pb"), "depth").alias("x")).select("conv_id", "x.*")
    sent = heads.groupBy("pa", "pb").agg(F.count("*").alias("n_heads"))
    inner = shared.where("pa is not null").groupBy("pa", "pb").agg(F.count("*").alias("n_inner"), F.bit_xor("a").alias("ra"), F.bit_xor("b").alias("rb"))
    kids = sent.join(inner, ["pa", "pb"], "full").select(F.col("pa").alias("a"), F.col("pb").alias("b"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_heads", "n_inner", "ra", "rb")])
    core = shared.join(kids, ["a", "b"], "left").fillna(0, ["n_heads", "n_inner", "ra", "rb"])
    core = common.staged(core.withColumn("childless", (F.col("n_heads") + F.col("n_inner") == 0).cast("long")), "shared")
    total = peeled(core.select("a", "b", "pa", "pb", F.col("n_inner").alias("n_children"), "ra", "rb", (F.col("n_heads") + F.col("childless")).alias("leaves"), F.col("own").alias("saved")))
    core = core.join(total.select("a", "b", "n_leaves", F.col("saved").alias("saved_tokens")), ["a", "b"])
    core = core.select("a", "b", "pa", "pb", "depth", "conv_id", "n", (F.col("n_heads") + F.col("n_inner")).alias("n_children"), "n_leaves", "saved_tokens")
    # Parents by name: the root and other hubs have many children, so their one row is salted.
    below = core.where("pa is not null").select("a", "b", "pa", "pb").union(heads.select("a", "b", "pa", "pb"))
    names = nodes.where((F.col("n") > 1) | (F.col("depth") == 0)).select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    fan = below.groupBy("pa", "pb").agg(F.count("*").alias("n"))
    parents = common.salted_join(below, names, ["pa", "pb"], fan, ["a", "b"]).select("a", "b", "parent_conv_id")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = single.select("a", "b", "depth", "conv_id", "n", F.when(F.col("ended"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.col("conv_id").alias("above"))
    rows = core.drop("pa", "pb").withColumn("above", F.lit(None).cast("long")).union(single)
    rows = rows.join(parents, ["a", "b"], "left").join(ends(found), ["a", "b"], "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return trie(common.table(spark, sf_dir, "conversations"))


def _crc32(x: str) -> str:
    """CRC-32 of an ASCII text, for DuckDB; `polynomial` has the 256 remainders."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({x}, ''), lambda z: CAST(ascii(z) AS BIGINT))), lambda c, z: xor(c >> 8, polynomial[CAST(xor(c, z) & 255 AS BIGINT) + 1])), CAST(4294967295 AS BIGINT))"


_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, CAST(3988292384 AS BIGINT)) ELSE {0} >> 1 END"
OP11_SQL = f"""
WITH RECURSIVE rest AS (SELECT i AS entry, i AS x, 0 AS step FROM range(256) t(i) UNION ALL SELECT entry, {_BIT.format("x")}, step + 1 FROM rest WHERE step < 8),
remainders AS (SELECT list(x ORDER BY entry) AS polynomial FROM rest WHERE step = 8),
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, {_crc32("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM own, remainders),
built AS (SELECT h.conv_id, coalesce(b.turns[1:h], []) || h.turns[h + 1:] AS turns FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % {FAMILY}),
prefixes AS (SELECT conv_id, len(turns) = d AS last, d AS depth, turns[1:d] AS path FROM built, range(0, (SELECT max(len(turns)) + 1 FROM built)) t(d) WHERE d <= len(turns)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
  CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[-1].t, '[^\\x20\\x09-\\x0D]+')) END AS own FROM prefixes GROUP BY path, depth),
kids AS (SELECT n.path, count(c.path) AS n_children FROM nodes n LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path GROUP BY n.path),
totals AS (SELECT n.path, CAST(sum(s.own) AS BIGINT) AS saved, count(*) FILTER (WHERE k.n_children = 0) AS leaves FROM nodes n JOIN nodes s ON s.depth >= n.depth AND s.path[1:n.depth] = n.path JOIN kids k ON k.path = s.path GROUP BY n.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, k.n_children, t.leaves AS n_leaves, t.saved AS saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k USING (path) JOIN totals t USING (path) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
