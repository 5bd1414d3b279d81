"""Embedding near-dedup by product quantisation.

A bounded sample fits coarse centroids and, for the residuals, codebooks of
SUBSPACES subspaces. Every vector is filed under its nearest centroid as residual
codes, and asks every list that can hold a link of it: a list is left out only if
the vector is farther than the link radius behind the plane midway between its own
centroid and that list's. In a list, distances of queries to codes come from lookup
tables; since each code's own residual length is known, a pair whose table distance
exceeds the link radius by more than that length can't be a link, and all others get
their exact cosine in double precision from the vectors as given. No step loses a
link, so the result is that of brute force. The price: where vectors are spread out
so that most lists are within reach of most vectors, most pairs of blocks are
compared, and the work grows with the square of the rows.

Equal vectors are one entry with a weight. Near lists are packed into blocks, large
ones cut by a hash of the id, and a task sees one pair of blocks, so no list is one
task; tasks return sums of links and a spanning forest of the links found, never
the pairs.

Defined cases: null, empty or zero vectors and vectors with null, nan or infinite
components link with nothing; vectors link within their own dimension only, each
dimension being a run of its own; every row is a vector of its own, so rows of one
id stay several rows and equal ones link with each other; rows with a null id are
linked like others, but name a component only where all its ids are null; an empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common, graph

COSINE = 0.95
#: Vectors for fitting at most (a hash of the id draws them), subspaces, codes, vectors to a list.
SAMPLE, SUBSPACES, CODES, PER_LIST, MOST_LISTS = 20_000, 8, 64, 800, 4096
#: Rows of a block; more from so many blocks on, while a block has at most so many components.
BLOCK, BLOCKS, COMPONENTS = 4096, 32, 4 << 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = x[np.random.default_rng(7).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centroids and residual codebooks, fitted on a sample of unit vectors."""

    def __init__(self, x: np.ndarray, lists: int):
        self.centres = _kmeans(x, lists)
        self.parts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        rest = x - self.centres[_nearest(x, self.centres)]
        self.books = [_kmeans(rest[:, p], CODES) for p in self.parts]

    def reached(self, x: np.ndarray, home: np.ndarray, cosine: float) -> np.ndarray:
        """For each row and list, whether the list can hold a link of the row.

        With c0 the row's own centre, |x - c|^2 - |x - c0|^2 is at most 0 for the vectors of list c
        and changes by at most 2 |c - c0| for each unit of distance.
        """
        square = (self.centres**2).sum(1)
        apart = square - 2 * x @ self.centres.T
        apart -= np.take_along_axis(apart, home[:, None], 1)
        between = np.sqrt(np.maximum(square + square[home][:, None] - 2 * self.centres[home] @ self.centres.T, 0))
        return apart <= 2 * np.sqrt(2 - 2 * cosine) * between + 1e-6

    def order(self) -> list[int]:
        """The lists as a chain, each followed by the nearest one left."""
        left, at, out = np.ones(len(self.centres), bool), 0, []
        for _ in range(len(self.centres)):
            left[at] = False
            out.append(at)
            at = int(np.where(left, ((self.centres - self.centres[at]) ** 2).sum(1), np.inf).argmin())
        return out

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the length of what the codes leave out."""
        codes = np.stack([_nearest(rest[:, p], book) for p, book in zip(self.parts, self.books, strict=True)], axis=1)
        gone = sum(((rest[:, p] - book[codes[:, i]]) ** 2).sum(1) for i, (p, book) in enumerate(zip(self.parts, self.books, strict=True)))
        return codes, np.sqrt(gone)

    def distances(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of query residuals to coded residuals, by one lookup table for each query and subspace."""
        total = np.zeros((len(queries), len(codes)), np.float32)
        for i, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            table = ((queries[:, None, p] - book[None]) ** 2).sum(2).astype(np.float32)
            total += table[:, codes[:, i]]
        return total


def _unit(table: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least label that each of n nodes reaches by the links i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _layout(index: Index, counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, n) of each list: it has the blocks from first on, n of them. Lists in a row share a block while they fit."""
    first, n = np.zeros(len(index.centres), np.int64), np.ones(len(index.centres), np.int64)
    block, filled = 0, 0
    for k in index.order():
        rows = counts.get(k, 0)
        if filled and filled + rows > size:
            block, filled = block + 1, 0
        first[k], n[k] = block, max(1, -(-rows // size))
        block, filled = (block + n[k], 0) if n[k] > 1 else (block, filled + rows)
    return first, n


def _links(index: Index, entries: pa.Table, queries: pa.Table, same: bool, cosine: float) -> pa.Table:
    """Links of one pair of blocks, or in one block: (id, n) sums and (u, v) forest links with n = 0."""
    x, q = _unit(entries), _unit(queries)
    eid, qid = (t.column("id").to_numpy().astype(np.int64) for t in (entries, queries))
    ew, qw = (t.column("weight").to_numpy().astype(np.int64) for t in (entries, queries))
    home, own = (t.column("home").to_numpy().astype(np.int64) for t in (entries, queries))
    lists = []
    for centre in np.unique(home):
        at = np.flatnonzero(home == centre)
        codes, gone = index.codes(x[at] - index.centres[centre])
        lists.append((centre, at, codes, (np.sqrt(2 - 2 * cosine) + gone + 1e-3).astype(np.float32) ** 2))
    n_e, n_q, us, vs = np.zeros(len(eid), np.int64), np.zeros(len(qid), np.int64), [], []
    for a in range(0, len(qid), 512):
        reached = index.reached(q[a : a + 512], own[a : a + 512], cosine)
        for centre, at, codes, radius in lists:
            asked = a + np.flatnonzero(reached[:, centre])
            near_q, near_e = np.nonzero(index.distances(q[asked] - index.centres[centre], codes) <= radius)
            near_q, near_e = asked[near_q], at[near_e]
            if same:
                keep = qid[near_q] < eid[near_e]
                near_q, near_e = near_q[keep], near_e[keep]
            exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", q[near_q[b : b + 65536]], x[near_e[b : b + 65536]]) for b in range(0, len(near_q), 65536))]) >= cosine
            i, j = near_q[exact], near_e[exact]
            n_q += np.bincount(i, ew[j], len(qid)).astype(np.int64)
            n_e += np.bincount(j, qw[i], len(eid)).astype(np.int64)
            if len(i):
                names, place = np.unique(np.concatenate([qid[i], eid[j]]), return_inverse=True)
                label = _forest(place[: len(i)], place[len(i) :], len(names))
                us.append(names[label != np.arange(len(names))])
                vs.append(names[label[label != np.arange(len(names))]])
    q_on, e_on = n_q > 0, n_e > 0
    us, vs = np.concatenate([np.zeros(0, np.int64), *us]), np.concatenate([np.zeros(0, np.int64), *vs])
    ids, ns = np.concatenate([qid[q_on], eid[e_on]]), np.concatenate([n_q[q_on], n_e[e_on]])
    return pa.table({"u": np.concatenate([ids, us]), "v": np.concatenate([ids, vs]), "n": np.concatenate([ns, np.zeros(len(us), np.int64)])})


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each of rows (vec_id, embedding)."""
    rows = rows.select("vec_id", F.col("embedding").alias("v"))
    good = F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    # Equal vectors are one entry, under a number of its own: ids may be null or belong to several vectors.
    entries = rows.where("good").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    entries = common.staged(entries.withColumn("id", F.monotonically_increasing_id()), "entries")
    found = [_linked(entries.where(F.size("v") == r["d"]), r["d"], r["count"], cosine) for r in entries.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()]  # a row for each dimension
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found:
        links = common.staged(reduce(DataFrame.union, [n for n, _ in found]), "link-sums")
        groups = common.staged(graph.components(reduce(DataFrame.union, [g for _, g in found])), "components")
        # The least vec_id of each component, from partial sums; a component may be large, so its row is salted.
        named = groups.join(entries.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
        named = common.staged(named, "component-names")
        groups = common.salted_join(groups, named.drop("n"), ["component"], named.select("component", "n"), ["id"]).select("id", "component_id")
        per = entries.join(links, "id", "left").join(groups, "id", "left")
        per = per.select("v", F.col("weight").alias("n"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
        per = common.staged(per, "per-entry")
        out = common.salted_join(rows.where("good"), per.drop("n"), ["v"], per.select("v", "n"), ["vec_id"])
        alone = out.select("vec_id", "n_links", "component_id").union(alone)
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(entries: DataFrame, width: int, total: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) sums of links and (u, v) links that join the components of entries (v, id, weight) of one dimension."""
    spark = entries.sparkSession
    share = min(1.0, SAMPLE / total)
    sample = entries.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) <= int(share * 1_000_000)).orderBy("id").select("v").toArrow()
    if sample.num_rows == 0:
        sample = entries.select("v").limit(SAMPLE).toArrow()
    lists = min(MOST_LISTS, max(1, sample.num_rows // 4), max(16, total // PER_LIST))
    index = Index(_unit(sample), lists)
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("int")
    def homes(v: pa.Array) -> pa.Array:
        return pa.array(_nearest(_unit(pa.record_batch({"v": v})), shared.value.centres) if len(v) else [], pa.int32())

    entries = entries.select("id", "weight", "v")
    homed = entries.withColumn("home", homes("v"))
    counts = {r["home"]: r["count"] for r in homed.groupBy("home").count().collect()}  # a row for each list
    first, n = _layout(index, counts, max(BLOCK, min(total // BLOCKS, COMPONENTS // width)))

    @F.arrow_udf("array<int>")
    def reached(v: pa.Array, home: pa.Array) -> pa.Array:
        x, own, out = _unit(pa.record_batch({"v": v})) if len(v) else np.zeros((0, width)), home.to_numpy(zero_copy_only=False), []
        steps = np.zeros((len(first), int((first + n).max()) + 1), np.int32)
        steps[np.arange(len(first)), first], steps[np.arange(len(first)), first + n] = 1, -1
        covers = np.cumsum(steps, axis=1).astype(np.float32)
        for a in range(0, len(x), 512):
            on = shared.value.reached(x[a : a + 512], own[a : a + 512], cosine).astype(np.float32) @ covers > 0
            out += [np.flatnonzero(row) for row in on]
        return pa.array(out, pa.list_(pa.int32()))

    at = F.element_at(F.create_map(*[c for k in counts for c in (F.lit(k), F.struct(F.lit(int(first[k])).alias("first"), F.lit(int(n[k])).alias("n")))]), F.col("home"))
    placed = homed.withColumn("_at", at).withColumn("block", (F.col("_at.first") + F.pmod(F.xxhash64("id"), F.col("_at.n"))).cast("int"))
    # A link is in reach from both of its ends, so each pair of blocks meets once.
    pairs = placed.select("id", "weight", "v", "home", "block", F.explode(reached("v", "home")).alias("other"))
    pairs = pairs.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "id", "weight", "v", "home", "block")

    def meet(rows: pa.Table) -> pa.Table:
        a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        left, right = (rows.filter(pc.equal(rows.column("block"), k)) for k in (a, b))
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("u", "v", "n")})
        return _links(shared.value, left, right, a == b, cosine)

    found = common.staged(pairs.groupBy("a", "b").applyInArrow(meet, "u long, v long, n long"), "links-found")
    return found.where("n > 0").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("n")), found.where("n = 0").select("u", "v")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more between all embeddings."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
