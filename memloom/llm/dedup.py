"""Near-duplicate documents by BagMinHash.

A document is the bag of its five-word shingles (words are runs without ASCII
white space; a text of one to four words is one shingle). Its signature is a
BagMinHash: for every shingle, Poisson processes run over the axis of weights,
cut at 1, 2, 4, 8, ...; a process over more than one unit of weight is split in
halves again and again, down to the units that the shingle's multiplicity covers.
Every point falls to one of HASHES components, and a component keeps its earliest
point, so two components agree with a probability of the weighted Jaccard
similarity. Points beyond the latest component are never drawn.

Equal bags become one representative. Representatives that agree on a band of ROWS
components are candidates. First each member of a bucket meets the bucket's least
id (a join, no pairs within buckets) and is verified by its exact multiset overlap
from the whole texts. Members of buckets that then still hold several components
bring their bags along and are compared in blocks inside tasks: by signature, then
exactly, and only while they are in different components. Tasks give the links that
join components, never the pairs. Connected components of all links are the classes.

A pair at the threshold is missed by all bands with a probability below 1e-4, and
its signatures agree less than AGREE with one of about 2e-5; nothing else is left
out, and no bucket is capped.

Defined cases: null texts and texts without a word link with nothing; a null id
stays alone; repeated rows of one id are one document, of the least of their texts;
an empty table gives no rows; extra columns are not read. The pipeline's stage keeps
of the rows of one id the least, and every row without an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common, graph

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
AGREE = 0.68
#: Bytes of text that are hashed at a time; a longer text stands alone.
SLICE = 1 << 19
#: Ids of candidates are broadcast up to so many and joined by shuffle beyond.
MOST_IDS = 1_000_000
#: Members of a block of a bucket, and rows of a task; bytes of their bags, as a mean.
BLOCK, TASK_ROWS, BLOCK_BYTES, TASK_BYTES = 1000, 20_000, 8 << 20, 32 << 20

_STEP, _SIDE, _ROOT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)


def shingles(offsets: np.ndarray, raw: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every shingle, in order of text."""
    doc, start, end = common.words(offsets, raw)
    h = common.hashes(raw, start, end)
    many = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(many) - many
    place = np.arange(len(doc)) - first[doc]
    # A shingle starts where a full window fits, or at the first word of a shorter text.
    heads = np.flatnonzero((place + words <= many[doc]) | (place == 0))
    out = np.zeros(len(heads), np.uint64)
    for k in range(words):
        at = np.minimum(heads + k, max(len(h) - 1, 0))
        out = out * np.uint64(0x100000001B3) + np.where(place[heads] + k < many[doc[heads]], h[at], np.uint64(k + 1))
    return doc[heads], common.mix(out)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_min_hash(doc: np.ndarray, element: np.ndarray, count: np.ndarray, n: int, hashes: int = HASHES) -> np.ndarray:
    """The earliest point of each component for n bags, given as rows (bag, element, count) without repeats."""
    h = np.full(n * hashes, np.inf)
    weight = np.bincount(doc, count, n)
    horizon = hashes * (np.log(hashes) + 4.0) / np.maximum(weight, 1.0)
    # One process for each power of two that a count reaches into: [0, 1), [1, 2), [2, 4), ...
    parts, low, width, level = [], 0, 1, 0
    rows = np.arange(len(doc))
    while len(rows):
        parts.append((doc[rows], common.mix(element[rows] ^ np.uint64(int(_ROOT) * (level + 1) % 2**64)), np.full(len(rows), low, np.int64), np.full(len(rows), width, np.int64), count[rows].astype(np.int64)))
        low, width, level = (1, 1, 1) if low == 0 else (low + width, 2 * width, level + 1)
        rows = rows[count[rows] > low]
    if not parts:
        return h.reshape(n, hashes)
    d, key, low, width, top = (np.concatenate(x) for x in zip(*parts, strict=True))
    t = -np.log(_uniform(key)) / width
    waiting = []
    limit = horizon.copy()
    while True:
        late = t >= horizon[d]
        if late.any():
            waiting.append(tuple(x[late] for x in (d, key, low, width, top, t)))
        on = t < limit[d]
        d, key, low, width, top, t = (x[on] for x in (d, key, low, width, top, t))
        if not len(d):
            latest = h.reshape(n, hashes).max(1)
            short = np.isinf(latest) & (weight > 0)
            if not short.any():
                return h.reshape(n, hashes)
            # Few bags: some component has no point before the horizon. They go on from where they stopped.
            horizon = np.where(short, 2 * horizon, 0.0)
            limit = horizon.copy()
            d, key, low, width, top, t = (np.concatenate(x) for x in zip(*waiting, strict=True))
            keep = short[d]
            d, key, low, width, top, t = (x[keep] for x in (d, key, low, width, top, t))
            waiting = []
            continue
        unit = width == 1
        at = common.mix(key[unit] + _SIDE)
        np.minimum.at(h, d[unit] * hashes + (at % np.uint64(hashes)).astype(np.int64), t[unit])
        limit = np.minimum(limit, h.reshape(n, hashes).max(1))
        next_key = common.mix(key[unit] + _STEP)
        moved = (d[unit], next_key, low[unit], width[unit], top[unit], t[unit] - np.log(_uniform(next_key)))
        if unit.all():
            d, key, low, width, top, t = moved
            continue
        # Halves: one has the point, the other draws its own first point after it.
        sd, sk, sl, sw, st, stt = (x[~unit] for x in (d, key, low, width, top, t))
        half = sw // 2
        right = common.mix(sk + _SIDE) & np.uint64(1) == 1
        has_key, other_key = common.mix(sk ^ _SIDE), common.mix(sk ^ _ROOT)
        has = (sd, has_key, sl + np.where(right, half, 0), half, st, stt)
        other = (sd, other_key, sl + np.where(right, 0, half), half, st, stt - np.log(_uniform(other_key)) / half)
        d, key, low, width, top, t = (np.concatenate(x) for x in zip(moved, has, other, strict=True))
        inside = low < top
        d, key, low, width, top, t = (x[inside] for x in (d, key, low, width, top, t))


def _bags(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (text, shingle, count) without repeats."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(head)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n, k1, k2, sig, bands): bag size and checksums, 16 bits of each component, and a hash of each band."""

    def sign(batches):
        common.held(None)
        for batch in common.slices(batches, "text", SLICE):
            offsets, raw = common.utf8(batch.column("text"))
            n = batch.num_rows
            doc, h = shingles(offsets, raw)
            size = np.bincount(doc, minlength=n)
            some = np.flatnonzero(size)
            sums = np.zeros((2, n), np.uint64)
            if len(some):
                heads = (np.cumsum(size) - size)[some]
                for k, salt in enumerate((_STEP, _SIDE)):
                    sums[k, some] = np.add.reduceat(common.mix(h ^ salt), heads)
            bits = bag_min_hash(*_bags(doc, h), n).view(np.uint64)
            short = common.mix(bits.ravel()) & np.uint64(0xFFFF)
            sig = short.astype("<u2").reshape(n, HASHES)
            bands = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP, (n, 1))
            for k in range(ROWS):
                bands = common.mix(bands ^ short.reshape(n, BANDS, ROWS)[:, :, k])
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()), "n": size.astype(np.int64), "k1": sums[0].view(np.int64), "k2": sums[1].view(np.int64),
                    "sig": pa.array([r.tobytes() for r in sig], pa.binary()), "bands": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, bands.view(np.int64).ravel()),
                }
            )
        common.give_back()

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, k1 long, k2 long, sig binary, bands array<long>")


def verified(pairs: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """pairs (u, v) whose sizes and signatures allow it, with their exact overlap as sim. held: (doc_id, n, sig, text)."""

    @F.arrow_udf("double")
    def agreement(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(s.to_pylist()), "<u2").reshape(len(s), HASHES) for s in (a, b))
        return pa.array((x == y).mean(1) if len(x) else np.zeros(0))

    @F.arrow_udf("double")
    def overlap(a: pa.Array, b: pa.Array) -> pa.Array:
        out = pa.array(overlaps(a, b))
        common.give_back()
        return out

    side = lambda k: held.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}"))
    per = lambda df: df.groupBy("u").agg(F.count("*").alias("n"))
    # v has a pair in each band at most; u may be the lead of many and comes last, in salted copies: its text is never sent along with each of its pairs.
    near = common.salted_join(pairs.join(side("v"), "v"), side("u"), ["u"], per(pairs), ["v"])
    near = near.where(F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * similarity)
    near = common.staged(near.withColumn("agree", agreement("sig_u", "sig_v")).where(F.col("agree") >= AGREE).select("u", "v"), "near")
    text = lambda k: held.select(F.col("doc_id").alias(k), F.col("text").alias(f"text_{k}"))
    near = common.salted_join(near.join(text("v"), "v"), text("u"), ["u"], per(near), ["v"])
    return near.select("u", "v", overlap("text_u", "text_v").alias("sim"))


def overlaps(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The weighted Jaccard similarity of the shingle bags of each pair of texts."""
    out = [np.zeros(0)]
    for batch in common.slices([pa.record_batch({"a": left, "b": right})], "a", SLICE):
        sides = []
        for k, name in enumerate("ab"):
            d, h, c = _bags(*shingles(*common.utf8(batch.column(name))))
            sides.append((d, h, c if k == 0 else 0 * c, 0 * c if k == 0 else c))
        d, h, a, b = (np.concatenate(x) for x in zip(*sides, strict=True))
        order = np.lexsort((h, d))
        d, h, a, b = d[order], h[order], a[order], b[order]
        head = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1]))) if len(d) else np.zeros(0, np.int64)
        a, b = (np.add.reduceat(x, head) if len(d) else x for x in (a, b))
        low, high = (np.bincount(d[head], x, batch.num_rows) for x in (np.minimum(a, b), np.maximum(a, b)))
        out.append(low / np.maximum(high, 1))
    return np.concatenate(out)


def keys(texts: pa.Array) -> pa.Array:
    """Each text's bag as a sorted set of 64-bit keys, one for each occurrence of a shingle: overlaps of sets are those of bags."""
    out = []
    for batch in common.slices([pa.record_batch({"text": texts})], "text", SLICE):
        doc, h = shingles(*common.utf8(batch.column("text")))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        at = np.arange(len(doc))
        fresh = np.append(True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])) if len(doc) else np.zeros(0, bool)
        again = at - np.maximum.accumulate(np.where(fresh, at, 0)) if len(doc) else at
        key = common.mix(h + again.astype(np.uint64) * _STEP)
        key = key[np.lexsort((key, doc))].astype("<u8").tobytes()
        ends = 8 * np.cumsum(np.bincount(doc, minlength=batch.num_rows))
        out += [key[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pa.array(out, pa.binary())


def _keys(texts: pa.Array) -> pa.Array:
    out = keys(texts)
    common.give_back()
    return out


def _against(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The similarity of a bag's keys to each of others."""
    sizes = np.array([len(x) for x in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return both / (len(one) + sizes - both)


def _cross_links(table: pa.Table, similarity: float) -> pa.Table:
    """Links between different components in each bucket of the table (in one bucket as many as join its components).

    A pair is looked at in the first band that it shares, and there only while its members are still apart.
    """
    bucket, band, ids, n, comp, block = (table.column(c).to_numpy() for c in ("bucket", "band", "id", "n", "comp0", "block"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
    bags = [np.frombuffer(x, "<u8") for x in table.column("bag").to_pylist()]
    order = np.argsort(bucket, kind="stable")
    us, vs = [], []
    for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else ():
        label, k = comp[rows].copy(), int(band[rows[0]]) * ROWS
        left = right = np.arange(len(rows))
        if len(halves := np.unique(block[rows])) > 1:
            left, right = (np.flatnonzero(block[rows] == x) for x in halves)
        for at, i in enumerate(left):
            j = right[at + 1 :] if left is right else right
            size, sizes = n[rows[i]], n[rows[j]]
            j = j[(label[j] != label[i]) & (np.minimum(sizes, size) >= np.maximum(sizes, size) * similarity)]
            for a in range(0, len(j), 256):
                some = j[a : a + 256]
                same = sig[rows[some]] == sig[rows[i]]
                earlier = same[:, :k].reshape(len(some), k // ROWS, ROWS).all(2).any(1)
                some = some[(same.mean(1) >= AGREE) & ~earlier & (label[some] != label[i])]
                if not len(some):
                    continue
                for x in some[_against(bags[rows[i]], [bags[rows[x]] for x in some]) >= similarity]:
                    if label[x] != label[i]:
                        us.append(min(ids[rows[i]], ids[rows[x]])), vs.append(max(ids[rows[i]], ids[rows[x]]))
                        label[label == label[x]] = label[i]
    return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) of each doc_id: the least id of its class, and whether it is that one itself."""
    known = docs.where("doc_id is not null").select("doc_id", "text")
    twice = common.staged(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if not twice.isEmpty():
        known = known.join(twice, "doc_id", "left_anti").union(known.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    marks = common.staged(signatures(known), "signatures")
    bags = marks.where("n > 0")
    reps = common.staged(bags.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "representatives")
    own = bags.join(reps.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    band = own.select(F.col("doc_id").alias("id"), "n", F.posexplode("bands").alias("band", "bucket"))
    lead = common.staged(band.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("members")).where("members > 1"), "leads")
    shared = common.salted_join(band, lead, ["bucket"], lead.select("bucket", F.col("members").alias("n")), ["id"])
    shared = common.staged(shared.where("id != lead"), "buckets")
    # What verification needs of the documents that share a bucket at all, written once.
    ids = common.staged(shared.select(F.col("id").alias("doc_id")).union(shared.select("lead")).distinct(), "candidate-ids")
    side = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    held = known.join(side, "doc_id", "left_semi").join(bags.join(side, "doc_id", "left_semi").select("doc_id", "n", "sig"), "doc_id")
    held = common.staged(held, "candidates")
    pairs = common.staged(shared.select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct(), "pairs")
    # Written before it is filtered: a filter right above would run the function twice, in two workers a task.
    links = common.staged(verified(pairs, held, similarity), "verified").where(F.col("sim") >= similarity)
    groups = common.staged(graph.components(links.select("u", "v")), "components")
    # Buckets that still hold several components, without their lead, whom all have met.
    wide = shared.where("members > 2").join(groups.withColumnRenamed("component", "comp0"), "id", "left").withColumn("comp0", F.coalesce("comp0", "id"))
    wide = common.staged(wide.select("bucket", "band", "id", "n", "comp0"), "wide-buckets")
    mixed = wide.groupBy("bucket").agg(F.min("comp0").alias("a"), F.max("comp0").alias("b"), F.count("*").alias("k"), F.sum("n").alias("all")).where("a < b").select("bucket", "k", "all")
    mixed = common.staged(mixed, "mixed")
    rest = common.salted_join(wide, mixed, ["bucket"], mixed.select("bucket", F.col("k").alias("n")), ["id"])
    rest = common.staged(rest.select("bucket", "band", "k", "all", "id", "n", "comp0"), "mixed-buckets")
    many = rest.agg(F.count("*").alias("rows"), F.sum("n").alias("keys")).first()
    if many["rows"]:
        bag = F.arrow_udf(_keys, "binary")
        content = held.join(rest.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "sig", bag("text").alias("bag"))
        tasks = max(1, -(-many["rows"] // TASK_ROWS), -(-8 * many["keys"] // TASK_BYTES))
        blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("all") * 8 / BLOCK_BYTES)).cast("int")
        at = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(content, "id")
        at = at.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        alone = F.col("blocks") == 1
        by = [F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(tasks))).otherwise(F.col("bucket")).alias("t"), F.least("block", "to").alias("x"), F.greatest("block", "to").alias("y"), alone.alias("z")]

        def compare(table: pa.Table) -> pa.Table:
            out = _cross_links(table, similarity)
            common.give_back()
            return out

        new = common.staged(at.groupBy(*by).applyInArrow(compare, "u long, v long"), "cross-links")
        if not new.isEmpty():
            groups = common.staged(graph.components(links.select("u", "v").union(new)), "components")
    grouped = reps.join(groups, "id", "left").select("k1", "k2", F.col("n").alias("size"), F.coalesce("component", "id").alias("class_id"))
    copies = reps.select("k1", "k2", F.col("n").alias("size"), F.col("copies").alias("n"))
    out = common.salted_join(bags.select("doc_id", "k1", "k2", F.col("n").alias("size")), grouped, ["k1", "k2", "size"], copies, ["doc_id"]).select("doc_id", "class_id")
    out = out.union(marks.where("n = 0").select("doc_id", "doc_id"))
    alone = docs.where("doc_id is null").select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return out.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op2_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return classes(common.table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class (and those without an id), columns as they came."""
    stay = classes(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept"))
    out = docs.join(stay, docs["doc_id"] == stay["_kept"], "left_semi")
    n = out.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if n["n"] != n["d"]:
        names = sorted(docs.columns, key=lambda c: c != "text")
        out = out.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.struct(*names)).alias("_row")).select([F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return out.unionByName(docs.where("doc_id is null"))
