"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed over the whole text, for many texts at once, from
byte classes and word hashes. Trees are grown on quantile histograms of a
bounded sample of labelled rows, then flattened into arrays (feature,
threshold, leaf) of complete binary trees that numpy walks level by level for a
whole batch. Only the text is an input of a score.

Defined cases: a null text counts as empty; empty texts get the score that the
trees give to all-zero statistics; repeated rows are scored alike; without
labelled rows every score is 0.5 (kept); with one class only, scores lie on that
class's side of 0.5. Columns of the input stay; a clashing `score` is replaced
(the pipeline's stage keeps the input's own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common

#: At most about so many labelled rows fit the trees (a hash of the id draws them).
MAX_TRAIN = 20_000
#: Bytes of text whose statistics are made at a time, each of which takes some tens of bytes; a longer text stands alone.
SLICE = 1 << 19
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 80, 4, 64, 0.15, 1.0, 5

_CLASSES = ("upper", "lower", "digit", "space", "newline", "bang", "bar", "symbol", "stop", "punct", "high", "other")
_CLASS = np.full(256, 11, np.int64)
for _i in range(256):
    _c = chr(_i)
    if _i >= 128:
        _CLASS[_i] = 10
    elif _c.isupper():
        _CLASS[_i] = 0
    elif _c.islower():
        _CLASS[_i] = 1
    elif _c.isdigit():
        _CLASS[_i] = 2
    elif _c in "\n\r":
        _CLASS[_i] = 4
    elif _c.isspace():
        _CLASS[_i] = 3
    elif _c in "!?":
        _CLASS[_i] = 5
    elif _c == "|":
        _CLASS[_i] = 6
    elif _c in "#*$%&<>@^~=+_{}[]\\/":
        _CLASS[_i] = 7
    elif _c in ".,;:":
        _CLASS[_i] = 8
    elif _c in "'\"()-`":
        _CLASS[_i] = 9
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True

FEATURES = (*_CLASSES, "log_bytes", "log_words", "word_bytes", "word_bytes_dev", "words_per_line", "next_same", "near_same", "distinct_words", "repeat_lines")


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text."""
    offsets, raw = common.utf8(column)
    n, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    if len(raw) == 0:
        return out
    row = np.repeat(np.arange(n), sizes)
    k = len(_CLASSES)
    counts = np.bincount(row * k + _CLASS[raw], minlength=n * k).reshape(n, k)
    # Capital letters of the Latin-1 block: C3 80 .. C3 9E.
    capital = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E))
    counts[:, 0] += np.bincount(row[capital], minlength=n)
    out[:, :k] = counts / np.maximum(sizes, 1)[:, None]
    doc, start, end = common.words(offsets, raw)
    many = np.maximum(np.bincount(doc, minlength=n), 1)
    h, length = common.hashes(raw, start, end), (end - start).astype(float)
    mean = np.bincount(doc, length, n) / many
    out[:, k] = np.log1p(sizes)
    out[:, k + 1] = np.log1p(np.bincount(doc, minlength=n))
    out[:, k + 2] = mean
    out[:, k + 3] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / many - mean**2, 0))
    line_doc, line_start, line_end = common.spans(offsets, raw, _LINE)
    lines = np.maximum(np.bincount(line_doc, minlength=n), 1)
    out[:, k + 4] = np.log1p(np.bincount(doc, minlength=n) / lines)
    for gap, at in ((1, 5), (2, 6)):
        same = (h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])
        out[:, k + at] = np.bincount(doc[gap:][same], minlength=n) / many
    for at, (d, x, of) in ((7, (doc, h, many)), (8, (line_doc, common.hashes(raw, line_start, line_end), lines))):
        order = np.lexsort((x, d))
        d, x = d[order], x[order]
        fresh = np.ones(len(d), bool)
        fresh[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
        out[:, k + at] = np.bincount(d[fresh], minlength=n) / of
    return out


class Trees:
    """Boosted complete binary trees as arrays: node i of a level-ordered tree has the children 2i + 1 and 2i + 2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    inner = 2**DEPTH - 1
    rate = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    none = Trees(float(np.log(rate / (1 - rate))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(y) == 0 or y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    total, features, thresholds, leaves = np.full(len(y), none.base), [], [], []
    flat = binned + np.arange(x.shape[1]) * BINS
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for depth in range(DEPTH):
            first, wide = 2**depth - 1, 2**depth
            key = ((node - first)[:, None] * (x.shape[1] * BINS) + flat).ravel()
            size = wide * x.shape[1] * BINS
            gs, hs, ns = (np.bincount(key, np.repeat(v, x.shape[1]), size).reshape(wide, x.shape[1], BINS).cumsum(2) for v in (g, h, np.ones(len(y))))
            gt, ht, nt = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
            best = gain.reshape(wide, -1).argmax(1)
            for i, b in enumerate(best):
                j, cut = divmod(int(b), BINS)
                if gain[i, j, cut] > 1e-9 and cut < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][cut]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        node -= inner
        leaf = -RATE * np.bincount(node, g, inner + 1) / (np.bincount(node, h, inner + 1) + RIDGE)
        total = total + leaf[node]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(none.base, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: the rows that no model may learn from."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees for labels.quality from at most about max_train labelled rows that are not held out."""
    marks = held_out(labels.select("doc_id", F.col("quality").cast("int").alias("quality"))).where("not held_out and quality is not null")
    marks = marks.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marks = common.sampled(marks, max_train, ["doc_id"])
    marks = F.broadcast(marks)  # about max_train rows at most, so texts needn't be shuffled

    @F.arrow_udf("array<double>")
    def stats(text: pa.Array) -> pa.Array:
        common.held(None)
        parts = [statistics(b.column("text")) for b in common.slices([pa.record_batch({"text": text})], "text", SLICE)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
        return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES), rows.ravel())

    rows = docs.select("doc_id", "text").join(marks, "doc_id").select("doc_id", stats("text").alias("x"), "quality")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).toPandas().sort_values("doc_id")  # one text of each id that was drawn
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["quality"].to_numpy(float))


def score(docs: DataFrame, trees: Trees) -> DataFrame:
    """docs with score (0 to 1; higher: label 1 likelier)."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def scored(text: pa.Array) -> pa.Array:
        common.held(None)
        parts = [shared.value.score(statistics(b.column("text"))) for b in common.slices([pa.record_batch({"text": text})], "text", SLICE)]
        common.give_back()
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn("score", scored("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by the boosted trees."""
    docs = common.table(spark, sf_dir, "documents")
    trees = train(docs, common.table(spark, sf_dir, "labels"))
    out = held_out(score(docs.select("doc_id", "text"), trees))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with a score of 0.5 or more, columns as they came."""
    trees = train(docs, common.table(spark, sf_dir, "labels"))
    names = docs.columns
    out = score(docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(names)}).withColumn("text", F.col(f"in_{names.index('text')}")), trees)
    return out.where("score >= 0.5").select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
