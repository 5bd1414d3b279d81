"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and everything that is no letter becomes one kind of gap;
character 2- and 3-grams are hashed into BUCKETS columns. Counts by language
come from Spark (partial sums in each task, then a shuffle by bucket); the
smoothed log-probability matrix, languages x buckets, is broadcast (its size is
fixed by BUCKETS and the number of languages, which is checked) and whole batches
are scored by numpy gathers. The score is the posterior probability of the language
predicted. Only the text is an input of a prediction.

Defined cases: null texts and texts without a letter are `und` with score 0;
ties go to the language first in order; rows without lang teach nothing; with no
teaching rows all is `und`; repeated rows are predicted alike. Columns of the
input stay; clashing `lang_pred` and `score` are replaced. More than MOST_LANGS
languages are an error. The pipeline's stage drops null, empty and letterless texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common

BUCKETS = 1 << 15
#: At most about so many documents teach the model (a hash of the id draws them).
MAX_TRAIN = 20_000
#: More languages than this would make the broadcast matrix too large (64 MB at this bound).
MOST_LANGS = 512
#: Bytes of text whose grams are made at a time, each of which takes about a hundred bytes; a longer text stands alone.
SLICE = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")


def _folded() -> np.ndarray:
    """Code point -> itself for letters, 32 for all else; kept by a worker while it works for this operator."""
    return common.held(("langid",), lambda: np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every 2- and 3-gram that holds a letter."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    code = _folded()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), sizes)
    gap, rows, out = code == 32, [], []
    for n in (2, 3):
        m = len(code) - n + 1
        if m <= 0:
            continue
        x = np.full(m, np.uint64(n))
        blank = np.ones(m, bool)
        for i in range(n):
            x = x * np.uint64(0x100000001B3) + code[i : i + m]
            blank &= gap[i : i + m]
        keep = ~blank & (row[:m] == row[n - 1 :])
        x = (x[keep] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 15)
        rows.append(row[:m][keep])
        out.append(x.astype(np.int64))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(out)


def held_out(df: DataFrame) -> DataFrame:
    """Adds held_out: the rows that no model may learn from."""
    return df.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2)


class Model:
    def __init__(self, langs: list[str], logs: np.ndarray, prior: np.ndarray):
        self.langs, self.logs, self.prior = langs, logs, prior

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        row, bucket = grams(texts)
        total = np.stack([np.bincount(row, log[bucket], len(texts)) for log in self.logs], axis=1) + self.prior
        best = total.argmax(1)
        score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        blank = np.array([not _LETTER.search(t) for t in texts], bool)
        score[blank] = 0.0
        return ["und" if b else self.langs[i] for i, b in zip(best, blank, strict=True)], score


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from at most about max_train documents with a lang that are not held out."""
    rows = held_out(docs.select("doc_id", "lang", "text")).where("not held_out and lang is not null and text is not null")
    rows = common.sampled(rows, max_train, ["doc_id"], rows.select("doc_id").count())

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, "text", SLICE):
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            row, bucket = grams(texts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])[row]
            found = np.bincount(which * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            many = np.bincount([names.index(x) for x in langs], minlength=len(names))
            for name, c, m in zip(names, found, many, strict=True):
                sums[name] = sums.get(name, np.zeros(BUCKETS + 1, np.int64)) + np.append(c, m)
        for name, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.record_batch({"lang": pa.array([name] * len(at)), "bucket": pa.array(at), "n": pa.array(c[at])})

    some = [r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(some) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    found = rows.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + 1))
    counts[found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), found["bucket"].to_numpy(int)] = found["n"]
    if not langs:
        return Model([], np.zeros((0, BUCKETS)), np.zeros(0))
    logs = np.log((counts[:, :-1] + 0.5) / (counts[:, :-1].sum(1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    return Model(langs, logs, np.log((counts[:, -1] + 1) / (counts[:, -1] + 1).sum()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judged(text: pa.Array) -> pa.Array:
        langs, scores = [], [np.zeros(0)]
        for b in common.slices([pa.record_batch({"text": text})], "text", SLICE):
            found, score = shared.value.predict([t or "" for t in b.column("text").to_pylist()])
            langs += found
            scores.append(score)
        common.give_back()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], fields=list(kind))

    out = docs.withColumn("_judged", judged("text"))
    return out.withColumn("lang_pred", F.col("_judged.lang_pred")).withColumn("score", F.col("_judged.score")).drop("_judged")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by naive Bayes."""
    docs = common.table(spark, sf_dir, "documents")
    out = held_out(predict(docs.select("doc_id", "text"), train(docs)))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_known(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents whose language is predicted with a score of at least `least`, columns as they came."""
    names = docs.columns
    out = predict(docs.withColumnsRenamed({c: f"in_{i}" for i, c in enumerate(names)}).withColumn("text", F.col(f"in_{names.index('text')}")), train(docs))
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)])
