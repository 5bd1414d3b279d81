"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of an Arrow batch to a Python worker, unless the session names its own: 10,000 long rows would be too much.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; also lets Python workers started elsewhere find this package, and bounds the Arrow batches they get by bytes."""
    env = spark.sparkContext.environment
    if spark.sparkContext.getConf().get(ARROW_BYTES) is None:
        spark.conf.set(ARROW_BYTES, str(4 << 20))
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep) and ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage is cut, and a lost executor loses no work."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sampled(rows: DataFrame, most: int, keys: list[str], count: int | None = None) -> DataFrame:
    """All of rows, or about `most` of them drawn by a 63-bit hash of keys; `count` is the number of rows if known.

    If the hash draws none (few different keys, each in very many rows), the `most` rows of least hash.
    """
    count = rows.count() if count is None else count
    if count <= most:
        return rows
    drawn = F.shiftrightunsigned(F.xxhash64(*keys), 1)
    some = rows.where(drawn < F.lit(int(most / count * 2**63)))
    return rows.orderBy(drawn).limit(most) if some.isEmpty() else some


#: Rows of one key that a join may put into one task, and hot keys at most, whose list is broadcast; beyond, the rows a key may have grow.
HOT_ROWS, MOST_HOT = 1000, 20_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left (many rows a key) joined with right (one row a key); keys with many rows of left are split over salted copies of right's row.

    counts: (keys, n), the rows of left by key, cheap to read. by: columns of left that tell its rows of a key apart.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(HOT_ROWS, total // MOST_HOT)
    hot = counts.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).cast("int").alias("_salts"))
    found = hot.collect()  # at most MOST_HOT rows
    if not found:
        return left.join(right, keys, how)
    side = F.broadcast(left.sparkSession.createDataFrame(found, hot.schema))
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0)).cast("int")
    many = left.join(side, keys, "left").withColumn("_salt", salt).drop("_salts")
    copies = right.join(side, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return many.join(copies, [*keys, "_salt"], how).drop("_salt")


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, nulls as empty texts; text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return at - at[0], raw


def slices(batches, column: str, most_bytes: int = 4 << 20):
    """The batches cut into pieces of whole rows whose texts hold about most_bytes (one longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)).astype(np.int64)
        bins = np.cumsum(lengths) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


#: Spaces between words: the six ASCII ones.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = 0x9E3779B97F4A7C15 | 1
_TABLE = None
_POWERS: list[np.ndarray] = []
_HELD: list = [None, None]


def held(key: tuple | None, make=lambda: None):
    """What a worker keeps between tasks, made once: the state of one operator at a time, so that of another is let go first."""
    if _HELD[0] != key:
        _HELD[:] = [None, None]
        _POWERS.clear()
        gc.collect()
        _HELD[:] = [key, make()]
        give_back()
    return _HELD[1]


def give_back() -> None:
    """To be called after a partition or a batch: what is free inside the heap goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_ODD and its inverse to the powers 0..n, modulo 2**64."""

    def to(size: int) -> list[np.ndarray]:
        both = [np.full(size, np.uint64(base), np.uint64) for base in (_ODD, pow(_ODD, -1, 1 << 64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        return both

    if n >= 1 << 20:
        return tuple(to(n + 1))  # for a very long text only, not kept
    if not _POWERS:
        _POWERS[:] = to(1 << 20)
    return _POWERS[0], _POWERS[1]


def spans(offsets: np.ndarray, raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every run of bytes that are no breaks; breaks is a table of 256 booleans."""
    if len(raw) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~breaks[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offsets, start, side="right") - 1, start, end


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:end], by one running polynomial over the bytes."""
    global _TABLE
    if _TABLE is None:
        _TABLE = mix(np.arange(1, 257, dtype=np.uint64))
    power, inverse = _powers(len(raw))
    run = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLE[raw] * power[: len(raw)], out=run[1:])
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of every word: a run without ASCII white space."""
    return spans(offsets, raw, _SPACE)


class Remembered:
    """Results by key in a worker, about `most` keys of `LETTERS` letters each at a time; on overflow those stay that were asked for again."""

    LETTERS = 16

    def __init__(self, most: int):
        self.most, self.of, self.again = most, {}, set()

    def missing(self, keys: set) -> set:
        """The keys without a result; the others are marked as asked for again."""
        new = keys.difference(self.of)
        self.again |= keys - new
        return new

    def trim(self) -> None:
        """To be called between batches."""
        room = self.most * self.LETTERS
        if len(self.of) > self.most or sum(map(len, self.of)) > room:
            self.of = {k: self.of[k] for k in self.again if k in self.of}
            self.again = set()
            if len(self.of) > self.most // 2 or sum(map(len, self.of)) > room // 2:
                self.of = {}
