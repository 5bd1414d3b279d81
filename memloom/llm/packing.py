"""Best-fit packing of token sequences.

Best-two-fit: a sequence opens with the longest document left and is filled
greedily with the longest that still fit; then its smallest document is replaced
by two unpacked documents that fit the expanded gap more tightly.

What a sequence holds depends on lengths alone, so the method runs on the
histogram of lengths, which has one entry per possible length (4096) however
large the corpus is. Every step makes as many equal sequences as the counts
allow, until of one length fewer are left than such a sequence takes. The plan
(runs of equal sequences) is broadcast; documents find their places by their rank
among those of equal length, counted in salted groups, so a length that a third
of all documents share is no single task.

Defined cases: a null text is empty and holds only the end token; special tokens
written out in a text count as those tokens, as the tokenizers library reads them
by default; repeated rows
are packed as often as they occur; documents longer than a sequence are cut, the
last piece may be shorter; an empty table gives no rows; extra columns are not
read.
"""

from __future__ import annotations

import re
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import common

CAPACITY, END = 4096, 1
#: Least salts of a length's group, and rows for which one more is added.
LEAST_SALTS, ROWS_PER_SALT = 16, 4_000_000
#: Pieces whose ids a worker remembers before it starts over.
CACHE = 300_000
#: Texts of these characters only split at their white space alike everywhere; others go to the tokenizer whole.
_PLAIN = re.compile(r"[\t\n\r -~¡-ɏ]*\Z")


class _Mapped(dict):
    """Each character as the tokenizer's byte alphabet writes it, by code point."""

    def __init__(self):
        from tokenizers import pre_tokenizers

        self.alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def __missing__(self, code: int) -> str:
        self[code] = "".join(part for part, _ in self.alphabet.pre_tokenize_str(chr(code)))
        return self[code]


def _plain_pattern(stated: str) -> str:
    """The tokenizer's pattern for lower-cased plain texts: its classes of letters and numbers as sets of characters."""
    plain = sorted({x for c in map(chr, range(0x21, 0x250)) if _PLAIN.match(c) for x in c.lower()})  # lower-cased, some lie beyond
    of = {kind: "".join(re.escape(c) for c in plain if unicodedata.category(c).startswith(kind)) for kind in "LN"}
    return stated.replace(r"\p{L}", of["L"]).replace(r"\p{N}", of["N"])


class Encoder:
    """ids of a tokenizers file as little-endian unsigned 32-bit bytes.

    The file's tokenizer lower-cases, drops white space and cuts by a pattern, so a plain text is the row of its pieces,
    which are remembered. Pieces that are new go to the tokenizer's model one by one, since no merge crosses a piece.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.mapped = self.tokenizer.model, _Mapped()
        #: Written-out special tokens in a text are those tokens, as the tokenizer reads them by itself.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in stated["added_tokens"]) or r"(?!)", re.IGNORECASE).search
        self.cut = re.compile(_plain_pattern(stated["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])).findall
        self.pieces = common.Remembered(CACHE)

    @staticmethod
    def of(path: str) -> Encoder:
        return common.held(("packing", path), lambda: Encoder(path))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, wanted: set[str]) -> None:
        known, tokens, mapped = self.pieces.of, self.model.tokenize, self.mapped
        for p in self.pieces.missing(wanted):
            ids = [t.id for t in tokens(p if p.isascii() else p.translate(mapped))]
            known[p] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [self.cut(t.lower()) if _PLAIN.match(t) and not self.special(t) else None for t in texts]
        self.pieces.trim()
        self._learn(set().union(*filter(None, plain)))
        ids = self.pieces.of.__getitem__
        return [self.whole(t) if cut is None else b"".join(map(ids, cut)) for t, cut in zip(texts, plain, strict=True)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut to at most capacity ids; ids as bytes."""
    schema = "doc_id long, piece int, start long, length long, ids binary"
    step, last = 4 * capacity, int(end).to_bytes(4, "little")

    def cut(batches):
        encoder = Encoder.of(tokenizer)
        for batch in common.slices(batches, "text", 1 << 20):
            doc_ids, number, start, out = [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                ids += last
                for k, a in enumerate(range(0, len(ids), step)):
                    doc_ids.append(doc_id), number.append(k), start.append(a // 4), out.append(ids[a : a + step])
            held = pa.array(out, pa.binary())
            yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pc.divide(pc.binary_length(held), 4).cast(pa.int64()), "ids": held})
        common.give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of equal sequences: (how many, [(length, times)]). lengths: how many documents have each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    runs = []
    while (present := np.flatnonzero(left)).size:
        uses: dict[int, int] = {}
        gap, at = capacity, present.size - 1
        while gap and at >= 0:
            at = min(at, int(np.searchsorted(present, gap, side="right")) - 1)
            if at < 0:
                break
            length = int(present[at])
            # The longest opens a sequence; below it, as many of a length as fit and are left.
            times = min(gap // length, int(left[length]))
            uses[length] = times
            gap -= times * length
            at -= 1
        if gap and sum(uses.values()) > 1:
            gap = _two_for_one(uses, gap, left, present)
        many = min(int(left[length]) // times for length, times in uses.items())
        for length, times in uses.items():
            left[length] -= many * times
        runs.append((many, sorted(uses.items(), reverse=True)))
    return runs


def _two_for_one(uses: dict[int, int], gap: int, left: np.ndarray, present: np.ndarray) -> int:
    """Replaces the smallest document by the two unpacked ones that fill its place and the gap best, if they fill more."""
    small = min(uses)
    room = gap + small
    free = np.array([left[length] - uses.get(int(length), 0) for length in present])
    lengths, free = present[free > 0], free[free > 0]
    if lengths.size == 0:
        return gap
    other = np.searchsorted(lengths, room - lengths, side="right") - 1
    ok = other >= 0
    # A length of which one document is free can't pair with itself: the next shorter one then.
    alone = ok & (other == np.arange(lengths.size)) & (free < 2)
    other = np.where(alone, other - 1, other)
    ok = other >= 0
    total = np.where(ok, lengths + lengths[np.maximum(other, 0)], 0)
    best = int(total.argmax())
    if total[best] <= small or total[best] > room:
        return gap
    uses[small] -= 1
    if not uses[small]:
        del uses[small]
    for length in (int(lengths[best]), int(lengths[other[best]])):
        uses[length] = uses.get(length, 0) + 1
    return room - int(total[best])


def pack(rows: DataFrame, keys: list[str], capacity: int = CAPACITY) -> DataFrame:
    """rows (with a column length, 1 to capacity) and their sequence_id and offset; keys order rows of equal length."""
    counts = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    starts, first, times, offsets, seen, made = [], [], [], [], dict.fromkeys(counts, 0), 0
    for many, uses in plan(counts, capacity):
        offset = 0
        for length, k in uses:
            starts.append((length << 44) + seen[length]), first.append(made), times.append(k), offsets.append(offset)
            seen[length] += many * k
            offset += k * length
        made += many
    order = np.argsort(np.array(starts, np.int64))
    places = tuple(np.array(x, np.int64)[order] for x in (starts, first, times, offsets))
    shared = rows.sparkSession.sparkContext.broadcast(places)

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        starts, first, times, offsets = shared.value
        length, rank = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        key = (length << 44) + rank
        at = np.searchsorted(starts, key, side="right") - 1
        since = key - starts[at] if len(key) else key
        return pa.StructArray.from_arrays([pa.array(first[at] + since // times[at]), pa.array(offsets[at] + since % times[at] * length)], names=["sequence_id", "offset"])

    salts = max(LEAST_SALTS, -(-sum(counts.values()) // ROWS_PER_SALT))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*keys))
    ranked = salted.withColumn("_number", number).join(groups, ["length", "_salt"])
    placed = ranked.withColumn("_at", place(F.col("length").cast("long"), F.col("_before") + F.col("_number") - 1))
    return placed.select(*rows.columns, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from packed rows with ids: the token ids of every sequence in order, as bytes."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # a sequence holds at most capacity ids
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of docs."""
    cut = pieces(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(common.staged(cut, "pieces"), ["doc_id", "piece"])


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of docs with their places, by the cases above."""
    return pack_documents(docs)
