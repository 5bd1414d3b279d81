"""Byte-level BPE encoding and decoding by DuckDB recursive queries in each partition.

A text is cut by the published pattern; pieces that are tokens as a whole are
looked up. All other pieces that a worker hasn't met become token-position rows
of a DuckDB table. A recursive query joins neighbouring rows with the merge table
(left id, right id -> merged id) and contracts every word's leftmost pair of least
rank, until no pair is left. A round sees the rows of the one before, and a word's
rows leave the recursion when it has no pair left; those of earlier rounds are
dropped. Decoding joins ids with the vocabulary and aggregates the bytes in order of
position.

The merge table has the size of the vocabulary, whatever the corpus. What a worker
remembers (chunks and pieces with their ids) is bounded by CACHE; it saves work
and changes no result.

One round contracts all places of a word's least pair, from the left and without
overlap. That equals one place after another wherever a contraction gives no pair of
lower rank, which holds if every token comes from its own bytes by contractions of
ranks up to its own: neighbours that could be joined at a lower rank would have been
joined before. `ordered` checks this for the rank file, token by token; for a file
that fails it the query contracts one place in a round, for all words.

Defined cases: a null text is encoded as an empty one, to no ids; repeated rows
are encoded alike; null or empty ids decode to empty bytes; an unknown id is an
error. Columns of the input stay; clashing `ids` or `decoded` are replaced.
"""

from __future__ import annotations

import base64
import functools
import re
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from memloom.llm import common

CACHE = 400_000
#: Words, and bytes of them, in one recursive query (a longer word stands alone).
WORDS, WORD_BYTES = 50_000, 1 << 19
#: Texts of these characters with single spaces and line ends only, whose chunks can be cut one by one.
_PLAIN = re.compile(r"[\n -~¡-ɏ]*\Z")

#: All places of the least pair at once, from the left and without overlap (only pairs of twins can overlap). `q` is word and position in one number.
_MERGE = """
WITH RECURSIVE step(w, q, id, next_q, next_id, done) AS (
  SELECT w, w::BIGINT * 4294967296 + p, id, w::BIGINT * 4294967296 + next_p, next_id, false FROM pos
  UNION ALL (
    WITH pair AS MATERIALIZED (SELECT s.w, s.q, s.id, s.next_q, s.next_id, m.merged FROM (SELECT * FROM step WHERE NOT done) s LEFT JOIN merges m ON s.id = m.left_id AND s.next_id = m.right_id),
    best AS MATERIALIZED (SELECT w, min(merged) AS k FROM pair GROUP BY w),
    site AS MATERIALIZED (SELECT a.q, a.next_q AS gone, b.k, a.id = a.next_id AS twins FROM pair a JOIN best b USING (w) WHERE a.merged = b.k),
    run AS (SELECT *, row_number() OVER o AS n, lag(gone) OVER o IS DISTINCT FROM q AS fresh FROM site WHERE twins WINDOW o AS (ORDER BY q)),
    taken AS (SELECT q, gone, k FROM site WHERE NOT twins UNION ALL SELECT q, gone, k FROM (SELECT *, max(CASE WHEN fresh THEN n END) OVER (ORDER BY q) AS since FROM run) WHERE (n - since) % 2 = 0),
    edit AS MATERIALIZED (SELECT t.q, t.gone, t.k, g.next_q, g.next_id FROM taken t JOIN pair g ON g.q = t.gone)
    SELECT a.w, a.q, coalesce(t.k, a.id), CASE WHEN t.k IS NULL THEN a.next_q ELSE t.next_q END, coalesce(n.k, CASE WHEN t.k IS NULL THEN a.next_id ELSE t.next_id END), b.k IS NULL
    FROM pair a JOIN best b USING (w) LEFT JOIN edit t ON t.q = a.q LEFT JOIN edit n ON n.q = coalesce(t.next_q, a.next_q) WHERE a.q NOT IN (SELECT gone FROM edit)
  )
) SELECT w, id FROM step WHERE done ORDER BY q"""
#: One place in a round, for rank files that are not ordered.
_MERGE_ONE = """
WITH RECURSIVE step(w, p, id, next_p, next_id, done) AS (
  SELECT w, p, id, next_p, next_id, false FROM pos
  UNION ALL (
    WITH pair AS MATERIALIZED (SELECT s.w, s.p, s.id, s.next_p, s.next_id, m.merged::BIGINT * 4294967296 + s.p AS k FROM (SELECT * FROM step WHERE NOT done) s LEFT JOIN merges m ON s.id = m.left_id AND s.next_id = m.right_id),
    best AS (SELECT w, min(k) AS k, arg_min(next_p, k) AS gone FROM pair GROUP BY w),
    hit AS MATERIALIZED (SELECT b.w, (b.k >> 32)::INT AS merged, (b.k & 4294967295)::INT AS p, b.gone, g.next_p, g.next_id FROM best b LEFT JOIN pair g ON g.w = b.w AND g.p = b.gone)
    SELECT a.w, a.p, CASE WHEN a.p = h.p THEN h.merged ELSE a.id END, CASE WHEN a.p = h.p THEN h.next_p ELSE a.next_p END,
      CASE WHEN a.p = h.p THEN h.next_id WHEN a.next_p = h.p THEN h.merged ELSE a.next_id END, h.p IS NULL
    FROM pair a JOIN hit h ON a.w = h.w WHERE a.p IS DISTINCT FROM h.gone
  )
) SELECT w, id FROM step WHERE done ORDER BY w, p"""
_DECODE = "SELECT d, list(token ORDER BY p) AS tokens FROM (SELECT pos.d, pos.p, coalesce(v.token, error('unknown id')) AS token FROM pos LEFT JOIN vocabulary v USING (id)) GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose joined bytes are a token."""
    rows = [(left, right, r) for t, r in ranks.items() for k in range(1, len(t)) if (left := ranks.get(t[:k])) is not None and (right := ranks.get(t[k:])) is not None]
    left, right, merged = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "merged": pa.array(merged, pa.int32())})


@functools.cache
def ordered(path: str) -> bool:
    """Whether every token comes from its own bytes by contractions of ranks up to its own."""
    ranks = read_ranks(path)
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            least, at = min((ranks.get(a + b, len(ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least > rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


class Coder:
    """One worker's DuckDB with the merge table and the vocabulary."""

    def __init__(self, path: str, pattern: str, at_once: bool = True):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cut = regex.compile(pattern).findall
        self.query = _MERGE if at_once else _MERGE_ONE
        self.spill = tempfile.TemporaryDirectory()  # for one query over a word of many megabytes; gone with the worker's state
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": self.spill.name})
        for name, rows in (("merges", merge_table(self.ranks)), ("vocabulary", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "token": pa.array(self.ranks.keys(), pa.binary())}))):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.pieces, self.first, self.later = (common.Remembered(CACHE) for _ in range(3))

    @staticmethod
    def of(path: str, pattern: str, at_once: bool = True) -> Coder:
        return common.held(("bpe", path, pattern, at_once), lambda: Coder(path, pattern, at_once))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty) from its single bytes on."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        ids, last = self.byte[flat], np.zeros(len(flat), bool)
        last[np.cumsum(sizes) - 1] = True
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        self.db.register("pos", pa.table({"w": w, "p": at, "id": ids, "next_p": pa.array(at + 1, mask=last), "next_id": pa.array(np.roll(ids, -1), mask=last)}))
        found = self.db.sql(self.query).to_arrow_table()
        ids = found["id"].to_numpy().astype("<u4").tobytes()
        ends = 4 * np.searchsorted(found["w"].to_numpy(), np.arange(1, len(words) + 1))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Adds the ids of pieces that aren't known yet."""
        new, sizes, known = [], [], self.pieces.of
        for piece in self.pieces.missing(pieces):
            word = piece.encode()
            if (whole := self.ranks.get(word)) is not None:
                known[piece] = whole.to_bytes(4, "little")
            else:
                new.append((piece, word))
                sizes.append(len(word))
        bins = np.maximum(np.cumsum(np.array(sizes, np.int64)) // WORD_BYTES, np.arange(len(new)) // WORDS)
        cuts = [0, *(np.flatnonzero(np.diff(bins)) + 1).tolist(), len(new)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                known.update(zip([p for p, _ in new[a:b]], self.merge([w for _, w in new[a:b]]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        for kept in (self.pieces, self.first, self.later):
            kept.trim()
        plain = [bool(_PLAIN.match(t)) and not (t.startswith(" ") or t.endswith(" ") or "  " in t or " \n" in t or "\n " in t) for t in texts]
        cut = [None if ok else self.cut(t) for t, ok in zip(texts, plain, strict=True)]
        pieces = {p for some in cut if some for p in some}
        # Chunks between single spaces: each is met once a batch, however often it occurs.
        lists = pc.split_pattern(pa.array([t for t, ok in zip(texts, plain, strict=True) if ok], pa.large_string()), " ")
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary.to_pylist()
        edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        heads = [names[i] for i in chunks.indices.to_numpy()[edges[:-1]].tolist()]
        new = [(self.first.of, c, self.cut(c)) for c in self.first.missing(set(heads))] + [(self.later.of, c, self.cut(" " + c)) for c in self.later.missing(set(names))]
        for _, _, some in new:
            pieces.update(some)
        self.learn(pieces)
        ids = self.pieces.of.__getitem__
        for known, chunk, some in new:
            known[chunk] = b"".join(map(ids, some))
        coded = pa.array(list(map(self.later.of.__getitem__, names)), pa.large_binary()).take(chunks.indices)
        data, ends = memoryview(coded.buffers()[2] or b""), np.frombuffer(coded.buffers()[1], np.int64)
        starts, stops = ends[edges[:-1] + 1].tolist(), ends[edges[1:]].tolist()
        rows = (self.first.of[h] + data[a:b] for h, a, b in zip(heads, starts, stops, strict=True))
        return [next(rows) if some is None else b"".join(map(ids, some)) for some in cut]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        sizes = np.fromiter((len(r) // 4 for r in rows), np.int64, len(rows))
        if not sizes.sum():
            return [b""] * len(rows)
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
        self.db.register("pos", pa.table({"d": np.repeat(np.arange(len(rows)), sizes), "p": at, "id": ids}))
        found = self.db.sql(_DECODE).to_arrow_table()
        out = [b""] * len(rows)
        for chunk in found.to_batches():
            lists = chunk.column("tokens")
            tokens = lists.values.cast(pa.large_binary())
            ends = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset :]
            data = memoryview(tokens.buffers()[2] or b"")
            edges = ends[lists.offsets.to_numpy()]
            for d, a, b in zip(chunk.column("d").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out[d] = bytes(data[a:b])
        return out


def _mapped(rows: DataFrame, source: str, path: str, pattern: str, steps: tuple[str, ...]) -> DataFrame:
    """rows with the columns that steps name (ids, decoded), made batch by batch in one worker."""
    rows, at_once = rows.drop(*steps), ordered(path)

    def work(batches):
        coder = Coder.of(path, pattern, at_once)
        for batch in common.slices(batches, source, 4 << 20):
            columns, names = list(batch.columns), list(batch.schema.names)
            given = batch.column(source).to_pylist()
            for step in steps:
                given = coder.encode([t or "" for t in given]) if step == "ids" else coder.decode([i or b"" for i in given])
                columns.append(pa.array(given, pa.binary()))
                names.append(step)
            yield pa.record_batch(columns, names=names)

    schema = StructType([*rows.schema.fields, *(StructField(step, BinaryType()) for step in steps)])
    return rows.mapInArrow(work, schema)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids: the token ids of the text as little-endian unsigned 32-bit bytes."""
    return _mapped(docs, "text", path, pattern, ("ids",))


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """rows with decoded: the bytes that ids stand for."""
    return _mapped(rows, "ids", path, pattern, ("decoded",))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids and with decoded, which is made from ids alone."""
    return _mapped(docs, "text", path, pattern, ("ids", "decoded"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = round_trip(docs, path, pattern)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
