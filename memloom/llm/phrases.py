"""Phrase collocation mining: word-id suffix arrays by numpy prefix doubling in each shard, LCP intervals as n-gram counts, merged by key.

A shard is a run of about SHARD words of a partition. Its words get ids, its suffix
array is sorted by prefix doubling (1, 2, then 4 words, the longest phrase), and
runs of neighbours whose common prefix has n words or more are the shard's n-grams,
their lengths the counts. Words are told apart in a shard, and filtered, by 64-bit
hashes; what is merged over shards and returned is counted by its text.

Only phrases with `least` occurrences matter, as candidates and as their parts, and
each part of such a phrase has as many itself. So n-grams are counted by hash for
n = 1, 2, 3 in turn, each time only those whose parts of n - 1 words may be frequent,
and a last pass gives the texts of what is left for n = 1 to 4. "May be" is a bit
array of FILTER_BITS by hash: it can let too much through, which the merged counts
then leave out, but holds nothing back. It has the same size for every input
(8 MiB, also broadcast); where it fills up, more is shuffled and the result is the same.

Hot words and languages: counts are combined in each shard and again before each
shuffle; the best of each language are ranked within parts of it first.

Defined cases: a null text is empty; a null lang is `und`, together with a lang
written so; rows that repeat count each; an empty table gives no rows; extra columns are
not read. A shard may cut a text anywhere: its last suffixes see three more words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import common

LEAST, LONGEST, BEST = 30, 4, 2000
#: A phrase goes if a longer one that holds it has this share (in percent) of its occurrences.
COVERED = 80
SCALE = 2_000_000
#: Words of a shard, bytes of text taken at a time, and the bits of a filter (as a power of two).
SHARD, SLICE, FILTER_BITS = 1 << 20, 1 << 19, 26
#: Parts of a language that are ranked by themselves first.
PARTS = 64

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BREAK = _SEPARATOR.copy()
_BREAK[[0x20, 0x09]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of its first words and that of its last word."""
    return common.mix(left * _STEP + right)


class Shard:
    """Words of one or more whole texts: hash (language included), whether it goes on from the word before, language, and its text."""

    def __init__(self, texts: bool):
        self.texts, self.langs, self.known = texts, [], {}
        self.clear()

    def clear(self) -> None:
        self.parts, self.n = [], 0

    def _lang(self, name: str | None) -> int:
        name = "und" if name is None else name
        if name not in self.known:
            self.known[name] = len(self.langs)
            self.langs.append((name, int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")))
        return self.known[name]

    def add(self, batch: pa.RecordBatch) -> None:
        offsets, raw = common.utf8(batch.column("text"))
        text, start, end = common.spans(offsets, raw, _BREAK)
        if len(text) == 0:
            return
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        ruled = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_SEPARATOR[raw], out=ruled[1:])
        linked = np.zeros(len(text), bool)
        linked[1:] = (text[1:] == text[:-1]) & (ruled[start[1:]] == ruled[end[:-1]])
        del ruled
        langs = np.array([self._lang(x) for x in batch.column("lang").to_pylist()], np.int32)[text]
        salt = np.array([x[1] for x in self.langs], np.uint64)
        hashed = np.empty(len(text), np.uint64)
        for a in range(0, len(text), 1 << 16):  # the running hash takes many bytes for each byte
            b = min(len(text), a + (1 << 16))
            at = start[a]
            hashed[a:b] = common.hashes(raw[at : end[b - 1]], start[a:b] - at, end[a:b] - at)
        hashed = common.mix(hashed ^ salt[langs])
        plain = None
        if self.texts:  # words with one space after each
            length = end - start + 1
            after = np.cumsum(length)
            plain = np.full(after[-1], 0x20, np.uint8)
            inside = np.ones(after[-1], bool)
            inside[after - 1] = False
            edge = np.zeros(len(raw) + 1, np.int8)
            edge[start] += 1
            edge[end] -= 1  # words never touch
            plain[inside] = raw[np.cumsum(edge[:-1]).astype(bool)]
            plain = (plain, length)
        self.parts.append((hashed, linked, langs, plain))
        self.n += len(text)

    def windows(self) -> Iterator[tuple]:
        """(hashes, linked, langs, (bytes, offsets) or None, starts): pieces of about SHARD words; only the first `starts` begin phrases, the rest are seen from them."""
        hashed, linked, langs = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        text = None
        if self.texts:
            length = np.concatenate([p[3][1] for p in self.parts])
            text = np.concatenate([p[3][0] for p in self.parts]), np.concatenate([[0], np.cumsum(length)])
        for a in range(0, self.n, SHARD):
            b = min(self.n, a + SHARD)
            c = min(self.n, b + LONGEST - 1)
            yield hashed[a:c], linked[a:c], langs[a:c], None if text is None else (text[0], text[1][a : c + 1]), b - a


def intervals(ids: np.ndarray, linked: np.ndarray, longest: int, starts: int, shortest: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, word, count) for n = shortest to longest: the LCP intervals of n words as one place (the index of a first word) and how often it occurs.

    ids: from 1 on, 0 for words that no phrase holds. linked: whether a word goes on from the one before it.
    """
    place = np.arange(len(ids)) + np.cumsum(~linked)  # a 0 before each piece
    if len(place) == 0:
        return
    line = np.zeros(place[-1] + 1 + 2 * longest, np.int64)
    line[place] = ids
    word = np.zeros(len(line), np.int64)
    word[place] = np.arange(len(ids))
    held = place[ids > 0]
    rank, depth = line, 1
    while 2 * depth < longest:  # prefix doubling; the last step orders the suffixes themselves
        key = rank[held] * (rank.max() + 1) + rank[held + depth]
        rank, depth = np.zeros(len(line), np.int64), 2 * depth
        rank[held] = np.unique(key, return_inverse=True)[1] + 1
    suffixes = place[:starts][ids[:starts] > 0]
    for n in range(1, shortest):  # shorter ones begin no phrase that is asked for
        suffixes = suffixes[line[suffixes + n] > 0]
    if len(suffixes) == 0:
        return
    key = rank[suffixes] * (rank.max() + 1) + rank[suffixes + depth] if longest > 1 else rank[suffixes]
    suffixes = suffixes[np.argsort(key, kind="stable")]
    whole, common_prefix = np.ones(len(suffixes), bool), np.ones(len(suffixes) - 1, bool)
    for n in range(1, longest + 1):
        here = line[suffixes + n - 1]
        whole &= here > 0
        common_prefix &= (here[1:] == here[:-1]) & (here[1:] > 0)
        if n < shortest:
            continue
        first = np.flatnonzero(np.concatenate([[True], ~common_prefix]))
        count = np.diff(np.append(first, len(suffixes)))
        kept = whole[first]
        yield n, word[suffixes[first[kept]]], count[kept]


class Filters:
    """May a phrase of 1, 2, 3 words be frequent? Bit arrays by the leading bits of its hash."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits

    def passes(self, n: int, hashed: np.ndarray) -> np.ndarray:
        at = hashed >> np.uint64(64 - FILTER_BITS)
        return (self.bits[n - 1][at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _counted(shard: Shard, level: int, filters: Filters, longest: int) -> Iterator[tuple]:
    """(n, first words, counts, hashes by n, window) of a shard, filtered by all levels below `level`."""
    for hashed, linked, langs, text, starts in shard.windows():
        good = filters.passes(1, hashed) if level > 1 else np.ones(len(hashed), bool)
        ids = np.zeros(len(hashed), np.int64)
        ids[good] = np.unique(hashed[good], return_inverse=True)[1] + 1
        linked, by = linked.copy(), {1: hashed}
        for n in range(2, longest + 1):  # by[n][i] is the hash of words i to i + n - 1
            if len(hashed) < n:
                break
            by[n] = _joined(by[n - 1][:-1], hashed[n - 1 :])
        if level > 1:
            linked[1:] &= good[1:] & good[:-1]
            linked[0] = False
        if level > 2 and 2 in by:
            linked[1:] &= filters.passes(2, by[2])
        for n, word, count in intervals(ids, linked, longest, starts, 1 if level > 3 else level):
            if level > 3 and n >= 3:
                good = filters.passes(3, by[3][word])
                if n == 4:
                    good &= filters.passes(3, by[3][word + 1])
                word, count = word[good], count[good]
            yield n, word, count, by.get(n), langs, text


def _shards(batches, texts: bool) -> Iterator[Shard]:
    shard = Shard(texts)
    for batch in common.slices(batches, "text", SLICE):
        shard.add(batch)
        if shard.n >= SHARD:
            yield shard
            shard.clear()
    if shard.n:
        yield shard
    common.give_back()


_ROWS = 1 << 16


def _level(level: int, sent):
    """A function of batches (lang, text) to (lang, h, n): counts of n-grams of `level` words by hash; at level 1 also the words of each language, with a null h."""

    def run(batches):
        filters = sent and sent.value
        for shard in _shards(batches, False):
            for n, word, count, by, langs, _ in _counted(shard, level, filters, level):
                if n == level:
                    for a in range(0, len(word), _ROWS):
                        w = word[a : a + _ROWS]
                        lang = pa.DictionaryArray.from_arrays(pa.array(langs[w]), pa.array([x[0] for x in shard.langs])).cast(pa.string()) if level == 1 else pa.nulls(len(w), pa.string())
                        yield pa.RecordBatch.from_arrays([lang, pa.array(by[w].view(np.int64)), pa.array(count[a : a + _ROWS])], ["lang", "h", "n"])
            if level == 1:
                sizes = np.zeros(len(shard.langs), np.int64)
                for _, _, langs, _ in shard.parts:
                    sizes += np.bincount(langs, minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in shard.langs]), pa.nulls(len(sizes), pa.int64()), pa.array(sizes)], ["lang", "h", "n"])

    return run


def _texts(sent):
    """A function of batches (lang, text) to (lang, k, phrase, n) for phrases of 1 to LONGEST words that may be frequent."""

    def run(batches):
        for shard in _shards(batches, True):
            names = pa.array([x[0] for x in shard.langs])
            for n, word, count, _, langs, (raw, at) in _counted(shard, 4, sent.value, LONGEST):
                for a in range(0, len(word), _ROWS):
                    w = word[a : a + _ROWS]
                    length = at[w + n] - at[w] - 1
                    ends = np.cumsum(length)
                    spot = np.repeat(at[w] - ends + length, length) + np.arange(ends[-1])
                    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                    phrase = pa.StringArray.from_buffers(len(w), offsets, pa.py_buffer(raw[spot]))
                    lang = pa.DictionaryArray.from_arrays(pa.array(langs[w]), names).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(w), n, np.int32)), phrase, pa.array(count[a : a + _ROWS])], ["lang", "k", "phrase", "n"])

    return run


def _bits(frequent: DataFrame) -> np.ndarray:
    """The filter of hashes (h): at most 2**FILTER_BITS bits, whatever their number."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS) + 1
    parts = frequent.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for row in parts.toLocalIterator():
        part = np.frombuffer(row["bits"], np.uint8)
        a = (row["at"] - 1) * len(part)
        out[a : a + len(part)] = part[: len(out) - a]
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase, a) of all phrases of 1 to LONGEST words with a >= least, (lang, n) of all words)."""
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    bits, sizes, sent = [], None, None
    for level in (1, 2, 3):
        rows = docs.mapInArrow(_level(level, sent), "lang string, h long, n long")
        rows = rows.groupBy("lang", "h").agg(F.sum("n").alias("n")) if level == 1 else rows.groupBy("h").agg(F.sum("n").alias("n"))
        frequent = common.staged(rows.where((F.col("n") >= least) | F.col("h").isNull()), f"frequent-{level}")
        if level == 1:
            sizes = frequent.where("h is null").select("lang", "n")
        bits.append(_bits(frequent.where("h is not null")))
        sent = spark.sparkContext.broadcast(Filters(list(bits)))
    rows = docs.mapInArrow(_texts(sent), "lang string, k int, phrase string, n long")
    rows = rows.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return common.staged(rows, "phrases"), sizes


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of 2 to LONGEST words of each language of docs (lang, text)."""
    phrases, sizes = frequent_phrases(docs, least)
    candidates = phrases.where("k >= 2")
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"first": F.expr("substring_index(phrase, ' ', cut)"), "rest": F.expr("substring_index(phrase, ' ', cut - k)")})
    part = lambda name, out: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(out))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumn("score", F.expr(f"CAST(CAST({SCALE} AS DECIMAL(38, 0)) * a DIV (l + r) AS BIGINT)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    inner = candidates.where("k >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("size"))))
    inner = inner.select("lang", F.expr("substring_index(substring_index(phrase, ' ', at + size), ' ', -size)").alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = scored.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= best)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of all documents."""
    return collocations(common.table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, {LONGEST + 1}) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, a FROM f WHERE k >= 2),
cuts AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, CAST(CAST({SCALE} AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
subs AS (SELECT lang, array_to_string(w[i:i + j - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN subs USING (lang, phrase) JOIN sizes USING (lang) WHERE longer IS NULL OR 100 * longer < {COVERED} * a
QUALIFY rank <= {BEST}
"""
