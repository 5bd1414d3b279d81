"""Packing, BPE, rules, sharding, quality and language against brute force, with the odd cases of every column."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from memloom.llm import bpe, common, langid, packing, quality, rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, ids string, shard string"
ODD = [
    (1, None, None, None, None, "x", "y", "z"),
    (2, "", "en", "s", 0, "x", "y", "z"),
    (3, " \n\t ", "en", "s", 4, "x", "y", "z"),
    (4, "one two", "en", None, 7, "x", "y", "z"),
    (5, "word " * 30_000, "en", "s", 1, "x", "y", "z"),
    (6, "tie tie tie", "en", "s", 1, "x", "y", "z"),
    (6, "tie tie tie", "en", "s", 1, "x", "y", "z"),
    (7, "tie tie tie", "de", "s", 1, "x", "y", "z"),
    (8, "héllo  wörld — 漢字 😂 <|endoftext|>\r\n it's I'LL", "fr", "s", 1, "x", "y", "z"),
    (9, "a" * 3000, "fr", "s", 1, "x", "y", "z"),
    (None, "no id at all", "fr", "s", 1, "x", "y", "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# --- packing -------------------------------------------------------------------------------------------------------


@functools.cache
def _tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path())


def _ids(text):
    return _tokenizer().encode(text or "", add_special_tokens=False).ids + [1]


def _check_packing(rows, docs):
    want = Counter()
    for doc_id, text in docs:
        ids = _ids(text)
        for k, a in enumerate(range(0, len(ids), 4096)):
            piece = ids[a : a + 4096]
            want[doc_id, k, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert want == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    return len(by)


def test_packing_odd_rows(odd, none):
    _check_packing(packing.pack_documents(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack_documents(none).count() == 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.op1_packing(spark, "/root/testdata/sf0.01").collect()
    made = _check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert made <= 1.01 * sum(r.length for r in rows) / 4096 + 1


def test_special_tokens_count_as_such():
    texts = ["hello <|endoftext|> world", "<|StartOfText|>", "a<|startoftext|>b c", "<|endoftext", "plain"]
    plain = [chr(c) for c in range(0x21, 0x250) if packing._PLAIN.match(chr(c))]
    texts += plain + [a + b for a in plain for b in ("İ", "'s", "Ə7", "\t")]  # some are lower-cased to letters outside
    assert packing.Encoder.of(packing.tokenizer_path()).encode(texts) == [np.array(_ids(t)[:-1], "<u4").tobytes() for t in texts]
    assert _ids(texts[0]) == [3306, 49407, 1002, 1]


def _filled(lengths, capacity):
    """Best-two-fit one sequence at a time: greedy filling, then the best two for the smallest."""
    left, made = sorted(lengths), []
    while left:
        held, gap = [], capacity
        for x in sorted(left, reverse=True):
            if x <= gap:
                held.append(x)
                gap -= x
        rest = list((Counter(left) - Counter(held)).elements())
        if gap and len(held) > 1:
            room = gap + held[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[:i] + rest[i + 1 :] if a + b <= room]
            if pairs and max(pairs)[0] > held[-1]:
                held = [*held[:-1], *max(pairs)[1:]]
        left = list((Counter(left) - Counter(held)).elements())
        made.append(sum(held))
    return made


def test_plan_equals_filling_one_by_one():
    rnd = random.Random(9)
    for most, capacity in ((5, 10), (20, 23), (60, 100), (100, 100)):
        for _ in range(12):
            lengths = [rnd.randint(1, most) for _ in range(rnd.randint(1, 60))]
            made = [sum(length * n for length, n in uses) for many, uses in packing.plan(dict(Counter(lengths)), capacity) for _ in range(many)]
            want = _filled(lengths, capacity)
            assert sum(made) == sum(lengths) and len(made) <= len(want) + 1 and made[0] == want[0]


def test_plan_uses_every_length_once():
    rnd = random.Random(3)
    for most in (7, 100, 4096):
        lengths = Counter(rnd.randint(1, most) for _ in range(rnd.randint(1, 3000)))
        used = Counter()
        for many, uses in packing.plan(dict(lengths), most):
            assert many > 0 and sum(length * n for length, n in uses) <= most
            for length, n in uses:
                used[length] += many * n
        assert used == lengths
    assert packing.plan({}) == []


def test_two_for_one_fits_tighter():
    # 6 + 3 leaves a gap of 1; the 3 gives way to 2 + 2, which fill it.
    runs = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert runs[0] == (1, [(6, 1), (2, 2)]) and runs[1] == (1, [(3, 1)])


def test_sequences_hold_the_ids(odd):
    cut = packing.pieces(odd.where("doc_id in (5, 6, 8)"), packing.tokenizer_path())
    made = packing.sequences(packing.pack(common.staged(cut, "t"), ["doc_id", "piece"])).collect()
    assert sum(len(r.ids) for r in made) // 4 == sum(len(_ids(t)) for i, t, *_ in ODD if i in (5, 6, 8))


# --- byte-level BPE --------------------------------------------------------------------------------------------------


def _reference():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


def test_bpe_equals_tiktoken(odd, none):
    path, want = _reference()
    rows = bpe.round_trip(odd, path, public_tokenizers.PATTERN).select("text", "ids", "decoded", "shard").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert bytes(r.ids) == np.array(want.encode_ordinary(r.text or ""), "<u4").tobytes()
        assert bytes(r.decoded) == (r.text or "").encode() and r.shard == "z"
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_random_texts():
    path, want = _reference()
    coder, rnd = bpe.Coder.of(path, public_tokenizers.PATTERN), random.Random(5)
    texts = ["".join(rnd.choice(letters) for _ in range(n)) for letters in ("ab", "abcé漢 \n\t'sx1!", "etaoin shrdlu", "aß́İ  \n") for n in (1, 5, 50, 400, 2000)]
    texts += [" lead", "trail ", "a \nb", "a\n b", "a\n\nb", "two  gaps", "\n", " "]
    assert coder.encode(texts) == [np.array(want.encode_ordinary(t), "<u4").tobytes() for t in texts]
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]


def test_bpe_long_words():
    """Any length by one query; what a worker keeps meanwhile is bounded."""
    path, want = _reference()
    assert bpe.ordered(path)
    rnd = random.Random(6)
    word = lambda n, letters="etaoinshrdlu": "".join(rnd.choice(letters) for _ in range(n))
    words = [word(n) for n in (127, 128, 129, 130, 1000, 5000)] + [word(n, "ab") for n in (130, 3000)] + ["a" * n for n in (129, 40_001)] + ["ab" * 4000, "=" * 9999, "漢" * 700]
    for at_once in (True, False):
        coder = bpe.Coder(path, public_tokenizers.PATTERN, at_once)
        some = words if at_once else [w for w in words if len(w) < 2000]
        assert coder.encode(some) == [np.array(want.encode_ordinary(w), "<u4").tobytes() for w in some]
    memory = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    coder = bpe.Coder(path, public_tokenizers.PATTERN)
    many, before = [word(100) for _ in range(4000)], memory()
    got = coder.encode(many[:2000]) + coder.encode(many[2000:])
    assert got == [np.array(want.encode_ordinary(w), "<u4").tobytes() for w in many] and memory() - before < 300


def test_bpe_unordered_ranks(tmp_path):
    """A file in which a merge gives a pair of lower rank: then one place in a round, as tiktoken does."""
    import base64

    import tiktoken

    tokens = [bytes([i]) for i in range(256)] + [b"aba", b"ab"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    want = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    assert not bpe.ordered(str(path))
    texts = ["abab", "ababab", "aabba", "babab"]
    assert bpe.Coder(str(path), public_tokenizers.PATTERN, False).encode(texts) == [np.array(want.encode_ordinary(t), "<u4").tobytes() for t in texts]


def test_bpe_query(spark, sf_dir):
    import hashlib

    _, want = _reference()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op3_bpe(spark, sf_dir).collect():
        ids = want.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_remembered_keeps_what_comes_again():
    kept = common.Remembered(4)
    for key in "abc":
        kept.of[key] = key
    assert kept.missing({"a", "z"}) == {"z"}
    kept.of |= {"x": "x", "y": "y"}
    kept.trim()
    assert kept.of == {"a": "a"}


# --- quality rules ---------------------------------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _word_statistics(text):
    text = text or ""
    words, at, covered = _WORD.findall(text), defaultdict(list), set()
    for k in range(len(words) - 4):
        at[tuple(words[k : k + 5])].append(k)
    for places in at.values():
        if len(places) > 1:
            covered.update(i for k in places for i in range(k, k + 5))
    seen, again = set(), 0
    for line in text.split("\n"):
        if _WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def test_word_statistics(spark, odd, none):
    extra = spark.createDataFrame([(20, "a b c d e f a b c d e\nx\nx\n\n \nx $$%", "en", "s", 1, "", "", ""), (21, "a a a a a a a", "en", "s", 1, "", "", "")], SCHEMA)
    for r in rules.statistics(odd.union(extra)).join(odd.union(extra).select(F.col("doc_id").alias("i"), "text"), F.col("doc_id") == F.col("i")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _word_statistics(r.text), r.doc_id
    assert rules.outliers(common.staged(rules.statistics(none), "t")).count() == 0
    judged = rules.outliers(common.staged(rules.statistics(odd), "t")).collect()
    assert len(judged) == len(ODD) and all(r.kept is not None and not (r.base_failed and r.kept) for r in judged)


def _distances(x, mean, cov):
    return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)


def _mcd(x, trials=60):
    """An independent estimate: random elemental starts, exact concentration steps, least determinant; (log det, distances, mean, cov)."""
    floor, rng, h, best = np.diag(rules.FLOOR), np.random.default_rng(0), int(np.ceil(rules.SHARE * len(x))), None
    for _ in range(trials):
        near = x[rng.choice(len(x), min(6, len(x)), replace=False)]
        for _ in range(30):
            mean, cov = near.mean(0), np.cov(near.T, bias=True) * rules.CONSISTENT + floor
            near = x[np.argsort(_distances(x, mean, cov), kind="stable")[:h]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True) * rules.CONSISTENT + floor
        found = (np.linalg.slogdet(cov)[1], _distances(x, mean, cov), mean, cov)
        best = found if best is None or found[0] < best[0] else best
    return best


def _near(got, x):
    """Distances close to those of the independent estimate (subsets differ by a distance bin) and the same verdicts."""
    want = _mcd(x)[1]
    assert np.median(np.abs(np.log1p(got) - np.log1p(want))) < 0.05 and ((np.array(got) > rules.CUTOFF) == (want > rules.CUTOFF)).all()


def test_estimate_has_the_least_determinant(spark):
    """Two clouds, a third of all rows far off in a tight one: one start would do for neither."""
    rng = np.random.default_rng(5)
    for share in (0.0, 0.1, 0.24):
        far = int(300 * share)
        x = np.vstack([rng.normal(size=(300 - far, 4)) @ np.array([[1, 0.6, 0, 0], [0, 1, 0, 0.3], [0, 0, 0.5, 0], [0, 0, 0, 2]]), rng.normal(size=(far, 4)) * 0.1 + [8, -8, 8, 4]])
        rows = spark.createDataFrame([(2, "en", "a", *map(float, r)) for r in x], f"{rules.POOL[0]} int, {rules.POOL[1]} string, {rules.POOL[2]} string, v1 double, v2 double, v3 double, v4 double")
        (found,) = rules.estimates(common.staged(rows, "t")).collect()
        assert found.log_det < _mcd(x)[0] + 0.15


def test_outliers_match_numpy_and_find_junk(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(400):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(30, 300))]
        if i % 20 == 0:
            words = [w + "$$$" for w in words]
        rows.append((i, " ".join(words), "en", "a", 1, "", "", ""))
    stats = common.staged(rules.statistics(spark.createDataFrame(rows, SCHEMA)), "t")
    got = {r.doc_id: r for r in rules.outliers(stats).collect()}
    x = np.array([[getattr(r, n) for n in rules.NAMES] for _, r in sorted(got.items())])
    _near([got[i].distance for i in range(400)], x)
    assert all(got[i].kept == (i % 20 != 0) for i in range(400))


def test_outliers_of_small_groups(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(160):  # 3 documents a source; en has 117, de 40, fr 3; source big has 40
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(30, 300))]
        if i % 20 == 1:
            words = [w + "$$$" for w in words]
        lang, source = ("fr", "few") if i < 3 else ("de", "big") if i < 43 else ("en", f"s{i // 3}")
        rows.append((i, " ".join(words), lang, source, 1, "", "", ""))
    stats = common.staged(rules.statistics(spark.createDataFrame(rows, SCHEMA)), "t")
    got = {r.doc_id: r for r in rules.outliers(stats).collect()}
    assert len(got) == 160 and all(got[i].kept == (i % 20 != 1) for i in range(160))
    x = np.array([[getattr(got[i], n) for n in rules.NAMES] for i in range(160)])
    # Each group lies between its own estimate and its language's, that between its own and that of all.
    between = lambda n, own, up: tuple((n * n * a + rules.HALF**2 * b) / (n * n + rules.HALF**2) for a, b in zip(own, up, strict=True))
    whole = _mcd(x)[2:]
    for a, b in ((0, 3), (3, 43), (43, 160)):
        tongue = between(b - a, _mcd(x[a:b])[2:], whole)
        for source in {got[i].source for i in range(a, b)}:
            of = [i for i in range(a, b) if got[i].source == source]
            want = _distances(x[of], *between(len(of), _mcd(x[of])[2:], tongue))
            assert np.median(np.abs(np.log1p([got[i].distance for i in of]) - np.log1p(want))) < 0.15


@pytest.mark.parametrize("n", [1, 2, 5, 24, 25, 60])
def test_group_of_any_size_is_judged(spark, n):
    """Junk goes and clean documents stay in a group of any size, beside a large one of its language."""
    rnd = random.Random(n)
    text = lambda junk: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + "$$$" * junk for _ in range(rnd.randint(30, 300)))
    rows = [(i, text(False), "en", "large" if i < 100 else "own", 1, "", "", "") for i in range(100 + n - 1)]
    rows.append((999, text(True), "en", "own", 1, "", "", ""))
    stats = common.staged(rules.statistics(spark.createDataFrame(rows, SCHEMA)), "t")
    assert {r.doc_id for r in rules.outliers(stats).collect() if not r.kept} == {999}


def test_rules_keep_clean_documents(spark):
    kept = rules.op6_rules(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("not base_failed")
    good, bad = (kept.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.995 and bad < 0.2


# --- sharding --------------------------------------------------------------------------------------------------------


def test_curve_visits_neighbours():
    places = sorted((sharding.curve_index([x, y, z], 3), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [i for i, _ in places] == list(range(512))
    for (_, a), (_, b) in zip(places, places[1:], strict=False):
        assert sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1


def _check_shards(rows, n):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    sizes = [len(by[k]) for k in range(40)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(by) <= set(range(40))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())


def test_shards(spark, sf_dir, odd, none):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = sharding.op5_sharding(spark, sf_dir).collect()
    _check_shards(rows, len(texts))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    _check_shards(sharding.hilbert_shards(odd).collect(), len(ODD))
    assert sharding.hilbert_shards(none).count() == 0


def test_shards_prune(spark):
    rows = sharding.op5_sharding(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id")
    spread = rows.groupBy("shard").agg(F.count_distinct("source").alias("s"), F.count_distinct("lang").alias("l")).agg(F.avg("s"), F.avg("l")).first()
    assert spread[0] < 8 and spread[1] < 3


# --- quality classifier ----------------------------------------------------------------------------------------------


def test_quality_held_out_accuracy(spark):
    out = quality.op9_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out")
    assert out.where("predicted = quality").count() > 0.99 * out.count() > 500


def test_held_out_is_never_learned(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"))
    marked = {r.doc_id: r.held_out for r in quality.held_out(docs).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 3 == 1) for k, v in marked.items())
    marked = {r.doc_id: r.held_out for r in langid.held_out(docs).collect()}
    assert all(v == (zlib.crc32(str(k).encode()) % 4 == 2) for k, v in marked.items())


def test_trees_equal_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.97
    for row, score in zip(x[:20], trees.score(x[:20]), strict=True):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += leaf[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-12


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(2, 1, 0), (3, None, 0), (None, 1, 1), (5, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        trees = quality.train(odd, given)
        rows = quality.score(odd, trees).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(none, trees).count() == 0


# --- language --------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    out = langid.op10_langid(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() > 0.98 * out.count() > 1000


def test_language_odd_rows(odd, none):
    model = langid.train(odd)
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rows[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.predict(odd, langid.train(none)).where("lang_pred != 'und'").count() == 0
    assert langid.predict(none, model).count() == 0


def test_too_many_languages_are_an_error(odd, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 1)
    with pytest.raises(ValueError):
        langid.train(odd)


def test_language_score_is_naive_bayes():
    rnd = random.Random(8)
    texts = ["ab ba", "abc", "xyz!", "x y z"] + ["".join(rnd.choice("abcdefgh xyz") for _ in range(rnd.randint(70, 900))) for _ in range(60)]
    logs = np.log(np.random.default_rng(2).dirichlet(np.full(langid.BUCKETS, 50.0), 2))
    model = langid.Model(["a", "b"], logs, np.log([0.3, 0.7]))
    langs, scores = model.predict(texts)
    for k, t in enumerate(texts):
        row, bucket = langid.grams([t])
        total = logs[:, bucket].sum(1) + np.log([0.3, 0.7])
        p = np.exp(total - total.max())
        assert langs[k] == "ab"[int(total.argmax())] and abs(scores[k] - p.max() / p.sum()) < 1e-9
