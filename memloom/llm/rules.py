"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Word statistics come from the whole text by array functions inside each row
(nothing is exploded). Four transformed statistics of the documents that pass
the base rule form a vector; for each language and source the minimum covariance
determinant estimate is found as by the deterministic algorithm for it: from each of
four starts (median and spread, mean and covariance, covariance of tanh, covariance
of directions), concentration steps take, again and again, mean and covariance of the
three quarters of the documents nearest by Mahalanobis distance, while that makes the
determinant less by SETTLED or more; the start with the least determinant gives the
estimate. Such estimates are made of each group, of each language and of all documents.
A group of n documents is judged by mean and covariance that lie between its own and
its language's, the language's between its own and those of all, with the weight
n^2 / (n^2 + HALF^2) for its own: so a group of any size, a single document too, is
judged, and no size switches from one way to another. A document is rejected where its
distance is beyond CUTOFF.

A concentration step is one aggregation: sums and products are gathered by
group and distance bin, the bins below the quantile are added up. Bins make the
quantile exact to BIN_STEP and the state of a group bounded. Estimates are one
short row a group and start; they are written after each step, and broadcast while there are at most MOST_GROUPS groups
and joined by shuffle beyond.

Defined cases: a null text has no words and fails the base rule; null lang or
source count as empty names; constant statistics keep a floor of variance, so
nothing is divided by zero; repeated rows are each counted and judged; extra columns
stay unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memloom.llm import common

SPACE = r"[\x20\x09-\x0D]+"
NAMES = ("v1", "v2", "v3", "v4")
#: Variance added to each statistic, so that a difference too small to matter is no outlier.
FLOOR = (0.16, 0.0225, 0.09, 0.09)
#: Share of the documents in the estimate, and the factor that makes its covariance consistent for four normal statistics: 0.75 / P(chi2_6 <= 5.385).
SHARE, CONSISTENT = 0.75, 1.485
#: Squared distance beyond which a document goes: chi2_4 at about 1 - 1e-9, for tails heavier than normal ones.
CUTOFF = 50.0
SETTLED, BIN_STEP, MOST_GROUPS = 0.01, 0.02, 20_000
#: Documents of a group whose own estimate weighs as much as its language's. In a group of three one far document is a third
#: of the scatter (0.33 of its squared distance); with the square and 30 that scatter weighs so little, in source and language
#: together (0.02), that such a document still stands at three times CUTOFF.
HALF = 30
#: What an estimate is made of: a group (level 2), a language (1, no source) or all documents (0, neither).
POOL = ("level", "pool_lang", "pool_source")
_SQUARES = [(i, j) for i in range(4) for j in range(i + 1)]
#: Mean and covariance of an estimate.
_MOMENTS = [*(f"m_{n}" for n in NAMES), *(f"c{i}{j}" for i, j in _SQUARES)]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each document."""
    ids = ["doc_id", "lang", "source"]
    text = F.coalesce("text", F.lit(""))
    a = docs.select(*ids, text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"))
    a = a.withColumn("n_words", F.size("words")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Each word is hashed once; a window is the hash of five of those numbers.
    a = a.withColumn("hashed", F.transform("words", lambda w: F.xxhash64(w)))
    gram = F.transform(F.sequence(F.lit(0), F.col("n_words") - 5), lambda i: F.xxhash64(*[F.get(F.col("hashed"), i + k) for k in range(5)]))
    b = a.select(
        *ids, F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n_words") >= 5, gram).otherwise(F.array().cast("array<bigint>")).alias("g"),
    )
    # Windows that occur again, sorted by hash, stand side by side; most texts have none and skip all that follows.
    again = F.size("g") > F.size(F.array_distinct("g"))
    pairs = F.sort_array(F.transform("g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    c = b.withColumn("s", F.when(again, pairs)).drop("g")
    same = lambda x, i: ((i > 0) & (F.get(F.col("s"), i - 1)["h"] == x["h"])) | (F.coalesce(F.get(F.col("s"), i + 1)["h"] == x["h"], F.lit(False)))
    d = c.withColumn("at", F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))).drop("s")
    # Each such window covers five words, or as many as the next one leaves it.
    covered = F.aggregate(F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("at"), i + 1) - p, F.lit(5)))), F.lit(0), lambda x, y: x + y)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("at")


def _vector(df: DataFrame) -> DataFrame:
    """Adds v1..v4: logarithms of length, word length, symbols per 100 characters, and repeated lines and words per 25 words."""
    words = F.col("n_words").cast("double")
    v = (
        F.log1p(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(words, F.lit(1.0))),
        F.log1p(F.col("n_symbols") * 100.0 / F.greatest(F.col("word_chars"), F.lit(1))),
        F.log1p((F.col("n_repeat_words") + F.col("n_dup_lines")) * 25.0 / F.greatest(words, F.lit(1.0))),
    )
    return df.withColumns(dict(zip(NAMES, v, strict=True)))


def _distance() -> Column:
    """Squared Mahalanobis distance: the norm of the inverse Cholesky factor (w11..w44) times the centred vector."""
    y = [F.col(n) - F.col(f"m_{n}") for n in NAMES]
    rows = [sum((F.col(f"w{i}{j}") * y[j] for j in range(i + 1)), F.lit(0.0)) for i in range(4)]
    return sum((r * r for r in rows), F.lit(0.0))


def _factor(estimate: DataFrame) -> DataFrame:
    """From mean and covariance (m_*, c_ij) of each group and start to the inverse Cholesky factor w_ij and the covariance's log determinant."""
    out = estimate
    for i in range(4):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(4):
        out = out.withColumn(f"w{i}{i}", 1.0 / F.col(f"l{i}{i}"))
        for j in range(i - 1, -1, -1):
            out = out.withColumn(f"w{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    out = out.withColumn("log_det", sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(4)), F.lit(0.0)))
    return out.select(*POOL, "start", "log_det", *_MOMENTS, *[f"w{i}{j}" for i, j in _SQUARES])


def _starts(rows: DataFrame, side) -> DataFrame:
    """Four starts for each pool: median and spread; mean and covariance; and, about the median, the covariances of tanh and of directions."""
    quart = lambda n: F.percentile_approx(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(f"q_{n}")
    base = rows.groupBy(*POOL).agg(*[quart(n) for n in NAMES])
    base = base.select(*POOL, *[F.get(F.col(f"q_{n}"), F.lit(1)).alias(f"m_{n}") for n in NAMES], *[F.sqrt(F.pow((F.get(F.col(f"q_{n}"), F.lit(2)) - F.get(F.col(f"q_{n}"), F.lit(0))) / 1.349, F.lit(2.0)) + FLOOR[i]).alias(f"d_{n}") for i, n in enumerate(NAMES)])
    base = common.staged(base, "medians")
    z = [(F.col(n) - F.col(f"m_{n}")) / F.col(f"d_{n}") for n in NAMES]
    norm = F.greatest(sum((x * x for x in z), F.lit(0.0)), F.lit(1e-12))
    squares = [(i, j) for i in range(4) for j in range(i + 1)]
    kinds = {"p": lambda i, j: F.avg(F.col(NAMES[i]) * F.col(NAMES[j])), "t": lambda i, j: F.avg(F.tanh(z[i]) * F.tanh(z[j])), "g": lambda i, j: 4 * F.avg(z[i] * z[j] / norm)}
    sums = rows.join(side(base), list(POOL)).groupBy(*POOL).agg(*[F.avg(n).alias(f"a_{n}") for n in NAMES], *[make(i, j).alias(f"{k}{i}{j}") for k, make in kinds.items() for i, j in squares])
    both = sums.join(side(base), list(POOL))
    spread = lambda i, j: F.col(f"d_{NAMES[i]}") * F.col(f"d_{NAMES[j]}")
    floor = lambda i, j: FLOOR[i] if i == j else 0.0
    cov = {
        0: lambda i, j: spread(i, j) if i == j else F.lit(0.0),
        1: lambda i, j: F.col(f"p{i}{j}") - F.col(f"a_{NAMES[i]}") * F.col(f"a_{NAMES[j]}") + floor(i, j),
        2: lambda i, j: F.col(f"t{i}{j}") * spread(i, j) + floor(i, j),
        3: lambda i, j: F.col(f"g{i}{j}") * spread(i, j) + floor(i, j),
    }
    kept = [F.struct(F.lit(k).alias("start"), *[F.col(f"{'a' if k == 1 else 'm'}_{n}").alias(f"m_{n}") for n in NAMES], *[make(i, j).alias(f"c{i}{j}") for i, j in squares]) for k, make in cov.items()]
    return _factor(both.select(*POOL, F.explode(F.array(*kept)).alias("_e")).select(*POOL, "_e.*"))


def _concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """From each start on: mean and covariance of the nearest SHARE of each pool, by the distances under the estimate."""
    binned = rows.join(estimate, list(POOL)).withColumn("bin", F.floor(F.log1p(_distance()) / BIN_STEP))
    sums = [F.sum(n).alias(f"s_{n}") for n in NAMES]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p{i}{j}") for i in range(4) for j in range(i + 1)]
    bins = binned.groupBy(*POOL, "start", "bin").agg(F.count("*").alias("n"), *sums, *products)
    group = Window.partitionBy(*POOL, "start")
    below = F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("n_group", F.sum("n").over(group)).withColumn("below", F.coalesce(below, F.lit(0))).where(F.col("below") < F.col("n_group") * SHARE)
    names = [f"s_{n}" for n in NAMES] + [f"p{i}{j}" for i in range(4) for j in range(i + 1)]
    out = bins.groupBy(*POOL, "start").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])
    out = out.withColumns({f"m_{n}": F.col(f"s_{n}") / F.col("n") for n in NAMES})
    cov = {f"c{i}{j}": (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m_{NAMES[i]}") * F.col(f"m_{NAMES[j]}")) * CONSISTENT + (FLOOR[i] if i == j else 0.0) for i in range(4) for j in range(i + 1)}
    return _factor(out.withColumns(cov))


def estimates(rows: DataFrame, side=lambda x: x) -> DataFrame:
    """The minimum covariance determinant estimate of each pool of rows (pool columns, v1..v4; staged), with its log_det.

    Each start goes on by itself while its determinant gets less by SETTLED or more. Determinants are no less than
    the floor's, so the steps come to an end without a count of them.
    """
    keys, now, first = [*POOL, "start"], common.staged(_starts(rows, side).withColumn("active", F.lit(True)), "estimates"), True
    values = [c for c in now.columns if c not in (*keys, "active")]
    while True:
        new = _concentrate(rows, side(now.where("active"))).select(*keys, F.struct(*values).alias("_new"))
        both = now.select(*keys, F.struct(*values).alias("_old")).join(side(new), keys, "left")
        # The first determinants are those of the starts, not of subsets.
        less = F.col("_new").isNotNull() if first else F.coalesce(F.col("_new.log_det") < F.col("_old.log_det") - SETTLED, F.lit(False))
        both = both.withColumn("active", less).withColumn("_best", F.when(F.col("active"), F.col("_new")).otherwise(F.col("_old")))
        now, first = common.staged(both.select(*keys, "_best.*", "active"), "estimates"), False
        if now.where("active").isEmpty():
            break
    best = now.groupBy(*POOL).agg(F.min(F.struct("log_det", "start", *[c for c in values if c != "log_det"])).alias("_best"))
    return best.select(*POOL, "_best.*").drop("start")


def _between(n: Column, own: str, up: str) -> list[Column]:
    """Moments between those of own and those of up, by the number of documents."""
    weight = n * n / (n * n + F.lit(float(HALF * HALF)))
    return [(weight * F.col(f"{own}.{c}") + (1 - weight) * F.col(f"{up}.{c}")).alias(c) for c in _MOMENTS]


def _judges(estimate: DataFrame, sizes: DataFrame, side) -> DataFrame:
    """(lang, source, m_*, w_ij): what each group is judged by. sizes: (lang, source, n)."""
    at = lambda level, *names, to: estimate.where(F.col(POOL[0]) == level).select(*[F.col(a).alias(b) for a, b in zip(POOL[1:], names, strict=False)], F.struct(*_MOMENTS).alias(to))
    whole = at(0, to="_up")  # one row
    langs = sizes.groupBy("lang").agg(F.sum("n").cast("double").alias("n"))
    tongues = at(1, "lang", to="_own").join(side(langs), "lang").crossJoin(F.broadcast(whole))
    tongues = tongues.select("lang", F.struct(*_between(F.col("n"), "_own", "_up")).alias("_up"))
    groups = at(2, "lang", "source", to="_own").join(side(sizes.withColumn("n", F.col("n").cast("double"))), ["lang", "source"]).join(side(tongues), "lang")
    moments = groups.select(F.lit(2).alias(POOL[0]), F.col("lang").alias(POOL[1]), F.col("source").alias(POOL[2]), F.lit(0).alias("start"), *_between(F.col("n"), "_own", "_up"))
    return _factor(moments).drop("start", "log_det", POOL[0]).withColumnsRenamed({POOL[1]: "lang", POOL[2]: "source"})


def outliers(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """stats (staged) with base_failed, distance (null where the base rule fails) and kept."""
    rows = stats.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")})
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = _vector(rows.withColumn("base_failed", failed))
    passed = rows.where("not base_failed")
    sizes = common.staged(passed.groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    side = F.broadcast if sizes.count() <= MOST_GROUPS else (lambda x: x)
    pool = lambda level, lang, source: F.struct(F.lit(level).alias(POOL[0]), lang.alias(POOL[1]), source.alias(POOL[2]))
    pools = F.array(pool(2, F.col("lang"), F.col("source")), pool(1, F.col("lang"), F.lit("")), pool(0, F.lit(""), F.lit("")))
    counted = passed.select(F.explode(pools).alias("_pool"), *NAMES).select("_pool.*", *NAMES)
    judges = common.staged(_judges(estimates(common.staged(counted, "vectors"), side), sizes, side), "judges")
    judged = rows.join(side(judges), ["lang", "source"], "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's word statistics and the verdict of the robust outlier rule."""
    stats = common.staged(statistics(common.table(spark, sf_dir, "documents")), "word-statistics")
    return outliers(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
