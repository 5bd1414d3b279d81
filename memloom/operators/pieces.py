"""The sanitized text of a session of any size, cut to its head or tail, without the session ever being one value.

Texts are joined by runs of message numbers. A session of one run is sanitized as it
is. A longer one is a row of pieces whose concatenation is its joined text, and each
step of the sanitizer turns pieces into pieces:

* Blocks may open in one piece and close in another. A piece is a map from "inside a
  block at its start" to "inside at its end": both outcomes are worked out for each
  piece by itself, and what holds before it follows from the maps of the pieces
  before: the last one that ends alike either way, and how many since then swap. An
  opener counts only if a closer (and what else the block needs) follows in its
  piece or a later one, so a block that never closes stays text.
* Where the end of a piece may be the beginning of a token (a tag, a fence, a date), the
  next piece is put behind it first.
* At last blank pieces at both ends go, and only the pieces that the cut can reach
  come together.

Windows run over narrow rows (session, run and what is known of the piece), and pieces are
dealt by session and run, so a long session is spread over tasks. Steps are
written to the shared folder. The pieces equal the sanitizer on the joined text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from memloom.config import DEFAULT, Config
from memloom.functions import text as T
from memloom.operators import messages as M
from memloom.sources import shared

#: Message numbers of a run.
RUN = 1000
KEY = ["session_key", "run"]
#: Characters of the longest token, white space and quotes aside.
TOKEN = 48
LINE_ENDS = ("\n", "\r", "\u2028", "\u2029")



def _in_order() -> WindowSpec:
    return Window.partitionBy("session_key").orderBy("run")


def _upto(row: int, order: WindowSpec | None = None) -> WindowSpec:
    return (order or _in_order()).rowsBetween(Window.unboundedPreceding, row)


def _whole() -> WindowSpec:
    return Window.partitionBy("session_key")


def _open_end(text: Column) -> Column:
    """Whether a token may begin before a piece's end and go on behind it: one of `<`, backtick, quote or bracket with less than a token behind it, or a piece that could lie within one.

    White space doesn't count, nor do quotes, of which a run is one. What begins before more than a token is no matter, so the
    last characters mostly tell.
    """
    squeezed = lambda t: F.regexp_replace(F.regexp_replace(t, f"[{T.SPACES}]+", ""), '"+', '"')
    solid = lambda t: F.length(F.replace(t, F.lit('"'), F.lit("")))
    begun = lambda t: t.rlike(rf'[<`\["](?:"?[^"`<\[]){{0,{TOKEN}}}"?\z')
    every = lambda: T.let(squeezed(text), lambda t: begun(t) | (solid(t) < TOKEN))
    return T.let(squeezed(F.right(text, F.lit(2 * TOKEN))), lambda t: F.when(solid(t) > TOKEN, begun(t)).otherwise(every()))


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """rows (session_key, run, text) written to the shared folder without empty ones, with what is known of their ends: `_open`, and `_mid` if it is so or lies within a line."""
    rows = rows.where("text != ''").withColumn("_open", _open_end(F.col("text")))
    return shared.settled(rows.select(*KEY, "text", "_open", (F.col("_open") | ~F.right("text", F.lit(1)).isin(*LINE_ENDS)).alias("_mid")), name)


def _merged(pieces: DataFrame, unsafe: str) -> DataFrame:
    """Pieces with those put together that a token may straddle."""
    flags = pieces.select(*KEY, F.coalesce(F.lag(unsafe).over(_in_order()), F.lit(False)).alias("_glued"))
    if flags.where("_glued").isEmpty():
        return pieces
    first = F.max(F.when(~F.col("_glued"), F.col("run"))).over(_upto(0))
    rows = pieces.join(flags.select(*KEY, first.alias("_first")), KEY)
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    rows = rows.groupBy("session_key", F.col("_first").alias("run")).agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return _kept(rows, "merged")


def _passed(piece: DataFrame, block: T.Block, inside: bool, n: int) -> DataFrame:
    """Adds out<n> and exit<n>: what is left of a piece that starts outside (or inside) a block, and whether it ends inside one."""
    text, size = F.col("text"), len(block.closer)
    if inside:
        closes = text.contains(block.closer)
        rest = F.when(closes, F.substr(text, T.locate(block.closer, text, F.lit(0)) + size + 1)).otherwise("")
        shut = ~closes
    else:
        rest, shut = text, F.lit(False)
    piece = piece.withColumn("_rest", rest)
    # Openers count up to `_reach`; where all that they need follows later, up to the end.
    t, far = F.col("_rest"), F.length("_rest")
    reach = F.least(far, *[F.when(F.col(f"_later{k}"), far).otherwise(T.last_start(t, need)) for k, need in enumerate(block.needs)]) if block.needs else far
    piece = piece.withColumn("_reach", reach)
    bound = F.col("_reach") < far
    closer = F.when(bound & (F.col("_reach") >= 0), T.locate(block.closer, t, F.greatest("_reach", F.lit(0)))).otherwise(-1)
    piece = piece.withColumn("_closer", closer)
    cut = F.when(F.col("_reach") < 0, 0).when(F.col("_closer") >= 0, F.col("_closer") + size).otherwise(F.col("_reach"))
    piece = piece.withColumn("_cut", cut)
    a, b = F.left(t, F.col("_cut")), F.substr(t, F.col("_cut") + 1)
    open_ended = rf"(?s)(?:{block.opener})(?:.*?{block.closer}|.*)"
    last = F.try_element_at(F.regexp_extract_all(a, F.lit(open_ended), F.lit(0)), F.lit(-1))  # null if nothing opens
    with_end = rf"(?s)\A(?:{block.opener}).*{block.closer}\z"
    piece = piece.withColumn("_exits", F.coalesce(F.col("_later") & (F.col("_closer") < 0) & ~last.rlike(with_end), F.lit(False)))
    plain = T.without_blocks(a, T.Block(block.opener, block.closer))
    out = F.when(F.col("_exits"), F.regexp_replace(a, open_ended, "")).otherwise(F.concat(plain, b))
    piece = piece.withColumns({f"out{n}": out, f"exit{n}": F.col("_exits") | shut})
    return piece.drop("_rest", "_reach", "_closer", "_cut", "_exits")


def _unblocked(pieces: DataFrame, block: T.Block) -> DataFrame:
    """Pieces without a kind of block."""
    if pieces.where(F.col("text").contains(block.closer)).isEmpty():
        return pieces
    pieces = _merged(pieces, "_open")
    marks = {"_later": block.closer, **{f"_later{k}": need for k, need in enumerate(block.needs)}}
    facts = pieces.select(*KEY, *[F.when(F.col("text").contains(part), F.col("run")).alias(name) for name, part in marks.items()])
    facts = facts.select(*KEY, *[F.coalesce(F.max(name).over(_whole()) > F.col("run"), F.lit(False)).alias(name) for name in marks])
    both = _passed(_passed(pieces.join(facts, KEY), block, False, 0), block, True, 1)
    both = shared.settled(both.select(*KEY, "out0", "exit0", "out1", "exit1"), "passed")
    swaps = F.sum((F.col("exit0") & ~F.col("exit1")).cast("int"))
    known = F.when(F.col("exit0") == F.col("exit1"), F.struct("exit0", F.col("_swaps")))
    state = both.select(*KEY, "exit0", "exit1")
    state = state.withColumn("_swaps", swaps.over(_upto(0))).withColumn("_known", known)
    state = state.withColumns({"_base": F.last("_known", ignorenulls=True).over(_upto(-1)), "_since": F.coalesce(F.lag("_swaps").over(_in_order()), F.lit(0))})
    odd = (F.col("_since") - F.coalesce("_base._swaps", F.lit(0))) % 2 == 1
    state = state.select(*KEY, (F.coalesce("_base.exit0", F.lit(False)) != odd).alias("_inside"))
    rows = both.join(state, KEY).select(*KEY, F.when(F.col("_inside"), F.col("out1")).otherwise(F.col("out0")).alias("text"))
    return _kept(rows, "unblocked")


def _gathered(pieces: DataFrame, cap: int, tails: DataFrame | None) -> DataFrame:
    """(session_key, text): trimmed, then the first cap characters, or the last ones for sessions of tails."""
    filled = F.when(T.trim(F.col("text")) != "", F.col("run"))
    ends = pieces.select(*KEY, filled.alias("_filled"))
    ends = ends.select(*KEY, F.min("_filled").over(_whole()).alias("_lo"), F.max("_filled").over(_whole()).alias("_hi")).where(F.col("run").between(F.col("_lo"), F.col("_hi")))
    rows = pieces.join(ends, KEY)
    text = F.when(F.col("run") == F.col("_lo"), F.ltrim(F.col("text"), F.lit(T.SPACES))).otherwise(F.col("text"))
    rows = rows.withColumn("text", F.when(F.col("run") == F.col("_hi"), F.rtrim(text, F.lit(T.SPACES))).otherwise(text)).select(*KEY, "text")
    # Where two pieces meet, at most two line ends go; so these are lower bounds of what lies before and behind a piece.
    sizes = rows.select(*KEY, (F.length("text") - 2).alias("_size"))
    sizes = sizes.withColumn("_tail", F.lit(False)) if tails is None else sizes.join(tails.select("session_key", F.lit(True).alias("_tail")), "session_key", "left")
    back = Window.partitionBy("session_key").orderBy(F.desc("run"))
    for name, order in (("_head_at", _in_order()), ("_tail_at", back)):
        sizes = sizes.withColumn(name, F.coalesce(F.sum("_size").over(_upto(-1, order)), F.lit(0)))
        sizes = sizes.withColumn(name, F.max(name).over(_upto(0, order)))
    near = F.when(F.coalesce("_tail", F.lit(False)), F.col("_tail_at")).otherwise(F.col("_head_at")) < cap
    rows = rows.join(sizes.where(near).select(*KEY, F.coalesce("_tail", F.lit(False)).alias("_tail")), KEY)
    parts = F.array_sort(F.collect_list(F.struct("run", "text")))
    rows = rows.groupBy("session_key", "_tail").agg(F.regexp_replace(F.array_join(F.transform(parts, lambda x: x["text"]), ""), r"\n{3,}", "\n\n").alias("text"))
    return rows.select("session_key", F.when(F.col("_tail"), F.right("text", F.lit(cap))).otherwise(F.left("text", F.lit(cap))).alias("text"))


def sanitized(texts: DataFrame, cap: int, config: Config = DEFAULT, tails: DataFrame | None = None, step: int = RUN) -> DataFrame:
    """(session_key, text): each session's texts (session_key, idx, block, text) joined, sanitized and cut to cap characters.

    Sessions of tails (session_key) keep their last characters, others the first. `step` message numbers make a run. If any
    session has several runs, jobs are run here; sessions without texts have no row, those of which nothing is left an empty
    text; rows without a session_key belong to none.
    """
    texts = texts.where("session_key is not null")
    runs = M.joined(texts.withColumn("session_key", F.struct("session_key", F.floor(F.col("idx") / step).alias("run")))).select("session_key.*", "text")
    runs = shared.settled(runs, "runs")  # so that the texts are worked out once
    several = F.min("run") < F.max("run")
    long = shared.settled(runs.groupBy("session_key").agg(several.alias("_several")).where("_several").select("session_key"), "long")
    none = long.isEmpty()
    short = runs if none else runs.join(long, "session_key", "left_anti")  # before they are sanitized
    clean = T.sanitize(F.col("text"), config)
    if tails is None:
        short = short.select("session_key", F.left(clean, F.lit(cap)).alias("text"))
    else:
        rows = short.join(tails.select("session_key", F.lit(True).alias("_tail")), "session_key", "left").withColumn("text", clean)
        short = rows.select("session_key", F.when(F.col("_tail"), F.right("text", F.lit(cap))).otherwise(F.left("text", F.lit(cap))).alias("text"))
    if none:
        return short
    pieces = runs.join(long, "session_key", "left_semi").withColumn("text", F.concat("text", F.lit("\n\n")))  # behind the last text the trim takes it away
    pieces = reduce(_unblocked, T.blocks(config), _kept(pieces, "pieces"))
    pieces = _merged(pieces, "_mid").select(*KEY, T.without_noise(F.col("text")).alias("text"))
    found = _gathered(shared.settled(pieces, "pieces"), cap, tails)
    found = long.join(found, "session_key", "left").select("session_key", F.coalesce("text", F.lit("")).alias("text"))
    return short.unionByName(found)
