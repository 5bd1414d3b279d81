"""URL filter: pattern rules indexed by their rarest literal token.

Every rule lists literal tokens that a matching url must hold (whole runs of
ASCII letters and digits). Token counts over all urls tell which of a rule's
tokens is the rarest; the rule is filed under that one. A url's own tokens fetch
its candidate rules by an equi-join, and only those run their regular
expressions, so a url never meets the rest of the rule set. Rules without a
literal token are tried on every url.

Host rules (like `example.net/en/`) fit a host and its subdomains under a path
prefix; the longest that fits decides. Where none fits, a url is blocked if a
pattern matches it, else allowed. Patterns are made from word lists by rules: a word
that stands alone in the host, a word that is a whole directory or file name of the
path, a parameter of the query that carries an advert or a paid click.

Defined cases: a null url, or one without `://`, has empty host and path, no
rule, and is allowed; ties in length go to the rule last in order of text;
repeated rows are each judged; with no rules all is allowed; extra columns are
not read.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common

HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Words that get a host blocked where no host rule fits; with those after them, the names of directories and files that do.
HOST_WORDS = tuple("ads adserver adult bets betting bookmaker camgirls casino casinos cialis crackz doubleclick escort escorts gambling hentai jackpot keygen malware nude payday phishing pills poker popunder porn porno pornstar roulette sex slots spam spyware tracker viagra warez webcams xanax xxx".split())
PATH_WORDS = (*HOST_WORDS, *"adframe adclick adview adbanner bannerads clicktrack interstitial paidlinks popads sponsoredlinks toplist trackback webbug".split())
#: Parameters of the query that a url of content doesn't carry.
QUERY_NAMES = tuple("adclickid adunit adurl affid affiliate affiliateid bannerid clickid clicktag partnerid popunder referralcode subid trackingid zoneid".split())
#: The index is broadcast up to so many rules; beyond, it is joined by shuffle, hot tokens over salted copies of their rules.
MOST_RULES = 50_000
_RULE = "kind string, rule string, verdict string, pattern string, tokens array<string>"
_TYPES = [pa.string()] * 4 + [pa.list_(pa.string())]


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query(url: Column) -> Column:
    """From the first `?` of a url with a scheme up to `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def _tokens(text: str) -> list[str]:
    return sorted(set(re.findall(r"[a-z0-9]+", text.lower())))


def host_rule(rule: str, verdict: str) -> tuple:
    """The rule of a host and path prefix, as a pattern over host followed by path."""
    whole = rule if re.search(r"[^A-Za-z0-9]$", rule) else re.sub(r"[A-Za-z0-9]+$", "", rule)  # a last open token may go on
    return ("host", rule, verdict, rf"^(?:[^/]*\.)?{re.escape(rule)}", _tokens(whole))


def word_rule(word: str, verdict: str = "block") -> tuple:
    """A word that stands alone in the host."""
    return ("word", word, verdict, rf"^(?:[^/?]*[^/?a-z0-9])?{re.escape(word)}(?:[^a-z0-9]|$)", _tokens(word))


def path_rule(word: str, verdict: str = "block") -> tuple:
    """A word that is a whole directory or, up to its first dot, file name of the path, in any case."""
    return ("word", f"/{word}", verdict, rf"^[^/?]*/(?:[^?]*/)?(?i:{re.escape(word)})(?:[./?]|$)", _tokens(word))


def query_rule(name: str, verdict: str = "block") -> tuple:
    """A parameter of the query by its name, in any case."""
    return ("word", f"?{name}", verdict, rf"^[^?]*\?(?:.*&)?(?i:{re.escape(name)})=", _tokens(name))


def default_rules(spark: SparkSession) -> DataFrame:
    rules = [*(host_rule(*r) for r in HOST_RULES), *map(word_rule, HOST_WORDS), *map(path_rule, PATH_WORDS), *map(query_rule, QUERY_NAMES)]
    return spark.createDataFrame(rules, _RULE)


#: What makes a pattern of a rule's text, by kind.
KINDS = {"host": host_rule, "word": word_rule, "path": path_rule, "query": query_rule}


def compiled(table: DataFrame) -> DataFrame:
    """Rules from a table (kind, text, verdict) of any size, repeated ones once; made in tasks.

    kind is one of KINDS; host rules block or allow, all others block. Anything else, nulls included, is an error.
    """

    def make(batches):
        for batch in batches:
            made = []
            for kind, text, verdict in zip(*(batch.column(c).to_pylist() for c in ("kind", "text", "verdict")), strict=True):
                if kind not in KINDS or not text or verdict not in (("block", "allow") if kind == "host" else ("block",)):
                    raise ValueError(f"no rule: {kind}, {text}, {verdict}")
                made.append(KINDS[kind](text, verdict))
            columns = list(zip(*made, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["kind", "rule", "verdict", "pattern", "tokens"])

    return table.select("kind", "text", "verdict").distinct().mapInArrow(make, _RULE)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, host, path, rule, verdict) of each row of pages."""
    urls = pages.select(key, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), query(F.col("url")).alias("_query"))
    urls = urls.withColumn("_at", F.concat("host", "path", "_query")).withColumn("_tokens", F.array_distinct(F.regexp_extract_all(F.lower("_at"), F.lit("[a-z0-9]+"), F.lit(0))))
    few = rules.count() <= MOST_RULES
    wanted = rules.select(F.explode("tokens").alias("_token")).distinct()
    # The empty token stands for the rules that have none.
    spread = urls.withColumn("_row", F.monotonically_increasing_id()).select("_row", key, "host", "path", "_at", F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("_token"))
    if few:  # only the rules' own tokens are counted, in each task first
        counts = urls.select(F.explode("_tokens").alias("_token")).join(F.broadcast(wanted), "_token", "left_semi").groupBy("_token").agg(F.count("*").alias("n"))
    else:  # all are, since a token that no rule has may still be the hot one of the join
        counts = common.staged(spread.groupBy("_token").agg(F.count("*").alias("n")), "url-tokens")
    filed = rules.select("kind", "rule", "verdict", "pattern", F.explode_outer("tokens").alias("_token")).join(counts, "_token", "left")
    filed = filed.groupBy("kind", "rule", "verdict", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "_token"))["_token"].alias("_token"))
    filed = filed.withColumn("_token", F.coalesce("_token", F.lit("")))
    tried = spread.join(F.broadcast(filed), "_token", "left") if few else common.salted_join(spread, filed, ["_token"], counts, ["_row"], "left")
    tried = tried.withColumn("_hit", F.coalesce(F.regexp_like("_at", F.col("pattern")), F.lit(False)))
    best = F.max(F.when(F.col("_hit") & (F.col("kind") == "host"), F.struct(F.length("rule").alias("n"), "rule", "verdict")))
    word = F.max(F.when(F.col("_hit") & (F.col("kind") == "word"), F.lit(1)))
    judged = tried.groupBy("_row").agg(F.first(key).alias(key), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("_best"), word.alias("_word"))
    verdict = F.coalesce("_best.verdict", F.when(F.col("_word") == 1, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(key, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page."""
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), default_rules(spark))


OP8_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host, split_part(rest, '#', 1) AS whole FROM u
), p AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path,
         CASE WHEN strpos(whole, '?') > 0 THEN substr(whole, strpos(whole, '?')) ELSE '' END AS query FROM h
), r AS (
  SELECT page_id, host, path, query,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN regexp_matches(host, '(^|[^a-z0-9])({"|".join(HOST_WORDS)})([^a-z0-9]|$)') THEN 'block'
       WHEN list_has_any(list_transform(string_split(path[2:], '/'), lambda x: split_part(lower(x), '.', 1)), ['{"', '".join(PATH_WORDS)}']) AND path != '' THEN 'block'
       WHEN list_has_any(list_transform(list_filter(string_split(query[2:], '&'), lambda x: contains(x, '=')), lambda x: split_part(lower(x), '=', 1)), ['{"', '".join(QUERY_NAMES)}']) THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
