"""HTML extraction by site template removal.

Every page is read into its element tree. The hashes of element subtrees (tag,
class, texts, children) are counted per host in Spark; a subtree that recurs on
LEAST_PAGES or more pages of its host with different main texts is that site's
template and is deleted, inside the article as well as around it. Two things are
never template, so that copies of an article and shared passages stay: running text
inside an article (paragraphs, headings, list items, quotes and inline elements by
themselves; a box of them can be template), and a subtree that holds the page's main
text or more than half of its text.

What recurs too seldom to be counted is known by its element, role, or class or id:
menus, headers, footers, sidebars, notices, adverts, forms, reader comments. A class
counts as a whole, not by a word in it (`ad-box` is an advert, `social-history` is
not). Where a page has article or main elements only these are its text. A class or
id never drops the element around main; it drops the one around an article only where
the page has another main text outside (as beside a list of related articles).

Counts: distinct (host, main text, subtree) rows, then partial sums. The recurring
subtrees are broadcast while all together there are at most MOST_HASHES; beyond, each
page's own subtrees are joined with them by host and hash in salted groups, so no
host is gathered in one place.

Defined cases: null html gives an empty text; a null url is the empty host;
unclosed tags, comments and quotes are read as browsers do, roughly; unknown
references stay as written; repeated rows each give their text; other columns stay
as they came, but a clashing `text` is replaced.
"""

from __future__ import annotations

import html as references
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import common, urls

#: A subtree is template from so many pages of its host with different main texts on.
LEAST_PAGES = 3
MOST_HASHES = 100_000

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one of the same kind, up to the element that holds them.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
_SCOPE = frozenset("table td th caption button object template html".split())
#: What is never main text, by element, by the words of a class or id, and by role.
_OUT = frozenset("aside button canvas datalist dialog footer form head iframe menu nav noembed noframes noscript object script search select style svg template textarea title".split())
_OUT_WORDS = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe taboola toolbar widget widgets".split()
)
#: Words that may stand beside one of those in a class or id; any other word makes it the name of something else.
_BESIDE = frozenset("area bar block bottom box btn button center container content desktop fixed global group holder inner item items left link links list main mobile outer page panel primary right section site slot small sticky text top unit wrap wrapper".split())
#: Running text, which alone is never template inside an article.
_PROSE = frozenset("a abbr b bdi bdo blockquote caption cite code dd del dfn dt em figcaption font h1 h2 h3 h4 h5 h6 i ins kbd label li mark p pre q rp rt ruby s samp small span strike strong sub sup td th time tr tt u var".split())
_OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search".split())
_HEAD, _COMMENT = frozenset(("header", "masthead", "topbar")), frozenset(("comment", "comments", "reply"))


class Page:
    """The element tree of a page: for each node its parent, subtree hash and kind; the texts by block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.parts = ["#root"], [-1], [[]]
        #: Never main text; by its words unless it holds the main text; as the page's head unless it stands in main; 1 for an article, 2 for main.
        self.never, self.worded, self.headed, self.kind = [False], [False], [False], [0]
        self.names: list[str] = [""]
        self.blocks: list[list[tuple[str, int]]] = [[]]
        #: Open nodes; the places of each open tag among them, and those of the blocks, so that no end walks the stack.
        self.open, self.places, self.open_blocks = [0], {}, [0]
        at, last = 0, source.rfind(">")
        while at < len(source):
            found = _TAG.search(source, at) if at <= last else None
            if not found:  # no tag ends behind the last ">", only a comment may begin there
                self._text(source[at:].partition("<!--")[0])
                break
            self._text(source[at : found.start()])
            at = found.end()
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            rest = found["rest"] or found["rest2"] or ""
            if found["end"] or found["end2"]:
                self._end(name)
                continue
            self._start(name, rest)
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(source, at)
                at = close.start() if close else len(source)
        while len(self.open) > 1:
            self._close()
        self._judge()
        self.hashes = [0] * len(self.tags)
        for i in range(len(self.tags) - 1, 0, -1):  # children come after their parents
            kept = [p if isinstance(p, str) else f"\x01{self.hashes[p]}" for p in self.parts[i]]
            self.hashes[i] = xxhash.xxh64_intdigest("\x00".join((self.names[i], *kept)).encode("utf-8", "surrogatepass")) - (1 << 63)

    def _text(self, text: str) -> None:
        if not text:
            return
        text = references.unescape(text) if "&" in text else text
        node = self.open[-1]
        if stripped := " ".join(text.split()):
            self.parts[node].append(stripped)
        if not self.never[node]:
            self.blocks[-1].append((text, node))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _start(self, name: str, rest: str) -> None:
        if name in _BLOCK:
            if self.places.get("p"):
                self._pop({"p"}, _SCOPE)
            self._break()
        if name in _SIBLINGS:
            self._pop(*_SIBLINGS[name])
        if name == "br" and not self.never[self.open[-1]]:
            self.blocks[-1].append((" ", self.open[-1]))
        if name in _VOID:
            return
        parent, marks = self.open[-1], {}
        if rest:
            for key, *value in _ATTRIBUTE.findall(rest):
                marks[key.lower()] = "".join(value).lower()
        named = [set(_WORD.findall(x)) for x in f"{marks.get('class', '')} {marks.get('id', '')}".split()] if marks else []
        marked = lambda words: any(x & words and x <= words | _BESIDE and not x <= _BESIDE for x in named)
        never = self.never[parent] or name in _OUT or marks.get("role") in _OUT_ROLES
        if name == "article":
            never = never or marked(_COMMENT)
        plain = name in ("html", "body", "main", "article")
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        self.never.append(never)
        self.worded.append(not plain and marked(_OUT_WORDS))
        self.headed.append(not plain and (name == "header" or marked(_HEAD)))
        self.kind.append(0 if never else 2 if name == "main" or marks.get("role") == "main" else int(name == "article"))
        self.names.append(f"{name} {marks.get('class', '')}")
        self.parts.append([])
        self.parts[parent].append(node)
        self.places.setdefault(name, []).append(len(self.open))
        if name in _BLOCK:
            self.open_blocks.append(len(self.open))
        self.open.append(node)

    def _last(self, names) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _pop(self, names, until) -> None:
        """Closes the innermost element of these names with all in it, unless one of until is open within it."""
        if (place := self._last(names)) > self._last(until):
            self._close_to(place)

    def _close_to(self, place: int) -> None:
        while len(self.open) > place:
            self._close()

    def _close(self) -> None:
        name = self.tags[self.open.pop()]
        self.places[name].pop()
        if name in _BLOCK:
            self.open_blocks.pop()
            self._break()

    def _end(self, name: str) -> None:
        place = self._last((name,))
        # The end of an inline element doesn't close blocks.
        if place and (name in _BLOCK or place > self.open_blocks[-1]):
            self._close_to(place)

    def _judge(self) -> None:
        """Sets out and main of each node."""
        holds = list(self.kind)
        for i in range(len(self.tags) - 1, 0, -1):
            holds[self.parents[i]] = max(holds[self.parents[i]], holds[i])
        for least in (2, 1):
            self.out, self.main = [False], [False]
            for i in range(1, len(self.tags)):
                inside = self.main[self.parents[i]]
                marked = holds[i] < least and (self.worded[i] or self.headed[i] and not inside)
                out = self.never[i] or self.out[self.parents[i]] or marked
                self.out.append(out)
                self.main.append(not out and (inside or self.kind[i] > 0))
            if not holds[0] or any(self.main):
                break

    def _sizes(self) -> list[int]:
        """The length of the text in each node that isn't never text."""
        sizes = [0 if self.never[i] else sum(len(p) for p in parts if isinstance(p, str)) for i, parts in enumerate(self.parts)]
        for i in range(len(self.tags) - 1, 0, -1):
            sizes[self.parents[i]] += sizes[i]
        return sizes

    def open_to_count(self) -> list[bool]:
        """For each node whether it may be template: it has content, doesn't hold the main element or most of the text, and is no running text in main."""
        holds, sizes, inside = [kind > 0 for kind in self.kind], self._sizes(), [False]
        for i in range(len(self.tags) - 1, 0, -1):
            holds[self.parents[i]] |= holds[i]
        for i in range(1, len(self.tags)):
            inside.append(inside[self.parents[i]] or self.kind[i] > 0)
        return [i > 0 and bool(self.parts[i]) and not holds[i] and 2 * sizes[i] <= sizes[0] and not (inside[i] and self.tags[i] in _PROSE) for i in range(len(self.tags))]

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text without the subtrees whose hash is in template."""
        only, gone = any(self.main), [False] * len(self.tags)
        if template:
            may = self.open_to_count()
            for i in range(1, len(self.tags)):
                gone[i] = gone[self.parents[i]] or (may[i] and self.hashes[i] in template)
        blocks = []
        for block in self.blocks:
            if words := "".join(t for t, node in block if not gone[node] and not self.out[node] and (self.main[node] or not only)).split():
                blocks.append(" ".join(words))
        return "\n".join(blocks)

    def subtrees(self) -> set[int]:
        """Hashes of the subtrees that may be template."""
        return {self.hashes[i] for i, may in enumerate(self.open_to_count()) if may}


def _columns(pages: DataFrame) -> list:
    """host, key, html: key is a checksum of the html, by which equal pages of a host are one."""
    source = F.coalesce("html", F.lit(""))
    return [urls.host(F.col("url")).alias("host"), F.xxhash64(source, F.octet_length(source)).alias("key"), F.col("html")]


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(*_columns(pages))


def _subtrees(keyed: DataFrame) -> DataFrame:
    """(host, key, page, hash) of every subtree that may be template; page is a checksum of the page's main text."""

    def read(batches):
        common.held(None)
        for batch in common.slices(batches, "html", 1 << 20):
            rows, sums, hashes = [], [], []
            for i, source in enumerate(batch.column("html").to_pylist()):
                page = Page(source or "")
                found = page.subtrees()
                rows += [i] * len(found)
                sums += [xxhash.xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)] * len(found)
                hashes += found
            at = pa.array(rows, pa.int64())
            yield pa.record_batch({"host": batch.column("host").take(at), "key": batch.column("key").take(at), "page": pa.array(sums, pa.int64()), "hash": pa.array(hashes, pa.int64())})

    return keyed.mapInArrow(read, "host string, key long, page long, hash long")


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash, n): the subtrees that recur on the pages of each host, and on how many main texts."""
    seen = _subtrees(_keyed(pages)).select("host", "hash", "page").distinct()
    return seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)


def extract(pages: DataFrame, template: DataFrame) -> DataFrame:
    """pages with the column text, and no html. template: (host, hash, n), cheap to read."""
    names = [c for c in pages.columns if c not in ("html", "text")]
    rows = pages.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)], *_columns(pages))
    out = [F.col(f"in_{i}").alias(c) for i, c in enumerate(names)]
    few = template.limit(MOST_HASHES + 1).count() <= MOST_HASHES
    if few:
        by: dict[str, set[int]] = {}
        for r in template.select("host", "hash").collect():  # at most MOST_HASHES rows
            by.setdefault(r["host"], set()).add(r["hash"])
        shared = pages.sparkSession.sparkContext.broadcast(by)

        @F.arrow_udf("string")
        def main_text(host: pa.Array, source: pa.Array) -> pa.Array:
            common.held(None)
            found = shared.value
            return pa.array([Page(s or "").text(found.get(h, frozenset())) for h, s in zip(host.to_pylist(), source.to_pylist(), strict=True)], pa.string())

        return rows.select(*out, main_text("host", "html").alias("text"))

    @F.arrow_udf("string")
    def own_text(own: pa.Array, source: pa.Array) -> pa.Array:
        return pa.array([Page(s or "").text(frozenset(t or ())) for t, s in zip(own.to_pylist(), source.to_pylist(), strict=True)], pa.string())

    seen = common.staged(_subtrees(_keyed(pages)).drop("page").distinct(), "subtrees")
    hits = common.salted_join(seen, template.drop("n"), ["host", "hash"], template.select("host", "hash", "n"), ["key"])
    own = common.staged(hits.groupBy("host", "key").agg(F.collect_set("hash").alias("own")), "own-templates")  # of one page, so bounded by it
    counts = common.staged(rows.groupBy("host", "key").agg(F.count("*").alias("n")), "page-copies")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    return common.salted_join(rows, own, ["host", "key"], counts, ["_row"], "left").select(*out, own_text("own", "html").alias("text"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract(pages, common.staged(templates(pages), "templates"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
