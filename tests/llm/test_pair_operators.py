"""Near-duplicates, embeddings, pages, urls and the pipeline against brute force."""

import random
import time
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memloom.llm import common, dedup, embeddings, graph, html, registry, urls

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _classes(links, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def _bag(text):
    words = _WORD.findall(text or "")
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else Counter()


def _similar(a, b):
    high = sum((a | b).values())
    return high and sum((a & b).values()) / high >= 0.8


def _brute(docs):
    bags = {i: _bag(t) for i, t in docs if i is not None}
    ids = sorted(bags)
    return _classes([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if _similar(bags[a], bags[b])], ids)


def _variant(rnd, words, share):
    return [rnd.choice("abcdefgh") * rnd.randint(2, 9) if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted():
    rnd, rows = random.Random(11), []
    for group in range(25):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(3, 200))]
        for _ in range(rnd.randint(1, 8)):
            rows.append(" ".join(_variant(rnd, words, rnd.choice([0, 0.005, 0.02, 0.04]))))
    passage = " ".join("".join(rnd.choice("klmnop") for _ in range(5)) for _ in range(60))
    rows += [passage + " " + " ".join("".join(rnd.choice("qrstuv") for _ in range(6)) for _ in range(n)) for n in range(5, 60)]
    chain = ["".join(rnd.choice("wxyz") for _ in range(7)) for _ in range(300)]
    rows += [" ".join(chain[k : k + 200]) for k in range(0, 100, 15)]
    rows += ["again and again and again"] * 3 + ["same same same same same same same"] * 2 + ["x " * 5000, "x " * 4999]
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, planted):
    got = {r.doc_id: (r.class_id, r.kept) for r in dedup.classes(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    assert got == {i: (c, i == c) for i, c in _brute(planted).items()}


def test_near_duplicates_in_blocks(spark, planted, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    monkeypatch.setattr(dedup, "TASK_ROWS", 10)
    monkeypatch.setattr(dedup, "MOST_IDS", 0)
    monkeypatch.setattr(dedup.common, "HOT_ROWS", 3)
    got = {r.doc_id: r.class_id for r in dedup.classes(spark.createDataFrame(planted, "doc_id long, text string")).collect()}
    assert got == _brute(planted)


def test_near_duplicates_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a"), (5, "a"), (5, "a"), (6, "a b c d"), (7, "a b c e"), (None, "a"), (8, "w " * 20_000), (9, "w " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n int, sig string")
    got = {r.doc_id: (r.class_id, r.kept) for r in dedup.classes(docs).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (4, False), 6: (6, True), 7: (7, True), 8: (8, True), 9: (8, False), None: (None, True)}
    assert dedup.classes(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in dedup.keep_one(spark, docs, "").collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    twice = spark.createDataFrame([(1, "b b b"), (1, "a a a"), (1, None), (2, "a a a"), (3, "b b b")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dedup.classes(twice).collect()} == {1: 1, 2: 1, 3: 3}
    assert sorted(map(tuple, dedup.keep_one(spark, twice, "").collect()), key=str) == [(1, None), (3, "b b b")]


def test_dedup_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = _brute([tuple(r) for r in docs])
    assert {r.doc_id: r.class_id for r in dedup.op2_dedup(spark, sf_dir).collect()} == want


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    element, a = rng.integers(0, 2**63, 300).astype(np.uint64), rng.integers(0, 20, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.integers(0, 20, 300))
    want, found = np.minimum(a, b).sum() / np.maximum(a, b).sum(), []
    for k in range(15):
        x = dedup.common.mix(element + np.uint64(k))
        h = dedup.bag_min_hash(np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)], np.r_[x[a > 0], x[b > 0]], np.r_[a[a > 0], b[b > 0]], 2)
        found.append((h[0] == h[1]).mean())
    assert abs(np.mean(found) - want) < 4 * np.std(found) / 15**0.5 + 0.005


def test_components(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    want = _classes(links, range(600))
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- embeddings ------------------------------------------------------------------------------------------------------


def _brute_vectors(rows):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    links = [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(x @ x.T >= 0.95), strict=True) if a != b]
    many = Counter(a for a, _ in links)
    classes = _classes(links, [i for i, _ in rows])
    return {i: (many[i], classes[i]) for i, _ in rows}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(120):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * rng.choice([0, 0.01, 0.1, 0.2])).tolist() for _ in range(rng.integers(1, 12))]
    rows = list(enumerate(rows)) + [(5000, None), (5001, []), (5002, [0.0] * 16), (5003, [1.0, None] + [0.0] * 14), (5004, [float("nan")] * 16), (5005, [float("inf")] + [1.0] * 15), (5007, rows[0]), (5008, [2 * x for x in rows[0]])]
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    docs = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(docs).collect()}
    want = _brute_vectors(rows)
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in got) and found >= 0.99 * there > 0
    assert all(got[i] == (0, i) for i in range(5000, 5006))
    assert sum(got[i][1] == want[i][1] for i in got) >= 0.99 * len(got)


def test_embeddings_hot_group_over_many_lists(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64) / 8
    rows = list(enumerate([(centre + rng.normal(size=64) * 0.0265).tolist() for _ in range(800)] + rng.normal(size=(1600, 64)).tolist()))
    monkeypatch.setattr(embeddings, "PER_LIST", 8)  # 300 lists, about a hundred of them in the group
    monkeypatch.setattr(embeddings, "BLOCK", 300)
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(docs).collect()}
    want = _brute_vectors(rows)
    assert sum(n for n, _ in want.values()) > 300_000 and got == want


def test_embeddings_query_recall(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    want = _brute_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.op4_embeddings(spark, "/root/testdata/sf0.1").collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_embeddings_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.near_duplicates(none).count() == 0
    one = spark.createDataFrame([(3, [1.0, 2.0]), (3, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(one).collect())) == [(3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)]


def test_embeddings_of_several_dimensions_and_repeated_ids(spark, monkeypatch):
    """Equal to brute force over rows, with hot components and entries split."""
    monkeypatch.setattr(embeddings.common, "HOT_ROWS", 2)
    rng, rows = np.random.default_rng(9), []
    for d in (2, 3, 5):
        for _ in range(6):
            centre = rng.normal(size=d)
            rows += [(int(rng.integers(0, 40)), (centre + rng.normal(size=d) * rng.choice([0, 0.05])).tolist()) for _ in range(rng.integers(1, 7))]
    rows += [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [1.0, 0.0]), (None, [1.0, 0.01]), (None, [0.0, -1.0, 0.0]), (None, None), (5, None), (7, [0.0, 0.0])]
    link = lambda a, b: a and b and len(a) == len(b) and any(a) and any(b) and np.dot(a, b) >= 0.95 * np.linalg.norm(a) * np.linalg.norm(b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and link(rows[i][1], rows[j][1])]
    many, classes = Counter(i for i, _ in pairs), _classes([p for p in pairs if p[0] < p[1]], range(len(rows)))
    want = []
    for i, (vec_id, _) in enumerate(rows):
        names = [rows[j][0] for j in range(len(rows)) if classes[j] == classes[i] and rows[j][0] is not None]
        least = min(names, default=None)
        want.append((vec_id, many[i], least, vec_id is None or vec_id == least))
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# --- pages -----------------------------------------------------------------------------------------------------------


def test_main_text():
    page = """<html><head><title>no</title><style>p{}</style></head><body><header>no</header><nav><ul><li>no</nav>
    <div class="cookie-notice">no</div><main><h1>T &amp; &eacute;&nbsp;x</h1><p>a <b>b</b>
    c<br>d<script>var t="</p>";</script><p>e<ul><li>x<li>y</ul><!-- no --><aside>no</aside><form>no</form>
    <section id=comments><article class="comment">no</article></section><p class='ad'>no</p><p title="a > b">f</p></main><footer>no"""
    assert html.Page(page).text() == "T & é x\na b c d\ne\nx\ny\nf"
    for odd in ("", "<", "<p", "plain & simple", "<!-- open", "<a href='x", "</p></p>", "<p>" * 3000 + "deep"):
        html.Page(odd).text()
    assert html.Page("plain &lt; simple").text() == "plain < simple"


def test_layout_words_keep_the_article():
    article = "<article><header>T</header><p>a</p><div class='share'>no</div></article>"
    for wrapper in ("<div class='content has-sidebar'>%s</div>", "<div id='page-with-comments'><div class='widget'>%s</div></div>", "<div class=social><main>%s</main></div>", "<div role=main class='no-footer'>%s</div>"):
        assert html.Page("<body><nav>no</nav>" + wrapper % article + "<footer>no</footer>").text() == "T\na"
    assert html.Page(article + "<div class='related'><article>other</article></div><section id=comments><article class=comment>no</article></section>").text() == "T\na"
    assert html.Page("<p>x</p><section id=comments><article class=comment>no</article></section>").text() == "x"


def test_names_count_as_a_whole():
    page = """<article><h1>T</h1><div class="social-history">a</div><p class="alert-quote">b</p><p id="related-work">c</p>
    <math><mi>x</mi></math><div class="ad-box top">no</div><div id="site-footer">no</div><div class="x sidebar left">no</div><div class="main-content">d</div></article>"""
    assert html.Page(page).text() == "T\na\nb\nc\nx\nd"


def test_only_host_counts_tell_template_from_text(spark, monkeypatch):
    """The same boxes with plain names, in and beside the article: template where they recur on the host, text where they don't."""
    box = "<div class=x><p>Read our letter.</p><p>It is free.</p></div>"
    page = lambda text, inner: f"<body><div>Top of all</div><article><h1>Common title</h1><p>{text}</p>{inner}<p>Shared passage of many articles.</p></article></body>"
    rows = [(i, f"http://a.org/{i}", page(f"Own text {i}.", box)) for i in range(4)]
    rows += [(10 + i, f"http://b.org/{i}", page(f"Own text {i}.", box)) for i in range(2)]
    rows += [(20 + i, f"http://c.org/{i}", page("One copied text.", box)) for i in range(6)]
    rows += [(30 + i, f"http://d.org/{i}", f"<body><div>Menu</div><div>Long text number {i} of the page itself.</div><div>Imprint</div></body>") for i in range(4)]
    rows += [(40, "http://e.org/", None), (41, None, box)]
    pages = spark.createDataFrame([(*r, "own", "t", 1) for r in rows], "page_id long, url string, html string, text string, template string, hash int")
    for most, hot in ((100_000, 1000), (0, 1)):
        monkeypatch.setattr(html, "MOST_HASHES", most)
        monkeypatch.setattr(html.common, "HOT_ROWS", hot)
        out = html.extract(pages, common.staged(html.templates(pages), "t"))
        assert out.columns == ["page_id", "url", "template", "hash", "text"]
        got = {r.page_id: r.text for r in out.collect()}
        article = "Common title\n%s\n%sShared passage of many articles."
        assert all(got[i] == article % (f"Own text {i}.", "") for i in range(4))
        assert all(got[10 + i] == article % (f"Own text {i}.", "Read our letter.\nIt is free.\n") for i in range(2))
        assert all(got[20 + i] == article % ("One copied text.", "Read our letter.\nIt is free.\n") for i in range(6))
        assert all(got[30 + i] == f"Long text number {i} of the page itself." for i in range(4))
        assert got[40] == "" and got[41] == "Read our letter.\nIt is free." and len(got) == len(rows)


def test_very_long_page():
    long = "<p>" + "word " * 200_000 + "</p>"
    assert html.Page(f"<nav>no</nav><article>{long * 3}</article>").text().count("word") == 600_000


@pytest.mark.parametrize("part", ["<div>", "<p>", "<ul><li>", "<span></b>", "<a ", "<!--"])
def test_time_grows_with_the_page_however_deep(part):
    def seconds(n):
        start = time.perf_counter()
        html.Page(part * n + "x").text()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(120_000) < 24 * (seconds(10_000) + 0.05)  # a walk over the stack takes 144 times as long


def test_templates_are_removed_by_host(spark):
    rows = [(i, f"http://a.org/{i}", f"<body><div><p>Menu of the site</p></div><div><p>Own text number {i}.</p></div><div>Imprint</div></body>") for i in range(8)]
    rows += [(20 + i, "http://b.org/", f"<body><div><p>Menu of the site</p></div><p>Text {i}</p></body>") for i in range(2)]
    rows += [(40 + i, f"http://c.org/{i}", "<article><p>One text</p></article>") for i in range(9)] + [(60, None, None), (61, "x", ""), (62, "http://a.org/z", None)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.extract(pages, html.templates(pages)).collect()}
    assert all(got[i] == f"Own text number {i}." for i in range(8))
    assert got[20] == "Menu of the site\nText 0" and all(got[40 + i] == "One text" for i in range(9))
    assert got[60] == got[61] == got[62] == "" and len(got) == len(rows)
    assert html.extract(pages.limit(0), html.templates(pages.limit(0))).count() == 0


def test_pages_query(spark, sf_dir):
    import html as references

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in html.op7_html(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|br)>", " ", inner))
        assert r.text == "\n".join(b for b in (" ".join(references.unescape(x).split()) for x in blocks) if b)
        assert r.n_chars == len(r.text)


# --- urls ------------------------------------------------------------------------------------------------------------


def _judge(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]) if found else ""
    path = found[2] if found else ""
    fits = [(len(rule), rule, verdict) for rule, verdict in urls.HOST_RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    rule = max(fits) if fits else (0, None, None)
    query = (url or "").split("://", 1)[-1].split("#")[0].partition("?")[2] if found else ""
    bad = set(re.split("[^a-z0-9]+", host)) & set(urls.HOST_WORDS)
    bad |= {x.lower().split(".")[0] for x in path.split("/")[1:]} & set(urls.PATH_WORDS)
    bad |= {x.split("=")[0].lower() for x in query.split("&") if "=" in x} & set(urls.QUERY_NAMES)
    return host, path, rule[1], rule[2] or ("block" if bad else "allow")


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "http://net/", "http://net", "http://A.NET/x", "http://planet/", "http://x.example.net/en/a", "http://example.net/en", "http://example.com/de/?q", "https://www.EXAMPLE.com/de/x#y", "ftp://a.org/fr/b", "http://a.org/fr", "http://a.org?fr/", "http://casino-x.io/", "http://casinos.io/", "http://a://b.net/", "http://ÄÖ.net/é", "http://net/"]
    given += ["http://a.io/casino/x", "http://a.io/x/Casino.html?y=1", "http://a.io/casino-royale", "http://a.io/x?y=1&ClickID=7#z", "http://a.io/x?clickid", "http://a.io/?q=/porn/", "http://a.io/x#?adurl=1", "http://a.io?adurl=1", "http://a.io/adframe.js", "http://a.io/x?noadurl=1", "http://porn?x", "http://a.io/slots"]
    rows = [(i, u, "r") for i, u in enumerate(given)] + [(None, "http://net/", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urls.judge(pages, urls.default_rules(spark)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *_judge(u)) for i, u, _ in rows), key=str)
    assert 100 < urls.default_rules(spark).count() < 200
    assert urls.judge(pages.limit(0), urls.default_rules(spark)).count() == 0
    nothing = spark.createDataFrame([], urls._RULE)
    assert {r.verdict for r in urls.judge(pages, nothing).collect()} == {"allow"}


def test_urls_query_equals_sql(spark):
    d = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = sorted(con.execute(registry.ORACLES["op8_urls"]).fetchall())
    assert sorted(map(tuple, registry.QUERIES["op8_urls"](spark, d).collect())) == want
    con.execute("CREATE OR REPLACE TABLE odd AS SELECT unnest(range(7)) AS page_id, unnest(['http://a.io/casino/x', 'http://a.io/x/Casino.html?y=1', 'http://a.io/casino-royale', 'http://a.io/x?y=1&ClickID=7#z', 'http://a.io/?q=/porn/', 'http://a.io?adurl=1', 'http://a.io/slots']) AS url")
    got = con.execute(registry.ORACLES["op8_urls"].replace("FROM pages", "FROM odd")).fetchall()
    assert [r[4] for r in sorted(got)] == ["block", "block", "allow", "block", "allow", "block", "block"]


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    ids, now = [{r.doc_id for r in docs.collect()}], docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns
        rows = now.collect()
        ids.append({r.doc_id for r in rows})
        assert len(rows) == len(ids[-1]) and ids[-1] <= ids[-2]
    assert sum(labels.get(i) == 1 for i in ids[0] - ids[1]) <= 3 and sum(labels.get(i) == 0 for i in ids[1]) <= 3
    assert len(ids[1] - ids[2]) <= 5
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in ids[2]]
    by = defaultdict(list)
    for i, t in texts:
        by[frozenset(_bag(t).items())].append(i)
    assert all(len(set(same) & ids[3]) <= 1 for same in by.values())
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids[3]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES if n != "pipeline"] == [f"op{k}" for k in range(1, 11)] and "pipeline" in registry.QUERIES


def test_thousands_of_url_rules_from_a_table(spark, monkeypatch):
    draw = random.Random(8)
    hosts = [f"h{i}.{draw.choice(('com', 'org', 'net'))}" for i in range(700)]
    table = [("host", f"{h}/{draw.choice(('', 'a/', 'b/'))}", draw.choice(("block", "allow"))) for h in hosts]
    table += [("word", f"w{i}", "block") for i in range(800)] + [("path", f"p{i}", "block") for i in range(800)] + [("query", f"q{i}", "block") for i in range(800)]
    rules = urls.compiled(spark.createDataFrame(table + table[:50], "kind string, text string, verdict string"))
    made = rules.collect()
    assert len(made) == len(table)
    rows = [(None, None), (1, ""), (1, "no scheme"), *((i, "http://www.hot.com/") for i in range(3000))]
    for i in range(1500):
        host = draw.choice((f"www.{draw.choice(hosts)}", f"w{draw.randrange(1600)}.hot.com"))
        rows.append((i, f"http://{host}/{draw.choice(('a', 'b', f'P{draw.randrange(1600)}.html'))}/x?q{draw.randrange(1600)}=1#p1"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    tests = [(r.kind, r.rule, r.verdict, re.compile(r.pattern)) for r in made]
    want = []
    for i, url in rows:
        rest = (url or "").partition("://")[2].partition("#")[0]
        host = re.match("[^/?]*", rest)[0]
        at = host.lower() + rest[len(host) :]
        hits = [(len(rule), rule, verdict) for kind, rule, verdict, p in tests if kind == "host" and p.search(at)] if at else []
        bad = bool(at) and any(p.search(at) for kind, _, _, p in tests if kind != "host")
        want.append((i, max(hits)[1] if hits else None, max(hits)[2] if hits else "block" if bad else "allow"))
    assert {v for *_, v in want} == {"allow", "block"} and sum(r is not None for _, r, _ in want) > 100
    for most in (urls.MOST_RULES, 10):  # broadcast, and joined by salted tokens
        monkeypatch.setattr(urls, "MOST_RULES", most)
        assert Counter((r.page_id, r.rule, r.verdict) for r in urls.judge(pages, rules).collect()) == Counter(want)
    assert urls.compiled(spark.createDataFrame([], "kind string, text string, verdict string")).count() == 0
    for row in (("host", None, "block"), ("word", "x", "allow"), ("else", "x", "block")):
        with pytest.raises(Exception, match="no rule"):
            urls.compiled(spark.createDataFrame([row], "kind string, text string, verdict string")).collect()
