"""HTML extraction, WARC derivatives and the pipeline."""

import html as H
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from storelens.llm import extraction as X
from storelens.llm import warc as W
from storelens.llm.dom import parse
from storelens.llm.queries import op7_warc

PAGE = """<html><body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav>
<main><article><header><h1>Title &amp; more</h1></header><p>One <span class="ad">buy</span>two<br>three<ul><li>a<li>b</ul>
<form><p>mail</p></form><aside>side</aside><section class="comments"><article><p>nice</p></article></section><p>End</p>
<table><tr><td>c1<td>c2</table></article></main><footer>f</footer>"""


@pytest.mark.parametrize(("html", "text"), [
    (PAGE, "Title & more\n\nOne two three\n\na\n\nb\n\nEnd\n\nc1\n\nc2"), (None, ""), ("", ""), ("plain &lt;text", "plain <text"),
    ("<p>a<p>b<!-- un", "a\n\nb"), ("<div>" * 3000 + "deep <b>x", "deep x"), ("<p>x</p><script>var a='</p>'</script>y", "x\n\ny"),
    ("<article><p>a&nbsp;&#65;&unknown;</article", "a A&unknown;"), ("<ul><li><a href=1>m</a><li><a href=2>n</a></ul><p>words here</p>", "words here"),
])
def test_main_text(html, text):
    assert X.main_text(html) == text


LONG = [f"Paragraph {k} of the story goes on with many more words than any title or date has." for k in range(6)]
STORY = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize(("html", "text"), [
    # no tag marks the article; dates, related titles and comments stand in neutral blocks
    (f"<body><div class=x1>May 5, by Ann</div><div class='post-body'>{STORY}</div><div class=x2>Another story you may like</div><div class=x3>Nice one, Bob</div>", LONG),
    (f"<div id=page><div class=x><h1>The title</h1><div class=x1>May 5</div><div class=y>{STORY}</div><div class=x2>Some other title</div></div></div>", ["The title", *LONG]),
    (f"<div class=x><p>{LONG[0]}</p><div class=y>{STORY}</div></div>", [LONG[0], *LONG]),
    (f"<div><section>{STORY}</section><section><p>{LONG[0]}</p></section></div>", [*LONG, LONG[0]]),
    # several articles, one longer than the others
    (f"<main><article>{STORY}</article><article><p>{LONG[1]}</p></article><div>Older posts</div></main>", [*LONG, LONG[1]]),
    # teasers beside the text of main
    (f"<main><h1>T</h1>{STORY}<article><p>A teaser</p></article><article><p>One more</p></article></main>", ["T", *LONG]),
    (f"<main><div class=y>{STORY}</div><article><p>A teaser</p></article></main>", LONG),
])
def test_region_is_where_the_text_varies(html, text):
    assert X.main_text(html) == "\n\n".join(text)


@pytest.mark.parametrize("before", ['<script>var s="<!-- ad";</script>', "<style>/* <!-- */</style>", '<div title="<!-- x">d</div>'])
def test_a_comment_start_outside_markup_cuts_nothing(before):
    page = f"{before}<article><p>one <a href='/n'>two</a></p><p>three</p></article>"
    assert X.main_text(page) == "one two\n\nthree"
    meta, text = W.derivatives("<urn:uuid:9>", "u", "d", "", page.encode())
    assert bytes(text[8]).endswith(b"one two\n\nthree") and b"outlink: /n" in meta[8]
    assert X.main_text("<article><p>a</p><!-- open <p>b</p><p>c</p></article>") == "a"
    assert X.main_text("<article><p>a</p><!-- shut --><p>b</p><!-- open <p>c</p>") == "a\n\nb"


def test_wrapper_drops_what_all_pages_share():
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    pages = [f"<div><div>Welcome to the site</div><div><h1>{w}</h1><p>{w} tells a long story of {w} and others</p><p>Read more below</p></div></div>" for w in words]
    wrapper = X.induce(pages)
    import json
    got = X.main_text(pages[2], json.dumps(wrapper))
    assert got == "gamma\n\ngamma tells a long story of gamma and others"
    assert X.induce(pages[:4]) is None
    copies = [f"<div><p>The very same long article stands on every page of this host</p><i>{w}</i></div>" for w in words]
    assert X.induce(copies) is None


def test_template_is_counted_over_all_pages_of_a_host(spark):
    rng = random.Random(4)
    story = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(40))
    one = lambda t: f"<div><div>We close early on Fridays</div><p>{t}</p></div>"
    two = lambda t: f"<div><div>The other layout's notice</div><p>{t}</p><div>Our address and hours</div></div>"
    rows = [(f"http://big.org/{k}", t, (two if k % 4 == 0 else one)(t)) for k in range(40) for t in [story()]]
    rows += [(f"http://big.org/e{k}", None, f"<h1>Error {k}</h1>") for k in range(1)]
    rows += [(f"http://small.org/{k}", t, one(t)) for k in range(3) for t in [story()]]
    rows += [(f"http://copies.org/{k}", t, f"<div><div>{t}</div><i>{k}</i></div>") for t in [story()] for k in range(2)]
    d = spark.createDataFrame([(k, u, h) for k, (u, _, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.url: r.text for r in X.extract_pages(d).collect()}
    assert all(got[u] == t for u, t, _ in rows if "big" in u and t or "small" in u)
    assert all(t in got[u] for u, t, _ in rows if "copies" in u)


@pytest.mark.parametrize(("html", "text"), [
    # names that only contain such a word, or hold most of the text, don't count
    ('<article><h1>T</h1><div class="notice-board"><p>A b c d e f.</p></div></article>', ["T", "A b c d e f."]),
    ('<article><h1>T</h1><p class="promo">A b c.</p><p class="promo">D e f.</p></article>', ["T", "A b c.", "D e f."]),
    ('<article><p>Intro.</p><section class="related-work"><p>Earlier.</p></section><section id="comments-on-law"><p>Law.</p></section></article>',
     ["Intro.", "Earlier.", "Law."]),
    (f"<article>{STORY}<div class='related-posts'><p>Others</p></div><div class='cookie-notice'>We use cookies</div></article>", LONG),
    (f"<article><div class='comments'>{STORY}</div></article>", LONG),
])
def test_names_are_hints(html, text):
    assert X.main_text(html) == "\n\n".join(text)


@pytest.mark.parametrize("tag", ["article", "div"])
def test_headings_that_all_pages_of_a_host_have_stay(spark, tag):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        title, things, steps = words(4), words(30), words(60)
        rows.append((k, f"http://cook.org/{k}", f"<div>Eat well</div><{tag}><h1>{title}</h1><h2>Ingredients</h2><p>{things}</p><h2>Method</h2><p>{steps}</p></{tag}>"))
        want[k] = "\n\n".join([title, "Ingredients", things, "Method", steps])
    got = X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == want


def test_long_pages_are_aligned_and_read_in_proportion():
    import time

    def page(k, n):
        return X.grouped(X.read("".join(f"<h2>a{i}{k}</h2><p>b</p><ul><li>c</ul>" for i in range(n))))

    start = time.time()
    size, pairs = X.tree_match(page(1, 7000), page(2, 6990))
    assert size > 6990 * 4 and len(pairs) == size
    for html in ("<b>" * 80000 + "x", "<b>x</b>" * 80000, "<i>" * 8000 + "<p>y</b>" * 8000):
        assert X.main_text(html)
    assert time.time() - start < 60


def test_matches_of_short_sequences_are_the_largest():
    rng = random.Random(9)

    def tree(depth):
        return [rng.choice("abc"), [], [tree(depth - 1) for _ in range(rng.randrange(5))] if depth else []]

    def largest(a, b):
        if a[0] != b[0]:
            return 0
        best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
        for i, x in enumerate(a[2]):
            for j, y in enumerate(b[2]):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + largest(x, y))
        return best[-1][-1] + 1

    for _ in range(300):
        a, b = tree(3), tree(3)
        size, pairs = X.tree_match(a, b)
        assert size == largest(a, b) == len(pairs)
        assert all(x[0] == y[0] for x, y in pairs)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_extraction_of_all_pages_equals_their_articles(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    extra = spark.createDataFrame([(-1, None, None), (-2, "http://a.b/c", ""), (-3, "nohost", "<p>x</p>"), (-3, "nohost", "<p>x</p>")], pages.schema)
    got = X.extract_pages(pages.union(extra).withColumn("text", F.lit("clash"))).collect()
    want = []
    for p in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        want.append((p.page_id, p.url, text, len(text)))
    want += [(-1, None, "", 0), (-2, "http://a.b/c", "", 0), (-3, "nohost", "x", 1), (-3, "nohost", "x", 1)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert X.extract_pages(pages.limit(0)).count() == 0


def test_warc_derivatives_round_trip(spark):
    rows = [("<urn:uuid:1>", "http://a/b", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: x\r\n", b"<title>T &amp; u</title><p>a<p>b <a href='/c'>l</a>"),
            ("<urn:uuid:2>", None, None, None, None), ("<urn:uuid:3>", "u", "d", "", b"\xff<p>x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "record_id string, target_uri string, date string, http_headers string, payload binary, block int")
    derived = W.derive(df)
    records = {r.record_id: bytes(r.record) for r in W.to_records(derived).collect()}
    found = dict(zip(records, ([*W.parsed(x)][0] for x in records.values()), strict=True))
    out = derived.collect()
    assert len(out) == 6 and len(found) == 6
    for r in out:
        head, block = found[r.record_id]
        h = dict(head)
        assert block == bytes(r.block) and h["WARC-Refers-To"] == r.refers_to and h["WARC-Block-Digest"] == W.digest(block)
        assert h["WARC-Refers-To-Payload-Digest"] == W.digest(dict((x[0], x[4] or b"") for x in rows)[r.refers_to])
    first = {r.warc_type: r for r in out if r.refers_to == "<urn:uuid:1>"}
    assert first["conversion"].block == b"a\n\nb l"
    assert first["metadata"].block == b"title: T & u\r\nblocks: 2\r\noutlink: /c\r\n"
    assert ("WARC-Source-Header", "Server: x") in found[first["conversion"].record_id][0]
    whole = b"".join(records.values())
    assert len([*W.parsed(whole)]) == 6
    assert W.derive(df.limit(0)).count() == 0


def test_derivative_report_has_two_records_a_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = W.derivative_report(pages).collect()
    assert len(rows) == 2 * pages.count() and len({r.record_id for r in rows}) == len(rows)
    html = {r.url: r.html for r in pages.collect()}
    assert all(r.source_digest == W.digest(html[r.target_uri].encode()) for r in rows)
    assert all(r.n_links == len(parse(html[r.target_uri]).links) for r in rows)


@pytest.mark.parametrize(("headers", "payload", "text"), [
    ("Content-Type: text/html; charset=ISO-8859-1\r\n", "<p>caf\xe9</p>".encode("latin-1"), "caf\xe9"),
    ("X: y\r\ncontent-type: text/html;charset=\"windows-1251\"", "<p>\u043c\u0438\u0440</p>".encode("cp1251"), "\u043c\u0438\u0440"),
    ("Content-Type: text/html; charset=nonsense\r\n", "<p>\u20ac</p>".encode(), "\u20ac"), ("Content-Type: text/html; charset=hex", b"<p>x", "x"),
    ("Content-Type: text/html", "<p>\u20ac</p>".encode(), "\u20ac"), (None, b"<p>\xff", "\ufffd")])
def test_payloads_are_read_in_the_charset_of_their_headers(headers, payload, text):
    assert bytes(W.derivatives("<urn:uuid:1>", "u", "d", headers, payload)[1][8]).decode() == text


def test_pages_of_one_name_have_records_of_their_own(spark):
    rows = [(1, "http://a/b", "<p>one"), (1, "http://a/b", "<p>two"), (1, None, "<p>one"), (None, "1", "<p>one")]
    got = W.derivative_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len({r.record_id for r in got}) == 2 * len(rows) and len({r.refers_to for r in got}) == len(rows)


def test_the_warc_query_has_the_blocks(spark):
    rows = op7_warc(spark, "/root/testdata/sf0.001").collect()
    assert all(W.digest(bytes(r.block)) == r.block_digest and len(r.block) == r.content_length for r in rows)
    assert all(len(r.block) > 0 for r in rows)


def test_pipeline_stages_keep_the_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = " ".join(f"word{i}" for i in range(60))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    planted = [(10**6, None, "en", "s", 0), (10**6 + 1, "123 456", "en", "s", 7), (10**6 + 2, text, "en", "s", len(text)),
               (10**6 + 3, text, "en", "s", len(text)), (10**6 + 4, f"The other day {item} and so on", "en", "s", 0), (10**6 + 5, "the thing and the other", "en", "s", 23)]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, sf), "test")
        assert out.columns == docs.columns, name
        docs = out
    ids = {r.doc_id for r in docs.collect()}
    assert 10**6 + 2 in ids and 10**6 + 5 in ids
    assert not ids & {10**6, 10**6 + 1, 10**6 + 3, 10**6 + 4}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == ids


def test_queries_are_registered_and_the_library_does_not_import_them():
    import __spark_entry__
    names = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)) and "pipeline" in names
    import pathlib
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "storelens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
