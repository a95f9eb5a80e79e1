import hashlib

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.operators import pages as P
from caseloom.sources import files


def one_page(spark, html, url="https://x.org/a/b"):
    return spark.createDataFrame([(1, url, html)], schemas.PAGES)


def test_main_text(spark):
    html = ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href='/n'>menu</a></nav><!-- note <p>x</p> -->"
            "<script>var t='</p>';</script><div class=\"ad\">buy</div><header>Top</header><p>Caf&eacute; &amp; <b>bon</b>\n\t&lt;ok&gt;</p>"
            "<footer>&copy; me</footer></body></html>")
    assert P.extract_main_text(one_page(spark, html)).first().text == "Top Café & bon <ok>"


def test_markup_in_either_case_and_any_quotes(spark):
    html = ("<HEAD>x</HEAD><SCRIPT>var x='<p>no</p>';</SCRIPT><DIV CLASS=\"ad big\">buy<div>in</div>more</DIV><p>after</p>"
            "<div class='x ad'>no</div><div class=ad>no</div><div data-class=\"ad\">yes</div><div class=\"adverb\">too</div>"
            "<p>&#233;&#xE9;&hellip;&amp;lt;&nope;&#0;&#55296;&#128512;</p>")
    assert P.extract_main_text(one_page(spark, html)).first().text == "after yes too éé…&lt;&nope;\ufffd\ufffd😀"


def test_links_in_any_quotes(spark):
    html = "<a href='p?a=1&amp;b=2' title=\"a>b\">x</a><A HREF=q>u</A><a class=c href=\"../x/./y\">d</a><a href='/a/../../b/.'>e</a>"
    page = one_page(spark, html, "https://h.org/a/b/c?z#f")
    real = [r.link for r in P.extract_links(page, mode="resolve").orderBy("pos").collect()]
    assert real == ["https://h.org/a/b/p?a=1&b=2", "https://h.org/a/b/q", "https://h.org/a/x/y", "https://h.org/b/"]
    assert P.extract_links(page).orderBy("pos").first().link == "https://h.org/a/b/c?z#fp?a=1&b=2"


def test_fallback_source(spark):
    df = spark.createDataFrame([(1, "u", "<head></head>", "<p>second</p>"), (2, "u", "<p>first</p>", "<p>second</p>"),
                                (3, "u", None, None)], "page_id long, url string, html string, other string")
    got = {r.page_id: r.text for r in P.extract_main_text(df, fallback=F.col("other")).collect()}
    assert got == {1: "second", 2: "first", 3: None}


def test_links(spark):
    html = ("<a>no</a><a href=\"\">empty</a><a href=\"#top\">t</a><a class=\"c\" href=\"/x\">x</a><A HREF='y.html'>y</A>"
            "<a data-href=\"no\">n</a><!-- <a href=\"/hidden\">h</a> --><a href=\"https://z.org/\">z</a><a href=\"/x\">again</a>"
            "<abbr href=\"no\">q</abbr>")
    page = one_page(spark, html)
    got = [(r.pos, r.link) for r in P.extract_links(page).orderBy("pos").collect()]
    base = "https://x.org/a/b"
    assert got == [(1, base + "#top"), (2, base + "/x"), (3, base + "y.html"), (4, base + "https://z.org/"), (5, base + "/x")]
    real = [r.link for r in P.extract_links(page, mode="resolve").orderBy("pos").collect()]
    assert real == [base + "#top", "https://x.org/x", "https://x.org/a/y.html", "https://z.org/", "https://x.org/x"]


def test_resolve_forms(spark):
    hrefs = ["//cdn.org/i", "?q=1", "mailto:a@b.c", "c"]
    html = "".join(f'<a href="{h}">x</a>' for h in hrefs)
    got = [r.link for r in P.extract_links(one_page(spark, html, "https://x.org"), mode="resolve").orderBy("pos").collect()]
    assert got == ["https://cdn.org/i", "https://x.org?q=1", "mailto:a@b.c", "https://x.org/c"]


def links_of(spark, counts, step=1):
    return spark.createDataFrame([(p, i * step, f"u{(p + i) % 7}") for p, n in enumerate(counts) for i in range(1, n + 1)],
                                 schemas.LINKS)


def test_frontier(spark, rows):
    dense = links_of(spark, [0, 1, 5, 6, 8])
    assert rows(P.crawl_frontier(dense)) == rows(P.crawl_frontier(dense, dense=True))
    gaps = links_of(spark, [0, 1, 5, 6, 8], step=3)
    got = rows(P.crawl_frontier(gaps, k=2), "page_id", "pos")
    assert got == [(1, 3), (2, 3), (2, 6), (3, 3), (3, 6), (4, 3), (4, 6)]


def texts(spark):
    return spark.createDataFrame([(0, "u0", "old"), (9, "u0", "new"), (1, "u1", "one"), (2, "u2", None)],
                                 "page_id long, url string, text string")


def test_crawl_join_keeps_every_link(spark, rows):
    frontier = P.crawl_frontier(links_of(spark, [0, 1, 5, 6, 8]))
    plain = rows(P.crawl_join(frontier, texts(spark)))
    assert len(plain) == frontier.count()
    by_link = {link: (text, hit) for _, _, link, text, hit in plain}
    assert by_link["u0"] == ("new", True)
    assert by_link["u2"] == ("", True)
    assert by_link["u5"] == ("", False)


def test_status_coverage_pending(spark, rows):
    links = links_of(spark, [0, 1, 5, 6, 8])
    got = rows(P.link_status(links, texts(spark)))
    assert got == rows(P.link_status(links, texts(spark), dense=True))
    status = P.link_status(links, texts(spark))
    assert status.filter("attempted").count() == 1 + 5 + 5 + 5
    assert rows(P.pending_links(status)) == sorted((p, n, u) for p, n, u, a, f in got if not (a and f))
    cover = {r.page_id: r for r in P.crawl_coverage(status).collect()}
    assert cover[4].found == 8 and cover[4].attempted == 5 and cover[4].progress == 5 / 8
    assert cover[2].progress == 1.0


def test_accumulate_and_context(spark, rows):
    pages = spark.createDataFrame([(0, "a", "A"), (1, "b", None), (2, "c", "C")], "page_id long, url string, text string")
    crawled = spark.createDataFrame([(0, 2, "u1", "two", True), (0, 1, "u0", "one", True), (1, 1, "u9", "", False)],
                                    "page_id long, pos int, link string, text string, fetched boolean")
    acc = P.accumulate_text(pages, crawled)
    assert rows(acc) == [(0, 2, "Aonetwo"), (1, 0, ""), (2, 0, "C")]
    links = spark.createDataFrame([(0, i, f"l{i}") for i in range(1, 8)] + [(1, 1, "u9")], schemas.LINKS)
    whole = {r.page_id: (r.num_urls, r.context) for r in P.report_context(acc, links).collect()}
    assert whole[0] == (8, "Aonetwo" + str([f"l{i}" for i in range(1, 8)]))
    assert whole[1] == (2, "['u9']")
    assert whole[2] == (1, "C[]")
    long = spark.createDataFrame([(2, i, f"l{i}") for i in range(1, 3001)], schemas.LINKS)
    got = {r.page_id: (r.num_urls, r.context) for r in P.report_context(acc, long).collect()}
    assert got[2] == (3001, "C" + str([f"l{i}" for i in range(1, 3001)])) and got[0] == (1, "Aonetwo[]")


def test_keyed_texts(spark):
    got = {r.url: (r.file_name, r.text) for r in P.keyed_texts(texts(spark)).collect()}
    assert got["u0"] == (hashlib.md5(b"u0").hexdigest() + ".txt", "new")
    assert got["u2"][1] == ""


def test_html_is_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.range(20).selectExpr("id as page_id", "'u' || id as url", "'<p>x</p><a href=\"/y\">z</a>' as html").write.parquet(path)
    pages = spark.read.parquet(path)
    plan = P.crawl_join(P.crawl_frontier(P.extract_links(pages)), P.extract_main_text(pages))
    text = plan._jdf.queryExecution().executedPlan().toString()
    for line in text.splitlines():
        if "Exchange" in line:
            assert "html" not in line


def test_runs_of_a_keyed_store_leave_each_others_texts(spark, rows, tmp_path):
    path = str(tmp_path / "texts")
    page = lambda *given: P.keyed_texts(spark.createDataFrame(given, "page_id long, url string, text string"))
    assert files.append_keyed_texts(page((1, "a", "a1"), (2, "b", "b1"), (3, "c", None)), path) == 1
    assert rows(files.latest_keyed_texts(spark, path), "url", "text", "version") == [("a", "a1", 1), ("b", "b1", 1), ("c", "", 1)]
    assert files.append_keyed_texts(page((1, "b", "b2"), (4, "d", "d2"), (5, "d", "d3")), path) == 2
    assert files.append_keyed_texts(page((9, "a", "a3")), path, version=7) == 7
    latest = [("a", "a3", 7), ("b", "b2", 2), ("c", "", 1), ("d", "d3", 2)]
    assert rows(files.latest_keyed_texts(spark, path), "url", "text", "version") == latest
    assert files.compact_keyed_texts(spark, path) == 8 and files.text_versions(spark, path) == [8]
    assert rows(files.latest_keyed_texts(spark, path), "url", "text") == [r[:2] for r in latest]
    assert files.compact_keyed_texts(spark, path) == 8


def test_two_runs_of_one_number_do_not_mix(spark, tmp_path):
    path = str(tmp_path / "texts")
    texts = P.keyed_texts(spark.createDataFrame([(1, "a", "x")], "page_id long, url string, text string"))
    files.append_keyed_texts(texts, path, version=1)
    with pytest.raises(AnalysisException):
        files.append_keyed_texts(texts, path, version=1)
    with pytest.raises(FileNotFoundError):
        files.latest_keyed_texts(spark, str(tmp_path / "none"))


def blocks_of(spark, html):
    return P.main_text_by_blocks(one_page(spark, html)).first().text


def test_main_text_by_blocks(spark):
    html = """<html><head><title>T.</title></head><body><div class="topnav menu"><a href=/>Home.</a></div>
<div><a href=/a>News.</a> <a href=/b>Sports and more of it, as ever, on all of our pages.</a></div>
<div class="x ad y"><div><div><div>Buy this now.</div></div>And this.</div>Really.</div>
<div><h1>The title</h1><p>First <a href=/x>sentence</a> of it.<p>A long one without an end that goes on and on for ten words
<div class="share">Share this page now.</div>
<div>Beside it</div><div>not beside it</div><p>two</p><p>three</p><ul><li>One &amp; only<li>Caf&eacute; &lt;b&gt; (as they say.)</ul></div>
<form><p>Your name.</p></form><section id=c class="comments"><p>I like this very much, thank you for it all.</p></section>
<footer><p>All rights reserved.</p></footer><script>var a = "<p>No.</p>";</script></body></html>"""
    assert blocks_of(spark, html).split("\n\n") == [
        "The title", "First sentence of it.", "A long one without an end that goes on and on for ten words", "Beside it", "One & only", "Café <b> (as they say.)"]


def test_blocks_at_their_borders(spark):
    assert blocks_of(spark, "<div>a one.<p>b two.</p>c three.<b>d</b> e.</div>") == "a one.\n\nb two.\n\nc three.d e."
    assert blocks_of(spark, "x y.<br>z.<hr>w.") == "x y. z.\n\nw."
    assert blocks_of(spark, "<p><a href=q>Half of it is</a> linked so.") is None
    assert blocks_of(spark, "<div class='advice'>Kept here.</div><div class=ad>Not.") == "Kept here."
    assert blocks_of(spark, "") is None and blocks_of(spark, "<p> </p>") is None
    many = "".join(f"<p>Line {i}.</p>" for i in range(700))
    assert blocks_of(spark, many) == "\n\n".join(f"Line {i}." for i in range(700))
