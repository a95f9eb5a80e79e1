from itertools import product

import pytest
from pyspark.sql import functions as F

from caseloom.llm.main_text import Field, decoded, extracted_texts, features, main_text, train, trained_field
from caseloom.llm.page_blocks import page_blocks
from caseloom.llm.page_labels import labelled_pages


@pytest.fixture(scope="module")
def field():
    return trained_field()


def texts(html):
    return [b.text for b in page_blocks(html)]


@pytest.mark.parametrize("html, blocks", [
    ("", []), ("plain", ["plain"]), ("<p>a<p>b</p>c", ["a", "b", "c"]), ("a <b>b</b><i>c</i> d<br>e", ["a bc d e"]),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style>", ["x"]), ("<SCRIPT>x</script >y", ["y"]), ("<script>never closed <p>x", []),
    ("a<!-- <p>no</p> -->b<!-->c<!---->d", ["abcd"]), ("a<!-- open", ["a"]), ("x &lt;b&gt; &eacute;&#233;&#x41;&copy &am", ["x <b> ééA© &am"]),
    ("1 < 2 <3 > 0 <", ["1 < 2 <3 > 0 <"]), ("a<p class='x", ["a"]), ("a</", ["a"]), ("a</p", ["a"]), ("a<", ["a<"]),
    ('<p title="a > b" x=\'c > d\'>t</p>', ["t"]), ('<p title="no end>t</p>', ["t"]), ("a \n\t b&nbsp;c　d", ["a b c d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]), ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<textarea>x<p>y</textarea>z", ["z"]), ("<title>t</title><noscript>n</noscript><p>p", ["p"]), ("<div/>a</div>b", ["a", "b"]),
    ("<svg/>a<svg><text>b</text></svg>c", ["ac"]), ("<!DOCTYPE html><?xml a?><![CDATA[x]]>y", ["y"]), ("</div></p>a</section>", ["a"]),
])
def test_blocks_of_all_kinds_of_markup(html, blocks):
    assert texts(html) == blocks


def test_blocks_know_what_is_around_them():
    a, b = page_blocks('<div class="siteMenu main-nav" id=top><ul><li hidden><a href=x>one</a> two</ul></div><p data-main role=note>three')
    assert a.tags == ("div", "ul", "li") and a.words == {"site", "menu", "main", "nav", "top", "hidden"} and not a.main
    assert a.linked == 3 / 7 and b.tags == ("p",) and b.words == {"note"} and b.main and b.linked == 0


def test_tags_of_a_long_broken_page_take_no_long():
    assert len(page_blocks("<p>x" * 50_000)) == 50_000
    assert page_blocks("<div " * 100_000) == [] and page_blocks('<a href="' * 50_000) == []
    assert len(page_blocks("<div>" * 2_000 + "x")) == 1


def test_viterbi_finds_the_best_of_all_labellings():
    blocks = page_blocks("<h1>a</h1><p>b c d.</p><li><a href=x>e</a></li><p>f</p><footer>g</footer>")
    made = features(blocks)
    weights = {n: ((hash_ * 37) % 11 - 5) / 3 for hash_, n in enumerate(sorted({n for f in made for n in f}))}
    for steps in (((0.5, -0.4), (0.1, 0.3)), ((-1.0, 2.0), (1.5, -2.0))):
        field = Field(weights, steps, 0.7, -0.9)
        scores = [sum(weights[n] for n in f) for f in made]

        def total(labels):
            return (sum(s for s, y in zip(scores, labels) if y) + sum(steps[a][b] for a, b in zip(labels, labels[1:]))
                    + field.first * labels[0] + field.last * labels[-1])

        assert total(decoded(field, blocks)) == pytest.approx(max(total(y) for y in product((0, 1), repeat=len(blocks))))


def test_held_out_pages(field):
    right = total = whole = 0
    pages = list(labelled_pages(300, seed=77))
    for blocks in map(page_blocks, pages):
        labels = [b.main for b in blocks]
        got = decoded(field, blocks)
        right, total, whole = right + sum(a == b for a, b in zip(got, labels)), total + len(blocks), whole + (got == labels)
    assert right / total > 0.99 and whole / len(pages) > 0.9


PAGE = """<html><head><title>Title</title></head><body>
<div id="cookie-banner"><p>We use cookies on this site.</p><button>Accept</button></div>
<header><a href="/">Daily</a><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">Sports</a></li><li><a href="/c">Contact</a></li></ul></nav>
<form><input name=q><button>Search</button></form></header>
<main><article><h1>The river &amp; its town</h1><p>The river rose in the night, and the town woke to it.</p>
<div class="ad">Buy boots now, half price until Sunday!</div>
<h2>What came of it</h2><p>Nobody was hurt. <a href="/x">The mayor</a> spoke at noon.</p><ul><li>Two bridges closed</li><li>One road under water</li></ul>
<div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></article>
<aside class="sidebar"><h3>Related articles</h3><ul><li><a href="/1">A dry summer behind us</a></li></ul></aside>
<section id="comments"><h3>2 comments</h3><div class="comment"><p>Ann</p><p>I saw it from my window, it was a long night.</p></div>
<form><textarea name=t></textarea><button>Post comment</button></form></section></main>
<footer><p>&copy; 2024 Daily. All rights reserved.</p></footer></body></html>"""

TEXT = "\n\n".join(["The river & its town", "The river rose in the night, and the town woke to it.", "What came of it",
                    "Nobody was hurt. The mayor spoke at noon.", "Two bridges closed", "One road under water"])


def test_a_page_written_by_hand(field):
    assert main_text(field, PAGE) == TEXT
    assert main_text(field, PAGE.replace("<article>", "<div class='post'>").replace("</article>", "</div>").replace("main>", "div>")) == TEXT


def test_pages_of_the_tables(spark, field):
    """Their articles are titles and paragraphs."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    block = F.expr(r"""transform(split(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|<[^>]*$|$)', 1),
                    '</?b>', ''), '<br>', ' '), '</?(?:p|h1)>'), x -> trim(regexp_replace(x, '\\s+', ' ')))""")
    plain = pages.select("page_id", F.array_join(F.filter(block, lambda x: x != ""), "\n\n").alias("plain"))
    decoded_plain = F.replace(F.replace(F.replace("plain", F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")), F.lit("&middot;"), F.lit("·"))
    both = extracted_texts(pages, field).join(plain, "page_id").select("page_id", "text", decoded_plain.alias("want")).collect()
    differing = [r["page_id"] for r in both if r["text"] != r["want"] and not r["want"].endswith(("&", "&am", "&amp"))]
    assert len(both) > 20 and differing == []


def test_odd_rows(spark, field):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "v", " \n "), (4, "w", "<p>" + "word " * 200_000 + "end.</p>"), (5, "x", "<<<>>>&&&")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(7) for c in ("text", "n_chars", "main", "__text")})
    got = sorted((r["page_id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in extracted_texts(df, field).collect())
    assert [g for g in got if g[0] in (0, 1, 2, 3)] == [(0, "", "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, "", "", 0), (3, "v", "", 0)]
    assert next(g[3] for g in got if g[0] == 4) in (0, 1_000_004)
    assert extracted_texts(df.limit(0), field).collect() == []


def test_trained_on_given_pages(spark):
    pages = spark.createDataFrame([(p,) for p in labelled_pages(60, seed=5)] + [(None,), ("",)], "html string")
    given = trained_field(pages)
    assert given.weights["own h1"] > 0 and given == trained_field(pages.repartition(5))
    assert train(list(labelled_pages(20)), rounds=3) == train(list(labelled_pages(20)), rounds=3)
