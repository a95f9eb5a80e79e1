import pytest
from pyspark.sql import functions as F

from caseloom.functions.markdown import markdown_html

CASES = [
    ("", ""), ("  \n\n ", ""), ("one\n two \n\n\nthree", "<p>one\ntwo</p>\n<p>three</p>"),
    ("# T #\n###### six\n####### seven\n#no", "<h1>T</h1>\n<h6>six</h6>\n<p>####### seven\n#no</p>"),
    ("- x\n* y\nz\n+ w\n\nend", "<ul>\n<li>x</li>\n<li>y\nz</li>\n<li>w</li>\n</ul>\n<p>end</p>"),
    ("1. p\n22. q", "<ol>\n<li>p</li>\n<li>q</li>\n</ol>"), ("- a\n1. b", "<ul>\n<li>a</li>\n</ul>\n<ol>\n<li>b</li>\n</ol>"),
    ("```py\nx < 1 & **y**\n\n# no\n```\nend", "<pre><code>x &lt; 1 &amp; **y**\n\n# no\n</code></pre>\n<p>end</p>"),
    ("```\nopen", "<pre><code>open\n</code></pre>"), ("```\n```", "<pre><code></code></pre>"), ("```", "<pre><code></code></pre>"),
    ("**a** *b* _c_ d_e_f ** * `**g** <` h`", "<p><strong>a</strong> <em>b</em> <em>c</em> d_e_f ** * <code>**g** &lt;</code> h`</p>"),
    ("[x](http://y/a_b_c) [no] (u) <script>&amp;", '<p><a href="http://y/a_b_c">x</a> [no] (u) &lt;script>&amp;amp;</p>'),
    ("a\r\nb\r\n\r\n- c", "<p>a\nb</p>\n<ul>\n<li>c</li>\n</ul>"), ("## A\ntext\n## B", "<h2>A</h2>\n<p>text</p>\n<h2>B</h2>"),
]


def test_markdown(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, text string")
    got = {r.i: r.html for r in df.select("i", markdown_html(F.col("text")).alias("html")).collect()}
    for i, (text, html) in enumerate(CASES):
        assert got[i] == html, text


@pytest.mark.parametrize("lines", [1, 63, 64, 65, 300])
def test_long_texts(spark, lines):
    text = "\n".join(["```", *(f"- {i}" for i in range(lines)), "```", *(f"- {i}" for i in range(lines))])
    html = spark.createDataFrame([(text,)], "text string").select(markdown_html(F.col("text")).alias("html")).first().html
    assert html == "<pre><code>" + "".join(f"- {i}\n" for i in range(lines)) + "</code></pre>\n<ul>\n" + "".join(f"<li>{i}</li>\n" for i in range(lines)) + "</ul>"
