"""The element fold and the case reading against a tree built tag by tag."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from caseloom import schemas
from caseloom.functions import elements as E
from caseloom.operators import cases as C


class Tree(HTMLParser):
    """Elements as ``[name, attributes, children]``; end tags close up to the innermost one of their name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.in_text = False    # any tag ends a text, an end tag that ends nothing as well
        self.feed(html)
        self.close()

    def add_text(self, text):
        if self.in_text:
            self.open[-1][2][-1] += text
        else:
            self.open[-1][2].append(text)
        self.in_text = True

    def handle_starttag(self, tag, attrs):
        self.in_text = False
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in E.EMPTY:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.in_text = False
        self.open[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        self.in_text = False
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.add_text(data)

    def handle_entityref(self, name):
        self.add_text({"amp": "&", "eacute": "é", "lt": "<"}[name])

    def handle_charref(self, name):
        self.add_text(chr(int(name)))

    def handle_comment(self, data):
        self.in_text = False
        self.open[-1][2].append("\0" + data)


def walk(node):
    for child in node[2]:
        yield child, node
        if not isinstance(child, str):
            yield from walk(child)


def only_string(node):
    while len(node[2]) == 1:
        node = node[2][0]
        if isinstance(node, str):
            return node.lstrip("\0")
    return None


def expected(html):
    tree = Tree(html).root
    items = [only_string(n) for n, _ in walk(tree) if not isinstance(n, str) and n[0] == "li" and "mrgn-bttm-md" in (n[1].get("class") or "").split()]
    status = href = None
    for cell, row in walk(tree):
        if not isinstance(cell, str) and cell[0] == "td":
            at = next(i for i, c in enumerate(row[2]) if c is cell)
            beside = next((c for c in row[2][at + 1:] if not isinstance(c, str)), None)
            link = next((n for n, _ in walk(beside) if not isinstance(n, str) and n[0] == "a"), None) if beside else None
            if link:
                status = "".join("".join(t for t, _ in walk(link) if isinstance(t, str) and not t.startswith("\0")).split())
                href = link[1].get("href")
            break
    return status, href, items


PAGES = [
    # nested first cell, comments, other cells, stray and missing tags
    "<table><tr><td>PR<table><tr><td>in</td> <td><a href='?id=1&'>no</a></td></tr></table></td> <td><a href='?id=2&'>Yes</a></td></tr></table>",
    "<tr><td>PR</td><!-- <td><a href='?id=1&'>no</a></td> --> <td><a href='?id=2&'> In  P </a></td></tr>",
    "<!-- <td> --><tr><td>PR</td>text<td><table><tr><td><b>x</b><a href='?id=3&'>A<i>b</i><!-- c -->d</a></td></tr></table></td></tr>",
    "<tr><td>PR<td><a href='?id=4&'>inside the first</a></td></tr>", "<tr><td>PR</tr><tr><td><a href='?id=5&'>x</a></td></tr>",
    "<tr><td><div>PR</td> <td><span><a class=x href=?id=6&amp;t>&eacute; t</a></td></tr>", "<tr><td>PR</td> <th><a href='?id=7&'>head</a></th></tr>",
    "<script>var x = '<td>a</td> <td><a href=1>';</script><tr><td>PR</td><td><br><a href='?id=8&'>x<br/>y</a></td></tr>",
    "<div><tr><td>PR</div></td> <td><a href='?id=9&'>x</a></td>", "<td title='a > b'>PR</td> <td title=\"</td>\"><a href='x>y?id=10&'>z</a></td>",
    "<td>PR</td> <td><a href='?id=11&'>never closed", "<td>PR</td>", "", "1 < 2 <td>a < b</td> <td><a href='?id=12&'>1 < 2</a></td>",
    "<td/><td><a href='?id=13&'>x</a></td>", "<td>PR</td> <td></td> <td><a href='?id=14&'>third</a></td>",
    # items
    "<ul><li class='mrgn-bttm-md'>one<ul><li class='mrgn-bttm-md x'>two</li></ul></li></ul>",
    "<li class=mrgn-bttm-md><b><i><u>deep</u></i></b></li><li class='mrgn-bttm-md'><b>x</b> </li><li class='mrgn-bttm-md'><b></b></li>",
    "<li class='mrgn-bttm-md'><ul><li class='mrgn-bttm-md'><p>x &amp; y</p></li></ul></li>", "<li class='mrgn-bttm-md'><!-- c --></li>",
    "<li class='mrgn-bttm-md'>a<!-- c --></li><!-- <li class='mrgn-bttm-md'>no</li> -->", "<li class='mrgn-bttm-md'>a<li class='mrgn-bttm-md'>b</ul>c",
    "<li class='mrgn-bttm-md'>x<br></li><li class='mrgn-bttm-md'><br></li><li class='mrgn-bttm-md'><br/>y</li><li class='mrgn-bttm-md'></li>",
    "<div title=\"<li class='mrgn-bttm-md'>no</li>\"><li class='a mrgn-bttm-md b'>yes</li></div>", "<LI CLASS=\"mrgn-bttm-md\"><B>x</B></LI >",
    "<li class='mrgn-bttm-md'>one</li><li class='mrgn-bttm-mdx'>no</li><li data-class='mrgn-bttm-md'>no</li><li class='mrgn-bttm-md'><b>x</b><b>y</b></li>",
]


def random_page(seed):
    rnd = random.Random(seed)
    words = ["<td>", "</td>", "</td> <td>", "<a href='?id=1&'>", "</a>", "<tr>", "</tr>", "<table>", "</table>", "text", " ", "<b>", "</b>", "<!-- c -->", "<br>",
             "<li class='mrgn-bttm-md'>", "</li>", "<ul>", "</ul>", "<li>", "x &amp; y", "<p/>", "<i>deep</i>", "1 < 2"]
    return "".join(rnd.choice(words) for _ in range(rnd.randint(1, 24)))


def check(spark, pages):
    df = spark.createDataFrame([(i, 200, p) for i, p in enumerate(pages)], schemas.STATUS_PAGES)
    status = {r.case_key: (r.status, r.case_id) for r in C.case_status_extract(df).collect()}
    items = {}
    for r in C.case_history(df).orderBy("case_key", "pos").collect():
        items.setdefault(r.case_key, []).append(r.item)
    for i, page in enumerate(pages):
        said, href, listed = expected(page)
        digits = None
        if href is not None and "id=" in href:
            found = re.search(r"id=(\d*)&", href)
            digits = found and found[1]
        assert (status[i], items.get(i, [])) == ((said, digits), listed), page


def test_pages_written_by_hand(spark):
    check(spark, PAGES)


@pytest.mark.parametrize("seed", range(3))
def test_random_pages(spark, seed):
    check(spark, [random_page(seed * 1000 + i) for i in range(700)])


def test_known_answers(spark):
    df = spark.createDataFrame([(i, 200, p) for i, p in enumerate(PAGES)], schemas.STATUS_PAGES)
    status = {r.case_key: (r.status, r.case_id) for r in C.case_status_extract(df).collect()}
    assert [status[i] for i in (0, 1, 2, 3, 5, 9, 12)] == [("Yes", "2"), ("InP", "2"), ("Abd", "3"), (None, None), ("ét", "6"), ("z", "10"), (None, None)]
    items = [(r.case_key, r.item) for r in C.case_history(df).orderBy("case_key", "pos").collect()]
    assert items[:6] == [(16, None), (16, "two"), (17, "deep"), (17, None), (17, None), (18, "x & y")]


def test_long_page_in_blocks(spark):
    page = "<div>" + "<p>a</p><br>" * 300 + "<td>x</td> <td><a href='?id=5&'>y</a></td></div>"
    nodes = spark.createDataFrame([(page,)], "html string").select(F.inline(E.nodes(F.col("html")))).collect()
    assert [n.depth for n in nodes[:5]] == [0, 1, 2, 1, 1] and len(nodes) == 1 + 900 + 6
    check(spark, [page, page.replace("</td> <td>", "<table></table></td><!-- --><td>")])
