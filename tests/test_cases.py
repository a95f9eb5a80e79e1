from caseloom import schemas
from caseloom.operators import cases as C


def page(anchor='<a href="v.do?id=123&type=x">In  Process</a>', items=""):
    return f"<table><tr><td>PR</td>\n<td>{anchor}</td></tr></table><ul>{items}</ul>"


def frame(spark, *pages, status=200):
    return spark.createDataFrame([(i, status, p) for i, p in enumerate(pages)], schemas.STATUS_PAGES)


def test_status_and_id(spark):
    pages = [page(), page('<a href="?id=&&">x</a>'), page('<a href="?id=9">x</a>'), page('<a href="?pid=5&id=7&">x</a>'),
             page('<a class="c" href="?id=8&amp;type=x"><b> Decision\n Made </b></a>'), "<p>maintenance</p>", page("none")]
    got = [(r.status, r.case_id) for r in C.case_status_extract(frame(spark, *pages)).orderBy("case_key").collect()]
    assert got == [("InProcess", "123"), ("x", ""), ("x", None), ("x", "5"), ("DecisionMade", "8"), (None, None), (None, None)]


def test_history(spark):
    items = ('<li class="mrgn-bttm-md">one</li><li class="other">no</li><li class="a mrgn-bttm-md b">two &amp; a half</li>'
             '<li class="mrgn-bttm-md">A <b>b</b> c</li><li class="mrgn-bttm-md"><b>x</b></li><li class="mrgn-bttm-md-x">no</li>')
    got = [(r.pos, r.item) for r in C.case_history(frame(spark, page(items=items))).orderBy("pos").collect()]
    assert got == [(0, "one"), (1, "two & a half"), (2, None), (3, "x")]


def test_markup_in_either_case_and_any_quotes(spark):
    html = ("<TABLE><TR><TD>PR</TD> <TD><A HREF='v.do?id=12&amp;t=x'>In  P</A></TD></TR></TABLE><ul><LI CLASS='mrgn-bttm-md'>one</LI>"
            "<li data-class=\"mrgn-bttm-md\">no</li><li class=mrgn-bttm-md>Re&ccedil;u</li></ul>")
    record = C.case_status(frame(spark, html)).first()
    assert (record.status, record.case_id, record.detail, record.error) == ("InP", "12", ["one", "Reçu"], None)


def test_outcome_per_page(spark):
    good = page(items='<li class="mrgn-bttm-md">one</li>')
    df = frame(spark, good, "<p></p>", page('<a href="?x=1">s</a>')).unionAll(
        spark.createDataFrame([(7, 500, good), (8, None, good)], schemas.STATUS_PAGES))
    got = {r.case_key: r for r in C.case_status(df).collect()}
    assert (got[0].status, got[0].case_id, got[0].detail, got[0].error) == ("InProcess", "123", ["one"], None)
    assert (got[1].status, got[1].detail) == (C.NO_STATUS, [])
    assert got[2].error == C.NO_CASE_ID
    assert got[7].status == got[8].status == C.BAD_RESPONSE and got[7].detail == [] and got[7].case_id is None
    assert sorted((r.case_key, r.error) for r in C.error_capture(df).collect()) == [
        (1, C.NO_STATUS), (2, C.NO_CASE_ID), (7, C.BAD_RESPONSE), (8, C.BAD_RESPONSE)]
