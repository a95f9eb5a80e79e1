"""The operators' input relations, derived row by row from the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caseloom.operators.eligibility import REQUIRED_DOCS

PROMPT = "Répondez avec le document."


# Declared, so that no footer has to be read while a query is planned.
TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def applicants(spark, sf_dir):
    """Profiles; some diplomas are unknown, some ages, marks or years missing."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as applicant_id",
        "if(c_custkey % 31 = 5, null, cast(18 + c_custkey % 43 as int)) as age",
        """case c_custkey % 4 when 0 then 'Secondaire' when 1 then 'Baccalauréat' when 2 then 'Master'
             else case c_custkey % 5 when 0 then 'Licence' when 1 then null else 'Doctorat' end end as education""",
        "if(c_custkey % 37 = 6, null, cast(c_custkey % 19 as double) / 2) as language_score",
        "if(c_custkey % 31 = 5, null, cast(c_custkey % 16 as int)) as work_experience",
    )


def submitted(spark, sf_dir):
    """Papers handed in: each of the five, but for every seventh combination of applicant and paper."""
    listed = F.array(*[F.struct(F.lit(i).alias("doc_no"), F.lit(name).alias("doc")) for i, name in enumerate(REQUIRED_DOCS)])
    return (
        table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("applicant_id"), F.inline(listed))
        .filter("(applicant_id * 3 + doc_no) % 7 <> 0").select("applicant_id", "doc")
    )


def uploads(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "'f' || doc_id || '.' || case doc_id % 3 when 0 then 'pdf' when 1 then 'csv' else 'txt' end as name",
        "text as content",
    )


def csv_uploads(spark, sf_dir):
    """Uploads of which the .csv ones hold a table with quoted commas, quotes and line breaks, a short row and a blank line."""
    return uploads(spark, sf_dir).selectExpr(
        "doc_id", "name", """if(doc_id % 3 = 1, concat('id,name,"the, note"', chr(10), doc_id, ',"a ""quoted"" word",x', chr(13), chr(10), chr(10),
            doc_id + 1, ',"two', chr(10), 'lines","', length(content), ', chars"', chr(10), '7,short', chr(10)), content) as content""")


def upload_elements(spark, sf_dir):
    """The lines of every upload as its elements."""
    return uploads(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n")).alias("elem_no", "text"))


def mixed_table_texts(spark, sf_dir):
    """Tables with headers of three kinds: plain, with a name that repeats, and with one that a suffix would make a second time."""
    return table_texts(spark, sf_dir).selectExpr("table_id", """case ascii(right(split(table_id, '/')[0], 1)) % 3
        when 0 then text when 1 then replace(replace(text, 'p_name', 'x'), 'p_size', 'x') else replace(replace(replace(text, 'p_partkey', 'a'), 'p_name', 'a'), 'p_size', 'a.1') end as text""")


def messages(spark, sf_dir):
    """The logs, and one long conversation (-1) with a message of every log, gaps in its numbers and one without number."""
    shapes = ["case when conv_id % 2 = 0 then array(text) end as parts", "case when conv_id % 2 = 0 then null else text end as content"]
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    long = logs.filter("turn = 0").selectExpr(
        "-1L as conv_id", "nullif(conv_id, 0) * 3 as turn", "if(conv_id % 3 = 2, 'assistant', 'user') as role", "'m' || conv_id as text")
    return logs.unionByName(long).selectExpr("conv_id", "turn", "role", *shapes)


def markdown_messages(spark, sf_dir):
    """The messages with Markdown around their texts."""
    marked = """concat('### About ', turn, ' #', chr(10), 'It is **', conv_id, '** & _so_ <b>', chr(10), 'on.', chr(10), '- a `*b* <c>`', chr(10), '- [x](http://y.z/a_b_c)', chr(10), 'more', chr(10), chr(10),
        '1. *one*', chr(10), '2. two', chr(10), '```sql', chr(10), '# not ', conv_id, chr(10), chr(10), '- <no>', chr(10), '```', chr(10), content)"""
    return messages(spark, sf_dir).filter("turn is not null").selectExpr("conv_id", "turn", "role", "coalesce(parts[0], content) as content").selectExpr(
        "conv_id", "turn", "role", "cast(null as array<string>) as parts", f"{marked} as content")


def conversation_docs(spark, sf_dir):
    """A document for most conversations; every fourth has the same one, every tenth none."""
    return table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(
        "conv_id", "case when conv_id % 10 = 9 then null when conv_id % 4 = 0 then 0L else conv_id end as doc_id"
    ).unionByName(spark.range(1).selectExpr("-1L as conv_id", "1L as doc_id"))


def report_runs(spark, sf_dir):
    """Reports of every conversation; every second one lacks run 1."""
    return table(spark, sf_dir, "conversations").filter("turn = 0").selectExpr(
        "conv_id", "explode(if(conv_id % 2 = 0, array(0, 1, 2), array(0, 2))) as run"
    ).selectExpr("conv_id", "run", "'rapport ' || run || ' de ' || conv_id as response")


def pages(spark, sf_dir):
    """Captured pages with further markup at their end; every tenth is a later capture of an address that others have as well."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "if(page_id % 10 = 9, 'https://again.example.org/x/y' || page_id div 40, url) as url",
        """html || case page_id % 6
             when 0 then '<p>Caf&eacute; &#233;t&#xE9; &amp;lt; &hellip;</p>'
             when 1 then '<SCRIPT>var t="<p>no</p>";</SCRIPT><DIV CLASS="ad big">buy<div>in</div>more</DIV><P>after</P>'
             when 2 then '<a href="p?a=1&amp;b=2">x</a><A HREF=q>u</A><a class=c href=\\'r#s\\'>v</a>'
             when 3 then '<a href="../x/./y">d</a><a href="/a/../b/">e</a>'
             when 4 then '<div class=\\'x ad\\'>no</div><div data-class="ad">kept</div>'
             else '' end as html""".replace("\\\\", "\\"),
    )


def boxed_pages(spark, sf_dir):
    """Pages with adverts three divs deep, a menu that is only links, and short blocks beside long ones and not."""
    return table(spark, sf_dir, "pages").selectExpr("page_id", "url", """if(html like '%</html>', html || '<div class="box"><div class="ad"><div><div>deep <p>buy this now, friends.</p></div></div>more words here.</div>after it come a few words</div><div><a href="x">Home page</a> <a href="y">News</a> or</div><div>alone here</div><ul><li><a href=z>Up</a></ul><p>Last words.</p><div><span>two</span> <i>more</i></div>', html) as html""")


def bare_pages(spark, sf_dir):
    """Pages of which every seventh came without text, next to a second capture (``other``) of all."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "url", "if(page_id % 7 = 0, '<head><title>wait</title></head>', html) as html", "'<p>second ' || page_id || '</p>' as other")


def link_plan(spark, sf_dir):
    """One to eight links per page, forty on the first; every fifth leads nowhere and every third to the first page."""
    all_pages = table(spark, sf_dir, "pages")
    n_pages = all_pages.agg(F.count(F.lit(1))).scalar()
    wanted = (
        all_pages.selectExpr("page_id", "explode(sequence(1, cast(if(page_id = 0, 40, 1 + page_id % 8) as int))) as pos")
        .withColumn("__to", F.when((F.col("page_id") + F.col("pos")) % 3 == 0, 0).otherwise((F.col("page_id") * 7 + F.col("pos") * 13) % n_pages))
    )
    targets = pages(spark, sf_dir).selectExpr("page_id as __to", "url")
    return wanted.join(targets, "__to").selectExpr(
        "page_id", "pos",
        "case when (page_id + pos) % 5 = 0 then 'https://missing.example.org/' || page_id || '/' || pos else url end as link",
    )


def responses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang",
        """'{"sujets_principaux":["' || source || '","' || lang || '"],"thèmes_clés":[{"thème":"' || lang
           || '","description":"d' || doc_id || '","sujets_connexes":["' || source
           || '","voisin"]}],"points_de_données_significatifs":[{"point_de_donnée":"' || doc_id || '","contexte":"' || lang || '"}],"insights":[{"insight":"i' || doc_id
           || '","explication":"' || lang || '"}]}' as j""",
    )
    return docs.selectExpr(
        "doc_id",
        """case doc_id % 5
             when 0 then 'Résumé: ' || lang || chr(10) || '```json' || chr(10) || j || chr(10) || '```'
             when 1 then 'Résumé: ' || lang
             when 2 then 'Résumé: ' || lang || ' ```json' || substr(j, 1, length(j) - 1) || '```'
             when 3 then 'Résumé: ' || lang || ' ```json' || j || '```' || chr(10) || 'fin'
             else 'Résumé: ' || lang || ' ```json ' || j end as response""",
    )


def status_pages(spark, sf_dir):
    """Portal pages in four ways of writing the same markup, and with a table in the first cell, a comment behind it and items in items."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as case_key",
        "cast(case when o_orderkey % 17 = 0 then 500 else 200 end as int) as status_code",
        "case o_orderstatus when 'F' then ' Decision  Made' when 'O' then ' In  Process' else 'Application Received ' end as said",
        "o_orderpriority as pr", "o_orderkey as k",
    ).selectExpr(
        "case_key", "status_code",
        """case when k % 10 = 0 then '<p>maintenance</p>'
             when k % 10 = 1 then '<TABLE><TR><TD>PR</TD> <TD><A CLASS="c" HREF="viewcasestatus.do?id=' || k || '&amp;type=prCases">' || chr(10) || said
               || '</A></TD></TR></TABLE><UL><LI CLASS="a mrgn-bttm-md b">Received ' || pr || '</LI><li data-class="mrgn-bttm-md">no</li></UL>'
             when k % 10 = 2 then '<table><tr><td>PR</td><td><a href=viewcasestatus.do?id=' || k || '&type=prCases>' || said
               || '</a></td></tr></table><ul><li class=mrgn-bttm-md>Re&ccedil;u &amp; ' || pr || '</li></ul>'
             when k % 10 = 3 then '<table><tr><td>PR</td><td><a href="viewcasestatus.do?type=prCases">' || said || '</a></td></tr></table>'
             when k % 10 = 4 then replace('<table><tr><td>PR</td> <td><a href="v.do?id=' || k || '&type=prCases">' || said
               || '</a></td></tr></table><ul><li class="mrgn-bttm-md">Received ' || pr || '</li></ul>', '"', chr(39))
             when k % 250 = 15 then '<table><tr><td>PR<table><tr><td>no</td> <td><a href="?id=1&">no</a></td></tr></table></td><!-- <td>no</td> --> <td><b><a href="v.do?id=' || k
               || '&type=prCases"><i>' || said || '</i></a></b></td></tr></table><ul><li class="mrgn-bttm-md">Received<ul><li class="mrgn-bttm-md"><b><i>inner ' || k
               || '</i></b></li></ul></li><!-- <li class="mrgn-bttm-md">no</li> --></ul>'
             else '<table><tr><td>PR</td> <td><a href="viewcasestatus.do?id=' || k || '&type=prCases">' || chr(10) || said
               || '</a></td></tr></table><ul><li class="mrgn-bttm-md">Received ' || pr
               || '</li><li class="other">x</li><li class="mrgn-bttm-md">A <b>b</b> c</li></ul>' end as html""")


def elements(spark, sf_dir):
    """Elements of which a fifth lies on one page, many at one height, and some without height."""
    return table(spark, sf_dir, "events").selectExpr(
        "if(event_id % 5 = 3, 0L, user_id) as doc_id", "if(event_id % 5 = 3, 1, cast(1 + event_id % 5 as int)) as page_no",
        "event_id as elem_no", "case when event_type = 'error' then 'R' else 'T' end as elem_type",
        "if(event_id % 101 = 7, null, if(event_id % 4 = 0, 500.0D, 1000 - value)) as y1", "event_type || '  ' || event_id || ';' as text",
    ).selectExpr("doc_id", "page_no", "elem_no", "elem_type", "y1 - 5 as y0", "y1", "text")


def page_boxes(spark, sf_dir):
    """Boxes of most pages, and one of a page without elements."""
    boxes = elements(spark, sf_dir).select("doc_id", "page_no").distinct().filter("(doc_id + page_no) % 13 <> 4")
    return boxes.unionByName(spark.range(1).selectExpr("-1L as doc_id", "1 as page_no")).withColumn("page_h", F.lit(1000.0))


def page_tables(spark, sf_dir):
    """Two tables on every page that holds a rectangle."""
    found = (
        elements(spark, sf_dir).filter("elem_type = 'R'").groupBy("doc_id", "page_no")
        .agg(F.min("text").alias("a"), F.max("text").alias("b"))
    )
    return found.selectExpr("doc_id", "page_no", """inline(array(
        named_struct('table_no', 0, 'bbox_bottom', cast(100 as double), 'cells', array(array(a, cast(null as string)))),
        named_struct('table_no', 1, 'bbox_bottom', cast(300 as double), 'cells', array(array(b, 'x\\ny'), array('z')))))""")


def table_texts(spark, sf_dir):
    """Parts as table texts of at most a thousand part numbers, with the delimiter chosen by brand; some rows have a cell too many."""
    parts = table(spark, sf_dir, "part").selectExpr(
        "p_brand || '/' || (p_partkey div 1000) as table_id", "p_partkey", "p_name", "p_size",
        "case cast(substr(p_brand, 7) as int) % 3 when 0 then '|' when 1 then chr(9) else ',' end as dl",
    )
    rows = parts.groupBy("table_id", "dl").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size"))).alias("rows"))
    return rows.selectExpr(
        "table_id",
        """concat(dl, 'p_partkey', dl, 'p_name', dl, 'p_size', dl, chr(10),
             array_join(transform(rows, x -> concat(dl, ' ', x.p_partkey, ' ', dl, x.p_name, dl, x.p_size, dl,
               if(x.p_partkey % 11 = 3, 'more' || dl, ''))), chr(10))) as text""",
    )


def cell_rows(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as doc_id", "cast(1 + o_orderkey % 6 as int) as page_no", "0 as table_no", "o_orderkey as row_no",
        "slice(array(o_orderstatus, cast(null as string), o_orderpriority), 1, cast(1 + o_orderkey % 3 as int)) as cells",
    )


def order_tables(spark, sf_dir):
    """Two-row tables: one per order, the order number standing for the table's place on its page."""
    return cell_rows(spark, sf_dir).selectExpr(
        "doc_id", "page_no", "row_no as table_no", "array(cells, array('n' || row_no, 'a\\nb')) as cells"
    )


def submissions(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as sub_id", "case when c_custkey % 11 = 0 then '' else c_name end as nom",
        "case when c_custkey % 7 = 0 then 'bad' else 'c' || c_custkey || '@example.org' end as email",
        "cast(null as string) as telephone",
        """case c_custkey % 5 when 0 then 'evaluation' when 1 then 'information' when 2 then 'rendez-vous'
                              when 3 then 'autre' else 'inconnu' end as sujet""",
        "case when c_custkey % 13 = 0 then null else c_mktsegment end as message",
    )
