"""Main text of a page by its blocks: their length, their links, and what stands beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caseloom.functions.elements import bound, nodes
from caseloom.functions.html import attribute_token, unescape_rare
from caseloom.functions.text import squeeze

# Elements that make blocks, those that hold no main text, and words of a class that say the same.
BLOCK = ("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
         "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split()
NOT_MAIN = "script style head title nav footer aside form button select textarea noscript template iframe svg".split()
NOT_MAIN_CLASS = ("ad ads advert advertisement sponsored promo banner cookie cookies menu navbar breadcrumb breadcrumbs sidebar comment comments "
                  "share newsletter").split()
LONG = 10       # words
_END = "[.!?…][”»')]*$"
_SKIPPED_CLASS = rf"(?is)^<[a-z]+[0-9]*(?=[\s]){attribute_token('class', '(?:' + '|'.join(NOT_MAIN_CLASS) + ')')}$"


# A fold over the nodes. Its state: the depth of an element that is left out with all in it, that of the link it is in,
# and that of the element whose block is open, -1 for none; the open block's text and how much of it is linked. A block
# ends where another begins, where something is left out, and at the first node that is no deeper than its element.
_BLOCKS = """
get(transform(array(aggregate(
  sequence(1, greatest(size(marked), 1), 256),
  named_struct('skip', -1, 'link', -1, 'depth', -1, 'text', '', 'linked', 0, 'blocks', cast(array() as array<array<struct<text: string, linked: int>>>)),
  (o, at) -> get(transform(array(aggregate(
    slice(marked, at, 256),
    named_struct('skip', o.skip, 'link', o.link, 'depth', o.depth, 'text', o.text, 'linked', o.linked, 'done', cast(array() as array<struct<text: string, linked: int>>)),
    (s, n) -> if(n.name = '!' or (s.skip >= 0 and n.depth > s.skip), s, get(transform(
      array(named_struct('ends', n.kind > 0 or (s.depth >= 0 and n.depth <= s.depth), 'in_link', s.link >= 0 and n.depth > s.link)),
      x -> named_struct(
        'skip', if(n.kind = 2, n.depth, -1),
        'link', if(n.name = 'a', n.depth, if(x.in_link, s.link, -1)),
        'depth', if(n.kind > 0, n.depth, if(x.ends, n.depth - 1, s.depth)),
        'text', concat(if(x.ends, '', s.text), if(n.name = '', n.token, if(n.name = 'br', ' ', ''))),
        'linked', if(x.ends, 0, s.linked) + if(n.name = '' and x.in_link, length(n.token), 0),
        'done', if(x.ends and s.text <> '', concat(s.done, array(named_struct('text', s.text, 'linked', s.linked))), s.done))), 0)))),
    i -> named_struct('skip', i.skip, 'link', i.link, 'depth', i.depth, 'text', i.text, 'linked', i.linked, 'blocks', concat(o.blocks, array(i.done)))), 0))),
  f -> flatten(f.blocks) || if(f.text = '', cast(array() as array<struct<text: string, linked: int>>), array(named_struct('text', f.text, 'linked', f.linked)))), 0)
"""
_JUDGED = f"""
transform(clean, b -> named_struct('text', b.text, 'menu', b.linked * 2 >= b.size,
                                   'long', b.linked * 2 < b.size and (size(split(b.text, ' ')) >= {LONG} or b.text rlike "{_END}")))
"""
_KEPT = """
array_join(transform(filter(transform(judged, (b, i) -> named_struct('text', b.text, 'keep',
    b.long or (not b.menu and (coalesce(get(judged, i - 1).long, false) or coalesce(get(judged, i + 1).long, false))))), b -> b.keep), b -> b.text), '\\n\\n')
"""


def block_nodes(html: Column) -> Column:
    """The nodes of a page with their ``kind``: 1 begins a block, 2 is left out with all in it, 0 neither."""

    def marked(n: Column) -> Column:
        kind = F.when(n["name"].isin("", "!"), 0).when(n["name"].isin(*NOT_MAIN) | n["token"].rlike(_SKIPPED_CLASS), 2).when(n["name"].isin(*BLOCK), 1).otherwise(0)
        return F.struct(n["token"].alias("token"), n["name"].alias("name"), n["depth"].alias("depth"), kind.alias("kind"))

    return F.transform(nodes(html), marked)


def with_main_blocks(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages with ``__main``: the blocks that are main text, an empty line between; empty where there are none.

    A block is the text between two borders of block elements. It is a menu if half
    of it or more is linked; long if it has ten words or ends like a sentence; long
    ones that are no menus are main text, and short ones directly beside such a one.
    Step by step, so that no expression is worked out twice.
    """
    def clean(b: Column) -> Column:
        return F.struct(bound(b["text"], lambda t: squeeze(unescape_rare(t))).alias("text"), b["linked"].alias("linked"), F.length(b["text"]).alias("size"))

    found = pages.withColumn("marked", block_nodes(F.col(html))).withColumn("blocks", F.expr(_BLOCKS))
    told = found.withColumn("clean", F.filter(F.transform("blocks", clean), lambda b: b["text"] != ""))
    return told.withColumn("judged", F.expr(_JUDGED)).withColumn("__main", F.expr(_KEPT)).drop("marked", "blocks", "clean", "judged")
