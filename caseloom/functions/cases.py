"""Status, case id and history out of a portal page.

Most pages write cells and items plainly; one pattern reads those in one pass, and
matches only where nothing in the markup could lead to another answer. All other
pages go through the element fold.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions import elements as E
from caseloom.functions.html import attribute_token, href_of, unescape_rare
from caseloom.functions.text import without_space

_RAW = "|".join(E.RAW)
_BEFORE = rf"(?:[^<]++|<(?!!--|(?:td|{_RAW})\b)(?=[a-z/!?]){E.TAG_REST})*+"
_DEEPER = rf"(?:[^<]++|{E.leaf(2)}|<(?!(?:a|{_RAW})\b)(?=[a-z]){E.TAG_REST})*+"
#: The first cell, the cell after it, and the first link in that: group 3, without its end tag.
PLAIN_LINK = (
    rf"(?is)^{_BEFORE}<td\b{E.TAG_REST}{E.flat(1)}</td\s*+>\s*+<td\b{E.TAG_REST}{_DEEPER}(<a(?=[\s>]){E.TAG_REST}{E.flat(4)})</a\s*+>")
CASE_ID = r"id=\d*&"

_ITEM_CLASS = attribute_token("class", "mrgn-bttm-md")
#: Every tag; of an item (group 2) the end of its tag and what follows it, with the beginning of its end tag if all between is plain.
HISTORY_ITEM = (
    rf"(?is){E.COMMENT}|{E.RAW_ELEMENT}|<li\b{_ITEM_CLASS.removesuffix('>')}(>{E.flat(3)}(?:</li(?=\s*+>))?+)|{E.TAG}|{E.BOGUS}")
_WRAPPED = r"(?s)^<[^>]++>([^<]++)</[^>]++>$"


def plain_link(html: Column) -> Column:
    """The status link of a plain page, without its end tag; empty for every other page."""
    return F.regexp_extract(html, PLAIN_LINK, 3)


def status_link(html: Column, plain: Column) -> Column:
    """``(tag, text)`` of the first link in the cell after the first cell; NULL when there is none. Character references stay."""

    def cut(link: Column) -> Column:
        tag = F.regexp_extract(link, rf"(?is)^{E.TAG}", 0)
        return E.bound(tag, lambda t: F.struct(t.alias("tag"), E.bound(
            F.substr(link, F.length(t) + 1), lambda inner: F.when(F.contains(inner, F.lit("<")), F.regexp_replace(inner, rf"(?is){E.TAG}", "")).otherwise(inner)).alias("text")))

    def folded(all_nodes: Column) -> Column:
        return E.bound(E.first_where(all_nodes, lambda n: n["name"] == "td"), lambda cell: F.when(cell > 0, E.bound(
            F.get(all_nodes, cell - 1)["depth"], lambda depth: E.bound(E.behind(all_nodes, cell), lambda rest: beside(rest, depth)))))

    def beside(rest: Column, depth: Column) -> Column:
        """In the nodes behind the first cell's tag: the next element beside it, if its row goes on so far."""
        place = E.first_where(rest, lambda n: (n["depth"] < depth) | ((n["depth"] == depth) & ~n["name"].isin("", "!")))
        return E.bound(place, lambda p: F.when((p > 0) & (F.get(rest, p - 1)["depth"] == depth), E.bound(E.inside(rest, p), first_link)))

    def first_link(within: Column) -> Column:
        def read(place: Column) -> Column:
            texts = F.transform(F.filter(E.inside(within, place), lambda n: n["name"] == ""), lambda n: n["token"])
            return F.when(place > 0, F.struct(F.get(within, place - 1)["token"].alias("tag"), F.array_join(texts, "").alias("text")))

        return E.bound(E.first_where(within, lambda n: n["name"] == "a"), read)

    return F.when(plain != "", cut(plain)).when(html.rlike(r"<[tT][dD]\b"), E.bound(E.nodes(html), folded))


def status_text(text: Column) -> Column:
    """Status without any whitespace."""
    return without_space(unescape_rare(text))


def case_id(tag: Column) -> Column:
    """Digits of the first ``id=...&`` in the decoded address of the status link; may be empty."""
    found = F.regexp_extract(href_of(tag), CASE_ID, 0)
    return E.bound(found, lambda m: F.when(m != "", F.substr(m, F.lit(4), F.length(m) - 4)))


def history_items(html: Column) -> Column:
    """Text per history item, in order.

    An item keeps its text if it holds nothing else, or one element that holds
    nothing else, and so on; one that mixes text and elements, or holds several,
    or nothing, reads NULL. An item in an item is an item of its own.
    """

    def plain_text(inner: Column) -> Column:
        text = F.when(F.contains(inner, F.lit("<")), F.regexp_extract(inner, _WRAPPED, 1)).otherwise(inner)
        return E.bound(F.nullif(text, F.lit("")), unescape_rare)

    def plain_texts(items: Column) -> Column:
        return F.transform(F.transform(items, lambda item: F.substr(item, F.lit(2), F.length(item) - 5)), plain_text)

    def folded(all_nodes: Column) -> Column:
        deepest = F.array_max(F.transform(all_nodes, lambda n: n["depth"]))
        placed = F.transform(all_nodes, lambda n, i: F.struct((i + 1).alias("place"), n["depth"].alias("depth"), (
            (n["name"] == "li") & n["token"].rlike(rf"(?is)^<li\b{_ITEM_CLASS}$")).alias("is_item")))
        return E.bound(deepest, lambda most: F.transform(F.filter(placed, lambda x: x["is_item"]), lambda x: text_of(all_nodes, x["place"], x["depth"], most)))

    def text_of(all_nodes: Column, place: Column, depth: Column, deepest: Column) -> Column:
        def of_last(last: Column) -> Column:
            return F.when(last["name"] == "", unescape_rare(last["token"])).when(
                last["token"].startswith("<!--"), F.regexp_extract(last["token"], r"(?s)^<!--(.*)-->$", 1))

        def only_children(chain: Column) -> Column:
            one_by_one = F.forall(F.transform(chain, lambda n, i: n["depth"] == depth + 1 + i), lambda ok: ok)
            return F.when((F.size(chain) > 0) & one_by_one, E.bound(F.element_at(chain, -1), of_last))

        # A chain of only children can't be longer than the page is deep.
        rest = F.slice(all_nodes, place + 1, deepest - depth + 1)
        return E.bound(rest, lambda r: E.bound(E.until(r, lambda n: n["depth"] <= depth), only_children))

    def chosen(items: Column) -> Column:
        plain = F.forall(items, lambda item: F.right(item, F.lit(4)).isin("</li", "</LI", "</Li", "</lI"))
        return F.when(plain, plain_texts(items)).otherwise(E.bound(E.nodes(html), folded))

    return E.bound(F.filter(F.regexp_extract_all(html, F.lit(HISTORY_ITEM), F.lit(2)), lambda item: item != ""), chosen)
