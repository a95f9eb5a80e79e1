"""Elements of markup with their depths, as arrays: a fold over the tags with a stack of open elements.

The rules are those of a tolerant parser that implies nothing: an end tag closes
all elements up to the innermost one of its name, and is ignored where none is
open; an element that is never closed ends with the one around it. Scripts and
styles are single nodes, comments are nodes, empty elements have no inside.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: elements without an end tag, and those whose content is not markup.
EMPTY = ("area", "base", "br", "col", "embed", "hr", "img", "input", "keygen", "link", "menuitem", "meta", "param", "source", "track", "wbr",
         "basefont", "bgsound", "command", "frame", "image", "isindex", "nextid", "spacer")
RAW = ("script", "style")

COMMENT = r"<!--[^-]*+(?:-(?!->)[^-]*+)*+-->"
RAW_ELEMENT = rf"<({'|'.join(RAW)})(?=[\s/>])[^>]*+>[^<]*+(?:<(?!/\1[^a-z0-9])[^<]*+)*+(?:</\1[^>]*+>|\z)"
#: From a letter or slash behind the bracket to the closing one; brackets in quoted values don't close.
TAG_REST = r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>"""
TAG = rf"<(?=/?[a-z]){TAG_REST}"
BOGUS = r"<[a-z/!?][^>]*+(?:>|\z)"
TOKEN = rf"(?is){COMMENT}|{RAW_ELEMENT}|{TAG}|{BOGUS}|(?:[^<]++|<(?![a-z/!?]))++"

BLOCK = 64


def leaf(group: int) -> str:
    """Pattern of an element that holds nothing but text, or nothing, and can't end others; its name is the group of this number."""
    never = "|".join((*EMPTY, *RAW, "a", "li", "td", "th", "tr", "table"))
    return rf"<(?!(?:{never})\b)([a-z][a-z0-9]*+)(?=[\s>]){TAG_REST}[^<]*+</\{group}\s*+>"


def flat(group: int) -> str:
    """Pattern of text and such elements."""
    return rf"[^<]*+(?:{leaf(group)}[^<]*+)*+"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _named(token: Column) -> Column:
    """Name of an element, with a slash before that of an end tag; ``!`` for comments and the like; empty for text."""
    tag = F.lower(F.regexp_extract(token, r"^<(/?[A-Za-z][^\s/>]*)", 1))
    return F.when(~token.startswith("<"), "").when(tag != "", tag).when(token.rlike(r"^<[!/?]"), "!").otherwise("")


def _step(state: Column, token: Column, name: Column) -> Column:
    """Path of the open elements behind a token, and the depths so far with its own: below 0 for what is no node."""
    path, depth = state["path"], state["depth"]
    closed = F.concat(name, F.lit("/"))
    inner = F.call_function("substring_index", path, closed, F.lit(-1))         # of the elements that an end tag closes, those inside
    closes = name.startswith("/") & F.contains(path, closed)
    opens = (name != "") & ~name.startswith("/") & (name != "!") & ~name.isin(*EMPTY, *RAW) & ~token.endswith("/>")
    return F.struct(
        F.when(closes, F.left(path, F.length(path) - F.length(inner) - F.length(name)))
        .when(opens, F.concat(path, closed)).otherwise(path).alias("path"),
        F.when(closes, depth - 1 - F.length(inner) + F.length(F.replace(inner, F.lit("/"), F.lit(""))))
        .when(opens, depth + 1).otherwise(depth).alias("depth"),
        F.concat(state["depths"], F.array(F.when(name.startswith("/"), -1).otherwise(depth))).alias("depths"))


def nodes(html: Column) -> Column:
    """Array of ``(token, name, depth)`` of the elements (their start tags), texts and comments of a page, in order.

    What lies in an element are the nodes behind it up to the next one that is not
    deeper. Depths are gathered by blocks, so that a long page is not copied per tag.
    """
    tokens = F.transform(F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0)), lambda t: F.struct(t.alias("token"), _named(t).alias("name")))

    def folded(named: Column) -> Column:
        empty = F.array().cast("array<int>")
        start = F.struct(F.lit("/").alias("path"), F.lit(0).alias("depth"), F.array().cast("array<array<int>>").alias("blocks"))

        def block(state: Column, first: Column) -> Column:
            inside = F.aggregate(
                F.slice(named, first, F.lit(BLOCK)), F.struct(state["path"].alias("path"), state["depth"].alias("depth"), empty.alias("depths")),
                lambda s, t: _step(s, t["token"], t["name"]))
            return bound(inside, lambda s: F.struct(s["path"].alias("path"), s["depth"].alias("depth"), F.concat(state["blocks"], F.array(s["depths"])).alias("blocks")))

        firsts = F.sequence(F.lit(1), F.greatest(F.size(named), F.lit(1)), F.lit(BLOCK))
        depths = F.flatten(F.aggregate(firsts, start, block, lambda s: s["blocks"]))
        return F.zip_with(named, depths, lambda n, d: F.struct(n["token"].alias("token"), n["name"].alias("name"), d.alias("depth")))

    return F.filter(bound(tokens, folded), lambda n: n["depth"] >= 0)


def first_where(array: Column, test) -> Column:
    """Place (from 1) of the first element that passes a test; 0 without one."""
    return F.array_position(F.transform(array, test), True).cast("int")


def until(array: Column, test) -> Column:
    """The elements before the first one that passes a test."""
    return bound(first_where(array, test), lambda end: F.when(end == 0, array).otherwise(F.slice(array, F.lit(1), F.greatest(end - 1, F.lit(0)))))


def behind(array: Column, place: Column) -> Column:
    return F.slice(array, place + 1, F.size(array))


def inside(array: Column, place: Column) -> Column:
    """The nodes in the element at a place (from 1). ``array`` and ``place`` should be lambda variables."""
    return bound(F.get(array, place - 1)["depth"], lambda depth: bound(behind(array, place), lambda rest: until(rest, lambda n: n["depth"] <= depth)))
