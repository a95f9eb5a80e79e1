"""Leaf blocks of a web page: runs of text between block-level tags, with the elements around them.

A tolerant reading of markup: end tags may be missing or wrong, tags may be cut off
at the end of the page. No page raises.
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple

# What HTML says of elements.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noscript noembed noframes template xmp svg".split())   # no text of the page
CLOSES_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option select tbody td tfoot th thead tr".split())
ENDS = {    # element -> (open elements that it ends, those beyond which it ends nothing)
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"}),
}
LABEL = "data-main"     # attribute of the elements that hold the main text of a labelled page

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^"'>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|(!--)|[!?/])""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_COMMENT_END = re.compile(r"--!?>")
_WORD = re.compile(r"[a-z]{2,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


_NOTHING = ("", frozenset(), frozenset(), False)


class Block(NamedTuple):
    text: str           # decoded, white space as single spaces
    linked: float       # share of the characters that lie in links
    tags: tuple         # block elements around it, outermost first
    words: frozenset    # words of their class, id and role
    near: frozenset     # those of the innermost element that has any
    main: bool          # inside an element that bears the label


def _marks(attributes: str) -> tuple[frozenset, bool]:
    """Words of class, id and role, and whether the label is there."""
    words, main = set(), False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            # of both ways to write compound names, the words
            words.update(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        elif name == "hidden" or name == "style" and _HIDDEN.search(value.lower()):
            words.add("hidden")
        elif name == LABEL:
            main = True
    return frozenset(words), main


def page_blocks(html: str) -> list[Block]:
    """The blocks of a page that hold any text, in page order."""
    out: list[Block] = []
    open_tags: list[tuple[str, frozenset, frozenset, bool]] = []    # element, words of it and around it, near ones, label
    texts: list[tuple[str, bool]] = []
    link_depth = None       # number of open elements around the link that is open

    def flush() -> None:
        if texts:
            text = " ".join("".join(t for t, _ in texts).split())
            if text:
                size = sum(len(t) for t, _ in texts)
                _, words, near, main = open_tags[-1] if open_tags else _NOTHING
                linked = sum(len(t) for t, linked in texts if linked) / size
                out.append(Block(text, linked, tuple(t[0] for t in open_tags), words, near, main))
            texts.clear()

    def close_from(i: int) -> None:
        nonlocal link_depth
        del open_tags[i:]
        if link_depth is not None and link_depth > i:
            link_depth = None

    def end_open(names: set, limits: set) -> None:
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i][0] in names:
                close_from(i)
                return
            if open_tags[i][0] in limits:
                return

    at, last_close = 0, html.rfind(">")
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            begin = len(html)
        if begin > at:
            texts.append((unescape(html[at:begin]), link_depth is not None))
        if begin == len(html):
            break
        tag = _TAG.match(html, begin) if begin < last_close else None
        if tag is None:
            follows = html[begin + 1:begin + 3]
            if follows[:1].isalpha() and follows[:1].isascii() or follows[:1] in ("/", "!", "?"):
                break       # a tag or comment that the page's end cuts off
            texts.append(("<", link_depth is not None))
            at = begin + 1
            continue
        at = tag.end()
        if tag[4]:
            end = _COMMENT_END.search(html, begin + 4)
            short = html.startswith((">", "->"), begin + 4)
            at = html.find(">", begin + 4) + 1 if short else end.end() if end else len(html)
            continue
        if tag[2] is None:
            at = html.find(">", begin) + 1 or len(html)
            continue
        name = tag[2].lower()
        if tag[1]:
            if name == "a":
                link_depth = None
            elif name in BLOCK:
                flush()
                for i in range(len(open_tags) - 1, -1, -1):
                    if open_tags[i][0] == name:
                        close_from(i)
                        break
                    if open_tags[i][0] == "table" and name not in ("body", "html"):
                        break
            continue
        if name in RAW:
            if name == "svg" and tag[3].rstrip().endswith("/"):
                continue
            end = _RAW_END[name].search(html, at)
            at = end.start() if end else len(html)
            continue
        if name == "br":
            texts.append((" ", False))
        elif name == "a":
            link_depth = len(open_tags)
        elif name in BLOCK:
            flush()
            if name in CLOSES_P:
                end_open({"p"}, {"table", "td", "th", "caption"})
            if name in ENDS:
                end_open(*ENDS[name])
            if name not in VOID:
                _, around, near, inside = open_tags[-1] if open_tags else _NOTHING
                words, main = _marks(tag[3]) if tag[3] else (frozenset(), False)
                open_tags.append((name, around | words, words or near, inside or main))
    flush()
    return out
