"""Text and links out of page HTML."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F


def up_to(end: str) -> str:
    """Pattern of everything up to a tag that begins like ``end``; it goes from bracket to bracket and never back."""
    return rf"[^<]*+(?:<(?!{end})[^<]*+)*+"


_INNER = up_to(r"/?div\b")
_COMMENT = r"!--[^-]*+(?:-(?!->)[^-]*+)*+-->"


def attribute_token(name: str, token: str) -> str:
    """Pattern of the rest of an opening tag whose attribute holds ``token`` as one of its words, quoted or not."""
    words = [rf"{q}(?:[^{q}]*\s)?{token}(?:\s[^{q}]*+)?{q}" for q in "\"'"]
    return rf"(?=[^>]*?\s{name}\s*+=\s*+(?:{words[0]}|{words[1]}|{token}(?=[\s>])))[^>]*+>"


# One left-to-right pass, each alternative behind one opening bracket: comments, elements that carry no main text,
# ad blocks with divs at most one deep inside, then any other tag. Possessive quantifiers keep the matcher from going
# back over long pages. Names count in either case.
NOT_MAIN_TEXT = (
    rf"(?is)<(?:{_COMMENT}"
    rf"|(script|style|nav|footer|head)\b[^>]*+>{up_to('/%1[^a-z0-9]').replace('%', chr(92))}</\1\s*+>"
    rf"|div\b{attribute_token('class', 'ad')}{_INNER}(?:<div\b[^>]*+>{_INNER}</div\s*+>{_INNER})*+</div\s*+>"
    r"|[^>]++>)"
)
# Comments and scripts are matched as a whole, so that an anchor inside one is not taken for a link.
HIDDEN_OR_ANCHOR = (
    rf"(?is)<(?:{_COMMENT}|script\b[^>]*+>{up_to('/script[^a-z0-9]')}</script\s*+>"
    r"""|a\s(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)"""
)
HREF = r"""(?i)\shref\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:"

REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# The published names of characters (of HTML 4, and the apostrophe), as a map that is folded into a constant.
_NAMES = ",".join(f"{name};={point}" for name, point in {**name2codepoint, "apos": 39}.items())


def _character(reference: Column) -> Column:
    """What a reference stands for; one that stands for nothing stays as it is."""
    body = F.substr(reference, F.lit(2))
    digits = (
        F.when(F.lower(F.left(body, F.lit(2))) == "#x", F.conv(F.rtrim(F.substr(body, F.lit(3)), F.lit(";")), 16, 10))
        .when(F.startswith(body, F.lit("#")), F.rtrim(F.substr(body, F.lit(2)), F.lit(";")))
        .otherwise(F.try_element_at(F.str_to_map(F.lit(_NAMES), F.lit(","), F.lit("=")), body))
    )
    point = digits.cast("int")
    legal = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(legal, point).otherwise(32)), 8, "0")), "UTF-32")
    return F.when(point.isNull(), reference).when(legal, char).otherwise("\ufffd")


def unescape(text: Column) -> Column:
    """Named and numeric character references replaced, in one pass: what comes out is not looked at again."""
    return F.array_join(F.zip_with(
        F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)),
        lambda piece, ref: F.concat(piece, F.when(ref.isNull(), "").otherwise(_character(ref)))), "")


#: A reference other than that of the ampersand.
_OTHER_REFERENCE = r"&(?!amp;)(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]{1,31};)"


def unescape_rare(text: Column) -> Column:
    """The same where most texts hold no character reference, or only ampersands: one look saves them the replacements.

    ``text`` should be a column or a lambda variable, for it is named several times.
    """
    held = F.contains(text, F.lit(";")) & F.contains(text, F.lit("&"))
    return F.when(~held, text).when(~text.rlike(_OTHER_REFERENCE), F.replace(text, F.lit("&amp;"), F.lit("&"))).otherwise(unescape(text))


def main_text(html: Column) -> Column:
    """Readable text of a page; NULL when there is none."""
    bare = F.get(F.transform(F.array(F.regexp_replace(html, NOT_MAIN_TEXT, " ")), unescape_rare), F.lit(0))
    return F.nullif(F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")), F.lit(""))


def href_of(tag: Column) -> Column:
    """Decoded ``href`` of an opening tag, in double, single or no quotes; empty where there is none."""

    def bare(value: Column) -> Column:
        quoted = F.left(value, F.lit(1)).isin("\"", "'")
        return F.when(quoted, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)

    value = F.get(F.transform(F.array(F.regexp_extract(tag, HREF, 1)), bare), F.lit(0))
    return F.get(F.transform(F.array(value), unescape_rare), F.lit(0))


def hrefs(html: Column) -> Column:
    """Non-empty ``href`` values of the anchors of a page, in document order, duplicates kept."""
    found = F.regexp_extract_all(html, F.lit(HIDDEN_OR_ANCHOR), F.lit(0))
    tags = F.filter(found, lambda tag: F.lower(F.left(tag, F.lit(2))) == "<a")
    return F.filter(F.transform(tags, href_of), lambda value: value != "")


def without_dots(url: Column) -> Column:
    """The address without ``.`` and ``..`` segments in its path."""
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rest = F.substr(url, F.length(origin) + F.length(path) + 1)
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.lit(1), F.size(done) - 1))).otherwise(F.concat(done, F.array(s))))
    ended = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), F.concat(origin, F.array_join(ended, "/"), rest)).otherwise(url)


def resolve(base: Column, href: Column) -> Column:
    """Absolute address of a link, dot segments removed."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"#.*$", "")
    path = F.regexp_replace(page, r"\?.*$", "")
    folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    joined = (
        F.when(href.rlike(ABSOLUTE), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("#"), F.concat(page, href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(folder, href))
    )
    return F.get(F.transform(F.array(joined), without_dots), F.lit(0))
