"""Small text functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern; the Unicode class is far quicker than the characters one by one.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze(text: Column) -> Column:
    """Whitespace runs become one blank; none at the edges."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_RUN, "")


def sentence_case(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def file_extension(name: Column) -> Column:
    """What follows the last dot; the whole name when it has no dot."""
    return F.substring_index(name, ".", -1)
