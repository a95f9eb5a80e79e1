"""Markdown as HTML: blocks by the kinds of lines, then the marks inside of them.

The rule: a line of three back-ticks begins and ends a block of code, in which
nothing is read; ``#`` to ``######`` begin headings; ``-``, ``*`` or ``+`` and a
number with a point begin list items; all other lines are paragraphs. A blank line
ends a paragraph or a list; another line goes on with it. Inside of a line, code in
back-ticks, links, strong and emphasised text are read; ``&`` and ``<`` are always
text, so that no markup of a message becomes markup of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.elements import bound

_FENCE = r"^\s{0,3}```"
_HEADING = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
_BULLET = r"^\s{0,3}[-*+]\s+(.*)$"
_NUMBER = r"^\s{0,3}[0-9]{1,9}[.]\s+(.*)$"
_SPAN = r"`[^`]++`|[^`]++|`"
_LINK = r"\[([^\[\]]*+)\]\(([^()\s]*+)\)"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def inline_html(line: Column) -> Column:
    """The marks in a line: code spans as they are, then links, strong, emphasis in the text between them."""

    def span(s: Column) -> Column:
        code = s.startswith("`") & (F.length(s) > 1)
        marked = escaped(s)
        for pattern, html in ((_LINK, '<a href="$2">$1</a>'), (r"\*\*([^*]++)\*\*", "<strong>$1</strong>"), (r"\*([^*\s][^*]*+)\*", "<em>$1</em>"),
                              (r"(?<![\w/])_([^_\s][^_]*+)_(?!\w)", "<em>$1</em>")):
            marked = F.regexp_replace(marked, pattern, html)
        return F.when(code, F.concat(F.lit("<code>"), escaped(F.substr(s, F.lit(2), F.length(s) - 2)), F.lit("</code>"))).otherwise(marked)

    return F.array_join(F.transform(F.regexp_extract_all(line, F.lit(_SPAN), F.lit(0)), span), "")


def _kind(line: Column, before: Column) -> Column:
    """Kind of a line behind one of kind ``before``: the only thing that a line has to know of those before it."""
    fence = line.rlike(_FENCE)
    in_code = before.isin("begin", "code")
    goes_on = F.when(before.isin("ul", "ul+"), "ul+").when(before.isin("ol", "ol+"), "ol+").otherwise("p")
    return (
        F.when(in_code & fence, "end").when(in_code, "code").when(fence, "begin").when(line.rlike(r"^\s*$"), "")
        .when(line.rlike(_HEADING), "h").when(line.rlike(_BULLET), "ul").when(line.rlike(_NUMBER), "ol").otherwise(goes_on)
    )


BLOCK = 64      # lines whose kinds are gathered before they are put to those before them


def _kinds(lines: Column) -> Column:
    none = F.array().cast("array<string>")

    def block(state: Column, first: Column) -> Column:
        inner = F.aggregate(
            F.slice(lines, first, F.lit(BLOCK)), F.struct(state["last"].alias("last"), none.alias("kinds")),
            lambda s, line: bound(_kind(line, s["last"]), lambda k: F.struct(k.alias("last"), F.concat(s["kinds"], F.array(k)).alias("kinds"))))
        return bound(inner, lambda i: F.struct(i["last"].alias("last"), F.concat(state["kinds"], F.array(i["kinds"])).alias("kinds")))

    start = F.struct(F.lit("").alias("last"), F.array().cast("array<array<string>>").alias("kinds"))
    return F.aggregate(F.sequence(F.lit(1), F.size(lines), F.lit(BLOCK)), start, block, lambda s: F.flatten(s["kinds"]))


def markdown_html(text: Column) -> Column:
    """HTML of a Markdown text; empty for an empty one."""

    def written(lines: Column, kinds: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            kind, before, behind = (F.coalesce(F.get(kinds, i + d), F.lit("")) for d in (0, -1, 1))

            def told(k: Column, b: Column, n: Column) -> Column:
                def item(tag: str, pattern: str) -> Column:
                    opens = F.when(b.isin(tag, f"{tag}+"), "").otherwise(f"<{tag}>\n")
                    closes = F.when(n == f"{tag}+", "").otherwise("</li>")
                    ends = F.when(n.isin(tag, f"{tag}+"), "").otherwise(f"\n</{tag}>")
                    return F.concat(F.when(k == tag, F.concat(opens, F.lit("<li>"), inline_html(F.regexp_extract(line, pattern, 1)))).otherwise(inline_html(F.trim(line))), closes, ends)

                level = F.length(F.regexp_extract(line, _HEADING, 1)).cast("string")
                paragraph = F.concat(F.when(b == "p", "").otherwise("<p>"), inline_html(F.trim(line)), F.when(n == "p", "").otherwise("</p>"))
                html = (
                    F.when(k == "h", F.concat(F.lit("<h"), level, F.lit(">"), inline_html(F.regexp_extract(line, _HEADING, 2)), F.lit("</h"), level, F.lit(">")))
                    .when(k == "p", paragraph).when(k.startswith("ul"), item("ul", _BULLET)).when(k.startswith("ol"), item("ol", _NUMBER))
                    # the last line of a text ends a block of code that nothing else ended
                    .when(k == "begin", F.when(n == "", "<pre><code></code></pre>").otherwise("<pre><code>"))
                    .when(k == "code", F.concat(escaped(line), F.when(n == "", "\n</code></pre>").otherwise("")))
                    .when(k == "end", "</code></pre>").otherwise("")
                )
                return F.concat(F.when((k == "") | (b == "begin"), "").otherwise("\n"), html)

            return bound(F.struct(kind.alias("k"), before.alias("b"), behind.alias("n")), lambda x: told(x["k"], x["b"], x["n"]))

        return F.ltrim(F.array_join(F.transform(lines, one), ""), F.lit("\n"))

    return bound(F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n"), lambda lines: bound(_kinds(lines), lambda kinds: written(lines, kinds)))
