"""Table text: choosing the delimiter, cutting rows and cells, writing rows."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import strip

# The candidates, in the order that breaks ties.
DELIMITERS = ["|", "\t", ","]


def occurrences(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def delimiter_of(text: Column) -> Column:
    """The candidate seen most often in the whole text."""
    counts = [occurrences(text, char) for char in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.when(text.isNull(), F.lit(None).cast("string"))
    for char, count in zip(DELIMITERS, counts):
        choice = choice.when(count == most, char)
    return choice


SEPARATOR_LINE = r"^[|,\t :-]*-[|,\t :-]*$"


def lines_of(text: Column, drop_separator: bool = False) -> Column:
    """The non-blank lines, stripped. ``drop_separator`` also leaves out Markdown delimiter lines below the first line."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    if drop_separator:
        lines = F.filter(lines, lambda line, i: (i == 0) | ~line.rlike(SEPARATOR_LINE))
    return lines


def cells_of(line: Column, delimiter: Column, keep_empty: bool = False) -> Column:
    """Stripped cells of a line. Blank cells are left out unless ``keep_empty``.

    One constant pattern per candidate: a pattern built per row would be compiled per row.
    """
    pieces = F.when(delimiter == "|", F.split(line, r"\|")).when(delimiter == "\t", F.split(line, "\t")).otherwise(F.split(line, ","))
    stripped = F.transform(pieces, strip)
    return stripped if keep_empty else F.filter(stripped, lambda cell: cell != "")


def rendered_row(cells: Column) -> Column:
    """``|a|b|``; NULL cells read ``None`` and line breaks inside a cell become blanks."""
    shown = F.transform(cells, lambda cell: F.replace(F.coalesce(cell, F.lit("None")), F.lit("\n"), F.lit(" ")))
    return F.concat(F.lit("|"), F.array_join(shown, "|"), F.lit("|"))


def rendered_rows(rows: Column) -> Column:
    return F.array_join(F.transform(rows, rendered_row), "\n")


# A record goes to the first line break outside of quotes; a field to the first comma outside of them.
_RECORD = r'(?:[^"\r\n]++|"(?:[^"]++|"")*+"?)++'
_FIELD = r',((?:[^",]++|"(?:[^"]++|"")*+"?)*+)'


def csv_records(text: Column) -> Column:
    """The non-blank records of a CSV text, each as its fields: quotes taken off, doubled ones single, line breaks in them kept."""

    def field(raw: Column) -> Column:
        quoted = raw.startswith('"') & raw.endswith('"') & (F.length(raw) > 1)
        return F.when(quoted, F.replace(F.substr(raw, F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)

    records = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: ~r.rlike(r"^\s*$"))
    return F.transform(records, lambda r: F.transform(F.regexp_extract_all(F.concat(F.lit(","), r), F.lit(_FIELD), F.lit(1)), field))


# Fixed value: what counts as a number in a column that is set to the right.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
_MARKDOWN = """
get(transform(array(named_struct('head', get({r}, 0), 'body', slice({r}, 2, size({r})))), t ->
  get(transform(array(named_struct(
    'first', greatest(2, length(cast(size(t.body) - 1 as string))),
    'cols', transform(t.head, (name, i) -> named_struct(
      'name', coalesce(nullif(name, ''), 'Unnamed: ' || i),
      'width', greatest(length(coalesce(nullif(name, ''), 'Unnamed: ' || i)) + 2, coalesce(array_max(transform(t.body, b -> length(get(b, i)))), 0)),
      'right', size(t.body) > 0 and forall(t.body, b -> coalesce(get(b, i), '') = '' or get(b, i) rlike '{number}'))))), s ->
    array_join(
      array('| ' || repeat(' ', s.first) || ' | ' || array_join(transform(s.cols, c -> if(c.right, lpad(c.name, c.width, ' '), rpad(c.name, c.width, ' '))), ' | ') || ' |',
            '|' || repeat('-', s.first + 1) || ':|' || array_join(transform(s.cols, c -> if(c.right, repeat('-', c.width + 1) || ':', ':' || repeat('-', c.width + 1))), '|') || '|')
      || transform(t.body, (b, n) -> '| ' || lpad(cast(n as string), s.first, ' ') || ' | ' || array_join(transform(s.cols, (c, i) ->
           if(c.right, lpad(coalesce(get(b, i), ''), c.width, ' '), rpad(coalesce(get(b, i), ''), c.width, ' '))), ' | ') || ' |'),
      '\n')), 0)), 0)
"""


def markdown_of(records: str) -> Column:
    """One text with the pipe table of a column of records, the first being the header, row numbers first.

    Columns of numbers stand right. Short rows are filled up; what a row has beyond
    the header is left out; a name that is missing says its place. NULL without a record.
    """
    return F.when(F.size(records) > 0, F.expr(_MARKDOWN.format(r=records, number=NUMBER)))
