"""Splitting a model reply into summary and JSON, and checking the JSON strictly."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import strip
from caseloom.schemas import REPORT

FENCE = "```json"


def summary_part(response: Column) -> Column:
    """Before the first fence, stripped; the untouched reply when there is no fence."""
    return F.when(F.contains(response, F.lit(FENCE)), strip(_before_fence(response))).otherwise(response)


def _before_fence(response: Column) -> Column:
    return F.left(response, F.locate(FENCE, response) - 1)


def raw_json_part(response: Column) -> Column:
    """After the first fence, stripped; NULL when there is no fence."""
    start = F.locate(FENCE, response) + F.lit(len(FENCE))
    return F.when(F.contains(response, F.lit(FENCE)), strip(F.substr(response, start)))


def json_text(raw: Column) -> Column:
    """Without the back-ticks that close the fence."""
    return F.regexp_replace(raw, r"`+$", "")


def is_one_json_value(text: Column) -> Column:
    """True iff the whole text is exactly one JSON value.

    A JSON parser reading from the front accepts text after the value. Put in
    an array the text must give one element, put in an object one member; no
    single text can break out of both brackets.
    """
    strict = {"allowSingleQuotes": "false"}
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>", strict)
    in_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "map<string,string>", strict)
    return F.coalesce((F.size(in_array) == 1) & (F.size(in_object) == 1), F.lit(False))


def typed_report(text: Column) -> Column:
    return F.from_json(text, REPORT, {"allowSingleQuotes": "false"})
