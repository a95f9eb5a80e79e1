"""Ordered folds of text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def ordered_texts(order: Sequence[str], text: str) -> Column:
    """Aggregate: the texts of a group as an array, in the given order, NULL keys first."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("__text"))))
    return F.transform(rows, lambda r: r["__text"])
