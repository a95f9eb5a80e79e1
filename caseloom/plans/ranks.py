"""Places and offsets of rows within groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.plans.store import stored


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], amounts: Mapping[str, Column]) -> DataFrame:
    """``df`` with sums of amounts over the rows before each row of its group, whatever a group's size.

    Rows are dealt out by ranges of the whole order, so that one group may lie in
    many tasks. Sums are taken within ranges; of a range its totals are carried on
    to the next. Rows that are alike in the order may come in any order.
    """
    named = df.withColumns({f"__{name}": amount.cast("long") for name, amount in amounts.items()})
    # Written, for the borders of the ranges come from a sample.
    dealt = stored(named.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*keys, "__range").agg(*[F.sum(f"__{n}").alias(f"__total_{n}") for n in amounts])
    before = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)    # a row per range of a group
    above = totals.select(*[F.col(k).alias(f"__key_{k}") for k in keys], F.col("__range").alias("__of"),
                          *[F.coalesce(F.sum(f"__total_{n}").over(before), F.lit(0)).alias(f"__above_{n}") for n in amounts])
    within = W.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    same = F.col("__range") == F.col("__of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    sums = dealt.withColumns({f"__sum_{n}": F.coalesce(F.sum(f"__{n}").over(within), F.lit(0)) for n in amounts})
    return sums.join(above, same).select(*df.columns, *[(F.col(f"__sum_{n}") + F.col(f"__above_{n}")).alias(n) for n in amounts])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 0."""
    return running(df, keys, order, {name: F.lit(1)})


def text_pieces(pieces: DataFrame, keys: Sequence[str], order: Sequence[Column], text: str) -> DataFrame:
    """``(*keys, start, text)``: texts of a group as the pieces of one long text, with the character at which each begins.

    The pieces in the order of ``start`` (empty ones need none) join up to the text.
    """
    placed = running(pieces, keys, order, {"start": F.length(text)})
    return placed.select(*keys, "start", F.col(text).alias("text"))
