"""What each of five document filters removes in every order in which they can be applied.

A document is known by the set of filters it fails, a mask. In one order it is
removed by the first of its mask's filters. The orders of the letters, written in
lexicographic rank, that begin with the same letters are an interval of ranks, so a
mask's removals at a step are some intervals: their counts are added at one end and
taken off behind the other, and a running sum over the ranks gives every order.
The documents are read once and are counted by mask; orders never meet documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from caseloom.plans.store import stored

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))

# The limits of the filters.
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITALS_PERCENT = 2
SYMBOLS = r"[#$%&*|]"
SPACE = r"[\x20\x09-\x0D]+"


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """``(mask, step, first rank, rank behind the last)``; letter i of ``FILTERS`` is bit i of a mask.

    A mask is removed at a step by all orders that begin with letters outside of it
    and go on with one inside. With n letters to come, a beginning of k letters
    fixes an interval of (n - k)! ranks, at the factorial digits of its Lehmer code.
    """
    n = len(FILTERS)
    found = []
    for step in range(1, n + 1):
        width = factorial(n - step)
        for first, head in enumerate(permutations(range(n), step)):
            passed = sum(1 << i for i in head[:-1])
            for mask in range(1, 1 << n):
                if not mask & passed and mask >> head[-1] & 1:
                    found.append((mask, step, first * width, (first + 1) * width))
    return found


def text_failures(text: Column) -> Column:
    """Bits of the first four filters that a text fails; they need nothing but the text. Words are told by case."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.aggregate(
        F.array(words), F.lit(0),
        lambda none, w: (
            F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0)
            + F.when(100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w), 2).otherwise(0)))\
        + F.when(100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS_PERCENT * F.length(text), 4).otherwise(0)\
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)


def failing_masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic, n``: the documents of a part by the filters they fail and by their labels.

    Texts are read once; what goes on is a digest. Repeated texts are told by a
    table of the digests of more than one id, written first, so that a text that
    most rows share is a hot key of a plain join, which the adaptive join splits.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = stored(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")), "labelled")
    rows = stored(documents.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text_failures(text).alias("fails")), "failures")
    repeated = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                      .where("first < last").select("digest", "first"), "repeated_texts")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return (
        rows.join(repeated, "digest", "left").join(known, "doc_id", "left")
        .select("part", (F.col("fails") + F.when(later, 16).otherwise(0)).alias("mask"),
                F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
        .groupBy("part", "mask", "good", "toxic").agg(F.count(F.lit(1)).alias("n")))


def audit_orders(masks: DataFrame) -> DataFrame:
    """From :func:`failing_masks` to a row per part, order and step. Bounded by parts x 600 rows, whatever the documents."""
    spark = masks.sparkSession
    masks = stored(masks, "masks")
    intervals = F.broadcast(spark.createDataFrame(removal_intervals(), "mask int, step int, first int, behind int"))
    names = spark.createDataFrame([(r, "".join(o)) for r, o in enumerate(permutations(FILTERS))], "rank int, filter_order string")

    counted = masks.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))
    ends = counted.join(intervals, "mask").select(
        "part", "step", F.inline(F.expr("""array(
            named_struct('rank', first, 'removed', n, 'good_lost', good, 'toxic_lost', toxic),
            named_struct('rank', behind, 'removed', -n, 'good_lost', -good, 'toxic_lost', -toxic))""")))
    none = counted.select("part").distinct().select(
        "part", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")).alias("step")).select(
        "part", "step", F.explode(F.expr(f"sequence(0, {ORDERS - 1})")).alias("rank"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("removed", "good_lost", "toxic_lost")])
    up_to = Window.partitionBy("part", "step").orderBy("rank")
    sums = ends.unionByName(none).where(F.col("rank") < ORDERS).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in ("removed", "good_lost", "toxic_lost")]).select(
        "part", "step", "rank", *[F.sum(c).over(up_to).alias(c) for c in ("removed", "good_lost", "toxic_lost")])

    bits = [1 << i for i in range(len(FILTERS))]
    totals = counted.groupBy("part").agg(
        F.sum("n").alias("documents"),
        F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(b) != 0, F.col("n")).otherwise(0)) for b in bits]).alias("fails"),
        F.array(*[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)) for b in bits]).alias("only"))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(FILTERS), F.col("letter"))
    so_far = Window.partitionBy("part", "rank").orderBy("step")
    return (
        sums.join(F.broadcast(names), "rank").join(totals, "part").withColumn("letter", letter)
        .select(
            "part", "filter_order", "step", (F.col("documents") - F.sum("removed").over(so_far)).alias("kept"), "removed",
            (F.element_at("fails", place) - F.col("removed")).alias("redundant"), F.element_at("only", place).alias("unique_fails"),
            "good_lost", "toxic_lost", F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")))


def filter_interactions(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A part is a source. A document fails A with under 200 words, B if under half of
    its words are distinct, C if over 2 % of its code points are ``A-Z``, D if it
    holds one of ``#$%&*|``, and E if its text is that of a row with a smaller id.

    A NULL text is empty (and fails A), a NULL source is the part ''. A row without
    id has no smaller one, and no label; it is counted. Repeated rows count each,
    and do not fail E for each other. Of several labels for an id, one that is 1 is
    enough. An empty table gives no rows. Other columns play no part.
    """
    return audit_orders(failing_masks(documents, labels))
