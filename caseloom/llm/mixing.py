"""Mixing sources to target weights in fixed-length blocks of words.

A source is a sequence of blocks: its documents in a fixed order, cut every
``block`` words. The mix is a sequence of slots, dealt out to shards. Each
shard's number of slots per source is a multinomial draw; what a source drew
beyond its target goes to sources that drew too few, so that all targets are
met. A source's slots count through its blocks, once an epoch, in the order of a
pseudorandom permutation of the block numbers (swap-or-not), and blocks are
joined by number. Everything is a hash of stable values, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caseloom.llm.tables import ROW, stored_with_row
from caseloom.plans.store import stored

WEIGHTS = (3, 1, 2)
BLOCK = 256            # words of a block
SHARD_SLOTS = 4096     # blocks of a shard
SHARE = 1.5            # words of the mix, as a part of all words
MAX_REPEAT = 2         # times that a source's words may be taken
GROUP = 1 << 10        # documents whose places are counted together
ROUNDS = 24            # of the permutation
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``(source, sno, source_size, n_docs, target)``: one row per source, by code point, NULL last.

    ``min(max_repeat * size, level * weight)``, with the level at which the targets
    add up: what giving the excess of full sources to the others again and again
    leads to. The windows run over sources, not over documents.
    """
    listed = ", ".join(map(str, weights))
    every = Window.partitionBy()
    by_cap = Window.orderBy("cap_at", "sno").rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("sno", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.expr(f"element_at(array({listed}), cast((sno - 1) % {len(weights)} + 1 as int))").cast("double"))
        .withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
        .withColumn("cap_at", F.col("cap") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
        # The level if the sources before this one are full; too few or too many full ones both give too low a level.
        .withColumn("level", F.max(F.col("left") / F.col("open")).over(every))
    )
    return sources.select("source", "sno", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _placed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents that have words, with ``start``: the words of their source before them."""
    by_source = sized.filter("size > 0").join(
        sources.select(F.col("source").alias("s2"), "sno", "n_docs"), F.col("source").eqNullSafe(F.col("s2")))
    spread = by_source.withColumn("part", F.expr(f"pmod(xxhash64(id, mark), cast(ceil(n_docs / {GROUP}) as bigint))"))
    totals = spread.groupBy("sno", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sno").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("sno", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inner = Window.partitionBy("sno", "part").orderBy("id", "mark", ROW).rowsBetween(Window.unboundedPreceding, -1)
    counted = spread.select("sno", "part", ROW, "size", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("inner"))
    return counted.join(offsets, ["sno", "part"]).select("sno", ROW, "size", (F.col("inner") + F.col("offset")).alias("start"))


def document_blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(sno, block, row, at, lo, words)``: the part of each document in each block, ``lo`` counted in the document, ``at`` in the block."""
    cut = placed.select("sno", ROW, "size", "start", F.explode(F.expr(
        f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("start"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start"))
    return cut.select("sno", "block", ROW, (F.col("start") + lo - F.col("block") * block).alias("at"), lo.alias("lo"), (hi - lo).alias("words"))


def shard_draws(sources: DataFrame, seed: int, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, sno, first, n)``: how many slots of a source a shard gets, and where they begin in the source's count.

    Every slot of the mix draws a source with the chance of its part of all slots.
    ``first`` and ``n`` come from one pass over the shards of a source in order.
    """
    spark = sources.sparkSession
    total, n = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return spark.createDataFrame([], "shard long, sno int, first long, n long")
    edges = sources.withColumn("to", F.sum("slots").over(Window.orderBy("sno"))).select("sno", "slots", (F.col("to") - F.col("slots")).alias("from"))
    # A draw is a whole number under the total; equal numbers are counted before they meet their source.
    drawn = (
        spark.range(total).select(F.expr(f"id div {shard_slots}").alias("shard"), F.expr(f"pmod(xxhash64(id, {seed}L), {total}L)").alias("u"))
        .withColumn("cell", F.expr(f"u div greatest(1L, {total}L div 4096)"))
    )
    cells = edges.filter("slots > 0").select("sno", "from", "slots", F.explode(F.expr(
        f"sequence(from div greatest(1L, {total}L div 4096), (from + slots - 1) div greatest(1L, {total}L div 4096))")).alias("cell"))
    counts = stored(
        drawn.join(cells, "cell").filter("u >= from and u < from + slots").groupBy("shard", "sno").agg(F.count(F.lit(1)).alias("c")), "draws")
    before = Window.partitionBy("sno").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    met = (
        counts.join(sources.select("sno", "slots"), "sno")
        .withColumn("had", F.coalesce(F.sum("c").over(before), F.lit(0)))
        .withColumn("n", F.greatest(F.lit(0), F.least("c", F.col("slots") - F.col("had"))))
    )
    surplus = met.filter("c > n").select("shard", (F.col("c") - F.col("n")).alias("k"), "sno")
    short = sources.select("sno", "slots").join(counts.groupBy("sno").agg(F.sum("c").alias("c")), "sno", "left").select(
        "sno", (F.col("slots") - F.coalesce("c", F.lit(0))).alias("k")).filter("k > 0")

    def units(df, *order):
        to = df.withColumn("to", F.sum("k").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        return to.select("*", F.explode(F.expr("sequence(to - k, to - 1)")).alias("unit"))

    moved = units(surplus, "shard", "sno").select("shard", "unit").join(units(short, "sno").select("sno", "unit"), "unit")
    final = met.select("shard", "sno", "n").union(moved.select("shard", "sno", F.lit(1).cast("long"))).groupBy("shard", "sno").agg(
        F.sum("n").alias("n")).filter("n > 0")
    return final.select("shard", "sno", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def permuted(index: str, size: str, *keys: str) -> str:
    """SQL: place of ``index`` in a permutation of 0 .. ``size`` - 1 that the keys pick, by swap-or-not rounds.

    Every round pairs i with (k - i) mod size and a bit of the pair decides on a
    swap, which is a permutation for any size.
    """
    picked = ", ".join(keys)
    return (f"aggregate(sequence(1, {ROUNDS}), {index}, (x, r) -> transform(array(pmod(pmod(xxhash64({picked}, r), {size}) - x, {size})), "
            f"y -> if((xxhash64({picked}, r, greatest(x, y)) & 1) = 1, y, x))[0])")


def mixture_slots(sources: DataFrame, seed: int = 42, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """``(shard, sno, slot, epoch, block, take)``: the first ``take`` words of a block for every slot of the mix."""
    counted = stored(
        sources.withColumn("whole", F.expr(f"source_size div {block}"))
        .withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
        .withColumn("wanted", F.round("target").cast("long"))
        .withColumn("epochs", F.expr("if(source_size = 0, 0L, wanted div source_size)"))
        .withColumn("rest", F.expr("if(source_size = 0, 0L, wanted - epochs * source_size)"))
        .withColumn("slots", F.expr(f"epochs * blocks + (rest + {block - 1}) div {block}")), "targets")
    draws = stored(shard_draws(counted, seed, block, shard_slots), "draws")
    # A draw is a few bytes that grow to thousands of slots: spread first.
    spread = draws.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "sno")
    slots = (
        spread.select("shard", "sno", F.explode(F.expr("sequence(first, first + n - 1)")).alias("slot"))
        .join(counted.select("sno", "source_size", "whole", "blocks", "epochs", "rest"), "sno")
        .withColumn("epoch", F.expr("slot div blocks")).withColumn("q", F.expr("slot % blocks"))
        .withColumn("block", F.expr(f"if(q >= whole, whole, {permuted('q', 'whole', f'{seed}L', 'sno', 'epoch')})"))
    )
    length = F.expr(f"least({block}L, source_size - block * {block})")
    take = F.when(F.col("epoch") < F.col("epochs"), length).otherwise(F.least(length, F.col("rest") - F.col("q") * block))
    return slots.select("shard", "sno", "slot", "epoch", "block", take.alias("take"))


def taken_parts(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """``(shard, slot, sno, epoch, block, row, lo, words)``: documents' words in the mix, blocks joined by number."""
    part = F.least("words", F.col("take") - F.col("at"))
    return slots.join(blocks, ["sno", "block"]).withColumn("words", part).filter("words > 0").select(
        "shard", "slot", "sno", "epoch", "block", ROW, "lo", "words")


def _sized(docs: DataFrame, text: str, id_col: str, source: str, *more) -> DataFrame:
    return stored_with_row(docs.select(
        F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(text)).alias("mark"), *more), "sized")


def mix(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 42, block: int = BLOCK,
        shard_slots: int = SHARD_SLOTS, carry: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(documents, sources, parts)`` of a mix: sized documents by row number, targets, and the parts taken."""
    sized = _sized(docs, text, id_col, source, *([F.struct(*docs.columns).alias("doc")] if carry else []))
    narrow = sized.drop("doc")
    sources = stored(source_targets(narrow), "sources")
    blocks = document_blocks(_placed(narrow, sources), block)
    parts = taken_parts(blocks, mixture_slots(sources, seed, block, shard_slots))
    return sized, sources, parts


def mixed_documents(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    ``target`` is that of the document's source. A document without words, or
    with a NULL text, has size 0 and nothing taken; a NULL source is a source of
    its own, the last; repeated rows are documents of their own. A table without
    words gives targets of 0, an empty one no rows.
    """
    sized, sources, parts = mix(docs, text, id_col, source, seed)
    taken = parts.groupBy(ROW).agg(F.sum("words").alias("taken"))
    by_source = sized.join(
        sources.select(F.col("source").alias("s2"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s2")))
    return by_source.join(taken, ROW, "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source", seed: int = 42) -> DataFrame:
    """The mix as rows of ``docs``: a document once for every epoch that takes words of it.

    A copy that is taken whole keeps its text; of one taken in part, each run of
    words is a line, words one space apart. ``n_chars``, if there is one, follows.
    """
    sized, _, parts = mix(docs, text, id_col, source, seed, carry=True)
    copies = parts.groupBy(ROW, "epoch").agg(
        F.array_sort(F.collect_list(F.struct("lo", "words"))).alias("parts"), F.sum("words").alias("taken"))
    every_word = F.regexp_extract_all(F.col(f"doc.{text}"), F.lit(WORD), F.lit(0))
    lines = F.expr("array_join(transform(parts, p -> array_join(slice(all_words, cast(p.lo + 1 as int), cast(p.words as int)), ' ')), '\\n')")
    rows = sized.join(copies, ROW).withColumn("all_words", F.when(F.col("taken") < F.col("size"), every_word)).withColumn(
        "new_text", F.when(F.col("taken") < F.col("size"), lines).otherwise(F.col(f"doc.{text}")))
    made = {text: F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return rows.select(*[made[c].alias(c) if c in made else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
