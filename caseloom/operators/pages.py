"""Captured pages: text, links, which links to follow, what was fetched, and the context for a report.

``html`` never crosses a shuffle: every operator first turns a page into text
or links inside the scan stage. Relations that feed several operators (links,
page texts) are meant to be written once, see :func:`caseloom.plans.store.stored`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from caseloom.functions import html as H
from caseloom.functions.blocks import with_main_blocks
from caseloom.plans.parts import ordered_texts
from caseloom.plans.ranks import text_pieces
from caseloom.plans.store import stored

FOLLOWED_LINKS = 5


def extract_main_text(pages: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``(page_id, url, text)``. Where a page yields no text the ``fallback`` HTML is tried; NULL if that fails too."""
    text = H.main_text(F.col("html"))
    if fallback is not None:
        text = F.coalesce(text, H.main_text(fallback))
    return pages.select("page_id", "url", text.alias("text"))


def main_text_by_blocks(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: like :func:`extract_main_text`, but by the rule of :func:`caseloom.functions.blocks.with_main_blocks`.

    Adverts of any depth, and menus and notices that no element names, are left out. NULL where nothing is left.
    """
    return with_main_blocks(pages.select("page_id", "url", "html")).select("page_id", "url", F.nullif("__main", F.lit("")).alias("text"))


def page_links(html: Column, url: Column, mode: str = "concat") -> Column:
    """Array of the links of one page. ``concat`` puts the href behind the page url; ``resolve`` makes a real address."""
    if mode not in ("concat", "resolve"):
        raise ValueError(f"unknown link mode: {mode}")
    join = F.concat if mode == "concat" else H.resolve
    return F.transform(H.hrefs(html), lambda href: join(url, href))


def extract_links(pages: DataFrame, mode: str = "concat") -> DataFrame:
    """``(page_id, pos, link)``: links in document order, ``pos`` from 1 without gaps, duplicates kept."""
    found = page_links(F.col("html"), F.col("url"), mode)
    return pages.select("page_id", F.posexplode(found).alias("pos", "link")).withColumn("pos", F.col("pos") + 1)


def crawl_frontier(links: DataFrame, k: int = FOLLOWED_LINKS, dense: bool = False) -> DataFrame:
    """The first ``k`` links of each page.

    ``dense`` says that ``pos`` counts from 1 without gaps, as
    :func:`extract_links` writes it; the frontier is then a filter without a
    shuffle. Otherwise a rank is taken; ranks above ``k`` are cut off before
    the shuffle, so a page with very many links sends at most ``k`` per task.
    """
    if dense:
        return links.filter(F.col("pos") <= k).select("page_id", "pos", "link")
    rank = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return links.withColumn("__rank", rank).filter(F.col("__rank") <= k).select("page_id", "pos", "link")


def _newest(pages: DataFrame) -> DataFrame:
    """``(link, target)``: the latest page of every url. Reads and moves ids and urls only.

    Written once: both sides of a join with it are then plain scans, which the adaptive join can split.
    """
    return stored(pages.groupBy(F.col("url").alias("link")).agg(F.max("page_id").alias("target")), "newest")


def crawl_join(frontier: DataFrame, page_texts: DataFrame) -> DataFrame:
    """``(page_id, pos, link, text, fetched)``: text of every frontier link, empty where nothing was captured.

    ``page_texts`` is ``(page_id, url, text)``; of several captures of a url the
    latest page counts. Which page that is is found on ids and urls; the texts
    come last, by page, once, and neither sorted nor ranked. A link or page that
    very many rows share is split by the adaptive skew join.
    """
    found = frontier.select("page_id", "pos", "link").join(_newest(page_texts), "link", "left")
    texts = page_texts.select(F.col("page_id").alias("target"), "text")
    return found.join(texts, "target", "left").select(
        "page_id", "pos", "link", F.coalesce("text", F.lit("")).alias("text"), F.col("target").isNotNull().alias("fetched"))


def link_status(links: DataFrame, pages: DataFrame, k: int = FOLLOWED_LINKS, dense: bool = False) -> DataFrame:
    """``(page_id, pos, link, attempted, fetched)`` for all links. Only urls are joined, no text.

    ``attempted`` marks the first ``k`` links of a page, ``fetched`` those of them that were captured.
    """
    rank = F.col("pos") if dense else F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    flagged = links.select("page_id", "pos", "link", (rank <= k).alias("attempted"))
    return flagged.join(_newest(pages.select("page_id", "url")), "link", "left").select(
        "page_id", "pos", "link", "attempted", (F.col("attempted") & F.col("target").isNotNull()).alias("fetched"))


def pending_links(status: DataFrame) -> DataFrame:
    """Links without a fetched page: those past the first ``k`` and those that failed. Input: :func:`link_status`."""
    return status.filter(~F.col("fetched")).select("page_id", "pos", "link")


def crawl_coverage(status: DataFrame) -> DataFrame:
    """``(page_id, found, attempted, fetched, progress)``; progress is attempted over found, below 1 beyond ``k`` links."""
    return (
        status.groupBy("page_id")
        .agg(
            F.count(F.lit(1)).alias("found"),
            F.sum(F.col("attempted").cast("long")).alias("attempted"),
            F.sum(F.col("fetched").cast("long")).alias("fetched"),
        )
        .withColumn("progress", F.try_divide(F.col("attempted").cast("double"), F.col("found")))
    )


def accumulate_text(page_texts: DataFrame, crawled: DataFrame) -> DataFrame:
    """``(page_id, n_fetched, all_text)``: page text, then the texts of its followed links by position, run together.

    A group is one page and its at most ``k`` frontier links.
    """
    own = page_texts.select("page_id", F.lit(0).alias("pos"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0).alias("hit"))
    followed = crawled.select("page_id", "pos", "text", F.col("fetched").cast("int").alias("hit"))
    return own.unionByName(followed).groupBy("page_id").agg(
        F.sum("hit").cast("long").alias("n_fetched"),
        F.array_join(ordered_texts(["pos"], "text"), "").alias("all_text"),
    )


def report_context(accumulated: DataFrame, links: DataFrame) -> DataFrame:
    """``(page_id, num_urls, context)``: accumulated text followed by the list of all links, one row per page.

    ``num_urls`` is the number of links plus one.
    """
    lists = links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("__links"), F.array_join(ordered_texts(["pos"], "link"), "', '").alias("__list"))
    listed = F.when(F.col("__links").isNull(), F.lit("[]")).otherwise(F.concat(F.lit("['"), F.col("__list"), F.lit("']")))
    return accumulated.join(lists, "page_id", "left").select(
        "page_id", (F.coalesce("__links", F.lit(0)) + 1).alias("num_urls"), F.concat("all_text", listed).alias("context"))


def context_pieces(page_texts: DataFrame, crawled: DataFrame, links: DataFrame) -> DataFrame:
    """``(page_id, start, text)``: the contexts of :func:`report_context` as pieces: texts, then links, with their places in the context.

    A page with any number of links lies in as many tasks as it needs.
    """
    own = page_texts.select("page_id", F.lit(0).alias("__kind"), F.lit(0).alias("pos"), F.coalesce("text", F.lit("")).alias("__text"))
    followed = crawled.select("page_id", F.lit(1).alias("__kind"), "pos", F.col("text").alias("__text"))
    ends = stored(links.groupBy("page_id").agg(F.min("pos").alias("__first"), F.max("pos").alias("__last")), "link-ends")
    listed = links.join(ends, "page_id").select("page_id", F.lit(2).alias("__kind"), "pos", F.concat(
        F.when(F.col("pos") == F.col("__first"), "['").otherwise("', '"), "link", F.when(F.col("pos") == F.col("__last"), "']").otherwise("")).alias("__text"))
    none = page_texts.select("page_id").join(ends, "page_id", "left_anti").select(
        "page_id", F.lit(2).alias("__kind"), F.lit(0).alias("pos"), F.lit("[]").alias("__text"))
    every = own.unionByName(followed).unionByName(listed).unionByName(none)
    return text_pieces(every, ["page_id"], [F.asc("__kind"), F.asc("pos"), F.asc("__text")], "__text")


def keyed_texts(page_texts: DataFrame) -> DataFrame:
    """``(file_name, page_id, url, text)``: one text per url under its md5 name; the last version written wins."""
    last = _newest(page_texts).select(F.col("target").alias("page_id"))
    return page_texts.join(last, "page_id", "left_semi").select(
        F.concat(F.md5("url"), F.lit(".txt")).alias("file_name"), "page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
