"""A crawl over stored pages: what can be reached from some addresses by links, and in how many steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.urls import links, resolved, without_fragment
from loomtext.sources.scratch import stored


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(at, to): the distinct links of each page, as addresses without fragments. Only http and https ones."""
    rows = pages.where(F.col(url).isNotNull()).select(F.col(url).alias("base"), F.explode(links(F.col(html))).alias("link"))
    out = rows.select(without_fragment(F.col("base")).alias("at"), resolved(F.col("base"), F.col("link")).alias("to"))
    return out.where(F.lower("to").rlike("^https?://")).distinct()


def reached(pages: DataFrame, seeds: DataFrame, most: int | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """(url, depth): every address that can be reached from the seeds (url, depth 0) in `most` steps (None: any number), with the least number of steps; also of pages that aren't stored, which lead nowhere.

    Pages are read once, for their links. A step joins the newest addresses with the links, and takes out what is known; each is
    stored, so a step is as much work as what it finds. It ends when nothing is new.
    """
    known = stored(seeds.select(without_fragment(F.col(url)).alias("url"), F.lit(0).alias("depth")).where("url IS NOT NULL").distinct())
    newest, every, depth = known, edges(pages, url, html), 0
    if most != 0:
        every = stored(every)
    while most is None or depth < most:
        depth += 1
        found = every.join(newest.select(F.col("url").alias("at")), "at", "left_semi").select(F.col("to").alias("url")).distinct()
        newest = stored(found.join(known.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if newest.isEmpty():
            break
        known = known.unionByName(newest)
    return known
