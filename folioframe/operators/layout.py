"""Order, numbering and ownership of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique(blocks: DataFrame) -> DataFrame:
    """One row per block; rows of one key are exact copies."""
    return blocks.dropDuplicates(["paper", "id"])


def with_order(blocks: DataFrame) -> DataFrame:
    """Where any box of a page has no order, all boxes of the page take their position instead."""
    page = Window.partitionBy("paper", "page")
    place = F.row_number().over(page.orderBy("seq", "id")).cast("double")
    return unique(blocks).withColumn("place", F.when(F.max(F.col("ord").isNull()).over(page), place).otherwise(F.col("ord")))


def numbering(blocks: DataFrame) -> DataFrame:
    """Dense numbers of top-level blocks on their page, as names p000b000 that grow beyond three digits."""
    n = F.row_number().over(Window.partitionBy("paper", "page").orderBy("place", "seq", "id")) - 1
    return with_order(blocks).where("kind <> 'inline_math'").withColumn("n", n).select("paper", "id", F.format_string("p%03db%03d", "page", "n").alias("name"))


def children(blocks: DataFrame) -> DataFrame:
    """Inline formulas in slot order; slots whose block is missing are dropped."""
    b = unique(blocks)
    slots = b.select("paper", F.col("id").alias("owner"), F.posexplode("inline").alias("slot", "child"))
    return slots.join(b.select("paper", F.col("id").alias("child"), F.col("text").alias("child_text")), ["paper", "child"]).select("paper", "owner", "slot", "child", "child_text")


def reading_order(blocks: DataFrame) -> DataFrame:
    """Rank of every top-level block in its paper; captions and footnotes follow their owner.

    Blocks are ranked within a page, the page of their owner, and a page's ranks begin where the pages before
    it end: no window holds the blocks of a whole paper, only one number for each of its pages.
    """
    b = with_order(blocks).where("parent is null or kind in ('caption', 'footnote')")
    owner = F.coalesce(F.try_element_at("links", F.lit("caption_of")), F.try_element_at("links", F.lit("footnote_of")))
    b = b.withColumn("owner", owner)
    o = b.select(F.col("paper").alias("op"), F.col("id").alias("oid"), F.col("page").alias("opage"), F.col("place").alias("oplace"), F.col("seq").alias("oseq"), F.col("kind").alias("okind"))
    j = b.join(o, (F.col("paper") == F.col("op")) & (F.col("owner") == F.col("oid")), "left")
    kept = j.where("kind <> 'furniture' and (owner is null or (oid is not null and okind <> 'furniture'))").withColumn("at", F.coalesce("opage", "page"))
    keys = [F.coalesce("oplace", "place"), F.coalesce("oseq", "seq"), F.coalesce("oid", "id"), F.col("owner").isNotNull(), "page", "place", "seq", "id"]
    on_page = kept.withColumn("nth", F.row_number().over(Window.partitionBy("paper", "at").orderBy(*keys))).select("paper", "at", "id", "page", "kind", "owner", "nth")
    sizes = on_page.groupBy("paper", "at").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("paper").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("paper").alias("sp"), F.col("at").alias("sat"), F.coalesce(before, F.lit(0)).alias("before"))
    ranked = on_page.join(starts, F.col("paper").eqNullSafe(F.col("sp")) & F.col("at").eqNullSafe(F.col("sat")))
    return ranked.select("paper", "id", "page", "kind", "owner", (F.col("before") + F.col("nth")).cast("int").alias("rank"))
