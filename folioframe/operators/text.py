"""Text of blocks: from glyphs, as Markdown, as documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import lines as L
from folioframe.functions.udfs import lazily
from folioframe.operators.layout import children, reading_order, unique as unique_blocks
from folioframe.operators.spatial import glyph_owner

_GLYPH = "struct<text:string,font:string,size:double,x0:double,y0:double,x1:double,y1:double,ox:double,oy:double>"


def block_glyphs(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, owner, glyphs): each block's visible glyphs in drawing order; a block is a bounded group."""
    item = F.struct("span", "ch", F.struct("text", "font", F.col("size_pt").alias("size"), "x0", "y0", "x1", "y1", "ox", "oy").alias("g"))
    owned = glyph_owner(glyphs, blocks, item.alias("item")).where("owner is not null")
    return owned.groupBy("paper", "owner").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["g"]).alias("glyphs"))


def _compose(column: pd.Series) -> pd.DataFrame:
    rows = []
    for gs in column:
        gs = [dict(g) for g in gs]
        body = sorted(g["size"] for g in gs)[len(gs) // 2] if gs else 10.0
        lines = L.build_lines(gs)
        text, slots = L.compose(lines, [L.math_runs(x, body) for x in lines])
        rows.append({"text": text, "slots": ["".join(g["text"] for g in s) for s in slots], "lines": len(lines)})
    return pd.DataFrame(rows, columns=["text", "slots", "lines"])


_composed = lazily(lambda: F.pandas_udf(_compose, "struct<text:string,slots:array<string>,lines:int>"))


def composed_text(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Prose with slots of every block that owns glyphs."""
    return block_glyphs(glyphs, blocks).select("paper", F.col("owner").alias("id"), _composed("glyphs").alias("c")).select("paper", "id", "c.text", "c.slots", "c.lines")


def prose_markdown(blocks: DataFrame) -> DataFrame:
    """Prose with the children's formulas in its slots; a slot without a formula shows a question mark."""
    kids = children(blocks).groupBy("paper", F.col("owner").alias("id")).agg(F.array_sort(F.collect_list(F.struct("slot", "child_text"))).alias("kids"))
    b = unique_blocks(blocks).join(kids, ["paper", "id"], "left")
    parts = F.split("text", L.SLOT)
    fill = F.transform(F.coalesce("kids", F.array().cast("array<struct<slot:int,child_text:string>>")), lambda k: F.concat(F.lit("$"), F.coalesce(F.nullif(k["child_text"], F.lit("")), F.lit(r"\text{?}")), F.lit("$")))
    woven = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i < F.size(parts) - 1, F.coalesce(F.get(fill, i), F.lit(r"$\text{?}$"))).otherwise(F.lit("")))), "")
    return b.select("paper", "id", "page", "kind", "level", woven.alias("prose"))


def block_markdown(blocks: DataFrame) -> DataFrame:
    """Markdown of each block by its kind."""
    level = F.greatest(F.lit(2), F.least(F.lit(6), F.coalesce("level", F.lit(2))))
    md = (
        F.when(F.col("kind") == "title", F.concat(F.lit("# "), "prose"))
        .when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("prose")))
        .when(F.col("kind") == "display_math", F.concat(F.lit("$$\n"), "prose", F.lit("\n$$")))
        .when(F.col("kind").isin("code", "algorithm"), F.concat(F.lit("```\n"), "prose", F.lit("\n```")))
        .when(F.col("kind") == "footnote", F.concat(F.lit("> "), "prose"))
        .otherwise(F.col("prose")))
    return prose_markdown(blocks).where("prose is not null and prose <> ''").select("paper", "id", md.alias("markdown"))


def documents(blocks: DataFrame) -> DataFrame:
    """(paper, rank, markdown): a paper's Markdown as its blocks in reading order. A paper may be of any size,
    so it never stands in one value; written sorted by rank, with blank lines between, the rows are its file."""
    return reading_order(blocks).join(block_markdown(blocks), ["paper", "id"]).select("paper", "rank", "id", "markdown")


def context_mask(blocks: DataFrame) -> DataFrame:
    """For each inline formula the parent's text with this slot and the other slots marked."""
    kids = children(blocks)
    b = unique_blocks(blocks).select("paper", F.col("id").alias("owner"), "text")
    parts = F.split("text", L.SLOT)
    masked = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.when(i >= F.size(parts) - 1, "").when(i == F.col("slot"), "⟦THIS⟧").otherwise("⟦math⟧"))), "")
    return kids.join(b, ["paper", "owner"]).select("paper", "owner", "child", "slot", masked.alias("context"))
