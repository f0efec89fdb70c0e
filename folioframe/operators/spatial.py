"""Spatial joins of glyphs and boxes. All are local to a page: (paper, page) is the equi key and
the box test a residual condition, so that no plan falls back to a nested loop, and a page's
glyphs meet that page's few boxes only. AQE splits the partition of a very large paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.operators.glyphs import KEY, center, is_visible, unique

# Kinds that claim glyphs, kinds of prose, and the slack of a box in points.
PROSE_KINDS = ("title", "heading", "text", "list", "caption", "footnote", "reference")
CLAIMING_KINDS = (*PROSE_KINDS, "display_math", "figure", "table", "code", "algorithm", "furniture", "other")
PAD = 1.0


def area(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.col(x1) - F.col(x0)) * F.greatest(zero, F.col(y1) - F.col(y0))


def boxes(blocks: DataFrame, prefix: str = "b_") -> DataFrame:
    return blocks.dropDuplicates(["paper", "id"]).select("paper", "page", F.col("id").alias(prefix + "id"), F.col("kind").alias(prefix + "kind"), F.col("parent").alias(prefix + "parent"), F.col("seq").alias(prefix + "seq"), *[F.col(c).alias(prefix + c) for c in ("x0", "y0", "x1", "y1")])


def glyph_owner(glyphs: DataFrame, blocks: DataFrame, *carried: Column) -> DataFrame:
    """(key..., owner, carried...): the smallest top-level claiming block around each visible glyph, else null.
    ``carried`` columns of the glyph come along, so that nobody has to join them back."""
    cx, cy = center()
    g = unique(glyphs).where(is_visible()).select(*KEY, cx.alias("cx"), cy.alias("cy"), *carried)
    names = [c for c in g.columns if c not in (*KEY, "cx", "cy")]
    b = boxes(blocks).where(F.col("b_kind").isin(*CLAIMING_KINDS) & F.col("b_parent").isNull()).withColumn("b_area", area("b_x0", "b_y0", "b_x1", "b_y1"))
    b = b.withColumnsRenamed({"paper": "bp", "page": "bpage"})
    inside = (F.col("paper") == F.col("bp")) & (F.col("page") == F.col("bpage")) & F.col("cx").between(F.col("b_x0") - PAD, F.col("b_x1") + PAD) & F.col("cy").between(F.col("b_y0") - PAD, F.col("b_y1") + PAD)
    hit = g.join(b, inside, "left")
    return hit.groupBy(*KEY).agg(F.min_by("b_id", F.struct("b_area", "b_seq", "b_id")).alias("owner"), *[F.first(n).alias(n) for n in names])


def region_evidence(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per block what the text layer holds inside its box (touching counts), in one join and one aggregation."""
    g = unique(glyphs).select(F.col("paper").alias("gp"), F.col("page").alias("gpage"), "font", "suspicious_encoding", "x0", "y0", "x1", "y1")
    b = boxes(blocks)
    meets = (F.col("gp") == F.col("paper")) & (F.col("gpage") == F.col("page")) & (F.col("x0") <= F.col("b_x1")) & (F.col("x1") >= F.col("b_x0")) & (F.col("y0") <= F.col("b_y1")) & (F.col("y1") >= F.col("b_y0"))
    cx, cy = center()
    target = cx.between(F.col("b_x0"), F.col("b_x1")) & cy.between(F.col("b_y0"), F.col("b_y1"))
    return b.join(g, meets, "left").groupBy("paper", F.col("b_id").alias("id")).agg(
        F.count("gp").alias("glyphs"), F.count_if(target).alias("in_target"), F.count_if("suspicious_encoding").alias("suspicious"),
        F.array_join(F.array_sort(F.collect_set("font")), ",").alias("fonts"), F.when(F.count("gp") > 0, "text_present").otherwise("no_text_in_region").alias("status"))


def enclosing_prose(blocks: DataFrame) -> DataFrame:
    """Each inline formula's smallest enclosing prose block on its page (no slack), else null."""
    inner = boxes(blocks, "i_").where("i_kind = 'inline_math'").withColumnsRenamed({"paper": "ip", "page": "ipage"})
    outer = boxes(blocks, "o_").where(F.col("o_kind").isin(*PROSE_KINDS)).withColumn("o_area", area("o_x0", "o_y0", "o_x1", "o_y1"))
    around = (F.col("ip") == F.col("paper")) & (F.col("ipage") == F.col("page")) & (F.col("o_x0") <= F.col("i_x0")) & (F.col("o_y0") <= F.col("i_y0")) & (F.col("o_x1") >= F.col("i_x1")) & (F.col("o_y1") >= F.col("i_y1"))
    return inner.join(outer, around, "left").groupBy(F.col("ip").alias("paper"), F.col("i_id").alias("id")).agg(F.min_by("o_id", F.struct("o_area", "o_seq", "o_id")).alias("enclosing"))


def best_overlap(blocks: DataFrame, floor: float = 0.5) -> DataFrame:
    """For each block the other block of its page with the highest intersection over union, if at least ``floor``."""
    a = boxes(blocks, "a_").withColumnsRenamed({"paper": "ap", "page": "apage"})
    b = boxes(blocks)
    w = F.greatest(F.lit(0.0), F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"))
    h = F.greatest(F.lit(0.0), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0"))
    both = w * h
    union = area("a_x0", "a_y0", "a_x1", "a_y1") + area("b_x0", "b_y0", "b_x1", "b_y1") - both
    meets = (F.col("ap") == F.col("paper")) & (F.col("apage") == F.col("page")) & (F.col("a_id") != F.col("b_id")) & (F.col("a_x0") < F.col("b_x1")) & (F.col("b_x0") < F.col("a_x1")) & (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    scored = a.join(b, meets).withColumn("iou", F.when(union > 0, both / union).otherwise(0.0)).where(F.col("iou") >= floor)
    return scored.groupBy("paper", F.col("a_id").alias("id")).agg(F.max_by("b_id", F.struct("iou", -F.col("b_seq"), "b_id")).alias("other"), F.round(F.max("iou"), 6).alias("iou"))


def box_union(blocks: DataFrame) -> DataFrame:
    """Box around all children of a block."""
    return blocks.dropDuplicates(["paper", "id"]).where("parent is not null").groupBy("paper", "parent").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))], F.count(F.lit(1)).alias("children"))
