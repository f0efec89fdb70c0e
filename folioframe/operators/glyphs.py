"""Operators over the glyph table. Keys are (paper, page, span, ch); exact copies are one glyph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("paper", "page", "span", "ch")
# The thresholds and the font families that the results depend on.
LAYER_MINIMUM = 20
DEGRADED_SHARE = 0.05
MATH_FONT = r"(?i)(MI\d|SY\d|EX\d|math)"


def unique(glyphs: DataFrame) -> DataFrame:
    """One row per glyph; rows of one key are exact copies. Glyphs are spread by page, so that the removal of
    copies, joins with a page's boxes and grouping by page or line share one shuffle."""
    return glyphs.repartition("paper", "page").dropDuplicates(list(KEY))


def is_visible(with_space_test: bool = True) -> Column:
    shown = (F.col("render_type") != 3) & (F.col("opacity") > 0)
    return shown & ~F.col("text").rlike(r"^\s*$") if with_space_test else shown


def font_name() -> Column:
    """Font without its six-letter subset mark."""
    return F.regexp_replace("font", r"^[A-Z]{6}\+", "")


def is_math_font() -> Column:
    return font_name().rlike(MATH_FONT)


def symbol() -> Column:
    """The mapped text where a map gives one, else the raw text."""
    return F.coalesce(F.nullif("mapped_text", F.lit("")), F.col("text"))


def center() -> tuple[Column, Column]:
    return (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2


def text_layer_status(glyphs: DataFrame) -> DataFrame:
    """Class of each page's text layer from its glyphs, in one aggregation."""
    shown = is_visible(False)
    per_page = unique(glyphs).groupBy("paper", "page").agg(
        F.count_if(shown).alias("n_visible"), F.count_if(~shown).alias("n_invisible"), F.count_if(shown & F.col("suspicious_encoding")).alias("n_suspicious"))
    status = (
        F.when(F.col("n_visible") >= LAYER_MINIMUM, F.when(F.col("n_suspicious") > DEGRADED_SHARE * F.col("n_visible"), "degraded").otherwise("good"))
        .when(F.col("n_invisible") >= LAYER_MINIMUM, "ocr_layer").otherwise("none"))
    return per_page.withColumn("status", status)


def most_common(glyphs: DataFrame, value: Column, name: str) -> DataFrame:
    """Per page the most frequent value among visible glyphs; of equals the one drawn first."""
    n = unique(glyphs).where(is_visible(False)).select("paper", "page", value.alias(name), F.struct("span", "ch").alias("at")).groupBy("paper", "page", name).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    return n.groupBy("paper", "page").agg(F.max_by(name, F.struct("n", -F.col("first.span"), -F.col("first.ch"))).alias(name), F.max("n").alias("n"))


def gap_islands(glyphs: DataFrame, factor: float = 1.0) -> DataFrame:
    """Runs of glyphs on a line that no gap wider than ``factor`` times the size parts."""
    line = Window.partitionBy("paper", "page", "span").orderBy("x0", "ch")
    broken = F.when(F.col("x0") - F.lag("x1").over(line) > factor * F.col("size_pt"), 1).otherwise(0)
    run = unique(glyphs).where(is_visible()).withColumn("b", broken).withColumn("island", F.sum("b").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("paper", "page", "span", "island").agg(F.count(F.lit(1)).alias("glyphs"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
