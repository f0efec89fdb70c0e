"""What the text layer says about a formula: symbol counts, fonts, script roles, mapping conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry as G
from folioframe.functions import udfs
from folioframe.functions.atoms import SYMBOLS
from folioframe.operators.glyphs import KEY, center, is_visible, symbol, unique
from folioframe.operators.spatial import PAD, boxes

# The alphabet in which glyphs and formulas can be compared.
COMPARABLE = sorted(set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789()[],;=+-′") | {v for v in SYMBOLS.values() if "Ͱ" <= v <= "Ͽ" or v == "ϵ"})


def plain(c):
    return F.when(c == "−", "-").when(c == "'", "′").otherwise(c)


def glyphs_in_formulas(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, symbol, suspicious) of the visible glyphs whose centre lies in a formula block."""
    cx, cy = center()
    g = unique(glyphs).where(is_visible(False)).select(F.col("paper").alias("gp"), F.col("page").alias("gpage"), cx.alias("cx"), cy.alias("cy"), plain(symbol()).alias("symbol"), (F.col("mapped_text").isNull() & F.coalesce("suspicious_encoding", F.lit(False))).alias("suspicious"))
    b = boxes(blocks).where("b_kind in ('display_math', 'inline_math')")
    inside = (F.col("gp") == F.col("paper")) & (F.col("gpage") == F.col("page")) & F.col("cx").between(F.col("b_x0") - PAD, F.col("b_x1") + PAD) & F.col("cy").between(F.col("b_y0") - PAD, F.col("b_y1") + PAD)
    return b.join(g, inside).select("paper", F.col("b_id").alias("id"), "symbol", "suspicious")


def symbol_counts(candidates: DataFrame) -> DataFrame:
    """(paper, block, seq, symbol, n) of the printed symbols of formulas whose commands are all known."""
    a = candidates.select("paper", "block", "seq", udfs.atoms("content").alias("a")).where(F.size("a.unsupported") == 0)
    return a.select("paper", "block", "seq", F.explode("a.symbols").alias("symbol")).select("paper", "block", "seq", plain(F.col("symbol")).alias("symbol")).where(F.col("symbol").isin(*COMPARABLE)).groupBy("paper", "block", "seq", "symbol").agg(F.count(F.lit(1)).alias("n"))


def count_differences(glyphs: DataFrame, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Symbols that text layer and candidate show a different number of times; formulas with
    unreliable glyphs are left out."""
    comparable = F.col("symbol").isin(*COMPARABLE)
    # one row per formula: the counts of its symbols, and whether any glyph is unreliable
    per_symbol = glyphs_in_formulas(glyphs, blocks).groupBy("paper", F.col("id").alias("block"), "symbol").agg(F.count(F.lit(1)).alias("n"), F.max("suspicious").alias("bad"))
    pairs = lambda: F.map_from_entries(F.collect_list(F.when(comparable, F.struct("symbol", "n"))))
    have = per_symbol.groupBy("paper", "block").agg(pairs().alias("source"), F.max("bad").alias("bad")).where("not bad and size(source) > 0").drop("bad")
    read = symbol_counts(candidates).groupBy("paper", "block", "seq").agg(pairs().alias("read"))
    both = read.join(have, ["paper", "block"]).select("paper", "block", "seq", "source", "read", F.explode(F.array_union(F.map_keys("source"), F.map_keys("read"))).alias("symbol"))
    count = lambda c: F.coalesce(F.try_element_at(c, F.col("symbol")), F.lit(0))
    return both.select("paper", "block", "seq", "symbol", count("source").alias("source_count"), count("read").alias("candidate_count")).where("source_count <> candidate_count")


def mapping_conflicts(glyphs: DataFrame) -> DataFrame:
    """Glyphs of one font and glyph number that are mapped to more than one text."""
    g = unique(glyphs).where("mapped_text is not null and font_xref is not null")
    return g.groupBy("paper", "font_xref", "glyph_id").agg(F.count_distinct("mapped_text").alias("texts"), F.count(F.lit(1)).alias("glyphs")).where("texts > 1")


def apply_mapping(glyphs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed mappings (paper, font_xref, glyph_id, text) before the font's own, before the raw text."""
    m = confirmed.groupBy("paper", "font_xref", "glyph_id").agg(F.max("text").alias("confirmed"))
    return unique(glyphs).join(m, ["paper", "font_xref", "glyph_id"], "left").select(*KEY, F.coalesce("confirmed", F.nullif("mapped_text", F.lit("")), "text").alias("symbol"), F.when(F.col("confirmed").isNotNull(), "confirmed").when(F.col("mapped_text").isNotNull(), "font_table").alias("source"))


# ---------------------------------------------------------------- checks of single formulas and pages

def _glyph():
    return F.struct("span", "ch", F.struct(symbol().alias("symbol"), "font", F.col("size_pt").alias("size"), "x0", "y0", "x1", "y1", "ox", "oy").alias("g"))


def formula_glyphs(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, page, glyphs) of formula blocks: the visible glyphs with their centre inside, in drawing order."""
    cx, cy = center()
    g = unique(glyphs).where(is_visible(False)).withColumns({"item": _glyph(), "cx": cx, "cy": cy}).select(F.col("paper").alias("gp"), F.col("page").alias("gpage"), "cx", "cy", "item")
    b = boxes(blocks).where("b_kind in ('display_math', 'inline_math')")
    inside = (F.col("gp") == F.col("paper")) & (F.col("gpage") == F.col("page")) & F.col("cx").between(F.col("b_x0") - PAD, F.col("b_x1") + PAD) & F.col("cy").between(F.col("b_y0") - PAD, F.col("b_y1") + PAD)
    return b.join(g, inside).groupBy("paper", F.col("b_id").alias("id"), "page").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["g"]).alias("glyphs"))


def _per_row(returns: str, f):
    """``f`` over two columns of one row."""
    def make():
        if returns.startswith("struct"):
            def rows(a: pd.Series, b: pd.Series) -> pd.DataFrame:
                return pd.DataFrame([f(_plain(x), _plain(y)) for x, y in zip(a, b)], columns=[p.split(":")[0] for p in returns[7:-1].split(",")])
            return F.pandas_udf(rows, returns)

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(_plain(x), _plain(y)) for x, y in zip(a, b)], dtype=object)
        return F.pandas_udf(two, returns)
    return udfs.lazily(make)


def _plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = list(v)
    return [dict(x) if isinstance(x, dict) else x for x in v] if isinstance(v, list) else v


_scripts = _per_row("array<struct<symbol:string,source:string,candidate:string>>", G.script_findings)
_labels = _per_row("array<struct<id:string,status:string,numbers:array<string>>>", lambda gs, bs: G.number_labels(gs, [(b["id"], b["x0"], b["y0"], b["x1"], b["y1"]) for b in bs]))
_edges = _per_row("array<struct<trim:string,prose:string,first:int,last:int>>", G.edge_prose)


_matrices = _per_row("struct<status:string,rows:int,source_rows:int>", G.matrix_findings)


def matrix_checks(glyphs: DataFrame, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper, block, seq, status, rows, source_rows) of readings that may hold a matrix."""
    j = formula_glyphs(glyphs, blocks).withColumnRenamed("id", "block").join(candidates, ["paper", "block"])
    return j.select("paper", "block", "seq", _matrices("glyphs", "content").alias("m")).select("paper", "block", "seq", "m.*")


def script_findings(glyphs: DataFrame, blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Symbols that text layer and candidate place in different scripts."""
    j = formula_glyphs(glyphs, blocks).withColumnRenamed("id", "block").join(candidates, ["paper", "block"])
    return j.select("paper", "block", "seq", F.explode(_scripts("glyphs", "content")).alias("f")).select("paper", "block", "seq", "f.*")


def number_association(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Equation numbers of display formulas. A page's glyphs and boxes meet in one row."""
    g = unique(glyphs).where(is_visible(False)).groupBy("paper", "page").agg(F.transform(F.array_sort(F.collect_list(_glyph())), lambda x: x["g"]).alias("glyphs"))
    b = blocks.dropDuplicates(["paper", "id"]).where("kind = 'display_math'").groupBy("paper", "page").agg(F.array_sort(F.collect_list(F.struct("id", "x0", "y0", "x1", "y1"))).alias("bs"))
    return b.join(g, ["paper", "page"]).select("paper", F.explode(_labels("glyphs", "bs")).alias("l")).select("paper", "l.id", "l.status", F.array_join("l.numbers", ",").alias("numbers"))


def edge_prose(glyphs: DataFrame, blocks: DataFrame, fonts: DataFrame) -> DataFrame:
    """Prose in the page's body font inside formulas. ``fonts``: (paper, page, font)."""
    j = formula_glyphs(glyphs, blocks).join(fonts.select("paper", "page", F.col("font").alias("body")), ["paper", "page"])
    return j.select("paper", "id", F.explode(_edges("glyphs", "body")).alias("e")).select("paper", "id", "e.trim", "e.prose")
