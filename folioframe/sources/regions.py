"""Regions from layout engines' JSON, and files from folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.udfs import nfkc

MIDDLE = (
    "struct<pdf_info:array<struct<page_idx:int,page_size:array<double>,para_blocks:array<struct<type:string,bbox:array<double>,index:int,level:int,"
    "lines:array<struct<spans:array<struct<type:string,content:string,html:string,bbox:array<double>>>>>>>,discarded_blocks:array<struct<type:string,bbox:array<double>,index:int,level:int,"
    "lines:array<struct<spans:array<struct<type:string,content:string,html:string,bbox:array<double>>>>>>>>>>"
)
LAYOUT = "struct<boxes:array<struct<cls_id:int,label:string,score:double,coordinate:array<double>,order:double>>>"
# Engine names of kinds.
KINDS = {"title": "heading", "text": "text", "list": "list", "interline_equation": "display_math", "image": "figure", "table": "table", "code": "code"}
LABELS = {"doc_title": "title", "paragraph_title": "heading", "text": "text", "abstract": "text", "content": "text", "reference": "reference", "reference_content": "reference", "footnote": "footnote", "vision_footnote": "footnote", "algorithm": "algorithm", "image": "figure", "chart": "figure", "figure_title": "caption", "table": "table", "display_formula": "display_math", "inline_formula": "inline_math", "formula_number": "text", "header": "furniture", "footer": "furniture", "number": "furniture", "seal": "other"}
#: Blocks that a page puts aside come after all others.
DISCARDED = 10000.0


def _map(pairs: dict[str, str]):
    return F.create_map(*[F.lit(x) for p in pairs.items() for x in p])


def from_middle(files: DataFrame) -> DataFrame:
    """(paper, page, idx, kind, ord, level, text, x0..y1) from ``files`` (paper, json)."""
    page = files.select("paper", F.explode(F.from_json("json", MIDDLE)["pdf_info"]).alias("p"))
    kept = page.select("paper", "p.page_idx", F.posexplode("p.para_blocks").alias("idx", "b")).withColumn("add", F.lit(0.0))
    aside = page.select("paper", "p.page_idx", F.posexplode("p.discarded_blocks").alias("idx", "b")).withColumn("add", F.lit(DISCARDED))
    both = kept.unionByName(aside)
    line = lambda x: F.array_join(F.transform(x["spans"], lambda s: F.when(s["type"] == "inline_equation", F.concat(F.lit("$"), s["content"], F.lit("$"))).otherwise(F.coalesce(s["content"], F.lit("")))), "")
    kind = F.when(F.col("add") > 0, "furniture").when((F.col("b.type") == "title") & (F.col("b.level") == 1), "title").otherwise(F.coalesce(_map(KINDS)[F.col("b.type")], F.lit("other")))
    return both.select("paper", F.col("page_idx").alias("page"), "idx", kind.alias("kind"), (F.coalesce(F.col("b.index"), F.col("idx")) + F.col("add")).alias("ord"), F.col("b.level").alias("level"), F.array_join(F.transform("b.lines", line), "\n").alias("text"), *[F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def from_layout(files: DataFrame) -> DataFrame:
    """The same from pixel boxes: ``files`` (paper, page, scale, json). One missing order on a page
    makes all boxes of the page take their position."""
    box = files.select("paper", "page", "scale", F.from_json("json", LAYOUT)["boxes"].alias("bs"))
    none = F.exists("bs", lambda b: b["order"].isNull())
    each = box.withColumn("none", none).select("paper", "page", "scale", "none", F.posexplode("bs").alias("idx", "b"))
    order = F.when(F.col("none") | F.col("b.order").isNull(), F.col("idx") + 1.0).otherwise(F.col("b.order"))
    level = F.when(F.col("b.label") == "doc_title", 1).when(F.col("b.label") == "paragraph_title", 2)
    return each.select("paper", "page", "idx", F.coalesce(_map(LABELS)[F.col("b.label")], F.lit("other")).alias("kind"), order.alias("ord"), level.alias("level"), *[(F.col("b.coordinate")[i] / F.col("scale")).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))])


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, size, sha256) of the files of a folder, without those below it."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def paper_key(path):
    """Key of a paper from its file name: compatible characters as one, then ASCII word signs, dots and dashes;
    ``paper`` if nothing is left."""
    path = F.when(path.rlike(r"^[\x00-\x7f]*$"), path).otherwise(nfkc(path))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(stem, r"[^A-Za-z0-9_.\-]+", "_"), r"^[._]+|[._]+$", ""), F.lit("")), F.lit("paper"))


def glyphs_from_pdf(files: DataFrame, extract=None) -> DataFrame:
    """Glyph rows of PDF files by a pluggable ``extract(bytes) -> iterator of tuples``; the parser
    itself is not part of this library."""
    if extract is None:
        raise NotImplementedError("no PDF parser is installed; pass extract=")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame([(path, *r) for r in extract(content)], columns=["path", "page", "span", "ch", "text", "x0", "y0", "x1", "y1"])

    return files.mapInPandas(run, "path string, page int, span int, ch int, text string, x0 double, y0 double, x1 double, y1 double")
