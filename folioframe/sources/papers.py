"""Papers as files: listing, keys, documents as JSON, TeX projects and reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions.tex import include_names
from folioframe.functions.udfs import column
from folioframe.session import durable
from folioframe.sources.regions import files, paper_key


def listed(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(paper, path, sha256) of a folder's files. Raises if there are none, or if one key names two files."""
    found = files(spark, folder, pattern).withColumn("paper", paper_key(F.col("path")))
    clash = found.groupBy("paper").agg(F.count_distinct("sha256").alias("n"), F.array_sort(F.collect_set("path")).alias("paths")).where("n > 1").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0].paper}: {', '.join(clash[0].paths)} are different files under one key")
    if found.isEmpty():
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return found.groupBy("paper").agg(F.min("path").alias("path"), F.min("sha256").alias("sha256"))


def changed(found: DataFrame, known: DataFrame) -> DataFrame:
    """Papers that are known under their key with another content."""
    k = known.groupBy("paper").agg(F.max("sha256").alias("had"))
    return found.join(k, "paper").where("sha256 <> had").select("paper", "path", "sha256", "had")


def load_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """Stored documents, one JSON file each; unreadable ones raise."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(pattern)


def save_documents(documents: DataFrame, folder: str) -> None:
    """One row per document; the writer's commit protocol makes the folder appear whole or not at all."""
    documents.write.mode("overwrite").option("compression", "gzip").json(folder)


# ---------------------------------------------------------------- TeX projects

_DOCUMENT = r"\\begin\s*\{document\}"
#: File names that a main file may have where several could be one.
MAIN_NAMES = ("main", "ms", "paper", "article")


def main_files(sources: DataFrame, stated: DataFrame | None = None) -> DataFrame:
    """(project, path) of each project's main file; projects where it can't be told have no row.

    ``sources``: (project, path, text). ``stated``: (project, path, rank), what a project says itself, the lowest
    rank first; it counts where the file is there. Else the only file that is a whole document, or the only one
    of those with a usual name.
    """
    whole = sources.where(F.col("path").endswith(".tex") & F.col("text").rlike(r"\\documentclass") & F.col("text").rlike(_DOCUMENT))
    stem = F.regexp_extract("path", r"([^/]*)\.tex$", 1)
    named = whole.where(stem.isin(*MAIN_NAMES))
    lone = lambda d: d.groupBy("project").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").select("project", "path")
    options = lone(whole).withColumn("rank", F.lit(1000)).unionByName(lone(named).withColumn("rank", F.lit(1001)))
    if stated is not None:
        options = options.unionByName(stated.join(sources.select("project", "path"), ["project", "path"], "left_semi").select("project", "path", "rank"))
    return options.groupBy("project").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


_names = column("struct<all:array<string>,body:array<string>>", lambda t: {"all": include_names(t), "body": include_names(t, True)})


def included(sources: DataFrame, mains: DataFrame) -> DataFrame:
    """(project, path, depth): every file that a main file includes from its document, at any depth, once each.

    A name is looked for beside the including file, then at the project's root, with and without ``.tex``.
    Levels are joined one after another until one brings nothing new, each written once.
    """
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    edge = sources.select("project", "path", folder.alias("folder"), _names("text").alias("n"))
    edge = edge.select("project", "path", "folder", F.explode(F.transform("n.all", lambda x: F.struct(x.alias("name"), F.array_contains("n.body", x).alias("in_body")))).alias("e"))
    places = F.array(*[F.struct(F.lit(i).alias("rank"), F.concat(base, F.col("e.name"), F.lit(end)).alias("target")) for i, (base, end) in enumerate((b, e) for b in (F.col("folder"), F.lit("")) for e in ("", ".tex"))])
    there = sources.select("project", F.col("path").alias("target"))
    tried = edge.select("project", "path", "e.name", "e.in_body", F.explode(places).alias("p")).select("project", "path", "name", "in_body", "p.*").join(there, ["project", "target"])
    edges = durable(tried.groupBy("project", "path", "name").agg(F.min_by("target", "rank").alias("target"), F.max("in_body").alias("in_body")))
    level = durable(mains.select("project", "path", F.lit(0).alias("depth")))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        step = edges if depth > 1 else edges.where("in_body")
        found = level.select("project", "path").join(step, ["project", "path"]).select("project", F.col("target").alias("path")).distinct()
        level = durable(found.join(out.select("project", "path"), ["project", "path"], "left_anti").withColumn("depth", F.lit(depth)))
        out = out.unionByName(level)
    return out


# ---------------------------------------------------------------- reference data

GOLD = "paper string, layout_shifted_pages array<int>, formulas array<struct<id:int,display:boolean,latex:string,latex_expanded:string,status:string,expansion_complete:boolean,unsupported_macros:array<string>,occurrences:array<struct<page:int,layout_verified:boolean,glyphs:array<struct<text:string,x:double,y:double>>>>>>"


def load_gold(spark: SparkSession, pattern: str) -> DataFrame:
    """(paper, id, display, latex, ..., occurrences) of every formula of stored reference files."""
    raw = spark.read.schema(GOLD).option("multiLine", True).json(pattern)
    return raw.select("paper", F.explode("formulas").alias("f")).select("paper", "f.*")


def usable(gold: DataFrame) -> DataFrame:
    """Formulas that recognition can be scored on: one occurrence, in its verified place, fully expanded."""
    one = F.get("occurrences", F.lit(0))
    whole = (F.col("status") == "ok") & (F.size("occurrences") == 1) & one["layout_verified"] & F.col("expansion_complete")
    return gold.where(whole & (F.size("unsupported_macros") == 0) & (F.trim("latex_expanded") != ""))


def gold_summary(gold: DataFrame) -> DataFrame:
    """Per paper: formulas, those on a page, those displayed, those usable."""
    good = usable(gold).select("paper", "id", F.lit(True).alias("good"))
    shown = F.col("status") == "ok"
    return gold.join(good, ["paper", "id"], "left").groupBy("paper").agg(
        F.count(F.lit(1)).alias("formulas"), F.count_if(shown).alias("rendered"), F.count_if(shown & F.col("display")).alias("displayed"), F.count("good").alias("usable"))


def shifted_pages(clean: DataFrame, marked: DataFrame) -> DataFrame:
    """Pages on which the marked version does not have every glyph where the clean one has it.
    Both: (paper, page, nth, text, x, y), glyphs numbered in drawing order."""
    place = F.struct("text", "x", "y")
    a, b = clean.select("paper", "page", "nth", place.alias("a")), marked.select("paper", "page", "nth", place.alias("b"))
    return a.join(b, ["paper", "page", "nth"], "full_outer").groupBy("paper", "page").agg(F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("moved")).where("moved").select("paper", "page")


def marked_formulas(glyphs: DataFrame) -> DataFrame:
    """(paper, id, page, n, x0, y0, x1, y1): glyphs gathered by the number that their colour stands for.
    ``glyphs``: (paper, page, r, g, b, x0, y0, x1, y1); black and other colours are no marks."""
    from folioframe.functions.colour import decode

    g = glyphs.withColumn("id", decode(F.col("r"), F.col("g"), F.col("b"))).where("id is not null")
    return g.groupBy("paper", "id", "page").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def glyph_key(x: str = "x", y: str = "y"):
    """Identity of a glyph in two renderings of one page: origin to a tenth of a point, and character."""
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5).cast("long")
    return F.struct("paper", "page", tenth(x).alias("x"), tenth(y).alias("y"), "text")


def inline_benchmark(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: glyphs of inline formulas found, wrongly claimed and missed; claimed ones in math fonts that no
    formula is known for are set apart; and how many formulas were found whole, in part, or not.

    ``gold``: (paper, page, formula, display, text, x, y); ``predicted``: (paper, page, text, x, y, math_font).
    """
    g = gold.select(glyph_key().alias("k"), "paper", "formula", "display").distinct()
    p = predicted.groupBy(glyph_key().alias("k")).agg(F.bool_or("math_font").alias("math_font"))
    per_key = g.groupBy("k").agg(F.bool_or("display").alias("display"), F.bool_or(~F.col("display")).alias("inline"))
    both = per_key.join(p.withColumn("claimed", F.lit(True)), "k", "full_outer")
    claimed, inline, display = (F.coalesce(F.col(c), F.lit(False)) for c in ("claimed", "inline", "display"))
    loose = claimed & ~inline & ~display
    unknown = loose & F.coalesce("math_font", F.lit(False))
    glyphs = both.agg(F.count_if(inline & claimed & ~display).alias("tp"), F.count_if(loose & ~unknown).alias("fp"), F.count_if(inline & (~claimed | display)).alias("fn"), F.count_if(unknown).alias("unknown_math_font"))
    hit = g.where(~F.col("display")).join(both.where(claimed & ~display).select("k", F.lit(True).alias("hit")), "k", "left").groupBy("paper", "formula").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"))
    formulas = hit.agg(F.count(F.lit(1)).alias("formulas"), F.count_if(F.col("hits") == F.col("n")).alias("exact"), F.count_if(F.col("hits") == 0).alias("missed"), F.count_if((F.col("hits") > 0) & (F.col("hits") < F.col("n"))).alias("partial"))
    total = lambda d: d.withColumn("all", F.lit(1))
    return total(glyphs).join(total(formulas), "all").drop("all")
