"""Text of blocks from engines or text layer, Markdown with marks, and what leaves the library."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioframe.functions.latex import math_spans, split_tags
from folioframe.functions.lines import SLOT
from folioframe.functions.udfs import column
from folioframe.operators import layout, stages, text, vote
from folioframe.operators.glyphs import text_layer_status
from folioframe.session import durable


def slotted(markdown: str) -> dict:
    """An engine's prose with a slot for every formula, and the formulas. Where delimiters don't pair, all is text."""
    raw = markdown.replace(SLOT, "")
    spans, whole = math_spans(raw)
    parts, at = [], 0
    for start, end, *_ in spans if whole else ():
        parts += [raw[at:start], SLOT]
        at = end
    return {"text": re.sub(r"\s+", " ", "".join([*parts, raw[at:]])).strip(), "formulas": [raw[a:b] for _, _, a, b in spans] if whole else []}


_slotted = column("struct<text:string,formulas:array<string>>", slotted)


def engine_text(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper, id, text, formulas, source): prose blocks as the first engine reads them that gives text or
    Markdown; formulas are looked for in Markdown only."""
    c = vote.current(candidates).where("format in ('markdown', 'text')").groupBy("paper", "block").agg(F.min_by(F.struct("engine", "format", "content"), F.struct("seq", "engine")).alias("c"))
    b = layout.unique(blocks).where(F.col("kind").isin(*stages.PROSE_KINDS)).select("paper", "id")
    j = b.join(c.withColumnRenamed("block", "id"), ["paper", "id"], "left")
    plain = F.struct(F.trim(F.regexp_replace(F.replace(F.coalesce("c.content", F.lit("")), F.lit(SLOT), F.lit("")), r"\s+", " ")).alias("text"), F.array().cast("array<string>").alias("formulas"))
    read = F.when((F.col("c.format") == "markdown") & F.col("c.content").rlike(r"[$\\`]"), _slotted("c.content")).otherwise(plain)
    return j.select("paper", "id", read.alias("r"), F.coalesce(F.concat(F.lit("engine:"), "c.engine"), F.lit("none")).alias("source")).select("paper", "id", "r.text", "r.formulas", "source")


def text_stage(blocks: DataFrame, glyphs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper, id, text, formulas, source) of every prose block: from the text layer where its page has a
    readable one and glyphs lie in the block, else from an engine."""
    good = text_layer_status(glyphs).where(F.col("status").isin(*stages.READABLE_LAYERS)).select("paper", "page")
    prose = layout.unique(blocks).where(F.col("kind").isin(*stages.PROSE_KINDS)).join(good, ["paper", "page"], "left_semi").select("paper", "id")
    layer = text.composed_text(glyphs, blocks).join(prose, ["paper", "id"], "left_semi").select("paper", "id", "text", F.col("slots").alias("formulas"), F.lit("text_layer").alias("source"))
    return layer.unionByName(engine_text(blocks, candidates).join(layer.select("paper", "id"), ["paper", "id"], "left_anti"))


def inline_children(read: DataFrame) -> DataFrame:
    """(paper, parent, id, slot, latex): one row for every slot of a text, named after its block."""
    return read.select("paper", F.col("id").alias("parent"), F.posexplode("formulas").alias("slot", "latex")).select("paper", "parent", F.format_string("%s.m%02d", "parent", "slot").alias("id"), "slot", "latex")


_tagged = column("struct<body:string,tags:array<string>>", lambda t: dict(zip(("body", "tags"), (lambda b, g: (b, [x[0] for x in g]))(*split_tags(t)))))


def display_latex(blocks: DataFrame, decisions: DataFrame, numbers: DataFrame) -> DataFrame:
    """(paper, id, latex): decided display formulas with the number that stands beside them, where they have no
    tag of their own. ``numbers``: (paper, id, status, numbers)."""
    d = vote.latest_decisions(decisions).where("value is not null").select("paper", F.col("block").alias("id"), F.trim("value").alias("value"))
    b = layout.unique(blocks).where("kind = 'display_math'").select("paper", "id").join(d, ["paper", "id"])
    own = numbers.where("status = 'associated_by_layout'").select("paper", "id", F.col("numbers").alias("number"))
    j = b.join(own, ["paper", "id"], "left").withColumn("t", _tagged("value"))
    bare = (F.size("t.tags") == 0) & F.col("number").isNotNull()
    return j.select("paper", "id", F.when(bare, F.concat("t.body", F.lit(r" \tag{"), "number", F.lit("}"))).otherwise(F.col("value")).alias("latex"))


def front_matter(blocks: DataFrame) -> DataFrame:
    """(paper, front): a document's head with its first title as a JSON string."""
    first = layout.with_order(blocks).where("kind = 'title' and text is not null").groupBy("paper").agg(F.min_by("text", F.struct("page", "place", "seq", "id")).alias("title"))
    quoted = F.regexp_extract(F.to_json(F.struct("title")), r"(?s)^\{\"title\":(.*)\}$", 1)
    return first.select("paper", F.concat(F.lit("---\ntitle: "), quoted, F.lit("\n---\n")).alias("front"))


def working_markdown(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper, rank, id, markdown): blocks in reading order, each after a mark that names it; formulas that are
    not final say so."""
    s = stages.states(blocks, decisions).select("paper", F.col("block").alias("id"), "kind", "page", "status")
    mark = F.format_string("<!-- %s p%d %s -->\n", "id", F.col("page") + 1, "kind")
    open_ = (F.col("kind") == "display_math") & ~stages.is_final(F.col("status"))
    d = text.documents(blocks).join(s, ["paper", "id"])
    return d.select("paper", "rank", "id", F.concat(mark, "markdown", F.when(open_, F.format_string("<!--unresolved %s-->", "id")).otherwise("")).alias("markdown"))


def write_markdown(documents: DataFrame, folder: str) -> None:
    """Blocks as text files, one folder per paper, in order: a paper's parts are split by rank where it is large."""
    ordered = documents.repartitionByRange("paper", "rank").sortWithinPartitions("paper", "rank")
    ordered.select("paper", F.concat("markdown", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("paper").text(folder)


def export(blocks: DataFrame, decisions: DataFrame, folder: str, allow_unresolved: bool = False) -> None:
    """Write the Markdown of all papers, unless formulas are open and that is not allowed."""
    held = stages.export_gate(blocks, decisions).where("not allowed").orderBy("paper").limit(1).collect()
    if held and not allow_unresolved:
        raise ValueError(f"{held[0].paper}: {held[0].pending} formulas are open ({held[0].first})")
    write_markdown(text.documents(blocks), folder)


def answers_from_json(lines: DataFrame) -> DataFrame:
    """(task_id, choice, latex, input_hash, note) from a model's replies (task_id, reply, input_hash). A reply may
    stand under its task's name; what can't be read is left open, with the first 2,000 characters as a note."""
    shape = "choice string, latex string"
    own = F.from_json("reply", shape)
    named = F.from_json("reply", "map<string,string>")
    inner = F.from_json(F.try_element_at(named, F.col("task_id")), shape)
    got = F.when(own["choice"].isNotNull(), own).when(inner["choice"].isNotNull(), inner)
    read = lines.withColumn("a", got)
    return read.select("task_id", F.coalesce("a.choice", F.lit("open")).alias("choice"), "a.latex", "input_hash", F.when(F.col("a").isNull(), F.left("reply", F.lit(2000))).alias("note"))


# ---------------------------------------------------------------- a run's stages

def mark(done: DataFrame, finished: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(paper, stage, key): the table of finished stages after ``finished`` (paper, stage, key) was done anew;
    what comes after a stage that ran again no longer holds."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    new = finished.withColumn("at", at)
    first = new.groupBy("paper").agg(F.min("at").alias("from"))
    kept = done.withColumn("at", at).join(first, "paper", "left").where("from is null or at < from").select("paper", "stage", "key")
    last = Window.partitionBy("paper", "stage").orderBy(F.col("key").asc_nulls_first())
    return kept.unionByName(new.withColumn("r", F.row_number().over(last)).where("r = 1").select("paper", "stage", "key"))


def due(papers: DataFrame, done: DataFrame, order: tuple[str, ...], keys: dict[str, str | None]) -> DataFrame:
    """(paper, stage): the first stage of each paper that is not done with the settings of now; papers that are
    through have no row."""
    wanted = papers.select("paper").distinct().select("paper", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s).alias("stage"), F.lit(keys.get(s)).cast("string").alias("want")) for i, s in enumerate(order)])).alias("w")).select("paper", "w.*")
    # a stage without settings is done when it has a row, whatever its key
    have = done.withColumn("has", F.lit(True))
    missing = wanted.join(have, ["paper", "stage"], "left").where("has is null or want is not null and not (key <=> want)")
    return missing.groupBy("paper").agg(F.min_by("stage", "at").alias("stage"))


def run_stages(papers: DataFrame, done: DataFrame, bodies: dict, order: tuple[str, ...], keys: dict[str, str | None]) -> DataFrame:
    """The table of finished stages after a run: one stage after another over all papers for which it is due.

    ``bodies``: stage -> function of the due papers (paper) that gives those it finished (paper). Papers that a
    body leaves out wait; the others go on. Every stage's outcome is written once.
    """
    for stage in order:
        todo = durable(due(papers, done, order, keys).where(F.col("stage") == stage).select("paper"))
        if not todo.isEmpty():
            finished = bodies[stage](todo).select("paper", F.lit(stage).alias("stage"), F.lit(keys.get(stage)).cast("string").alias("key")).distinct()
            done = durable(mark(done, finished, order))
    return done
