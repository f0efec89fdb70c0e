"""The stages after recognition as relations: decisions of every block, what blocks a delivery, answers, status.

All work on whole tables, keyed by (paper, block); nothing is collected, and no group is larger than a block
or a page, but for counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioframe.operators import layout, vote
from folioframe.operators.glyphs import center, is_math_font, is_visible, symbol
from folioframe.operators.glyphs import unique as unique_glyphs
from folioframe.operators.spatial import PAD, PROSE_KINDS, area, boxes

# States, kinds and limits that the results depend on.
MATH_KINDS = ("display_math", "inline_math")
FINAL = ("accepted", "resolved")
READABLE_LAYERS = ("good", "degraded")
ANSWER_OPEN, ANSWER_CUSTOM = "open", "custom"


def is_final(status: Column) -> Column:
    return F.coalesce(status.isin(*FINAL), F.lit(False))


# ---------------------------------------------------------------- candidates


def pool(candidates: DataFrame, engines: DataFrame) -> DataFrame:
    """Readings that may vote: current runs in LaTeX that are not blank, of engines that have a place in the
    order of preference."""
    c = vote.with_family(vote.current(candidates), engines)
    return c.where(F.col("pref").isNotNull() & (F.col("format") == "latex") & F.col("content").rlike(r"\S"))


def without_stale(candidates: DataFrame, blocks: DataFrame, engines: DataFrame) -> DataFrame:
    """Candidates that stay when formulas are recognised anew: on formula blocks those of the formula
    recognisers (engines with a formula family that read no pages) go."""
    recognisers = engines.where("formula_family is not null and text_family is null").select("engine").distinct()
    math = layout.unique(blocks).where(F.col("kind").isin(*MATH_KINDS)).select("paper", F.col("id").alias("block"))
    stale = candidates.join(recognisers, "engine", "left_semi").join(math, ["paper", "block"], "left_semi").select("paper", "block", "seq").distinct()
    return candidates.dropDuplicates(["paper", "block", "seq"]).join(stale, ["paper", "block", "seq"], "left_anti")


def evidence_key(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper, block, evidence): identity of what a decision rests on, the block's box and its readings in order."""
    point = lambda c: F.coalesce(F.round(F.col(c) * 100).cast("long").cast("string"), F.lit("-"))
    box = layout.unique(blocks).select("paper", F.col("id").alias("block"), F.concat_ws(",", *map(point, ("x0", "y0", "x1", "y1"))).alias("box"))
    reading = F.concat(F.coalesce("engine", F.lit("")), F.lit("\x1f"), F.coalesce("content", F.lit("")))
    read = vote.current(candidates).groupBy("paper", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", reading.alias("r")))), lambda x: x["r"]), "\x1e").alias("read"))
    both = box.join(read, ["paper", "block"], "left")
    return both.select("paper", "block", F.left(F.sha2(F.concat("box", F.lit("\x1d"), F.coalesce("read", F.lit(""))), 256), F.lit(16)).alias("evidence"))


# ---------------------------------------------------------------- decisions


def reconcile(blocks: DataFrame, votes: DataFrame, candidates: DataFrame) -> DataFrame:
    """(paper, block, kind, status, value, rule) of every block that gets a decision.

    Formulas by vote, failed where nobody may vote; prose by where its text comes from; tables stay to be
    checked. ``votes`` is what ``vote.decide`` takes.
    """
    b = layout.unique(blocks).select("paper", F.col("id").alias("block"), "kind", F.get_json_object("extra", "$.text_source").alias("text_source"))
    math = b.where(F.col("kind").isin(*MATH_KINDS)).join(vote.decide(votes).select("paper", "block", "status", "value", "rule"), ["paper", "block"], "left")
    math = math.select("paper", "block", "kind", F.coalesce("status", F.lit("failed")).alias("status"), "value", F.coalesce("rule", F.lit("no_candidate")).alias("rule"))
    native = F.coalesce(F.col("text_source") == "text_layer", F.lit(False))
    prose = b.where(F.col("kind").isin(*PROSE_KINDS)).select(
        "paper", "block", "kind", F.when(native, "accepted").otherwise("unverified").alias("status"), F.lit(None).cast("string").alias("value"),
        F.when(native, "text_layer").otherwise(F.concat(F.lit("ocr_only:"), F.coalesce("text_source", F.lit("")))).alias("rule"))
    html = vote.current(candidates).where("format = 'html'").groupBy("paper", "block").agg(F.min_by(F.struct(F.col("content").alias("value")), F.struct("seq", "engine")).alias("h"))
    tables = b.where("kind = 'table'").join(html, ["paper", "block"], "left").select(
        "paper", "block", "kind", F.lit("unverified").alias("status"), F.col("h.value").alias("value"), F.when(F.col("h").isNotNull(), "table_structure_unchecked").otherwise("image_only").alias("rule"))
    return math.unionByName(prose).unionByName(tables)


def kept_answers(decisions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Decisions that were not made by the program and rest on the evidence that still holds: they stand."""
    d = vote.latest_decisions(decisions).where("by <> 'program'").select("paper", "block", "status", "value", "by", F.get_json_object("evidence", "$.input_hash").alias("input_hash"))
    return d.join(evidence, ["paper", "block"]).where("input_hash = evidence").select("paper", "block", "status", "value", "by")


def states(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper, block, kind, page, status, rule): every block with the decision that holds, or none."""
    d = vote.latest_decisions(decisions).select("paper", "block", "status", "rule", "value")
    return layout.unique(blocks).select("paper", F.col("id").alias("block"), "kind", "page").join(d, ["paper", "block"], "left").withColumn("status", F.coalesce("status", F.lit("none")))


def blocking(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Formulas that must be resolved before a paper is delivered."""
    return states(blocks, decisions).where(F.col("kind").isin(*MATH_KINDS) & ~is_final(F.col("status"))).select("paper", "block", "kind", "page", "status", F.coalesce("rule", F.lit("")).alias("rule"))


def export_gate(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper, pending, first, allowed): a paper goes out when nothing blocks it; the first five that do are named."""
    place = F.row_number().over(Window.partitionBy("paper").orderBy("page", "block"))
    # only the first of each page can be among the first five of a paper
    few = blocking(blocks, decisions).withColumn("on_page", F.row_number().over(Window.partitionBy("paper", "page").orderBy("block"))).where("on_page <= 5").withColumn("place", place).where("place <= 5")
    first = few.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), ",").alias("first"))
    all_ = layout.unique(blocks).select("paper").distinct()
    n = blocking(blocks, decisions).groupBy("paper").agg(F.count(F.lit(1)).alias("pending"))
    return all_.join(n, "paper", "left").join(first, "paper", "left").select("paper", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("first", F.lit("")).alias("first"), F.col("pending").isNull().alias("allowed"))


def batch_status(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper, decided, blocking, next): what is left to do; blocking is null before any decision exists."""
    s = states(blocks, decisions)
    n = s.groupBy("paper").agg(F.count_if(F.col("status") != "none").alias("decided"), F.count_if(F.col("kind").isin(*MATH_KINDS) & ~is_final(F.col("status"))).alias("open"))
    return n.select("paper", "decided", F.when(F.col("decided") > 0, F.col("open")).alias("blocking"), F.when(F.col("decided") == 0, "reconcile").when(F.col("open") > 0, "answer").otherwise("export").alias("next"))


# ---------------------------------------------------------------- answers


def tasks(blocks: DataFrame, decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(task_id, kind, page, engines, readings): one task for every formula that blocks, with the engines to choose from."""
    c = vote.current(candidates).where(F.col("content").rlike(r"\S")).groupBy("paper", "block").agg(F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"), F.count_distinct("content").alias("readings"))
    return blocking(blocks, decisions).join(c, ["paper", "block"], "left").select(F.concat_ws("/", "paper", "block").alias("task_id"), "kind", "page", F.coalesce("engines", F.lit("")).alias("engines"), F.coalesce("readings", F.lit(0)).alias("readings"))


def validated(answers: DataFrame, blocks: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(task_id, latex, reason): the accepted LaTeX of each answer, or the first reason against it.

    ``answers`` has (task_id, choice, latex, input_hash); the task id is cut at its first slash. Reasons are
    tried in one order: unknown task, evidence that has changed, left open, no LaTeX, unknown candidate,
    delimiters within, broken braces.
    """
    a = answers.withColumns({"paper": F.substring_index("task_id", "/", 1), "block": F.expr("substring(task_id, instr(task_id, '/') + 1)")})
    b = layout.unique(blocks).select("paper", F.col("id").alias("block"), F.lit(True).alias("known"))
    c = vote.current(candidates).select("paper", "block", F.col("engine").alias("choice"), F.col("content").alias("reading"), F.lit(True).alias("offered"))
    j = a.join(b, ["paper", "block"], "left").join(evidence, ["paper", "block"], "left").join(c, ["paper", "block", "choice"], "left")
    text = F.trim(F.when(F.col("choice") == ANSWER_CUSTOM, F.col("latex")).otherwise(F.col("reading")))
    bare = F.replace(text, F.lit("\\\\"), F.lit(""))
    count = lambda s: F.size(F.regexp_extract_all(bare, F.lit(rf"(?<!\\)\{s}"), F.lit(0)))
    custom = F.coalesce(F.col("choice") == ANSWER_CUSTOM, F.lit(False))
    reason = (
        F.when(F.col("known").isNull(), "unknown_task").when(~F.col("input_hash").eqNullSafe(F.col("evidence")), "stale_input_hash")
        .when(F.col("choice") == ANSWER_OPEN, "left_open").when(custom & F.coalesce(text == "", F.lit(True)), "custom_without_latex")
        .when(~custom & F.col("offered").isNull(), "unknown_candidate").when(bare.rlike(r"(?<!\\)\$|\\[()\[\]]"), "math_delimiters_in_latex")
        .when(count("{") != count("}"), "invalid_latex"))
    return j.select("task_id", "paper", "block", "choice", F.when(reason.isNull(), text).alias("latex"), reason.alias("reason"))


def applied(checked: DataFrame, decisions: DataFrame) -> DataFrame:
    """(paper, block, status, value, rule): the decisions that hold once accepted answers have been applied."""
    new = checked.where("reason is null").select("paper", "block", F.lit("resolved").alias("status"), F.col("latex").alias("value"), F.concat(F.lit("escalation:"), "choice").alias("rule"))
    old = vote.latest_decisions(decisions).select("paper", "block", "status", "value", "rule")
    return old.join(new.select("paper", "block"), ["paper", "block"], "left_anti").unionByName(new)


# ---------------------------------------------------------------- pages and boxes


def ocr_only_pages(pages: DataFrame) -> DataFrame:
    """Pages whose text layer can't be read."""
    status = F.col("text_layer.status")
    return pages.groupBy("paper", "page").agg(F.max(status).alias("status")).where(~F.coalesce(F.col("status").isin(*READABLE_LAYERS), F.lit(False)))


def evidence_windows(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Where a formula's evidence is looked for: a displayed one on its rows across the page, so that numbers
    come in; an inline one close around it."""
    b = layout.unique(blocks).where(F.col("kind").isin(*MATH_KINDS)).select("paper", "id", "page", "kind", "x0", "y0", "x1", "y1")
    p = pages.groupBy("paper", "page").agg(F.max("width").alias("width"))
    shown = F.col("kind") == "display_math"
    return b.join(p, ["paper", "page"], "left").select(
        "paper", "id", F.when(shown, F.lit(0.0)).otherwise(F.col("x0") - 1).alias("x0"), (F.col("y0") - F.when(shown, 2).otherwise(1)).alias("y0"),
        F.when(shown, F.col("width")).otherwise(F.col("x1") + 1).alias("x1"), (F.col("y1") + F.when(shown, 2).otherwise(1)).alias("y1"))


def crop_bounds(blocks: DataFrame, pages: DataFrame, scale: float = 3.0, pad: float = 2.0) -> DataFrame:
    """Pixels of each block's picture on its rendered page, whole and within the page; empty ones are left out."""
    b = layout.unique(blocks).select("paper", "id", "page", "x0", "y0", "x1", "y1")
    p = pages.groupBy("paper", "page").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    low = lambda c: F.greatest(F.lit(0), ((F.col(c) - pad) * scale).cast("int"))
    high = lambda c, size: F.least((F.col(size) * scale).cast("int"), ((F.col(c) + pad) * scale + 0.999).cast("int"))
    return b.join(p, ["paper", "page"]).select("paper", "id", low("x0").alias("left"), low("y0").alias("top"), high("x1", "width").alias("right"), high("y1", "height").alias("bottom")).where("right > left and bottom > top")


def inline_names(blocks: DataFrame) -> DataFrame:
    """Names of inline formulas: their parent's and a number in order of arrival."""
    b = layout.unique(blocks).where("kind = 'inline_math' and parent is not null")
    n = F.row_number().over(Window.partitionBy("paper", "parent").orderBy("seq", "id")) - 1
    return b.withColumn("n", n).select("paper", "id", F.format_string("%s.e%02d", "parent", "n").alias("name"))


def region_order(blocks: DataFrame) -> DataFrame:
    """Rank of each region on its page by order and arrival."""
    place = F.row_number().over(Window.partitionBy("paper", "page").orderBy(F.col("ord").asc_nulls_last(), "seq", "id")) - 1
    return layout.unique(blocks).select("paper", "page", "id", place.alias("rank"))


# ---------------------------------------------------------------- fonts

# Families of TeX fonts with their encoding and styles.
FONT_FAMILIES = (
    ("CMSY", "OMS", "calligraphic"), ("CMBSY", "OMS", "calligraphic,bold"), ("MSBM", "UMSB", "double_struck"), ("EUSM", "EUS", "script"),
    ("EUSB", "EUS", "script,bold"), ("RSFS", "RSFS", "script"), ("EUFM", "EUF", "fraktur"), ("EUFB", "EUF", "fraktur,bold"),
    ("CMMIB", "OML", "bold,italic"), ("CMMI", "OML", "italic"), ("CMBX", "OT1", "bold"))
OML_SYMBOLS = "ΓΔΘΛΞΠΣΥΦΨΩαβγδεζηθικλμνξπρστυφχψωϵϕϑϖϱς.,∂"
STYLES = ("bold", "calligraphic", "script", "double_struck", "fraktur")


def font_family() -> Column:
    """Upper-case family of a font: without subset mark and size."""
    return F.upper(F.regexp_replace(F.regexp_replace("font", r"^[A-Z]{6}\+", ""), r"\d+$", ""))


def font_table(glyphs: DataFrame) -> DataFrame:
    """(paper, page, span, ch, symbol, styles): what a known font family makes of a decoded glyph.

    The family table has eleven rows. Suspicious glyphs are not decoded: a code point does not stand for the
    slot of a font. Calligraphic, script and double-struck fonts hold capitals only.
    """
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else x for f, e, s in FONT_FAMILIES for x in (f, F.struct(F.lit(e).alias("encoding"), F.lit(s).alias("styles")))])
    g = glyphs.select("paper", "page", "span", "ch", "text", "suspicious_encoding", F.try_element_at(table, font_family()).alias("t")).where(F.col("t").isNotNull() & ~F.coalesce("suspicious_encoding", F.lit(False)) & (F.length("text") == 1))
    capital, letter = F.col("text").rlike("^[A-Z]$"), F.col("text").rlike(r"^[\p{L}\p{N}]$") | F.lit(OML_SYMBOLS).contains(F.col("text"))
    fits = F.when(F.col("t.encoding").isin("OMS", "UMSB", "EUS", "RSFS"), capital).when(F.col("t.encoding") == "EUF", F.col("text").rlike(r"^[\x00-\x7f]$")).otherwise(letter)
    return g.where(fits).select("paper", "page", "span", "ch", F.col("text").alias("symbol"), F.col("t.styles").alias("styles")).distinct()


# ---------------------------------------------------------------- what the text layer says of a formula


def in_formulas(glyphs: DataFrame, blocks: DataFrame, *carried: Column) -> DataFrame:
    """(paper, id, span, ch, carried...): visible glyphs whose centre lies in a formula's box."""
    cx, cy = center()
    g = unique_glyphs(glyphs).where(is_visible(False)).select(F.col("paper").alias("gp"), F.col("page").alias("gpage"), "span", "ch", cx.alias("cx"), cy.alias("cy"), *carried)
    names = [c for c in g.columns if c not in ("gp", "gpage", "cx", "cy")]
    b = boxes(blocks).where(F.col("b_kind").isin(*MATH_KINDS))
    inside = (F.col("gp") == F.col("paper")) & (F.col("gpage") == F.col("page")) & F.col("cx").between(F.col("b_x0") - PAD, F.col("b_x1") + PAD) & F.col("cy").between(F.col("b_y0") - PAD, F.col("b_y1") + PAD)
    return b.join(g, inside).select("paper", F.col("b_id").alias("id"), *names)


def is_extension_font() -> Column:
    """Fonts of large delimiters and operators, whose glyphs stand where they are drawn in pieces."""
    return F.coalesce(font_family().rlike("EX$") | font_family().isin("TEX_CM_MATHS_EXTENSION", "MATHEXTRA"), F.lit(False))


def geometry_reliable(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, reliable): whether a formula's glyphs are all known well enough to compare their places."""
    unmapped = F.coalesce(F.col("mapped_text"), F.lit("")) == ""
    doubtful = (F.coalesce("suspicious_encoding", F.lit(False)) | (F.coalesce("font", F.lit("")) == "")) & unmapped & ~is_extension_font()
    return in_formulas(glyphs, blocks, doubtful.alias("doubtful")).groupBy("paper", "id").agg((~F.bool_or("doubtful")).alias("reliable"))


def prose_mixed_in(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, source_text): formulas whose glyphs hold a citation of a figure or table."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "ch", "s"))), lambda x: x["s"]), "")
    return in_formulas(glyphs, blocks, symbol().alias("s")).groupBy("paper", "id").agg(text.alias("source_text")).where(F.col("source_text").rlike(r"(?:Fig(?:ure)?\.|Table)\s*\d"))


def style_counts(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, symbol, style, n): how many glyphs of a letter a formula shows in each style that LaTeX has a
    command for; a bold font counts as bold."""
    bold = F.array(F.when(F.col("font_flags").bitwiseAND(16) != 0, "bold"))
    styles = F.array_distinct(F.array_compact(F.concat(F.coalesce("mapped_styles", F.array().cast("array<string>")), bold)))
    g = in_formulas(glyphs, blocks, symbol().alias("symbol"), styles.alias("styles")).where(F.col("symbol").rlike(r"^\p{L}+$"))
    return g.select("paper", "id", "symbol", F.explode("styles").alias("style")).where(F.col("style").isin(*STYLES)).groupBy("paper", "id", "symbol", "style").agg(F.count(F.lit(1)).alias("n"))


def review(glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, id, reasons): formulas that someone has to look at, and why."""
    doubt = geometry_reliable(glyphs, blocks).where("not reliable").select("paper", "id", F.lit("unreliable_geometry").alias("reason"))
    prose = prose_mixed_in(glyphs, blocks).select("paper", "id", F.lit("prose_in_formula").alias("reason"))
    return doubt.unionByName(prose).groupBy("paper", "id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def math_runs(glyphs: DataFrame, factor: float = 1.0) -> DataFrame:
    """(paper, page, span, run, x0, y0, x1, y1): stretches of glyphs in math fonts on a line, with their boxes."""
    line = Window.partitionBy("paper", "page", "span").orderBy("x0", "ch")
    g = unique_glyphs(glyphs).where(is_visible() & is_math_font())
    broken = F.when(F.col("x0") - F.lag("x1").over(line) > factor * F.col("size_pt"), 1).otherwise(0)
    run = g.withColumn("b", broken).withColumn("run", F.sum("b").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("paper", "page", "span", "run").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def run_proposals(glyphs: DataFrame, blocks: DataFrame, least: float = 0.5) -> DataFrame:
    """(paper, page, span, run, id, iou): the inline formula that a layout engine proposed at a run, the one that
    overlaps it best; runs that none overlaps by ``least`` have no row."""
    p = boxes(blocks, "p_").where("p_kind = 'inline_math'").withColumnsRenamed({"paper": "pp", "page": "ppage"})
    meets = (F.col("paper") == F.col("pp")) & (F.col("page") == F.col("ppage")) & (F.col("x0") < F.col("p_x1")) & (F.col("p_x0") < F.col("x1")) & (F.col("y0") < F.col("p_y1")) & (F.col("p_y0") < F.col("y1"))
    j = math_runs(glyphs).join(p, meets)
    inter = (F.least("x1", "p_x1") - F.greatest("x0", "p_x0")) * (F.least("y1", "p_y1") - F.greatest("y0", "p_y0"))
    both = area() + area("p_x0", "p_y0", "p_x1", "p_y1") - inter
    best = j.withColumn("iou", F.when(both > 0, inter / both).otherwise(0.0)).where(F.col("iou") >= least)
    return best.groupBy("paper", "page", "span", "run").agg(F.max_by("p_id", F.struct("iou", -F.col("p_seq"), "p_id")).alias("id"), F.round(F.max("iou"), 6).alias("iou"))


def alignment(read: DataFrame, glyphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(paper, block, seq, symbol, status): whether each symbol of a reading stands in the text layer of its
    formula, and if one can be told from the others. ``read``: (paper, block, seq, symbol, n)."""
    seen = in_formulas(glyphs, blocks, symbol().alias("symbol")).groupBy("paper", F.col("id").alias("block"), "symbol").agg(F.count(F.lit(1)).alias("seen"))
    known = seen.select("paper", "block").distinct()
    j = read.join(known, ["paper", "block"], "left_semi").join(seen, ["paper", "block", "symbol"], "left")
    status = F.when(F.col("seen").isNull(), "not_in_text_layer").when((F.col("seen") == 1) & (F.col("n") == 1), "unique_symbol").otherwise("ambiguous")
    return j.select("paper", "block", "seq", "symbol", status.alias("status"))
