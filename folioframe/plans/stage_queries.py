"""Queries of the stages after recognition, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioframe.functions import udfs
from folioframe.operators import constraints, delivery, glyphs, layout, score, stages, vote
from folioframe.plans.registry import _B, _C, _D, _F, _G, _KIDS, _MARKDOWN, _NAME, _PLACE, _RANKED, _S, _SHOWN, _V, _VISIBLE, _VOTED, _scores, query

_MATH = "kind IN ('display_math', 'inline_math')"
_FINAL = "coalesce(status IN ('accepted', 'resolved'), false)"
_STATES = f"{_B}, {_D}, st AS (SELECT b.paper, b.id AS block, kind, page, coalesce(status, 'none') AS status, rule FROM b LEFT JOIN d ON d.paper = b.paper AND d.block = b.id)"
_POOL = _V.replace("FROM f WHERE", "FROM f WHERE pref IS NOT NULL AND")
_PROSE = ", ".join(f"'{k}'" for k in stages.PROSE_KINDS)
_P = "pg AS (SELECT paper, page, max(width) AS width, max(height) AS height, max(text_layer.status) AS status, max(text_layer.unassigned_glyphs) AS unassigned FROM pages GROUP BY ALL)"


def _pool(t):
    return stages.pool(t("candidates"), t("engines")).withColumn("key", vote.simple_key(F.col("content"))).withColumn("rejected", F.lit(False))


# ---------------------------------------------------------------- decisions


_RECONCILED = f"""{_C}, {_F}, {_POOL}, {_VOTED}, {_B}, h AS (SELECT paper, block, min_by(content, (seq, engine)) AS value FROM c WHERE format = 'html' AND content IS NOT NULL GROUP BY ALL),
h2 AS (SELECT DISTINCT paper, block FROM c WHERE format = 'html'),
r AS (SELECT b.paper, b.id AS block, kind, coalesce(v.status, 'failed') AS status, v.value, coalesce(v.rule, 'no_candidate') AS rule FROM b LEFT JOIN v ON v.paper = b.paper AND v.block = b.id WHERE {_MATH}
UNION ALL SELECT paper, id, kind, CASE WHEN json_extract_string(extra, '$.text_source') = 'text_layer' THEN 'accepted' ELSE 'unverified' END, NULL,
CASE WHEN json_extract_string(extra, '$.text_source') = 'text_layer' THEN 'text_layer' ELSE 'ocr_only:' || coalesce(json_extract_string(extra, '$.text_source'), '') END FROM b WHERE kind IN ({_PROSE})
UNION ALL SELECT b.paper, b.id, kind, 'unverified', h.value, CASE WHEN h2.paper IS NOT NULL THEN 'table_structure_unchecked' ELSE 'image_only' END
FROM b LEFT JOIN h ON h.paper = b.paper AND h.block = b.id LEFT JOIN h2 ON h2.paper = b.paper AND h2.block = b.id WHERE kind = 'table')"""


@query(f"WITH {_RECONCILED} SELECT * FROM r")
def reconcile_blocks(t):
    """The decision of every block that gets one, with the normal form that SQL can express."""
    return stages.reconcile(t("blocks"), _pool(t), t("candidates").where("format <> 'html' or content is not null"))


@query(f"WITH {_RECONCILED} SELECT status, CAST(count(*) AS BIGINT) AS blocks FROM r GROUP BY ALL")
def reconcile_status(t):
    return reconcile_blocks(t).groupBy("status").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"WITH {_RECONCILED} SELECT paper, block, kind FROM r WHERE {_MATH} AND NOT {_FINAL}")
def fallback_items(t):
    """Formulas that go to the engines of last resort: those that the vote leaves open."""
    r = reconcile_blocks(t)
    return r.where(F.col("kind").isin(*stages.MATH_KINDS) & ~stages.is_final(F.col("status"))).select("paper", "block", "kind")


@query(f"WITH {_C}, {_F}, {_POOL} SELECT paper, block, engine, family, CAST(pref AS INT) AS pref FROM k")
def voting_pool(t):
    return stages.pool(t("candidates"), t("engines")).select("paper", "block", "engine", "family", F.col("pref").cast("int").alias("pref"))


@query(f"WITH {_B}, {_C} SELECT paper, block, seq FROM u WHERE NOT (coalesce(engine IN (SELECT engine FROM engines WHERE formula_family IS NOT NULL AND text_family IS NULL), false) AND (paper, block) IN (SELECT (paper, id) FROM b WHERE {_MATH}))")
def candidates_without_stale(t):
    return stages.without_stale(t("candidates"), t("blocks"), t("engines")).select("paper", "block", "seq")


_BOX = " || ',' || ".join(f"coalesce(CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR), '-')" for c in ("x0", "y0", "x1", "y1"))
_EVIDENCE = f"""ev AS (SELECT b.paper, b.id AS block, left(sha256({_BOX} || chr(29) || coalesce(read, '')), 16) AS evidence FROM b LEFT JOIN
(SELECT paper, block, string_agg(coalesce(engine, '') || chr(31) || coalesce(content, ''), chr(30) ORDER BY seq, coalesce(engine, '') || chr(31) || coalesce(content, '')) AS read FROM c GROUP BY ALL) AS x ON x.paper = b.paper AND x.block = b.id)"""


@query(f"WITH {_B}, {_C}, {_EVIDENCE} SELECT paper, block, evidence FROM ev")
def evidence_hash(t):
    return stages.evidence_key(t("blocks"), t("candidates"))


@query(f"""WITH {_B}, {_C}, {_D}, {_EVIDENCE} SELECT paper, block, status, value, "by" FROM d JOIN ev USING (paper, block) WHERE "by" <> 'program' AND json_extract_string(d.evidence, '$.input_hash') = ev.evidence""")
def kept_answers(t):
    return stages.kept_answers(t("decisions"), stages.evidence_key(t("blocks"), t("candidates")))


@query(f"WITH {_STATES} SELECT kind, status, CAST(count(*) AS BIGINT) AS blocks FROM st GROUP BY ALL")
def status_report(t):
    """How many blocks of each kind have each status."""
    return stages.states(t("blocks"), t("decisions")).groupBy("kind", "status").agg(F.count(F.lit(1)).alias("blocks"))


@query(f"WITH {_STATES} SELECT paper, block, kind, page, status, coalesce(rule, '') AS rule FROM st WHERE {_MATH} AND NOT {_FINAL}")
def blocking_items(t):
    return stages.blocking(t("blocks"), t("decisions"))


@query(f"""WITH {_STATES}, o AS (SELECT *, row_number() OVER (PARTITION BY paper ORDER BY page, block) AS n FROM st WHERE {_MATH} AND NOT {_FINAL})
SELECT p.paper, CAST(count(o.block) AS BIGINT) AS pending, coalesce(string_agg(o.block, ',' ORDER BY n) FILTER (n <= 5), '') AS first, count(o.block) = 0 AS allowed
FROM (SELECT DISTINCT paper FROM b) AS p LEFT JOIN o USING (paper) GROUP BY ALL""")
def export_gate(t):
    return stages.export_gate(t("blocks"), t("decisions"))


@query(f"""WITH {_STATES}, n AS (SELECT paper, CAST(count(*) FILTER (status <> 'none') AS BIGINT) AS decided, CAST(count(*) FILTER ({_MATH} AND NOT {_FINAL}) AS BIGINT) AS open FROM st GROUP BY ALL)
SELECT paper, decided, CASE WHEN decided > 0 THEN open END AS blocking, CASE WHEN decided = 0 THEN 'reconcile' WHEN open > 0 THEN 'answer' ELSE 'export' END AS next FROM n""")
def batch_status(t):
    return stages.batch_status(t("blocks"), t("decisions"))


# ---------------------------------------------------------------- answers


@query(f"""WITH {_STATES}, {_C}, x AS (SELECT paper, block, string_agg(DISTINCT engine, ',' ORDER BY engine) AS engines, count(DISTINCT content) AS readings FROM c WHERE regexp_matches(content, '\\S') GROUP BY ALL)
SELECT st.paper || '/' || st.block AS task_id, kind, page, coalesce(engines, '') AS engines, CAST(coalesce(readings, 0) AS BIGINT) AS readings FROM st LEFT JOIN x USING (paper, block) WHERE {_MATH} AND NOT {_FINAL}""")
def task_export(t):
    return stages.tasks(t("blocks"), t("decisions"), t("candidates"))


# answers as they may come: of each formula's decision by its state, some to blocks that are not there
_ANSWERS = f"""a AS (SELECT d.paper || '/' || d.block || CASE WHEN status = 'failed' THEN 'x' ELSE '' END AS task_id, CASE status WHEN 'conflict' THEN 'open' WHEN 'accepted' THEN 'quillnet_m' ELSE 'custom' END AS choice, value AS latex,
CASE WHEN status = 'unverified' THEN 'old' ELSE ev.evidence END AS input_hash FROM d JOIN b ON b.paper = d.paper AND b.id = d.block AND {_MATH} LEFT JOIN ev ON ev.paper = d.paper AND ev.block = d.block),
j AS (SELECT a.*, split_part(task_id, '/', 1) AS paper, substr(task_id, strpos(task_id, '/') + 1) AS block FROM a),
m AS (SELECT j.*, b.id IS NOT NULL AS known, ev.evidence, c.engine IS NOT NULL AS offered, trim(CASE WHEN choice = 'custom' THEN latex ELSE c.content END, ' ') AS txt FROM j LEFT JOIN b ON b.paper = j.paper AND b.id = j.block
LEFT JOIN ev ON ev.paper = j.paper AND ev.block = j.block LEFT JOIN c ON c.paper = j.paper AND c.block = j.block AND c.engine = j.choice),
n AS (SELECT *, replace(txt, '\\\\', '') AS bare FROM m),
checked AS (SELECT task_id, paper, block, choice, txt, CASE WHEN NOT known THEN 'unknown_task' WHEN input_hash IS DISTINCT FROM evidence THEN 'stale_input_hash' WHEN choice = 'open' THEN 'left_open' WHEN choice = 'custom' AND coalesce(txt, '') = '' THEN 'custom_without_latex'
WHEN choice <> 'custom' AND NOT offered THEN 'unknown_candidate' WHEN regexp_matches(bare, '(^|[^\\\\])\\$|\\\\[()\\[\\]]') THEN 'math_delimiters_in_latex'
WHEN len(regexp_extract_all(bare, '\\{{')) - len(regexp_extract_all(bare, '\\\\\\{{')) <> len(regexp_extract_all(bare, '\\}}')) - len(regexp_extract_all(bare, '\\\\\\}}')) THEN 'invalid_latex' END AS reason FROM n)"""


def _checked(t):
    b = layout.unique(t("blocks")).where(F.col("kind").isin(*stages.MATH_KINDS)).select("paper", F.col("id").alias("block"))
    evidence = stages.evidence_key(t("blocks"), t("candidates"))
    d = vote.latest_decisions(t("decisions")).select("paper", "block", "status", "value").join(b, ["paper", "block"]).join(evidence, ["paper", "block"], "left")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    answers = d.select(
        F.concat("paper", F.lit("/"), "block", F.when(failed, "x").otherwise("")).alias("task_id"), F.when(F.col("status") == "conflict", "open").when(F.col("status") == "accepted", "quillnet_m").otherwise("custom").alias("choice"),
        F.col("value").alias("latex"), F.when(F.col("status") == "unverified", "old").otherwise(F.col("evidence")).alias("input_hash"))
    return stages.validated(answers, t("blocks"), t("candidates"), evidence)


@query(f"WITH {_B}, {_C}, {_D}, {_EVIDENCE}, {_ANSWERS} SELECT task_id, choice, CASE WHEN reason IS NULL THEN txt END AS latex, reason FROM checked")
def answer_validation(t):
    return _checked(t).select("task_id", "choice", "latex", "reason")


@query(f"""WITH {_B}, {_C}, {_D}, {_EVIDENCE}, {_ANSWERS}, good AS (SELECT * FROM checked WHERE reason IS NULL)
SELECT paper, block, status, value, rule FROM d WHERE (paper, block) NOT IN (SELECT (paper, block) FROM good) UNION ALL SELECT paper, block, 'resolved', txt, 'escalation:' || choice FROM good""")
def apply_answers(t):
    return stages.applied(_checked(t), t("decisions"))


# ---------------------------------------------------------------- pages, boxes, fonts


@query(f"""WITH {_G}, n AS (SELECT paper, page, count(*) FILTER ({_SHOWN}) AS n_visible, count(*) FILTER (NOT ({_SHOWN})) AS n_invisible, count(*) FILTER ({_SHOWN} AND suspicious_encoding) AS n_suspicious FROM g GROUP BY ALL)
SELECT CASE WHEN n_visible >= 20 THEN CASE WHEN n_suspicious > 0.05 * n_visible THEN 'degraded' ELSE 'good' END WHEN n_invisible >= 20 THEN 'ocr_layer' ELSE 'none' END AS status, CAST(count(*) AS BIGINT) AS pages FROM n GROUP BY ALL""")
def text_layer_histogram(t):
    return glyphs.text_layer_status(t("glyphs")).groupBy("status").agg(F.count(F.lit(1)).alias("pages"))


@query(f"WITH {_P} SELECT paper, page, status FROM pg WHERE NOT coalesce(status IN ('good', 'degraded'), false)")
def ocr_only_pages(t):
    return stages.ocr_only_pages(t("pages"))


@query(f"WITH {_P} SELECT paper, page, CAST(unassigned AS INT) AS unassigned FROM pg WHERE unassigned > 0")
def pages_with_unassigned(t):
    return t("pages").groupBy("paper", "page").agg(F.max("text_layer.unassigned_glyphs").alias("unassigned")).where("unassigned > 0")


@query(f"""WITH {_B}, {_P} SELECT b.paper, b.id, CASE WHEN kind = 'display_math' THEN 0.0::DOUBLE ELSE x0 - 1 END AS x0, y0 - CASE WHEN kind = 'display_math' THEN 2 ELSE 1 END AS y0, CASE WHEN kind = 'display_math' THEN width ELSE x1 + 1 END AS x1,
y1 + CASE WHEN kind = 'display_math' THEN 2 ELSE 1 END AS y1 FROM b LEFT JOIN pg ON pg.paper = b.paper AND pg.page = b.page WHERE {_MATH}""")
def evidence_windows(t):
    return stages.evidence_windows(t("blocks"), t("pages"))


@query(f"""WITH {_B}, {_P}, k AS (SELECT b.paper, b.id, greatest(0, CAST(trunc((x0 - 2) * 3) AS INT)) AS "left", greatest(0, CAST(trunc((y0 - 2) * 3) AS INT)) AS top, least(CAST(trunc(width * 3) AS INT), CAST(trunc((x1 + 2) * 3 + 0.999) AS INT)) AS "right",
least(CAST(trunc(height * 3) AS INT), CAST(trunc((y1 + 2) * 3 + 0.999) AS INT)) AS bottom FROM b JOIN pg ON pg.paper = b.paper AND pg.page = b.page) SELECT * FROM k WHERE "right" > "left" AND bottom > top""")
def crop_bounds(t):
    return stages.crop_bounds(t("blocks"), t("pages"))


@query(f"WITH {_B} SELECT paper, id, printf('%s.e%02d', parent, row_number() OVER (PARTITION BY paper, parent ORDER BY seq, id) - 1) AS name FROM b WHERE kind = 'inline_math' AND parent IS NOT NULL")
def inline_names(t):
    return stages.inline_names(t("blocks"))


@query(f"WITH {_B} SELECT paper, page, id, CAST(row_number() OVER (PARTITION BY paper, page ORDER BY ord NULLS LAST, seq, id) - 1 AS INT) AS rank FROM b")
def region_order(t):
    return stages.region_order(t("blocks"))


_FAMILIES = ", ".join(f"('{f}', '{e}', '{s}')" for f, e, s in stages.FONT_FAMILIES)


@query(f"""WITH {_G}, fam(family, encoding, styles) AS (VALUES {_FAMILIES}), x AS (SELECT g.*, encoding, styles FROM g JOIN fam ON family = upper(regexp_replace({_NAME}, '[0-9]+$', '')))
SELECT DISTINCT paper, page, span, ch, text AS symbol, styles FROM x WHERE NOT coalesce(suspicious_encoding, false) AND length(text) = 1
AND CASE WHEN encoding IN ('OMS', 'UMSB', 'EUS', 'RSFS') THEN regexp_full_match(text, '[A-Z]') WHEN encoding = 'EUF' THEN unicode(text) < 128 ELSE regexp_full_match(text, '[\\p{{L}}\\p{{N}}]') OR contains('{stages.OML_SYMBOLS}', text) END""")
def font_table(t):
    return stages.font_table(t("glyphs"))


@query("SELECT paper, CAST(count(DISTINCT sha256) AS BIGINT) AS files FROM papers WHERE paper IS NOT NULL GROUP BY ALL HAVING count(DISTINCT sha256) > 1")
def key_conflicts(t):
    """Keys under which different files stand; such inputs can't be opened together."""
    return t("papers").where("paper is not null").groupBy("paper").agg(F.count_distinct("sha256").alias("files")).where("files > 1")


@query("""WITH m AS (SELECT DISTINCT ON (paper, block, seq) engine, CAST(json_extract_string(meta, '$.seconds') AS DOUBLE) AS s FROM candidates)
SELECT engine, CAST(count(s) AS BIGINT) AS timed, round(max(s), 6) AS longest, CAST(sum(CAST(round(s * 1000) AS BIGINT)) AS BIGINT) AS total_ms FROM m GROUP BY ALL""")
def engine_seconds(t):
    """How long each engine took for a reading, as far as its meta says."""
    s = F.get_json_object("meta", "$.seconds").cast("double")
    m = t("candidates").dropDuplicates(["paper", "block", "seq"]).select("engine", s.alias("s"))
    return m.groupBy("engine").agg(F.count("s").alias("timed"), F.round(F.max("s"), 6).alias("longest"), F.sum(F.round(F.col("s") * 1000).cast("long")).alias("total_ms"))


@query(f"""WITH {_G}, f AS (SELECT paper, page, span, ch, regexp_matches({_NAME}, '(?i)(MI[0-9]|SY[0-9]|EX[0-9]|math)') AS hit FROM g), q AS (SELECT DISTINCT paper, page, span, ch FROM glyphs WHERE in_target),
l AS (SELECT q.paper, q.page, q.span, count(*) AS n, count(*) FILTER (hit) AS hits FROM q LEFT JOIN f USING (paper, page, span, ch) GROUP BY ALL)
SELECT CASE WHEN hits = n THEN 'exact' WHEN hits = 0 THEN 'missed' ELSE 'partial' END AS outcome, CAST(count(*) AS BIGINT) AS lines FROM l GROUP BY ALL""")
def inline_outcomes(t):
    """Lines with target glyphs: are all of them in math fonts, none, or some."""
    g = glyphs.unique(t("glyphs")).where("in_target").groupBy("paper", "page", "span").agg(F.count(F.lit(1)).alias("n"), F.count_if(glyphs.is_math_font()).alias("hits"))
    return g.select(F.when(F.col("hits") == F.col("n"), "exact").when(F.col("hits") == 0, "missed").otherwise("partial").alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("lines"))


@query(f"WITH {_B} SELECT paper, id, page, kind, text, CAST(level AS INT) AS level FROM b")
def document_round_trip(t):
    """Blocks through their JSON form and back."""
    b = layout.unique(t("blocks")).select("paper", "id", "page", "kind", "text", "level")
    back = F.from_json(F.to_json(F.struct(*b.columns)), "paper string, id string, page int, kind string, text string, level int")
    return b.select(back.alias("r")).select("r.*")


@query("""WITH n AS (SELECT DISTINCT o_orderkey % 63999 AS n FROM orders) SELECT n, round(((n + 1) // 1600 % 40 + 1) / 41, 6) AS r, round(((n + 1) // 40 % 40 + 1) / 41, 6) AS g,
round(((n + 1) % 40 + 1) / 41, 6) AS b, n AS decoded FROM n""")
def color_codec_roundtrip(t):
    """Numbers to colours and back; SQL computes the channels on its own."""
    from folioframe.functions import colour

    n = t("orders").select((F.col("o_orderkey") % 63999).alias("n")).distinct().withColumn("c", colour.encode(F.col("n")))
    return n.select("n", *[F.round(f"c.{k}", 6).alias(k) for k in "rgb"], colour.decode(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("decoded"))


# ---------------------------------------------------------------- text and delivery


@query()
def engine_text(t):
    """Prose as engines read it, with a slot for every formula."""
    return delivery.engine_text(t("blocks"), t("candidates")).select("paper", "id", "text", F.array_join("formulas", "|").alias("formulas"), "source")


@query()
def text_stage(t):
    """Prose of every block from the text layer where it can be read, else from an engine."""
    return delivery.text_stage(t("blocks"), t("glyphs"), t("candidates")).select("paper", "id", "text", F.array_join("formulas", "|").alias("formulas"), "source")


@query()
def inline_children(t):
    """Every slot of the prose as a formula of its own, named after its block."""
    return delivery.inline_children(delivery.text_stage(t("blocks"), t("glyphs"), t("candidates")))


@query(f"""WITH {_STATES}, {_PLACE}, {_RANKED}, {_KIDS}, {_MARKDOWN} SELECT ranked.paper, rank, ranked.id, printf('<!-- %s p%d %s -->', ranked.id, st.page + 1, st.kind) || chr(10) || markdown
|| CASE WHEN st.kind = 'display_math' AND NOT {_FINAL} THEN printf('<!--unresolved %s-->', ranked.id) ELSE '' END AS markdown
FROM ranked JOIN md ON md.paper = ranked.paper AND md.id = ranked.id JOIN st ON st.paper = ranked.paper AND st.block = ranked.id""")
def working_markdown(t):
    return delivery.working_markdown(t("blocks"), t("decisions"))


@query(f"""WITH {_B}, {_PLACE} SELECT paper, '---' || chr(10) || 'title: ' || to_json(title) || chr(10) || '---' || chr(10) AS front FROM
(SELECT paper, arg_min(text, (page, place, seq, id)) AS title FROM p WHERE kind = 'title' AND text IS NOT NULL GROUP BY ALL)""")
def front_matter(t):
    return delivery.front_matter(t("blocks"))


@query()
def display_latex(t):
    numbers = constraints.number_association(t("glyphs"), t("blocks"))
    return delivery.display_latex(t("blocks"), t("decisions"), numbers)


@query()
def equation_patches(t):
    """Each reading of a displayed formula as a patch of the decided one: what it would become, or why it may not."""
    d = vote.latest_decisions(t("decisions")).where("value is not null").select("paper", "block", "value")
    b = layout.unique(t("blocks")).where("kind = 'display_math'").select("paper", F.col("id").alias("block"))
    c = vote.current(t("candidates")).where("format = 'latex' and content is not null").select("paper", "block", "engine", "content")
    return c.join(b, ["paper", "block"]).join(d, ["paper", "block"]).select("paper", "block", "engine", udfs.patch("value", "content").alias("p")).select("paper", "block", "engine", "p.*")


@query()
def matrix_checks(t):
    """Rows of each reading's matrix against the baselines of the text layer."""
    return constraints.matrix_checks(t("glyphs"), t("blocks"), t("candidates").dropDuplicates(["paper", "block", "seq"]).where("content like '%matrix%' or content like '%array%'").select("paper", "block", "seq", "content"))


# ---------------------------------------------------------------- what the text layer says of a formula

_FAMILY = f"upper(regexp_replace({_NAME}, '[0-9]+$', ''))"
_IN = f"""g2 AS (SELECT DISTINCT paper, page, span, ch, text, font, font_flags, mapped_text, mapped_styles, suspicious_encoding, x0, y0, x1, y1 FROM glyphs WHERE {_SHOWN}),
fg AS (SELECT b.paper, b.id, span, ch, coalesce(nullif(mapped_text, ''), g2.text) AS symbol, font, font_flags, mapped_text, mapped_styles, suspicious_encoding FROM b JOIN g2 ON g2.paper = b.paper AND g2.page = b.page
AND (g2.x0 + g2.x1) / 2 BETWEEN b.x0 - 1 AND b.x1 + 1 AND (g2.y0 + g2.y1) / 2 BETWEEN b.y0 - 1 AND b.y1 + 1 WHERE {_MATH}),
rel AS (SELECT paper, id, NOT bool_or((coalesce(suspicious_encoding, false) OR coalesce(font, '') = '') AND coalesce(mapped_text, '') = ''
AND NOT coalesce(ends_with({_FAMILY}, 'EX') OR {_FAMILY} IN ('TEX_CM_MATHS_EXTENSION', 'MATHEXTRA'), false)) AS reliable FROM fg GROUP BY ALL),
mix AS (SELECT paper, id, string_agg(symbol, '' ORDER BY span, ch) AS source_text FROM fg GROUP BY ALL HAVING regexp_matches(string_agg(symbol, '' ORDER BY span, ch), '(Fig(ure)?\\.|Table)\\s*[0-9]'))"""


@query(f"WITH {_B}, {_IN} SELECT * FROM rel")
def geometry_reliable(t):
    return stages.geometry_reliable(t("glyphs"), t("blocks"))


@query(f"WITH {_B}, {_IN} SELECT * FROM mix")
def prose_in_formulas(t):
    return stages.prose_mixed_in(t("glyphs"), t("blocks"))


@query(f"""WITH {_B}, {_IN}, s AS (SELECT paper, id, symbol, unnest(list_distinct(list_concat(coalesce(mapped_styles, []), CASE WHEN font_flags & 16 <> 0 THEN ['bold'] ELSE [] END))) AS style FROM fg WHERE regexp_full_match(symbol, '\\p{{L}}+'))
SELECT paper, id, symbol, style, CAST(count(*) AS BIGINT) AS n FROM s WHERE style IN ({", ".join(f"'{s}'" for s in stages.STYLES)}) GROUP BY ALL""")
def font_style_counts(t):
    return stages.style_counts(t("glyphs"), t("blocks"))


@query(f"""WITH {_B}, {_IN}, r AS (SELECT paper, id, 'unreliable_geometry' AS reason FROM rel WHERE NOT reliable UNION ALL SELECT paper, id, 'prose_in_formula' FROM mix)
SELECT paper, id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM r GROUP BY ALL""")
def formulas_to_review(t):
    return stages.review(t("glyphs"), t("blocks"))


@query(f"""WITH {_G}, {_B}, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > size_pt THEN 1 ELSE 0 END AS b FROM g WHERE {_VISIBLE} AND regexp_matches({_NAME}, '(?i)(MI[0-9]|SY[0-9]|EX[0-9]|math)') WINDOW w AS (PARTITION BY paper, page, span ORDER BY x0, ch)),
n AS (SELECT *, sum(b) OVER (PARTITION BY paper, page, span ORDER BY x0, ch ROWS UNBOUNDED PRECEDING) AS run FROM m),
r AS (SELECT paper, page, span, CAST(run AS BIGINT) AS run, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM n GROUP BY paper, page, span, run),
j AS (SELECT r.*, b.id, b.seq, (least(r.x1, b.x1) - greatest(r.x0, b.x0)) * (least(r.y1, b.y1) - greatest(r.y0, b.y0)) AS w, (r.x1 - r.x0) * (r.y1 - r.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS s
FROM r JOIN b ON b.paper = r.paper AND b.page = r.page AND b.kind = 'inline_math' AND r.x0 < b.x1 AND b.x0 < r.x1 AND r.y0 < b.y1 AND b.y0 < r.y1),
k AS (SELECT *, w / (s - w) AS iou FROM j WHERE w / (s - w) >= 0.5)
SELECT paper, page, span, run, arg_max(id, (iou, -seq, id)) AS id, round(max(iou), 6) AS iou FROM k GROUP BY ALL""")
def run_proposals(t):
    return stages.run_proposals(t("glyphs"), t("blocks"))


@query()
def glyph_alignment(t):
    """Symbols of the readings in the text layer of their formula."""
    c = t("candidates").dropDuplicates(["paper", "block", "seq"]).where("format = 'latex' and content is not null").select("paper", "block", "seq", "content")
    return stages.alignment(constraints.symbol_counts(c), t("glyphs"), t("blocks"))


_BENCH = f"""{_S}, gold AS (SELECT count(*) AS n FROM d JOIN bk USING (paper, block) WHERE kind IN ('display_math', 'inline_math')),
q AS (SELECT engine, n, count(*) AS answered, count(*) FILTER (key = '') AS empty, count(*) FILTER (correct) AS correct FROM s, gold GROUP BY ALL)"""


def _benchmark(t):
    d = t("decisions").where("value is not null and status in ('accepted', 'resolved')").select("paper", "block")
    b = layout.unique(t("blocks")).where(F.col("kind").isin(*stages.MATH_KINDS)).select("paper", F.col("id").alias("block"))
    return score.benchmark(_scores(t), d.join(b, ["paper", "block"], "left_semi"))


@query(f"WITH {_BENCH} SELECT engine, CAST(n AS BIGINT) AS n, CAST(answered AS BIGINT) AS answered, CAST(empty AS BIGINT) AS empty, CAST(correct AS BIGINT) AS correct, CAST(n - answered AS BIGINT) AS missing FROM q")
def formula_benchmark(t):
    """Every engine against all decided formulas; what it did not answer counts as missing."""
    return _benchmark(t)


@query(f"WITH {_BENCH} SELECT engine, printf('%-24s %8d %8d %8d', engine, n, answered, correct) AS line FROM q")
def benchmark_table(t):
    return score.table(_benchmark(t), "engine", "n", "answered", "correct")
