"""Every query of the library by name, with its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.functions import udfs
from folioframe.operators import constraints, glyphs, layout, score, spatial, text, vote
from folioframe.session import durable, read_table
from folioframe.sources import models, regions

_Q: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        _Q[f.__name__] = lambda spark, directory: f(lambda name: read_table(spark, directory, name))
        if sql:
            _SQL[f.__name__] = sql
        return f
    return put


def queries() -> dict:
    from folioframe.plans import stage_queries  # noqa: F401  (registers its own)

    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    from folioframe.plans import stage_queries  # noqa: F401

    return dict(_SQL)


# common SQL parts
_G = "g AS (SELECT DISTINCT paper, page, span, ch, text, font, font_xref, glyph_id, size_pt, x0, y0, x1, y1, ox, oy, render_type, opacity, suspicious_encoding, mapped_text FROM glyphs)"
_B = "b AS (SELECT DISTINCT ON (paper, id) * FROM blocks)"
_SHOWN = "render_type <> 3 AND opacity > 0"
_VISIBLE = _SHOWN + " AND NOT regexp_full_match(text, '\\s*')"
_NAME = "regexp_replace(font, '^[A-Z]{6}\\+', '')"
_KINDS = ", ".join(f"'{k}'" for k in spatial.CLAIMING_KINDS)
_PROSE = ", ".join(f"'{k}'" for k in spatial.PROSE_KINDS)


# ---------------------------------------------------------------- glyphs


@query(f"WITH {_G} SELECT paper, page, CAST(count(*) AS BIGINT) AS visible FROM g WHERE {_VISIBLE} GROUP BY ALL")
def visible_filter(t):
    return glyphs.unique(t("glyphs")).where(glyphs.is_visible()).groupBy("paper", "page").agg(F.count(F.lit(1)).alias("visible"))


@query(f"""WITH {_G}, n AS (SELECT paper, page, count(*) FILTER ({_SHOWN}) AS n_visible, count(*) FILTER (NOT ({_SHOWN})) AS n_invisible, count(*) FILTER ({_SHOWN} AND suspicious_encoding) AS n_suspicious FROM g GROUP BY ALL)
SELECT *, CASE WHEN n_visible >= 20 THEN CASE WHEN n_suspicious > 0.05 * n_visible THEN 'degraded' ELSE 'good' END WHEN n_invisible >= 20 THEN 'ocr_layer' ELSE 'none' END AS status FROM n""")
def text_layer_status(t):
    return glyphs.text_layer_status(t("glyphs"))


@query(f"""WITH {_G}, n AS (SELECT paper, page, font, count(*) AS n, min(span * 100000 + ch) AS f FROM g WHERE {_SHOWN} GROUP BY ALL)
SELECT paper, page, arg_max(font, n * 1000000000000 - f) AS font, CAST(max(n) AS BIGINT) AS n FROM n GROUP BY ALL""")
def body_font(t):
    return glyphs.most_common(t("glyphs"), F.col("font"), "font")


@query(f"""WITH {_G}, n AS (SELECT paper, page, round(size_pt, 1) AS size, count(*) AS n, min(span * 100000 + ch) AS f FROM g WHERE {_SHOWN} GROUP BY ALL)
SELECT paper, page, arg_max(size, n * 1000000000000 - f) AS size, CAST(max(n) AS BIGINT) AS n FROM n GROUP BY ALL""")
def body_size(t):
    return glyphs.most_common(t("glyphs"), F.round("size_pt", 1), "size")


@query(f"WITH {_G} SELECT {_NAME} AS name, regexp_matches({_NAME}, '(?i)(MI[0-9]|SY[0-9]|EX[0-9]|math)') AS math, CAST(count(*) AS BIGINT) AS glyphs FROM g GROUP BY ALL")
def math_font_flags(t):
    return glyphs.unique(t("glyphs")).select(glyphs.font_name().alias("name"), glyphs.is_math_font().alias("math")).groupBy("name", "math").agg(F.count(F.lit(1)).alias("glyphs"))


@query(f"WITH {_G} SELECT coalesce(nullif(mapped_text, ''), text) AS symbol, CAST(count(*) AS BIGINT) AS n FROM g WHERE {_SHOWN} GROUP BY ALL")
def symbol_frequencies(t):
    return glyphs.unique(t("glyphs")).where(glyphs.is_visible(False)).groupBy(glyphs.symbol().alias("symbol")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_G}, m AS (SELECT *, CASE WHEN x0 - lag(x1) OVER w > size_pt THEN 1 ELSE 0 END AS b FROM g WHERE {_VISIBLE} WINDOW w AS (PARTITION BY paper, page, span ORDER BY x0, ch)),
r AS (SELECT *, sum(b) OVER (PARTITION BY paper, page, span ORDER BY x0, ch ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT paper, page, span, CAST(island AS BIGINT) AS island, CAST(count(*) AS BIGINT) AS glyphs, min(x0) AS x0, max(x1) AS x1 FROM r GROUP BY paper, page, span, island""")
def gap_islands(t):
    return glyphs.gap_islands(t("glyphs"))


@query(f"""WITH {_G} SELECT paper, font_xref, glyph_id, CAST(count(DISTINCT mapped_text) AS BIGINT) AS texts, CAST(count(*) AS BIGINT) AS glyphs FROM g
WHERE mapped_text IS NOT NULL AND font_xref IS NOT NULL GROUP BY ALL HAVING count(DISTINCT mapped_text) > 1""")
def mapping_conflicts(t):
    return constraints.mapping_conflicts(t("glyphs"))


@query(f"""WITH {_G}, c AS (SELECT paper, font_xref, glyph_id, max(text) AS confirmed FROM g WHERE NOT suspicious_encoding GROUP BY ALL)
SELECT g.paper, page, span, ch, coalesce(confirmed, nullif(mapped_text, ''), text) AS symbol, CASE WHEN confirmed IS NOT NULL THEN 'confirmed' WHEN mapped_text IS NOT NULL THEN 'font_table' END AS source
FROM g LEFT JOIN c USING (paper, font_xref, glyph_id)""")
def mapping_precedence(t):
    g = t("glyphs")
    known = g.where("not suspicious_encoding").select("paper", "font_xref", "glyph_id", "text")
    return constraints.apply_mapping(g, known)


# ---------------------------------------------------------------- spatial

_OWNER = f"""v AS (SELECT paper, page, span, ch, text, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM g WHERE {_VISIBLE}),
o AS (SELECT *, greatest(0.0, x1 - x0) * greatest(0.0, y1 - y0) AS area FROM b WHERE kind IN ({_KINDS}) AND parent IS NULL),
w AS (SELECT v.paper, v.page, span, ch, v.text, o.id AS owner, row_number() OVER (PARTITION BY v.paper, v.page, span, ch ORDER BY o.area, o.seq, o.id) AS r
FROM v LEFT JOIN o ON v.paper = o.paper AND v.page = o.page AND cx BETWEEN o.x0 - 1 AND o.x1 + 1 AND cy BETWEEN o.y0 - 1 AND o.y1 + 1)"""


@query(f"WITH {_G}, {_B}, {_OWNER} SELECT paper, page, span, ch, owner FROM w WHERE r = 1")
def glyph_owner_argmin(t):
    return spatial.glyph_owner(t("glyphs"), t("blocks"))


@query(f"WITH {_G}, {_B}, {_OWNER} SELECT paper, page, CAST(count(*) AS BIGINT) AS unassigned, left(string_agg(text, '' ORDER BY span, ch), 500) AS sample FROM w WHERE r = 1 AND owner IS NULL GROUP BY ALL")
def glyph_unassigned(t):
    g = spatial.glyph_owner(t("glyphs"), t("blocks"), F.col("text")).where("owner is null")
    return g.groupBy("paper", "page").agg(F.count(F.lit(1)).alias("unassigned"), F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "ch", "text"))), lambda x: x["text"]), ""), F.lit(500)).alias("sample"))


@query(f"""WITH {_G}, {_B} SELECT b.paper, b.id, CAST(count(g.paper) AS BIGINT) AS glyphs, CAST(count(*) FILTER ((g.x0 + g.x1) / 2 BETWEEN b.x0 AND b.x1 AND (g.y0 + g.y1) / 2 BETWEEN b.y0 AND b.y1) AS BIGINT) AS in_target,
CAST(count(*) FILTER (suspicious_encoding) AS BIGINT) AS suspicious, coalesce(string_agg(DISTINCT font, ',' ORDER BY font), '') AS fonts, CASE WHEN count(g.paper) > 0 THEN 'text_present' ELSE 'no_text_in_region' END AS status
FROM b LEFT JOIN g ON g.paper = b.paper AND g.page = b.page AND g.x0 <= b.x1 AND g.x1 >= b.x0 AND g.y0 <= b.y1 AND g.y1 >= b.y0 GROUP BY b.paper, b.id""")
def region_evidence(t):
    return spatial.region_evidence(t("glyphs"), t("blocks"))


@query(f"""WITH {_B}, j AS (SELECT i.paper, i.id, o.id AS enclosing, row_number() OVER (PARTITION BY i.paper, i.id ORDER BY greatest(0.0, o.x1 - o.x0) * greatest(0.0, o.y1 - o.y0), o.seq, o.id) AS r
FROM b i LEFT JOIN b o ON i.paper = o.paper AND i.page = o.page AND o.kind IN ({_PROSE}) AND o.x0 <= i.x0 AND o.y0 <= i.y0 AND o.x1 >= i.x1 AND o.y1 >= i.y1 WHERE i.kind = 'inline_math') SELECT paper, id, enclosing FROM j WHERE r = 1""")
def orphan_inline(t):
    return spatial.enclosing_prose(t("blocks"))


@query(f"""WITH {_B}, j AS (SELECT a.paper, a.id, o.id AS other, o.seq AS oseq, greatest(0.0, least(a.x1, o.x1) - greatest(a.x0, o.x0)) * greatest(0.0, least(a.y1, o.y1) - greatest(a.y0, o.y0)) AS w,
greatest(0.0, a.x1 - a.x0) * greatest(0.0, a.y1 - a.y0) + greatest(0.0, o.x1 - o.x0) * greatest(0.0, o.y1 - o.y0) AS s FROM b a JOIN b o ON a.paper = o.paper AND a.page = o.page AND a.id <> o.id AND a.x0 < o.x1 AND o.x0 < a.x1 AND a.y0 < o.y1 AND o.y0 < a.y1),
k AS (SELECT *, CASE WHEN s - w > 0 THEN w / (s - w) ELSE 0.0 END AS iou FROM j), r AS (SELECT *, row_number() OVER (PARTITION BY paper, id ORDER BY iou DESC, oseq, other DESC) AS r FROM k WHERE iou >= 0.1)
SELECT paper, id, other, round(iou, 6) AS iou FROM r WHERE r = 1""")
def proposal_iou_best(t):
    return spatial.best_overlap(t("blocks"), 0.1)


@query(f"WITH {_B} SELECT paper, parent, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS BIGINT) AS children FROM b WHERE parent IS NOT NULL GROUP BY ALL")
def box_union(t):
    return spatial.box_union(t("blocks"))


# ---------------------------------------------------------------- layout

_PLACE = "p AS (SELECT *, CASE WHEN bool_or(ord IS NULL) OVER (PARTITION BY paper, page) THEN CAST(row_number() OVER (PARTITION BY paper, page ORDER BY seq, id) AS DOUBLE) ELSE ord END AS place FROM b)"


@query(f"WITH {_B}, {_PLACE} SELECT paper, id, page, place FROM p")
def null_order_fallback(t):
    return layout.with_order(t("blocks")).select("paper", "id", "page", "place")


@query(f"WITH {_B}, {_PLACE} SELECT paper, id, printf('p%03db%03d', page, row_number() OVER (PARTITION BY paper, page ORDER BY place, seq, id) - 1) AS name FROM p WHERE kind <> 'inline_math'")
def block_numbering(t):
    return layout.numbering(t("blocks"))


@query(f"""WITH {_B}, u AS (SELECT paper, id AS owner, unnest(inline) AS child, generate_subscripts(inline, 1) - 1 AS slot FROM b)
SELECT u.paper, owner, CAST(slot AS INT) AS slot, child, b.text AS child_text FROM u JOIN b ON b.paper = u.paper AND b.id = u.child""")
def block_children(t):
    return layout.children(t("blocks"))


_RANKED = """q AS (SELECT *, coalesce(links['caption_of'], links['footnote_of']) AS owner FROM p WHERE parent IS NULL OR kind IN ('caption', 'footnote')),
j AS (SELECT q.*, o.id AS oid, o.page AS opage, o.place AS oplace, o.seq AS oseq, o.kind AS okind FROM q LEFT JOIN q o ON q.paper = o.paper AND q.owner = o.id),
ranked AS (SELECT paper, id, page, kind, owner, CAST(row_number() OVER (PARTITION BY paper ORDER BY coalesce(opage, page), coalesce(oplace, place), coalesce(oseq, seq), coalesce(oid, id), owner IS NOT NULL, page, place, seq, id) AS INT) AS rank
FROM j WHERE kind <> 'furniture' AND (owner IS NULL OR (oid IS NOT NULL AND okind <> 'furniture')))"""


@query(f"WITH {_B}, {_PLACE}, {_RANKED} SELECT * FROM ranked")
def reading_order(t):
    return layout.reading_order(t("blocks"))


@query(f"WITH {_B} SELECT coalesce(kind, 'all') AS kind, CAST(coalesce(page, -1) AS INT) AS page, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY CUBE (b.kind, b.page)")
def block_cube(t):
    return layout.unique(t("blocks")).cube("kind", "page").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("kind", F.lit("all")).alias("kind"), F.coalesce("page", F.lit(-1)).alias("page"), "n")


# ---------------------------------------------------------------- candidates and votes

_C = "u AS (SELECT DISTINCT ON (paper, block, seq) * FROM candidates), c AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY paper, block, engine ORDER BY seq DESC) = 1)"
_F = "e AS (SELECT engine, min(formula_family) AS known, min(pref) AS pref FROM engines GROUP BY ALL), f AS (SELECT c.* REPLACE (coalesce(c.family, known, c.engine) AS family), pref FROM c LEFT JOIN e USING (engine))"
_KEY = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\([lg])eq(q|slant)', '\\\1E\2', 'g'), '^\s*(\$\$?|\\\[|\\\()|(\$\$?|\\\]|\\\))\s*$', '', 'g'), '\\leq', '\le', 'g'), '\\geq', '\ge', 'g'), '\\(dfrac|tfrac)', '\frac', 'g'), '(\\[,;:!]|\s)', '', 'g'), '([_^])([A-Za-z0-9])', '\1{\2}', 'g'), '\\([lg])E(q|slant)', '\\\1eq\2', 'g')"""
_KEY = _KEY.replace(r"'\le'", r"'\\le'").replace(r"'\ge'", r"'\\ge'").replace(r"'\frac'", r"'\\frac'")
_V = f"k AS (SELECT f.*, {_KEY} AS key FROM f WHERE format = 'latex' AND trim(content, ' \\t\\n') <> '' AND regexp_matches(content, '\\S'))"


def _votes(t, key=None, rejected=None) -> DataFrame:
    c = vote.with_family(vote.current(t("candidates")), t("engines")).where((F.col("format") == "latex") & F.col("content").rlike(r"\S"))
    return c.withColumn("key", vote.simple_key(F.col("content")) if key is None else key).withColumn("rejected", F.lit(False) if rejected is None else rejected)


@query(f"WITH {_C} SELECT paper, block, engine, seq FROM c")
def candidate_replace_by_key(t):
    return vote.current(t("candidates")).select("paper", "block", "engine", "seq")


@query(f"WITH {_C}, {_F} SELECT family, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT engine) AS BIGINT) AS engines FROM f GROUP BY ALL")
def family_lookup(t):
    return vote.with_family(vote.current(t("candidates")), t("engines")).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("engine").alias("engines"))


_VOTED = """s AS (SELECT paper, block, count(*) AS n_candidates FROM k GROUP BY ALL),
g AS (SELECT paper, block, key, list_sort(list_distinct(list(family))) AS fams, min(lpad(CAST(coalesce(pref, 2147483647) AS VARCHAR), 12, '0') || engine) AS best, arg_min(content, lpad(CAST(coalesce(pref, 2147483647) AS VARCHAR), 12, '0') || engine) AS value FROM k GROUP BY ALL),
w AS (SELECT *, row_number() OVER o AS place, count(*) OVER (PARTITION BY paper, block) AS groups, lead(len(fams)) OVER o AS second FROM g WINDOW o AS (PARTITION BY paper, block ORDER BY len(fams) DESC, best)),
v AS (SELECT s.paper, s.block, CASE WHEN len(fams) >= 2 AND (groups = 1 OR len(fams) > coalesce(second, 0)) THEN 'accepted' WHEN groups = 1 THEN 'unverified' WHEN n_candidates >= 2 THEN 'conflict' ELSE 'unverified' END AS status, value,
CASE WHEN len(fams) >= 2 AND groups = 1 THEN 'unanimous:' || array_to_string(fams, '+') WHEN len(fams) >= 2 AND len(fams) > coalesce(second, 0) THEN 'majority:' || array_to_string(fams, '+') WHEN groups = 1 THEN 'single_family:' || fams[1] WHEN n_candidates >= 2 THEN 'disagreement' ELSE 'single_candidate' END AS rule,
CAST(n_candidates AS BIGINT) AS n_candidates, CAST(coalesce(groups, 0) AS BIGINT) AS n_groups FROM s LEFT JOIN w ON s.paper = w.paper AND s.block = w.block AND place = 1)"""


@query(f"WITH {_C}, {_F}, {_V}, {_VOTED} SELECT * FROM v")
def vote_decisions(t):
    """Votes with the normal form that SQL can express, without rejections."""
    return vote.decide(_votes(t))


@query()
def vote_exact(t):
    """Votes with the full normal form; candidates that fail the structural checks do not vote."""
    return vote.decide(_votes(t, udfs.layout_form("content"), F.size(udfs.lint("content")) > 0))


@query(f"WITH {_C}, {_F}, {_V} SELECT paper, block, key, CAST(count(DISTINCT family) AS BIGINT) AS families, CAST(count(*) AS BIGINT) AS engines FROM k GROUP BY ALL")
def vote_families(t):
    return _votes(t).groupBy("paper", "block", "key").agg(F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("engines"))


_D = '''d AS (SELECT paper, block, status, value, rule, "by", evidence, decided_at FROM decisions QUALIFY row_number() OVER (PARTITION BY paper, block
ORDER BY decided_at DESC NULLS LAST, status DESC NULLS LAST, value DESC NULLS LAST, rule DESC NULLS LAST, "by" DESC NULLS LAST, evidence DESC NULLS LAST) = 1)'''


@query(f"WITH {_D} SELECT paper, block, status, value, rule FROM d")
def decision_latest(t):
    """The state that holds of each block."""
    return vote.latest_decisions(t("decisions")).select("paper", "block", "status", "value", "rule")


@query(f"WITH {_C} SELECT left(sha256(coalesce(engine, chr(0)) || chr(31) || coalesce(content, chr(0))), 32) AS key, CAST(count(*) AS BIGINT) AS items FROM c GROUP BY ALL")
def cache_keys(t):
    return vote.current(t("candidates")).select(models.content_key("engine", "content").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("items"))


_CACHE = f"WITH {_C}, i AS (SELECT paper, block, seq, left(sha256(coalesce(engine, chr(0)) || chr(31) || coalesce(content, chr(0))), 32) AS key, run_at FROM u), h AS (SELECT DISTINCT key FROM i WHERE run_at < TIMESTAMP '2025-09-01')"


@query(_CACHE + " SELECT paper, block, seq FROM i WHERE key IN (SELECT key FROM h)")
def cache_hits(t):
    items, seen = _items(t)
    return models.cached(items, seen)[0].select("paper", "block", "seq")


@query(_CACHE + " SELECT paper, block, seq FROM i WHERE key NOT IN (SELECT key FROM h)")
def cache_misses(t):
    items, seen = _items(t)
    return models.cached(items, seen)[1].select("paper", "block", "seq")


def _items(t) -> tuple[DataFrame, DataFrame]:
    c = t("candidates").dropDuplicates(["paper", "block", "seq"]).withColumn("key", models.content_key("engine", "content"))
    return c, c.where("run_at < timestamp'2025-09-01'").select("key", F.col("content").alias("output"))


# ---------------------------------------------------------------- LaTeX as text

_M = "m AS (SELECT DISTINCT ON (paper, block, seq) paper, block, seq, content FROM candidates WHERE format = 'latex' AND content IS NOT NULL)"


def _latex(t) -> DataFrame:
    return t("candidates").dropDuplicates(["paper", "block", "seq"]).where("format = 'latex' and content is not null").select("paper", "block", "seq", "content")


@query(f"WITH {_M} SELECT paper, block, seq, CAST(len(regexp_extract_all(content, '(?s)\\\\[a-zA-Z]+|\\\\.|\\s+|.')) AS INT) AS tokens FROM m")
def latex_tokens(t):
    return _latex(t).select("paper", "block", "seq", F.size(F.expr(r"regexp_extract_all(content, '(?s)\\\\[a-zA-Z]+|\\\\.|\\s+|.', 0)")).alias("tokens"))


@query(f"""WITH {_M}, n AS (SELECT *, len(regexp_extract_all(replace(content, '\\\\', ''), '\\{{')) - len(regexp_extract_all(replace(content, '\\\\', ''), '\\\\\\{{')) AS opened,
len(regexp_extract_all(replace(content, '\\\\', ''), '\\}}')) - len(regexp_extract_all(replace(content, '\\\\', ''), '\\\\\\}}')) AS closed FROM m) SELECT paper, block, seq, CAST(opened AS INT) AS opened, CAST(closed AS INT) AS closed FROM n WHERE opened <> closed""")
def brace_lint(t):
    clear = F.replace(F.col("content"), F.lit("\\\\"), F.lit(""))
    n = lambda s: F.size(F.regexp_extract_all(clear, F.lit(rf"(?<!\\)\{s}"), F.lit(0)))
    return _latex(t).select("paper", "block", "seq", n("{").alias("opened"), n("}").alias("closed")).where("opened <> closed")


@query(f"WITH {_M} SELECT paper, block, seq, CASE WHEN regexp_full_match(s, '(?s)\\$\\$.*\\$\\$') THEN trim(s[3:-3]) WHEN regexp_full_match(s, '(?s)\\\\\\[.*\\\\\\]') THEN trim(s[3:-3]) WHEN regexp_full_match(s, '(?s)\\$.+\\$') THEN trim(s[2:-2]) ELSE s END AS body FROM (SELECT *, trim(content) AS s FROM m)")
def unwrap_math(t):
    s = F.trim("content")
    inner = lambda n: F.trim(F.substring(s, n + 1, F.length(s) - 2 * n))
    return _latex(t).select("paper", "block", "seq", F.when(s.rlike(r"(?s)^\$\$.*\$\$$"), inner(2)).when(s.rlike(r"(?s)^\\\[.*\\\]$"), inner(2)).when(s.rlike(r"(?s)^\$.+\$$"), inner(1)).otherwise(s).alias("body"))


@query()
def latex_lint(t):
    return _latex(t).withColumn("problems", udfs.lint("content")).where(F.size("problems") > 0).select("paper", "block", "seq", F.array_join("problems", ",").alias("problems"))


@query()
def alias_normalise(t):
    return _latex(t).select("paper", "block", "seq", udfs.normal_form("content").alias("normal"))


_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_TAG = r"\\tag\s*(\*?)\s*\{((?:[^{}]|\{[^{}]*\})*)\}"
_BARE = " ".join(f"WHEN starts_with(s, '{a}') AND ends_with(s, '{b}') AND length(s) >= {2 * n} THEN s[{n + 1}:-{n + 1}]" for a, b, n in (("$$", "$$", 2), ("\\[", "\\]", 2), ("\\(", "\\)", 2), ("$", "$", 1)))


@query(f"""WITH {_M}, s AS (SELECT paper, block, seq, {_STRIPPED.format('content')} AS s FROM m), w AS (SELECT paper, block, seq, {_STRIPPED.format(f"CASE {_BARE} ELSE s END")} AS t FROM s)
SELECT paper, block, seq, {_STRIPPED.format(f"regexp_replace(t, '{_TAG}', ' ', 'g')")} AS body, array_to_string(regexp_extract_all(t, '{_TAG}', 2), ',') AS tags FROM w""")
def split_tags(t):
    """Bodies and equation tags; the SQL takes tags with braces one deep, outside groups."""
    return _latex(t).select("paper", "block", "seq", udfs.tags("content").alias("t")).select("paper", "block", "seq", "t.body", F.array_join("t.tags", ",").alias("tags"))


@query()
def math_spans(t):
    return _latex(t).select("paper", "block", "seq", udfs.spans("content").alias("s")).select("paper", "block", "seq", "s.n", "s.balanced")


@query()
def normalize_formula(t):
    return _latex(t).select("paper", "block", "seq", udfs.clean_output("content").alias("o")).select("paper", "block", "seq", "o.latex", "o.error")


@query()
def candidate_atoms(t):
    return _latex(t).select("paper", "block", "seq", udfs.atoms("content").alias("a")).select("paper", "block", "seq", "a.n", F.array_join("a.symbols", "").alias("symbols"), F.array_join("a.unsupported", " ").alias("unsupported"))


@query()
def matrix_rows(t):
    return _latex(t).select("paper", "block", "seq", udfs.matrix_rows("content").alias("m")).select("paper", "block", "seq", "m.status", "m.rows")


@query()
def tex_scan(t):
    return _latex(t).select("paper", "block", "seq", F.posexplode(udfs.segments("content")).alias("n", "s")).select("paper", "block", "seq", "n", "s.*")


@query()
def compare_latex(t):
    """Each candidate against the decided value of its block."""
    d = vote.latest_decisions(t("decisions")).where("value is not null").select("paper", "block", "value")
    return _latex(t).join(d, ["paper", "block"]).select("paper", "block", "seq", udfs.compare("content", "value").alias("c")).select("paper", "block", "seq", "c.body", "c.number", "c.difference_count", F.to_json("c.differences").alias("differences"))


@query()
def score_levels(t):
    d = vote.latest_decisions(t("decisions")).where("value is not null and status in ('accepted', 'resolved')").select("paper", "block", "value")
    return _latex(t).join(d, ["paper", "block"]).select("paper", "block", "seq", udfs.score("content", "value").alias("s")).select("paper", "block", "seq", "s.*")


@query()
def table_render(t):
    c = t("candidates").dropDuplicates(["paper", "block", "seq"]).where("content like '%<table%'")
    return c.select("paper", "block", "seq", udfs.table("content").alias("markdown"))


# ---------------------------------------------------------------- text and documents


@query()
def compose_prose(t):
    return text.composed_text(t("glyphs"), t("blocks")).select("paper", "id", "text", F.array_join("slots", "|").alias("slots"), "lines")


_KIDS = "u AS (SELECT paper, id AS owner, unnest(inline) AS child, generate_subscripts(inline, 1) AS slot FROM b), kid AS (SELECT u.paper, owner, list(coalesce(nullif(x.text, ''), '\\text{?}') ORDER BY slot) AS fill FROM u JOIN b x ON x.paper = u.paper AND x.id = u.child GROUP BY ALL)"
_WOVEN = "array_to_string(list_transform(string_split(b.text, '￼'), lambda x, i: x || CASE WHEN i < len(string_split(b.text, '￼')) THEN '$' || coalesce(fill[i], '\\text{?}') || '$' ELSE '' END), '')"


@query(f"WITH {_B}, {_KIDS} SELECT b.paper, b.id, b.kind, {_WOVEN} AS prose FROM b LEFT JOIN kid ON kid.paper = b.paper AND kid.owner = b.id WHERE b.text IS NOT NULL")
def slot_interleave(t):
    return text.prose_markdown(t("blocks")).where("prose is not null").select("paper", "id", "kind", "prose")


@query(f"""WITH {_B}, u AS (SELECT paper, id AS owner, unnest(inline) AS child, generate_subscripts(inline, 1) - 1 AS slot FROM b)
SELECT u.paper, owner, child, CAST(slot AS INT) AS slot, array_to_string(list_transform(string_split(b.text, '￼'), lambda x, i: x || CASE WHEN i >= len(string_split(b.text, '￼')) THEN '' WHEN i - 1 = slot THEN '⟦THIS⟧' ELSE '⟦math⟧' END), '') AS context
FROM u JOIN b ON b.paper = u.paper AND b.id = owner JOIN b k ON k.paper = u.paper AND k.id = child""")
def context_mask(t):
    return text.context_mask(t("blocks"))


_MARKDOWN = f"""w AS (SELECT b.paper, b.id, b.kind, b.level, {_WOVEN} AS prose FROM b LEFT JOIN kid ON kid.paper = b.paper AND kid.owner = b.id),
md AS (SELECT paper, id, CASE kind WHEN 'title' THEN '# ' || prose WHEN 'heading' THEN repeat('#', CAST(greatest(2, least(6, coalesce(level, 2))) AS BIGINT)) || ' ' || prose WHEN 'display_math' THEN '$$' || chr(10) || prose || chr(10) || '$$'
WHEN 'code' THEN '```' || chr(10) || prose || chr(10) || '```' WHEN 'algorithm' THEN '```' || chr(10) || prose || chr(10) || '```' WHEN 'footnote' THEN '> ' || prose ELSE prose END AS markdown FROM w WHERE prose <> '')"""


@query(f"WITH {_B}, {_KIDS}, {_MARKDOWN} SELECT * FROM md")
def markdown_blocks(t):
    return text.block_markdown(t("blocks"))


@query(f"WITH {_B}, {_PLACE}, {_RANKED}, {_KIDS}, {_MARKDOWN} SELECT ranked.paper, rank, ranked.id, markdown FROM ranked JOIN md ON md.paper = ranked.paper AND md.id = ranked.id")
def markdown_documents(t):
    return text.documents(t("blocks"))


_LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"), ("￼", ""))
_CLEANED = "text"
for _a, _b in _LIGATURES:
    _CLEANED = f"replace({_CLEANED}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, nfc_normalize({_CLEANED}) AS text FROM documents")
def ligature_clean(t):
    """Ligatures opened, slots taken out, accents composed."""
    plain = F.col("text").rlike(r"^[\x00-\x7f]*$")
    return t("documents").select("doc_id", F.when(plain, F.col("text")).otherwise(udfs.clean_text("text")).alias("text"))


@query("SELECT DISTINCT path, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), '[^A-Za-z0-9_.\\-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'paper') AS key FROM papers WHERE path IS NOT NULL")
def paper_key(t):
    return t("papers").where("path is not null").select("path", regions.paper_key(F.col("path")).alias("key")).distinct()


@query("SELECT sha256, CAST(count(DISTINCT paper) AS BIGINT) AS papers, string_agg(DISTINCT paper, ',' ORDER BY paper) AS names FROM papers GROUP BY ALL HAVING count(DISTINCT paper) > 1")
def same_file(t):
    """Papers that are one file under several keys."""
    return t("papers").groupBy("sha256").agg(F.count_distinct("paper").alias("papers"), F.array_join(F.array_sort(F.collect_set("paper")), ",").alias("names")).where("papers > 1")


@query("""WITH d AS (SELECT DISTINCT ON (paper, id) paper, page, id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM blocks WHERE text IS NOT NULL)
SELECT a.paper, a.id, b.id AS inside FROM d a JOIN d b ON a.paper = b.paper AND a.page = b.page AND a.id <> b.id WHERE a.t <> '' AND (a.t = b.t OR (length(a.t) >= 40 AND contains(b.t, a.t)))""")
def duplicate_insert_join(t):
    """Blocks whose text stands in another block of the page; short texts must be the whole of it."""
    d = t("blocks").where("text is not null").dropDuplicates(["paper", "id"]).select("paper", "page", "id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("t"))
    o = d.select("paper", "page", F.col("id").alias("inside"), F.col("t").alias("o"))
    return d.join(o, ["paper", "page"]).where("id <> inside and t <> '' and (t = o or (length(t) >= 40 and contains(o, t)))").select("paper", "id", "inside")


# ---------------------------------------------------------------- constraints and evaluation


@query()
def symbol_count_diff(t):
    return constraints.count_differences(t("glyphs"), t("blocks"), _latex(t))


@query()
def script_roles(t):
    return constraints.script_findings(t("glyphs"), t("blocks"), _latex(t))


@query()
def number_association(t):
    return constraints.number_association(t("glyphs"), t("blocks"))


@query()
def boundary_prose(t):
    return constraints.edge_prose(t("glyphs"), t("blocks"), glyphs.most_common(t("glyphs"), F.col("font"), "font"))


@query("""WITH RECURSIVE b AS (SELECT DISTINCT ON (paper, id) paper, id, parent FROM blocks), r AS (SELECT paper, id, parent, 0 AS depth FROM b WHERE parent IS NULL
UNION ALL SELECT b.paper, b.id, b.parent, r.depth + 1 FROM b JOIN r ON b.paper = r.paper AND b.parent = r.id) SELECT paper, id, CAST(depth AS INT) AS depth FROM r""")
def include_closure(t):
    """Depth of every block below its top-level owner; blocks below a missing owner are not reached."""
    b = t("blocks").dropDuplicates(["paper", "id"]).select("paper", "id", "parent")
    level = b.where("parent is null").select("paper", "id", F.lit(0).alias("depth"))
    out = level
    # one level after another until one is empty; a block has one owner, so no cycle hangs below a top-level one
    b, level = durable(b), durable(level)
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        level = durable(b.join(level.select("paper", F.col("id").alias("parent")), ["paper", "parent"]).select("paper", "id", F.lit(depth).alias("depth")))
        out = out.unionByName(level)
    return out


_S = f"""{_C}, {_F}, {_V}, d AS (SELECT paper, block, arg_max(content_key, decided_at) AS dk FROM (SELECT paper, block, decided_at, {_KEY.replace('content', 'value', 1)} AS content_key FROM decisions WHERE value IS NOT NULL AND status IN ('accepted', 'resolved')) GROUP BY ALL),
bk AS (SELECT DISTINCT ON (paper, id) paper, id AS block, kind FROM blocks), s AS (SELECT k.paper, k.block, engine, kind, key, key = dk AS correct FROM k JOIN d USING (paper, block) JOIN bk USING (paper, block) WHERE kind IN ('display_math', 'inline_math'))"""


def _scores(t) -> DataFrame:
    d = t("decisions").where("value is not null and status in ('accepted', 'resolved')").groupBy("paper", "block").agg(F.max_by("value", "decided_at").alias("value")).select("paper", "block", vote.simple_key(F.col("value")).alias("dk"))
    k = layout.unique(t("blocks")).where("kind in ('display_math', 'inline_math')").select("paper", F.col("id").alias("block"), "kind")
    return _votes(t).join(d, ["paper", "block"]).join(k, ["paper", "block"]).select("paper", "block", "engine", "kind", "key", (F.col("key") == F.col("dk")).alias("correct"), (F.col("key") == "").alias("empty"))


@query(f"WITH {_S} SELECT engine, coalesce(kind, 'all') AS kind, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(correct AS DOUBLE)), 4) AS correct, CAST(count(*) FILTER (key = '') AS BIGINT) AS empty FROM s GROUP BY GROUPING SETS ((engine), (engine, kind))")
def engine_summary(t):
    return score.engine_summary(_scores(t))


@query(f"""WITH {_S} SELECT x.engine AS a, y.engine AS b, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (x.key = y.key AND x.key <> '') AS BIGINT) AS agree, CAST(count(*) FILTER (x.key = y.key AND x.key <> '' AND NOT x.correct) AS BIGINT) AS agree_but_wrong,
round(count(*) FILTER (x.key = y.key AND x.key <> '' AND x.correct) / nullif(count(*) FILTER (x.key = y.key AND x.key <> ''), 0), 4) AS agreement_precision, CAST(count(*) FILTER (x.correct OR y.correct) AS BIGINT) AS either_correct
FROM s x JOIN s y ON x.paper = y.paper AND x.block = y.block AND x.engine < y.engine GROUP BY ALL""")
def pair_agreement(t):
    return score.pair_agreement(_scores(t))


@query(f"""WITH {_G}, p AS (SELECT DISTINCT paper, page, span, ch FROM g WHERE regexp_matches({_NAME}, '(?i)(MI[0-9]|SY[0-9]|EX[0-9]|math)')), q AS (SELECT DISTINCT paper, page, span, ch FROM glyphs WHERE in_target),
n AS (SELECT count(*) FILTER (p.paper IS NOT NULL AND q.paper IS NOT NULL) AS tp, count(*) FILTER (q.paper IS NULL) AS fp, count(*) FILTER (p.paper IS NULL) AS fn FROM p FULL JOIN q USING (paper, page, span, ch))
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM n""")
def inline_precision_recall(t):
    """Glyphs in math fonts against the glyphs of target regions."""
    g = glyphs.unique(t("glyphs"))
    return score.precision_recall(g.where(glyphs.is_math_font()), g.where("in_target"), list(glyphs.KEY))
