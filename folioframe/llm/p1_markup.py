"""Markup residue: find HTML, Markdown, wiki and LaTeX markup and turn it into clean text.

Method: maximum-scoring subsequence. A text is cut into words and markup tokens; every token
class has a weight, the smoothed log odds that its tokens stand in the block's own text, learnt from
labelled records: words come out positive, tags negative. A linear scan (Kadane) finds the contiguous
region with the highest sum, the content region; the same scan over the turned weights finds the
region that is most markup, and a record holds markup when that region scores above zero.

Defined results: null text gives no row in ``found`` and null columns in ``clean``; an empty text
gives an empty region; texts are processed whole; repeated rows count once; unknown or null
``format`` and unknown kinds are treated alike; in clean text, footnotes in ``<ref>`` and wiki templates
leave with what they hold, all other text stays; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import MATH_KINDS, blocks_of, candidates_of, hashed_sample, plain, python_stage
from folioframe.session import read_table

#: Element names of HTML and of wiki extensions.
TAGS = (
    "a abbr address article aside b big blockquote body br caption center cite code col colgroup dd del div dl dt em "
    "figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main mark math meta nav "
    "nowiki ol p pre q ref references s samp script section small source span strike strong style sub sup "
    "syntaxhighlight table tbody td tfoot th thead title tr tt u ul var wbr"
)
_NAME = "(?:" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + ")"
_ATTR = r"""(?:\s+[a-zA-Z_:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*"""
#: Labelled records from which the weights are learnt, picked by hash (about half of all records are
#: formulas, so twice as many are drawn). This bounds a model of a few
#: dozen numbers; everything else reads all records.
LABELLED = 20_000
CODE_KINDS = ("code", "algorithm")

#: Token classes in the order in which they are tried at a position.
PATTERNS = [
    ("path", r"(?<![\w\\])[A-Za-z]:(?:\\[\w .-]*\w)+|(?<![\w\\])\\\\\w[\w.-]*(?:\\[\w.-]+)+"),
    ("url", r"https?://[^\s<>\])}]+"),
    ("word", r"[^\W\d_]+"),
    ("number", r"\d[\d.,]*"),
    ("plain", r"[ .,()“”„’–—。、；？%]+(?<!\s)(?=[^\W_])|(?<=[^\s]) (?=[^\W_])"),
    ("set", r"\{\s*[^\W_.]+(?:\s*,\s*(?:[^\W_]|[.…])+)+\s*\}"),
    ("html_comment", r"<!--.*?-->|<!--|-->"),
    ("html_tag", rf"(?i:<{_NAME}{_ATTR}\s*/?>|</{_NAME}\s*>|<!doctype[^>]*>)|</?(?i:{_NAME})(?:\s+[a-zA-Z-]+\s*=[^<>]*)?\Z|</\Z"),
    ("html_entity", r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,8});|&#\d*\Z"),
    ("md_fence", r"(?m:^\s*```[\w+-]*)|```|(?m:^\s*~~~+[\w+-]*[ \t]*$)"),
    ("wiki_table", r"(?m:^\s*\{\||^\s*\|\}|^\s*\|-+\s*$|^\s*\|\+)"),
    ("md_table_rule", r"(?m:^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$)"),
    ("md_row", r"(?m:^\s*\|(?=[^\n]*\S))"),
    ("wiki_heading", r"(?m:^\s*={2,6}(?=\s*[^=\s])|(?<=[^=\s])={2,6}\s*$|(?<=[^=\s]\s)={2,6}\s*$)"),
    ("md_heading", r"(?m:^\s{0,3}#{1,6}(?=\s+\S)|^\s{0,3}#{2,6}\s*$)"),
    ("md_quote", r"(?m:^\s{0,3}>+(?=\s+\S))"),
    ("md_image", r"!\[[^\]\n]*\]\([^)\n]*\)"),
    ("md_link", r"\[[^\]\n]+\]\((?:https?:|#|/|\.|mailto:|\w+[./#])[^)\s]*(?:\s+\"[^\"]*\")?\)|\[\^\w+\]:?"),
    ("wiki_link", r"\[\[|\]\]|\[https?://"),
    ("wiki_template", r"\{\{(?=\s*[^\W\d_]|\s*[#!])|(?<=[\w|=\s)])\}\}"),
    ("wiki_quote", r"'{2,5}"),
    ("latex_env", r"\\(?:begin|end)\s*\{[^}\n]*\}?"),
    ("latex_math", r"\\[\[\]()]|\$\$|\$(?=[^\s$\d](?:[^$\n]*[^\s$\\])?\$(?!\d))|\$(?=\d[^\s$]*[\\^_{=<>+*/-][^\s$]*\$(?!\d))|(?<=[^\s$\\])\$(?![\w$])|\$(?=\\|[A-Za-z]\b(?!\$))"),
    ("latex_cmd", r"\\[a-zA-Z@]+\*?"),
    ("latex_row", r"\\\\"),
    ("latex_escape", r"\\[&%$#_{}~^,;:!\"'`=.\-* |<>]"),
    ("latex_tie", r"(?<=[^\W_\d])~(?=[^\W_]|[\\$])|(?<=\.)~(?=[^\W_]|[\\$])"),
    ("latex_script", r"[\^_]\{|[\^_](?=\\)"),
    ("brace", r"[{}]"),
    ("md_strong", r"\*\*|__(?=\S)|(?<=\S)__"),
    ("md_code", r"`+"),
    ("md_emph", r"(?<![\w*\\])\*(?=[^\s*])(?=[^*\n]*[^\s*]\*(?![\w*]))|(?<=[^\s*(\\])\*(?![\w*\s(])|(?<=[^\s*\d)(\\]{2})\*(?=\s|\Z)|(?<![\w_\\])_(?=[^\s_])(?=[^_\n]*[^\s_]_(?!\w))|(?<=[^\s_])_(?![\w{\\])"),
    ("md_list", r"(?m:^\s*[-+*](?=\s+\S))"),
    ("wiki_list", r"(?m:^\s*[*#:;]{2,}(?=\s+\S))"),
    ("md_rule", r"(?m:^\s*(?:-{3,}|\*{3,}|_{3,}|={4,})\s*$)"),
    ("amp_cell", r"(?<=\s)&(?=\s)"),
    ("space", r"\s+"),
    ("punct", r"."),
]
TOKEN = re.compile("|".join(f"(?P<{n}>{p})" for n, p in PATTERNS), re.S)
CONTENT = ("plain", "path", "url", "set", "word", "number", "space", "punct", "amp_cell")
CLASSES = [n for n, _ in PATTERNS]
#: In bare code these signs belong to the program.
NOT_IN_CODE = {"md_heading", "md_emph", "md_strong", "md_list", "md_rule", "md_quote", "wiki_list", "wiki_quote", "wiki_heading", "wiki_link", "wiki_template", "brace", "latex_row", "latex_escape", "latex_script", "latex_tie", "md_code", "md_row", "md_link", "amp_cell"}


#: Signs without which a text holds no markup: every pattern of a markup class needs one of them.
SIGNS = re.compile(r"[<>&\\$`*_#|{}\[\]~^=]|''|^\s*(?:[-+>]|[:;]{2})", re.M)


def tokens(text: str, kind: str | None = None) -> list[tuple[str, int, int]]:
    """(class, start, end) of every token; concatenated they give the text back."""
    out = []
    for m in TOKEN.finditer(text):
        name = m.lastgroup
        if kind in CODE_KINDS and name in NOT_IN_CODE:
            name = "punct"
        out.append((name, m.start(), m.end()))
    return out


#: Weights before any learning; ``learn_weights`` replaces them.
PRIOR = {c: (1.0 if c in ("word", "path", "url", "set") else 0.2 if c == "number" else 0.0 if c in CONTENT else -1.5) for c in CLASSES}


def best_region(toks: list[tuple[str, int, int]], weights: dict[str, float]) -> tuple[int, int, float]:
    """Kadane's scan: start, end and score of the best contiguous region (the first of equals)."""
    best, here, start, span = 0.0, 0.0, 0, (0, 0)
    for name, a, b in toks:
        if here <= 0:
            here, start = 0.0, a
        here += weights[name]
        if here > best + 1e-9:
            best, span = here, (start, b)
    return (*span, best)


def markup_in(text: str, kind: str | None = None) -> list[str]:
    """The markup classes that stand in a text, without repetition."""
    return list(dict.fromkeys(n for n, _, _ in tokens(text, kind) if n not in CONTENT))


# ---------------------------------------------------------------- conversion

_INLINE = "(?:" + "|".join("a abbr b big center cite code del em font i ins kbd mark nowiki q s samp small span strike strong sub sup tt u var".split()) + ")"


def _cells(row: str, sep: str) -> str:
    return "\t".join(c.strip() for c in re.split(sep, row.strip().strip("|")))


def to_clean(text: str, kind: str | None = None) -> str:
    """Clean text of one record: headings stand alone between blank lines, list items begin with
    a bullet, code lines keep their indent, table rows are tab-separated, formulas keep their source."""
    if not SIGNS.search(text):
        return text.strip()
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\ue0f0{len(kept) - 1}\ue0f1"

    def table(rows: list[str]) -> str:
        return "\n" + keep("\n".join(r for r in rows if r.strip())) + "\n"

    def cell(s: str) -> str:
        return html.unescape(re.sub(r"<[^<>]*>", "", s)).strip()

    t = text  # every pattern is tried where a sign of it stands
    if "<!--" in t:
        t = re.sub(r"<!--.*?(?:-->|\Z)", "", t, flags=re.S)
    if "<" in t:
        t = re.sub(r"(?is)<(?:pre|syntaxhighlight)[^>]*>(?:\s*<code[^>]*>)?(.*?)(?:</code>\s*)?(?:</(?:pre|syntaxhighlight)>|\Z)", lambda m: "\n" + keep(html.unescape(m[1].strip("\n"))) + "\n", t)
    if "```" in t or "~~~" in t:
        t = re.sub(r"(?s)(```|~~~)[\w+-]*\n(.*?)(?:\n?\1|\Z)", lambda m: "\n" + keep(m[2]) + "\n", t)
    if "\\begin" in t:
        t = re.sub(r"(?s)\\begin\{(?:verbatim|lstlisting|minted)\}(?:\{[^}]*\}|\[[^\]]*\])*\n?(.*?)(?:\\end\{(?:verbatim|lstlisting|minted)\}|\Z)", lambda m: "\n" + keep(m[1].strip("\n")) + "\n", t)
    if kind in CODE_KINDS:
        t = html.unescape(re.sub(rf"(?i)</?{_NAME}{_ATTR}\s*/?>", "", t))
        return re.sub(r"\ue0f0(\d+)\ue0f1", lambda m: kept[int(m[1])], t).strip("\n")
    if ":\\" in t:
        t = re.sub(r"[A-Za-z]:(?:\\[\w.-]+)+", lambda m: keep(m[0]), t)
    if "<" in t:
        t = re.sub(r"(?is)<table[^>]*>(.*?)(?:</table>|\Z)", lambda m: table(["\t".join(cell(c) for c in re.split(r"(?i)<t[dh][^>]*>", r)[1:]) for r in re.split(r"(?i)<tr[^>]*>", m[1])]), t)
    if "{|" in t:
        t = re.sub(r"(?ms)^\s*\{\|[^\n]*\n(.*?)(?:^\s*\|\}|\Z)", lambda m: table([_cells(re.sub(r"^\s*[|!]", "", r), r"\|\||!!") for r in m[1].split("\n") if not re.match(r"\s*\|[-+]", r)]), t)
    if "\\begin" in t:
        t = re.sub(r"(?s)\\begin\{(?:tabular|array)\*?\}(?:\{[^}]*\})*(.*?)(?:\\end\{(?:tabular|array)\*?\}|\Z)", lambda m: table([_cells(re.sub(r"\\(?:hline|toprule|midrule|bottomrule)", "", r), r"(?<!\\)&") for r in re.split(r"\\\\", m[1])]), t)
    if "|" in t:
        t = re.sub(r"(?m)(?:^\s*\|.*(?:\n|\Z))+", lambda m: table([_cells(r, r"(?<!\\)\|") for r in m[0].split("\n") if not re.fullmatch(r"[\s|:-]*", r)]), t)
    # formulas
    if "$" in t or "\\" in t:
        t = re.sub(r"(?s)\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\$([^\s$](?:[^$\n]*?[^\s$\\])?)\$(?!\d)|\\begin\{(?:equation|align|gather)\*?\}(.+?)\\end\{(?:equation|align|gather)\*?\}", lambda m: keep(next(g for g in m.groups() if g is not None).strip()), t)
    # headings
    if "<" in t:
        t = re.sub(r"(?is)<h[1-6][^>]*>(.*?)(?:</h[1-6]>|\n|\Z)", r"\n\n\1\n\n", t)
    if "#" in t:
        t = re.sub(r"(?m)^\s{0,3}#{1,6}\s+(.*?)#*\s*$", r"\n\n\1\n\n", t)
    if "==" in t:
        t = re.sub(r"(?m)^\s*={2,6}\s*([^=\n]+?)\s*(?:={2,6})?\s*$", r"\n\n\1\n\n", t)
    if "\\" in t:
        t = re.sub(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph|title|caption)\*?\s*\{([^{}]*)\}", r"\n\n\1\n\n", t)
    # lists
    if "<" in t:
        t = re.sub(r"(?i)<li[^>]*>", "\n• ", t)
    if "\\item" in t:
        t = re.sub(r"\\item(?:\[([^\]]*)\])?\s*", lambda m: f"\n• {m[1] or ''}".rstrip() + " ", t)
    t = re.sub(r"(?m)^(\s*)[-+*](?=\s+\S)", r"\1•", t)
    t = re.sub(r"(?m)^(\s*)[*#:;]{2,}(?=\s+\S)", r"\1•", t)
    # inline wiki, Markdown, LaTeX
    if "<" in t:
        t = re.sub(r"(?is)<ref[^>]*/>|<ref[^>]*>.*?</ref>", "", t)
    n = "{{" in t
    while n:
        t, n = re.subn(r"(?s)\{\{[^{}]*\}\}", "", t)
    if "[[" in t:
        t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    if "[http" in t:
        t = re.sub(r"\[https?://\S+\s+([^\]]+)\]", r"\1", t)
    if "](" in t:
        t = re.sub(r"!?\[([^\]\n]*)\]\((?:https?:|#|/|\.|mailto:|\w+[./#])[^)\n]*\)", r"\1", t)
    if ">" in t:
        t = re.sub(r"(?m)^\s{0,3}>+\s+", "", t)
    if "\\" in t:
        t = re.sub(r"\\(?:label|vspace|hspace|input|index|pagestyle)\*?\{[^{}]*\}", "", t)
        t = re.sub(r"\\(?:begin|end)\{[^}]*\}", "\n", t)
    while "\\" in t:
        t, n = re.subn(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
        t, k = re.subn(r"\{\\[a-zA-Z]+\s+([^{}]*)\}", r"\1", t)
        if not n + k:
            break
    if "\\" in t:
        t = re.sub(r"\\[a-zA-Z]+\*?\s?", "", t)
    if "<" in t:
        t = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|ul|ol|dl|tr|section|blockquote)\b[^>]*>", "\n", t)
        t = re.sub(rf"(?i)</?{_INLINE}{_ATTR}\s*/?>|</?{_NAME}{_ATTR}\s*/?>", "", t)
    t = re.sub(r"'{2,5}|\*\*|(?<!\w)__|__(?!\w)|`+|\[\[|\]\]|\{\{|\}\}|[{}]", "", t)
    if "*" in t or "_" in t:
        t = re.sub(r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])|(?<!\w)_(?=\S)([^_\n]+?)(?<=\S)_(?!\w)", lambda m: m[1] or m[2], t)
    if "\\" in t:
        t = re.sub(r"\\([&%$#_{}])", r"\1", t)
    if "~" in t:
        t = re.sub(r"(?<=[^\W_\d])~(?=[^\W_])|(?<=\.)~(?=[^\W_])", " ", t)
    if "\\" in t:
        t = re.sub(r"\\\\", "\n", t)
    if "&" in t:
        t = html.unescape(t)
    t = re.sub(r"[ \t]*\n[ \t]*(?=[^•\s]|$)", "\n", t)
    t = re.sub(r"\n{3,}", "\n\n", t)
    t = re.sub(r"\ue0f0(\d+)\ue0f1", lambda m: kept[int(m[1])], t)
    return t.strip()


# ---------------------------------------------------------------- operators


def records(spark: SparkSession, directory: str, sampled: bool = False) -> DataFrame:
    """Candidates of blocks that are not formulas, with the block's kind and text; with ``sampled``
    those of the bounded sample that the weights are learnt from."""
    b = blocks_of(spark, directory).where(~F.col("kind").isin(*MATH_KINDS)).select("paper", F.col("id").alias("block"), "kind", F.col("text").alias("label"))
    c = candidates_of(spark, directory)
    if sampled:
        c = hashed_sample(c, ["paper", "block", "seq"], 2 * LABELLED, read_table(spark, directory, "candidates").count())
    return c.select("paper", "block", "seq", "content").join(b, ["paper", "block"])




def label_tokens(text: str, label: str, kind: str | None) -> Counter:
    """(class, does the block's own text have the token?) -> how many tokens of a record."""
    own = plain(label)
    tally: Counter = Counter()
    for name, a, b in tokens(text, kind):
        if name not in ("space", "plain"):
            tally[name, text[a:b].strip() in own] += 1
    return tally


def odds(n: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights of the token classes from labelled tokens; spaces and single signs between words weigh nothing."""
    learnt = {}
    for c in CLASSES:
        good, bad = n.get((c, True), 0), n.get((c, False), 0)
        learnt[c] = 0.0 if c in ("plain", "space", "punct", "amp_cell") else math.log((good + 0.5) / (bad + 0.5)) / 4 if good + bad else PRIOR[c]
    return learnt


def learn_weights(recs: DataFrame) -> dict[str, float]:
    """Log odds of each token class. A record is labelled where its block has a text of its own."""

    def count(row: dict):
        for (name, good), n in label_tokens(row["content"], row["label"], row["kind"]).items():
            yield name, good, n

    picked = recs.where(F.col("content").rlike(r"\S") & F.col("label").rlike(r"\S")).select("content", "label", "kind")
    seen = python_stage(picked, "name string, good boolean, n long", count).groupBy("name", "good").agg(F.sum("n").alias("n")).collect()
    return odds({(r["name"], r["good"]): r["n"] for r in seen})


_FIRST = re.compile(r"[^\W_]")


def region_of(text: str, kind: str | None, weights: dict[str, float]) -> tuple[list[str], tuple[int, int, float], tuple[int, int, float]]:
    """(markup classes met, content region, region that is most markup); regions with their scores."""
    if not SIGNS.search(text):
        # only content, none of it negative: the region reaches from the first word to the last
        m = _FIRST.search(text)
        if m is None:
            return [], (0, 0, 0.0), (0, 0, 0.0)
        return [], (m.start(), len(text.rstrip()), float(sum(weights["word"] for _ in text.split()))), (0, 0, 0.0)
    toks = tokens(text, kind)
    marks = list(dict.fromkeys(n for n, _, _ in toks if n not in CONTENT and weights[n] < 0))
    turned = {c: 0.0 if c in CONTENT and w < 0 else -w for c, w in weights.items()}
    return marks, best_region(toks, weights), best_region(toks, turned)


def scan(recs: DataFrame, weights: dict[str, float], convert: bool = True) -> DataFrame:
    """The scan over every record: content region, region that is most markup, scores, and the markup met on
    the way; with ``convert`` the clean text of the whole record too."""

    def rows(row: dict):
        text = row["content"]
        if text is None:
            yield row["paper"], row["block"], row["seq"], row["kind"], *[None] * 8
            return
        marks, own, markup = region_of(text, row["kind"], weights)
        yield row["paper"], row["block"], row["seq"], row["kind"], marks, *own, *markup, to_clean(text, row["kind"]) if convert else None

    return python_stage(
        recs.select("paper", "block", "seq", "kind", "content"),
        "paper string, block string, seq int, kind string, marks array<string>, region_start int, region_end int, score double, markup_start int, markup_end int, markup_score double, clean string", rows)


def weights_for(spark: SparkSession, directory: str) -> dict[str, float]:
    """Weights from the directory's own records. The sample is cut before the records are joined."""
    return learn_weights(records(spark, directory, sampled=True))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    recs = records(spark, directory)
    return scan(recs, weights_for(spark, directory), convert=False).where("markup_score > 0").select("paper", "block", "seq").distinct()


def p1_method(spark: SparkSession, directory: str) -> DataFrame:
    """The scan's own result: the maximum-scoring region of every record that is not a formula, and the region
    that is most markup."""
    recs = records(spark, directory)
    return scan(recs, weights_for(spark, directory), convert=False).select("paper", "block", "seq", "region_start", "region_end", "score", "markup_start", "markup_end", "markup_score")


def p1_clean(spark: SparkSession, directory: str) -> DataFrame:
    """The clean text of every record that is not a formula."""
    recs = records(spark, directory)
    return scan(recs, weights_for(spark, directory)).select("paper", "block", "seq", "kind", "marks", "region_start", "region_end", "clean")


def p1_kinds(spark: SparkSession, directory: str) -> DataFrame:
    """How many records hold each class of markup, by kind of block."""
    recs = records(spark, directory)
    return scan(recs, weights_for(spark, directory), convert=False).select("kind", F.explode("marks").alias("mark")).groupBy("kind", "mark").agg(F.count(F.lit(1)).alias("records"))


QUERIES = {"p1_method": p1_method, "p1_found": p1_found, "p1_clean": p1_clean, "p1_kinds": p1_kinds}
