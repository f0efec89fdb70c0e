"""Text cut off by field limits: find candidates that stop before what the engine was reading.

Method: a trie over the corpus vocabulary, held as a distributed table of nodes (prefix, is it a
word, how many words go on from it), flags final tokens that are unknown proper prefixes of known
words. This is combined with length evidence: lengths at which an engine's texts pile up. Both are
counted in bits and added (``p3_method``).

A text that is cut between words, in a row of a table or in a formula ends in no unknown prefix, and
an engine that loses its connection cuts at no fixed length. ``p3_found`` therefore also weighs what
``meta`` admits, and how far the block's own text and the other engines' readings go on.

Defined results: null or blank content is no case; headings and other texts that need no end mark
are cases only where other evidence shows that they go on; a paragraph that itself runs on is
none; repeated rows count once; unreadable ``meta`` counts as no evidence; blocks that are missing
from ``blocks`` are judged without kind and text; texts are compared whole; a final token of more than
``LONGEST`` letters is no prefix of a word.
"""

from __future__ import annotations

import json
import re
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import MATH_KINDS, blocks_of, plain, python_stage
from folioframe.llm.p1_markup import CODE_KINDS, to_clean
from folioframe.llm.p4_consensus import canonical
from folioframe.llm.p6_scan import LONE_NUMBER
from folioframe.session import durable, read_table

#: Kinds whose texts end with an end mark.
SENTENCE_KINDS = ("text", "list", "footnote", "reference")
END = re.compile(r"[.!?。！？…:;](?:[\"'”’»)\]）】]|\s|￼)*$")
#: A length is a limit of an engine when this share of its texts, and this many, have exactly it.
LIMIT_SHARE, LIMIT_COUNT, LIMIT_PEAK = 0.004, 4, 6.0
#: Letters of a final token that is looked up in the trie, at most.
LONGEST = 64
#: Bits of evidence from which ``p3_method`` calls a text cut.
CUT_BITS = 3.0
#: Characters by which another reading must go on.
GOES_ON = 3


_FORMULA = re.compile(r"\$\$[^$]+\$\$|(?<!\$)\$(?=[^\s$\d])[^$\n]+\$|\\\([^\n]*?\\\)")


_OTHER = re.compile(r"[\W_]+")


def words_only(text: str) -> str:
    return _OTHER.sub("", text.casefold())


def _spots(part: str, text: str) -> list[int]:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return out


def _goes_on(short: str, long: str) -> int:
    """By how many letters and digits ``long`` goes on after the place where ``short`` stops; -1 if it
    can't be told. The last letters of ``short`` are looked for near their own distance from the start."""
    if len(long) <= len(short) // 2 or not short:
        return -1
    for size in (24, 12, 7):
        tail = short[-size:]
        if len(tail) < size and size != 7:
            continue
        spots = _spots(tail, long)
        if spots:
            at = min(spots, key=lambda i: (abs(i + len(tail) - len(short)), i))
            if abs(at + len(tail) - len(short)) <= 40 + len(short) // 6:
                return len(long) - at - len(tail)
    # misread characters: align the tail
    tail, window = short[-30:], long[max(0, len(short) - 60):len(short) + 40]
    m = SequenceMatcher(None, tail, window, autojunk=False).get_matching_blocks()
    same = sum(x.size for x in m)
    if same >= 0.75 * len(tail) and len(m) > 1:
        last = m[-2]
        after = last.b + last.size + (len(tail) - last.a - last.size)
        return len(long) - (max(0, len(short) - 60) + after)
    return -1


def _meta(text: str | None) -> tuple[bool, bool]:
    """(it says that the output ended at a limit, it says that fewer bytes were read than expected)"""
    if not text or "length" not in text and "bytes_read" not in text and "\\" not in text:
        return False, False  # nothing in it can say so
    try:
        m = json.loads(text)
    except ValueError:
        m = {}
    if not isinstance(m, dict):
        m = {}
    a, b = m.get("bytes_read"), m.get("bytes_expected")
    return m.get("finish_reason") == "length", isinstance(a, (int, float)) and isinstance(b, (int, float)) and a < b


def judge_formula(rows: list[dict]) -> list[dict]:
    out = []
    keys = [canonical(r["content"]) for r in rows]
    for r, k in zip(rows, keys):
        text = plain(r["content"])
        others = [o for o, q in zip(keys, rows) if q is not r and len(o) > len(k) and o[:len(k)] == k]
        # the last command or token may itself be cut: all but it must agree
        partly = [o for o, q in zip(keys, rows) if q is not r and len(o) > len(k) > 3 and o[:len(k) - 1] == k[:-1] and str(o[len(k) - 1]).startswith(str(k[-1]))]
        body = re.sub(r"\\[{}]", "", text)
        broken = body.count("{") > body.count("}") or len(re.findall(r"\\left\b", text)) > len(re.findall(r"\\right\b", text)) or len(re.findall(r"\\begin\b", text)) > len(re.findall(r"\\end\b", text))
        unclosed = text.count("(") > text.count(")") or (text.startswith("$") and not text.endswith("$")) or (text.startswith("\\[") and not text.endswith("\\]")) or (text.startswith("\\(") and not text.endswith("\\)"))
        dangling = bool(re.search(r"(?:[=+\-<>^_,(\\]|\\(?:le|ge|leq|geq|ne|neq|approx|sim|frac|dfrac|tfrac|hat|sqrt|int|sum|cdot|times))\s*$", text))
        limit, short = _meta(r["meta"])
        # an index or exponent that was left out at the end is an error of reading, not a cut
        rest = [o[len(k):] for o in others]
        script = bool(rest) and all(x[0] in ("_", "^") and x[-1] == "}" and x.count("{") == 1 for x in rest)
        goes = max((len(o) - len(k) for o in others + partly), default=0)
        cut = bool(
            broken
            or (goes >= 1 and (dangling or unclosed))
            or (goes >= 3 and not script)
            or (goes >= 2 and (limit or short or (r["limit"] and not script)))
            or (dangling and (limit or short or r["limit"] or len(rows) == 1 or not any(o[-1:] == k[-1:] for o, q in zip(keys, rows) if q is not r)))
            or (unclosed and (limit or short or r["limit"]))
        )
        out.append({"cut": cut, "prefix": bool(partly) or bool(r["prefix"]), "goes_on": goes, "at_limit": bool(r["limit"]), "admitted": limit or short})
    return out


def _table_cut(text: str, clean: str, others: list[str]) -> bool:
    t = text.strip()
    if re.match(r"(?is)(?:<[^>]*>\s*)*<table", t):
        return not re.search(r"(?i)</table\s*>?\s*(?:</div>)?\s*$", t)
    if "\\begin{tabular}" in t:
        return "\\end{tabular}" not in t
    if t.startswith("{|"):
        return not t.endswith("|}")
    rows = [r for r in clean.split("\n") if r.strip()]
    if t.startswith("|"):
        if not t.endswith("|"):
            return True
        n = [r.count("|") for r in t.split("\n") if r.strip()]
        if n and n[-1] < max(n):
            return True
    cells = [r.count("\t") for r in rows]
    return len(cells) > 1 and cells[-1] < max(set(cells), key=cells.count)


def judge_text(rows: list[dict], kind: str | None, block: str | None) -> list[dict]:
    # formulas within the text are slots in the block's own text; they are left out of the comparison
    cleans = [to_clean(r["content"] if kind in CODE_KINDS else _FORMULA.sub("", r["content"]) if "$" in r["content"] or "\\(" in r["content"] else r["content"], kind) for r in rows]
    plains = [plain(c) for c in cleans]
    letters = [words_only(c) for c in plains]
    lines = [x for x in (block or "").split("\n") if x.strip() and (kind in CODE_KINDS or not LONE_NUMBER.match(x.strip()) or x.strip()[-1] in ".,")]
    own = words_only(plain(re.sub(r"(?<=[^\W\d_])-[ ]*\n[ ]*", "", "\n".join(lines))))
    last_line = words_only(plain(lines[-1])) if len(lines) > 1 else ""
    out = []
    for i, r in enumerate(rows):
        text, mine = plains[i], letters[i]
        limit, short = _meta(r["meta"])
        ended = bool(END.search(text)) or not text
        siblings = [_goes_on(mine, letters[j]) for j in range(len(rows)) if j != i and letters[j] != mine]
        same = sum(1 for j in range(len(rows)) if j != i and letters[j][-12:] == mine[-12:] and abs(len(letters[j]) - len(mine)) < 40)
        from_block = _goes_on(mine, own) if own else -1
        if from_block > 0 and last_line and (from_block <= len(last_line) + 1 and ended or from_block == len(last_line) and not r["limit"] and not short and max(siblings, default=-1) <= 0):
            from_block = 0  # a running head or page number at the end of a scanned block
        goes = max([from_block, *siblings], default=-1)
        prefix = bool(r["prefix"]) and not ended
        hard = bool(r["limit"]) or short or limit
        if kind == "table":
            cut = _table_cut(r["content"], cleans[i], cleans) or (goes >= 2 and not re.search(r"(?i)</table>|\\end\{tabular\}|\|\}|\|\s*$", r["content"].strip()[-24:])) or (goes >= 6)
        elif kind in CODE_KINDS:
            cut = goes >= GOES_ON or (goes < 0 and prefix and hard)
        elif not ended:
            if goes >= 1:
                cut = goes >= GOES_ON or kind in SENTENCE_KINDS or bool(r["limit"]) or short
            elif goes == 0 or (same and not r["limit"]):
                cut = False  # the others end here too: it runs on, or needs no end mark
            elif kind in SENTENCE_KINDS:
                cut = True  # it needs an end mark, has none, and no text shows that it ends here
            else:
                cut = (prefix and hard) or bool(r["limit"])
        else:
            cut = goes >= 12 and (bool(r["limit"]) or short or limit or goes >= 20)
        out.append({"cut": bool(cut), "prefix": prefix, "goes_on": goes, "at_limit": bool(r["limit"]), "admitted": limit or short})
    return out


# ---------------------------------------------------------------- operators


def trie_nodes(words: DataFrame) -> DataFrame:
    """The vocabulary trie as a table: (node, n_word, n_longer) for every prefix of every word.

    ``words`` has (word, n). Words seen once are left out: a cut word is such a word itself.
    """
    w = words.where("n > 1")
    return (
        w.select("word", "n", F.explode(F.expr(f"transform(sequence(1, least(length(word), {LONGEST})), i -> left(word, i))")).alias("node"))
        .groupBy("node").agg(F.sum(F.when(F.col("node") == F.col("word"), F.col("n")).otherwise(0)).alias("n_word"), F.sum(F.when(F.col("node") != F.col("word"), F.col("n")).otherwise(0)).alias("n_longer"))
    )


def limits(cands: DataFrame) -> DataFrame:
    """(engine, unit, length, bits): lengths at which an engine's texts pile up, and by how many bits more
    of them have it than the lengths around it.

    Each row of the result holds at least ``LIMIT_SHARE`` of its engine's records, so that there are
    at most 1 / LIMIT_SHARE rows per engine and unit, however many records there are.
    """
    n = cands.select("engine", F.explode(F.array(
        F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")),
        F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x")).where("x.length >= 40").groupBy("engine", "x.unit", "x.length").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("engine", "unit").agg(F.sum("n").alias("all"))
    near = n.select("engine", "unit", F.explode(F.expr("sequence(length - 5, length + 5)")).alias("length"), "n").groupBy("engine", "unit", "length").agg(F.sum("n").alias("near"))
    around = (F.col("near") - F.col("n")) / 10
    return (
        n.join(total, ["engine", "unit"]).join(near, ["engine", "unit", "length"])
        .where((F.col("n") >= LIMIT_COUNT) & (F.col("n") >= LIMIT_SHARE * F.col("all")) & (F.col("n") >= LIMIT_PEAK * around))
        .select("engine", "unit", "length", F.log2(F.col("n") / F.greatest(around, F.lit(0.5))).alias("bits"))
    )


def evidence(spark: SparkSession, directory: str) -> DataFrame:
    """(paper, block, seq, prefix_bits, limit_bits) of the candidates that end in an unknown prefix or at a
    length where texts pile up. What is counted over all records travels without contents."""
    raw = filled(spark, directory)
    last = F.lower(F.regexp_extract("content", r"(\p{L}{2,})\z", 1))
    small = durable(raw.select("paper", "block", "seq", "engine", F.length("content").alias("n_chars"), F.octet_length("content").alias("n_bytes"), last.alias("last")).distinct())
    seen = raw.select(F.col("content").alias("text")).unionByName(read_table(spark, directory, "blocks").select("text"))
    vocabulary = seen.select(F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ends = small.where("last <> ''")
    nodes = trie_nodes(vocabulary).join(ends.select(F.col("last").alias("node")).distinct(), "node", "left_semi").where("n_longer > 0 and n_word * 4 < n_longer").select(F.col("node").alias("last"), F.log2((F.col("n_longer") + 1) / (F.col("n_word") + 1)).alias("bits"))
    lim = durable(limits(small))
    chars, byts = (lim.where(F.col("unit") == u).select("engine", F.col("length").alias(f"n_{u}"), F.col("bits").alias(f"at_{u}")) for u in ("chars", "bytes"))
    nothing = F.lit(0.0)
    # records without a final word don't take part in the join on it
    at_limit = small.join(F.broadcast(chars), ["engine", "n_chars"], "left").join(F.broadcast(byts), ["engine", "n_bytes"], "left").where("at_chars is not null or at_bytes is not null").select("paper", "block", "seq", nothing.alias("prefix_bits"), F.greatest("at_chars", "at_bytes").alias("limit_bits"))
    in_word = ends.join(nodes, "last").select("paper", "block", "seq", F.col("bits").alias("prefix_bits"), nothing.alias("limit_bits"))
    return at_limit.unionByName(in_word).groupBy("paper", "block", "seq").agg(F.max("prefix_bits").alias("prefix_bits"), F.max("limit_bits").alias("limit_bits"))


def filled(spark: SparkSession, directory: str) -> DataFrame:
    return read_table(spark, directory, "candidates").where(F.col("content").rlike(r"\S"))


def judged(spark: SparkSession, directory: str) -> DataFrame:
    """Every candidate with non-blank content, the evidence, and whether it is cut. Contents are shuffled
    once, by block."""
    blocks = blocks_of(spark, directory)
    flags = evidence(spark, directory).groupBy("paper", "block").agg(F.collect_list(F.struct("seq", (F.col("limit_bits") > 0).alias("limit"), (F.col("prefix_bits") > 0).alias("prefix"))).alias("flags"))
    rows = (
        filled(spark, directory).select("paper", "block", F.struct("seq", "engine", "content", "meta").alias("r")).repartition("paper", "block")
        .groupBy("paper", "block").agg(F.array_sort(F.collect_set("r")).alias("rows")).join(flags, ["paper", "block"], "left")
    )
    both = rows.join(blocks.select("paper", F.col("id").alias("block"), "kind", "text"), ["paper", "block"], "left")

    def judge(row: dict):
        flags = {f["seq"]: f for f in row["flags"] or []}
        rs = [{**r, "limit": False, "prefix": False, **flags.get(r["seq"], {})} for i, r in enumerate(row["rows"]) if not i or r["seq"] != row["rows"][i - 1]["seq"]]
        found = judge_formula(rs) if row["kind"] in MATH_KINDS else judge_text(rs, row["kind"], row["text"])
        for r, f in zip(rs, found):
            yield row["paper"], row["block"], r["seq"], r["engine"], row["kind"], f["cut"], f["prefix"], f["goes_on"], f["at_limit"], f["admitted"]

    return python_stage(both, "paper string, block string, seq int, engine string, kind string, cut boolean, unknown_prefix boolean, goes_on int, at_limit boolean, admitted boolean", judge)


def p3_method(spark: SparkSession, directory: str) -> DataFrame:
    """What trie and lengths say alone: the bits of evidence of every candidate that has any, and whether
    they suffice."""
    return evidence(spark, directory).withColumn("cut", F.col("prefix_bits") + F.col("limit_bits") >= CUT_BITS)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return judged(spark, directory).where("cut").select("paper", "block", "seq").distinct()


def p3_rates(spark: SparkSession, directory: str) -> DataFrame:
    """How often each engine cuts, and how much of that ``meta`` admits."""
    return judged(spark, directory).groupBy("engine").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("double")).alias("rate"),
        F.count_if(F.col("cut") & F.col("admitted")).alias("cut_and_admitted"), F.count_if(~F.col("cut") & F.col("admitted")).alias("admitted_only"))


QUERIES = {"p3_method": p3_method, "p3_found": p3_found, "p3_rates": p3_rates}
