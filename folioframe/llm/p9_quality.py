"""Per-document text statistics, and whether a document is prose, list, table or junk.

Method: distributions compared by Jensen-Shannon divergence. For every language a profile of
function words and of character classes is taken from all documents of that language (the bulk is
prose). A document is described by the distribution of its characters over kinds of lines, by its
function words and by its character classes; each structural profile (prose, list, table, junk)
is a distribution over the same kinds, and the nearest by divergence is assigned. Basic counts
stand beside it.

Defined results: null texts give no row; empty and blank texts are junk with zero counts; the
language column is a hint only, the nearest language profile is used; texts are read whole;
repeated texts are judged alike; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import LANGS, python_stage, spread
from folioframe.session import durable, read_table

# Frequent function words of the languages.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for on with as was be by are this from or an at not which have has had but were their its they we our each any every if so than then more because while although unless how can will may into over within without these those such no one all only near at same".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch weil wenn".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son ou aux cette mais sa comme nous été tout même ces si leur leurs après cause on sans entre malgré à d l n".split(),
    "ru": "и в не на я что он с как это по но из к у за от о же так для бы его все мы или при если то после их быть между чтобы этом кроме того до ли".split(),
    "zh": "的 了 是 在 和 有 不 这 我 也 就 对 与 可 以 为 会 及 并 且 第 个 中 上 下 而".split(),
}
CLASSES = ("lower", "upper", "han", "letter", "digit", "space", "line", "tab", "stop", "comma", "quote", "bracket", "bar", "dash", "bullet", "math", "symbol", "other")
LINES = ("sentence", "item", "row", "noise", "formula", "heading")
SHAPES = ("prose", "list", "table", "junk")
#: The kind of line that a shape is made of; formulas and headings say little either way.
MAIN = dict(zip(SHAPES, LINES))
#: A profile that few documents of a language stand for leans on the one of all languages, as if that
#: were so many documents more.
LEAN = 20.0
#: Share of the lines' kinds, of the function words and of the character classes in the divergence.
WEIGHTS = (0.6, 0.2, 0.2)
_FW = {w for ws in FUNCTION_WORDS.values() for w in ws}
_HAN = "㐀-鿿豈-﫿"
_WORDS = re.compile(rf"[{_HAN}]|[^\W\d_{_HAN}]+(?:[-'’][^\W\d_{_HAN}]+)*")
_HANS = re.compile(f"[{_HAN}]")
_BULLET = re.compile(r"\s*(?:[-*+•‣▪◦·–—]\s+|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+|\(\d{1,3}\)\s*|\[\d{1,4}\]\s+|\d+(?:\.\d+)+\.?\s+|第?[一二三四五六七八九十]+[、.]\s*)")
_TOC = re.compile(r"(?:\.\s?){4,}\s*\d+\s*$|…{2,}\s*\d+\s*$")
_CELL = re.compile(r"[-+−]?\d[\d.,]*\s*%?|n/?a|N/?A|[–—-]|")
_END = re.compile(r"[.!?。！？…][\"'”’»)\]）]*\s*$")
_JUNK = re.compile(r"\(cid:\d+\)|[■□▪▯�¿]|(?:\b[0-9a-fA-F]{2}\b\s+){6,}|[A-Za-z0-9+/]{50,}={0,2}|([^\s.])\1{11,}|(?:\\x[0-9a-f]{2}){3,}|%PDF|\bobj\b.*\bendobj\b")
_MENU = set("home next previous prev login logout search help contact about share cite menu download pdf skip content sign in register cookies privacy terms back top print email save loading more click here".split())


def js(p: dict[str, float], q: dict[str, float]) -> float:
    """Jensen-Shannon divergence in bits."""
    total, left = 0.0, sum(q.values())
    log2, get = math.log2, q.get
    for k, a in p.items():
        b = get(k, 0.0)
        if a > 0:
            if b > 0:
                left -= b
                m = (a + b) / 2
                total += a * log2(a / m) + b * log2(b / m)
            else:
                total += a
    return (total + max(0.0, left)) / 2


#: Signs that tell shapes apart are classes of their own.
_SIGNS = {c: k for k, cs in {"line": "\n\r\u2028", "tab": "\t", "stop": ".!?。！？…", "comma": ",;:，；：、", "quote": "'\"“”„’‘«»", "bracket": "()[]（）", "bar": "|&/", "dash": "-–—", "bullet": "•*‣▪◦·#", "math": "$\\^_{}=+<>~"}.items() for c in cs}


@lru_cache(maxsize=65536)
def _class(c: str) -> str:
    if c in _SIGNS:
        return _SIGNS[c]
    if c.isalpha():
        return "lower" if c.islower() else "upper" if c.isupper() else "han" if _HANS.match(c) else "letter"
    return "digit" if c.isdigit() else "space" if c.isspace() else "symbol" if c.isprintable() else "other"


_ASCII = bytes(CLASSES.index(_class(chr(i))) if i < 128 else 255 for i in range(256))
_BEYOND = re.compile(r"[^\x00-\x7f]")


def char_classes(text: str) -> dict[str, float]:
    own = text.encode("ascii", "ignore").translate(_ASCII)
    n = {k: own.count(i) for i, k in enumerate(CLASSES)}
    if len(own) < len(text):
        for c, k in Counter(_BEYOND.findall(text)).items():
            n[_class(c)] += k
    size = max(1, len(text))
    return {k: v / size for k, v in n.items()}


def function_counts(ws: list[str]) -> Counter:
    return Counter(filter(_FW.__contains__, ws))


def function_words(size: int, n: Counter) -> dict[str, float]:
    """Distribution over function words among ``size`` words; all others are one."""
    out = {w: k / max(1, size) for w, k in n.items()}
    out[""] = (size - sum(n.values())) / max(1, size)
    return out


_OF = {w: [k for k in LANGS if w in FUNCTION_WORDS[k]] for w in _FW}


def language(ws: list[str], counts: Counter | None = None) -> str:
    """The language whose function words a text has most of; of equals the first of the list."""
    n = dict.fromkeys(LANGS, 0)
    for w, c in (function_counts(ws) if counts is None else counts).items():
        for k in _OF[w]:
            n[k] += c
    return max(LANGS, key=lambda k: (n[k], -LANGS.index(k)))


_WIDE = re.compile(r"\S\s{2,}\S")


@lru_cache(maxsize=4096)
def _columns(line: str) -> int:
    """How many cells a line has as a row of a table; 0 if it is none."""
    s = line.strip()
    if "  " not in s and "\t" not in s and "|" not in s and "&" not in s and s.count(";") < 2 and s.count(",") < 2 and "---" not in s:
        return 0
    if len(s) < 300 and "---" in s and re.fullmatch(r"[\s|:+=-]*[|:+-][\s|:+=-]*", s) and len(s) > 4 and s.count("-") >= 3:
        return 99
    options = []
    if s.count("|") >= 2:
        options.append(re.split(r"\|", s.strip("|")))
    if "\t" in s:
        options.append(s.split("\t"))
    if re.search(r"\s&\s", s):
        options.append(re.split(r"(?<!\\)&", s.removesuffix("\\\\")))
    if "  " in s and _WIDE.search(s):
        options.append(re.split(r"\s{2,}", s))
    for sep in (";", ","):
        if s.count(sep) >= 2:
            options.append(s.split(sep))
    for cells in options:
        if max(map(len, cells)) > 48:
            continue
        cells = [c.strip() for c in cells]
        if len(cells) >= 2 and all(len(c.split()) <= 4 and len(c) <= 34 for c in cells) and (not s.endswith(".") or sum(bool(_CELL.fullmatch(c)) for c in cells) * 2 > len(cells)):
            return len(cells)
    return 0


def line_kinds(text: str, count: Counter | None = None) -> dict[str, float]:
    """Distribution of the characters over kinds of lines. ``count`` receives the function words,
    and under None the number of words."""
    paragraphs: list[str] = []
    text = re.sub(r"(?s)\$\$(?:(?!\n\s*\n|\$\$).)*\$\$", lambda m: m[0].replace("\n", " "), text)
    raw = [x for x in re.split(r"\r\n?|\n", text) if x.strip()]
    # lines of wrapped prose are read together
    last = ""
    for x in raw:
        if len(last) >= 45 and not _END.search(last[-40:]) and not _BULLET.match(x) and not _columns(x) and not _columns(last) and not _TOC.search(last) and (x.count(" ") > 3 or len(x.split()) > 2 or _END.search(x)):
            paragraphs[-1] += "\n" + x
        else:
            paragraphs.append(x)
        last = x
    marks: list[tuple[str, str]] = []
    widths = Counter(c for x in paragraphs if (c := _columns(x)) and c != 99)
    number_rows = sum(1 for x in paragraphs if _columns(x) and cells_with_numbers(x))
    bullets = sum(bool(_BULLET.match(x)) for x in paragraphs)
    again = len(raw) >= 4 and len({x.strip() for x in raw}) * 3 <= len(raw)
    for x in paragraphs:
        s = x.strip()
        ws = _WORDS.findall(s.lower())
        own = list(filter(_FW.__contains__, ws))
        fw = len(own) / max(1, len(ws))
        if count is not None:
            count.update(own)
            count[None] += len(ws)
        if not again and len(ws) >= 8 and fw >= 0.12 and _END.search(s[-8:]) and not _BULLET.match(s) and "|" not in s and "\t" not in s and s[0] not in "$#=" and sum(map(len, ws)) >= 0.55 * len(s) and not repeated(ws):
            marks.append(("sentence", s))  # what all later tests would say of it
            continue
        han = len(_HANS.findall(s))
        letters = sum(map(str.isalpha, s))
        if re.fullmatch(r"(?s)\$+.*\$+|\\\[.*\\\]|\\begin\{(?:equation|align).*", s):
            kind = "formula"
        elif _TOC.search(s) and letters >= 4:
            kind = "item"
        elif sum(map(str.isalnum, s)) < 0.4 * len(re.sub(r"\s", "", s)) and _columns(s) != 99:
            kind = "noise"
        elif torn(s) or _JUNK.search(s) or letters < 0.35 * len(s.replace(" ", "")) and not _columns(s) and not _TOC.search(s) and not _BULLET.match(s):
            kind = "noise"
        elif again or menu(s) or repeated(ws):
            kind = "noise"
        elif re.match(r"#{1,6}\s|={2,}\s*\S.*=+$|(?:Table|Tabelle|Tableau|Таблица|Fig(?:ure|\.)?|表)\s*\d+", s) and len(s) < 140:
            kind = "heading"
        elif 3 <= _columns(s) < 99 and widths[_columns(s)] >= 2 and cells_with_numbers(s) and not s[0].isdigit():
            kind = "row"
        elif _BULLET.match(s) and (bullets >= 2 or len(paragraphs) == 1):
            kind = "item"
        elif (c := _columns(s)) and (c == 99 or (number_rows >= 1 or "|" in s or "\t" in s or "&" in s) and (widths[c] >= 2 or number_rows >= 2)) and not (fw > 0.3 and _END.search(s)):
            kind = "row"
        elif han >= 6 and re.search(r"[。！？；]", s) or _END.search(s) and len(ws) >= 4 and (fw >= 0.08 or readable(ws)):
            kind = "sentence"
        elif len(ws) >= 12 and fw >= 0.12 or han >= 20 and fw >= 0.05:
            kind = "sentence"
        elif unreadable(s, ws):
            kind = "noise"
        elif len(ws) > 14 and fw < 0.04:
            kind = "noise"  # a string of terms
        elif len(paragraphs) >= 3 and len(ws) <= 12:
            kind = "item" if sum(len(p.split()) <= 8 for p in paragraphs) >= 0.7 * len(paragraphs) else "heading"
        elif len(ws) <= 12 and len(s) < 120 and ws:
            kind = "heading"
        else:
            kind = "noise" if fw < 0.05 and not _END.search(s) else "sentence"
        marks.append((kind, s))
    # a first line such as "References" or "Contents" belongs to what follows
    size = Counter()
    for k, s in marks:
        size[k] += len(s)
    total = sum(size.values())
    return {k: size[k] / total for k in LINES} if total else {"noise": 1.0}


def cells_with_numbers(s: str) -> int:
    return sum(bool(_CELL.fullmatch(c.strip())) and c.strip() != "" for c in re.split(r"[|\t;,&]|\s{2,}", s))


def torn(s: str) -> bool:
    """Letters set apart: most tokens are single letters."""
    t = s.split()
    return len(t) >= 8 and sum(len(x) == 1 for x in t) >= 0.7 * len(t) and not _HANS.search(s)


def menu(s: str) -> bool:
    cells = [c.strip().lower() for c in re.split(r"[|»›·/]", s) if c.strip()]
    return len(cells) >= 4 and sum(all(w in _MENU for w in c.split()) for c in cells) >= 0.6 * len(cells)


def repeated(ws: list[str]) -> bool:
    return len(ws) >= 6 and len(set(ws)) <= max(1, len(ws) // 6) or len(ws) >= 2 and len(set(ws)) == 1 and ws[0] in _MENU


def unreadable(s: str, ws: list[str]) -> bool:
    """Words without vowels, or letters mixed with digits and signs."""
    latin = [w for w in ws if re.fullmatch(r"[a-zäöüßéèêàç]+", w)]
    if len(latin) >= 4 and sum(not re.search(r"[aeiouyäöüéèêà]", w) for w in latin) >= 0.5 * len(latin):
        return True
    t = s.split()
    mixed = sum(bool(re.search(r"[^\W\d_]", x) and re.search(r"[\d!|\\/<>@#$%^&*_=+~]", x.strip(".,;:()"))) for x in t)
    return len(t) >= 6 and mixed >= 0.4 * len(t)


def readable(ws: list[str]) -> bool:
    return sum(len(w) > 2 for w in ws) >= 0.5 * len(ws) and len(set(ws)) >= 0.5 * len(ws)


def features(text: str) -> tuple[str, dict[str, float], dict[str, float], dict[str, float]]:
    """(language, distribution over kinds of lines, over function words, over character classes)"""
    fws: Counter = Counter()
    kinds = line_kinds(text, fws)
    size = fws.pop(None, 0)
    firm = sum(kinds.get(MAIN[s], 0.0) for s in SHAPES)
    if firm > 0:  # formulas and headings beside other lines do not decide
        kinds = {k: kinds.get(k, 0.0) / firm for k in MAIN.values()}
    return language([], fws), kinds, function_words(size, fws), char_classes(text)


def seed(kinds: dict[str, float]) -> str:
    """The shape that a document stands for when profiles are taken: the one of most of its lines."""
    return max(SHAPES, key=lambda s: (kinds.get(MAIN[s], 0.0), s == "prose"))


class Profiles:
    """Structural profiles of each language: the mean distributions of the documents that stand for a shape."""

    def __init__(self, totals: dict[tuple[str, str, str, str], float]):
        """totals: (language, shape, what, key) -> sum over documents; what is k, w, c, or n for their number."""
        self.totals = totals
        every: Counter = Counter()
        for (_, s, what, key), n in totals.items():
            every[s, what, key] += n
        self.of: dict[tuple[str, str], tuple[dict, dict, dict]] = {}
        mean = {s: tuple(self._share(every, (s,), what) for what in "kwc") for s in SHAPES}
        for lang in sorted({k[0] for k in totals}) + [""]:
            for s in SHAPES:
                n = totals.get((lang, s, "n", ""), 0.0)
                own = tuple(self._share(totals, (lang, s), what) for what in "kwc")
                self.of[lang, s] = tuple({k: (n * o.get(k, 0.0) + LEAN * m.get(k, 0.0)) / (n + LEAN) for k in {*o, *m}} for o, m in zip(own, mean[s]))
        self.known = {s for s in SHAPES if every[s, "n", ""]}

    @staticmethod
    def _share(totals: dict, head: tuple, what: str) -> dict[str, float]:
        part = {k[-1]: n for k, n in totals.items() if k[:-2] == head and k[-2] == what and n > 0}
        total = sum(part.values())
        return {k: n / total for k, n in part.items()}

    def far(self, lang: str | None, kinds: dict, words: dict, classes: dict) -> dict[str, tuple[float, float, float]]:
        """Divergence from each shape's profile: of kinds of lines, function words and character classes."""
        at = lang if (lang, "prose") in self.of else ""
        return {s: tuple(js(x, y) for x, y in zip((kinds, words, classes), self.of[at, s])) if s in self.known else (1.0, 1.0, 1.0) for s in SHAPES}


def nearest(far: dict[str, float]) -> str:
    return min(SHAPES, key=lambda s: (round(far[s], 12), s != "prose"))


# ---------------------------------------------------------------- operators


def measured(docs: DataFrame) -> DataFrame:
    """The distributions of every document, read and cut into words once, and written once. A row without
    ``doc_id`` holds the sums of one task, from which the profiles are taken: all documents count, labelled
    with a language or not (the language is that of the function words)."""

    def run(batches):
        import pyarrow as pa

        totals: Counter = Counter()
        shares = pa.list_(pa.float64())
        types = (pa.int64(), pa.string(), shares, pa.list_(pa.string()), shares, shares, pa.map_(pa.string(), pa.float64()))
        names = ["doc_id", "language", "kinds", "words", "shares", "classes", "totals"]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                rows = []
                for d, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text.strip():
                        rows.append((d, None, [], [], [], [], None))
                        continue
                    lang, kinds, fws, classes = features(text)
                    s = seed(kinds)
                    totals[lang, s, "n", ""] += 1
                    for what, x in (("k", kinds), ("w", fws), ("c", classes)):
                        for k, n in x.items():
                            totals[lang, s, what, k] += n
                    rows.append((d, lang, [kinds.get(k, 0.0) for k in LINES], list(fws), list(fws.values()), [classes[c] for c in CLASSES], None))
                if rows:
                    yield out(rows)
        if totals:
            yield out([(*[None] * 6, [("\t".join(k), n) for k, n in sorted(totals.items())])])

    source = spread(docs.select("doc_id", "text")).where("doc_id is not null and text is not null")
    return durable(source.mapInArrow(run, "doc_id long, language string, kinds array<double>, words array<string>, shares array<double>, classes array<double>, totals map<string,double>"))


def profiles_of(rows: DataFrame) -> Profiles:
    """Profiles from the tasks' sums: one number per language, shape and key comes to the driver."""
    got = rows.where("totals is not null").select(F.explode("totals")).groupBy("key").agg(F.sum("value").alias("n")).collect()
    return Profiles({tuple(r["key"].split("\t")): r["n"] for r in got})


def judged(docs: DataFrame) -> DataFrame:
    """Every document's divergence from each structural profile of its language, and the nearest one."""
    rows = measured(docs)
    profiles = profiles_of(rows)

    def judge(row: dict):
        if not row["kinds"]:
            yield row["doc_id"], "junk", "junk", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0
            return
        kinds, words, classes = dict(zip(LINES, row["kinds"])), dict(zip(row["words"], row["shares"])), dict(zip(CLASSES, row["classes"]))
        parts = profiles.far(row["language"], kinds, words, classes)
        far = {s: sum(w * x for w, x in zip(WEIGHTS, parts[s])) for s in SHAPES}
        plain = {s: parts[s][1] + parts[s][2] for s in SHAPES}
        yield row["doc_id"], nearest(far), nearest(plain), row["language"], parts["prose"][1], parts["prose"][2], *(far[s] for s in SHAPES)

    return python_stage(
        rows.where("doc_id is not null").select("doc_id", "language", "kinds", "words", "shares", "classes"),
        "doc_id long, shape string, by_words_and_classes string, language string, word_js double, class_js double, far_prose double, far_list double, far_table double, far_junk double", judge)


def p9_method(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's nearest structural profile by function words and character classes alone, without
    the kinds of lines, and its divergence from its language's prose."""
    d = judged(read_table(spark, directory, "documents"))
    return d.select("doc_id", "language", "word_js", "class_js", F.col("by_words_and_classes").alias("shape"))


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    return judged(read_table(spark, directory, "documents")).where("shape <> 'prose'").select("doc_id", "shape").distinct()


def p9_shapes(spark: SparkSession, directory: str) -> DataFrame:
    """Every document's shape with the divergences behind it."""
    return judged(read_table(spark, directory, "documents"))


#: Words that count as common, a score of each language.
COMMON = tuple(dict.fromkeys(w for k in LANGS for w in FUNCTION_WORDS[k][:20]))


def p9_stats(spark: SparkSession, directory: str) -> DataFrame:
    """Basic counts, in the JVM alone. Words are runs of letters of any script; a Chinese character is one."""
    d = read_table(spark, directory, "documents").where("text is not null").select("doc_id", "text")
    parts = d.select(
        "doc_id", F.length("text").alias("n_chars"),
        F.regexp_extract_all(F.lower("text"), F.lit(r"\p{IsHan}|[\p{L}&&[^\p{IsHan}]]+"), F.lit(0)).alias("ws"),
        F.expr(r"filter(split(text, '\n'), x -> trim(x) <> '')").alias("ls"),
        F.length(F.regexp_replace("text", r"[\p{L}\p{N}\p{M} \n]", "")).alias("n_symbols"),
    )
    return parts.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), F.size("ws").cast("bigint").alias("n_words"),
        F.when(F.size("ws") > 0, F.round(F.expr("aggregate(ws, 0L, (s, w) -> s + length(w))") / F.size("ws"), 6)).alias("mean_word_length"),
        F.when(F.col("n_chars") > 0, F.round(F.col("n_symbols") / F.col("n_chars"), 6)).alias("symbol_ratio"),
        F.size("ls").cast("bigint").alias("n_lines"),
        F.when(F.size("ls") > 0, F.round(F.expr("size(filter(ls, x -> rlike(rtrim(x), '[.!?:;。！？…]$')))") / F.size("ls"), 6)).alias("ended_lines"),
        F.when(F.size("ws") > 0, F.round(F.size(F.filter("ws", lambda w: w.isin(*COMMON))) / F.size("ws"), 6)).alias("common_words"),
    )


P9_STATS_SQL = f"""
WITH d AS (SELECT doc_id, text, length(text) AS n_chars, regexp_extract_all(lower(text), '\\p{{Han}}|[^\\P{{L}}\\p{{Han}}]+') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, length(regexp_replace(text, '[\\p{{L}}\\p{{N}}\\p{{M}} \\n]', '', 'g')) AS n_symbols
  FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(len(ws) AS BIGINT) AS n_words,
  CASE WHEN len(ws) > 0 THEN round(list_sum(list_transform(ws, lambda w: length(w))) / len(ws), 6) END AS mean_word_length,
  CASE WHEN n_chars > 0 THEN round(n_symbols / n_chars, 6) END AS symbol_ratio, CAST(len(ls) AS BIGINT) AS n_lines,
  CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[.!?:;。！？…]$'))) / len(ls), 6) END AS ended_lines,
  CASE WHEN len(ws) > 0 THEN round(len(list_filter(ws, lambda w: w IN ({", ".join(f"'{w}'" for w in COMMON)}))) / len(ws), 6) END AS common_words
FROM d"""

QUERIES = {"p9_method": p9_method, "p9_found": p9_found, "p9_shapes": p9_shapes, "p9_stats": p9_stats}
ORACLE = {"p9_stats": P9_STATS_SQL}
