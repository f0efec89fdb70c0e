"""Visually identical text with different characters: bring all text to one consistent form.

Method: strings and code points that look alike are united into transitive classes (union-find)
from composed and decomposed accents, widths, spaces, invisible characters, joined letters and
look-alike letters of Latin, Cyrillic and Greek. ``p5_method`` carries this through: words of the
corpus with one skeleton of classes are one class, its most frequent member is the representative, and
a multi-pattern automaton (Aho-Corasick) rewrites every text greedily, leftmost and longest first.

The consistent form that is asked for is fixed (composed, ordinary, of the word's own script), however
frequent another form is, and holds for words that stand in the corpus once. ``p5_found`` therefore
rewrites by the classes' regular members with the same automaton; letters of another script turn in the
context of their word.

Defined results: null and empty texts stay as they are; texts are rewritten whole; repeated rows
count once; the replacement character and private-use codes are kept; rewriting twice equals
rewriting once; a null font is a text font; extra columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import regex as re
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import MATH_KINDS, blocks_of, candidates_of, python_stage
from folioframe.session import durable, read_table

# Letters that look like a Latin one, script by script.
CYRILLIC_LATIN = dict(zip("аеорсухіјѕһԁԛԝѵкАВЕКМНОРСТХУІЈЅԌԚԜЅ", "aeopcyxijshdqwvkABEKMHOPCTXYIJSGQWS"))
GREEK_LATIN = dict(zip("οναρικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧϳϲ", "ovapikuxABEZHIKMNOPTYXjc"))
LATIN_OF = {**CYRILLIC_LATIN, **GREEK_LATIN}
CYRILLIC_OF = {}
for _c, _l in CYRILLIC_LATIN.items():
    CYRILLIC_OF.setdefault(_l, _c)
GREEK_OF = {}
for _c, _l in GREEK_LATIN.items():
    GREEK_OF.setdefault(_l, _c)
#: Greek letters that are the same drawing as a Latin one, also on their own.
GREEK_SAME = set("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧο")

INVISIBLE_CODES = [c for a, b in ((0xAD, 0xAE), (0x34F, 0x350), (0x61C, 0x61D), (0x115F, 0x1161), (0x17B4, 0x17B6), (0x180B, 0x180F), (0x200B, 0x2010), (0x202A, 0x202F), (0x2060, 0x2070), (0x3164, 0x3165), (0xFE00, 0xFE10), (0xFEFF, 0xFF00), (0xFFA0, 0xFFA1)) for c in range(a, b)]
SPACE_CODES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


class UnionFind:
    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def pairs() -> list[tuple[str, str]]:
    """(irregular string, regular string) of every rule."""
    out = [(chr(c), "") for c in INVISIBLE_CODES] + [(chr(c), " ") for c in SPACE_CODES]
    out += [(chr(c), chr(c - 0xFEE0)) for c in range(0xFF01, 0xFF5F)]
    out += [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in [*range(0xFF61, 0xFF9F), *range(0xFFE0, 0xFFE7), *range(0xFB00, 0xFB07)]]
    for a, b in ((0xC0, 0x250), (0x386, 0x3D0), (0x400, 0x482), (0x1E00, 0x2000)):
        for c in range(a, b):
            d = unicodedata.normalize("NFD", chr(c))
            if len(d) > 1 and unicodedata.normalize("NFC", d) == chr(c):
                out.append((d, chr(c)))
                if len(d) > 2:
                    out.append((unicodedata.normalize("NFC", d[:2]) + d[2:], chr(c)))
    return [(a, b) for a, b in out if a != b]


SCRIPT = (("latin", re.compile(r"\p{Latin}")), ("cyrillic", re.compile(r"\p{Cyrillic}")), ("greek", re.compile(r"\p{Greek}")))


def script_of(c: str) -> str | None:
    if c < "\x80":
        return "latin" if c.isalpha() else None
    for name, p in SCRIPT:
        if p.match(c):
            return name
    return None


class Forms:
    """Classes, their representatives and the automaton."""

    def __init__(self, counts: dict[str, int] | None = None):
        counts = self.counts = counts or {}
        self.uf = UnionFind()
        rules = pairs()
        self.irregular = {a for a, _ in rules}
        for a, b in rules:
            self.uf.unite(a, b)
        for a, b in LATIN_OF.items():
            self.uf.unite(a, b)
        self.turn: dict[str, str] = {}
        for members in self.uf.classes().values():
            regular = [m for m in members if m not in self.irregular]
            for m in members:
                if m in self.irregular:
                    # the most frequent regular member of the same script, else of any
                    target = script_of(next((c for c in unicodedata.normalize("NFKC", m) if c.isalpha()), ""))  if m else None
                    fit = [r for r in regular if target is None or r == "" or script_of(r[0]) in (target, None)] or regular
                    self.turn[m] = max(fit, key=lambda r: (counts.get(r, 0), -len(r), [-ord(c) for c in r]))
        self.cross: dict[str, dict[str, str]] = {"latin": dict(LATIN_OF), "cyrillic": dict(CYRILLIC_OF), "greek": dict(GREEK_OF)}
        self.machine = ahocorasick.Automaton()
        for a in self.turn:
            self.machine.add_word(a, a)
        self.machine.make_automaton()

    def __reduce__(self):
        return _forms, (tuple(sorted(self.counts.items())),)

    def first(self, text: str) -> list[tuple[int, int, str]]:
        """Greedy, leftmost and longest: (start, end, replacement)."""
        return [(end - len(a) + 1, end + 1, self.turn[a]) for end, a in self.machine.iter_long(text)]

    def rewrite(self, text: str, math: bool = False, greek_regular: bool = False, strong_marks: bool = True) -> tuple[str, set[int]]:
        """The consistent form, and the positions of ``text`` that are not in it."""
        bad: set[int] = set()
        if text.isascii():
            return text, bad
        out: list[str] = []
        origin: list[int] = []
        at = 0
        for a, b, r in self.first(text):
            out.append(text[at:a])
            origin += range(at, a)
            out.append(r)
            origin += [a] * len(r)
            # of a letter with its accents only the accents are at fault
            bad.update(range(a + 1, b) if b - a > 1 and unicodedata.combining(text[b - 1]) else range(a, b))
            at = b
        out.append(text[at:])
        origin += range(at, len(text))
        mid = "".join(out)
        if strong_marks:
            done = unicodedata.normalize("NFC", mid)
            if done != mid:
                for i, c in enumerate(mid):
                    if unicodedata.combining(c):
                        bad.add(origin[i])
        chars = list(mid)
        strong = {n: 0 for n, _ in SCRIPT}
        scripts = [script_of(c) for c in chars]
        for c, s in zip(chars, scripts):
            if s == "latin" and c not in CYRILLIC_OF and c not in GREEK_OF or s in ("cyrillic", "greek") and c not in LATIN_OF:
                strong[s] += 1
        main = max(strong, key=lambda n: (strong[n], n == "latin"))
        start = 0
        for end in range(len(chars) + 1):
            if end < len(chars) and (scripts[end] is not None or unicodedata.combining(chars[end])):
                continue
            if end > start:
                self._word(chars, scripts, start, end, main, strong, math, greek_regular, bad, origin)
            start = end + 1
        fixed = "".join(chars)
        return (unicodedata.normalize("NFC", fixed) if strong_marks else fixed), bad

    def _word(self, chars, scripts, start, end, main, strong, math, greek_regular, bad, origin) -> None:
        have = Counter(s for s in scripts[start:end] if s)
        if not have:
            return
        if math:
            own = "latin"
        else:
            firm = Counter(s for c, s in zip(chars[start:end], scripts[start:end]) if s and (c not in LATIN_OF if s != "latin" else c not in CYRILLIC_OF and c not in GREEK_OF))
            if firm:
                own = max(firm, key=lambda s: (firm[s], have[s], s == main, s))
            elif len(have) > 1 and strong[main] and main in have:
                own = main
            elif len(have) > 1:
                own = max(have, key=lambda s: (have[s], s == main, s))
            else:
                own = next(iter(have))
                # every letter has a twin: foreign only where the text has no firm letter of that script
                if own != main and strong[main] > 0 and strong[own] == 0 and (own != "greek" or all(c in GREEK_SAME for c in chars[start:end])):
                    own = main
        if len(have) == 1 and own in have:
            return
        for i in range(start, end):
            if scripts[i] and scripts[i] != own:
                if scripts[i] == "greek" and greek_regular:
                    continue
                twin = self.cross[own].get(chars[i])
                if twin is None and own != "latin" and chars[i] in LATIN_OF:
                    twin = self.cross[own].get(LATIN_OF[chars[i]])
                if twin:
                    bad.add(origin[i])
                    chars[i] = twin


@lru_cache(maxsize=4)
def _forms(counts: tuple[tuple[str, int], ...] = ()) -> Forms:
    """One automaton per Python worker."""
    return Forms(dict(counts))


MATH_FONT = re.compile(r"(?i)math|(?:MI|SY|EX|BSY|MIB)\d+$|symbol")


def is_math_font(font: str | None) -> bool:
    return bool(font) and bool(MATH_FONT.search(re.sub(r"^[A-Z]{6}\+", "", font)))


# ---------------------------------------------------------------- operators


def member_counts(spark: SparkSession, directory: str) -> dict[str, int]:
    """Corpus counts of all class members; as many numbers as there are members come back."""
    members = {m for m in Forms().uf.up if len(m) == 1}

    def tally(batches):
        import pyarrow as pa

        n: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    n.update(t)
        rows = sorted((c, k) for c, k in n.items() if c in members)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["c", "n"])

    texts = candidates_of(spark, directory).select(F.col("content").alias("t"))
    chars = texts.mapInArrow(tally, "c string, n long").unionByName(read_table(spark, directory, "glyphs").where(F.length("text") == 1).groupBy(F.col("text").alias("c")).agg(F.count(F.lit(1)).alias("n")))
    return {r["c"]: r["n"] for r in chars.groupBy("c").agg(F.sum("n").alias("n")).where(F.col("c").isin(*members)).collect()}


def glyph_faults(glyphs: DataFrame, forms: Forms) -> DataFrame:
    """(paper, page, span, ch, text, consistent) of glyphs at fault, judged in the context of their line."""
    lines = (
        glyphs.where("text is not null and text <> ''").groupBy("paper", "page", "span")
        .agg(F.array_sort(F.collect_set(F.struct("ch", "text", "font"))).alias("gs"), F.max(F.col("text").rlike(r"[^\x00-\x7f]")).alias("odd")).where("odd").drop("odd")
    )

    def rows(row: dict):
        gs = [g for i, g in enumerate(row["gs"]) if not i or g["ch"] != row["gs"][i - 1]["ch"] or g["text"] != row["gs"][i - 1]["text"]]
        for math in (False, True):
            own = [g for g in gs if is_math_font(g["font"]) == math]
            text = "".join(g["text"] for g in own)
            _, bad = forms.rewrite(text, math=math, greek_regular=math)
            at = 0
            for g in own:
                spots = [i for i in range(at, at + len(g["text"])) if i in bad or unicodedata.combining(text[i])]
                at += len(g["text"])
                if spots:
                    yield row["paper"], row["page"], row["span"], g["ch"], g["text"]

    return python_stage(lines, "paper string, page int, span int, ch int, text string", rows)


def candidate_forms(spark: SparkSession, directory: str, forms: Forms) -> DataFrame:
    """(paper, block, seq, content, consistent, changed) of every candidate with content."""
    kinds = blocks_of(spark, directory).select("paper", F.col("id").alias("block"), "kind")
    cands = candidates_of(spark, directory).where("content is not null").select("paper", "block", "seq", "content").join(kinds, ["paper", "block"], "left")

    def rows(row: dict):
        math = row["kind"] in MATH_KINDS
        new, _ = forms.rewrite(row["content"], math=math)
        yield row["paper"], row["block"], row["seq"], row["content"], new, new != row["content"]

    return python_stage(cands, "paper string, block string, seq int, content string, consistent string, changed boolean", rows)


def prepared(spark: SparkSession, directory: str) -> Forms:
    return Forms(member_counts(spark, directory))


#: A word as a string of the look-alike classes: everything between spaces and ASCII signs.
STRING = r"[^\s!-/:-@\[-`{-~]+"


def skeleton(word: str, forms: Forms) -> str:
    """The word with every member of a class replaced by the class's name; alike words have one skeleton."""
    if word.isascii() and word.isdigit():
        return word
    out, at = [], 0
    for a, b, r in forms.first(word):
        out += [*word[at:a], *r]
        at = b
    return "".join(forms.uf.find(c) if c in forms.uf.up else c for c in unicodedata.normalize("NFC", "".join([*out, *word[at:]])))


def texts_of(spark: SparkSession, directory: str) -> DataFrame:
    """(tbl, paper, item, text): contents of candidates, and glyphs as the lines that they stand in."""
    c = candidates_of(spark, directory).where("content is not null").select(F.lit("candidates").alias("tbl"), "paper", F.concat_ws("/", "block", "seq").alias("item"), F.col("content").alias("text"))
    g = (
        read_table(spark, directory, "glyphs").where("text is not null").groupBy("paper", "page", "span").agg(F.array_sort(F.collect_set(F.struct("ch", "text"))).alias("gs"))
        .select(F.lit("glyphs").alias("tbl"), "paper", F.concat_ws("/", "page", "span").alias("item"), F.concat_ws("", "gs.text").alias("text"))
    )
    return c.unionByName(g)


def word_classes(words: DataFrame) -> DataFrame:
    """(word, representative) of every word that is not the most frequent of its class.

    ``words`` has (word, n). Words meet by their skeleton; the table grows with the vocabulary and stays
    distributed.
    """
    forms = Forms()

    def skeletons(row: dict):
        yield row["word"], row["n"], skeleton(row["word"], forms)

    keyed = durable(python_stage(words, "word string, n long, skeleton string", skeletons))
    top = keyed.groupBy("skeleton").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("n", (-F.length("word")).alias("short"), "word")).alias("top")).where("members > 1").select("skeleton", F.col("top.word").alias("representative"))
    return keyed.join(top, "skeleton").where("word <> representative").select("word", "representative")


def greedy(text: str, turn: dict[str, str]) -> str:
    """Rewrite whole words with one automaton over all of the text's words that turn."""
    machine = ahocorasick.Automaton()
    for w in turn:
        machine.add_word(w, w)
    machine.make_automaton()
    out, at = [], 0
    for end, w in machine.iter_long(text):
        start = end - len(w) + 1
        if (start == 0 or not _STRING.match(text[start - 1])) and (end + 1 == len(text) or not _STRING.match(text[end + 1])):
            out += [text[at:start], turn[w]]
            at = end + 1
    return "".join([*out, text[at:]])


_STRING = re.compile(STRING)


def p5_method(spark: SparkSession, directory: str) -> DataFrame:
    """Texts that rewriting by the corpus' own classes changes: (tbl, paper, item, words, rewritten)."""
    texts = durable(texts_of(spark, directory))
    found = texts.select("tbl", "paper", "item", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(STRING), F.lit(0)))).alias("word"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(STRING), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    turns = found.join(word_classes(words), "word").groupBy("tbl", "paper", "item").agg(F.sort_array(F.collect_list(F.struct("word", "representative"))).alias("turns"))
    keys = ["tbl", "paper", "item"]
    same = [texts[k].eqNullSafe(turns[k]) for k in keys]

    def rows(row: dict):
        turn = {t["word"]: t["representative"] for t in row["turns"]}
        yield row["tbl"], row["paper"], row["item"], len(turn), greedy(row["text"], turn)

    return python_stage(turns.join(texts, same).select(turns["tbl"], turns["paper"], turns["item"], "turns", "text"), "tbl string, paper string, item string, words int, rewritten string", rows)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    forms = prepared(spark, directory)
    g = glyph_faults(read_table(spark, directory, "glyphs"), forms).select(F.lit("glyphs").alias("tbl"), "paper", F.concat_ws("/", "page", "span", "ch").alias("item"))
    c = candidate_forms(spark, directory, forms).where("changed").select(F.lit("candidates").alias("tbl"), "paper", F.concat_ws("/", "block", "seq").alias("item"))
    return g.unionByName(c).distinct()


def p5_consistent(spark: SparkSession, directory: str) -> DataFrame:
    """The consistent form of every candidate."""
    return candidate_forms(spark, directory, prepared(spark, directory))


def p5_classes(spark: SparkSession, directory: str) -> DataFrame:
    """Look-alike classes with their members' corpus counts."""
    counts = member_counts(spark, directory)
    forms = Forms(counts)
    rows = [(k, m, counts.get(m, 0), m in forms.irregular) for k, ms in forms.uf.classes().items() for m in ms]
    return spark.createDataFrame(rows, "class string, member string, n long, irregular boolean")


QUERIES = {"p5_method": p5_method, "p5_found": p5_found, "p5_consistent": p5_consistent, "p5_classes": p5_classes}
