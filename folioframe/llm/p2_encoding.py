"""Garbled glyph text: find glyphs whose mapped text a wrong decoding made, and restore them.

Method: minimum description length. For every line (span) each candidate chain of decodings is
undone glyph by glyph, and the result is compressed with one zstandard dictionary per language;
the chain with the shortest description, its own cost included, wins, otherwise the line stays
as it is. Gains are summed over all lines of a paper's font, and a chain that the font supports
costs less in each of its lines, so that short lines are decided with the whole font's evidence. Every
line counts for or against each chain, against it by ``SET_APART`` bytes at most.

Defined results: glyphs without ``mapped_text`` are never cases; null keys are kept as a group of
their own; of repeated or conflicting rows of one glyph the smallest ``mapped_text`` counts;
``suspicious_encoding`` is not consulted; strings of 40 characters and more between spaces are no words of a
dictionary; extra columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import LANGS, python_stage
from folioframe.session import durable, read_table

#: Words per language in a dictionary. This bounds the model that is sent to the executors.
DICTIONARY_WORDS = 6000
#: Bytes that one surprise in a word's spelling takes.
IRREGULAR = 1.5
_ACCENTED = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]*[À-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]*")
#: Bytes that a line must save before it is changed.
LEAST_GAIN = 2.0
#: Bytes by which a line counts against its font's chain at most: what it takes to set the line apart as genuine.
SET_APART = 12.0
# Names of encodings. (written in, read as)
WESTERN = ("cp1252", "mac_roman", "cp437", "cp850")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
UTF8_READ_AS = ("cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_15")
MULTIBYTE = ("gb18030", "big5", "shift_jis", "euc_jp", "euc_kr")


def chains() -> dict[str, tuple[tuple[tuple[str, str], ...], float]]:
    """name -> (steps (written in, read as) in the order in which they garbled, cost in bytes)."""
    out: dict = {}

    def add(cost: float, *steps: tuple[str, str]) -> None:
        out[">".join(f"{a}:{b}" for a, b in steps)] = (steps, cost)

    for d in UTF8_READ_AS:
        add(2.0, ("utf_8", d))
    for d in ("cp1252", "latin_1", "cp1251", "mac_roman", "cp1250"):
        add(3.0, ("utf_8", d), ("utf_8", d))
    for a, b in (("cp1252", "latin_1"), ("latin_1", "cp1252"), ("cp1252", "cp1251"), ("cp1251", "cp1252")):
        add(4.0, ("utf_8", a), ("utf_8", b))
    for group in (WESTERN, CYRILLIC):
        for a in group:
            for b in group:
                if a != b:
                    add(3.0, (a, b))
    for a in CYRILLIC:
        for b in ("cp1252", "latin_1", "mac_roman", "cp437"):
            add(3.0, (a, b))
    for a in ("cp1252", "mac_roman"):
        for b in ("cp1250", "cp1251", "koi8_r", "cp866"):
            add(3.0, (a, b))
    add(3.0, ("cp1250", "cp1252"))
    for a in MULTIBYTE:
        for b in ("cp1252", "latin_1", "cp1251"):
            add(3.0, (a, b))
    return out


CHAINS = chains()


def _write(m: str, encoding: str) -> bytes:
    """Encode; a control character below U+00A0 stands for the byte that had no meaning."""
    try:
        return m.encode(encoding)
    except UnicodeError:
        return b"".join(bytes([ord(c)]) if 0x80 <= ord(c) < 0xA0 else c.encode(encoding) for c in m)


def garble(c: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """What the chain makes of a character; a byte without a meaning becomes U+FFFD."""
    for a, b in steps:
        try:
            c = c.encode(a).decode(b, "replace")
        except UnicodeError:
            return None
    return c


def undo(m: str, steps: tuple[tuple[str, str], ...]) -> str | None:
    """The single character that the chain turned into ``m``, if bytes tell it."""
    for a, b in reversed(steps):
        try:
            m = _write(m, b).decode(a)
        except UnicodeError:
            return None
    return m if len(m) == 1 and (m.isprintable() or m in " \xad\u200b") and (m < "\u0100" or unicodedata.category(m) not in ("Co", "Cc", "Cn", "So", "Sm")) else None


class Model:
    """Per-language dictionaries, and the chains' inverses over the characters that texts use."""

    def __init__(self, vocabulary: dict[str, list[str]]):
        self.vocabulary = vocabulary
        self.known = {w for ws in vocabulary.values() for w in ws}
        self.lower = {w.strip("\"'“”„‘’«»()[].,;:!?…").lower() for w in self.known}
        self.joined = "\n" + "\n".join(w for ws in vocabulary.values() for w in ws) + "\n"
        self.packers = None
        letters = {c for ws in vocabulary.values() for w in ws for c in w if c > "\x7f"}
        letters |= {chr(x) for a, b in ((0xA0, 0x180), (0x2010, 0x2045), (0x401, 0x452), (0x391, 0x3CA)) for x in range(a, b)} | set("€™")
        #: chain -> garbled text with a lost byte -> the characters that it may have been
        self.lost: dict[str, dict[str, list[str]]] = {}
        for name, (steps, _) in CHAINS.items():
            table: dict[str, list[str]] = {}
            for c in sorted(letters):
                m = garble(c, steps)
                if m and m != c and "�" in m and len(m) > 1:
                    table.setdefault(m, []).append(c)
            self.lost[name] = table

    def __getstate__(self):
        return {"vocabulary": self.vocabulary}

    def __setstate__(self, state):
        self.__init__(state["vocabulary"])

    def cost(self, text: str) -> float:
        """Bytes of the description: the dictionary coder's, and those that irregular spelling takes."""
        return self.size(text) + IRREGULAR * sum(map(self.irregular, _ACCENTED.findall(text)))

    def irregular(self, word: str) -> float:
        """Surprises in an unknown word with accented Latin letters: each such letter, a capital after a
        small letter, and a letter on its own. A coder of bytes does not see them."""
        if word in self.known or word.lower() in self.lower:
            return 0.0
        odd = sum(c > "\x7f" for c in word)
        return 0.5 * odd + sum(a.islower() and b.isupper() for a, b in zip(word, word[1:])) + (len(word) == 1)

    def options(self, m: str) -> dict[str, str]:
        """chain -> character, for the chains that may have produced the glyph text ``m``."""
        return _options(self, m)

    def size(self, text: str) -> int:
        """Bytes of the shortest description over the languages. UTF-16, so that no script is dearer."""
        if self.packers is None:
            self.packers = []
            for ws in self.vocabulary.values():
                raw = (" ".join(reversed(ws)) + " ").encode("utf-16-le")
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                p = zstandard.ZstdCompressionParameters.from_level(12, dict_size=len(raw), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
                d.precompute_compress(compression_params=p)
                self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))
        data = text.encode("utf-16-le", "surrogatepass")
        return min((len(p.compress(data)) for p in self.packers), default=len(data))


@lru_cache(maxsize=200_000)
def _options(model: Model, m: str) -> dict[str, str]:
    out = {}
    for name, (steps, _) in CHAINS.items():
        if "�" in m:
            c = (model.lost[name].get(m) or [None])[0]
        else:
            c = undo(m, steps)
        if c is not None and c != m:
            out[name] = c
    return out


def weigh(model: Model, pieces: list[str]) -> list[tuple[str, float]]:
    """(chain, bytes saved over leaving the line unchanged), best first; without the chain's cost."""
    odd = {m for m in pieces if m > "\x7f" or len(m) > 1}
    by_chain: dict[str, dict[str, str]] = {}
    for m in odd:
        for name, c in model.options(m).items():
            by_chain.setdefault(name, {})[m] = c
    if not by_chain:
        return []
    base = model.cost(" " + "".join(pieces) + " ")
    sizes: dict[str, int] = {}
    out = []
    for name, turn in by_chain.items():
        text = " " + "".join(turn.get(m, m) for m in pieces) + " "
        if text not in sizes:
            sizes[text] = model.cost(text)
        out.append((name, float(base - sizes[text])))
    return sorted(out, key=lambda x: (-x[1], CHAINS[x[0]][1], x[0]))


@lru_cache(maxsize=100_000)
def _matching(model: Model, pattern: str) -> str | None:
    """The part of a known word that fits the pattern: a whole word before the most frequent piece of one."""
    m = re.search(f"\n({pattern})(?=\n)", model.joined) or re.search(f"({pattern})", model.joined)
    return m[1] if m else None


def _settle(model: Model, pieces: list[str], text: list[str], turned: dict[int, str]) -> None:
    """Of a garbled line some glyphs may be genuine: where both readings are letters, a known word
    that takes one reading at every position decides; without such a word all stay turned."""
    both = {i for i, c in turned.items() if len(pieces[i]) == 1 and pieces[i].isalpha() and c.isalpha()}
    start = 0
    for end in range(len(pieces) + 1):
        if end < len(pieces) and text[end].isalpha():
            continue
        spot = [i for i in range(start, end) if i in both]
        if spot and end - start >= 3 and "".join(text[start:end]) not in model.known:
            pattern = "".join(f"[{re.escape(text[i])}{re.escape(pieces[i])}]" if i in both else re.escape(text[i]) for i in range(start, end))
            found = _matching(model, pattern)
            if found and len(found) == end - start:
                for i in spot:
                    if found[i - start] == pieces[i]:
                        text[i] = pieces[i]
                        del turned[i]
        start = end + 1


def restore(model: Model, pieces: list[str], supported: str | None) -> tuple[str | None, dict[int, str]]:
    """The chain chosen for a line and the glyphs that it changes (position -> printed character).

    A chain that the font supports has been paid for there; it only must not lengthen the line.
    """
    gains = [(gain + LEAST_GAIN if name == supported else gain - CHAINS[name][1], name) for name, gain in weigh(model, pieces)]
    best = max(gains, key=lambda x: (x[0], x[1] == supported, -CHAINS[x[1]][1]), default=None)
    if best is None or best[0] < (0.0 if best[1] == supported else LEAST_GAIN):
        return None, {}
    text = list(pieces)
    turned: dict[int, str] = {}
    for i, m in enumerate(pieces):
        if m > "\x7f" or len(m) > 1:
            c = model.options(m).get(best[1])
            if c is not None:
                turned[i], text[i] = c, c
    if any(len(m) == 1 for m in pieces) and turned:
        _settle(model, pieces, text, turned)
    # genuine glyphs inside a garbled line: a known word must not be lost, nor a sign become a letter
    for i in list(turned):
        if len(pieces[i]) == 1:
            a = i
            while a > 0 and text[a - 1] != " ":
                a -= 1
            b = i
            while b + 1 < len(text) and text[b + 1] != " ":
                b += 1
            was, now = "".join(text[a:i]) + pieces[i] + "".join(text[i + 1:b + 1]), "".join(text[a:b + 1])
            lost = was in model.known and now not in model.known
            sign = pieces[i] in "‘’“”„–—" and turned[i].isalpha() and now not in model.known
            if lost or sign:
                text[i] = pieces[i]
                del turned[i]
    return best[1], turned


# ---------------------------------------------------------------- operators


def language_words(docs: DataFrame, top: int = DICTIONARY_WORDS) -> dict[str, list[str]]:
    """The most frequent words of each language with the signs that touch them.

    All documents are counted; the model keeps ``top`` words a language, so its size is bounded.
    """
    n = durable(
        docs.select("lang", F.explode(F.expr(r"regexp_extract_all(text, '\\p{IsHan}{1,4}|[^\\s\\p{IsHan}]+', 0)")).alias("word"))
        .where((F.length("word") < 40) & F.col("lang").isin(*LANGS)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    out = {}
    for lang in LANGS:
        out[lang] = [r["word"] for r in n.where(F.col("lang") == lang).orderBy(F.desc("n"), "word").limit(top).collect()]
    return {k: v for k, v in out.items() if v}


def lines(glyphs: DataFrame) -> DataFrame:
    """Lines that hold any mapped text beyond ASCII, with their glyphs in order."""
    odd = F.max(F.col("mapped_text").rlike(r"[^\x00-\x7f]")).alias("odd")
    return (
        glyphs.where(F.col("mapped_text").isNotNull()).select("paper", "page", "span", "ch", "mapped_text", "font")
        .groupBy("paper", "page", "span").agg(F.array_sort(F.collect_set(F.struct("ch", "mapped_text", "font"))).alias("gs"), odd).where("odd").drop("odd")
    )


def _pieces(row: dict) -> tuple[list, list[str], str | None]:
    chs, texts, fonts = [], [], []
    for g in row["gs"]:
        if not chs or g["ch"] != chs[-1]:
            if chs and isinstance(g["ch"], int) and isinstance(chs[-1], int) and g["ch"] > chs[-1] + 1:
                chs.append(None)
                texts.append(" ")
            chs.append(g["ch"])
            texts.append(g["mapped_text"])
            fonts.append(g["font"] or "")
    return chs, texts, max(sorted(set(fonts)), key=fonts.count) if fonts else None


def _supported(by_font: DataFrame, costs: dict[str, float]) -> DataFrame:
    """The best chain of each paper's font, where its lines save more than the chain costs."""
    cost = F.create_map(*[F.lit(x) for pair in costs.items() for x in pair])[F.col("chain")]
    best = by_font.withColumn("left", F.col("gain") - cost).where(F.col("left") >= LEAST_GAIN)
    return best.groupBy("paper", "font").agg(F.max(F.struct("left", -cost, "chain")).alias("best")).select("paper", "font", "best.chain")


def restored(glyphs: DataFrame, docs: DataFrame) -> DataFrame:
    """(paper, page, span, ch, mapped_text, restored_text, chain) of the affected glyphs."""
    model = Model(language_words(docs))

    def score(row: dict):
        _, pieces, font = _pieces(row)
        gains = weigh(model, pieces)
        if gains:
            # a line that every chain makes much longer stays as it is, and only speaks of its font
            may_turn = gains[0][1] > -SET_APART
            yield row["paper"], row["page"], row["span"], font, row["gs"] if may_turn else None, [{"chain": a, "gain": max(b, -SET_APART)} for a, b in gains]

    scored = durable(python_stage(lines(glyphs), "paper string, page int, span int, font string, gs array<struct<ch:int,mapped_text:string,font:string>>, gains array<struct<chain:string,gain:double>>", score))
    by_font = durable(scored.select("paper", "font", F.explode("gains").alias("g")).groupBy("paper", "font", "g.chain").agg(F.sum("g.gain").alias("gain")))
    # chains that several fonts support are cheap to name in all others (at most one row per chain comes back)
    seen = {r["chain"]: r["count"] for r in _supported(by_font, {n: c for n, (_, c) in CHAINS.items()}).groupBy("chain").count().collect()}
    font = _supported(by_font, {n: 1.0 if seen.get(n, 0) > 1 else c for n, (_, c) in CHAINS.items()}).select(F.col("paper").alias("p"), F.col("font").alias("f"), F.col("chain").alias("supported"))
    both = scored.where("gs is not null").join(font, scored["paper"].eqNullSafe(font["p"]) & scored["font"].eqNullSafe(font["f"]), "left").select("paper", "page", "span", "gs", "supported")

    def fix(row: dict):
        chs, pieces, _ = _pieces(row)
        chain, turned = restore(model, pieces, row["supported"])
        for i, c in turned.items():
            yield row["paper"], row["page"], row["span"], chs[i], pieces[i], None if "�" in pieces[i] else c, chain

    return python_stage(both, "paper string, page int, span int, ch int, mapped_text string, restored_text string, chain string", fix)


def p2_restored(spark: SparkSession, directory: str) -> DataFrame:
    """Affected glyphs with the printed character; null where a byte was lost for good."""
    return restored(read_table(spark, directory, "glyphs"), read_table(spark, directory, "documents"))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return p2_restored(spark, directory).select("paper", "page", "span", "ch").distinct()


def p2_fonts(spark: SparkSession, directory: str) -> DataFrame:
    """Affected glyphs by paper and chain."""
    return p2_restored(spark, directory).groupBy("paper", "chain").agg(F.count(F.lit(1)).alias("glyphs"), F.count("restored_text").alias("restored"))


QUERIES = {"p2_found": p2_found, "p2_restored": p2_restored, "p2_fonts": p2_fonts}
