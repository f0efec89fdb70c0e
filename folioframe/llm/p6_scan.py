"""Noise in text from scanned pages: broken words, misread characters, running heads, page numbers.

Method: joint word segmentation. The lines of a block are taken off and the character stream is
decoded by dynamic programming over a lexicon: a word may be read as it stands, with confused
characters, over a hyphen and a line end, split in two, or merged with its neighbour; each way has a
cost in bits, words cost by their corpus frequency. The cheapest path gives the continuous text and,
by the ways it took, the defects. A second dynamic programme over the lines chooses paragraph
boundaries.

Which words are a running head or a page number does not follow from words and their frequencies: a
head is made of ordinary words. ``p6_found`` therefore sets furniture lines aside, by comparison with the
paper's own, before it decodes; ``p6_method`` decodes every line.

The lexicon is a table. Blocks ask it for the strings that they may need; unknown strings are
turned into their possible originals (confusions undone) and looked up again. Only what a block
asked for comes back to it, so no vocabulary is collected.

Defined results: null and empty texts give no rows; blocks on pages without a known text layer are
treated as scanned, blocks of good pages are left alone; repeated rows count once; words are
compared without case; strings of more than 60 letters are read as they stand; of the wide strings of one
word (rn for m) eight at most are narrowed together; slots of formulas stay where they are; extra
columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import HAN, blocks_of, python_stage
from folioframe.session import durable, read_table

SCANNED = ("ocr_layer", "none")
#: Kinds whose text is prose that can be repaired.
KINDS = ("text", "caption", "footnote", "reference", "other", "figure", "table")
#: A word of the prose is seen at least this often, and this many times as often as what was read.
KNOWN, TIMES = 4, 8
#: Counts hold for a corpus of so many tokens; those of a larger one are scaled to it, so that the same text is
#: judged alike at any size. A smaller corpus is counted as it is: what it shows once is not known.
REFERENCE = 2_500_000

# What is read -> what may have stood there.
CONFUSIONS = {
    "rn": "m", "m": "rn", "ri": "n", "n": "ri", "ii": "u ü n", "u": "ii ll y n v", "cl": "d", "d": "cl", "vv": "w", "w": "vv", "li": "h", "h": "b li", "b": "h 6", "c": "e o", "e": "c o",
    "f": "t f", "t": "f", "1": "l i", "l": "i 1 t", "i": "l 1 t", "!": "i l", "|": "l i", "0": "o", "o": "0 c e a", "5": "s", "s": "5", "6": "b é ö g", "ss": "ß", "8": "b", "9": "g q", "q": "g", "g": "q", "a": "o ä", "v": "y", "y": "v",
    "ô": "ö", "û": "ü", "à": "ä", "é": "è", "è": "é", "ë": "é", "rri": "m", "in": "m", "iii": "m", "nn": "m", "ll": "u", "$": "s", "@": "a", "3": "e з", "4": "a ч", "7": "t", "2": "z", "z": "2", "k": "h", "j": "i", "ß": "b", "п": "л н", "н": "п и", "и": "н", "л": "п", "ш": "щ", "щ": "ш", "б": "6", "о": "0", "ь": "ъ",
}
_TURN = sorted(((a, b) for a, bs in CONFUSIONS.items() for b in bs.split()), key=lambda x: (-len(x[0]), x))
_CHUNK = re.compile(r"\S+")
_EDGE = "\"'“”„‚‘’«»()[]{}.,;:?…–—·•"
_ROMAN = re.compile(r"(?i)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_NUMBER = r"(?:\d{1,4}|[ivxlcdm]{1,8}|[IVXLCDM]{1,8})"
LONE_NUMBER = re.compile(rf"^[\s\[({{|·•*~_=–—-]*(?:(?:p|pp|pg|page|Page|Seite|S|с|стр)\.?\s*)?({_NUMBER})(?:\s*(?:/|of|von|sur)\s*\d+)?[\s\])}}|·•*~_=–—-]*$")

_LEADING = re.compile(rf"^[\[(·•–—|-]*\s*({_NUMBER})\s*[\])·•–—|-]*\s+(?=\S)")
_TRAILING = re.compile(rf"(?<=\S)\s+[\[(·•–—|-]*\s*({_NUMBER})\s*[\])·•–—|-]*$")
_DASH, _COMPOUND = re.compile("[-‐\xad]"), re.compile("([-‐])")
_DIVIDED, _STARTS, _ENDS = re.compile(r"(?<=[^\W_]|[!|])[-‐\xad¬]$"), re.compile(r"[^\W_]|[!|]"), re.compile(r"[.!?。…:]\W*$")
_HAN = re.compile(f"[{HAN}]")
_APART = re.compile(r"\W*\d(?: \d){1,3}\W*")


def core(token: str) -> str:
    """A token without the signs around it, lower case."""
    return token.strip(_EDGE).lower()


# Characters that scans confuse with one another are one class.
_CLASS = {c: k for k, cs in {"e": "eco0öéèêëóôсоеё", "i": "il1!|tfjíìîїі7ı", "u": "uüvyûùúу", "b": "bh8ß", "s": "s5$", "g": "gq9", "a": "aä@àâá4", "n": "nñ", "п": "плни", "ш": "шщ", "z": "z23з"}.items() for c in cs}
#: Strings of another width than what they stand for, and a sign of several classes.
_WIDE = {"rri": ("m",), "iii": ("m",), "rn": ("m",), "ri": ("n",), "ii": ("u", "n"), "cl": ("d",), "vv": ("w",), "li": ("h",), "nn": ("m",), "in": ("m",), "ll": ("u",), "ss": ("ß",), "6": ("b", "e", "g"), "m": ("rn",), "n": ("ri",), "d": ("cl",), "w": ("vv",), "u": ("ii",), "h": ("li",)}
_SITE = re.compile("(?=(rri|iii|rn|ri|ii|cl|vv|li|nn|in|ll|ss|6|[mndwuh]))")


def class_key(word: str) -> str:
    return "".join(_CLASS.get(c, c) for c in word)


def meeting_keys(word: str) -> set[str]:
    """Keys under which a misread word may meet its original: the classes of its letters, with wide
    strings narrowed anywhere, and with one narrow letter widened."""
    out = {word}
    sites = [(m.start(), m[1]) for m in _SITE.finditer(word)]
    for at, x in [x for x in sites if len(x[1]) > 1 or x[1] == "6"][:8][::-1]:
        end = at + len(x)
        out |= {w[:at] + b + w[end:] for w in list(out) if w[:end] == word[:end] for b in _WIDE[x]}
    for at, x in sites:
        if len(x) == 1 and x != "6":
            out |= {word[:at] + b + word[at + 1:] for b in _WIDE[x]}
    return {class_key(w) for w in out}


_PAIRS: dict[str, set[str]] = {}
for _a, _b in _TURN:
    _PAIRS.setdefault(_a, set()).add(_b)
_LONGEST = max(map(len, _PAIRS))


def steps_between(read: str, meant: str, most: float = 3.0) -> float | None:
    """How many confusions turn ``meant`` into ``read`` (repeats of one confusion cost half), or null."""
    n, m = len(read), len(meant)
    if abs(n - m) > most + 1 or n > 64:
        return None
    best: dict[tuple[int, int], tuple[float, frozenset]] = {(0, 0): (0.0, frozenset())}
    for i in range(n + 1):
        for j in range(m + 1):
            at = best.get((i, j))
            if at is None or at[0] > most:
                continue
            cost, used = at
            if i < n and j < m and read[i] == meant[j]:
                if cost < best.get((i + 1, j + 1), (9.9,))[0]:
                    best[i + 1, j + 1] = (cost, used)
            for k in range(1, min(_LONGEST, n - i) + 1):
                for b in _PAIRS.get(read[i:i + k], ()):
                    if meant.startswith(b, j):
                        c = cost + (0.5 if (read[i:i + k], b) in used else 1.0)
                        key = (i + k, j + len(b))
                        if c < best.get(key, (9.9,))[0]:
                            best[key] = (c, used | {(read[i:i + k], b)})
    end = best.get((n, m))
    return end[0] if end and end[0] <= most else None


def odd_word(word: str) -> bool:
    return len(word) >= 3 and any(c.isalpha() for c in word)


# ---------------------------------------------------------------- furniture


def head_key(text: str) -> str:
    """Letters of a head without case, accents and spaces; confusable characters are one."""
    t = unicodedata.normalize("NFKD", text.casefold())
    t = "".join(c for c in t if c.isalnum() or c in "!|$")
    for a, b in (("rn", "m"), ("ri", "n"), ("ii", "u"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"), ("!", "l"), ("5", "s"), ("6", "b")):
        t = t.replace(a, b)
    return "".join(c for c in t if c.isalpha())


def split_number(line: str) -> tuple[str, str | None]:
    """(rest, number) of a line that may begin or end with a page number."""
    s = line.strip()
    m = _LEADING.match(s)
    if m and (m[1].isdigit() or _ROMAN.fullmatch(m[1])):
        return s[m.end():], m[1]
    m = _TRAILING.search(s)
    if m and (m[1].isdigit() or _ROMAN.fullmatch(m[1])):
        return s[:m.start()], m[1]
    return s, None


def _shared(a: str, b: str) -> int:
    """Letters that both have, in any order: no alignment can find more."""
    return sum((Counter(a) & Counter(b)).values())


def is_head(text: str, heads: list[str]) -> bool:
    """A running head, whole or shortened, also in capitals, set apart or with misread characters."""
    if len(text) > 3.2 * max(map(len, heads), default=0) + 12:
        return False
    k = head_key(text)
    if len(k) < 4 if _HAN.search(text) else len(k) < 7:
        return False
    # real words are not told apart by a shared beginning: a shortened head keeps most of the line
    for h in heads:
        if not h:
            continue
        if k == h:
            return True
        if len(k) >= 0.35 * len(h) and (h.startswith(k) or h.endswith(k) and len(k) >= 0.5 * len(h)):
            return True
        if abs(len(k) - len(h)) <= 0.2 * len(h) and _shared(k, h) >= 0.85 * min(len(k), len(h)) and SequenceMatcher(None, k, h, autojunk=False).ratio() >= 0.85:
            return True
        if len(k) < len(h) and len(k) >= 10 and _shared(k, h[:len(k)]) >= 0.88 * len(k) and SequenceMatcher(None, k, h[:len(k)], autojunk=False).ratio() >= 0.88:
            return True
    return False


def furniture(lines: list[str], heads: list[str], numbers: set[str]) -> list[tuple[bool, bool]]:
    """(head, number) of each line."""
    out = []
    for i, line in enumerate(lines):
        s = line.strip()
        if _APART.fullmatch(s):
            s = s.replace(" ", "")  # a number set apart
        head = number = False
        m = LONE_NUMBER.match(s)
        if m and len(lines) > 1 and (m[1].isdigit() or _ROMAN.fullmatch(m[1])):
            plainly = m[1] in numbers or re.search(r"\D", s.strip()) is not None and not s[-1:] in ".," or m[1].isdigit() and not numbers
            lone = s == m[1]
            if m[1].lower() in numbers or (plainly and not lone) or (lone and _plausible(lines, i)):
                number = True
        if not number and s:
            rest, n = split_number(s)
            if n is not None and is_head(rest, heads):
                head = number = True
            elif is_head(s, heads):
                head = True
        out.append((head, number))
    return out


def _plausible(lines: list[str], i: int) -> bool:
    """A bare number alone on a line inside running text: lines are filled, so a word alone is not wrapped."""
    s = lines[i].strip()
    longest = max(len(x) for x in lines)
    if i + 1 < len(lines):
        return len(s) + 1 + len(lines[i + 1].split(" ")[0]) < 0.8 * longest
    before = lines[i - 1].rstrip() if i else ""
    return bool(re.search(r"[.!?。…:”»]$", before)) or len(before) + 1 + len(s) < longest


# ---------------------------------------------------------------- decoding


def stream(lines: list[str], marks: list[tuple[bool, bool]]) -> list[dict]:
    """Tokens of the de-lined text: {text, gap, hyphen}. ``gap`` is what stood before the token."""
    out: list[dict] = []
    for line, (head, number) in zip(lines, marks):
        if head or number:
            continue
        first = True
        for m in _CHUNK.finditer(line):
            out.append({"text": m[0], "line": first})
            first = False
    return out


def pieces(tokens: list[dict]) -> set[str]:
    """Strings whose corpus counts a block needs."""
    out = set()
    for i, t in enumerate(tokens):
        w = core(t["text"])
        if odd_word(w):
            out.add(w)
        for p in _DASH.split(w):
            if odd_word(p):
                out.add(p)
        if i + 1 < len(tokens) and _DIVIDED.search(t["text"]):
            a, b = t["text"].lstrip(_EDGE).lower(), core(tokens[i + 1]["text"])
            out |= {a[:-1] + b, a[:-1] + "-" + b, a[:-1], b}
        elif i + 1 < len(tokens) and t["text"].isalpha() and tokens[i + 1]["text"][:1].isalpha() and min(len(t["text"]), len(tokens[i + 1]["text"])) <= 3:
            out.add(w + core(tokens[i + 1]["text"]))
    return {x for x in out if 1 <= len(x) <= 60}


def decode(tokens: list[dict], lexicon: dict[str, tuple[float, list[tuple[str, float, float]]]], total: float) -> tuple[list[str], set[str]]:
    """The cheapest reading of the token stream: its words, and the defects on its path.

    ``lexicon`` maps a string to its corpus count and the known words that it may stand for.
    """

    def bits(n: float) -> float:
        return math.log2((total + 1e5) / (n + 0.05))

    def read(word: str) -> tuple[float, str, bool]:
        """(cost, reading, misread) of one word."""
        n, alts = lexicon.get(word, (0, []))
        best = (bits(n) if n else bits(0) + 1.5 * len(word) ** 0.5, word, False)
        for alt, k, steps in alts:
            # beyond this the costs ask for one ratio at every n: some 45 times as often for a step
            if k >= KNOWN and k >= TIMES * max(1, n):
                cost = bits(k) + 5.5 * steps + (bits(k) if " " in alt else 0.0)
                if cost < best[0]:
                    best = (cost, alt, " " not in alt)
        return best

    def count(word: str) -> float:
        return lexicon.get(word, (0, []))[0]

    n = len(tokens)
    cost = [0.0] + [math.inf] * n
    back: list[tuple[int, str, set[str]] | None] = [None] * (n + 1)

    def relax(i: int, j: int, c: float, text: str, defects: set[str]) -> None:
        if cost[i] + c < cost[j]:
            cost[j], back[j] = cost[i] + c, (i, text, defects)

    for i in range(n):
        if cost[i] == math.inf:
            continue
        raw = tokens[i]["text"]
        lead = raw[:len(raw) - len(raw.lstrip(_EDGE))]
        mid = raw.strip(_EDGE)
        tail = raw[len(lead) + len(mid):]
        w = mid.lower()
        if not odd_word(w):
            relax(i, i + 1, bits(total / 50), raw, set())
        else:
            c, word, wrong = read(w)
            # parts of a compound are read on their own
            parts = _COMPOUND.split(w)
            if len(parts) > 1 and count(w) < 1:
                got = [read(p) if odd_word(p) else (bits(total / 50), p, False) for p in parts[::2]]
                pc = sum(g[0] for g in got) + 2.0
                if pc < c:
                    c, word, wrong = pc, "-".join(g[1] for g in got), any(g[2] for g in got)
            relax(i, i + 1, c, lead + (_cased(mid, word) if wrong or " " in word else mid) + tail, {"misread"} if wrong else set())
            # a word set apart: both halves unknown or short, the whole well known
            if i + 1 < n and not tail and raw.isalpha() and tokens[i + 1]["text"][:1].islower() and count(w) < KNOWN:
                nxt = tokens[i + 1]["text"]
                whole = count(w + core(nxt))
                if whole >= KNOWN:
                    relax(i, i + 2, bits(whole) + 8.0, raw + nxt, set())
        if i + 1 < n and _DIVIDED.search(raw):
            nxt = tokens[i + 1]["text"]
            b = core(nxt)
            a = raw.lstrip(_EDGE).lower()[:-1]
            if b and _STARTS.match(nxt.lstrip(_EDGE)) and not nxt[:1] in "“„«\"(":
                after = nxt[len(nxt.rstrip(_EDGE)):]
                stem = raw[:-1]
                # a word divided by a hyphen that is not its own
                c, word, wrong = read(a + b)
                firm = min(count(p) for p in (a, b))
                if nxt[:1].isupper():
                    c += 12.0
                if count(a + b) < 1 and not wrong:
                    # an unknown word: a name, unless both parts are words of their own
                    c = bits(0.3) + 6.0 + (8.0 if firm >= KNOWN and len(a) > 2 and len(b) > 2 else 0.0)
                joined = stem + nxt.rstrip(_EDGE)
                relax(i, i + 2, c + 1.0, (_cased(joined, lead + word) if wrong else joined) + after, {"broken_word"} | ({"misread"} if wrong else set()))
                # a compound divided at its own hyphen
                whole = count(f"{a}-{b}")
                ra, rb = read(a) if odd_word(a) else (bits(count(a)), a, False), read(b) if odd_word(b) else (bits(count(b)), b, False)
                cc = bits(whole) if whole else min(ra[0] + rb[0] + 1.0, 1e9)
                if nxt[:1].isupper():
                    cc = min(cc, bits(2.0) + 4)
                relax(i, i + 2, cc, raw + nxt, {"misread"} if not whole and (ra[2] or rb[2]) else set())
    words: list[str] = []
    defects: set[str] = set()
    j = n
    while j > 0 and back[j] is not None:
        i, text, d = back[j]
        words.append(text)
        defects |= d
        j = i
    return words[::-1], defects


def _cased(was: str, now: str) -> str:
    if was.isupper() and len(was) > 1:
        return now.upper()
    first = next((c for c in was if c.isalpha()), "")
    return now[:1].upper() + now[1:] if first.isupper() else now


def boundaries(lines: list[str], marks: list[tuple[bool, bool]]) -> list[int]:
    """Lines after which a paragraph ends, by dynamic programming over the kept lines.

    A paragraph costs something to open; a short line inside one and a full line at its end cost
    more the further they are from the usual.
    """
    keep = [i for i, m in enumerate(marks) if not any(m)]
    if not keep:
        return []
    full = max(len(lines[i]) for i in keep)
    if len(keep) == 1:
        return keep
    inside = [0.0 if len(lines[i]) >= 0.7 * full else 3.0 + (4.0 if _ENDS.search(lines[i]) else -1.0) for i in keep]
    ends = [0.0 if _ENDS.search(lines[i]) else 9.0 for i in keep]
    # best[j]: cost of the first j lines; what lies inside a paragraph is a difference of sums, so that the
    # best start of the last paragraph is kept on the way
    best, back, within = 0.0, [0] * (len(keep) + 1), 0.0
    start, first = math.inf, 0
    for j in range(1, len(keep) + 1):
        if best - within <= start:
            start, first = best - within, j - 1
        best = start + within + 4.0 + (ends[j - 1] if j < len(keep) else 0.0)
        back[j] = first
        within += inside[j - 1]
    out, j = [], len(keep)
    while j > 0:
        out.append(keep[j - 1])
        j = back[j]
    return out[::-1]


def repair(text: str, heads: list[str], numbers: set[str], lexicon: dict, total: float, marks: list | None = None) -> tuple[str, list[str]]:
    lines = text.split("\n")
    marks = furniture(lines, heads, numbers) if marks is None else marks
    defects: set[str] = set()
    if any(h for h, _ in marks):
        defects.add("running_head")
    if any(n for _, n in marks):
        defects.add("page_number")
    ends = set(boundaries(lines, marks))
    paragraphs: list[list[int]] = [[]]
    for i, m in enumerate(marks):
        if not any(m):
            paragraphs[-1].append(i)
        if i in ends:
            paragraphs.append([])
    out = []
    for p in paragraphs:
        if p:
            words, d = decode(stream([lines[i] for i in p], [(False, False)] * len(p)), lexicon, total)
            defects |= d
            out.append(" ".join(words))
    return "\n\n".join(out), sorted(defects)


# ---------------------------------------------------------------- operators


#: Pages of one stretch of a paper. A running head is looked for on the pages of its stretch and of the two
#: beside it, so that no row holds the heads of a whole volume.
STRETCH = 32


def scanned_blocks(spark: SparkSession, directory: str) -> DataFrame:
    """Blocks of scanned pages that may hold prose, with the heads around them and the page's numbers."""
    blocks = blocks_of(spark, directory)
    pages = read_table(spark, directory, "pages").groupBy("paper", "page").agg(F.max("text_layer.status").alias("status"))
    furniture = blocks.where("kind = 'furniture'")
    stretch = F.floor(F.col("page") / STRETCH).cast("int")
    around = F.explode(F.array(*[stretch + i for i in (-1, 0, 1)])).alias("stretch")
    heads = furniture.select("paper", F.trim("text").alias("h"), around).where(F.col("h").rlike(r"\p{L}{3,}")).groupBy("paper", "stretch").agg(F.collect_set("h").alias("heads"))
    titles = read_table(spark, directory, "papers").where("title is not null").groupBy("paper").agg(F.min("title").alias("title"))
    numbers = furniture.where(F.lower("text").rlike(r"^\W*([0-9]{1,4}|[ivxlcdm]+)\W*$")).groupBy("paper", "page").agg(F.collect_set(F.regexp_extract(F.lower("text"), "([0-9]{1,4}|[ivxlcdm]+)", 1)).alias("numbers"))
    none = F.array().cast("array<string>")
    return (
        blocks.where(F.col("kind").isin(*KINDS) & F.col("text").rlike(r"\S")).join(pages, ["paper", "page"], "left")
        .where(F.coalesce(F.col("status"), F.lit("none")).isin(*SCANNED)).withColumn("stretch", stretch).join(heads, ["paper", "stretch"], "left").join(titles, "paper", "left").join(numbers, ["paper", "page"], "left")
        .select("paper", "id", "page", "kind", "text", F.concat(F.coalesce("heads", none), F.when(F.col("title").isNotNull(), F.array("title")).otherwise(none)).alias("heads"), "numbers")
    )


def _marked(row: dict) -> tuple[list[str], list[str], set[str], list[tuple[bool, bool]]]:
    heads = [head_key(h) for h in row["heads"] or []]
    numbers = set(row["numbers"] or [])
    lines = row["text"].split("\n")
    return lines, heads, numbers, furniture(lines, heads, numbers)


def lexicon_counts(spark: SparkSession, directory: str) -> DataFrame:
    """(word, n): words and compounds of all blocks and documents, without those at line ends."""
    texts = blocks_of(spark, directory).where("kind <> 'furniture'").select("text").unionByName(read_table(spark, directory, "documents").select("text"))
    # compounds and their parts in one pass; combined before the shuffle
    token = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}\p{M}]+(?:[-‐’'!|][\p{L}\p{N}]+)*"), F.lit(0))
    whole = texts.select(F.explode(token).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("word").rlike("[-‐]"), F.split("word", "[-‐]")).otherwise(F.array().cast("array<string>"))
    return whole.select(F.explode(F.concat(F.array("word"), parts)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def repaired(spark: SparkSession, directory: str, aside: bool = True) -> DataFrame:
    """(paper, id, kind, text, defects) of every scanned block: continuous text and what was wrong.
    ``aside``: furniture lines are set aside before decoding."""

    def mark(row: dict):
        marks = _marked(row)[3] if aside else [(False, False)] * len(row["text"].split("\n"))
        yield row["paper"], row["id"], row["kind"], row["text"], [h for h, _ in marks], [n for _, n in marks]

    blocks = durable(python_stage(scanned_blocks(spark, directory), "paper string, id string, kind string, text string, head_lines array<boolean>, number_lines array<boolean>", mark))
    counts = durable(lexicon_counts(spark, directory))
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    scale = max(1.0, total / REFERENCE)
    counts, total = counts.select("word", F.round(F.col("n") / scale, 6).alias("n")), total / scale

    def ask(row: dict):
        for w in pieces(stream(row["text"].split("\n"), list(zip(row["head_lines"], row["number_lines"])))):
            yield row["paper"], row["id"], w

    asked = durable(python_stage(blocks, "paper string, id string, word string", ask))
    strings = asked.select("word").distinct().join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0.0)).alias("n"))

    def fold(row: dict):
        yield row["word"], row["n"], class_key(row["word"])

    def meet(row: dict):
        for k in meeting_keys(row["word"]):
            yield row["word"], row["n"], k

    def close(row: dict):
        steps = steps_between(row["word"], row["alt"])
        # a word that costs no more as it stands is not read otherwise
        if steps and (not row["n"] or row["k"] + 0.05 > (row["n"] + 0.05) * 2 ** (5.5 * steps)):
            yield row["word"], row["alt"], steps, row["k"]

    def halves(row: dict):
        w = row["word"]
        for i in range(2, len(w) - 1):
            yield w, w[:i], w[i:]

    known = counts.where(f"n >= {KNOWN}")
    split = (
        python_stage(strings.where("n < 1").select("word"), "word string, a string, b string", halves)
        .join(known.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(known.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
        .where("na >= 50 and nb >= 50").select("word", F.concat_ws(" ", "a", "b").alias("alt"), F.lit(1.5).alias("steps"), F.least("na", "nb").alias("k"), (1.5 * 5.5 + math.log2(total + 1e5) - 2 * F.log2(F.least("na", "nb") + 0.05)).alias("cost"))
    )
    letters = F.col("word").rlike(r"\p{L}")
    folded = python_stage(known.where(letters & (F.length("word") >= 3)).select("word", "n"), "alt string, k double, s string", fold)
    asking = python_stage(strings.where(letters).select("word", "n"), "word string, n double, s string", meet)
    # unknown strings and known words meet by key; only pairs that confusions explain stay
    meant = python_stage(asking.join(folded, "s").where(f"word <> alt and k >= {TIMES} * greatest(n, 1)").select("word", "n", "alt", "k").distinct(), "word string, alt string, steps double, k double", close)
    alts = (
        meant.select("word", "alt", "steps", "k", (F.col("steps") * 5.5 - F.log2(F.col("k") + 0.05)).alias("cost")).unionByName(split)
        # of all possible originals the few that cost the decoder least; it takes the cheapest
        .groupBy("word").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "alt", "k", "steps"))), 1, 6).alias("alts"))
    )
    lexicon = strings.join(alts, "word", "left")
    per_block = asked.join(lexicon, "word").groupBy("paper", "id").agg(F.collect_list(F.struct("word", "n", "alts")).alias("lexicon"))

    def fix(row: dict):
        lex = {x["word"]: (x["n"], [(a["alt"], a["k"], a["steps"]) for a in x["alts"] or []]) for x in row["lexicon"] or []}
        text, defects = repair(row["text"], [], set(), lex, total, list(zip(row["head_lines"], row["number_lines"])))
        yield row["paper"], row["id"], row["kind"], text, defects

    return python_stage(blocks.join(per_block, ["paper", "id"], "left"), "paper string, id string, kind string, text string, defects array<string>", fix)


def p6_method(spark: SparkSession, directory: str) -> DataFrame:
    """What decoding alone gives, no line set aside: text in paragraphs, their number, and the defects."""
    d = repaired(spark, directory, aside=False)
    return d.select("paper", "id", "text", F.size(F.split("text", "\n\n")).alias("paragraphs"), "defects")


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    return repaired(spark, directory).select("paper", "id", F.explode("defects").alias("defect")).distinct()


def p6_text(spark: SparkSession, directory: str) -> DataFrame:
    """Scanned blocks as continuous paragraphs."""
    return repaired(spark, directory)


QUERIES = {"p6_method": p6_method, "p6_found": p6_found, "p6_text": p6_text}
