"""Evaluation texts in training text: documents that hold passages of test items.

Method: a distributed positional inverted index. Every document is cut into words once; the postings
(word of the test set, document, positions) of all documents are stored, block-compressed, in segments of
some hundred documents (``index_of``), as search engines do it: a segment is one row of a table in the
shared checkpoint folder. A document's word is posted under every test word that it equals or that it
misreads. Search reads the stored index alone, no text: the list of the rarest word of each phrase of three words is
intersected with those of the two others, their offsets adjusted, and every phrase found is adjusted to where
the item would start, so that a document and an item meet on a diagonal. Where enough words stand in such
runs, the pieces of all pairs are aligned together in windows of diagonals (proximity), and those that may
have enough words in full, on their posted positions.

There is no limit on how many documents hold a phrase or an item. Only the items say which phrases count:
what three or more different items share is stock language, as their stock question is.

Defined results: null and empty texts hold nothing; words are compared without case, accents,
markup and look-alikes and with single wrong characters; a sentence that opens several items is
not part of a passage; repeated rows count once; texts are read whole; a test set of more than
``MOST_BYTES`` raises (it is sent to every task), the corpus is never collected.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import HAN, spread
from folioframe.llm.p5_lookalike import INVISIBLE_CODES, LATIN_OF
from folioframe.session import durable, read_table

LEAST_WORDS = 15
#: A piece of a passage has at least this many words.
LEAST_PIECE = 5
#: A pair is aligned when so many phrases of the item stand in two windows of diagonals: fifteen words in at
#: most five runs (one piece with four words changed or put between, two pieces with three) hold at least five.
LEAST_PHRASES = 5
#: A phrase that so many different items hold is none of their own.
SHARED = 3
#: The texts of the test set have at most so many characters; it is sent to every task.
MOST_BYTES = 64_000_000
#: A segment of the index ends after so many documents or words.
SEGMENT_DOCS, SEGMENT_WORDS = 512, 400_000
_FOLD = str.maketrans({**LATIN_OF, **{chr(c): None for a, b in ((0x300, 0x370), (0x483, 0x488), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30)) for c in range(a, b)}, **{chr(c): None for c in INVISIBLE_CODES}})
_MARK = re.compile(r"<[!/?a-zA-Z][^<>]*>|&(?:#\d+|\w+);|\\[a-zA-Z]+\*?")
_BROKEN = re.compile(r"(?<=[^\W\d_])-\s*\n\s*(?=[^\W\d_])")
#: Characters that stand inside words without being letters: they are folded before words are cut.
_INSIDE = re.compile("[" + "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in ((0x300, 0x370), (0x483, 0x488), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100), (0xFE20, 0xFE30))) + "".join(f"\\u{c:04x}" for c in INVISIBLE_CODES) + "]")
_WORD = re.compile(f"[{HAN}]|[^\\W_{HAN}]+")


@lru_cache(maxsize=200_000)
def _folded(word: str) -> str:
    return word if word.isascii() else unicodedata.normalize("NFKD", word).translate(_FOLD)


def norm_words(text: str) -> list[str]:
    """Words as they are compared: no markup, case, accents, invisible or look-alike characters."""
    if "<" in text or "&" in text or "\\" in text:
        text = _MARK.sub(" ", text)
    if "-\n" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    text = text.casefold()
    if _INSIDE.search(text):
        text = unicodedata.normalize("NFKD", text).translate(_FOLD)
    return list(map(_folded, _WORD.findall(text)))


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> bool:
    """Equal, or one wrong character in a word of four letters or more (two in eight or more)."""
    if a == b:
        return True
    most = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 8 else 2
    if not most or abs(len(a) - len(b)) > most:
        return False
    # one change removes one letter at most
    if len(set(a) - set(b)) > most or len(set(b) - set(a)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= most


def _shorter(word: str, by: int) -> set[str]:
    """The word, and what is left of it without one letter (without two)."""
    out = {word}
    last = out
    for _ in range(by):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class Vocabulary:
    """The words of the items; for a document's word those that it equals or misreads.

    Words alike share a form with one letter left out (with two, where they are long): the forms are a
    table, so that a new word costs a few dozen look-ups.
    """

    def __init__(self, words: set[str]):
        self.words = sorted(words)
        self.number = {w: i for i, w in enumerate(self.words)}
        self.forms: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            if len(w) >= 4:
                for f in _shorter(w, 1 if len(w) < 8 else 2):
                    self.forms[f].append(w)
        self.known: dict[str, tuple[str, ...]] = {}

    def like(self, v: str) -> tuple[str, ...]:
        out = self.known.get(v)
        if out is None:
            near = {v} if v in self.number else set()
            if len(v) >= 4:
                near |= {w for f in _shorter(v, 1 if len(v) < 8 else 2) for w in self.forms.get(f, ()) if alike(w, v)}
            if len(self.known) >= 200_000:
                self.known.clear()
            out = self.known[v] = tuple(sorted(near))
        return out

    def index(self, doc: list[str]) -> dict[str, set[int]]:
        """For each of the words the positions of the document that hold it or a word like it."""
        at: dict[str, list[int]] = {}
        for j, v in enumerate(doc):
            at.setdefault(v, []).append(j)
        out: dict[str, set[int]] = {}
        for v, js in at.items():
            for w in self.like(v):
                out.setdefault(w, set()).update(js)
        return out


class Posting(dict):
    """word -> number of its list of test words, given on first use; 0 is the empty list."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.lists: dict[tuple[str, ...], int] = {(): 0}

    def __missing__(self, v: str) -> int:
        like = self.vocabulary.like(v)
        n = self.lists.get(like)
        if n is None:
            n = self.lists[like] = len(self.lists)
        if len(self) >= 200_000:
            self.clear()
        self[v] = n
        return n

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(start of each list, the test words' numbers one list after the other)"""
        starts = np.cumsum([0, *map(len, self.lists)])
        return starts, np.array([self.vocabulary.number[w] for ws in self.lists for w in ws], np.int64)


def _flat(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every (start, count), one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def _local(same: list[set[int]], i0: int, i1: int, d0: int, d1: int) -> tuple[int, int, int, int, int]:
    """Best local alignment of item[i0:i1] and doc[d0:d1]: (words in common, item start, end, doc start, end)."""
    best = (0, 0, 0, 0, 0, 0)
    # sparse rows: only cells with a positive score are kept, and only those above 3 outlive a gap
    row: dict[int, tuple[int, int, int, int]] = {}
    strong: list[int] = []
    for i in range(i0, i1):
        here = same[i]
        new: dict[int, tuple[int, int, int, int]] = {}
        todo = {x for x in here if d0 <= x < d1}
        todo.update(strong)
        todo.update([j + 1 for j in strong if j + 1 < d1])
        strong = []
        for at in sorted(todo):
            j = at
            while True:
                old = row.get(j - 1)
                if j in here:
                    cell = (old[0] + 2, old[1] + 1, old[2], old[3]) if old else (2, 1, i, j)
                else:
                    cell = (old[0] - 3, *old[1:]) if old else (0, 0, i, j)
                up, left = row.get(j), new.get(j - 1)
                if up and up[0] - 3 > cell[0]:
                    cell = (up[0] - 3, *up[1:])
                if left and left[0] - 3 > cell[0]:
                    cell = (left[0] - 3, *left[1:])
                if cell[0] <= 0:
                    break
                new[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], i + 1, cell[3], j + 1)
                if cell[0] <= 3:
                    break
                strong.append(j)
                j += 1
                if j >= d1 or j in todo:
                    break
        row = new
    return best[1:]


def passage_words(item: list[str], doc: list[str] | int, index: dict[str, set[int]] | None = None, least: int = 0) -> int:
    """Words of the item that stand in the document in order, in one piece or in two; 0 where they
    cannot be ``least``. ``index``: the document's positions of the item's words, where they are
    posted; its length does for the document then."""
    index = Vocabulary(set(item)).index(doc) if index is None else index
    size = doc if isinstance(doc, int) else len(doc)
    same = [index.get(w, frozenset()) for w in item]
    if sum(map(bool, same)) < least:
        return 0
    n, i0, i1, d0, d1 = _local(same, 0, len(item), 0, size)
    # a second piece has no more words than the item has left on one side
    if n < LEAST_PIECE or n + max(i0, len(item) - i1) < least:
        return 0
    before = _local(same, 0, i0, 0, d0)[0] if i0 else 0
    after = _local(same, i1, len(item), d1, size)[0] if i1 < len(item) else 0
    return n + max((x for x in (before, after) if x >= LEAST_PIECE), default=0)


def _bands(diagonal: int) -> tuple[int, int]:
    """Overlapping bands of diagonals, so that inserted and lost words do not part a passage."""
    return diagonal // 12 * 2, (diagonal + 6) // 12 * 2 + 1


def stock_openings(items: dict[int, str]) -> set[str]:
    """Opening sentences or lines that several items share."""
    first = Counter(" ".join(norm_words(re.split(r"(?<=[.?!:])\s|\n", t.strip(), maxsplit=1)[0])) for t in items.values())
    return {s for s, n in first.items() if n >= SHARED}


def passages(items: dict[int, str]) -> dict[int, list[str]]:
    stock = stock_openings(items)
    out = {}
    for k, t in items.items():
        head, *rest = re.split(r"(?<=[.?!:])\s|\n", t.strip(), maxsplit=1)
        out[k] = norm_words(rest[0] if rest and " ".join(norm_words(head)) in stock else t)
    return {k: w for k, w in out.items() if w}


# ---------------------------------------------------------------- the index


def segment(docs: list[tuple[int, list[str]]], posting: Posting) -> tuple:
    """One segment of the index: (document ids, where each begins, terms, postings of each, documents of each, block).

    Positions count through the segment, with one place free after each document. The block holds the
    positions of each term, ascending, as differences, compressed.
    """
    begins = np.cumsum([0, *(len(ws) + 1 for _, ws in docs)])
    lists = np.zeros(begins[-1], np.int64)
    for b, (_, ws) in zip(begins, docs):
        lists[b:b + len(ws)] = np.fromiter(map(posting.__getitem__, ws), np.int64, len(ws))
    starts, flat = posting.table()
    at = np.flatnonzero(lists)
    counts = starts[lists[at] + 1] - starts[lists[at]]
    term, place = flat[_flat(starts[lists[at]], counts)], np.repeat(at, counts)
    order = np.lexsort((place, term))
    term, place = term[order], place[order]
    terms, first, sizes = np.unique(term, return_index=True, return_counts=True)
    doc = np.searchsorted(begins, place, "right")
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    held = np.add.reduceat(new, first) if len(first) else first
    block = zlib.compress(np.diff(place, prepend=0).astype("<i4").tobytes(), 1)
    return [d for d, _ in docs], begins.tolist(), terms.tolist(), sizes.tolist(), held.tolist(), block


def own_phrases(passages: list[list[str]]) -> list[list[int]]:
    """Where the phrases of three words begin that are each item's own.

    What three or more different items share is stock language, as a stock question is. Items that share half
    of their phrases with the first that has them are copies of one item. All phrases count for an item that
    has hardly any of its own.
    """
    phrases = [list(zip(ws, ws[1:], ws[2:])) for ws in passages]
    first: dict[tuple[str, str, str], int] = {}
    copy_of = []
    for k, ps in enumerate(phrases):
        shared = Counter(copy_of[first[t]] for t in set(ps) if t in first)
        other, n = max(shared.items(), key=lambda x: (x[1], -x[0]), default=(k, 0))
        copy_of.append(other if 2 * n >= len(set(ps)) > 0 else k)
        for t in ps:
            first.setdefault(t, k)
    holders: dict[tuple[str, str, str], set[int]] = defaultdict(set)
    for k, ps in enumerate(phrases):
        for t in ps:
            holders[t].add(copy_of[k])
    out = []
    for ps in phrases:
        own = [q for q, t in enumerate(ps) if len(holders[t]) < SHARED]
        out.append(own if len(own) >= 2 * LEAST_PHRASES else list(range(len(ps))))
    return out


class Items:
    """The test set, ready for the search: the items' own phrases of three words, and where items have them."""

    def __init__(self, passage: dict[int, list[str]], df: dict[int, int] | None = None):
        self.passage = passage
        self.ids = sorted(passage)
        self.vocabulary = Vocabulary({w for ws in passage.values() for w in ws})
        number, self.size = self.vocabulary.number, len(self.vocabulary.words)
        numbers = [[number[w] for w in passage[k]] for k in self.ids]
        self.words = np.full((len(numbers), max(map(len, numbers), default=0)), self.size, np.int32)
        for k, ws in enumerate(numbers):
            self.words[k, :len(ws)] = ws
        own = own_phrases([passage[k] for k in self.ids])
        rows = sorted(((ws[q] * self.size + ws[q + 1]) * self.size + ws[q + 2], k, q) for k, (ws, qs) in enumerate(zip(numbers, own)) for q in qs)
        table = np.array(rows, np.int64).reshape(-1, 3)
        self.codes, self.starts = np.unique(table[:, 0], return_index=True)
        self.counts = np.diff(np.append(self.starts, len(table)))
        self.item, self.spot = table[:, 1], table[:, 2]
        self.width = self.words.shape[1] + 1
        # each phrase is looked up from its rarest word on: (phrase, how far in that word stands)
        seen = np.zeros(self.size, np.int64)
        for w, n in (df or {}).items():
            seen[w] = n
        parts = np.stack([self.codes // self.size ** 2, self.codes // self.size % self.size, self.codes % self.size])
        self.anchor = seen[parts].argmin(axis=0) if len(self.codes) else np.zeros(0, np.int64)
        self.by_anchor = [np.unique(parts[o][self.anchor == o]) for o in range(3)]


def _phrases(place: np.ndarray, term: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(place, phrase) of every phrase of the items: the list of its rarest word is intersected with those of
    the two others, their offsets adjusted. ``place`` ascends."""
    out_place, out_phrase = [], []
    for o in range(3):
        at = np.flatnonzero(np.isin(term, items.by_anchor[o]))
        part = {o: term[at]}
        start = place[at] - o
        for other in sorted({0, 1, 2} - {o}, key=lambda x: abs(x - o)):
            lo, hi = np.searchsorted(place, start + other, "left"), np.searchsorted(place, start + other, "right")
            again = hi - lo
            part = {k: np.repeat(v, again) for k, v in part.items()} | {other: term[_flat(lo, again)]}
            start = np.repeat(start, again)
        code = (part[0] * items.size + part[1]) * items.size + part[2]
        spot = np.minimum(np.searchsorted(items.codes, code), len(items.codes) - 1)
        met = (items.codes[spot] == code) & (items.anchor[spot] == o)
        out_place.append(start[met])
        out_phrase.append(spot[met])
    return np.concatenate(out_place), np.concatenate(out_phrase)


#: Diagonals of a window in which a piece is aligned, and how far apart windows are.
BAND, STEP = 12, 6
#: Scores of an alignment: a word in common, and one that is lost, added or another.
SAME_WORD, OTHER_WORD = 2, 3


def search_segment(seg: tuple, items: Items, least: int) -> list[tuple[int, int, int]]:
    """Search one segment for all items: (document, item, words)."""
    ids, begins, terms, sizes, _, block = seg
    place = np.frombuffer(zlib.decompress(block), "<i4").astype(np.int64).cumsum()
    if not len(place) or not len(items.codes):
        return []
    begins = np.array(begins)
    term = np.repeat(np.array(terms, np.int64), sizes)
    order = np.lexsort((term, place))
    place, term = place[order], term[order]
    start, phrase = _phrases(place, term, items)
    doc = np.searchsorted(begins, start, "right") - 1
    again = items.counts[phrase]
    spots = _flat(items.starts[phrase], again)
    pair = np.repeat(doc, again) * len(items.ids) + items.item[spots]
    spot = items.spot[spots]
    diagonal = np.repeat(start - begins[doc], again) - spot
    pair, window, begin, end = _windows(pair, spot, diagonal, items.width)
    if not len(pair):
        return []
    n, first, last, at = _pieces(pair, window, begin, end, begins, place, term, items, least)
    found = []
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    for h, t in zip(heads.tolist(), np.append(heads[1:], len(pair)).tolist()):
        if not _may_reach(n[h:t].tolist(), first[h:t].tolist(), last[h:t].tolist(), at[h:t].tolist(), least):
            continue
        d, k = divmod(int(pair[h]), len(items.ids))
        item = items.passage[items.ids[k]]
        a, b = np.searchsorted(place, begins[d:d + 2])
        where = defaultdict(set)
        for w, p in zip(term[a:b].tolist(), (place[a:b] - begins[d]).tolist()):
            where[items.vocabulary.words[w]].add(p)
        words = passage_words(item, int(begins[d + 1] - begins[d] - 1), where, least)
        if words >= least:
            found.append((ids[d], items.ids[k], words))
    return found


def _windows(pair: np.ndarray, spot: np.ndarray, diagonal: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """The one or two windows of diagonals in which a pair has most phrases, if it has LEAST_PHRASES there and
    two stand in one order: (pair, window, first and last spot of its phrases), by pair."""
    if not len(pair):
        return pair, pair, spot, spot
    band = diagonal // STEP
    low = int(band.min())
    reach = int(band.max()) - low + 1
    key = np.unique((pair * reach + (band - low)) * width + spot)
    window, spot = np.divmod(key, width)
    first = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
    many = np.diff(np.append(first, len(window)))
    begin, end = spot[first], spot[np.append(first[1:], len(spot)) - 1]
    owner, band = np.divmod(window[first], reach)
    band += low
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    lone = np.diff(np.append(heads, len(owner))) == 1
    order = np.argsort(owner * 1024 - np.minimum(many, 1023), kind="stable")
    one, two = order[heads], order[np.minimum(heads + 1, len(order) - 1)]
    same_way = (begin[one] <= begin[two]) == (begin[one] + band[one] * STEP <= begin[two] + band[two] * STEP)
    near = np.abs(band[one] - band[two]) <= 1
    pairs = ~lone & (same_way | near) & (many[one] + many[two] >= LEAST_PHRASES)
    keep = np.sort(np.concatenate([one[pairs | (many[one] >= LEAST_PHRASES)], two[pairs]]))
    return owner[keep], band[keep], begin[keep], end[keep]


def _pieces(pair: np.ndarray, window: np.ndarray, begin: np.ndarray, end: np.ndarray, begins: np.ndarray, place: np.ndarray, term: np.ndarray, items: Items, least: int) -> tuple[np.ndarray, ...]:
    """Of each window the best local alignment: (words in common, first and last spot of the item, diagonal).
    All windows advance together, one word of the items at a time, from ``least`` words before a window's
    first phrase to as many behind its last."""
    # a place of the documents has one test word, or a few that it may be
    first_at = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    nth = np.arange(len(place)) - np.repeat(first_at, np.diff(np.append(first_at, len(place))))
    longest = items.words.shape[1]
    layers = []
    for i in range(int(nth.max()) + 1):
        x = np.full(int(begins[-1]) + 2 * (longest + BAND), -1, np.int32)
        x[place[nth == i] + longest + BAND] = term[nth == i]
        layers.append(x)
    out = [np.zeros(len(pair), np.int32) for _ in range(4)]
    start, stop = np.maximum(0, begin - least), np.minimum(longest, end + 3 + least)
    by_length = np.argsort(stop - start, kind="stable")
    lost = np.int32(OTHER_WORD << 16)
    for a in range(0, len(pair), 2048):
        own = by_length[a:a + 2048]
        d, k = np.divmod(pair[own], len(items.ids))
        rows, length, q0 = len(own), int((stop - start)[own[-1]]), start[own]
        low = window[own] * STEP - (BAND - STEP) // 2
        where = (begins[d] + low + q0)[:, None] + np.arange(length + BAND)[None, :]
        outside = (where < begins[d][:, None]) | (where >= (begins[d + 1] - 1)[:, None])
        np.clip(where + longest + BAND, 0, len(layers[0]) - 1, out=where)
        texts = []
        for x in layers:
            t = x[where]
            t[outside] = -1
            if not texts or (t >= 0).any():
                texts.append(np.ascontiguousarray(t.T))
        spots = np.minimum(q0[:, None] + np.arange(length)[None, :], longest)
        words = np.ascontiguousarray(np.pad(items.words, ((0, 0), (0, 1)), constant_values=items.size)[k[:, None], spots].T)
        score = np.zeros((BAND, rows), np.int32)
        best, last, on = np.zeros(rows, np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int32)
        gain, other = np.int32((SAME_WORD << 16) + (1 << 8)), np.int32(0)
        for q in range(length):
            met = texts[0][q:q + BAND] == words[q]
            for t in texts[1:]:
                met |= t[q:q + BAND] == words[q]
            # score, words in common and the first spot in one number; a new piece begins at any word in common
            new = np.where(met, np.maximum(score, max(0, 255 - q)) + gain, score - lost)
            np.maximum(new[:-1], score[1:] - lost, out=new[:-1])
            # words of the document left out: best from each lower diagonal
            for step in (1, 2, 4):
                np.maximum(new[step:], new[:-step] - step * lost, out=new[step:])
            new[new < 1 << 16] = other
            score = new
            top = score.max(axis=0)
            up = np.flatnonzero(top > best)
            if len(up):
                best[up], last[up], on[up] = top[up], q, score[:, up].argmax(axis=0)
        for x, y in zip(out, (np.maximum((best >> 8) & 255, (best >> 16) // SAME_WORD), q0 + 255 - (best & 255), q0 + last, low + on)):
            x[own] = y
    return tuple(out)


def _may_reach(n: list[int], first: list[int], last: list[int], at: list[int], least: int) -> bool:
    """Whether one piece, or two in order, may have ``least`` words."""
    if max(n) >= least or max(last) - min(first) > 250:  # of longer pieces the first spot is not known
        return True
    return any(
        n[x] + n[y] - max(0, last[x] - first[y] + 1) >= least and first[x] <= first[y] and first[x] + at[x] <= last[y] + at[y]
        for x in range(len(n)) for y in range(len(n)) if x != y)


# ---------------------------------------------------------------- operators


def index_of(docs: DataFrame, passage: dict[int, list[str]]) -> DataFrame:
    """The stored index: one row per segment, written once to the shared checkpoint folder."""
    words = {w for ws in passage.values() for w in ws}

    def build(batches):
        import pyarrow as pa

        posting = Posting(Vocabulary(words))
        types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary())
        names = ["docs", "begins", "terms", "sizes", "held", "block"]

        def out(part):
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(segment(part, posting), types)], names=names)

        for batch in batches:
            part, size = [], 0
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ws = norm_words(t)
                part.append((d, ws))
                size += len(ws)
                if len(part) >= SEGMENT_DOCS or size >= SEGMENT_WORDS:
                    yield out(part)
                    part, size = [], 0
            if part:
                yield out(part)

    source = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    return durable(spread(source).mapInArrow(build, "docs array<long>, begins array<long>, terms array<int>, sizes array<int>, held array<int>, block binary"))


def leaks(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, item_id, words): documents that hold at least ``least`` words of an item's passage."""
    texts = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the test set has {size} characters; split it into parts of {MOST_BYTES}")
    passage = passages({r["item_id"]: r["text"] for r in texts.collect()})
    index = index_of(docs, passage)
    # in how many documents each test word stands: at most as many numbers as the test set has words
    df = {r["term"]: r["df"] for r in index.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.held").alias("df")).collect()}

    def search(batches):
        import pyarrow as pa

        ready = Items(passage, df)
        for batch in batches:
            for row in batch.to_pylist():
                found = search_segment((row["docs"], row["begins"], row["terms"], row["sizes"], row["held"], row["block"]), ready, least)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "words"])

    return index.mapInArrow(search, "doc_id long, item_id long, words int")


def p7_leaks(spark: SparkSession, directory: str) -> DataFrame:
    return leaks(read_table(spark, directory, "documents"), read_table(spark, directory, "eval_items"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return p7_leaks(spark, directory).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, directory: str) -> DataFrame:
    """Per leaked item: in how many documents, and the most words of it in one."""
    return p7_leaks(spark, directory).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("most_words"))


QUERIES = {"p7_found": p7_found, "p7_leaks": p7_leaks, "p7_items": p7_items}
