"""Consensus of several engines' readings of a formula.

Method: a community confusion model. Readings are brought to a canonical form; in a block, engines
with the same form support one reading. An engine belongs to one of a few communities; the engines of a
community share a confusion matrix over what a reading is relative to the right one (right, one symbol
off, several off, cut, blank-like), by kind of formula. Matrices and the communities' shares have Dirichlet
priors; mean-field updates alternate between the posterior over each block's right reading, each engine's
community and the Dirichlet posteriors, until the evidence lower bound no longer grows, so that engines with
few readings lean on their community. Engines of one family err together: an equal wrong reading of one
family is a copy with probability COPY, and counts against its engine only as far as it is none.

Defined results: null and blank readings, and those of no engine, are not read; of an engine's repeated runs the highest
``seq`` is current; a null family is looked up in ``engines`` or, failing that, is the engine's own;
ties fall to the reading with more families, then more engines, then the smaller text; a decision
counts only when its latest state is ``resolved``; blocks with fewer than three current readings
are left out of ``found`` but have a consensus; extra columns are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioframe.llm.base import INVISIBLE, MATH_KINDS, blocks_of, candidates_of, python_stage, to_python
from folioframe.llm.p5_lookalike import LATIN_OF
from folioframe.session import durable, read_table

# Commands that mean the same, and commands that only space.
SAME = {"leq": "le", "leqslant": "le", "geq": "ge", "geqslant": "ge", "neq": "ne", "dfrac": "frac", "tfrac": "frac", "cfrac": "frac", "rightarrow": "to", "longrightarrow": "to", "leftarrow": "gets", "land": "wedge", "lor": "vee", "lnot": "neg", "vert": "|", "lvert": "|", "rvert": "|", "mid": "|", "Vert": "\\|", "lVert": "\\|", "rVert": "\\|", "lbrace": "\\{", "rbrace": "\\}", "lbrack": "[", "rbrack": "]", "varepsilon": "epsilon", "varphi": "phi", "vartheta": "theta", "varrho": "rho", "ast": "*", "star": "*", "dots": "ldots", "cdots": "ldots", "widehat": "hat", "widetilde": "tilde", "overline": "bar", "thickapprox": "approx", "colon": ":", "prime": "'", "boldsymbol": "mathbf", "bm": "mathbf", "operatorname": "mathrm", "text": "mathrm", "textrm": "mathrm", "rm": "mathrm"}
SPACING = set("quad qquad enspace thinspace medspace thickspace negthinspace hspace hfill displaystyle textstyle scriptstyle limits nolimits left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr mathrm nonumber notag".split())
UNICODE = {"≤": "le", "≥": "ge", "≠": "ne", "≈": "approx", "∞": "infty", "×": "times", "·": "cdot", "→": "to", "∑": "sum", "∫": "int", "√": "sqrt", "±": "pm", "∈": "in", "∂": "partial"}
_TOKEN = re.compile(r"\\([a-zA-Z]+)\*?|\\(.)|(\s+)|(.)", re.S)
_FOLD = str.maketrans(LATIN_OF)


@lru_cache(maxsize=100_000)
def canonical(latex: str) -> tuple[str, ...]:
    """Tokens that stay when spacing, optional braces, outer delimiters, synonyms and look-alike
    characters are put aside. Sub- and superscripts come in one order."""
    t = latex.strip() if latex.isascii() else unicodedata.normalize("NFKC", INVISIBLE.sub("", latex)).translate(_FOLD).replace("−", "-").strip()
    while True:
        m = re.fullmatch(r"\s*(?:```(?:latex|math)?\s*(.*?)\s*```|\$\$(.*)\$\$|\$(.*)\$|\\\[(.*)\\\]|\\\((.*)\\\)|\\begin\{(?:equation|displaymath|math)\*?\}(.*)\\end\{(?:equation|displaymath|math)\*?\})\s*", t, re.S)
        if not m:
            break
        t = next(g for g in m.groups() if g is not None).strip()
    t = re.sub(r"^(?:\$\$?|\\\[|\\\()|(?:\$\$?|\\\]|\\\))$", "", t)
    flat: list[str] = []
    for m in _TOKEN.finditer(t):
        if m[1]:
            name = SAME.get(m[1], m[1])
            if name not in SPACING:
                flat.append("\\" + name if len(name) > 1 and name[0] != "\\" else name)
        elif m[2]:
            if m[2] not in ",;:!> /":
                flat.append("\\" + m[2])
        elif m[4]:
            if m[4] != "~":
                flat.append("\\" + UNICODE[m[4]] if m[4] in UNICODE else m[4])
    out, _ = _group(flat, 0, False)
    return tuple(out)


def _group(flat: list[str], at: int, inner: bool, depth: int = 0) -> tuple[list[str], int]:
    """A run of tokens up to the closing brace; scripts get braces, groups of one lose them."""
    out: list[str] = []
    scripts: dict[str, list[str]] = {}

    def flush() -> None:
        for s in ("_", "^"):
            if s in scripts:
                out.extend([s, "{", *scripts.pop(s), "}"])

    def one(i: int) -> tuple[list[str], int]:
        if i < len(flat) and flat[i] == "{" and depth < 60:
            return _group(flat, i + 1, True, depth + 1)
        if i < len(flat) and flat[i] != "}":
            return [flat[i]], i + 1
        return [], i

    while at < len(flat):
        x = flat[at]
        if x == "}" and inner:
            flush()
            return out, at + 1
        if x in "_^" and len(x) == 1:
            body, at = one(at + 1)
            if x in scripts:
                flush()
            scripts[x] = body
            continue
        if x == "'" and out:
            scripts["^"] = scripts.get("^", []) + ["'"]
            at += 1
            continue
        flush()
        if x in ("\\frac", "\\binom"):
            a, at = one(at + 1)
            b, at = one(at)
            out += [x, "{", *a, "}", "{", *b, "}"]
        elif x in ("\\hat", "\\bar", "\\tilde", "\\vec", "\\dot", "\\ddot", "\\mathbf", "\\mathcal", "\\mathbb"):
            a, at = one(at + 1)
            out += [x, "{", *a, "}"]
        elif x == "\\sqrt" and not (at + 1 < len(flat) and flat[at + 1] == "["):
            a, at = one(at + 1)
            out += [x, "{", *a, "}"]
        elif x == "{" and depth < 60:
            a, at = _group(flat, at + 1, True, depth + 1)
            out += a
        else:
            if x != "}":
                out.append(x)
            at += 1
    flush()
    return out, at


RELATIONS = ("right", "near", "far", "cut", "blank")


def distance(a: tuple[str, ...], b: tuple[str, ...], most: int = 4) -> int:
    """Edit distance of token lists, ``most`` + 1 at most."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def relation(reading: tuple[str, ...], right: tuple[str, ...]) -> str:
    if reading == right:
        return "right"
    if len(reading) <= 1 and len(right) > 2 or not reading:
        return "blank"
    if len(reading) < len(right) - 2 and right[:len(reading) - 1] == reading[:-1]:
        return "cut"
    return "near" if distance(reading, right) <= 3 else "far"


# ---------------------------------------------------------------- the model

#: What the matrices of the communities are expected to be, from the best to the worst, and as if from how
#: many readings. The communities differ in this alone; errors are shared out alike.
EXPECTED = tuple((right, *((1 - right) * x for x in (0.55, 0.14, 0.16, 0.15))) for right in (0.97, 0.93, 0.89, 0.84, 0.78, 0.71, 0.63, 0.54, 0.44, 0.33))
PRIOR_STRENGTH = 6.0
#: Pseudo-count of each community's share of the engines.
SHARE = 1.0
#: Probability that an engine repeats its family's error instead of making its own.
COPY = 0.5
#: Ways in which an error of each relation can come out, for one that agrees with no other.
WAYS = {"near": 40.0, "far": 400.0, "cut": 20.0, "blank": 6.0}
#: Updates end when a round adds less than this to the bound, per reading, and after so many at the latest.
GAIN, MOST_ROUNDS = 1e-6, 60


def digamma(x: float) -> float:
    """Derivative of log gamma, for x > 0."""
    low = 0.0
    while x < 8:
        low -= 1 / x
        x += 1
    y = 1 / (x * x)
    return low + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def dirichlet_divergence(a: list[float], b: list[float]) -> float:
    """KL(Dir(a) || Dir(b))"""
    top = digamma(sum(a))
    return math.lgamma(sum(a)) - math.lgamma(sum(b)) + sum(math.lgamma(y) - math.lgamma(x) + (x - y) * (digamma(x) - top) for x, y in zip(a, b))


class Community:
    """Posteriors over the engines' communities, their confusion matrices and shares; a few hundred numbers."""

    def __init__(self, engines: list[str], kinds: list[str]):
        self.engines, self.kinds = engines, kinds
        self.prior = [[PRIOR_STRENGTH * x for x in row] for row in EXPECTED]
        self.matrix = {(c, k): list(row) for c, row in enumerate(self.prior) for k in kinds}
        self.share = [SHARE] * len(EXPECTED)
        self.belongs = {e: [1 / len(EXPECTED)] * len(EXPECTED) for e in engines}
        self.rate: dict = {}
        self._expect()

    def _expect(self) -> None:
        """Expected log probability of each relation, by community and by engine."""
        self.log = {ck: [digamma(x) - digamma(sum(row)) for x in row] for ck, row in self.matrix.items()}
        for e in self.engines:
            for k in self.kinds:
                for i, r in enumerate(RELATIONS):
                    self.rate[e, k, r] = sum(w * self.log[c, k][i] for c, w in enumerate(self.belongs[e]))

    def update(self, counts: dict[tuple[str, str, str], float]) -> None:
        """One mean-field step from expected counts (engine, kind, relation)."""
        n = {(e, k): [counts.get((e, k, r), 0.0) for r in RELATIONS] for e in self.engines for k in self.kinds}
        shares = [digamma(x) - digamma(sum(self.share)) for x in self.share]
        for e in self.engines:
            logs = [shares[c] + sum(x * y for k in self.kinds for x, y in zip(n[e, k], self.log[c, k])) for c in range(len(EXPECTED))]
            top = max(logs)
            ws = [math.exp(x - top) for x in logs]
            self.belongs[e] = [w / sum(ws) for w in ws]
        self.share = [SHARE + sum(b[c] for b in self.belongs.values()) for c in range(len(EXPECTED))]
        for c, k in self.matrix:
            self.matrix[c, k] = [p + sum(self.belongs[e][c] * n[e, k][i] for e in self.engines) for i, p in enumerate(self.prior[c])]
        self._expect()

    def bound(self, of_blocks: float) -> float:
        """The evidence lower bound, given the blocks' part of it under the present posteriors."""
        shares = [digamma(x) - digamma(sum(self.share)) for x in self.share]
        out = of_blocks - dirichlet_divergence(self.share, [SHARE] * len(self.share))
        out -= sum(dirichlet_divergence(row, self.prior[c]) for (c, _), row in self.matrix.items())
        return out - sum(w * (math.log(w) - shares[c]) for b in self.belongs.values() for c, w in enumerate(b) if w > 0)


def infer(model: Community, kind: str, readings: list[tuple[str, str, int]], relations: list[list[str]], fixed: int | None) -> tuple[list[float], float, list[tuple[str, str, float]]]:
    """(P(reading g is the right one) for each distinct reading, the block's part of the bound, expected
    counts (engine, relation, n)).

    readings: (engine, family, group); relations[g][h]: what group h is if g is right.
    """
    logs, own = [], []
    order = sorted(readings)
    for g in range(len(relations)):
        total = 0.0
        seen: set[tuple[str, int]] = set()
        parts = []
        for e, f, h in order:
            r = relations[g][h]
            p, weight = model.rate[e, kind, r], 1.0
            if r != "right":
                if (f, h) in seen:
                    alone = (1 - COPY) * math.exp(p)
                    p, weight = math.log(COPY + alone), alone / (COPY + alone)
                else:
                    p -= math.log(WAYS[r])
                seen.add((f, h))
            total += p
            parts.append((e, r, weight))
        logs.append(total)
        own.append(parts)
    if fixed is not None:
        post, bound = [float(g == fixed) for g in range(len(logs))], logs[fixed]
    else:
        top = max(logs)
        ws = [math.exp(x - top) for x in logs]
        post, bound = [w / sum(ws) for w in ws], top + math.log(sum(ws)) - math.log(len(ws))
    return post, bound, [(e, r, p * w) for p, parts in zip(post, own) if p > 0 for e, r, w in parts]


def posterior(model: Community, kind: str, readings: list[tuple[str, str, int]], relations: list[list[str]], fixed: int | None) -> list[float]:
    """P(reading g is the right one) for each distinct reading."""
    return infer(model, kind, readings, relations, fixed)[0]


# ---------------------------------------------------------------- operators


def current_readings(spark: SparkSession, directory: str) -> DataFrame:
    """(paper, block, engine, family, content, kind, resolved) of formula blocks; current runs only."""
    families = read_table(spark, directory, "engines").groupBy("engine").agg(F.min("formula_family").alias("known"))
    kinds = blocks_of(spark, directory).where(F.col("kind").isin(*MATH_KINDS)).select("paper", F.col("id").alias("block"), "kind")
    latest = (
        candidates_of(spark, directory).groupBy("paper", "block", "engine").agg(F.max(F.struct("seq", "family", "content", "meta")).alias("c"), F.max("family").alias("said"))
        .select("paper", "block", "engine", F.coalesce("c.family", "said").alias("family"), F.col("c.content").alias("content")).where(F.col("content").rlike(r"\S") & F.col("engine").isNotNull())
    )
    decided = (
        read_table(spark, directory, "decisions").groupBy("paper", "block").agg(F.max(F.struct(F.col("decided_at").alias("at"), "status", "value")).alias("d"))
        .where((F.col("d.status") == "resolved") & F.col("d.value").rlike(r"\S")).select("paper", "block", F.col("d.value").alias("resolved"))
    )
    # a handful of engines exist at every size; the optimiser picks the join
    return (
        latest.join(kinds, ["paper", "block"]).join(families, "engine", "left")
        .withColumn("family", F.coalesce("family", "known", "engine")).drop("known").join(decided, ["paper", "block"], "left")
    )


def patterns(readings: DataFrame) -> DataFrame:
    """One row per block: readings grouped by canonical form, and how the forms relate."""
    grouped = readings.groupBy("paper", "block", "kind").agg(F.array_sort(F.collect_list(F.struct("engine", "family", "content"))).alias("rs"), F.max("resolved").alias("resolved"))

    def rows(row: dict):
        keys: list[tuple[str, ...]] = []
        texts: list[str] = []
        read = []
        for r in row["rs"]:
            k = canonical(r["content"])
            if k not in keys:
                keys.append(k)
                texts.append(r["content"])
            read.append({"engine": r["engine"], "family": r["family"], "g": keys.index(k)})
        fixed = None
        if row["resolved"] is not None:
            k = canonical(row["resolved"])
            if k not in keys:
                keys.append(k)
                texts.append(row["resolved"])
            fixed = keys.index(k)
        rel = [[relation(h, g) for h in keys] for g in keys]
        yield row["paper"], row["block"], row["kind"], read, rel, fixed, texts

    return python_stage(grouped, "paper string, block string, kind string, readings array<struct<engine:string,family:string,g:int>>, relations array<array<string>>, fixed int, texts array<string>", rows)


def fit(pats: DataFrame, rounds: int = MOST_ROUNDS) -> Community:
    """Variational fit. Blocks with the same pattern are one row with a count, and each round sends
    back expected counts by engine, kind and relation, and the blocks' part of the bound."""
    names = [r[0] for r in pats.select(F.explode("readings.engine").alias("e")).where("e is not null").distinct().collect()]
    model = Community(sorted(names), list(MATH_KINDS))
    small = durable(pats.groupBy("kind", "readings", "relations", "fixed").agg(F.count(F.lit(1)).alias("n")))
    last = -math.inf
    for _ in range(rounds):
        now = model

        def expect(batches, now=now):
            import pyarrow as pa

            counts: dict = defaultdict(float)
            for b in batches:
                for kind, readings, relations, fixed, times in zip(*(to_python(b.column(c)) for c in ("kind", "readings", "relations", "fixed", "n"))):
                    read = [(x["engine"], x["family"], x["g"]) for x in readings]
                    _, bound, own = infer(now, kind, read, relations, fixed)
                    for e, r, n in own:
                        counts[e, kind, r] += n * times
                    counts["", "", "bound"] += bound * times
                    counts["", "", "readings"] += len(read) * times
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*((*k, v) for k, v in sorted(counts.items())))], names=["engine", "kind", "relation", "n"])

        got = {(r["engine"], r["kind"], r["relation"]): r["n"] for r in small.mapInArrow(expect, "engine string, kind string, relation string, n double").groupBy("engine", "kind", "relation").agg(F.sum("n").alias("n")).collect()}
        size = got.pop(("", "", "readings"), 0.0)
        bound = model.bound(got.pop(("", "", "bound"), 0.0))
        if bound - last < GAIN * size or not size:
            break
        last = bound
        model.update(got)
    return model


def consensus(pats: DataFrame, model: Community) -> DataFrame:
    """Per block: the consensus reading, its probability, and each engine's agreement with it."""

    def rows(row: dict):
        read = [(x["engine"], x["family"], x["g"]) for x in row["readings"]]
        post = posterior(model, row["kind"], read, row["relations"], row["fixed"])
        fams = {g: len({f for _, f, h in read if h == g}) for g in range(len(post))}
        many = Counter(h for _, _, h in read)
        best = max(range(len(post)), key=lambda g: (round(post[g], 9), fams[g], many[g], [-ord(c) for c in row["texts"][g]]))
        same = sum(a[2] == b[2] for i, a in enumerate(read) for b in read[:i])
        pairs = len(read) * (len(read) - 1) // 2
        yield row["paper"], row["block"], row["kind"], row["texts"][best], float(post[best]), len(read), same / pairs if pairs else None, row["fixed"] is not None, [{"engine": e, "family": f, "right": h == best, "relation": row["relations"][best][h]} for e, f, h in read]

    return python_stage(pats, "paper string, block string, kind string, reading string, probability double, n_readings int, agreement double, resolved boolean, engines array<struct<engine:string,family:string,right:boolean,relation:string>>", rows)


def solved(spark: SparkSession, directory: str) -> DataFrame:
    pats = durable(patterns(current_readings(spark, directory)))
    return consensus(pats, fit(pats))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return solved(spark, directory).where("n_readings >= 3").select("paper", "block", F.explode("engines").alias("e")).where("not e.right").select("paper", "block", "e.engine").distinct()


def p4_consensus(spark: SparkSession, directory: str) -> DataFrame:
    """One reading per formula block, with its probability and the pairwise agreement of the engines."""
    return solved(spark, directory).select("paper", "block", "kind", "reading", "probability", "n_readings", "agreement", "resolved")


def p4_engines(spark: SparkSession, directory: str) -> DataFrame:
    """Reliability per engine and kind of formula."""
    e = solved(spark, directory).select("kind", F.explode("engines").alias("e"))
    return e.groupBy("e.engine", "kind").agg(F.count(F.lit(1)).alias("readings"), F.avg(F.col("e.right").cast("double")).alias("reliability"), *[F.count_if(F.col("e.relation") == r).alias(r) for r in RELATIONS[1:]])


QUERIES = {"p4_found": p4_found, "p4_consensus": p4_consensus, "p4_engines": p4_engines}
