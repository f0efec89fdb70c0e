"""Mixing sources to target weights, by size in tokens.

Method: pivotal dependent rounding. Every document gets the expected number of copies that its
source needs for its share, capped at the source's ``max_repeats``; the whole part is certain, the
fraction is rounded: two documents of a source exchange token mass at random until one of them is
decided. Within a bucket one document stays undecided; the undecided ones of all buckets meet on
the next level of a reduction tree until one per source is left, so that a source's size is
reached up to one document.

Sizes. Let S be a source's tokens, w its weight, r its cap. The mixture's size T is ``total``
(default: the tokens of all targeted sources). A source that cannot give w*T gives r*S; what is
missing is spread over the others in proportion to their weights, again and again (filling up),
until T is reached or all sources are at their caps.

Defined results: documents of a null source or one without a target get no copies and are left
out; null and empty texts have size 0 and get the whole part only; duplicate targets of a source
count once (the largest weight); null weights count as 0, null caps as 1; a source without
documents appears in the shares with 0 tokens; the random choices depend on ``doc_id`` and the
seed only; a cap of 2.5 lets every second document be used a third time; repeated ``doc_id`` are one document; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm.base import python_stage, spread
from folioframe.session import durable, read_table

TOKENIZER = os.environ.get("FOLIOFRAME_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Documents that meet in one bucket of the reduction tree.
BUCKET = 20_000


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sized(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of every document. Tokens are counted where the texts stand; only numbers
    are shuffled. Of several rows with one ``doc_id`` the least (source, tokens) holds."""

    def rows(row: dict):
        yield row["doc_id"], row["source"], len(encoder(tokenizer).encode_ordinary(row["text"])) if row["text"] else 0

    counted = python_stage(spread(docs.select("doc_id", "source", "text").where("doc_id is not null")), "doc_id long, source string, n_tokens long", rows)
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.source", "d.n_tokens")


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, float]], total: float | None = None) -> dict[str, float]:
    """source -> expected copies of each of its documents."""
    cap = {s: max(0.0, r) * sizes.get(s, 0) for s, (w, r) in targets.items()}
    weight = {s: w for s, (w, r) in targets.items() if w > 0 and cap[s] > 0}
    left = float(sum(sizes.get(s, 0) for s in targets) if total is None else total)
    give = {s: 0.0 for s in targets}
    open_ = dict(weight)
    while open_ and left > 1e-9:
        mass = sum(open_.values())
        full = [s for s in open_ if open_[s] / mass * left >= cap[s] - 1e-9]
        if not full:
            for s in open_:
                give[s] = open_[s] / mass * left
            break
        for s in full:
            give[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return {s: give[s] / sizes[s] if sizes.get(s) else 0.0 for s in targets}


def chance(*parts) -> float:
    """A number in [0, 1) that depends on the parts only."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=7).digest(), "big") / 2**56


def pivot(rows: list[tuple], seed: int) -> list[tuple]:
    """(doc_id, size, p) -> the same with p 0 or 1 for all but at most one row.

    Pairs exchange token mass: size_i * p_i + size_j * p_j stays as it is, and so does the
    expectation of each p.
    """
    out = []
    hand: tuple | None = None
    for doc, size, p in rows:
        if p <= 1e-9 or p >= 1 - 1e-9 or size <= 0:
            out.append((doc, size, float(round(p)) if size > 0 else 0.0))
            continue
        if hand is None:
            hand = (doc, size, p)
            continue
        d1, s1, p1 = hand
        up = min((1 - p1) * s1, p * size)  # mass from the second to the first
        down = min(p1 * s1, (1 - p) * size)  # and back
        move = up if chance(seed, d1, doc) < down / (up + down) else -down
        a, b = p1 + move / s1, p - move / size
        hand = None
        for d, s, q in ((d1, s1, a), (doc, size, b)):
            if q <= 1e-9 or q >= 1 - 1e-9:
                out.append((d, s, float(round(q))))
            elif hand is None:
                hand = (d, s, q)
            else:
                out.append((d, s, float(chance(seed, "last", d) < q)))
    if hand is not None:
        out.append(hand)
    return out


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares): the copies of every targeted document, and the shares reached."""
    spark = docs.sparkSession
    want = {r["source"]: (r["w"], r["r"]) for r in targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w"), F.max(F.coalesce("max_repeats", F.lit(1.0))).alias("r")).collect()}
    known = durable(sized(docs.where(F.col("source").isin(*want)), tokenizer)) if want else durable(sized(docs.where("false"), tokenizer))
    stats = {r["source"]: (r["n"], r["size"] or 0) for r in known.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("size")).collect()}
    copies = plan({s: v[1] for s, v in stats.items()}, want, total)
    rate = F.create_map(*[x for s in sorted(want) for x in (F.lit(s), F.lit(copies[s]))])[F.col("source")] if want else F.lit(0.0)
    base = known.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-9).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    open_ = base.select("source", "doc_id", "n_tokens", "p")
    decided = []
    buckets = {s: max(1, -(-n // BUCKET)) for s, (n, _) in stats.items()}
    level = 0
    while True:
        last = all(b == 1 for b in buckets.values())
        n = F.create_map(*[x for s in sorted(buckets) for x in (F.lit(s), F.lit(buckets[s]))])[F.col("source")] if buckets else F.lit(1)
        groups = open_.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed + level)), n).cast("int"))

        ending = last

        def settle(pdf):
            pdf = pdf.sort_values("doc_id")
            rows = pivot([(int(d), int(s), float(p)) for d, s, p in zip(pdf["doc_id"], pdf["n_tokens"], pdf["p"])], seed)
            if ending:
                rows = [(d, s, q if q in (0.0, 1.0) else float(chance(seed, "end", d) < q)) for d, s, q in rows]
            import pandas as pd

            return pd.DataFrame([(pdf["source"].iloc[0], d, s, q) for d, s, q in rows], columns=["source", "doc_id", "n_tokens", "p"])

        done = durable(groups.groupBy("source", "bucket").applyInPandas(settle, "source string, doc_id long, n_tokens long, p double"))
        decided.append(done.where("p = 0 or p = 1"))
        if last:
            break
        open_ = done.where("p > 0 and p < 1")
        buckets = {s: max(1, -(-b // BUCKET)) for s, b in buckets.items()}
        level += 1
    extra = decided[0]
    for d in decided[1:]:
        extra = extra.unionByName(d)
    mixed = base.join(extra.select("source", "doc_id", F.col("p").cast("int").alias("extra")), ["source", "doc_id"], "left").select("doc_id", "source", "n_tokens", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies"))
    mixed = durable(mixed)
    sums = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    # one row per target: the result is as small as the targets
    got = {r["source"]: r for r in sums.collect()}
    all_tokens, all_weight = sum(r["mixed_tokens"] for r in got.values()), sum(w for w, _ in want.values())
    rows = []
    for s, (w, r) in sorted(want.items()):
        g = got.get(s)
        mine, own = (g["mixed_tokens"], g["source_tokens"]) if g else (0, 0)
        rows.append((s, float(w), w / all_weight if all_weight else None, mine / all_tokens if all_tokens else None, float(r), copies[s], g["documents"] if g else 0, own, mine, g["most_copies"] if g else 0, copies[s] >= r - 1e-9))
    shares = spark.createDataFrame(rows, "source string, weight double, target_share double, share double, max_repeats double, expected_copies double, documents long, source_tokens long, mixed_tokens long, most_copies long, at_cap boolean")
    return mixed, shares


def p8_mixture(spark: SparkSession, directory: str) -> DataFrame:
    """How often each document is used."""
    return mixture(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_targets"))[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """Target and actual shares of each source."""
    return mixture(read_table(spark, directory, "documents"), read_table(spark, directory, "mix_targets"))[1]


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
