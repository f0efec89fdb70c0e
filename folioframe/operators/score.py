"""Benchmark scores of engines against decided readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def engine_summary(scores: DataFrame) -> DataFrame:
    """Per engine over all kinds and per kind, in one pass. ``scores``: (engine, kind, correct, empty)."""
    return scores.rollup("engine", "kind").agg(F.grouping("engine").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("double")), 4).alias("correct"), F.count_if("empty").alias("empty")).where("g = 0").select("engine", F.coalesce("kind", F.lit("all")).alias("kind"), "n", "correct", "empty")


def pair_agreement(scores: DataFrame) -> DataFrame:
    """Every pair of engines on common items. The self-join is on the item, whose rows are as many as
    there are engines, and pairs are combined before the shuffle. ``scores``: (paper, block, engine, key, correct)."""
    a = scores.select("paper", "block", F.col("engine").alias("a"), F.col("key").alias("ka"), F.col("correct").alias("ca"))
    b = scores.select("paper", "block", F.col("engine").alias("b"), F.col("key").alias("kb"), F.col("correct").alias("cb"))
    j = a.join(b, ["paper", "block"]).where("a < b")
    agree = (F.col("ka") == F.col("kb")) & (F.col("ka") != "")
    return j.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("agree"), F.count_if(agree & ~F.col("ca")).alias("agree_but_wrong"),
        F.round(F.try_divide(F.count_if(agree & F.col("ca")).cast("double"), F.count_if(agree).cast("double")), 4).alias("agreement_precision"), F.count_if(F.col("ca") | F.col("cb")).alias("either_correct"))


def precision_recall(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and misses of two key sets in one full outer join."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(True))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(True))
    n = p.join(g, keys, "full_outer").agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & F.col("g").isNull()).alias("fp"), F.count_if(F.col("g") & F.col("p").isNull()).alias("fn"))
    return n.select("tp", "fp", "fn", F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), 6).alias("precision"), F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), 6).alias("recall"))


def benchmark(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Per engine over all reference formulas: how many it answered, with blanks, right, and not at all.
    ``scores``: (paper, block, engine, correct, empty); ``gold``: (paper, block)."""
    all_ = gold.distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(1))
    own = scores.groupBy("engine").agg(F.count(F.lit(1)).alias("answered"), F.count_if("empty").alias("empty"), F.count_if("correct").alias("correct")).withColumn("k", F.lit(1))
    return own.join(all_, "k").select("engine", "n", "answered", "empty", "correct", (F.col("n") - F.col("answered")).alias("missing"))


def table(rows: DataFrame, name: str, *counts: str) -> DataFrame:
    """Rows as lines of a console table: the name to the left, counts to the right."""
    return rows.select(name, F.format_string("%-24s" + " %8d" * len(counts), name, *counts).alias("line"))
