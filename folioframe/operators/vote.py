"""Consensus of independent recogniser families on formula candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(candidates: DataFrame) -> DataFrame:
    """One row per (paper, block, engine): the run with the highest ``seq``."""
    last = F.row_number().over(Window.partitionBy("paper", "block", "engine").orderBy(F.desc("seq")))
    return candidates.dropDuplicates(["paper", "block", "seq"]).withColumn("r", last).where("r = 1").drop("r")


def with_family(candidates: DataFrame, engines: DataFrame) -> DataFrame:
    """Family as given, else as registered for formulas, else the engine's own name; and preference."""
    known = engines.groupBy("engine").agg(F.min("formula_family").alias("known"), F.min("pref").alias("pref"))
    return candidates.join(known, "engine", "left").withColumn("family", F.coalesce("family", "known", "engine")).drop("known")


def simple_key(content: Column) -> Column:
    """A normal form that SQL can express: outer dollars and spaces off, single scripts braced, aliases one."""
    # commands that begin like a shorter one are set apart meanwhile
    t = F.regexp_replace(content, r"\\([lg])eq(q|slant)", r"\\$1E$2")
    t = F.regexp_replace(t, r"^\s*(\$\$?|\\\[|\\\()|(\$\$?|\\\]|\\\))\s*$", "")
    t = F.regexp_replace(t, r"\\leq", r"\\le")
    t = F.regexp_replace(t, r"\\geq", r"\\ge")
    t = F.regexp_replace(t, r"\\(dfrac|tfrac)", r"\\frac")
    t = F.regexp_replace(t, r"(\\[,;:!]|\s)", "")
    t = F.regexp_replace(t, r"([_^])([A-Za-z0-9])", "$1{$2}")
    return F.regexp_replace(t, r"\\([lg])E(q|slant)", r"\\$1eq$2")


def decide(votes: DataFrame) -> DataFrame:
    """Decision per block. ``votes`` has (paper, block, engine, family, pref, content, key, rejected).

    Groups of equal keys are ranked by distinct families, then by their best engine. Two families
    without dissent are unanimous, strictly more families than any other group a majority. The
    partial aggregation runs before the shuffle; both windows share the partitioning of the group-by.
    """
    rank = F.struct(F.coalesce("pref", F.lit(2**31 - 1)).alias("pref"), "engine")
    block = Window.partitionBy("paper", "block")
    per_block = votes.groupBy("paper", "block").agg(F.count(F.lit(1)).alias("n_candidates"))
    groups = votes.where("not rejected").groupBy("paper", "block", "key").agg(F.array_sort(F.collect_set("family")).alias("fams"), F.min(rank).alias("best"), F.min_by("content", rank).alias("value"))
    order = block.orderBy(F.desc(F.size("fams")), "best")
    top = groups.withColumn("place", F.row_number().over(order)).withColumn("groups", F.count(F.lit(1)).over(block)).withColumn("second", F.lead(F.size("fams")).over(order)).where("place = 1")
    j = per_block.join(top, ["paper", "block"], "left")
    n = F.coalesce(F.size("fams"), F.lit(0))
    two = n >= 2
    clear = two & (n > F.coalesce("second", F.lit(0)))
    names = F.array_join("fams", "+")
    status = F.when(two & (F.col("groups") == 1) | clear, "accepted").when(F.col("groups") == 1, "unverified").when(F.col("n_candidates") >= 2, "conflict").otherwise("unverified")
    rule = (
        F.when(two & (F.col("groups") == 1), F.concat(F.lit("unanimous:"), names)).when(clear, F.concat(F.lit("majority:"), names))
        .when(F.col("groups") == 1, F.concat(F.lit("single_family:"), F.element_at("fams", 1))).when(F.col("n_candidates") >= 2, "disagreement").otherwise("single_candidate"))
    return j.select("paper", "block", status.alias("status"), "value", rule.alias("rule"), "n_candidates", F.coalesce("groups", F.lit(0)).alias("n_groups"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The state that holds per block: the latest, and of equals the greatest by status, value, rule, author and evidence."""
    return decisions.groupBy("paper", "block").agg(F.max(F.struct("decided_at", "status", "value", "rule", "by", "evidence")).alias("d")).select("paper", "block", "d.*")
