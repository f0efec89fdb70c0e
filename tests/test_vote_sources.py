"""Votes, regions, cache, models, colours, streaming on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from folioframe.functions import colour, udfs
from folioframe.operators import vote
from folioframe.sources import models, regions
from folioframe.streaming import votes


def decide(spark, *cands):
    rows = [("p", "b", f"e{i}", fam, i, text, False) for i, (fam, text) in enumerate(cands)]
    v = spark.createDataFrame(rows, "paper string, block string, engine string, family string, pref int, content string, rejected boolean").withColumn("key", udfs.layout_form("content"))
    return vote.decide(v).first()


def test_votes(spark):
    d = decide(spark, ("fa", "x^2"), ("fb", "x^{2}"))
    assert (d.status, d.rule, d.value) == ("accepted", "unanimous:fa+fb", "x^2")
    d = decide(spark, ("fa", "x"), ("fa", "x"))
    assert (d.status, d.rule) == ("unverified", "single_family:fa")
    d = decide(spark, ("fa", "x_1"), ("fb", "x_2"))
    assert (d.status, d.rule) == ("conflict", "disagreement")
    d = decide(spark, ("fa", "x"), ("fb", "x"), ("fc", "y"))
    assert (d.status, d.rule) == ("accepted", "majority:fa+fb")
    d = decide(spark, ("fa", "x"))
    assert (d.status, d.rule) == ("unverified", "single_family:fa")


def test_rejected_candidates_do_not_vote(spark):
    v = spark.createDataFrame([("p", "b", "e", "f", 1, "{", True, "{")], "paper string, block string, engine string, family string, pref int, content string, rejected boolean, key string")
    d = vote.decide(v).first()
    assert (d.status, d.rule, d.value) == ("unverified", "single_candidate", None)


def test_layout_boxes(spark):
    box = lambda label, order: {"cls_id": 1, "label": label, "score": 1.0, "coordinate": [20, 40, 60, 80], "order": order}
    js = json.dumps({"boxes": [box("doc_title", 2), box("text", None)]})
    got = regions.from_layout(spark.createDataFrame([("p", 0, 2.0, js)], "paper string, page int, scale double, json string")).orderBy("idx").collect()
    assert [(r.kind, r.ord, r.level, r.x0, r.y1) for r in got] == [("title", 1.0, 1, 10.0, 40.0), ("text", 2.0, None, 10.0, 40.0)]


def test_middle_json(spark):
    block = {"type": "text", "bbox": [0, 0, 9, 9], "index": 3, "lines": [{"spans": [{"type": "text", "content": "let "}, {"type": "inline_equation", "content": "x"}]}]}
    js = json.dumps({"pdf_info": [{"page_idx": 1, "page_size": [10, 10], "para_blocks": [block], "discarded_blocks": [block]}]})
    got = regions.from_middle(spark.createDataFrame([("p", js)], "paper string, json string")).orderBy("ord").collect()
    assert [(r.page, r.kind, r.ord, r.text) for r in got] == [(1, "text", 3.0, "let $x$"), (1, "furniture", 10003.0, "let $x$")]


def test_files(spark, tmp_path):
    (tmp_path / "A b.pdf").write_bytes(b"x")
    (tmp_path / "note.txt").write_bytes(b"y")
    got = regions.files(spark, str(tmp_path)).withColumn("key", regions.paper_key(F.col("path"))).collect()
    assert len(got) == 1 and got[0].size == 1 and len(got[0].sha256) == 64
    with pytest.raises(NotImplementedError):
        regions.glyphs_from_pdf(None)


def test_cache_and_model(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, content string").withColumn("key", models.content_key("content"))
    cache = items.where("id = 1").select("key", F.lit("A").alias("output"))
    hits, misses = models.cached(items, cache)
    assert [r.id for r in hits.collect()] == [1]
    assert sorted(r.output for r in models.run_model(misses, lambda rs: [r["content"].upper() for r in rs], 2).collect()) == ["B", "C"]


def test_colours(spark):
    n = spark.createDataFrame([(x,) for x in (0, 1, 39, 40, 1599, 60000)], "n long").withColumn("c", colour.encode(F.col("n")))
    assert all(r.n == r.m for r in n.select("n", colour.decode(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("m")).collect())
    assert spark.range(1).select(colour.decode(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("m")).first().m is None


def test_stream(spark, data, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{data}/candidates.parquet").select("paper", "block", "seq", "engine", "family", "content", "run_at").write.parquet(src)
    q = votes.start(votes.read_candidates(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert q.exception() is None
