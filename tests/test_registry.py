"""Registered queries on small fixtures of their own."""

from folioframe.plans import registry


def test_include_closure_has_no_last_level(spark, tmp_path):
    rows = [("p", "b0", None), *(("p", f"b{i}", f"b{i - 1}") for i in range(1, 8)), ("p", "x", "missing"), ("p", "y", "z"), ("p", "z", "y")]
    spark.createDataFrame(rows, "paper string, id string, parent string").write.parquet(str(tmp_path / "blocks.parquet"))
    got = {(r.id, r.depth) for r in registry.queries()["include_closure"](spark, str(tmp_path)).collect()}
    assert got == {(f"b{i}", i) for i in range(8)}
