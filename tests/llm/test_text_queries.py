"""The text queries on the small tables, on empty ones, and on ones with nulls, copies and odd columns."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from folioframe.llm.queries import oracle_sql, queries

TABLES = "papers pages glyphs blocks candidates decisions engines documents eval_items mix_targets".split()
COLUMNS = {
    "p1_found": ["paper", "block", "seq"], "p2_found": ["paper", "page", "span", "ch"], "p3_found": ["paper", "block", "seq"], "p4_found": ["paper", "block", "engine"], "p5_found": ["tbl", "paper", "item"],
    "p6_found": ["paper", "id", "defect"], "p7_found": ["doc_id", "item_id"], "p8_mixture": ["doc_id", "source", "n_tokens", "copies"], "p9_found": ["doc_id", "shape"]}


def write(folder, name, table):
    pq.write_table(table, os.path.join(folder, f"{name}.parquet"))


@pytest.fixture(scope="module")
def hard(data, tmp_path_factory):
    """Every row twice, null rows, a very long text, and extra columns that clash with the operators' own."""
    folder = str(tmp_path_factory.mktemp("hard"))
    for name in TABLES:
        t = pq.read_table(f"{data}/{name}.parquet")
        if name in ("glyphs", "candidates", "documents", "blocks"):
            t = t.slice(0, 400)
        nulls = pa.table({f.name: pa.nulls(2, f.type) for f in t.schema}, schema=t.schema)
        t = pa.concat_tables([t, t, nulls])
        if name in ("documents", "candidates"):
            column = "text" if name == "documents" else "content"
            i = t.schema.get_field_index(column)
            values = t.column(i).to_pylist()
            values[0], values[1], values[2] = "word <b>of</b> the text. " * 3000, "", " \n\t "
            t = t.set_column(i, t.schema.field(i), pa.array(values, t.schema.field(i).type))
        for extra in ("word", "rows", "n", "chain", "label", "flags", "term", "copies", "shape", "r"):
            if extra not in t.schema.names:
                t = t.append_column(extra, pa.array([1] * t.num_rows))
        write(folder, name, t)
    return folder


@pytest.fixture(scope="module")
def empty(data, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in TABLES:
        write(folder, name, pq.read_table(f"{data}/{name}.parquet").slice(0, 0))
    return folder


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, name):
    got = queries()[name](spark, data)
    if name in COLUMNS:
        assert got.columns == COLUMNS[name]
        pdf = got.toPandas()
        assert len(pdf) and not pdf.duplicated().any()
    else:
        assert got.count() >= 0


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_hard_tables(spark, hard, name):
    pdf = queries()[name](spark, hard).toPandas()
    assert list(pdf.columns) == COLUMNS[name] and not pdf.duplicated().any()


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_empty_tables(spark, empty, name):
    assert queries()[name](spark, empty).count() == 0


METHODS = {
    "p1_method": ["paper", "block", "seq", "region_start", "region_end", "score", "markup_start", "markup_end", "markup_score"], "p3_method": ["paper", "block", "seq", "prefix_bits", "limit_bits", "cut"],
    "p5_method": ["tbl", "paper", "item", "words", "rewritten"], "p6_method": ["paper", "id", "text", "paragraphs", "defects"], "p9_method": ["doc_id", "language", "word_js", "class_js", "shape"]}


@pytest.mark.parametrize("name", sorted(METHODS))
def test_methods_on_hard_and_empty_tables(spark, hard, empty, name):
    got = queries()[name](spark, hard)
    assert got.columns == METHODS[name] and got.count() >= 0
    assert queries()[name](spark, empty).count() == 0


def test_methods_stand_first():
    """Where a method has a query of its own, it is the problem's first."""
    names = list(queries())
    for n in METHODS:
        assert next(x for x in names if x.startswith(n.split("_")[0] + "_")) == n


def test_mixture_reaches_shares(spark, data):
    rows = queries()["p8_shares"](spark, data).collect()
    mixed = queries()["p8_mixture"](spark, data).toPandas()
    for r in rows:
        mine = mixed[mixed.source == r.source]
        assert (mine.n_tokens * mine.copies).sum() == r.mixed_tokens
        assert abs(r.mixed_tokens - r.expected_copies * r.source_tokens) <= (mine.n_tokens.max() if len(mine) else 0)
        assert r.expected_copies <= r.max_repeats + 1e-9


def test_stats_equal_sql(spark, data):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{data}/documents.parquet'")
    for name, sql in oracle_sql().items():
        got, want = queries()[name](spark, data).toPandas().sort_values("doc_id"), c.execute(sql).df().sort_values("doc_id")
        assert got.columns.tolist() == want.columns.tolist()
        assert (got.fillna(-1).round(6).to_numpy() == want.fillna(-1).round(6).to_numpy()).all()
