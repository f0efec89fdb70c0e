"""Settings, papers, TeX projects, reference data and deliveries on small fixtures of their own."""

import pytest
from pyspark.sql import functions as F

from folioframe.functions import colour, tex
from folioframe.operators import delivery
from folioframe.sources import papers, settings


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path))
    monkeypatch.delenv("FOLIOFRAME_SETTINGS", raising=False)
    monkeypatch.chdir(tmp_path)
    assert settings.load() == settings.Settings() and settings.load().engine("x") == settings.Engine("x")
    (tmp_path / "folioframe.toml").write_text('[pipeline]\nlayout = "l"\nformula = ["a"]\nformula_fallback = ["b"]\n[engines.a]\ndevice = "cpu"\nbeam = 3\n[answers]\nmode = "off"\n')
    s = settings.load()
    assert s.order == ("a", "b") and s.engine("a").device == "cpu" and s.engine("a").options == {"beam": 3} and s.answers == "off"
    assert s.stage_key("text") is None and s.stage_key("reconcile") != settings.Settings().stage_key("reconcile") and len(s.stage_key("layout")) == 16
    (tmp_path / "bad.toml").write_text('[answers]\nmode = "x"\n')
    with pytest.raises(ValueError, match="answers.mode"):
        settings.load(tmp_path / "bad.toml")


def test_listing(spark, tmp_path):
    with pytest.raises(Exception):
        papers.listed(spark, str(tmp_path / "none"))
    (tmp_path / "a").mkdir()
    with pytest.raises(FileNotFoundError):
        papers.listed(spark, str(tmp_path / "a"))
    (tmp_path / "a" / "x y.pdf").write_bytes(b"1")
    (tmp_path / "a" / "note.txt").write_bytes(b"1")
    got = papers.listed(spark, str(tmp_path / "a"))
    assert [r.paper for r in got.collect()] == ["x_y"]
    known = spark.createDataFrame([("x_y", "other")], "paper string, sha256 string")
    assert papers.changed(got, known).count() == 1
    (tmp_path / "a" / "x_y.pdf").write_bytes(b"2")
    with pytest.raises(ValueError, match="one key"):
        papers.listed(spark, str(tmp_path / "a"))


def test_documents_come_back(spark, tmp_path):
    d = spark.createDataFrame([("p", [("a", 1)]), ("q", [])], "paper string, blocks array<struct<id:string,page:long>>")
    papers.save_documents(d, str(tmp_path / "d"))
    assert sorted(papers.load_documents(spark, str(tmp_path / "d")).select("paper", "blocks").collect()) == sorted(d.collect())


def test_tex_projects(spark):
    whole = "\\documentclass{a}\n\\input{preamble}\\begin{document}\\input{sec/one} % \\input{no}\n\\include{two}\\end{document}"
    rows = [("p", "main.tex", whole), ("p", "preamble.tex", "x"), ("p", "sec/one.tex", "\\input{three}\\input{../gone}"), ("p", "sec/three.tex", "\\input{sec/one}"), ("p", "two.tex", ""), ("p", "no.tex", ""),
            ("q", "a.tex", whole), ("q", "ms.tex", whole), ("r", "a.tex", whole), ("r", "b.tex", whole), ("s", "a.tex", whole), ("s", "b.tex", whole)]
    s = spark.createDataFrame(rows, "project string, path string, text string")
    stated = spark.createDataFrame([("s", "b.tex", 1), ("s", "gone.tex", 0)], "project string, path string, rank int")
    mains = papers.main_files(s, stated)
    assert {(r.project, r.path) for r in mains.collect()} == {("p", "main.tex"), ("q", "ms.tex"), ("s", "b.tex")}
    got = papers.included(s.where("project = 'p'"), mains.where("project = 'p'"))
    assert {(r.path, r.depth) for r in got.collect()} == {("main.tex", 0), ("sec/one.tex", 1), ("two.tex", 1), ("sec/three.tex", 2)}


def test_markers():
    text = "a $x$ \\begin{align}y\\\\\\end{align} % $z$\n"
    out, records = tex.instrument(text, 5)
    assert [r["latex"] for r in records] == ["x", "y\\\\"] and records[0]["id"] == 5
    assert out == "a $\\markB{5}x\\markE $ \\begin{align}\\markB{6}y\\markE \\\\\\end{align} % $z$\n"
    out, records = tex.instrument("$p$\\begin{document}$x$", main=True, preamble="P")
    assert out == "$p$P\\begin{document}$\\markB{0}x\\markE $" and len(records) == 1
    with pytest.raises(ValueError):
        tex.instrument("$x$", main=True)
    assert tex.used_unsupported(r"\a\b", tex.unsupported("\\NewDocumentCommand{\\b}{m}{x}\\edef\\c{}\n% \\xdef\\a{}")) == ["b"]


def test_reference_data(spark):
    row = lambda i, **k: {"paper": "p", "id": i, "display": True, "latex": "x", "latex_expanded": "x", "status": "ok", "expansion_complete": True, "unsupported_macros": [], "occurrences": [{"page": 0, "layout_verified": True}], **k}
    schema = "paper string, id int, display boolean, latex string, latex_expanded string, status string, expansion_complete boolean, unsupported_macros array<string>, occurrences array<struct<page:int,layout_verified:boolean>>"
    g = spark.createDataFrame([row(0), row(1, unsupported_macros=["a"]), row(2, occurrences=[]), row(3, latex_expanded=" "), row(4, status="not_rendered"), row(5, display=False)], schema)
    assert [r.id for r in papers.usable(g).orderBy("id").collect()] == [0, 5]
    assert tuple(papers.gold_summary(g).first()) == ("p", 6, 5, 4, 2)
    glyph = "paper string, page int, nth int, text string, x double, y double"
    a = spark.createDataFrame([("p", 0, 0, "a", 1.0, 1.0), ("p", 1, 0, "a", 1.0, 1.0), ("p", 2, 0, "a", 1.0, 1.0)], glyph)
    b = spark.createDataFrame([("p", 0, 0, "a", 1.0, 1.0), ("p", 1, 0, "a", 2.0, 1.0)], glyph)
    assert {r.page for r in papers.shifted_pages(a, b).collect()} == {1, 2}
    marks = spark.createDataFrame([(3,), (3,), (None,)], "n int").withColumn("c", colour.encode(F.col("n"))).select(F.lit("p").alias("paper"), F.lit(0).alias("page"), "c.*", *[F.rand(1).alias(c) for c in ("x0", "y0", "x1", "y1")])
    assert [(r.id, r.n) for r in papers.marked_formulas(marks).collect()] == [(3, 2)]


def test_inline_benchmark(spark):
    gold = spark.createDataFrame([("p", 0, f, d, t, x, 0.0) for f, d, t, x in ((0, False, "a", 1.0), (0, False, "b", 2.0), (1, False, "c", 3.0), (2, False, "d", 4.0), (3, True, "e", 5.0))], "paper string, page int, formula int, display boolean, text string, x double, y double")
    said = spark.createDataFrame([("p", 0, t, x, 0.0, m) for t, x, m in (("a", 1.04, True), ("b", 2.0, True), ("d", 4.0, False), ("e", 5.0, True), ("z", 9.0, True), ("w", 9.5, False))], "paper string, page int, text string, x double, y double, math_font boolean")
    assert papers.inline_benchmark(gold, said).first().asDict() == {"tp": 3, "fp": 1, "fn": 1, "unknown_math_font": 1, "formulas": 3, "exact": 2, "missed": 1, "partial": 0}


def test_slots():
    assert delivery.slotted("a  $x$ b \\(y\\)") == {"text": "a ￼ b ￼", "formulas": ["x", "y"]}
    assert delivery.slotted("costs $5") == {"text": "costs $5", "formulas": []}


def test_answers_from_json(spark):
    rows = [("p/b", '{"choice":"custom","latex":"x"}', "h"), ("p/c", '{"p/c":{"choice":"open"}}', "h"), ("p/d", "no json", "h"), ("p/e", None, "h")]
    got = {r.task_id: r for r in delivery.answers_from_json(spark.createDataFrame(rows, "task_id string, reply string, input_hash string")).collect()}
    assert (got["p/b"].choice, got["p/b"].latex, got["p/b"].note) == ("custom", "x", None) and got["p/c"].choice == "open" and got["p/c"].note is None
    assert got["p/d"].choice == "open" and got["p/d"].note == "no json" and got["p/e"].choice == "open"


def test_stage_table(spark):
    order, shape = settings.STAGES, "paper string, stage string, key string"
    done = spark.createDataFrame([("p", s, "k" if s in ("layout", "recognize") else None) for s in order[:5]] + [("q", "preprocess", None)], shape)
    new = delivery.mark(done, spark.createDataFrame([("p", "text", None)], shape), order)
    assert {(r.paper, r.stage) for r in new.collect()} == {("p", "preprocess"), ("p", "layout"), ("p", "text"), ("q", "preprocess")}
    all_ = spark.createDataFrame([("p",), ("q",), ("r",)], "paper string")
    keys = {"layout": "k", "recognize": "k", "reconcile": "k"}
    assert {(r.paper, r.stage) for r in delivery.due(all_, done, order, keys).collect()} == {("p", "reconcile"), ("q", "layout"), ("r", "preprocess")}
    assert {(r.paper, r.stage) for r in delivery.due(all_, new, order, keys | {"layout": "other"}).collect()} == {("p", "layout"), ("q", "layout"), ("r", "preprocess")}


def test_stages_run_in_order(spark):
    order, ran = ("a", "b", "c"), []

    def body(stage, without=()):
        def run(todo):
            ran.append((stage, sorted(r.paper for r in todo.collect())))
            return todo.where(~F.col("paper").isin(*without)) if without else todo
        return run

    all_ = spark.createDataFrame([("p",), ("q",), ("r",)], "paper string")
    done = spark.createDataFrame([("q", "a", None), ("q", "b", None), ("q", "c", None)], "paper string, stage string, key string")
    now = delivery.run_stages(all_, done, {"a": body("a"), "b": body("b", ["r"]), "c": body("c")}, order, {})
    assert ran == [("a", ["p", "r"]), ("b", ["p", "r"]), ("c", ["p"])]
    assert {(r.paper, r.stage) for r in now.collect()} == {*(("p", s) for s in order), *(("q", s) for s in order), ("r", "a")}


def test_keys_of_compatible_characters(spark):
    rows = spark.createDataFrame([("/a/Ｐａｐｅｒ ﬁ.pdf",), ("/a/日.pdf",), ("x y.z.pdf",)], "path string")
    from folioframe.sources.regions import paper_key

    assert [r.k for r in rows.select(paper_key(F.col("path")).alias("k")).collect()] == ["Paper_fi", "paper", "x_y.z"]


def test_export_needs_final_formulas(spark, tmp_path):
    blocks = spark.createDataFrame([("p", "t", 0, 0.0, 0.0, 9.0, 9.0, "title", 0.0, 0, None, 1, "A \"T\"", [], None, {}), ("p", "f", 0, 0.0, 10.0, 9.0, 19.0, "display_math", 1.0, 1, None, None, "x", [], None, {})],
        "paper string, id string, page int, x0 double, y0 double, x1 double, y1 double, kind string, ord double, seq int, parent string, level int, text string, inline array<string>, extra string, links map<string,string>")
    state = lambda s: spark.createDataFrame([("p", "f", s, "x", "r", "program", None, None)], "paper string, block string, status string, value string, rule string, by string, evidence string, decided_at timestamp")
    with pytest.raises(ValueError, match="1 formulas are open"):
        delivery.export(blocks, state("conflict"), str(tmp_path / "out"))
    delivery.export(blocks, state("accepted"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out" / "paper=p")).collect() if r.value] == ['# A "T"', "$$", "x", "$$"]
    assert delivery.front_matter(blocks).first().front == '---\ntitle: "A \\"T\\""\n---\n'
    marked = {r.id: r.markdown for r in delivery.working_markdown(blocks, state("conflict")).collect()}
    assert marked["f"] == "<!-- f p1 display_math -->\n$$\nx\n$$<!--unresolved f-->" and "unresolved" not in marked["t"]
    numbers = spark.createDataFrame([("p", "f", "associated_by_layout", "3")], "paper string, id string, status string, numbers string")
    assert delivery.display_latex(blocks, state("accepted"), numbers).first().latex == r"x \tag{3}"


def test_command_line(capsys):
    from folioframe.__main__ import main

    assert main(["list"]) == 0 and "batch_status" in capsys.readouterr().out.split()
    assert main(["run", "no_such_query", "a", "b"]) == 2 and main([]) == 2


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from folioframe.session import checkpoint_dir

    unset = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))), setCheckpointDir=lambda folder: None)
    session = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, **vars(unset)), conf=SimpleNamespace(get=lambda key, default: default))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_dir(session(master))
    assert checkpoint_dir(session("local[4]")).endswith("folioframe-checkpoints")
