"""The text operators' plain parts against brute force, round trips and small cases."""

import itertools
import random

import pytest

from folioframe.llm import p1_markup as p1
from folioframe.llm import p2_encoding as p2
from folioframe.llm import p3_truncation as p3
from folioframe.llm import p4_consensus as p4
from folioframe.llm import p5_lookalike as p5
from folioframe.llm import p6_scan as p6
from folioframe.llm import p7_leak as p7
from folioframe.llm import p8_mix as p8
from folioframe.llm import p9_quality as p9

def test_columns_come_out_as_python():
    import pyarrow as pa

    from folioframe.llm.base import to_python

    kinds = [
        (pa.list_(pa.struct([("a", pa.int32()), ("b", pa.string()), ("c", pa.list_(pa.string()))])), [[{"a": 1, "b": "x", "c": ["y", None]}, {"a": None, "b": None, "c": None}], None, [], [None], [{"a": 2, "b": "", "c": []}]]),
        (pa.string(), ["a", None, "", "é", "b"]), (pa.int64(), [1, None, 3, 4, 5]), (pa.int64(), [1, 2, 3, 4, 5]), (pa.float64(), [1.5, 2.0, 3.0, 4.0, 5.0]), (pa.bool_(), [True, False, None, True, True]), (pa.bool_(), [True, False, True, True, False]),
        (pa.struct([("x", pa.int32())]), [{"x": 1}, None, {"x": None}, {"x": 4}, {"x": 5}])]
    for kind, values in kinds:
        column = pa.array(values, kind)
        assert to_python(column) == values and to_python(column.slice(1, 3)) == values[1:4] and to_python(column.slice(5)) == []
        assert all(type(a) is type(b) for a, b in zip(to_python(column), values))


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("text", ["<p>Text", "a &amp; b", "## Head\n\ntext", "a **b** c", "_a_ b", "`x`", "== H ==", "[[a|b]]", "{{note|x}}", "''Remark'' a", r"\textbf{a}", r"so $x_1$ is", "a~\\cite{b}", "word</i> left", "a** left", "> quoted text", "- item\n- item", "| a | b |", "{|\n| a\n|}", r"\begin{itemize}", "<!-- x --> a", "[a](#b)", "x<br/>y"])
def test_markup_is_found(text):
    assert p1.markup_in(text, "text")


@pytest.mark.parametrize("text", ["", " ", "Plain text.", "Here a < b and b > c hold.", "The unit costs $12 to $15.", "It reads f(x) = 2^3 + 1.", "We set p_max and q_min.", "Both a_1 and a_2.", "Note: 2*n + 1 terms.", "See item #3 of the R&D record.", "About ~5 K.", r"The log lies in D:\runs\new.", "Entries [3] and [17] agree.", "• a\n• b", "1. a\n2. b", "The set {1, 2, 5} is enough.", "x < 3 were dropped; n > 40", "3 * 4 * 5"])
def test_plain_text_is_no_markup(text):
    assert p1.markup_in(text, "text") == []


def test_code_is_no_markup():
    assert p1.markup_in("for t in range(4):\n    a = a + b[t] * 2 ** 3  # x", "code") == []
    assert p1.markup_in("<pre><code>x = 1</code></pre>", "code")


def test_best_region_equals_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        toks = [(rng.choice(["word", "html_tag", "punct"]), i, i + 1) for i in range(rng.randint(0, 14))]
        w = {"word": 1.0, "html_tag": -1.5, "punct": 0.0}
        best = max([0.0] + [sum(w[t[0]] for t in toks[a:b]) for a, b in itertools.combinations(range(len(toks) + 1), 2)])
        assert abs(p1.best_region(toks, w)[2] - best) < 1e-9


@pytest.mark.parametrize("text", ["Text\n:: item", ";; item", "a\n;: item"])
def test_lists_of_colons_are_scanned(text):
    marks, _, markup = p1.region_of(text, "text", p1.PRIOR)
    assert marks == ["wiki_list"] and markup[2] > 0


def test_weights_are_learnt_and_decide():
    seen = p1.label_tokens("<b>a</b> **dense** scheme 12", "a dense scheme 12", "text")
    assert seen["html_tag", False] == 2 and seen["md_strong", False] == 2 and seen["word", True] == 3 and seen["number", True] == 1
    weights = p1.odds({("html_tag", False): 50, ("md_list", True): 60, ("md_list", False): 2, ("word", True): 90})
    assert weights["html_tag"] < 0 < weights["word"] and weights["md_list"] > 0
    found = lambda t, w: p1.region_of(t, "text", w)[2][2] > 0
    assert found("- a <b>b</b>", weights) and not found("- a\n- b", weights) and found("- a\n- b", p1.PRIOR)
    assert not found("- a <b>b</b>", {c: abs(w) for c, w in weights.items()})


def test_nothing_is_lost_outside_the_region():
    text = "Short lead text here." + "<div>" * 6 + "The body of the text stands in the middle and is much longer than the rest of it." + "</div>" * 6 + "Trailing words."
    words = p1.to_clean(text).split()
    assert words[:3] == ["Short", "lead", "text"] and words[-2:] == ["Trailing", "words."]


def test_method_gives_the_best_region_of_every_record(spark, data):
    weights = p1.weights_for(spark, data)
    texts = {(r.paper, r.block, r.seq): (r.content, r.kind) for r in p1.records(spark, data).collect()}
    got = {(r.paper, r.block, r.seq): r for r in p1.QUERIES["p1_method"](spark, data).collect()}
    assert got.keys() == texts.keys()
    for k, (text, kind) in texts.items():
        if text and p1.SIGNS.search(text):
            assert (got[k].region_start, got[k].region_end) == p1.best_region(p1.tokens(text, kind), weights)[:2]


def test_conversion_keeps_structure():
    assert p1.to_clean("<h2>Head</h2><p>A <b>b</b>.</p>") == "Head\n\nA b."
    assert p1.to_clean("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}").replace("\n\n", "\n") == "• a\n• b"
    assert p1.to_clean("| a | b |\n|---|---|\n| 1 | 2 |") == "a\tb\n1\t2"
    assert p1.to_clean("'''A''' [[x|y]]{{n|z}}") == "A y"
    assert p1.to_clean("see $x^2$ now") == "see x^2 now"
    assert p1.to_clean("```\na = [1]\n```") == "a = [1]"
    assert p1.to_clean("D:\\runs\\new") == "D:\\runs\\new"
    clean = "Nothing to do here."
    assert p1.to_clean(clean) == clean and p1.to_clean("") == ""


# ---------------------------------------------------------------- 2

WORDS = {"en": "the spectrum of a matrix is not naïve résumé “so” – façade class term step Éthrin doesn’t".split() * 2, "ru": "точные сигналы изменяют внутренние переходы после шагов и в на с".split(), "de": "die Größen überlagern für Näherungen".split()}


@pytest.fixture(scope="module")
def model():
    return p2.Model(WORDS)


def garbled(text, chain):
    return [p2.garble(c, p2.CHAINS[chain][0]) if not c.isascii() else c for c in text]


@pytest.mark.parametrize("chain,text", [("utf_8:cp1252", "die Größen überlagern für Näherungen"), ("cp866:cp1251", "точные сигналы изменяют внутренние переходы"), ("utf_8:latin_1", "the naïve résumé of a façade term"), ("cp1252:mac_roman", "the résumé step of a façade class"), ("utf_8:cp1251", "die Größen überlagern")])
def test_round_trip(model, chain, text):
    _, turned = p2.restore(model, pieces := garbled(text, chain), chain)
    assert "".join(turned.get(i, m) for i, m in enumerate(pieces)) == text


@pytest.mark.parametrize("text", ["the naïve résumé – façade", "точные сигналы", "die Größen für Näherungen", "plain ascii", ""])
def test_genuine_text_stays(model, text):
    assert p2.restore(model, list(text), None) == (None, {})


def test_undo_inverts_garble():
    for name, (steps, _) in p2.CHAINS.items():
        for c in "éßжЯ–”的":
            m = p2.garble(c, steps)
            if m and "�" not in m and "?" not in m:
                assert p2.undo(m, steps) in (c, None), name


# ---------------------------------------------------------------- 3


def cand(content, meta=None, limit=False, prefix=False):
    return {"seq": 0, "engine": "e", "content": content, "meta": meta, "limit": limit, "prefix": prefix}


def cuts(kind, block, *texts, **more):
    return [f["cut"] for f in p3.judge_text([cand(t, **more) for t in texts], kind, block)]


def test_cut_texts():
    full = "The first sentence stands here. The second one is longer than the first."
    assert cuts("text", full, full[:50], full) == [True, False]
    assert cuts("text", full, full[:50]) == [True]
    assert cuts("text", full[:50], full[:50], full[:50]) == [False, False]  # it runs on
    assert cuts("heading", "A Heading Without Mark", "A Heading Without Mark") == [False]
    assert cuts("text", None, "An unknown wor", prefix=True) == [True]
    assert cuts("text", full + "\np. 12", full) == [False]
    assert cuts("table", None, "<table><tr><td>a</td></tr></table>", "<table><tr><td>a</t") == [False, True]


def test_cut_formulas():
    got = [f["cut"] for f in p3.judge_formula([cand(r"\frac{a}{b}+c"), cand(r"\frac{a}{b"), cand(r"\frac{a}{b}+"), cand("x")])]
    assert got == [False, True, True, False]
    assert p3._meta("{bad") == (False, False) and p3._meta('{"finish_reason":"length"}') == (True, False) and p3._meta("[1]") == (False, False)


def test_goes_on():
    assert p3._goes_on("abcdefghij", "abcdefghijklm") == 3 and p3._goes_on("abc", "abc") == 0


def test_method_by_trie_and_lengths(spark, data, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def row(i, content, engine="e"):
        return {"paper": "p", "block": f"b{i}", "seq": 0, "engine": engine, "content": content}

    line = "the spectrum of a dense operator converges, and the scheme stops there. "
    rows = [row(i, line) for i in range(40)] + [row(40, "and the spec"), row(41, "and the"), row(42, None), row(43, " "), row(44, "x" * 900)]
    rows += [row(50 + i, (line * 3)[i:][:100], "f") for i in range(12)]
    for name, rs in (("candidates", rows + rows[40:41]), ("blocks", [])):
        schema = pq.read_schema(f"{data}/{name}.parquet")
        pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rs], schema), tmp_path / f"{name}.parquet")
    got = {r.block: r for r in p3.p3_method(spark, str(tmp_path)).collect()}
    assert got["b40"].cut and got["b40"].prefix_bits > p3.CUT_BITS and got["b40"].limit_bits == 0
    assert "b41" not in got and "b42" not in got and "b43" not in got and "b44" not in got
    assert all(got[f"b{50 + i}"].limit_bits > 3 for i in range(12))


# ---------------------------------------------------------------- 4


@pytest.mark.parametrize("a,b", [("x^2", "x^{2}"), (r"$$a\leq b$$", r"a \le b"), (r"\dfrac{1}{2}", r"\tfrac 12"), ("x_1^2", "x^2_1"), (r"\hat x", r"\hat{x}"), ("{x}+y", "x + y"), ("x\u200d=1", "x=1"), ("ｘ＋１", "x+1"), (r"a\,b", "ab"), ("а=1", "a=1")])
def test_same_reading(a, b):
    assert p4.canonical(a) == p4.canonical(b)


@pytest.mark.parametrize("a,b", [("x^12", "x^{12}"), ("x_1", "x_2"), (r"\beta=1", r"B=1"), (r"\sum_{k=1}^n", r"\sum^{k=1}_n"), ("a<b", r"a\le b")])
def test_other_reading(a, b):
    assert p4.canonical(a) != p4.canonical(b)


def test_distance_equals_full_edit_distance():
    def full(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    rng = random.Random(2)
    for _ in range(200):
        a, b = (tuple(rng.choice("xyz") for _ in range(rng.randint(0, 7))) for _ in "ab")
        assert p4.distance(a, b) == min(5, full(a, b))


def test_families_err_together():
    m = p4.Community(["a", "b", "c", "d"], ["inline_math"])
    near = [["right", "near"], ["near", "right"]]
    read = [("a", "f", 0), ("b", "f", 0), ("c", "g", 1), ("d", "h", 1)]
    post = p4.posterior(m, "inline_math", read, near, None)
    assert post[1] > post[0] and abs(sum(post) - 1) < 1e-9
    assert p4.posterior(m, "inline_math", read, near, 0) == [1.0, 0.0]


def test_reliability_is_learnt():
    m = p4.Community(["good", "bad"], ["inline_math"])
    for _ in range(4):
        m.update({("good", "inline_math", "right"): 95, ("good", "inline_math", "near"): 5, ("bad", "inline_math", "right"): 40, ("bad", "inline_math", "near"): 60})
    assert m.rate["good", "inline_math", "right"] > m.rate["bad", "inline_math", "right"]


def test_bound_never_falls_and_few_readings_lean():
    rng = random.Random(4)
    engines = {"a": 0.95, "b": 0.95, "c": 0.6, "d": 0.6, "new": 0.95}
    rel = [["right", "near"], ["near", "right"]]
    blocks = []
    for i in range(300):
        who = [e for e in engines if e != "new" or i < 4]
        blocks.append([(e, e, int(rng.random() > engines[e])) for e in who])
    m = p4.Community(sorted(engines), ["inline_math"])
    bounds = []
    for _ in range(25):
        counts, total = {}, 0.0
        for read in blocks:
            _, bound, own = p4.infer(m, "inline_math", read, rel, None)
            total += bound
            for e, r, n in own:
                counts[e, "inline_math", r] = counts.get((e, "inline_math", r), 0.0) + n
        bounds.append(m.bound(total))
        m.update(counts)
    assert all(y >= x - 1e-6 for x, y in zip(bounds, bounds[1:])) and bounds[-1] > bounds[0] + 10
    rate = {e: m.rate[e, "inline_math", "right"] for e in engines}
    assert min(rate["a"], rate["b"]) > max(rate["c"], rate["d"]) and abs(rate["new"] - rate["a"]) < abs(rate["new"] - rate["c"])


def test_digamma():
    assert abs(p4.digamma(1.0) + 0.5772156649015329) < 1e-9 and abs(p4.digamma(0.5) + 1.9635100260214235) < 1e-9
    assert abs(p4.dirichlet_divergence([2.0, 3.0], [2.0, 3.0])) < 1e-12 < p4.dirichlet_divergence([2.0, 3.0], [1.0, 1.0])


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("text,want", [("cafe\u0301", "café"), ("a\u00a0b", "a b"), ("so\u200bft", "soft"), ("ＡＢ１", "AB1"), ("ﬁrst", "first"), ("dеnѕіty", "density"), ("Тable", "Table"), ("гrафик", "гrафик"), ("", ""), ("“x” – y", "“x” – y"), ("Привет", "Привет"), ("слoво", "слово"), ("\ue000�", "\ue000�"), ("的、。", "的、。")])
def test_consistent_form(text, want):
    f = p5._forms()
    assert f.rewrite(text)[0] == want and f.rewrite(want)[0] == want


def test_formulas_take_latin_letters():
    f = p5._forms()
    assert f.rewrite("ѕ+ν", math=True)[0] == "s+v" and f.rewrite("αν", math=True, greek_regular=True)[1] == set()


def test_union_find_is_transitive():
    u = p5.UnionFind()
    u.unite("a", "b")
    u.unite("c", "b")
    assert u.find("a") == u.find("c") and u.find("d") == "d" and sorted(map(len, u.classes().values())) == [1, 3]


def test_method_takes_the_frequent_member(spark):
    f = p5.Forms()
    assert p5.skeleton("dеnѕіty", f) == p5.skeleton("density", f) == p5.skeleton("den\u200bsity", f) != p5.skeleton("intensity", f)
    assert p5.skeleton("cafe\u0301", f) == p5.skeleton("café", f) and p5.skeleton("ﬁrst", f) == p5.skeleton("first", f)
    words = spark.createDataFrame([("density", 9), ("dеnѕіty", 2), ("ａｘ", 5), ("ax", 3), ("alone", 1)], "word string, n long")
    assert {tuple(r) for r in p5.word_classes(words).collect()} == {("dеnѕіty", "density"), ("ax", "ａｘ")}
    assert p5.greedy("ax, axe (ax) dеnѕіty", {"ax": "ａｘ", "dеnѕіty": "density"}) == "ａｘ, axe (ａｘ) density" and p5.greedy("", {"a": "b"}) == ""


# ---------------------------------------------------------------- 6

COUNTS = {w: 100 for w in "the scheme converges while this dense operator describes a periodic process and stops".split()} | {"mean-field": 50, "mean": 80, "field": 80, "modern": 60}


def lexicon(tokens):
    out = {}
    for w in p6.pieces(tokens):
        keys = p6.meeting_keys(w)
        alts = [(v, n, s) for v, n in COUNTS.items() if v != w and p6.class_key(v) in keys and (s := p6.steps_between(w, v))]
        out[w] = (COUNTS.get(w, 0), alts)
    return out


def fix(text, heads=(), numbers=()):
    lines = text.split("\n")
    marks = p6.furniture(lines, [p6.head_key(h) for h in heads], set(numbers))
    return p6.repair(text, [], set(), lexicon(p6.stream(lines, marks)), 10000.0, marks)


def test_repair():
    assert fix("the scheme con-\nverges") == ("the scheme converges", ["broken_word"])
    assert fix("this rnodern operafor") == ("this modern operator", ["misread"])
    assert fix("a mean-\nfield process") == ("a mean-field process", [])
    assert fix("the scheme per-\n12\niodic process", numbers=["12"]) == ("the scheme periodic process", ["broken_word", "page_number"])
    assert fix("while THE DENSE TITLE\nTHE DENSE TITLE OF IT\nstops", heads=["The Dense Title Of It"])[1] == ["running_head"]
    assert fix("the scheme converges while this dense operator") == ("the scheme converges while this dense operator", [])
    assert fix("")[1] == []


def test_confusion_distance_is_symmetric_to_enumeration():
    for read, meant in (("rnodel", "model"), ("operafor", "operator"), ("c0ntinuous", "continuous"), ("thresholcl", "threshold")):
        assert p6.steps_between(read, meant) == 1.0 and p6.class_key(meant) in p6.meeting_keys(read)
    assert p6.steps_between("abc", "xyz") is None


def test_boundaries_equal_brute_force():
    rng = random.Random(12)

    def cost(lines, cuts):
        full, total, a = max(map(len, lines)), 0.0, 0
        for b in [*cuts, len(lines)]:
            total += 4.0 + (0.0 if b == len(lines) or p6._ENDS.search(lines[b - 1]) else 9.0)
            total += sum(0.0 if len(x) >= 0.7 * full else 7.0 if p6._ENDS.search(x) else 2.0 for x in lines[a:b - 1])
            a = b
        return total

    for _ in range(150):
        lines = ["word " * rng.randint(1, 9) + rng.choice(["ends.", "goes on"]) for _ in range(rng.randint(2, 8))]
        got = [i + 1 for i in p6.boundaries(lines, [(False, False)] * len(lines))][:-1]
        want = min(cost(lines, c) for n in range(len(lines)) for c in itertools.combinations(range(1, len(lines)), n))
        assert abs(cost(lines, got) - want) < 1e-9
    assert len(p6.boundaries(["a short line"] * 5000, [(False, False)] * 5000)) >= 1


def test_misread_is_the_same_at_ten_times_the_rows(spark, data, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def found(times):
        folder = str(tmp_path / str(times))
        (tmp_path / str(times)).mkdir()
        texts = ["the scheme converges while this dense operator stops " * 20 + ("the schenne stops" if i < 5 else "the scheme stops") for i in range(20)]
        rows = {
            "blocks": [{"paper": f"p{t}", "id": f"b{i}", "page": 0, "kind": "text", "text": x} for t in range(times) for i, x in enumerate(texts)],
            "pages": [], "papers": [], "documents": []}
        for name, rs in rows.items():
            schema = pq.read_schema(f"{data}/{name}.parquet")
            pq.write_table(pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rs], schema), f"{folder}/{name}.parquet")
        return {tuple(r) for r in p6.p6_found(spark, folder).collect()}

    monkeypatch.setattr(p6, "REFERENCE", 1000, raising=False)
    one, ten = found(1), found(10)
    assert one == {("p0", f"b{i}", "misread") for i in range(5)}
    assert ten == {(f"p{t}", b, d) for _, b, d in one for t in range(10)}


# ---------------------------------------------------------------- 7


def test_passage_words_equals_brute_force_on_exact_pieces():
    rng = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    for _ in range(40):
        n = rng.randint(5, 40)
        a = rng.randint(0, 40 - n)
        doc = [f"z{i}" for i in range(rng.randint(0, 30))] + item[a:a + n] + [f"y{i}" for i in range(rng.randint(0, 30))]
        assert p7.passage_words(item, doc) == n
    assert p7.passage_words(item, item[20:40] + item[0:20]) == 20  # another order: one piece only
    assert p7.passage_words(item, item[:10] + ["q"] * 30 + item[25:35]) == 20  # two pieces
    assert p7.passage_words(item, []) == 0


def test_words_are_compared_without_form():
    assert p7.norm_words("Ｔhe <b>Café</b>, cafe\u0301!") == ["the", "cafe", "cafe"]
    assert p7.alike("turbulence", "furbulence") and not p7.alike("cat", "car")


def search(passage, docs, size=7):
    """(document, item) found through an index of small segments."""
    items = p7.Items(passage, {})
    posting = p7.Posting(items.vocabulary)
    cut = [(d, p7.norm_words(t)) for d, t in docs]
    return {(d, k) for a in range(0, len(cut), size) for d, k, _ in p7.search_segment(p7.segment(cut[a:a + size], posting), items, 15)}


def test_search_equals_brute_force():
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    passage = {k: [rng.choice(vocab) for _ in range(30)] for k in range(4)}
    docs = []
    for d in range(40):
        ws = [rng.choice(vocab) for _ in range(60)]
        if d % 4 == 0:
            k, a = rng.randrange(4), rng.randint(0, 10)
            ws[20:40] = passage[k][a:a + 20]
        docs.append((d, " ".join(ws)))
    want = {(d, k) for d, t in docs for k, ws in passage.items() if p7.passage_words(ws, p7.norm_words(t)) >= 15}
    assert search(passage, docs) == search(passage, docs, 100) == want and len(want) >= 10
    assert search(passage, [(1, ""), (2, "v1")]) == set() and search({}, docs) == set()


def test_two_pieces_in_order_are_found():
    rng = random.Random(6)
    item = _item(rng, 40)
    docs = [(n, " ".join(["x"] * 9 + item[3:3 + n] + ["y"] * 50 + item[20:20 + 15 - n] + ["z"] * 9)) for n in range(5, 11)]
    assert search({1: item}, docs) == {(n, 1) for n in range(5, 11)}
    turned = [(0, " ".join(item[20:28] + ["y"] * 50 + item[3:11]))]
    assert search({1: item}, turned) == set()


def test_stock_language_is_no_passage():
    rng = random.Random(8)
    stock = _item(rng, 12)
    items = {k: _item(rng, 15) + stock + _item(rng, 15) for k in range(4)}
    items[9] = list(items[0])  # a copy of an item is not another item
    docs = [(0, " ".join(_item(rng, 20) + stock + _item(rng, 3) + stock)), (1, " ".join(items[0])), (2, " ".join(_item(rng, 9) + items[1][4:19]))]
    assert search(items, docs) == {(1, 0), (1, 9), (2, 1)}
    short = {k: stock + ["v", "w", "x", f"y{k}"] for k in range(3)}  # nothing of their own: all phrases count
    assert {k for _, k in search(short, [(0, " ".join(stock + ["v", "w", "x"]))])} == {0, 1, 2}


def test_stored_postings_give_the_places_back():
    import zlib

    import numpy as np

    docs = [(7, ["a", "b", "a"]), (9, []), (8, ["c", "zz", "a"])]
    posting = p7.Posting(p7.Vocabulary({"a", "b", "c"}))
    ids, begins, terms, sizes, held, block = p7.segment(docs, posting)
    places = np.frombuffer(zlib.decompress(block), "<i4").cumsum().tolist()
    assert (ids, begins, terms, sizes, held) == ([7, 9, 8], [0, 4, 5, 9], [0, 1, 2], [3, 1, 1], [2, 1, 1]) and places == [0, 2, 7, 1, 5]


def test_long_tags_are_no_words():
    assert p7.norm_words("a <p class='" + "word " * 60 + "'>b</p> c < d") == ["a", "b", "c", "d"]


def _item(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n)]


def test_short_windows_open_at_any_size():
    """Windows of 15 words, up to 4 of them misread or 4 strange ones put between."""
    rng = random.Random(7)
    item = _item(rng, 40)
    docs = []
    for start in range(26):
        for edits in range(5):
            for change in (False, True):
                ws = item[start:start + 15]
                for i in sorted(rng.sample(range(1, 15), edits), reverse=True):
                    ws[i:i + 1] = ["zz"] + ws[i:i + 1] if change else [ws[i][:4] + "0" + ws[i][5:]]
                docs.append((len(docs), " ".join(["before"] * 20 + ws + ["behind"] * 20)))
    # strange words near an end may part less than a piece from the rest: the alignment decides
    want = {d for d, t in docs if p7.passage_words(item, p7.norm_words(t)) >= 15}
    for others in (0, 1000):
        filler = [(10_000 + i, " ".join(item)) for i in range(others)]
        got = {d for d, _ in search({1: item}, docs + filler, 512) if d < 10_000}
        assert got == want and len(want) >= 200


def test_item_in_a_third_of_the_documents(spark):
    rng = random.Random(9)
    wide, other = _item(rng, 40), _item(rng, 40)
    docs = []
    for d in range(300):
        ws = _item(rng, 30)
        if d % 3 == 0:
            ws[10:10] = wide
        elif d % 60 == 1:
            ws[10:10] = wide[d % 20:d % 20 + 15]  # a part of it elsewhere
        elif d % 60 == 2:
            ws[10:10] = other
        docs.append((d, " ".join(ws)))
    got = p7.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(wide)), (2, " ".join(other))], "item_id long, text string"))
    want = {(d, 1) for d in range(300) if d % 3 == 0 or d % 60 == 1} | {(d, 2) for d in range(300) if d % 60 == 2}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


@pytest.mark.parametrize("every", [100, 20, 5, 1])
def test_no_item_is_too_widely_leaked(every):
    rng = random.Random(10)
    item = _item(rng, 40)
    docs = [(d, " ".join(_item(rng, 20) + (item if d % every == 0 else []) + _item(rng, 5))) for d in range(400)]
    assert search({1: item}, docs, 512) == {(d, 1) for d in range(0, 400, every)}


# ---------------------------------------------------------------- 8


def test_pivot_keeps_mass_and_decides():
    rows = [(i, 10 + i % 7, 0.37) for i in range(500)]
    out = p8.pivot(rows, 1)
    assert len(out) == 500 and sum(0 < p < 1 for _, _, p in out) <= 1
    assert abs(sum(s * p for _, s, p in out) - sum(s * p for _, s, p in rows)) < 1e-6
    assert p8.pivot(rows, 1) == out and p8.pivot([], 1) == []
    assert p8.pivot([(1, 0, 0.5)], 1) == [(1, 0, 0.0)]


def test_plan_fills_up():
    got = p8.plan({"a": 100, "b": 10}, {"a": (0.5, 1.0), "b": (0.5, 2.0), "c": (0.1, 1.0)}, 100)
    assert got["b"] == 2.0 and abs(got["a"] - 0.8) < 1e-9 and got["c"] == 0.0
    assert p8.plan({}, {}) == {}


# ---------------------------------------------------------------- 9

SHAPED = {
    "prose": ["We find that the operator of the process converges, because the scheme is dense. It stops.", "Die Werte sind nicht in der Reihe, und sie werden von der Messung mit dem Gerät auf die Probe gestellt.", "光滑的探测器可以放大电流的区域。线性的矩阵可以放大曲率的边界。"],
    "list": ["- a dense scheme\n- an operator\n- the process", "1. a dense scheme\n2. an operator\n3. the process"],
    "table": ["| a | b |\n|---|---|\n| x | 1.5 |\n| y | 2.5 |", "name,value,other\nx,1.5,2\ny,2.5,3\nz,3.5,4"],
    "junk": ["Home | Login | Search | Help | Contact", "67 77 e5 11 da 64 73 74 98 a4 4f 72\nf3 b3 1b da 0e 1b 05 6d 74 88 58 83"]}


def fitted(texts):
    totals = p9.Counter()
    for t in texts:
        lang, *parts = p9.features(t)
        s = p9.seed(parts[0])
        totals[lang, s, "n", ""] += 1
        for what, x in zip("kwc", parts):
            for k, n in x.items():
                totals[lang, s, what, k] += n
    return p9.Profiles(totals)


PROFILES = fitted([t for ts in SHAPED.values() for t in ts])


def shape_of(text):
    far = PROFILES.far(*p9.features(text))
    return p9.nearest({s: sum(w * x for w, x in zip(p9.WEIGHTS, far[s])) for s in p9.SHAPES})


@pytest.mark.parametrize("text,shape", [
    ("We find that the operator of the process converges, because the scheme is dense. It stops.", "prose"),
    ("- a dense scheme\n- an operator\n- the process", "list"), ("References\n[1] Name, A. Title. Letters 5, 6.\n[2] Name, B. Title. Letters 7, 8.", "list"),
    ("| a | b |\n|---|---|\n| x | 1.5 |\n| y | 2.5 |", "table"), ("name,value,other\nx,1.5,2\ny,2.5,3\nz,3.5,4", "table"),
    ("Home | Login | Search | Help | Contact", "junk"), ("67 77 e5 11 da 64 73 74 98 a4 4f 72\nf3 b3 1b da 0e 1b 05 6d 74 88 58 83", "junk"), ("T h e   s a m e   l a m i n a r   f l o w", "junk"), ("", "junk"),
    ("光滑的探测器可以放大电流的区域。线性的矩阵可以放大曲率的边界。", "prose")])
def test_shapes(text, shape):
    assert (shape_of(text) if text else "junk") == shape


def test_divergence():
    assert p9.js({"a": 1.0}, {"a": 1.0}) == 0 and abs(p9.js({"a": 1.0}, {"b": 1.0}) - 1) < 1e-9
    assert abs(p9.js({"a": 0.5, "b": 0.5}, {"a": 1.0}) - p9.js({"a": 1.0}, {"a": 0.5, "b": 0.5})) < 1e-12


def test_profiles_decide(spark):
    """The nearest profile by words and characters alone: other profiles, other shapes."""
    text = SHAPED["list"][0]
    far = PROFILES.far(*p9.features(text))
    assert p9.nearest({s: x[1] + x[2] for s, x in far.items()}) == "list"
    other = p9.Profiles({(lang, {"list": "junk", "junk": "list"}.get(s, s), what, k): n for (lang, s, what, k), n in PROFILES.totals.items()})
    far = other.far(*p9.features(text))
    assert p9.nearest({s: x[1] + x[2] for s, x in far.items()}) == "junk"


def test_profiles_need_no_label(spark):
    text = SHAPED["prose"][1]
    docs = spark.createDataFrame([(1, text, None), (2, text, "xx"), (3, " ", "de"), (4, None, "de"), (None, text, "de")], "doc_id long, text string, lang string")
    got = p9.profiles_of(p9.measured(docs))
    assert {k[0] for k in got.totals} == {"de"} and got.totals["de", "prose", "n", ""] == 2
    rows = {r.doc_id: r for r in p9.judged(docs).collect()}
    assert {d: r["shape"] for d, r in rows.items()} == {1: "prose", 2: "prose", 3: "junk"}
    assert rows[1].word_js < 1e-9 and rows[3].language is None
