import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.operators import fuzzy, grep, stubs
from codeseam.operators.budget import allocate, prune, water_fill
from codeseam.operators.stubs import stub

FILES = "repo string, file_id long, path string, filename string, ext string, size long, content string, category string"


def files(spark, *rows):
    out = [(r, n, p, p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1] if "." in p else "", len(t.encode()) if t is not None else None, t, c) for n, (r, p, t, c) in enumerate(rows)]
    return spark.createDataFrame(out, FILES)


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_describe_splits_words_and_hints(spark):
    d = lambda p: one(spark, C.describe(F.col("p")), p=p)
    assert d("a/SaveGame.h") == "Save Game (header)"
    assert d("HTTPServer_core.rs") == "HTTP Server core (source)"
    assert d("a.b/Makefile") == "Makefile"


def test_category_strips_prefix_and_noise(spark):
    def cat(p, scan, noise):
        return one(spark, C.category(F.col("p"), F.array(*map(F.lit, scan)), F.array(*map(F.lit, noise))), p=p)

    assert cat("src/a/Private/b/x.c", ["src"], ["Private"]) == "a > b"
    assert cat("x.c", ["src"], ["Private"]) == "Other"
    assert cat("a/b/c/d/e/f/x.c", ["src"], ["none"]) == "a > b > c > d > e"


def test_small_columns(spark):
    assert one(spark, C.fence(F.col("e")), e="rs") == "rust" and one(spark, C.fence(F.col("e")), e="go") == "go"
    assert [one(spark, C.byte_label(F.col("n")), n=n) for n in (900, 2048, 3 << 20)] == ["900", "2.0K", "3.0M"]
    assert one(spark, C.ancestors(F.col("c")), c="a > b > c") == ["a", "a > b", "a > b > c"]
    assert one(spark, C.cut_line(F.col("t"), 3), t="abcd") == "abc..." and one(spark, C.bitmask(F.col("t")), t="aB9/") == 1 | 2 | 1 << 35 | 1 << 39


def test_path_guard(spark):
    e = lambda p: one(spark, C.path_error(F.col("p")), p=p)
    assert (e(""), e("../x"), e("/x"), e("a/b.c")) == ("empty", "parent", "absolute", None)


def test_lines_ignore_a_final_end(spark):
    n = lambda t: one(spark, F.size(C.lines(F.col("t"))), t=t)
    assert [n("a\r\nb\r\n"), n("a\nb"), n("\n"), n(""), n("a\n\n")] == [2, 2, 1, 0, 2]


def test_grep_modes_and_dirty_texts(spark):
    rows = files(spark, ("r", "a/graph.py", "graph session\nnothing\n", "a"), ("r", "b/x.py", "graph\nsession\n", "b"), ("r", "c/y.py", "", "c"), ("r", "d/z.py", "x" * 100_000, "d"))
    paths = lambda mode, q="graph session": [r["path"] for r in grep.grep(rows, q, mode).collect()]
    assert paths("all") == ["a/graph.py"] and set(paths("any")) == {"a/graph.py", "b/x.py"}
    assert paths("exact") == ["a/graph.py"] and set(paths("regex", "^sess")) == {"b/x.py"}
    for bad in (("any", " "), ("regex", "("), ("other", "x")):
        with pytest.raises(ValueError):
            grep.line_match(F.col("x"), bad[1], bad[0])
    assert grep.grep(rows.limit(0), "graph", "any").count() == 0


def test_more_matches_score_higher(spark):
    score = lambda m: one(spark, grep.relevance(F.lit(m), F.lit(100), F.lit("x"), F.lit("rs"), ["t"], F.lit(1), F.lit(50), F.array(F.lit(1.0))))
    assert score(10) > score(1)


def test_fuzzy_scores():
    assert fuzzy.fuzzy_score("SaveGame", "SG", False)[0] > 0
    assert fuzzy.fuzzy_score("abc", "xyz") is None and fuzzy.fuzzy_score("abc", "") == (0.0, [])
    assert fuzzy.fuzzy_score("foo_bar", "bar")[1] == [4, 5, 6]
    exact = fuzzy.score_file([fuzzy.Token("actor")], "Actor.h", "a/Actor.h", "Actor")
    longer = fuzzy.score_file([fuzzy.Token("actor")], "ActorComponent.h", "a/ActorComponent.h", "")
    assert exact >= 10_000 > longer >= 5_000


@settings(max_examples=150, deadline=None)
@given(st.text("aAbB_/1", max_size=12), st.text("ab1", min_size=1, max_size=4))
def test_fuzzy_positions_spell_the_pattern(text, pattern):
    got = fuzzy.fuzzy_score(text, pattern)
    it = iter(text.lower())
    assert got is None or ("".join(text[i].lower() for i in got[1]) == pattern and got[1] == sorted(set(got[1])))
    if got:
        assert all(c in it for c in pattern)


def test_file_search_smart_case_and_empty(spark):
    rows = files(spark, ("r", "a/SaveGame.h", "x", "a"), ("r", "a/savegame.h", "x", "a"))
    assert fuzzy.search_files(rows, "  ", 5).count() == 0
    assert [r["path"] for r in fuzzy.search_files(rows, "SvGm", 5).collect()] == ["a/SaveGame.h"]
    assert fuzzy.search_files(rows, "svgm", 5).count() == 2


def test_stubs_keep_signatures_and_drop_bodies():
    rs = stub("pub fn f(x: i32) -> i32 {\n    let y = x;\n    y\n}\n", "rs")
    assert "pub fn f(x: i32) -> i32 { /* ... */ }" in rs and "let y" not in rs
    py = stub("class A:\n    def m(self):\n        return 1\n\ndef g(a):\n    return 2\n", "py")
    assert "class A:" in py and "def m(self):" in py and "return" not in py and "..." in py
    ts = stub("class A {\n    x: number;\n    f() {\n        return 1;\n    }\n}\n", "ts")
    assert "x: number;" in ts and "return 1" not in ts
    cpp = stub("class A\n    : public B\n    , public C\n{\npublic:\n    int x;\n    A() : x(1)\n    {\n        run();\n    }\n};\n", "cpp")
    assert "int x;" in cpp and "public:" in cpp and "run();" not in cpp
    assert stub("a" * 10, None) == "a" * 10 + "\n" and stub("", "rs") == "" and stub(None, "py") == ""
    assert stub('{"a": {"b": {"c": 1}}, "d": [1, 2]}', "json").count("{...}") == 1
    assert stub("[s]\n" + "".join(f"k{i}=1\n" for i in range(9)), "ini").count("=") == 5


def test_blocks_cover_kinds():
    text = stub("#include <a/b.h>\n#include \"c.h\"\n\nclass A {\n    int x;\n};\n\nint f(int a) {\n    return a;\n}\n", "cpp")
    kinds = [b.kind for b in stubs.blocks(text, "cpp")]
    assert kinds == ["imports", "class", "function"]
    assert stubs.blocks(text, "cpp")[0].summary == "// 2 imports (b.h, c.h)\n"


def test_chunks_end_at_blank_lines():
    parts = stubs.chunks("a" * 50 + "\n\n" + "b" * 50 + "\nshort\n\nc\n", 1500)
    assert [p[0] for p in parts] == [1, 3] and all(len(t) >= 40 for _, t in parts)


def test_water_fill_cases():
    assert water_fill([], 1000) == []
    assert water_fill([(1.0, 500, 10)], 1000) == [500]
    three = [(1.0, 400, 10), (0.5, 400, 10), (0.2, 400, 10)]
    got = water_fill(three, 500)
    assert sum(g or f[2] for g, f in zip(got, three)) <= 500
    a, b = water_fill([(10.0, 300, 10), (1.0, 300, 10)], 400)
    assert a >= b


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 20), st.integers(1, 900), st.integers(1, 30)), max_size=12), st.integers(0, 5000))
def test_water_fill_keeps_the_budget(files, budget):
    spent = sum(g or f[2] for g, f in zip(water_fill(files, budget), files))
    assert spent <= max(budget, sum(f[2] for f in files)) + sum(max(0, f[2] - f[1]) for f in files)


def test_allocation_tiers():
    body = "class A {\n" + "".join(f"    int f{i}(int x) {{ return x; }}\n" for i in range(60)) + "};\n"
    body = stub(body, "cpp")
    few = allocate([("a.cpp", "cpp", body, "a", 1.0)], 100_000, [])
    assert few[0][1] == 1
    tight = allocate([("a.cpp", "cpp", body, "a", 1.0), ("b.cpp", "cpp", body, "b", 0.1)], 120, ["f1"])
    assert {t[1] for t in tight} <= {2, 4} and sum(t[2] for t in tight) <= 120
    assert prune([], [], 10) == ""
