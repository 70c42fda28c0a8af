"""Operators that cut large groups, against their plain forms on small data."""

import random

import pytest
from pyspark.sql import functions as F

from codeseam.functions import tokenizers
from codeseam.operators import budget, graph, stubs, syntax, treemap, views
from codeseam.session import distinct_rows, ensure_checkpoint_dir, numbered, running, small_side
from codeseam.sources import cache


def test_distinct_rows_keep_one_of_each_key(spark):
    rows = spark.createDataFrame([(n % 50 if n % 9 else None, f"t{n % 50}", n) for n in range(400)], "k long, t string, __n long")
    got = distinct_rows(rows, "k").collect()
    assert sorted(r["k"] for r in got) == sorted({n % 50 for n in range(400) if n % 9}) and all(r["t"] == f"t{r['k']}" for r in got)
    plan = distinct_rows(rows, "k")._jdf.queryExecution().toString()
    assert "Broadcast" in plan and distinct_rows(rows.limit(0), "k").count() == 0


def test_running_sums_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.randint(0, 20), n, rng.randint(1, 5)) for n in range(500)]
    frame = spark.createDataFrame(rows, "g long, v long, i long, w long")
    got = running(frame, ["g"], [("v", True), ("i", False)], "w", "before", 50).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    before, place, want, places = {}, {}, {}, {}
    for g, _, i, w in order:
        want[i], places[i] = before.get(g, 0), place.get(g, 0)
        before[g], place[g] = want[i] + w, places[i] + 1
    assert {r["i"]: r["before"] for r in got} == want
    for hot in (10, 10_000):
        assert {r["i"]: r["n"] for r in numbered(frame, "g", [("v", True), ("i", False)], "n", hot).collect()} == places


def test_small_sides_are_bounded_by_characters_too(spark, monkeypatch):
    rows = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("t"))
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString() or "UnresolvedHint" in df._jdf.queryExecution().logical().toString()
    assert hinted(small_side(rows)) and not hinted(small_side(rows, 5))
    monkeypatch.setattr("codeseam.session.SMALL_CHARS", 5_000)
    assert not hinted(small_side(rows))


def test_a_cluster_needs_a_shared_folder():
    class Nothing:
        def __getattr__(self, name):
            return Nothing()

        def __call__(self, *args):
            return Nothing()

        def isDefined(self):
            return False

        def get(self, *args):
            return None

    session = Nothing()
    session.sparkContext = Nothing()
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)


def requests(spark, n, seed):
    rng = random.Random(seed)
    body = lambda k: "".join(f"class K{k}_{i} {{\n    int f{i}(int x) {{ return x; }}\n}};\n\n" for i in range(rng.randint(0, 12)))
    rows = [(k % 3, f"a/f{k}.cpp", "cpp", body(k) if k % 7 else rng.choice(["", "  \n", "int x;\n"]), "words", round(rng.random() * 3, 3)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "request_id int, path string, ext string, content string, desc string, importance double")


@pytest.mark.parametrize("tokens", [10, 600, 1500, 1_000_000])
def test_packed_requests_are_those_of_one_task(spark, tokens):
    rows, frame = requests(spark, 90, 3)
    spread, mixed, together = (
        {(r["request_id"], r["path"]): (r["tier"], r["tokens"]) for r in budget.pack_requests(frame, tokens, "k1 f2", b).collect()} for b in (0, 9_500, 10**9)
    )
    want = {}
    for request in range(3):
        files = sorted(((p, e, stubs.stub(t, e), d, i) for q, p, e, t, d, i in rows if q == request), key=lambda f: f[0])
        want |= {(request, p): (tier, cost) for p, tier, cost, _ in budget.allocate(files, tokens, ["k1", "f2"])}
    assert spread == mixed == together == want


def test_greedy_rounds_are_the_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), n, rng.randint(1, 400), round(rng.random(), 2)) for n in range(600)] + [("c", 900, 5_000, 1.0), ("c", 901, 1, 0.5)]
    want = set()
    for g in ("a", "b", "c", None):
        used = 0
        for k, (_, i, t, _) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))):
            if k == 0 or used + t <= 3000:
                want.add((g, i, t))
                used += t
    frame = spark.createDataFrame(rows, "g string, file_id long, tokens int, importance double")
    for hot in (20, 10_000):
        assert {tuple(r) for r in budget.greedy(frame, "g", 3000, hot).collect()} == want


def test_modules_and_neighbours(spark):
    deps = spark.createDataFrame([("a", "b", "public"), ("a", "b", "private"), ("c", "a", "private")], "module string, dep string, kind string")
    modules = spark.createDataFrame([("a", "x > a"), ("b", "y"), ("c", "z > c")], "module string, module_category string")
    assert {tuple(r) for r in graph.adjacency(deps, modules).collect()} == {("a", "x", "public", "b"), ("b", "y", "public", "a"), ("c", "z", "private", "a"), ("a", "x", "private", "c")}
    assert {tuple(r) for r in graph.levels(deps, "b", 3, reverse=True).collect()} == {("b", 0, "root"), ("a", 1, "public"), ("c", 2, "private")}
    files = spark.createDataFrame([("r", "p1", "x > a > deep"), ("r", "p2", "y"), ("r", "p3", "x"), ("r", "p4", "z > c")], "repo string, path string, category string")
    assert {r["path"] for r in graph.closure(deps, modules, files, "b").collect()} == {"p1", "p2"}
    asked = spark.createDataFrame([("q > A",), ("y",), ("none",)], "category string")
    assert {tuple(r) for r in graph.lookup(asked, modules).collect()} == {("q > A", "a"), ("y", "b"), ("none", None)}
    assert {r["module"] for r in views.search_set(modules, "Z >").collect()} == {"c"}


def test_treemap_leaves_out_a_single_root(spark):
    files = spark.createDataFrame([("src > a",)] * 8 + [("src > b",)] + [("src > b > c",)] * 5, "category string")
    got = {r["node"]: (r["parent"], r["depth"], r["files"], r["value"]) for r in treemap.damped(files).collect()}
    assert got == {"a": ("", 1, 8, 2.0), "b": ("", 1, 6, 6.0), "b > c": ("b", 2, 5, 5.0)}


def test_syntax_tokens():
    text = "/* a\n b */ int x = 0x1F; // done\nif (S == 'q') {\n#define Y"
    got = list(syntax.tokens(text, "c"))
    assert got == [(1, 0, 4, "comment"), (2, 0, 5, "comment"), (2, 6, 3, "type"), (2, 14, 4, "number"), (2, 20, 7, "comment"), (3, 0, 2, "keyword"), (3, 9, 3, "string"), (4, 0, 9, "directive")]
    assert [t[3] for t in syntax.tokens("def f(): # x\n  return 'a'", "py")] == ["keyword", "comment", "keyword", "string"] and not list(syntax.tokens(None, None))


def test_tokenizers_by_name(spark):
    frame = spark.createDataFrame([("abcd",), (None,)], "t string")
    assert [tuple(r) for r in frame.select(tokenizers.count_tokens(F.col("t")), tokenizers.count_tokens(F.col("t"), "bytes-4")).collect()] == [(2, 1), (0, 0)]
    with pytest.raises(ValueError):
        tokenizers.count_tokens(F.col("t"), "none")
    with pytest.raises(ValueError):
        tokenizers.register("bytes-3", F.length)


def test_vector_cache_is_refreshed(spark, tmp_path):
    def files(*rows):
        return spark.createDataFrame([(n, "r", p, "py", s, 0, f"class {p[0].upper()}:\n    def run(self, value, other_value):\n        return value\n") for n, (p, s) in enumerate(rows)], "file_id long, repo string, path string, ext string, size long, mtime long, content string")

    folder = str(tmp_path / "c")
    first = cache.refresh(files(("a.py", 1), ("b.py", 1)), folder, "hash-96")
    assert {tuple(r)[1:] for r in first.collect()} == {("a.py", "missing"), ("b.py", "missing")}
    second = cache.refresh(files(("a.py", 1), ("b.py", 2), ("c.py", 1)), folder, "hash-96")
    assert {tuple(r)[1:] for r in second.collect()} == {("a.py", "hit"), ("b.py", "stale"), ("c.py", "missing")}
    rows = cache.load(spark, folder, "hash-96").select("path", "size").distinct().collect()
    assert {tuple(r) for r in rows} == {("a.py", 1), ("b.py", 2), ("c.py", 1)}
    cache.write_responses({"files": files(("a.py", 1)).drop("content")}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "files")).first()["path"] == "a.py"
