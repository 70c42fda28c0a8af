import subprocess

import pytest
from pyspark.sql import functions as F

from codeseam.api import Corpus
from codeseam.functions import encoder
from codeseam.operators import graph, history, incremental, ranking, treemap
from codeseam.sources import cache, git, manifests, walk
from codeseam.streaming import watch

MANIFESTS = {
    "a/Cargo.toml": '[package]\nname = "core"\n[dependencies]\nserde = "1"\ntokio = { version = "1" }\n[dev-dependencies]\nproptest = "1"\n',
    "b/package.json": '{"name": "ui", "dependencies": {"react": "1"}, "devDependencies": {"vite": "2"}}',
    "c/package.json": "not json",
    "d/go.mod": "module example.com/x/svc\n\nrequire (\n\tgithub.com/a/lib v1.2.3\n\tgithub.com/b/kit v0.1.0\n)\n",
    "e/CMakeLists.txt": "project(engine)\ntarget_link_libraries(engine PUBLIC ns::fmt ${X} PRIVATE zlib -lm)\n",
    "f/Game.Build.cs": 'PublicDependencyModuleNames.AddRange(new string[] { "Core", "Engine" });\nPrivateDependencyModuleNames.Add("Slate");\n',
}


def test_manifests(spark):
    rows = spark.createDataFrame([("r", p, t, "x") for p, t in MANIFESTS.items()], "repo string, path string, content string, category string")
    got = {r["module"]: (sorted(r["public"]), sorted(r["private"])) for r in manifests.modules(rows).collect()}
    assert got == {
        "core": (["serde", "tokio"], ["proptest"]), "ui": (["react"], ["vite"]), "c": ([], []), "svc": (["kit", "lib"], []), "engine": (["fmt"], ["zlib"]), "Game": (["Core", "Engine"], ["Slate"]),
    }
    assert manifests.edges(manifests.modules(rows)).count() == 12


def test_scan_and_config(spark, tmp_path):
    for path, data in {"src/Private/Save.h": b"int x;", "src/node_modules/y.js": b"z", "src/bin.dat": b"a\x00b", ".hidden/q.c": b"q", "src/bad.txt": b"\xff\xfe\xfa", "src/sp ace.txt": b"ok\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    with pytest.warns(UserWarning, match="scan_dirs"):
        config = walk.parse_config('scan_dirs = ["src"]\nskip_dirs = ["gen"]\nscan_dir = 1\n', str(tmp_path))
    assert "gen" in config.skip_dirs and "target" in config.skip_dirs and config.unknown == ("scan_dir",)
    rows = {r["path"]: r for r in walk.scan(spark, "r", config).collect()}
    assert set(rows) == {"src/Private/Save.h", "src/sp ace.txt"} and rows["src/Private/Save.h"]["desc"] == "Save (header)"
    (tmp_path / "src/long.txt").write_text("é" * 300_000)
    assert walk.scan(spark, "r", config).where("path = 'src/long.txt'").select("size", "truncated", F.octet_length("content")).first() == (600_000, True, 512 * 1024)
    assert walk.scan_file(spark, "r", config, "src/Private/Save.h").first()["content"] == "int x;"
    assert all(walk.scan_file(spark, "r", config, p).count() == 0 for p in ("src/bin.dat", "src/none", "../x", "src"))
    assert walk.guarded(str(tmp_path), "src/bin.dat").endswith("bin.dat")
    (tmp_path / "src/out").symlink_to("/etc")
    for path in ("src/out/passwd", "../x", "/etc/passwd", ""):
        with pytest.raises(ValueError):
            walk.guarded(str(tmp_path), path)
    listed = str(tmp_path / "repos.toml")
    assert walk.add_repo(listed, "a", str(tmp_path)) and not walk.add_repo(listed, "a", "/other") and walk.add_repo(listed, "b.c", "/tmp")
    with open(listed) as f:
        assert walk.registry(f.read()) == {"a": str(tmp_path), "b.c": "/tmp"}
    assert walk.registry('[repos.a]\nroot = "/x"\n') == {"a": "/x"}
    with pytest.raises(ValueError):
        walk.registry("[repos.a]\n")


def test_git_source(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    for text, name in (("a", "x.txt"), ("b", "x.txt"), ("c", "y.txt")):
        (tmp_path / name).write_text(text)
        run("add", ".")
        run("-c", "user.name=n", "-c", "user.email=e@e", "commit", "-q", "-m", f"m {text}")
    rows = git.git_history(spark, [str(tmp_path)]).select("path", "status", "message").collect()
    assert sorted(map(tuple, rows)) == [("x.txt", "added", "m a"), ("x.txt", "modified", "m b"), ("y.txt", "added", "m c")]
    assert sorted(map(tuple, git.git_changed(spark, [str(tmp_path)], "HEAD~2").select("path", "status").collect())) == [("x.txt", "modified"), ("y.txt", "added")]
    asked = spark.createDataFrame([(str(tmp_path), "x.txt"), (str(tmp_path), "none")], "repo string, path string")
    lines = {r["path"]: r for r in git.git_blame(asked).collect()}
    assert (lines["x.txt"]["line_no"], lines["x.txt"]["author"], lines["x.txt"]["content"]) == (1, "n", "b") and lines["none"]["error"] == "not found"


def test_imports_resolve_by_name_then_stem(spark):
    texts = {"a/x.c": '#include "b/y.h"\n#include "none.h"', "b/y.h": "", "c/y.h": "", "p/m.py": "import pkg.util\nfrom lost import z", "q/util.py": ""}
    rows = spark.createDataFrame([("r", p, p.rsplit("/", 1)[-1], p.rsplit(".", 1)[-1], t) for p, t in texts.items()] + [("s", "z/lost.py", "lost.py", "py", "")], "repo string, path string, filename string, ext string, content string")
    imports = graph.extract_imports(rows)
    resolved = graph.resolve_imports(imports, rows)
    got = {(r["src"], r["target"]): r["dst"] for r in resolved.collect()}
    assert got == {("a/x.c", "b/y.h"): "b/y.h", ("a/x.c", "none.h"): None, ("p/m.py", "pkg.util"): "q/util.py", ("p/m.py", "lost"): None}
    cross = graph.cross_repo_edges(resolved, rows).collect()
    assert [tuple(r) for r in cross] == [("r", "p/m.py", "s", "z/lost.py")]


def test_namespaces(spark):
    rows = spark.createDataFrame([("r", "a.cs", "cs", "using Acme.Core;\nusing Acme;\nusing System.IO;\n"), ("r", "b.cs", "cs", "namespace Acme.Core\n{}"), ("r", "c.cs", "cs", "namespace Acme.Net\n{}")], "repo string, path string, ext string, content string")
    got = sorted(tuple(r)[1:] for r in graph.namespace_edges(graph.extract_imports(rows), rows).collect())
    assert got == [("a.cs", "b.cs"), ("a.cs", "c.cs")]


def test_traversal(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("d", "a"), ("a", "d")], "src string, dst string")
    assert {tuple(r) for r in graph.reach(edges, ["a"], 5).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(16)], "src string, dst string")
    assert graph.shortest_paths(chain, "n00", ["n15"]).first()["hops"] == 15
    assert sorted(tuple(r) for r in graph.shortest_paths(edges, "c", ["d", "c", "zz"]).collect()) == [("c", "c", 0), ("d", "c -> b -> a -> d", 3)]
    away = edges.withColumn("away", F.col("src") == "c").unionByName(spark.createDataFrame([("x", "b", True), ("y", "x", False), ("z", "a", True)], "src string, dst string, away boolean"))
    assert {tuple(r) for r in graph.impact(away, ["a"], 5).collect()} == {("b", 1), ("d", 1), ("c", 2), ("x", 2), ("z", 1)}
    deps = edges.select(F.col("src").alias("module"), F.col("dst").alias("dep"), F.lit("public").alias("kind"))
    assert sorted(tuple(r) for r in graph.connections(deps, ["a", "b", "c"]).collect()) == [("a", "b", "public", "b -> a"), ("a", "c", "path", "a -> d -> c"), ("b", "c", "public", "c -> b")]
    assert graph.shortest_paths(edges, "a", ["zz"]).count() == 0 and graph.reach(edges, ["zz"], 3).count() == 0


def test_upsert_latest_and_cache(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(2, "c", False), (3, "d", None), (1, None, True)], "k long, v string, deleted boolean")
    assert sorted(map(tuple, incremental.upsert(table, changes, ["k"]).collect())) == [(2, "c"), (3, "d")]
    rows = spark.createDataFrame([(1, 5, "x"), (1, None, "y"), (2, None, "z")], "k long, t long, v string")
    assert sorted((r["k"], r["v"]) for r in incremental.latest(rows, ["k"], ["t"]).collect()) == [(1, "x"), (2, "z")]
    state = incremental.cache_state(rows.select("k", "t").where("t is not null"), spark.createDataFrame([(1, 5), (2, 7)], "k long, t long"), ["k"], ["t"])
    assert {tuple(r) for r in state.collect()} == {(1, "hit"), (2, "missing")}


def test_change_stream_keeps_table(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "table")
    send = lambda rows: spark.createDataFrame(rows, "repo string, path string, ts string, size long, content string, deleted boolean").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(inbox)
    send([("r", "a.py", "2025-01-01 00:00:00", 1, "one", False), ("r", "a.py", "2025-01-01 00:00:01", 1, "two", False), ("r", "vendor/b.py", "2025-01-01 00:00:00", 1, "x", False)])
    query = watch.keep_current(watch.change_stream(spark, inbox), out, str(tmp_path / "cp"), frozenset({"vendor"}))
    try:
        query.processAllAvailable()
        assert [(r["path"], r["content"]) for r in watch.current(spark, out)[0].collect()] == [("a.py", "two")]
        send([("r", "a.py", "2025-01-01 00:01:00", 0, None, True), ("r", "c.py", "2025-01-01 00:01:00", 1, "three", None)])
        query.processAllAvailable()
        assert [r["path"] for r in watch.current(spark, out)[0].collect()] == ["c.py"]
    finally:
        query.stop()


CHANGE = "repo string, path string, ts string, size long, content string, deleted boolean"


def change(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGE).withColumn("ts", F.col("ts").cast("timestamp"))


def files_of(spark, folder):
    return {(r["repo"], r["path"]): r["content"] for r in watch.current(spark, folder)[0].collect()}


def test_late_events_change_nothing(spark, tmp_path):
    out = str(tmp_path / "t")
    watch.apply_changes(spark, change(spark, ("r", "a", "2025-01-01 00:10:00", 1, "new", False), ("r", "b", "2025-01-01 00:00:00", 1, "b", False)), out, 0)
    watch.apply_changes(spark, change(spark, ("r", "a", "2025-01-01 00:05:00", 1, "old", False), ("r", "b", "2025-01-01 00:10:00", 0, None, True)), out, 1)
    assert files_of(spark, out) == {("r", "a"): "new"}
    watch.apply_changes(spark, change(spark, ("r", "b", "2025-01-01 00:09:00", 1, "late", False), ("s", "a", "2025-01-01 00:00:00", 1, "s", None), (None, "x", "2025-01-01 00:00:00", 1, "s", None)), out, 2)
    assert files_of(spark, out) == {("r", "a"): "new", ("s", "a"): "s"}
    watch.apply_changes(spark, change(spark, ("r", "a", "2026-01-01 00:00:00", 1, "again", False)), out, 1)  # a version that was written before
    assert files_of(spark, out)["r", "a"] == "new"
    watch.apply_changes(spark, change(spark), out, 3)
    assert watch.current(spark, out)[1] == 3 and len(files_of(spark, out)) == 2


def test_a_batch_writes_what_it_touches(spark, tmp_path):
    out = str(tmp_path / "t")
    watch.apply_changes(spark, change(spark, *(("r", f"f{n}", "2025-01-01 00:00:00", 1, "x", False) for n in range(300))), out, 0, buckets=16)
    first = sorted(p.name for p in (tmp_path / "t" / "v-0").glob("bucket=*"))
    assert len(first) == 16
    for n in range(1, 5):
        watch.apply_changes(spark, change(spark, ("r", "f7", f"2025-01-0{n + 1} 00:00:00", 1, f"y{n}", False)), out, n)
        assert len(list((tmp_path / "t" / f"v-{n}").glob("bucket=*"))) == 1
    assert not (tmp_path / "t" / "v-1").exists() and len(list((tmp_path / "t" / "v-0").glob("bucket=*"))) == 15  # expired
    assert files_of(spark, out)["r", "f7"] == "y4" and len(files_of(spark, out)) == 300


def test_rescan_of_a_repository(spark, tmp_path):
    out = str(tmp_path / "t")
    scan = lambda *rows: spark.createDataFrame(list(rows), "path string, size long, content string")
    watch.rescan(spark, out, "r", scan(("a", 1, "a"), ("b", 1, "b"), ("b", 1, "b")), "2025-01-01 00:00:00", 0)
    watch.rescan(spark, out, "s", scan(("a", 1, "s")), "2025-01-01 00:00:00", 1)
    watch.rescan(spark, out, "r", scan(("a", 2, "aa"), ("c", 1, None)), "2025-01-02 00:00:00", 2)
    assert files_of(spark, out) == {("r", "a"): "aa", ("r", "c"): None, ("s", "a"): "s"}


def test_changes_since_are_a_diff_of_states(spark):
    commits = spark.createDataFrame([(n, "a", f"2025-01-{n:02d} 00:00:00") for n in range(1, 10)], "hash long, author string, t string").select("hash", "author", F.to_timestamp_ntz("t").alias("ts"))
    steps = {"kept": [(1, "added")], "new": [(6, "added")], "new2": [(6, "added"), (7, "modified")], "gone": [(1, "added"), (7, "deleted")], "brief": [(6, "added"), (7, "deleted")], "back": [(1, "added"), (6, "deleted"), (8, "added")], "old": [(6, "modified")], "dead": [(1, "added"), (2, "deleted"), (8, "added")]}
    files = spark.createDataFrame([(h, p, s) for p, x in steps.items() for h, s in x], "hash long, path string, status string")
    got = {r["path"]: r["status"] for r in history.changed_since(commits, files, "2025-01-05 00:00:00").collect()}
    assert got == {"new": "added", "new2": "added", "gone": "deleted", "back": "modified", "old": "modified", "dead": "added"}


def test_live_sessions(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows = [(1, "f", 5, "2025-01-01 00:00:00"), (1, "g", 6, "2025-01-01 00:10:00"), (1, "f", 7, "2025-01-01 02:00:00"), (2, "f", 1, "2025-01-02 00:00:00")]
    frame = spark.createDataFrame(rows, "session_id long, path string, tokens long, t string").select("session_id", "path", "tokens", F.col("t").cast("timestamp").alias("ts"))
    frame.coalesce(1).write.parquet(inbox)
    query = watch.live_sessions(spark.readStream.schema(frame.schema).parquet(inbox)).writeStream.outputMode("append").format("memory").queryName("live").start()
    try:
        query.processAllAvailable()
        assert sorted((r["session_id"], r["reads"], r["tokens"]) for r in spark.table("live").collect()) == [(1, 1, 7), (1, 2, 11)]
    finally:
        query.stop()


def test_treemap_fills_its_rectangle():
    boxes = treemap.squarify([6, 6, 4, 3, 2, 2, 1], 0, 0, 6, 4)
    assert abs(sum(w * h for _, _, w, h in boxes) - 24) < 1e-9 and all(max(w / h, h / w) < 4 for _, _, w, h in boxes)
    assert treemap.squarify([], 0, 0, 1, 1) == []


def test_encoder_and_commands(spark):
    rows = spark.createDataFrame(
        [("r", 1, "src/save_game.py", "save_game.py", "py", 10, "def save(): pass\n", "core"), ("r", 2, "src/load.py", "load.py", "py", 10, "def load(save): pass\n", "core > io")],
        "repo string, file_id long, path string, filename string, ext string, size long, content string, category string",
    )
    chunks = rows.select(F.col("path").alias("file_path"), F.lit(1).alias("start_line"), encoder.encode(F.col("content")).alias("embedding"))
    corpus = Corpus(rows, chunks=chunks)
    assert corpus.call("find", query="save").first()["path"] == "src/save_game.py"
    assert Corpus(rows).search("save.py").first()["source"] in ("both", "name")
    assert corpus.read(["src/load.py", "../x", "nope"]).where("error is not null").count() == 2
    assert corpus.read(["src/load.py"], start=1, end=1).first()["content"] == "    1 | def load(save): pass"
    assert corpus.call("module_files", module="core").count() == 2 and corpus.status().count() == 2
    assert {r["tier"] for r in corpus.read_budget(["src/load.py", "src/save_game.py"], 5, "save").collect()} <= {2, 4}
    assert corpus.read([f"p{n}" for n in range(60)]).where("error is not null").count() == 60
    twice = rows.unionByName(rows.withColumn("repo", F.lit("q")))
    assert {(r["repo"], r["path"]) for r in Corpus(twice).read(["src/load.py"]).collect()} == {("r", "src/load.py"), ("q", "src/load.py")}
    assert {r["repo"] for r in Corpus(twice).search("save").collect()} == {"r", "q"}
    answer = Corpus(twice).read_budget(["src/load.py", "nope"], 10_000).collect()
    assert [(r["path"], r["error"]) for r in answer] == [("q/src/load.py", None), ("r/src/load.py", None), ("nope", "not found")] and "def load" in answer[0]["content"]
    assert corpus.grep("save", output="lines", per_file=1).count() == 2 and corpus.grep("def save", snippets=True).first()["snippet"] == "def save(): pass"
    assert {tuple(r) for r in corpus.imports("r/src/load.py").collect()} == set() and corpus.modules().first()["total"] == 2
    assert encoder.preset("MiniLM") == (384, 1500) and encoder.preset("x/y") == (768, 2000)
    for bad in (lambda: corpus.imports("x", direction="up"), lambda: corpus.git("history", "../x"), lambda: corpus.call("_filtered"), lambda: corpus.repo("none"), lambda: corpus.grep("(?P<x>a)", "regex")):
        with pytest.raises(ValueError):
            bad()
    v = encoder.ENCODERS["hash-96"]()(["alpha beta", ""])
    assert abs((v[0] ** 2).sum() - 1) < 1e-5 and not v[1].any()


def test_hybrid_weights(spark):
    rows = spark.createDataFrame([(1, "q", 10.0, 5.0, 2), (2, "q", None, 10.0, 2), (3, "q", float("nan"), None, 2)], "id long, g string, n double, c double, t int")
    got = {r["id"]: (r["combined"], r["match"]) for r in ranking.hybrid(rows, ["g"], "n", "c", "t").collect()}
    assert got == {1: (0.875, "both"), 2: (0.6, "content"), 3: (0.0, "none")}


def test_vector_cache(spark, tmp_path):
    entry = lambda path, size, v: ("m", "r", path, 1, size, 0, [v])
    frame = lambda *rows: spark.createDataFrame(list(rows), "model_name string, repo string, path string, start_line int, size long, mtime long, embedding array<float>")
    folder = str(tmp_path / "cache")
    cache.append(frame(entry("a", 1, 1.0), entry("b", 1, 2.0)), folder)
    cache.append(frame(entry("a", 2, 3.0)), folder)
    loaded = cache.load(spark, folder, "m")
    assert sorted((r["path"], r["embedding"][0]) for r in loaded.collect()) == [("a", 3.0), ("b", 2.0)]
    now = spark.createDataFrame([("r", "a", 2, 0), ("r", "b", 9, 0), ("r", "c", 1, 0), ("r", "d", 1, 0)], "repo string, path string, size long, mtime long")
    assert {(r["state"], r["files"], r["percent"]) for r in cache.status(loaded, now).collect()} == {("hit", 1, 25.0), ("stale", 1, 25.0), ("missing", 2, 50.0)}
    cache.write_metadata(loaded, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).first()["chunks"] == 2
