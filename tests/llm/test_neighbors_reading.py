import random

import numpy as np
import pandas as pd

from codeseam.llm import neighbors, reading

MODELS = "model_name string, dim int, other int"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(12, dim))
    x = topics[rng.integers(12, size=n)] * 0.8 + rng.normal(size=(n, dim))
    for k in range(0, n - 6, 25):
        x[k + 1 : k + 5] = x[k] + rng.normal(size=(4, dim)) * rng.uniform(0.1, 0.5)
    return (x * rng.uniform(0.1, 9, size=(n, 1))).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, model_name string, embedding array<float>, rank int, similarity string")


def brute(vectors):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (x @ x.T).round(9)
    np.fill_diagonal(s, -2)
    return {int(i): [(int(ids[j]), s[k, j]) for j in np.lexsort((ids, -s[k]))[:10]] for k, i in enumerate(ids)}


def test_mutual_pairs_against_brute_force(spark):
    a, b = clustered(1500, 32, 1), clustered(700, 48, 2)
    rows = [(i, "a", v.tolist(), 0, "") for i, v in enumerate(a)] + [(10_000 + i, "b", v.tolist(), 0, "") for i, v in enumerate(b)]
    rows += rows[:40] + [(90_000, "a", None, 0, ""), (90_001, "a", [0.0] * 32, 0, ""), (90_002, "a", [float("nan")] * 32, 0, ""), (90_003, "a", [1.0] * 31, 0, ""), (90_004, "zz", [1.0] * 32, 0, ""), (90_005, None, [1.0] * 32, 0, "")]
    models = spark.createDataFrame([("a", 32, 1), ("b", 48, 1), ("c", 5, 1)], MODELS)
    vectors = neighbors.valid_vectors(table(spark, rows), models, "chunk_id", "model_name", "embedding")
    got = {tuple(r) for r in neighbors.mutual(neighbors.search(vectors, 10, 5, at_least=0.8), 10).collect()}
    want = set()
    near = {**brute(dict(enumerate(a))), **{10_000 + i: [(10_000 + j, s) for j, s in v] for i, v in brute(dict(enumerate(b))).items()}}
    for i, v in near.items():
        want |= {(i, j) for j, s in v if i < j and s >= 0.8 and i in [k for k, _ in near[j]]}
    assert len(want) > 200 and got <= want and len(got) >= 0.95 * len(want)
    asked = neighbors.best_of(neighbors.search(vectors, 10, 40, asking_every=50), 10).collect()
    assert {r["id"] for r in asked} == {i for i in near if i % 50 == 0}
    assert sum(r["other"] in [j for j, _ in near[r["id"]]] for r in asked) >= 0.9 * len(asked)
    assert neighbors.search(vectors.limit(0), 10, 4).count() == 0


def recalls(spark, x, probes=40):
    """Of the mutual pairs and of the ten nearest of each asking vector, the shares that are found."""
    vectors = neighbors.valid_vectors(table(spark, [(i, "a", v.tolist(), 0, "") for i, v in enumerate(x)]), spark.createDataFrame([("a", x.shape[1], 1)], MODELS), "chunk_id", "model_name", "embedding")
    near = brute(dict(enumerate(x)))
    want = {(i, j) for i, v in near.items() for j, s in v if i < j and s >= 0.8 and i in [k for k, _ in near[j]]}
    got = {tuple(r) for r in neighbors.mutual(neighbors.search(vectors, 10, 5, at_least=0.8), 10).collect()}
    assert got <= want and len(want) > 200
    asked = neighbors.best_of(neighbors.search(vectors, 10, probes, asking_every=50), 10).collect()
    return len(got) / len(want), sum(r["other"] in [j for j, _ in near[r["id"]]] for r in asked) / len(asked)


def test_recall_where_cells_are_made_of_codes(spark, monkeypatch):
    """As above MAX_CELLS: 16 centroids, the other 204 cells by one book, or by two."""
    monkeypatch.setattr(neighbors, "CELL_VECTORS", 10)
    monkeypatch.setattr(neighbors, "MAX_CELLS", 16)
    x = clustered(2200, 32, 5)
    for codes, levels in ((256, 1), (4, 2)):
        monkeypatch.setattr(neighbors, "FINE_CODES", codes)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        index = neighbors.fit_index(unit.astype(np.float32), len(x))
        assert len(index.fine) == levels and len(index.cells) <= 18 and len(np.unique(index.nearest(unit.astype(np.float32), 1))) > 100
        pairs, nearest = recalls(spark, x)
        assert pairs >= 0.95 and nearest >= 0.9


def test_recall_where_cells_are_stored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_FROM", 15)
    vectors = clustered(1200, 24, 6)
    pairs, nearest = recalls(spark, vectors)
    assert pairs >= 0.95 and nearest >= 0.9


def test_rows_do_not_grow_with_the_number_of_vectors(monkeypatch):
    """At most 6 rows a vector and about as many vectors a cell, at 1e6, 1e7 and 1e8 vectors (centroids scaled down for speed)."""
    monkeypatch.setattr(neighbors, "MAX_CELLS", 256)
    monkeypatch.setattr(neighbors, "SAMPLE_CODES", 1024)
    x = clustered(12_000, 32, 7)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (10**6, 10**7, 10**8):
        index = neighbors.fit_index(x[:10_000], n)
        cells = len(index.cells) * np.prod([len(b) for b in index.fine]) if len(index.fine) else len(index.cells)
        assert n / cells <= 2 * neighbors.CELL_VECTORS
        visits = index.nearest(x[10_000:], 5)
        assert index.blocks(visits.ravel()).sum() / len(visits) + 1 <= 6 + 1e-9


def test_exact_search(spark):
    x = clustered(600, 16, 8)
    vectors = neighbors.valid_vectors(table(spark, [(i, "a", v.tolist(), 0, "") for i, v in enumerate(x)] + [(900, "a", [0.0] * 16, 0, "")]), spark.createDataFrame([("a", 16, 1)], MODELS), "chunk_id", "model_name", "embedding")
    near = brute(dict(enumerate(x)))
    got = neighbors.best_of(neighbors.search_exact(vectors, 10, asking_every=7, block_rows=100), 10).collect()
    assert {(r["id"], r["other"]) for r in got} == {(i, j) for i, v in near.items() if i % 7 == 0 for j, _ in v}
    assert neighbors.search_exact(vectors.limit(0), 10).count() == 0


def test_no_score_bound_loses_a_pair():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    said = x * rng.uniform(-0.4, 1.3, size=(400, 1)) + rng.normal(size=x.shape) * rng.uniform(0, 0.4, size=(400, 1))
    along = (x * said).sum(1)
    across = np.sqrt(np.maximum((said**2).sum(1) - along**2, 0))
    q = x + rng.normal(size=x.shape) * rng.uniform(0, 0.6, size=(400, 1))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    for t in (0.3, 0.8, 0.99, 1.0):
        s, score = q @ x.T, q @ said.T
        assert (score >= neighbors._least_score(along, across, t)[None] - 1e-9)[s >= t].all()


def test_many_copies_of_one_vector(spark):
    x = clustered(600, 16, 3)
    rows = [(i, "a", v.tolist(), 0, "") for i, v in enumerate(x)] + [(1000 + i, "a", x[0].tolist(), 0, "") for i in range(1500)]
    vectors = neighbors.valid_vectors(table(spark, rows), spark.createDataFrame([("a", 16, 1)], MODELS), "chunk_id", "model_name", "embedding")
    got = {tuple(r) for r in neighbors.mutual(neighbors.search(vectors, 10, 5, at_least=0.8), 10).collect()}
    full = brute(dict(enumerate(x)) | {1000 + i: x[0] for i in range(1500)})
    want = {(i, j) for i, v in full.items() for j, s in v if i < j and s >= 0.8 and i in [k for k, _ in full[j]]}
    assert got <= want and len(got) >= 0.95 * len(want) and {(0, 1000 + i) for i in range(10)} <= got


def test_codes_add_up():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    books = neighbors.fit_books(x[:2000], rng)
    error = lambda beam: float(((x[2000:] - neighbors.decode(neighbors.encode(x[2000:], books, beam), books)) ** 2).sum(1).mean() / 24)
    assert error(4) < error(1) < 0.45


PROSE = "The port opens the page. A team reads the log so the job stops here! Is it done?"


def test_running_text():
    doc = f"# Title here\n\n{PROSE}\n\n```py\ndef f(x):\n    return x\n```\n\n| a | b |\n|---|---|\n\n- First item of a list\n- Second `code` item (see v2.4)\n1. Third [link](http://x.y/z) item\n\nint f(int a) {{\nreturn a;\n}}\n2025-01-01T00:00:00Z WARN load took 5ms\n"
    text = reading.running_text(doc.replace("{{", "{").replace("}}", "}"))
    assert text.split("\n") == [PROSE, "First item of a list", "Second   item  ", "Third link item"]
    comment = "// The port opens\n// the page.\n//\n// A team reads.\n"
    assert reading.running_text(comment) == "The port opens the page.\nA team reads."
    wrapped = reading.running_text("The port\r\nopens the\r\npage.\r\n\r\nNext.")
    assert wrapped == "The port opens the page.\nNext."
    assert reading.measure("") is None and reading.measure(None) is None and reading.measure("x = 1\n") is None
    for text, language in ((PROSE, "en"), ("Der Port öffnet die Seite und das Team liest ein Log.", "de"), ("Le port ouvre la page et le code suit un outil.", "fr"), ("El plan abre la lista y los datos de una clave.", "es")):
        assert reading.measure(text)[0] == language
    assert len(reading.measure("word " * 200_000)[1]) == len(reading.FEATURES)


def test_trees_learn_and_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = 2 * (x[:, 0] > 0) + x[:, 1] ** 2 + rng.normal(size=1500) * 0.1
    trees = reading.Trees().fit(x[:1000], y[:1000])
    assert np.abs(trees.predict(x[1000:]) - y[1000:]).mean() < 0.35 * np.abs(y[1000:] - y.mean()).mean()
    knots, values = reading.isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert (np.diff(values) > 0).all() and values[1] == 2.5


def hard(rng, level):
    easy = ["The port opens the page", "A team reads the log", "The job stops the list", "Our app keeps a flag"]
    heavy = ["the asynchronous reconciliation protocol systematically parameterizes the heterogeneous dependency topology", "an incremental canonicalization pipeline substantially complicates the authentication federation boundary"]
    out = []
    for _ in range(25):
        out.append(" whereas ".join(rng.choice(heavy) for _ in range(1 + level // 3)).capitalize() if rng.random() < (level - 1) / 4 else rng.choice(easy))
    return ". ".join(out) + "."


def test_levels_on_held_out_documents(spark):
    rng = random.Random(3)
    level = {n: rng.randint(1, 5) for n in range(500)}
    rows = [(n, hard(rng, level[n]), f"src{n % 7}", "x") for n in level] + [(900, None, "a", "x"), (901, "", None, "x"), (902, "x = 1;", "a", "x"), (3, hard(rng, level[3]), "a", "x")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, grade string")
    labels = spark.createDataFrame([(n, level[n], "r") for n in range(250)] + [(5, None, "q"), (None, 3, "q"), (5, level[5], "z")], "doc_id long, reading_band int, rater string")
    got = pd.DataFrame([r.asDict() for r in reading.reading_levels(documents, labels).collect()]).set_index("doc_id")
    assert set(got.index) == set(level) and got["band"].between(1, 5).all()
    held = [n for n in range(250, 500)]
    assert np.mean([abs(got["grade"][n] - level[n]) for n in held]) < 0.7
    assert reading.reading_levels(documents.limit(0), labels).count() == 0
    unrated = reading.reading_levels(documents, labels.limit(0)).collect()
    assert len(unrated) == len(level) and all(r["grade"] is None and r["band"] is None for r in unrated)
    report = {(r["held_out"], r["name"]): r for r in reading.quality(documents, labels).collect()}
    assert report["all", ""]["rated"] == 250 and report["all", ""]["mean_error"] < 0.7 and report["source", "src3"]["rated"] > 20
    assert reading.quality(documents, labels.limit(0)).count() == 0
