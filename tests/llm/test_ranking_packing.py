import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeseam.llm import fusion, mixing, packing, splitting, tokens
from codeseam.session import running

NAN = float("nan")
RESULTS = "result_id long, query_id long, name_score double, grep_score double, grep_count long, terms_matched int, position string, fused string"
SCORES = ("name_score", "grep_score", "grep_count", "terms_matched")


def brute_fusion(rows, k=60):
    items = {}
    for i, g, *scores in rows:
        if i is None or g is None:
            continue
        have = items.setdefault((g, i), [None] * len(scores))
        for n, v in enumerate(scores):
            if v is not None and v == v and v > 0:
                have[n] = v if have[n] is None else max(have[n], v)
    out = {}
    for (g, i), have in items.items():
        total = 0.0
        for n, v in enumerate(have):
            if v is not None:
                total += 1 / (k + 1 + sum(1 for (h, _), other in items.items() if h == g and other[n] is not None and other[n] > v))
        out[g, i] = total
    return out


def results(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], RESULTS)


@pytest.mark.parametrize("hot", [100, fusion.HOT_ITEMS])
def test_fusion_equals_brute_force(spark, hot):
    rng = random.Random(5)
    pick = lambda: rng.choice([None, NAN, -1.0, 0.0, 1.0, 2.5, rng.random() * 10_000, float("inf")])
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), pick(), pick(), rng.choice([None, -1, 0, 1, 5, 5]), rng.choice([None, 0, 1, 2])) for i in range(300)]
    rows += [rows[0], rows[7], (None, 1, 1.0, 1.0, 1, 1), (900, None, 1.0, 1.0, 1, 1)]
    fused = fusion.fuse(results(spark, rows), "query_id", "result_id", SCORES, hot_items=hot)
    want = brute_fusion(rows)
    got = {(r["query_id"], r["result_id"]): r["fused"] for r in fused.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    order = {(r["query_id"], r["result_id"]): r["position"] for r in fusion.full_order(fused, "query_id", "result_id", hot).collect()}
    both = fusion.ranking(results(spark, rows), "query_id", "result_id", SCORES, hot_items=hot)
    assert {(r["query_id"], r["result_id"]): r["position"] for r in both.collect()} == order
    by = defaultdict(list)
    for (g, i), v in got.items():
        by[g].append((-v, i))
    assert order == {(g, i): n for g, items in by.items() for n, (_, i) in enumerate(sorted(items), 1)}
    wants = spark.createDataFrame([(1, 5), (2, 1000), (3, None), (4, 2), (1, 3)], "query_id long, want_k int")
    top = fusion.top(fusion.full_order(fused, "query_id", "result_id"), "query_id", wants, "want_k").collect()
    assert {(r["query_id"], r["result_id"]) for r in top} == {k for k, n in order.items() if n <= {1: 5, 2: 1000}.get(k[0], 0)}


@pytest.mark.parametrize("hot", [1000, fusion.HOT_ITEMS])
def test_fusion_of_hot_values_and_nothing(spark, hot):
    rows = [(i, 1, 7.0, None, 3, 1 + i % 2) for i in range(30_000)]
    fused = fusion.fuse(results(spark, rows), "query_id", "result_id", SCORES, hot_items=hot)
    assert {r["fused"] for r in fused.collect()} == {round(3 / 61, 12), round(2 / 61 + 1 / (60 + 15_001), 12)}
    assert fusion.fuse(results(spark, rows).limit(0), "query_id", "result_id", SCORES, hot_items=hot).count() == 0
    alone = fusion.fuse(results(spark, [(1, 1, None, NAN, 0, -1)]), "query_id", "result_id", SCORES).collect()
    assert [tuple(r) for r in alone] == [(1, 1, 0.0)]


@pytest.mark.parametrize("hot", [2, fusion.HOT_ITEMS])
def test_order_keeps_ids_of_any_size_and_sign(spark, hot):
    ids = [-(1 << 62), -5, -1, 0, 3, (1 << 60), (1 << 60) + 1, (1 << 60) + 2]
    rows = [(i, 1, 1.0, 2.0, 3, 1) for i in ids]
    got = fusion.ranking(results(spark, rows), "query_id", "result_id", SCORES, hot_items=hot).orderBy("position").collect()
    assert [(r["result_id"], r["position"]) for r in got] == [(i, n) for n, i in enumerate(sorted(ids), 1)]


def test_a_hot_group_is_cut_into_even_parts(spark):
    """Totals of a large group lie close together; ranges by sample still hold about as many rows each."""
    rows = spark.range(400_000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.round(1 / (61.0 + F.col("id") % 200_000), 12).alias("fused"), F.lit(1).cast("long").alias("one"))
    n = 100
    placed = rows.repartitionByRange(n, F.col("g"), F.col("fused").desc(), F.col("i"))
    assert placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 400_000 * 2 / n
    got = running(rows, ["g"], [("fused", True), ("i", False)], "one", "before", 20_000)
    assert got.agg(F.countDistinct("before"), F.min("before"), F.max("before")).first() == (400_000, 0, 399_999)


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \n\r#é😀", max_size=400), st.integers(1, 60), st.integers(0, 40))
def test_pieces_cover_the_text(text, limit, overlap):
    pieces = splitting.split_text(text, limit, overlap)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert all(b - a <= limit for a, b in pieces)
    shared = min(overlap, limit // 2)
    for (_, b), (c, e) in zip(pieces, pieces[1:]):
        assert b - c == shared and e > b
    assert (len(pieces) > 1) == (len(text) > limit)
    rebuilt = text[: pieces[0][1]] + "".join(text[b:e] for (_, b), (_, e) in zip(pieces, pieces[1:]))
    assert rebuilt == text


def test_cuts_are_natural():
    text = "# A\n" + "One two three. " * 6 + "\n\n" + "Four five six. " * 6 + "\n\n# B\n" + "Seven. " * 10
    ends = [text[:b] for _, b in splitting.split_text(text, 120, 10)]
    assert all(e.endswith(("\n", ". ", "."))for e in ends)
    text = "word " * 30 + "\n\n" + "next " * 100
    assert text[: splitting.split_text(text, 170, 10)[0][1]].endswith("\n\n")
    family = "\U0001f468\u200d\U0001f469\u200d\U0001f467"
    for unit in (family, "e\u0301", "\U0001f1e9\U0001f1ea", "\U0001f44d\U0001f3fd", "\r\n"):
        for limit in range(7, 14):
            ends = [b for _, b in splitting.split_text(unit * 40, limit, 0)]
            assert all(b % len(unit) == 0 for b in ends), (unit, limit)
    assert splitting.split_text("x" * 1_000_000, 1000, 100)[-1][1] == 1_000_000


def test_split_items_on_dirty_rows(spark):
    rows = [(1, "a b " * 50, "m", 10), (2, "short", "m", None), (3, None, "m", 1), (4, "", "m", 1), (5, "no rule " * 100, "zz", 1), (6, "y\r\n" * 100, "m", 5), (6, "y\r\n" * 100, "m", 5), (7, "x" * 300, None, 2)]
    df = spark.createDataFrame([(*r, 0, "p") for r in rows], "chunk_id long, text string, model string, start_line int, n_pieces int, piece string")
    limits = spark.createDataFrame([("m", 100, 20, 1), ("m", 100, 20, 2)], "model string, most int, over int, other int")
    got = splitting.split_items(df, "chunk_id", "text", limits, "model", "most", "over", "start_line").collect()
    by = defaultdict(list)
    for r in got:
        by[r["chunk_id"]].append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 3, 2: 1, 4: 1, 5: 1, 6: 8, 7: 1}
    six = sorted({(r["piece_no"], r["start_line"], r["start_char"]) for r in by[6]})
    assert all(line == 5 + at // 3 for _, line, at in six)
    assert splitting.split_items(df.limit(0), "chunk_id", "text", limits, "model", "most", "over", "start_line").count() == 0


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, tokens int")


def test_token_counts():
    size = tokens.counter()
    assert size("hello world") == 2 and size("") == 0
    long = "word " * 60_000
    assert abs(size(long) - 60_000) <= 2
    assert tokens.exceeds(long, 2048, size) and not tokens.exceeds("word " * 100, 2048, size)
    edge = "word " * 2047
    assert tokens.exceeds(edge, size(edge) - 1, size) and not tokens.exceeds(edge, size(edge), size)


def test_packing_fills_and_keeps_the_mixture():
    rng = random.Random(1)
    sizes = [min(2048, int(rng.lognormvariate(5.8, 0.8)) + 1) for _ in range(6000)]
    sources = [rng.choice("aaaabbc") for _ in sizes]
    total = sum(sizes)
    shares = {s: sum(z for z, t in zip(sizes, sources) if t == s) / total for s in "abc"}
    where = [p.container for p in sorted(packing.pack(sizes, sources, 2048, shares, {}))]
    filled = defaultdict(int)
    for w, z in zip(where, sizes):
        filled[w] += z
    assert max(filled.values()) <= 2048 and total / 2048 / len(filled) > 0.97
    first = [i for i, w in enumerate(where) if w < len(filled) // 2]
    for s in "abc":
        part = sum(sizes[i] for i in first if sources[i] == s) / sum(sizes[i] for i in first)
        assert abs(part - shares[s]) < 0.03
    assert packing.pack([], [], 10, {}, {}) == [] and packing.pack([0, 0], ["a", "a"], 10, {"a": 0.0}, {}) == [(0, 0, 0, 0), (1, 0, 0, 0)]
    assert packing.pack([25], ["a"], 10, {"a": 1.0}, {}) == [(0, 0, 10, 0), (0, 1, 10, 1), (0, 2, 5, 2)]


@pytest.mark.parametrize("capacity", [700, 8000])
def test_what_sources_are_owed_stays_bounded(capacity):
    """However many containers: no source runs ahead of its share, or behind it, by more than about two containers, until a source ends."""
    rng = random.Random(3)
    sources = [rng.choice("aaaaabbcd") for _ in range(9000)]
    sizes = [min(3 * capacity, int(rng.lognormvariate(5.2, 0.9)) + 1) for _ in sources]
    total = {s: sum(z for z, t in zip(sizes, sources) if t == s) for s in "abcd"}
    shares = {s: t / sum(total.values()) for s, t in total.items()}
    owed = {"a": 300.0, "b": -200.0, "c": -100.0}
    packed, taken = 0, {s: -owed.get(s, 0.0) for s in "abcd"}
    for p in packing.pack(sizes, sources, capacity, shares, owed):
        packed += p.tokens
        taken[sources[p.row]] += p.tokens
        assert all(abs(taken[s] - shares[s] * packed) <= 3 * capacity for s in "abcd")
    # What is owed at the end is what the sums foretell.
    assert all(abs((taken[s] - shares[s] * packed) + owed.get(s, 0.0)) < 1e-6 for s in "abcd")


def test_windows_follow_target_proportions(spark):
    rows = [(n, "word " * (5 + n % 20), "ab"[n % 2]) for n in range(2000)]
    sized = mixing.sized_documents(documents(spark, rows))
    targets = spark.createDataFrame([("a", 0.8), ("b", 0.2), ("c", 0.0)], "source string, share double")
    packed = packing.pack_windows(sized, 300, targets=targets).toPandas()
    first = packed[packed["container_id"] < 40].groupby("source")["tokens"].sum()
    assert abs(first["a"] / first.sum() - 0.8) < 0.03
    assert packed["tokens"].sum() == sum(r["tokens"] for r in sized.collect())


def test_windows_hold_every_token_once(spark):
    rows = [(1, "word " * 5000, "a"), (2, "", "a"), (3, None, None), (4, "one two three", "B_c "), (4, "one two three", "b-c"), (None, "x", "a")] + [(n, "some text here " * (n % 9), f"s{n % 3}") for n in range(10, 200)]
    sized = mixing.sized_documents(documents(spark, rows))
    assert {r["source"] for r in sized.collect()} >= {"a", "b-c", None}
    for per_task in (100_000, 40):
        packed = packing.pack_windows(sized, 512, per_task)
        got = packed.collect()
        assert {r["doc_id"] for r in got} == {r[0] for r in rows if r[0] is not None}
        filled, seen = defaultdict(int), defaultdict(int)
        for r in got:
            filled[r["container_id"]] += r["tokens"]
            seen[r["doc_id"]] += r["tokens"]
        assert max(filled.values()) <= 512 and all(seen[r["doc_id"]] == r["tokens"] for r in sized.collect())
        assert {r["doc_id"] for r in got if r["n_segments"] > 1} == {1}
        report = packing.fill(packed, 512).first()
        assert report["containers"] == len(filled) and report["tokens"] == sum(filled.values())
    assert packing.pack_windows(sized.limit(0), 512).count() == 0


def test_mix_reaches_shares_and_reports_short_sources(spark):
    rng = random.Random(2)
    rows = [(n, "tok " * rng.randint(1, 300), rng.choice(["big", "BIG ", "big", "mid_one", "Mid-One", "tiny", "unlisted", None])) for n in range(3000)]
    rows = [r for r in rows if r[2] != "tiny" or r[0] % 40 == 0]
    targets = spark.createDataFrame([("big", 0.4, 3, "x"), ("mid-one", 0.3, 3, "x"), ("tiny", 0.2, 2, "x"), ("absent", 0.1, 5, "x"), (None, 0.5, 1, "x")], "source string, target_share double, max_repeats int, tokens string")
    sized = mixing.sized_documents(documents(spark, rows))
    plan = mixing.plan_mix(sized, targets)
    mixed = mixing.mix(sized, plan)
    report = {r["source"]: r for r in mixing.shares(mixed, plan).collect()}
    assert {s for s, r in report.items() if r["short"]} == {"tiny", "absent"}
    size = {r["doc_id"]: r["tokens"] for r in sized.collect()}
    total = sum(r["tokens"] for r in sized.collect() if r["source"] in ("big", "mid-one", "tiny"))
    # What tiny and absent lack goes to the others, 4 : 3; the mix is as large as all listed documents but for a document of each.
    left = total - report["tiny"]["mixed_tokens"]
    for s, share in (("big", 4 / 7), ("mid-one", 3 / 7)):
        assert 0 <= share * left - report[s]["mixed_tokens"] <= max(size.values()) + 1
    assert 0 <= total - sum(r["mixed_tokens"] for r in report.values()) <= 2 * max(size.values()) + 2
    assert report["tiny"]["most_repeats"] == 2 and report["absent"]["mixed_tokens"] == 0
    got = mixed.collect()
    assert all(size[r["doc_id"]] == r["tokens"] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    # Against the definition: of each source the documents of the smallest hashes whose tokens fill the partial copy.
    below = {r["key"]: r["below"] for r in mixing.thresholds(sized, plan).collect()}
    for p in plan.where("partial > 0 and tokens > 0").collect():
        own = sorted((r["h"], r["tokens"]) for r in sized.collect() if r["source"] == p["key"])
        inside = [t for h, t in own if h < below[p["key"]]]
        after = next((t for h, t in own if h >= below[p["key"]]), None)
        assert sum(inside) <= p["partial"] and (after is None or sum(inside) + after > p["partial"])
    empty = mixing.plan_mix(sized.limit(0), targets)
    assert mixing.mix(sized.limit(0), empty).count() == 0
    assert mixing.shares(mixing.mix(sized.limit(0), empty), empty).where("short").count() == 0


def test_leftovers_are_given_out():
    assert mixing.give_out(100, [(0.5, 1000), (0.5, 1000)]) == [50, 50]
    assert mixing.give_out(100, [(0.5, 10), (0.3, 1000), (0.2, 1000)]) == [10, 54, 36]
    assert mixing.give_out(100, [(0.5, 10), (0.3, 50), (0.2, 1000)]) == [10, 50, 40]
    assert mixing.give_out(100, [(0.5, 10), (0.3, 20), (0.2, 0)]) == [10, 20, 0] and mixing.give_out(0, [(1.0, 5)]) == [0.0]


@pytest.mark.parametrize("spelling", ["Read_Me", " read-me", "READ me ", "read-me"])
def test_source_spellings(spark, spelling):
    assert spark.createDataFrame([(spelling,)], "s string").select(mixing.source_key(F.col("s"))).first()[0] == "read-me"
