"""Packing of file summaries into a token budget by importance."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C
from codeseam.operators import graph
from codeseam.operators.stubs import Block, blocks, size, stub, stub_column
from codeseam.session import HOT_ROWS, by_size, durable, running, small_side

MIN_UPGRADE, PASSES, WEIGHT_POWER = 30, 5, 1.5
BLOCK_WEIGHT = {"function": 3.0, "class": 2.5, "macro": 1.5, "annotation": 1.5, "misc": 0.5, "imports": 0.5}
SEEN_FACTOR, CONNECTED_BONUS, MATCH_FROM = 0.3, 5.0, 3.0


def water_fill(files: list[tuple[float, int, int]], budget: int) -> list[int]:
    """Tokens for each (importance, full cost, cost of a mention): 0 is a mention only, the full cost everything.

    What is left after all mentions goes to the files by weight. In each of a few passes, in the given order, a file
    whose share covers its cost is settled at that and frees the rest, and one whose share is of no use stays a mention.
    """
    left = budget - sum(mention for _, _, mention in files)
    out = [0] * len(files)
    weights = [importance**WEIGHT_POWER for importance, _, _ in files]
    total = sum(weights)
    if left <= 0 or total <= 0:
        return out
    open_files = list(range(len(files)))
    for _ in range(PASSES):
        still = []
        for k, i in enumerate(open_files):
            if total <= 0 or left == 0:
                still += open_files[k:]
                break
            share, need = int(weights[i] / total * left), max(0, files[i][1] - files[i][2])
            if share >= need:
                out[i] = files[i][1]
                left = max(0, left - need)
                total -= weights[i]
            elif share < MIN_UPGRADE:
                total -= weights[i]
            else:
                still.append(i)
        settled, open_files = len(still) < len(open_files), still
        if not settled:
            break
    rest = sum(weights[i] for i in open_files)
    if rest > 0 and left > 0:
        for i in open_files:
            out[i] = files[i][2] + int(weights[i] / rest * left)
    return out


def block_score(block: Block, terms: list[str]) -> float:
    low = block.full.lower()
    return BLOCK_WEIGHT[block.kind] + sum(10.0 if block.identifier and t in block.identifier else 3.0 if t in low else 0.0 for t in terms)


def prune(parts: list[Block], terms: list[str], budget: int) -> str:
    """The best blocks that fit, whole or else shortened, in their order."""
    chosen: dict[int, str] = {}
    used = 0
    for k in sorted(range(len(parts)), key=lambda k: -block_score(parts[k], terms)):
        if used + parts[k].cost <= budget:
            chosen[k] = parts[k].full
            used += parts[k].cost
        elif 0 < parts[k].summary_cost and used + parts[k].summary_cost <= budget:
            chosen[k] = parts[k].summary
            used += parts[k].summary_cost
    return "".join(chosen[k] for k in sorted(chosen))


def allocate(files: list[tuple[str, str, str, str, float]], budget: int, terms: list[str]) -> list[tuple[str, int, int, str]]:
    """(path, tier, cost, content) of each (path, ext, summary, description, importance); for summaries see stubs.stub.

    Tier 1 is the whole summary, 2 its best blocks, 4 a mention. If all summaries fit, all are whole; if at the end the
    sum is above the budget, the least important become mentions until it fits.
    """
    mention = [f"// {path} — {desc}\n" for path, _, _, desc, _ in files]
    texts = [summary for _, _, summary, _, _ in files]
    tiers = [1] * len(files)
    if sum(map(size, texts)) > budget:
        shares = water_fill([(f[4], size(t), size(m)) for f, t, m in zip(files, texts, mention)], budget)
        for i, share in enumerate(shares):
            if 0 < share < size(texts[i]):
                pruned = prune(blocks(texts[i], files[i][1]), terms, share)
                texts[i], tiers[i] = (pruned, 2) if pruned.strip() else (mention[i], 4)
            elif share == 0:
                texts[i], tiers[i] = mention[i], 4
        total = sum(map(size, texts))
        for i in sorted(range(len(files)), key=lambda i: files[i][4]):
            if total <= budget:
                break
            if tiers[i] < 4:
                total += size(mention[i]) - size(texts[i])
                texts[i], tiers[i] = mention[i], 4
    for i, text in enumerate(texts):
        if tiers[i] < 4 and not text.strip():
            texts[i], tiers[i] = mention[i], 4
    return [(f[0], tier, size(text), text) for f, tier, text in zip(files, tiers, texts)]


def _sums(requests: DataFrame, *costs: str) -> DataFrame:
    """One row per request with the sums of costs as __sum_<cost>."""
    return requests.groupBy("request_id").agg(*(F.sum(F.greatest(F.col(c), F.lit(1))).alias(f"__sum_{c}") for c in costs))


def fill_requests(requests: DataFrame, budget: int) -> DataFrame:
    """(request_id, path, allowed) for rows of request_id, path, importance, full_cost, mention_cost.

    Where the mentions alone come to the budget every file stays a mention, and that is told from sums. So a request that
    is shared out in one task has fewer files than the budget has tokens, however many files there are in all.
    """
    kind = requests.schema["request_id"].dataType.simpleString()
    rows = requests.select("request_id", "path", "importance", "full_cost", "mention_cost")
    sums = _sums(rows, "mention_cost")
    crowded = F.col("__sum_mention_cost") >= budget + 1  # costs of 0 count as 1 here: at most `budget` files go on
    placed = rows.join(sums, "request_id")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        allowed = water_fill(list(zip(frame["importance"], frame["full_cost"], frame["mention_cost"])), budget)
        return pd.DataFrame({"request_id": frame["request_id"], "path": frame["path"], "allowed": allowed})

    shared = placed.where(~crowded).drop("__sum_mention_cost").groupBy("request_id").applyInPandas(run, f"request_id {kind}, path string, allowed long")
    return placed.where(crowded).select("request_id", "path", F.lit(0).cast("long").alias("allowed")).unionByName(shared)


def _shorten(terms: list[str]):
    """The files whose summary is to be cut down, each by itself: (tier, tokens)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pruned = [prune(blocks(stub(t, e), e or ""), terms, int(n)) for t, e, n in zip(frame["content"], frame["ext"], frame["allowed"])]
            frame["tier"] = [2 if p.strip() else 4 for p in pruned]
            frame["tokens"] = [size(p) if p.strip() else m for p, m in zip(pruned, frame["mention_cost"])]
            yield frame[["request_id", "path", "importance", "mention_cost", "tier", "tokens"]]

    return run


def _trim(budget: int):
    """The least important become mentions until the sum fits; the rows of a request are fewer than the budget's tokens."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path").reset_index(drop=True)
        total = int(frame["tokens"].sum())
        tier, tokens = frame["tier"].tolist(), frame["tokens"].tolist()
        for i in frame["importance"].sort_values(kind="stable").index:
            if total <= budget:
                break
            if tier[i] < 4:
                total += int(frame["mention_cost"][i]) - tokens[i]
                tier[i], tokens[i] = 4, int(frame["mention_cost"][i])
        return frame.assign(tier=tier, tokens=tokens)[["request_id", "path", "tier", "tokens", "importance"]]

    return run


#: Bytes of texts up to which the summaries of a request go to one task.
TOGETHER_BYTES = 64_000_000


def pack_requests(requests: DataFrame, budget: int, query: str = "", together: int = TOGETHER_BYTES) -> DataFrame:
    """(request_id, path, tier, tokens, importance) for rows of request_id, path, ext, content, desc, importance, as allocate.

    path is unique in a request. Requests of at most `together` bytes are one task's work each, larger ones are spread.
    """
    sizes = requests.groupBy("request_id").agg(F.sum(F.octet_length("content")).alias("__bytes"))
    large = sizes.where(F.col("__bytes") > together).select(F.col("request_id").alias("__large"))
    if large.isEmpty():
        return _pack_together(requests, budget, query)
    large = small_side(durable(large))
    same = F.col("request_id").eqNullSafe(F.col("__large"))
    return _pack_together(requests.join(large, same, "left_anti"), budget, query).unionByName(_pack_spread(requests.join(large, same, "left_semi"), budget, query))


def _pack_together(requests: DataFrame, budget: int, query: str) -> DataFrame:
    """pack_requests where the summaries of a request fit into a task; they are made before they meet."""
    kind = requests.schema["request_id"].dataType.simpleString()
    terms = [t for t in query.lower().split() if len(t) >= 2]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        rows = allocate(list(zip(frame["path"], frame["ext"], frame["stub"], frame["desc"], frame["importance"])), budget, terms)
        return pd.DataFrame({
            "request_id": frame["request_id"], "path": [r[0] for r in rows], "tier": [r[1] for r in rows], "tokens": [r[2] for r in rows], "importance": frame["importance"],
        })

    rows = requests.select("request_id", "path", "ext", stub_column(F.col("content"), F.col("ext")).alias("stub"), "desc", "importance")
    return rows.groupBy("request_id").applyInPandas(run, f"request_id {kind}, path string, tier int, tokens long, importance double")


def _pack_spread(requests: DataFrame, budget: int, query: str) -> DataFrame:
    """pack_requests for requests of any size.

    The summaries are measured once; numbers are kept. A request whose summaries all fit is whole, one whose mentions
    alone come to the budget is all mentions: both are told from sums. The others have fewer files than the budget has
    tokens; numbers alone are shared out, and only the texts of files that are to be cut down are read again.
    """
    kind = requests.schema["request_id"].dataType.simpleString()
    terms = [t for t in query.lower().split() if len(t) >= 2]
    summary = requests.select(
        "request_id", "path", "importance", C.tokens(C.manifest_line(F.col("path"), F.col("desc"))).cast("long").alias("mention_cost"),
        F.explode(F.array(stub_column(F.col("content"), F.col("ext")))).alias("s")
    )
    rows = durable(
        summary.select(
            "request_id", "path", "importance", "mention_cost", C.tokens(F.col("s")).cast("long").alias("full_cost"),
            (F.trim(F.regexp_replace("s", r"\s+", " ")) == "").alias("blank")
        )
    )
    sums = rows.groupBy("request_id").agg(F.sum("full_cost").alias("__full"), F.sum(F.greatest("mention_cost", F.lit(1))).alias("__mentions"))
    placed = rows.join(sums, "request_id")
    fits, crowded = F.col("__full") <= budget, F.col("__mentions") > budget
    mention = lambda rows: rows.select("request_id", "path", F.lit(4).alias("tier"), F.col("mention_cost").alias("tokens"), "importance")
    whole = placed.where(fits).select(
        "request_id", "path", F.when(F.col("blank"), 4).otherwise(1).alias("tier"),
        F.when(F.col("blank"), F.col("mention_cost")).otherwise(F.col("full_cost")).alias("tokens"), "importance"
    )
    rest = placed.where(~fits & ~crowded).drop("__full", "__mentions")
    given = durable(rest.join(fill_requests(rest, budget), ["request_id", "path"]))
    columns = ["request_id", "path", "importance", "mention_cost"]
    none, full = (F.col("allowed") <= 0) | F.col("blank"), F.col("allowed") >= F.col("full_cost")
    settled = given.where(none | full).select(
        *columns, F.when(none, 4).otherwise(1).alias("tier"), F.when(none, F.col("mention_cost")).otherwise(F.col("full_cost")).alias("tokens")
    )
    cut = requests.select("request_id", "path", "ext", "content").join(small_side(given.where(~none & ~full).select(*columns, "allowed")), ["request_id", "path"])
    cut = cut.mapInPandas(_shorten(terms), f"request_id {kind}, path string, importance double, mention_cost long, tier int, tokens long")
    shared = settled.unionByName(cut).groupBy("request_id").applyInPandas(_trim(budget), f"request_id {kind}, path string, tier int, tokens long, importance double")
    return whole.unionByName(mention(placed.where(~fits & crowded))).unionByName(shared)


def answer(files: DataFrame, budget: int, query: str = "") -> DataFrame:
    """(path, tier, tokens, importance, content) of the files that one command asked for by name, in one task.

    files: path, ext, content, desc, importance; a list of paths that somebody wrote, for whole repositories see pack_requests.
    """
    terms = [t for t in query.lower().split() if len(t) >= 2]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("path")
        rows = allocate([(p, e or "", stub(t, e), d, i) for p, e, t, d, i in zip(frame["path"], frame["ext"], frame["content"], frame["desc"], frame["importance"])], budget, terms)
        return pd.DataFrame(
            rows, columns=["path", "tier", "tokens", "content"]
        ).assign(importance=frame["importance"].to_numpy())[["path", "tier", "tokens", "importance", "content"]]

    return files.select("path", "ext", "content", "desc", "importance").groupBy().applyInPandas(run, "path string, tier int, tokens long, importance double, content string")


def summary(packed: DataFrame, budget: int) -> DataFrame:
    """One row per request: files, tokens, and files by tier."""
    tier = lambda n: F.count_if(F.col("tier") == n)
    return packed.groupBy("request_id").agg(
        F.count("*").alias("files"), F.sum("tokens").alias("tokens"), tier(1).alias("whole"), tier(2).alias("pruned"), tier(4).alias("mentioned")
    ).withColumn("within", F.col("tokens") <= budget)


def connected_bonus(files: DataFrame, deps: DataFrame, modules: DataFrame) -> DataFrame:
    """files with importance raised where their module is one step from that of a file that matches well."""
    placed = files.join(graph.longest_module(files, modules), "file_id", "left")
    near = graph.expand(deps, placed.where((F.col("importance") >= MATCH_FROM) & F.col("module").isNotNull())).withColumn("near", F.lit(True))
    return placed.join(near, "module", "left").withColumn("importance", F.col("importance") + F.when(F.col("near"), CONNECTED_BONUS).otherwise(0.0)).drop("near")


def seen_penalty(importance: Column, seen: Column) -> Column:
    return F.when(seen, importance * SEEN_FACTOR).otherwise(importance)


def _take(frame: pd.DataFrame, budget: int) -> pd.DataFrame:
    """The files of a group that fit, in order; the first always counts."""
    frame = frame.sort_values(["o", "file_id"], kind="stable")
    chosen, used = [], 0
    for n, tokens in enumerate(frame["tokens"]):
        if (n == 0 and frame["first"].iloc[0]) or used + tokens <= budget - frame["used"].iloc[0]:
            chosen.append(n)
            used += tokens
    return frame.iloc[chosen]


def greedy(files: DataFrame, group: str, budget: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(group, file_id, tokens): files in the order of importance that fit, passing over those that don't; the first always counts.

    A large group is taken by rounds: the files before the first one that doesn't fit are told by running sums, and of the
    rest only what is no larger than the room left goes on, until few enough are left for one task. Null groups are one.
    """
    rows = files.select(F.col(group).alias("g"), "file_id", "tokens", (-F.col("importance")).alias("o"), F.lit(0).cast("long").alias("used"), F.lit(True).alias("first"))
    g, i = (files.schema[c].dataType.simpleString() for c in (group, "file_id"))
    schema = f"g {g}, file_id {i}, tokens long, o double, used long, first boolean"
    rows = rows.withColumns({"tokens": F.col("tokens").cast("long"), "o": F.col("o").cast("double")})
    few, many = by_size(rows, "g", hot_rows)
    run = lambda frame: _take(frame, budget)
    taken = few.groupBy("g").applyInPandas(run, schema)
    while many is not None:
        order = [("o", False), ("file_id", False)]
        summed = durable(running(many, ["g"], order, "tokens", "before"))
        over = (F.col("used") + F.col("before") + F.col("tokens") > budget) & ~(F.col("first") & (F.col("before") == 0))
        stop = summed.groupBy(F.col("g").alias("__g")).agg(F.min(F.when(over, F.struct("o", "file_id"))).alias("stop"))
        marked = summed.join(F.broadcast(stop), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")  # fewer than 20 000 groups
        here = F.col("stop").isNull() | (F.struct("o", "file_id") < F.col("stop"))
        now = durable(marked.where(here).select("g", "file_id", "tokens", "o", "used", "first"))
        spent = now.groupBy(F.col("g").alias("__g")).agg(F.sum("tokens").alias("spent"))
        left = marked.where(~here).join(F.broadcast(spent), F.col("g").eqNullSafe(F.col("__g"))).drop("__g")
        left = left.withColumn("used", F.col("used") + F.col("spent")).where(F.col("used") + F.col("tokens") <= budget).select(
            "g", "file_id", "tokens", "o", "used", F.lit(False).alias("first")
        )
        taken = taken.unionByName(now)
        few, many = by_size(durable(left), "g", hot_rows)
        taken = taken.unionByName(few.groupBy("g").applyInPandas(run, schema))
    return taken.select(F.col("g").alias(group), "file_id", "tokens")


def requests_of(files: DataFrame) -> DataFrame:
    """Each repository's files as one request, with standing importance and costs, and their texts where they are at hand.

    files: file_id, repo, path, ext, bytes and perhaps content, each file once.
    """
    mention = C.tokens(C.manifest_line(F.col("path"), C.describe(F.col("path"))))
    text = ["content"] if "content" in files.columns else []
    return files.select(
        "file_id", F.col("repo").alias("request_id"), "path", "ext", *text, C.describe(F.col("path")).alias("desc"), C.importance(
            F.col("path"), F.col("bytes")
        ).alias("importance"), F.ceil(F.col("bytes") / 3).cast("long").alias("full_cost"), mention.alias("mention_cost")
    )
