"""Problem 7: combine sources to target shares of the tokens, small ones repeated up to a cap.

No sort: tokens are summed by source and hash bucket, the bucket in which a source's budget ends is looked up, and only
the documents of that bucket are summed again, on the next bits of their hash. Choosing is then a filter on the hash.
What sources lack that can't reach their target is given out to the others, so that the mix is as large as promised as
long as any source has repeats left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.llm.tokens import n_tokens
from codeseam.session import durable, small_side

#: Bits of the hash that a level of histograms resolves, and levels there are.
BITS, LEVELS = 12, 5


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, no outer blanks, `-` for `_` and inner blanks; null stays null."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(source, r"\s+", " "))), "[_ ]+", "-")


def sized_documents(documents: DataFrame, **tokenizer: str) -> DataFrame:
    """(doc_id, source, tokens, h), once per doc_id, kept in the shared folder as tokens are dear to count.

    h is a hash of 60 bits. Rows without doc_id are left out; a null text has 0 tokens; of repeated ids the first source
    in alphabetical order and the largest size count.
    """
    rows = documents.where("doc_id is not null").select("doc_id", source_key(F.col("source")).alias("source"), n_tokens(F.col("text"), **tokenizer).alias("tokens"))
    once = rows.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens"))
    return durable(once.withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << BITS * LEVELS) - 1))))


def give_out(total: float, rows: list[tuple[float, float]]) -> list[float]:
    """Budgets that add up to total, in proportion to the shares, none above its source's most; rows: (share, most).

    What doesn't fit goes to those with room, again by share, until nothing is left or nobody has room.
    """
    budgets, open_rows = [0.0] * len(rows), [n for n, (share, most) in enumerate(rows) if share > 0 and most > 0]
    left = float(total)
    while open_rows and left > 1e-9 * max(total, 1.0):
        shares = sum(rows[n][0] for n in open_rows)
        filled = [n for n in open_rows if budgets[n] + left * rows[n][0] / shares >= rows[n][1]]
        if not filled:
            for n in open_rows:
                budgets[n] += left * rows[n][0] / shares
            return budgets
        # Full ones are set first: what is left is then given anew to the others from the start.
        for n in filled:
            budgets[n] = float(rows[n][1])
        open_rows = [n for n in open_rows if n not in set(filled)]
        for n in open_rows:
            budgets[n] = 0.0
        left = total - sum(budgets)
    return budgets


PLAN = "source string, key string, target_share double, max_repeats long, tokens long, n_docs long, target_tokens double, budget double, copies long, partial long"


def plan_mix(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per listed source: share, max_repeats, available tokens, target and budget, whole copies and tokens of the partial one.

    The mix is as large as all documents of the listed sources together; target_tokens is a source's share of it, budget
    what it gives: the target, less what its documents lack at max_repeats, plus its part of what others lack. Targets
    spelt differently but alike by source_key are one source (shares add up, the largest cap holds); null shares and caps
    count as 0 and 1. The driver holds one row per listed source.
    """
    listed = targets.where("source is not null").groupBy(source_key(F.col("source")).alias("key")).agg(
        F.min("source").alias("source"), F.sum(
            F.coalesce("target_share", F.lit(0.0))
        ).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("long").alias("max_repeats")
    )
    have = sized.groupBy(F.col("source").alias("key")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"))
    found = small_side(listed).join(have, "key", "left").orderBy("key").collect()
    rows = [(r["source"], r["key"], max(r["target_share"], 0.0), max(r["max_repeats"], 0), r["tokens"] or 0, r["n_docs"] or 0) for r in found]
    total = sum(r[4] for r in rows)
    out = []
    for row, budget in zip(rows, give_out(total, [(share, tokens * cap) for _, _, share, cap, tokens, _ in rows])):
        _, _, share, cap, tokens, _ = row
        copies = min(cap, int((budget + 1e-6) // tokens)) if tokens else 0
        partial = max(0, int(budget - copies * tokens + 1e-6)) if copies < cap else 0
        out.append((*row, float(share * total), float(budget), copies, partial))
    return sized.sparkSession.createDataFrame(out, PLAN)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """key -> below: of each source the documents with h < below are those whose tokens fill the partial copy.

    A level looks at one bucket of each source only; between levels the driver holds one row per listed source.
    """
    spark = sized.sparkSession
    schema = "key string, prefix long, left_tokens long"
    state = [(r["key"], 0, r["partial"]) for r in plan.where("partial > 0 and tokens > 0").select("key", "partial").collect()]
    done: dict[str, int] = {}
    for level in range(LEVELS):
        if not state:
            break
        shift = BITS * (LEVELS - level - 1)
        at = small_side(spark.createDataFrame(state, schema))
        inside = sized.join(
            at, (F.col("source") == F.col("key")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
        ) if level else sized.join(at, F.col("source") == F.col("key"))
        hist = inside.groupBy("key", "prefix", "left_tokens", F.shiftright("h", shift).alias("bucket")).agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        upto = F.sum("t").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = hist.withColumn("upto", upto).where("upto > left_tokens")
        edge = {r["key"]: r for r in over.groupBy("key").agg(F.min(F.struct("bucket", "t", "n", "upto")).alias("e")).select("key", "e.*").collect()}
        following = []
        for key, prefix, left in state:
            if key not in edge:
                done[key] = (prefix + 1) << (shift + BITS)
            elif edge[key]["n"] == 1 or level == LEVELS - 1:
                done[key] = edge[key]["bucket"] << shift
            else:
                following.append((key, edge[key]["bucket"], left - (edge[key]["upto"] - edge[key]["t"])))
        state = following
    return spark.createDataFrame(sorted(done.items()), "key string, below long")


def mix(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, tokens, repeats) for every document used at least once; source as spelt in the targets."""
    rules = plan.join(thresholds(sized, plan), "key", "left").select("key", F.col("source").alias("listed"), "copies", F.coalesce("below", F.lit(0).cast("long")).alias("below"))
    repeats = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    rows = sized.join(small_side(rules), F.col("source") == F.col("key")).withColumn("repeats", repeats.cast("int"))
    return rows.where("repeats > 0").select("doc_id", F.col("listed").alias("source"), "tokens", "repeats")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per listed source: target and actual share, tokens, repeats used, and whether it misses its target.

    short is read off the mix: its tokens of the source are below the target although every document of the source is in
    it as often as it may be.
    """
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"),
        F.min("repeats").alias("least_repeats"), F.count("*").alias("used_docs")
    )
    rows = plan.join(used, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("long")))
    total = rows.agg(F.sum("mixed_tokens").alias("all_tokens"))
    rows = rows.join(F.broadcast(total))  # one row
    actual = F.round(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("all_tokens").cast("double")), 6)
    exhausted = (F.col("n_docs") == 0) | ((F.col("used_docs") == F.col("n_docs")) & (F.col("least_repeats") == F.col("max_repeats")))
    short = F.coalesce(exhausted & (F.col("mixed_tokens") < F.col("target_tokens") * (1 - 1e-9)), F.lit(False))
    columns = ["source", "target_share", actual.alias("actual_share"), "max_repeats", F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.col("tokens").alias("available_tokens"), "mixed_tokens", short.alias("short")]
    return rows.select(*columns)
