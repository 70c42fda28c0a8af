"""Problem 1: one order per group out of several scores of different scale (reciprocal rank fusion).

Each score is ranked on its own, so that its scale and outliers don't matter, and an item gets the sum of 1 / (k + rank).

Groups are counted first. Those of ordinary size meet in one shuffle by group: copies, ranks, sum and position all use it.
A group of more than HOT_ITEMS rows (and 1/20000 of all rows) never meets in one task: equal values are counted first,
ranks and positions come from running counts over range partitions, which sampling keeps even whatever the values are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeseam.session import HOT_ROWS as HOT_ITEMS
from codeseam.session import by_size, durable, join_counted, numbered, running

#: The usual constant of reciprocal rank fusion.
RRF_K = 60
#: Equal values with more rows than this and than 1/500 of all items are joined by broadcast (at most 2000 of them).
HOT_VALUES = 20_000


def usable(score: Column) -> Column:
    """The score as double; null where it wasn't computed (null, NaN, 0 or below)."""
    v = score.cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (v > 0), v)


def _total(ranks: Sequence[Column], k: int) -> Column:
    """The sum of 1 / (k + rank), rounded to 12 digits so that it doesn't depend on the order of the sum; nulls add nothing."""
    parts = [F.coalesce(1 / (F.lit(float(k)) + r), F.lit(0.0)) for r in ranks]
    return F.round(sum(parts[1:], parts[0]), 12)


def _fuse_meeting(rows: DataFrame, n_scores: int, k: int) -> DataFrame:
    """(g, i, fused) of groups that fit into a task: one shuffle by g."""
    items = rows.repartition("g").groupBy("g", "i").agg(*(F.max(f"s{n}").alias(f"s{n}") for n in range(n_scores)))
    place = lambda s: F.when(F.col(s).isNotNull(), F.rank().over(Window.partitionBy("g").orderBy(F.col(s).desc_nulls_last())))
    return items.select("g", "i", _total([place(f"s{n}") for n in range(n_scores)], k).alias("fused"))


def _fuse_spread(rows: DataFrame, n_scores: int, k: int) -> DataFrame:
    """As _fuse_meeting, for groups of any size."""
    items = durable(rows.groupBy("g", "i").agg(*(F.max(f"s{n}").alias(f"s{n}") for n in range(n_scores))))
    unpivot = f"stack({n_scores}, {', '.join(f'{n}, s{n}' for n in range(n_scores))}) as (kind, value)"
    long = items.select("g", "i", F.expr(unpivot)).where("value is not null")
    counts = long.groupBy("g", "kind", "value").agg(F.count("*").alias("n"))
    ranks = running(counts, ["g", "kind"], [("value", True)], "n", "above")
    hot_from = max(HOT_VALUES, items.count() // 500)  # of the n_scores rows that an item has at most, one in 2000
    ranked = join_counted(long, ranks, ["g", "kind", "value"], "n", "i", hot_from)
    ranked = ranked.groupBy("g", "i").pivot("kind", list(range(n_scores))).agg(F.max(F.col("above") + 1))
    total = _total([F.col(f"`{n}`") for n in range(n_scores)], k)
    return items.select("g", "i").join(ranked, ["g", "i"], "left").select("g", "i", total.alias("fused"))


def _scored(df: DataFrame, group: str, item: str, scores: Sequence[str]) -> DataFrame:
    items = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *(usable(F.col(s)).alias(f"s{n}") for n, s in enumerate(scores)))
    return items.where("g is not null and i is not null")


def fuse(df: DataFrame, group: str, item: str, scores: Sequence[str], k: int = RRF_K, hot_items: int = HOT_ITEMS) -> DataFrame:
    """(group, item, fused): the reciprocal rank fusion of the scores within each group.

    A score that is null, NaN, 0 or negative contributes nothing; an item without any usable score gets 0. Equal values
    share the best rank, as in SQL's rank(), so that a tie lifts nobody above another. An item delivered several times
    counts once (per score its largest usable value). Rows without group or item are left out.
    """
    meeting, spread = by_size(_scored(df, group, item, scores), "g", hot_items)
    fused = _fuse_meeting(meeting, len(scores), k)
    if spread is not None:
        fused = fused.unionByName(_fuse_spread(spread, len(scores), k))
    return fused.select(F.col("g").alias(group), F.col("i").alias(item), "fused")


def _order_meeting(fused: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("g").orderBy(F.col("fused").desc(), F.col("i").asc()))
    return fused.withColumn("position", at.cast("long"))


def _order_spread(fused: DataFrame) -> DataFrame:
    rows = running(fused.withColumn("one", F.lit(1).cast("long")), ["g"], [("fused", True), ("i", False)], "one", "before")
    return rows.select("g", "i", "fused", (F.col("before") + 1).alias("position"))


def ranking(df: DataFrame, group: str, item: str, scores: Sequence[str], k: int = RRF_K, hot_items: int = HOT_ITEMS) -> DataFrame:
    """(group, item, fused, position): fuse and full_order in one, with one shuffle for all but the large groups."""
    meeting, spread = by_size(_scored(df, group, item, scores), "g", hot_items)
    ordered = _order_meeting(_fuse_meeting(meeting, len(scores), k))
    if spread is not None:
        ordered = ordered.unionByName(_order_spread(_fuse_spread(spread, len(scores), k)))
    return ordered.select(F.col("g").alias(group), F.col("i").alias(item), "fused", "position")


def full_order(fused: DataFrame, group: str, item: str, hot_items: int = HOT_ITEMS) -> DataFrame:
    """Every item with its position in its group, 1 first; equal totals in the order of the item, of whatever type it is."""
    rows = durable(fused.select(group, item, "fused"))
    return numbered(rows, group, [("fused", True), (item, False)], "position", hot_items).withColumn("position", F.col("position") + 1)


def top(ordered: DataFrame, group: str, wants: DataFrame, want: str) -> DataFrame:
    """The first `want` items of each group of a ranking; groups without a number, or with null, yield nothing."""
    need = wants.where(F.col(group).isNotNull() & F.col(want).isNotNull()).groupBy(group).agg(F.max(want).alias("__want"))
    return ordered.join(need, group).where("position <= __want").drop("__want")
