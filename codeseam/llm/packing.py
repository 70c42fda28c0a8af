"""Problem 6: put texts into containers of a fixed capacity, every container filled to target proportions of the sources.

Deficit round-robin: a source earns its share of every token that is packed, and the source that is owed most gives its next
text, or else its largest that still fits, until nothing fits. A text above the capacity is divided where it is packed: it
fills whole containers, and what is left of it goes first in its source's queue. What a source is owed goes on to the next
container, and from one partition to the next: as every token that is packed is earned by all and taken by one, what a
partition leaves owed is exactly share x its tokens - the source's tokens in it, which sums beforehand tell.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeseam.session import durable, parts_for, salt, small_side

#: Items that one task packs.
ITEMS_PER_TASK = 150_000
OUT = "doc_id long, segment_no int, n_segments int, source string, tokens long, container_id long"


class Placed(NamedTuple):
    """A text, or a part of one, and the container it is in."""

    row: int
    segment_no: int
    tokens: int
    container: int


class _Queue:
    """The texts of one source: in the order they came, and those that a container can hold also by size."""

    def __init__(self, items: list[tuple[int, int]], capacity: int) -> None:
        self.order, self.at, self.left, self.capacity = items, 0, len(items), capacity
        self.used: set[int] = set()
        self.rest: tuple[int, int] | None = None  # what is left of a divided text: (size, row)
        self.by_size: dict[int, list[int]] = {}
        for size, row in reversed(items):
            if size <= capacity:
                self.by_size.setdefault(size, []).append(row)
        self.sizes = sorted(self.by_size)

    def _spend(self, size: int, row: int) -> None:
        rows = self.by_size[size]
        rows.pop() if rows[-1] == row else rows.remove(row)
        if not rows:
            del self.by_size[size], self.sizes[bisect_right(self.sizes, size) - 1]

    def take(self, room: int) -> tuple[int, int] | None:
        """(size, row) of what goes into the room: the next text if it fits, a full container's worth of one that is above
        the capacity into an empty container, else the largest text that fits; None if there is none."""
        while self.at < len(self.order) and self.order[self.at][1] in self.used:
            self.at += 1
        size, row = self.rest or (self.order[self.at] if self.at < len(self.order) else (0, -1))
        if row >= 0 and size > self.capacity and room == self.capacity:
            self.rest = (size - room, row)
            self.used.add(row)
            return room, row
        if row >= 0 and size <= room:
            if self.rest:
                self.rest = None
            else:
                self._spend(size, row)
        else:
            k = bisect_right(self.sizes, room) - 1
            if k < 0:
                return None
            size = self.sizes[k]
            row = self.by_size[size][-1]
            self._spend(size, row)
        self.used.add(row)
        self.left -= 1
        return size, row


def pack(sizes: list[int], sources: list[str], capacity: int, shares: dict[str, float], owed: dict[str, float]) -> list[Placed]:
    """Where the texts go; containers count from 0 and none is above capacity. owed: what each source is due at the start."""
    items: dict[str, list[tuple[int, int]]] = {}
    for row, (size, source) in enumerate(zip(sizes, sources)):
        items.setdefault(source, []).append((size, row))
    ready = {s: _Queue(q, capacity) for s, q in sorted(items.items())}
    taken, packed = {s: -owed.get(s, 0.0) for s in ready}, 0
    share = {s: shares.get(s, 0.0) for s in ready}
    parts: dict[int, int] = {}
    out: list[Placed] = []
    container = 0
    while ready:
        room = capacity
        # Owed at the end of this container, were it filled: the order in which sources give, mended by what they give.
        turn = sorted((taken[s] - share[s] * (packed + capacity), s) for s in ready)
        while turn:
            due, s = turn.pop(0)
            got = ready[s].take(room)
            if got is None:
                continue
            size, row = got
            room -= size
            packed += size
            taken[s] += size
            out.append(Placed(row, parts.get(row, 0), size, container))
            parts[row] = parts.get(row, 0) + 1
            if ready[s].left:
                insort(turn, (due + size, s))
            else:
                del ready[s]
        container += 1
    return out


def _pack_part(capacity: int):
    def run(key: tuple, items: pd.DataFrame, due: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["h", "doc_id"], kind="stable")
        shares, owed = dict(zip(due["source"], due["share"])), dict(zip(due["source"], due["owed"]))
        placed = pd.DataFrame(pack(items["tokens"].tolist(), items["source"].tolist(), capacity, shares, owed), columns=Placed._fields)
        whole = items[["doc_id", "source"]].iloc[placed["row"]].reset_index(drop=True)
        return pd.DataFrame(
            {
                "doc_id": whole["doc_id"],
                "segment_no": placed["segment_no"],
                "n_segments": placed.groupby("row")["segment_no"].transform("count"),
                "source": whole["source"],
                "tokens": placed["tokens"],
                "container_id": placed["container"] + int(key[0]) * (1 << 32),
            }
        ).astype({"segment_no": "int32", "n_segments": "int32"})

    return run


def pack_windows(sized: DataFrame, capacity: int, items_per_task: int = ITEMS_PER_TASK, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, segment_no, n_segments, source, tokens, container_id) for every row of sized (see mixing.sized_documents).

    Only a text above the capacity is divided. A source that is null is one of its own, named ''. Empty texts take a
    place of no size. targets (source, share) are the proportions that containers are filled to, as long as a source has
    texts left; without them a source's share of all tokens, so that the mixture holds to the last container. A source
    that isn't in targets has share 0 and gives when the others have nothing that fits. Items are dealt out by hash over
    as many tasks as keep each at about items_per_task, however large a source is.
    """
    items = sized.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "tokens", "h")
    items = items.withColumn("part", salt(F.col("h"), parts_for(sized.count(), items_per_task)))
    sums = durable(items.groupBy("part", "source").agg(F.sum("tokens").alias("t")))
    totals = sums.groupBy("source").agg(F.sum("t").alias("source_tokens"))
    everything = totals.agg(F.sum("source_tokens").alias("all_tokens"))  # one row
    if targets is None:
        share = F.coalesce(F.try_divide(F.col("source_tokens").cast("double"), F.col("all_tokens").cast("double")), F.lit(0.0))
        shares = totals.join(F.broadcast(everything)).select("source", share.alias("share"))
    else:
        wanted = targets.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(F.greatest("share", F.lit(0.0))).alias("share"))
        shares = totals.select("source").join(small_side(wanted), "source", "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    part_tokens = sums.groupBy("part").agg(F.sum("t").alias("part_tokens"))
    grid = part_tokens.join(small_side(shares)).join(sums, ["part", "source"], "left").fillna(0, ["t"])  # partitions x sources
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    owed = F.coalesce(F.sum(F.col("share") * F.col("part_tokens") - F.col("t")).over(before), F.lit(0.0))
    due = grid.select("part", "source", "share", owed.alias("owed"))
    return items.groupBy("part").cogroup(due.groupBy("part")).applyInPandas(_pack_part(capacity), OUT)


def divided(packed: DataFrame) -> DataFrame:
    """doc_id of the texts that lie in more than one container."""
    boxes = packed.groupBy("doc_id").agg(F.min("container_id").alias("a"), F.max("container_id").alias("b"))
    return boxes.where("a <> b").select("doc_id")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of the room that is used, and the mean distance to the corpus's mixture."""
    packed = durable(packed)  # used more than once; small rows, without the texts
    by = packed.groupBy("container_id", "source").agg(F.sum("tokens").alias("t"))
    boxes = by.groupBy("container_id").agg(F.sum("t").alias("box_tokens"))
    shares = by.groupBy("source").agg(F.sum("t").alias("source_tokens"))
    total = boxes.agg(F.count("*").alias("containers"), F.sum("box_tokens").alias("tokens"))
    # Half the sum of |share in the container - share in the corpus|, over the sources in the container and those not in it.
    joined = by.join(boxes, "container_id").join(shares, "source").join(F.broadcast(total))
    here, there = F.try_divide(F.col("t"), F.col("box_tokens")), F.col("source_tokens") / F.col("tokens")
    distance = joined.groupBy("container_id").agg((F.sum(F.abs(here - there)) + 1 - F.sum(there)).alias("d")).agg(F.round(F.avg(F.col("d") / 2), 6).alias("mixture_distance"))
    return total.join(distance).select("containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill_rate"), "mixture_distance")
