"""Treemap of categories: values by level and squarified rectangles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeseam.functions import columns as C


def values(files: DataFrame) -> DataFrame:
    """(node, parent, depth, files, value): categories with the cube root of their files, so that small ones stay visible."""
    rows = files.select(F.explode(C.ancestors(F.col("category"))).alias("node")).groupBy("node").agg(F.count("*").alias("files"))
    parts = F.split("node", " > ")
    parent = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ")
    return rows.select("node", parent.alias("parent"), F.size(parts).alias("depth"), "files", F.round(F.cbrt("files"), 6).alias("value"))


def unwrapped(files: DataFrame, most: int = 5) -> DataFrame:
    """files without the first parts of their categories that all of them share, as long as something is left of each."""
    parts = F.split("category", " > ")
    n = [F.countDistinct(F.get(parts, F.lit(k))).alias(f"n{k}") for k in range(most)]
    row = files.agg(*n, F.min(F.size(parts)).alias("shortest")).first()
    skip = 0
    while skip < most and row[f"n{skip}"] == 1 and row["shortest"] > skip + 1:
        skip += 1
    return files.withColumn("category", F.array_join(F.slice(parts, F.lit(skip + 1), F.size(parts)), " > ")) if skip else files


def damped(files: DataFrame) -> DataFrame:
    """(node, parent, depth, files, value): as values, but summed up from below: a category's own files count by their cube
    root where it has siblings, so that every node is as large as what is drawn in it; shared first parts are left out."""
    rows = unwrapped(files)
    own = rows.groupBy("category").agg(F.count("*").alias("n"))
    parts = F.split("category", " > ")
    parent = lambda c: F.array_join(F.slice(F.split(c, " > "), F.lit(1), F.size(F.split(c, " > ")) - 1), " > ")
    nodes = own.select(F.explode(C.ancestors(F.col("category"))).alias("node")).distinct().withColumn("parent", parent("node"))
    siblings = nodes.groupBy("parent").agg(F.count("*").alias("siblings"))
    drawn = own.withColumn("parent", parent("category")).join(siblings, "parent")
    value = F.when(F.col("siblings") >= 2, F.cbrt("n")).otherwise(F.col("n").cast("double"))
    up = drawn.select("n", value.alias("v"), F.explode(C.ancestors(F.array_join(parts, " > "))).alias("node"))
    return up.groupBy("node").agg(F.sum("n").alias("files"), F.round(F.sum("v"), 6).alias("value")).select(
        "node", parent("node").alias("parent"), F.size(F.split("node", " > ")).alias("depth"), "files", "value"
    )


def _worst(row: list[float], side: float) -> float:
    total = sum(row)
    return max(max(side * side * v / total**2, total**2 / (side * side * v)) for v in row)


def squarify(sizes: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Rectangles of the given areas (scaled to fit), in their order, laid in rows of the best aspect ratio."""
    total = sum(sizes)
    if not sizes or total <= 0 or w <= 0 or h <= 0:
        return [(x, y, 0.0, 0.0)] * len(sizes)
    areas = [s * w * h / total for s in sizes]
    out: list[tuple[float, float, float, float]] = []
    at = 0
    while at < len(areas):
        side, end = min(w, h), at + 1
        while end < len(areas) and _worst(areas[at : end + 1], side) <= _worst(areas[at:end], side):
            end += 1
        row, band = areas[at:end], sum(areas[at:end])
        along = 0.0
        for a in row:
            if w >= h:
                out.append((x, y + along, band / h, a / band * h))
                along += a / band * h
            else:
                out.append((x + along, y, a / band * w, band / w))
                along += a / band * w
        if w >= h:
            x, w = x + band / h, w - band / h
        else:
            y, h = y + band / w, h - band / w
        at = end
    return out


def layout(nodes: DataFrame, width: float, height: float, depths: int) -> DataFrame:
    """(node, depth, x, y, w, h): level by level, the children of a node inside it, each parent on its own."""
    schema = "node string, depth int, x double, y double, w double, h double"

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["value", "node"], ascending=[False, True])
        px, py, pw, ph = frame[["px", "py", "pw", "ph"]].iloc[0]
        pad = min(2.0, 0.02 * min(pw, ph))
        boxes = squarify(frame["value"].tolist(), px + pad, py + pad, max(0.0, pw - 2 * pad), max(0.0, ph - 2 * pad))
        return pd.DataFrame([(n, d, *(round(v, 4) for v in b)) for n, d, b in zip(frame["node"], frame["depth"], boxes)], columns=["node", "depth", "x", "y", "w", "h"])

    parents = nodes.sparkSession.createDataFrame([("", 0.0, 0.0, width, height)], "parent string, px double, py double, pw double, ph double")
    out = None
    for depth in range(1, depths + 1):
        level = nodes.where(F.col("depth") == depth).join(parents, "parent").groupBy("parent").applyInPandas(place, schema)
        out = level if out is None else out.unionByName(level)
        parents = level.select(F.col("node").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("w").alias("pw"), F.col("h").alias("ph"))
    return out


def depth_at(scale: Column) -> Column:
    """Levels to show at a zoom, from 2 to 10."""
    return F.greatest(F.lit(2), F.least(F.lit(10), (F.floor(F.log2(scale)) + 3).cast("int")))


def hit(boxes: DataFrame, x: float, y: float) -> DataFrame:
    """The deepest rectangle that holds a point."""
    inside = (F.col("x") <= x) & (F.col("x") + F.col("w") > x) & (F.col("y") <= y) & (F.col("y") + F.col("h") > y)
    return boxes.where(inside).orderBy(F.desc("depth"), "node").limit(1)
