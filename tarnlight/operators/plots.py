"""Tables behind the plots: hexagons, class sizes, colours and point styles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hexagons across, and classes that a legend names.
GRID, LEGEND = 50, 30
#: Steps of the colour parts from label to label, each without a factor in common with 255.
STEPS = (97, 58, 203)


def hexbin(points: DataFrame, grid: int = GRID) -> DataFrame:
    """(cx, cy, n): points by the nearest centre of two interleaved lattices; empty hexagons give no row."""
    rows = int(grid / math.sqrt(3))
    s = points.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])
    at = points.join(F.broadcast(s))  # one row is broadcast
    step = lambda c, n: (F.col(f"max_{c}") - F.col(f"min_{c}")) / n
    at = at.withColumns({"sx": step("x", grid), "sy": step("y", rows)})
    at = at.withColumns({f"i{c}": F.when(F.col(f"s{c}") > 0, (F.col(c) - F.col(f"min_{c}")) / F.col(f"s{c}")).otherwise(F.lit(0.0)) for c in "xy"})
    near = {f"a{c}": F.rint(f"i{c}") for c in "xy"} | {f"b{c}": F.floor(f"i{c}") + 0.5 for c in "xy"}
    at = at.withColumns(near)
    d = lambda p: (F.col("ix") - F.col(f"{p}x")) ** 2 + 3 * (F.col("iy") - F.col(f"{p}y")) ** 2
    first = d("a") < d("b")
    centre = lambda c: (F.when(first, F.col(f"a{c}")).otherwise(F.col(f"b{c}")) * F.col(f"s{c}") + F.col(f"min_{c}")).alias(f"c{c}")
    return at.select(centre("x"), centre("y")).groupBy("cx", "cy").agg(F.count("*").alias("n"))


def class_sizes(labels: DataFrame, column: str) -> DataFrame:
    """(label, n) by label as text."""
    return labels.groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("n"))


def top_classes(labels: DataFrame, column: str, most: int = LEGEND) -> DataFrame:
    """The ``most`` largest classes, ties by label."""
    return class_sizes(labels, column).orderBy(F.desc("n"), "label").limit(most)


def colours(labels: DataFrame, column: str, seed: int = 1) -> DataFrame:
    """(label, r, g, b) with each part in 0 .. 254, steps of the label's number in sorted order; noise (-1) is black."""
    part = lambda step: F.when(F.col("label") == "-1", 0).otherwise((F.col("k") + seed) * step % 255).cast("int")
    return sorted_labels(labels, column).select("label", *[part(s).alias(c) for c, s in zip("rgb", STEPS, strict=True)])


def point_styles(labels: DataFrame, column: str) -> DataFrame:
    """``labels`` with the point size and whether markers have an edge, by the number of rows; noise is drawn smaller."""
    n = labels.agg(F.count("*").alias("_n"))
    at = labels.join(F.broadcast(n))  # one row is broadcast
    size = F.when(F.col("_n") > 10_000, 1.5).when(F.col("_n") > 1_000, 3.0).otherwise(7.0)
    noise = F.col(column).cast("string") == "-1"
    return at.withColumn("size", F.when(noise, size).otherwise(2 * size)).withColumn("edge", F.col("_n") <= 10_000).drop("_n")


def split_noise(labels: DataFrame, column: str) -> DataFrame:
    """``labels`` with noise (whether the class is -1) and layer, its drawing order: noise lies under the classes."""
    noise = F.coalesce(F.col(column).cast("string") == "-1", F.lit(False))
    return labels.withColumn("noise", noise).withColumn("layer", F.when(noise, 0).otherwise(1))


def plot_table(points: DataFrame, nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(id, name, x, y, cluster, r, g, b): all that a scatter plot needs."""
    at = points.join(nodes, "id").join(clusters, "id")
    shade = colours(clusters, "cluster").withColumnRenamed("label", "_label")
    return at.join(shade, F.col("cluster").cast("string") == F.col("_label")).drop("_label")


def sorted_labels(labels: DataFrame, column: str) -> DataFrame:
    """(label, k): distinct labels as text, numbered in ascending order; labels are few, as a legend's are."""
    from pyspark.sql import Window as W

    return labels.select(F.col(column).cast("string").alias("label")).distinct().withColumn("k", F.row_number().over(W.orderBy("label")))


def eq_prefixes(series: DataFrame) -> DataFrame:
    """(frame, step, eq): for each frame of a series (step, eq) all steps up to it, as the animation draws them.

    The output is half the square of the number of frames, which the schedule bounds at 401.
    """
    frames = series.select(F.col("step").alias("frame"))
    return frames.join(series, F.col("step") <= F.col("frame")).select("frame", "step", "eq")
