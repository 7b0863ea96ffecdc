"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """node, class (the least node of its component) for each node of edges (a, b).

    Each pass points every node at the one of least hash among itself and its neighbours, renames nodes and edges by what
    they point at, and drops edges within a class: a constant share of the nodes goes in each pass, of stars and dense groups all
    but one. Every pass is cut off by a stored table, and labels follow all passes in the end.
    """
    edges = common.materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
    both = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    passes = []
    while not edges.isEmpty():
        around = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        points = around.groupBy("node").agg(F.min(F.struct(F.xxhash64("to").alias("h"), "to")).alias("m"))
        points = points.select("node", F.when(F.col("m.h") < F.xxhash64("node"), F.col("m.to")).otherwise(F.col("node")).alias("to"))
        passes.append(common.materialise(points, "points"))
        from_a, from_b = passes[-1].select(F.col("node").alias("a"), F.col("to").alias("p")), passes[-1].select(F.col("node").alias("b"), F.col("to").alias("q"))
        renamed = edges.join(from_a, "a").join(from_b, "b")
        edges = common.materialise(renamed.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("p != q").distinct(), "edges")
    labels = both.select("node", F.col("node").alias("class"))
    for points in passes:
        labels = labels.join(points.select(F.col("node").alias("class"), "to"), "class", "left").select("node", F.coalesce("to", "class").alias("class"))
    labels = common.materialise(labels, "labels")
    least = labels.groupBy("class").agg(F.min("node").alias("least"))
    return common.materialise(labels.join(least, "class").select("node", F.col("least").alias("class")), "components")
