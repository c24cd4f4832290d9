"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node of each component, for every node of the edges (a, b); loops and repeats are fine.

    Each round every label takes its smallest neighbouring label and follows such choices to their end, doubling the
    steps, so chains of any length collapse; edges between equal labels go. At least half of the labels that still have
    edges go each round. Rounds are cut by checkpoints."""
    left = C.checkpointed(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = C.checkpointed(left.select(F.col("a").alias("node")).union(left.select("b")).distinct().withColumn("comp", F.col("node")))
    while not left.isEmpty():
        both = left.union(left.select("b", "a")).toDF("x", "y")
        step = C.checkpointed(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("to")))
        moving = True
        while moving:
            far = step.select(F.col("x").alias("to"), F.col("to").alias("next"))
            ahead = C.checkpointed(step.join(far, "to").select("x", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            step, moving = ahead.select("x", "to"), not ahead.filter("moved").isEmpty()
        move = lambda df, c: df.join(step.select(F.col("x").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")  # noqa: E731, B023
        labels = C.checkpointed(move(labels, "comp"))
        moved = move(move(left, "a"), "b")
        left = C.checkpointed(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    return labels
