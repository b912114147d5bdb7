"""Connected components over edges, by least labels that travel along edges and along themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (``a, b``); ``label`` is the least node that can be reached.

    Each round gives a node the least label among its neighbours, and then the label of its label, so that the rounds
    grow with the logarithm of the longest path. Labels are written in every round; nothing of them is collected.
    """
    there = edges.select("a", "b").where("a <> b")
    links = written(there.union(there.select("b", "a")).distinct(), "links")
    labels = written(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = written(
            labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old")),
            "labels",
        )
        further = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = written(
            step.join(further, "label").select("node", F.least("label", "further").alias("label"), "old"), "labels"
        )
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def joined_components(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` (``node, label``, as ``components`` gives them) after further ``edges``; only their labels are worked on."""
    ends = [classes.select(F.col("node").alias(x), F.col("label").alias(f"l{x}")) for x in ("a", "b")]
    named = edges.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left")
    named = named.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    moved = components(named.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    new = named.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node", "left_anti")
    every = classes.union(new.select("node", F.col("node").alias("label")))
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return written(every.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "classes")
