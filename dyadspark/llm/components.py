"""Connected components of a link table, by rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dyadspark.session import materialise, reads, release


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes of the links (a, b); the label is the smallest node of the component.

    Every round takes the smallest label among a node's neighbours and then the label of its label, so paths halve. Each
    round's labels are written, which ends the lineage there; those of the round before are deleted. The result may be released.
    """
    both = materialise(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
            "node", F.least("node", "least").alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        new = materialise(
            step.join(up, F.col("label") == F.col("parent")).select("node", "old", F.col("above").alias("label")))
        release(labels)
        labels = reads(new.select("node", "label"), new)
        if new.where(F.col("old") != F.col("label")).isEmpty():
            release(both)
            return labels
