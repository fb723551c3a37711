"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgauge.session import cut_and_count


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows by themselves, without what they were made from."""
    return cut_and_count(df)[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label among itself and its neighbours and then, twice, its
    label's label, so rounds grow with the logarithm of a chain's length. Minima are aggregated map-side; a
    node with very many links is only a sum over its rows.
    """
    links = cut_lineage(links.select("a", "b"))  # read twice below
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).select(
        F.col("a").alias("node"), F.least("a", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # the node that a label names takes the lower label as well
        named = lower.groupBy(F.col("old").alias("node")).agg(F.min("label").alias("named"))
        lower = lower.join(named, "node", "left").select(
            "node", "old", F.least("label", F.coalesce("named", "label")).alias("label"))
        lower = cut_lineage(lower)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = cut_lineage(lower.join(jump, "label", "left").select(
            "node", "old", F.coalesce("next", "label").alias("label")))
        labels = stepped.select("node", "label")
        if stepped.where("label <> old").isEmpty():
            return labels
