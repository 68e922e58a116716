"""Connected components of a graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchwork.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of undirected edges (a, b): label is the component's least node.

    Each round gives a node the least label among its neighbours and then that
    label's own label, so paths shorten by half. Labels are written to the
    checkpoint folder in every round: lineage stays short, and both sides of
    each join come from an exchange of their own, so that adaptive execution
    can split the rows of a node with very many edges. Minima are combined
    before they are shuffled.
    """
    both = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where(F.col("node") != F.col("other")).distinct())
    labels = cut(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("seen"))
        hooked = cut(labels.join(seen, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "seen").alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = cut(hooked.join(jump, "label", "left").select("node", "was", F.coalesce("next", "label").alias("label")))
        if labels.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
