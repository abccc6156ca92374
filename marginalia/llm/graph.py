"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.llm.util import discard, settle, spread_join


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, label), a settled table: label is the least node of the component.

    Each round points every node to its least neighbour, if that is less, follows the pointers to their ends (twice as far with each join), and
    goes on with the edges between different ends. A group of copies that all point to one node is done in one round; the number of rounds
    and joins grows with the logarithm of the longest path. A node of very many edges is pre-aggregated where it is the group and dealt to many
    places where it is the join key.
    """
    edges = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")), "ends")
        moved = True
        while moved:
            further = ends.select(F.col("node").alias("label"), F.col("label").alias("end"))
            after = settle(spread_join(ends, further, "label", "node").select("node", F.col("label").alias("old"), F.col("end").alias("label")), "ends")
            moved = not after.where("old <> label").isEmpty()
            discard(ends)
            ends = after
        if labels is None:
            labels = settle(ends.select("node", "label"), "labels")
        else:
            renamed = ends.select(F.col("node").alias("label"), F.col("label").alias("end"))
            before, labels = labels, settle(spread_join(labels, renamed, "label", "node", "left").select("node", F.coalesce("end", "label").alias("label")), "labels")
            discard(before)
        low, high = (ends.select(F.col("node").alias(k), F.col("label").alias(f"end_{k}")) for k in "ab")
        joined = spread_join(spread_join(edges, low, "a", "b"), high, "b", "a").where("end_a <> end_b")
        before, edges = edges, settle(joined.select(F.least("end_a", "end_b").alias("a"), F.greatest("end_a", "end_b").alias("b")).distinct(), "edges")
        discard(before, ends)
        if edges.isEmpty():
            return labels
