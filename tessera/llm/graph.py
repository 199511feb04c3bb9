"""Connected components over DataFrames: smallest neighbour's label, then pointer jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, few


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of ``edges`` (a, b): label is the smallest vertex of its component.

    Each round hooks every vertex to the smallest label around it and then halves the paths of labels, so long chains take
    a number of rounds near the logarithm of their length.  Joins are plain equi-joins, which adaptive execution can split
    where a star's centre is hot; sums and minima combine before the shuffle.
    """
    edges = edges.where("a <> b")
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("new"))
        # a label is a vertex too: take over what that vertex was labelled with
        roots = labels.select(F.col("v").alias("new"), F.col("label").alias("above"))
        following = cut(hooked.join(roots, "new", "left").select("v", F.least("new", F.coalesce("above", "new")).alias("next"), "label"))
        moved = following.where("next <> label").limit(1).count()
        labels = following.select("v", F.col("next").alias("label"))
        if not moved:
            return labels


def components_by_leaders(rows: DataFrame) -> DataFrame:
    """(v, label) for rows (v, leader): v is connected with each of its leaders, and each leader has a row naming itself.

    A vertex goes with its smallest leader, and the graph is contracted to the leaders: of thousands of vertices with the same
    leaders one edge for each pair of (smallest, other) is left.
    """
    low = rows.groupBy("v").agg(F.min("leader").alias("low"))
    edges = rows.join(low, "v").where("low <> leader").select(F.col("low").alias("a"), F.col("leader").alias("b")).distinct()
    labels = components(edges).withColumnRenamed("v", "low")
    # thousands may share a smallest leader: where the labels are few, no task gets all of them
    return low.join(few(labels) or labels, "low", "left").select("v", F.coalesce("label", "low").alias("label"))
