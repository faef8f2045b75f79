"""Connected components as Spark jobs: smallest labels spread over edges, with pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.plans.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``a, b`` edges; a component is named by its smallest node.

    Nodes without a greater neighbour only hang on their smallest one. They are set aside, and their
    other edges become edges between their neighbours, of which few are different where many nodes
    hang on the same few.
    """
    down = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    least = staged(down.groupBy("hi").agg(F.min("lo").alias("m")))
    inner = staged(down.select(F.col("lo").alias("node")).distinct())
    across = down.join(least, "hi").where("lo <> m").select(F.col("lo").alias("a"), F.col("m").alias("b"))
    between = least.join(inner.withColumnRenamed("node", "hi"), "hi", "left_semi").select(F.col("hi").alias("a"), F.col("m").alias("b"))
    labels = spread_labels(across.unionByName(between).distinct())
    kept = inner.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    hanging = (
        least.join(inner.withColumnRenamed("node", "hi"), "hi", "left_anti")
        .join(labels.withColumnRenamed("node", "m"), "m", "left")
        .select(F.col("hi").alias("node"), F.coalesce("component", "m").alias("component"))
    )
    return kept.unionByName(hanging)


def spread_labels(edges: DataFrame) -> DataFrame:
    """``node, component`` of distinct ``a, b`` edges.

    Each round a node takes the smallest label among its neighbours' and then that label's label, so
    the rounds grow with the logarithm of a component's width. Every round is a written table, and
    only whether something changed reaches the driver.
    """
    both = staged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = staged(both.groupBy("a").agg(F.min("b").alias("_m")).select(
        F.col("a").alias("node"), F.least("a", "_m").alias("component")
    ))
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy("a")
            .agg(F.min("component").alias("_near"))
            .withColumnRenamed("a", "node")
        )
        spread = labels.join(near, "node").select(
            "node", F.col("component").alias("_old"), F.least("component", "_near").alias("_to")
        )
        far = labels.select(F.col("node").alias("_to"), F.col("component").alias("_far"))
        new = staged(spread.join(far, "_to").select("node", "_old", F.least("_to", "_far").alias("component")))
        changed = new.where("_old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
