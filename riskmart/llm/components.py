"""Connected components of an edge table, as written tables step by step."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources import shared_dir


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to a new table of the shared folder and read it back; what follows carries no lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def groups_for(df: DataFrame, group_bytes: int) -> int:
    """How many groups of about ``group_bytes`` the input makes, by Spark's own estimate of its size; the shuffle partitions where it has none.

    It sizes groups only; results do not depend on it.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 60:  # Spark's mark for unknown
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // group_bytes))


def components(spark: SparkSession, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``links`` (a, b) and of ``known``, an earlier result; a component is its least node.

    Links first lead between earlier components. Each round gives a node the least label next to it and then the label of
    that label, so long chains halve; rounds end when nothing changes.
    """
    edges = links.select("a", "b")
    if known is not None:
        for c in ("a", "b"):
            names = known.select(F.col("node").alias(c), F.col("component").alias("to"))
            edges = edges.join(names, c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = store(both.distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("component").alias("old"), F.least("component", "least").alias("via")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        stepped = lower.join(jump, "via").select("node", "old", F.least("via", "far").alias("component"))
        stepped = store(stepped, "labels")
        labels = stepped.select("node", "component")
        if stepped.filter("component <> old").isEmpty():
            break
    if known is None:
        return labels
    moved = labels.select(F.col("node").alias("component"), F.col("component").alias("to"))
    renamed = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return store(renamed.unionByName(labels.join(known, "node", "left_anti")), "labels")
