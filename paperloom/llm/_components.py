"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each endpoint of ``edges`` (a, b) reaches.

    Each round takes the least label of a node's neighbours and then that label's own label
    twice, so paths shrink by a factor every round.  Nothing is collected but the count of
    changed labels.  Every join has a side with unique keys, and AQE may split the other, so
    a node with very many edges is no bottleneck.
    """
    e = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = written(labels)
    while True:
        near = e.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        for _ in range(2):
            up = new.select(F.col("node").alias("label"), F.col("label").alias("up"))
            new = new.join(up, "label").select("node", "old", F.col("up").alias("label"))
        new = written(new)
        if new.where("old <> label").limit(1).count() == 0:
            return new.select("node", "label")
        labels = new.select("node", "label")
