"""Connected components of links between numbered things."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.sources.store import written


def connected(links: DataFrame) -> DataFrame:
    """node and label, the least node that it reaches, of all nodes in links (a, b); null ends count for nothing.

    In every turn a node takes the least label among its neighbours and then the label of its label, so turns grow with the
    logarithm of the longest chain. Labels are grouped with partial minima, so that a node with very many links is no single task's
    work but in the joins, which Spark splits. Each turn's labels are a table.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        now = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("label", "near").alias("low"), "label")
        up = now.select(F.col("node").alias("of"), F.col("low").alias("higher"))
        now = written(now.join(up, F.col("low") == F.col("of"), "left").select("node", F.least("low", "higher").alias("low"), "label"), "labels")
        if now.where("low <> label").isEmpty():
            return labels
        labels = now.select("node", F.col("low").alias("label"))
