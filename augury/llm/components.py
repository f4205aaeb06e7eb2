"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from augury.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node each node of links(a, b) reaches.

    Every round a node takes the smallest label around it and then the label of that label, so rounds
    grow with the logarithm of a component's width.  Rows only; nothing passes through the driver but
    the number of changed labels."""
    both = written(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labels = written(labels.select("node", F.least("node", "low").alias("root")), "labels")
    while True:
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        nearer = labels.join(heard, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        step = nearer.join(jump, "root").select("node", "old", F.least("root", "next").alias("root"))
        after = written(step, "labels")
        if after.where(F.col("old") != F.col("root")).limit(1).count() == 0:
            return after.select("node", "root")
        labels = after.select("node", "root")
