"""Connected components of an edge table, by least labels with pointer jumping.

Labels are written to the shared folder after every round, so lineage stays short and
a lost executor costs at most a round. Nothing but a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, comp) for every node of ``edges`` (long columns a, b); comp: the least node that it is linked to, however far.

    Repeated edges and loops do no harm. An empty table gives no rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    both.where("a <> b").distinct().write.parquet(f"{folder}/links")
    links = spark.read.parquet(f"{folder}/links")
    labels, turn = links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), 0
    while True:
        labels.write.parquet(f"{folder}/labels-{turn}")
        labels = spark.read.parquet(f"{folder}/labels-{turn}")
        if turn and not labels.where("moved").limit(1).count():
            return labels.select("node", "comp")
        own = labels.select("node", "comp")
        # the least label of a node's neighbours, and that of its label's own node
        near = links.join(own.select(F.col("node").alias("a"), "comp"), "a").groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        jump = own.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        labels = own.join(near, "node").join(jump, "comp").select("node", F.least("near", "far", "comp").alias("comp"), (F.least("near", "far") < F.col("comp")).alias("moved"))
        turn += 1
