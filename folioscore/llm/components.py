"""Connected components of links between nodes, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscore.session import workspace


def connected_components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``), the root being the least node.

    In every round each node goes over to its least neighbour, if that is less than itself, and
    links are drawn anew between where their ends went; links within one node are dropped and
    equal ones become one. So a node with very many links costs its links once. Few rounds are
    needed where names are not in the order of long chains (here they are hashes). The rounds are
    written to the shared folder; the driver only asks whether links are left.
    """
    spark = links.sparkSession

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = workspace(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    left = kept(
        links.filter("a is not null and b is not null").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ).distinct(),
        "links",
    )
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    went = kept(ends.withColumn("at", F.col("node")), "roots")
    while not left.isEmpty():
        # neighbours are less on one side only: the least of b for a, and b itself where it is least
        steps = left.filter("a <> b").groupBy("a").agg(F.min("b").alias("to"))
        steps = kept(steps, "steps")
        there = steps.select(F.col("a").alias("_from"), F.col("to").alias("_to"))
        went = kept(
            went.join(there, F.col("at") == F.col("_from"), "left").select(
                "node", F.coalesce("_to", "at").alias("at")
            ),
            "roots",
        )
        ahead = left.join(there, F.col("a") == F.col("_from")).select(F.col("_to").alias("a"), "b")
        both = ahead.join(there, F.col("b") == F.col("_from"), "left").select(
            "a", F.coalesce("_to", "b").alias("b")
        )
        left = kept(
            both.filter("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            "links",
        )
    return _least_names(went)


def _least_names(went: DataFrame) -> DataFrame:
    names = went.groupBy("at").agg(F.min("node").alias("root"))
    return went.join(names, "at").select("node", "root")
