"""Several catalogs for one source: candidates of all children, merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge(children: list[DataFrame], top_n: int) -> DataFrame:
    """children: candidates (s_ord, group_code, score) in frozen order.

    A code keeps its best score, ties to the earlier child; then the best
    top_n by score, ties by code. Adds child and rank.
    """
    d = None
    for i, c in enumerate(children):
        x = c.withColumn("child", F.lit(i))
        d = x if d is None else d.unionByName(x, allowMissingColumns=True)
    best = Window.partitionBy("s_ord", "group_code").orderBy(F.col("score").desc(), "child")
    d = d.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    w = Window.partitionBy("s_ord").orderBy(F.col("score").desc(), "group_code")
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
