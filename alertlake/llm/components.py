"""Connected components by repeated contraction of edges.

In each round every node points at the neighbour (or itself) with the least hash of that
round, and each edge is replaced by the edge between the nodes its ends point at. A constant
share of the nodes goes in each round whatever the shape of the graph, so a long chain takes
O(log n) rounds too. Hubs are harmless: minima are combined before the shuffle, and the
joins are plain equi-joins whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.shared import cut, remove


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, label): nodes have the same label iff a path joins them.

    Every node of an edge is returned once. Null ends and loops are ignored; repeated and
    reversed edges count once; no edges give no rows.
    """
    spark = edges.sparkSession
    live = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps = []
    for k in range(max_rounds):
        if live.isEmpty():
            break
        both = live.union(live.select("b", "a")).toDF("node", "other")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("id"))
        to = cut(both.groupBy("node").agg(F.min(order("other")).alias("m")).select("node", F.least("m", order("node")).getField("id").alias("to")), "points")
        maps.append(to)
        left, right = to.toDF("a", "a_to"), to.toDF("b", "b_to")
        nxt = live.join(left, "a").join(right, "b").where("a_to <> b_to").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        nxt = cut(nxt, "edges")
        remove(spark, live)
        live = nxt
    else:
        raise RuntimeError("components did not settle")
    if not maps:
        return edges.where("false").select(F.col("a").alias("node"), F.col("a").alias("label"))
    labels = maps[0].toDF("node", "label")
    for to in maps[1:]:
        labels = labels.join(to.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels
