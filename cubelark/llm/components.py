"""Connected components by alternating large and small stars.

Every round is two aggregations and two joins over the edges; it halves the distances to the smallest
node of a component, so that a few rounds do. Rounds are written to the shared folder. Hubs are
split by partial aggregation and by the skew handling of joins; nothing comes to the driver but a
checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubelark.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of all nodes of ``src, dst``: the smallest node that each reaches.

    Loops, repeated and reversed edges count once; nulls are no nodes; no edges give no rows.
    """
    edges = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
        # large star: all larger neighbours of a node go to the smallest of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        dropped(last)
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
