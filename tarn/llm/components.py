"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import common


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node links to one lesser node that links to none itself."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    node = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not node.where(F.col("up") + F.col("down") > 1).agg(F.count("*")).first()[0]


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b); label is the component's least node.

    Alternating large-star and small-star steps: each links the neighbours of
    a node to the least of them, so that every component ends as a star, which
    one grouping confirms. The least neighbours are grouped before they are
    shuffled and written before they are joined, so that a join is one of two
    plain exchanges and adaptive execution splits the links of a large star.
    Each round is written to the shared folder; only a count reaches the driver.
    """
    edges = common.materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        # One row for each link, all of which now point to a lesser node.
        large = common.materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        second = common.materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        ends = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = common.materialize(large.join(second, "u").select(ends).select("e.*").where("u <> v").distinct(), "links")
        for used in (least, large, second):
            common.discard(used)
        common.discard(edges)
        edges = after
        if _is_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
