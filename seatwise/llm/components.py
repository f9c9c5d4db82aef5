"""Connected components of an edge table by alternating large-star and small-star contraction.

O(log n) rounds whatever the shape (a chain of n edges included), no cap on rounds. Each round is
written to the shared checkpoint folder, so lineage stays short and a lost executor only repeats
one round; the round before it is deleted once its successor is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seatwise.session import drop_scratch, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component = smallest node reachable.

    Null ends and self-loops carry no link and are ignored; repeated edges count once; an empty
    table gives an empty result.
    """
    e = (edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct())
    cur, path = materialise(e, "components")
    while not _is_star_forest(cur):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("u"), F.least("m", "a").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        nxt = (small.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
               .unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        done, done_path = materialise(nxt, "components")
        drop_scratch(cur.sparkSession, path)
        cur, path = done, done_path
    roots = cur.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _is_star_forest(e: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent: nothing is left to contract."""
    marks = (e.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
             .unionByName(e.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
             .groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down")))
    return marks.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count() == 0
