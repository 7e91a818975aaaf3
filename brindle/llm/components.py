"""Connected components by minimum labels, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import growing, release, table


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of ``edges`` (a, b) reaches. ``rows`` bounds the number of edges.

    Alternating large-star and small-star steps: edges are rewired towards
    smaller neighbours until each component is a star, in O(log^2 n) rounds. The
    minimum over a vertex' neighbours is a partial aggregate, so a vertex with
    very many links is no hot spot; the join that rewires its edges is a plain
    equi-join whose skew Spark may split.
    """
    now = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", rows)
    while True:
        # Neither step makes more edges than there were.
        rows = now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a vertex link to its smallest neighbour.
        large = both.where("b > a").join(growing(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = table(large, "edges", rows)
        # Small star: a vertex and its neighbours below link to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(growing(low), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = table(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges", 2 * rows)
        release(large)
        # Done once no edge has changed: every vertex above links to its component's smallest alone.
        stands = new.join(growing(now), ["a", "b"], "left_anti").isEmpty() and now.join(growing(new), ["a", "b"], "left_anti").isEmpty()
        release(now)
        now = new
        if stands:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
