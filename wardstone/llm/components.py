"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrowed, stored

EDGES = "u long, v long"


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step over some n edges, stored: every node's neighbours (greater ones, or itself and lesser ones) move to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = stored(narrowed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n), "star-least")
    joined = both.join(least, "u")
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return stored(narrowed(narrowed(moved.where("u <> v"), n).distinct(), n), "star-large" if large else "star-small")


def _stars(edges: DataFrame, n: int) -> bool:
    """Whether edges from each u to a lesser v are stars: every u has one edge, and no v is another edge's u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return narrowed(nodes.where("up > 1 OR (up = 1 AND down = 1)"), n).agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every linked node but the roots; root is the least node that links reach.

    links: columns u and v (long, not null, u <> v), in any direction and repeated at will; they are
    counted first. Large-star and small-star steps in turn until the edges are stars, which a
    further round would leave as they are; each step is written to the shared folder, in as many
    tasks as the edges need. A node with very many links is only ever a key of a minimum and of a join.
    """
    n = links.count()
    edges = stored(narrowed(links.select("u", "v").where("u <> v").distinct(), n), "links")
    while True:
        edges = _star(_star(edges, True, n), False, n)
        if _stars(edges, n):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
