"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stage


def _towards_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step over edges (src, dst).

    Every vertex learns the least vertex next to it.  With ``larger_only`` its larger
    neighbours are linked to that least one; otherwise it and its smaller neighbours are.
    The least neighbour is a pre-aggregated minimum, so a hub costs one row for each task.  It
    is written before it is joined back to the edges: adaptive execution can split a join of
    two plain tables at a hub, but not one whose other side is still grouped by the key.
    """
    if larger_only:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        both = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = both.groupBy("src").agg(F.min("dst").alias("least"))
    least = stage(least.select("src", F.least("src", "least").alias("least")), "least")
    linked = both.join(least, "src")
    if larger_only:
        out = linked.where("dst > src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
    else:
        out = linked.select(F.col("dst").alias("src"), F.col("least").alias("dst")).unionByName(
            least.select("src", F.col("least").alias("dst"))
        )
    return out.where("src <> dst").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(vertex, root) for every vertex with an edge; the root is the least vertex reachable.

    ``edges`` has columns src and dst (long).  Large and small stars alternate until the
    edges stand still, which takes a number of rounds that grows with the logarithm of the
    vertices; each round's edges are written to the shared folder.  Vertices that are their
    own root are left out.  No edges give no rows.
    """
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    current = stage(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    seen = mark(current)
    while True:
        current = stage(_towards_least(_towards_least(current, True), False), "edges")
        now = mark(current)
        if now == seen:
            return current.select(F.col("src").alias("vertex"), F.col("dst").alias("root"))
        seen = now
