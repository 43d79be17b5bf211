"""Connected components of a link table by alternating star contraction.

Every round points each node's neighbours at the smallest node it knows
(large star, then small star).  Links stay a distributed table, written to
the shared scratch folder after each half round; the joins read stored
tables on both sides, so AQE can split the partition of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compacted, stored


def _links(df: DataFrame) -> DataFrame:
    """``(hi, lo)`` distinct, larger node first, no loops."""
    return df.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")) \
        .where(F.col("hi") != F.col("lo")).distinct()


def _large_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour or itself."""
    least = stored(links.select(F.col("lo").alias("node"), F.col("lo").alias("m"))
                   .unionByName(links.select(F.col("hi").alias("node"), F.col("lo").alias("m")))
                   .groupBy("node").agg(F.min("m").alias("m")), "components-least", rows)
    return stored(_links(links.join(least, links["lo"] == least["node"])
                         .select(F.col("hi").alias("a"), F.col("m").alias("b"))), "components-large", rows)


def _small_star(links: DataFrame, rows: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = stored(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")), "components-least", rows)
    joined = links.join(least, links["hi"] == least["node"])
    return stored(_links(joined.select(F.col("lo").alias("a"), F.col("m").alias("b"))
                         .unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))),
                  "components-small", rows)


def _are_stars(links: DataFrame) -> bool:
    """No node has both larger and smaller neighbours, nor two smaller ones: each hangs on its smallest."""
    sides = links.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")) \
        .unionByName(links.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    bad = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")) \
        .where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))
    return bad.isEmpty()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link, ``component`` its smallest reachable node.

    Nodes without links don't appear.  Neither star adds links, so their
    number at the start bounds every table.
    """
    edges = compacted(_links(links.select(F.col(a).alias("a"), F.col(b).alias("b"))), "components-links")
    rows = edges.count()
    while not _are_stars(edges):
        edges = _small_star(_large_star(edges, rows), rows)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")) \
        .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
