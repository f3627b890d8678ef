"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _settled(edges: DataFrame) -> bool:
    """True if every node hangs on one root and no root hangs on another."""
    several = edges.groupBy("hi").agg(F.min("lo").alias("a"), F.max("lo").alias("b")).filter("a < b").select("hi")
    chained = edges.select(F.col("lo").alias("hi")).join(edges.select("hi"), "hi", "left_semi")
    return several.unionByName(chained).isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with a link to another; the component is its smallest node.

    Alternating large and small stars: each round hangs neighbours on the smallest node in reach, and is written to the shared folder.
    Partial minima are taken before each shuffle; in the joins AQE splits the links of a node with very many.
    Null ends and links from a node to itself are left out.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo")))
    edges = cut(edges.distinct(), "links")
    while not _settled(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = cut(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def local_roots(n: int, left, right):
    """Component number (its smallest member) of 0..n-1 under the links ``left[i]`` - ``right[i]``, in numpy."""
    import numpy as np

    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:  # pointers to their ends
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root
