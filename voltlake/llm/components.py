"""Connected components of a graph given as edges, by alternating star contraction.

No node's neighbours are ever gathered: each step takes minima per node, which combine
before the shuffle, and joins them back, which Spark splits where a node is hot.
"""

from pyspark.sql import DataFrame, functions as F

from voltlake.session import settle


def _pointed(edges: DataFrame) -> DataFrame:
    """Edges once each, from the larger to the smaller node."""
    return edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).filter("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    inner = edges.join(least, "u").filter("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return inner.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """Tells whether a set of edges has changed; one row."""
    both = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(both), F.sum(F.shiftright(both, 20))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; a component is its smallest node.

    ``edges`` has columns u and v; direction, repeats and loops do not matter. The edges
    shrink to one star per component in about as many rounds as the logarithm of the
    longest path; each round's edges are written to the shared folder.
    """
    now = settle(_pointed(edges).distinct(), "edges")
    seen = _print(now)
    while True:
        now = settle(_small_star(_large_star(now)), "edges")
        if seen == (seen := _print(now)):
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots)
