"""Connected components of a link table, as DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _digest(edges: DataFrame) -> tuple:
    """Number of rows and an order-free sum of their hashes: equal for equal tables."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 24)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(h)).first())


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (id, comp): each end of a link with its component's least id. Rows without links are not listed.

    Every round replaces links by stars: each id is tied to the least id it sees, and that one to all ids around.
    Lineage ends in a written table after each round; the number of rounds grows with the logarithm of the longest path.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = _digest(edges)
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to the least id around u
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: smaller neighbours of u, and u, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct(), "edges")
        before, seen = seen, _digest(edges)
        if seen == before:
            break
    stars = edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("id"), "comp")
    return stars.unionAll(stars.select(F.col("comp").alias("id"), "comp").distinct())
