"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metergrid.llm.common import Scratch


def connected_components(links: DataFrame, tmp: Scratch, most: int = 60) -> DataFrame:
    """links(a, b) -> (id, component): the smallest id that can be reached from each linked id; a table of `tmp`.

    Alternates the large-star and small-star steps, which end in stars around the smallest ids after a number of
    rounds in the order of log(n) squared. A round aggregates (map-side first) and joins; its links are written to
    the shared folder, and those of the round before deleted. Nothing is gathered on the driver but a count and a
    checksum of each round."""
    links = tmp.written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    state = None
    for _ in range(most):
        before, links = links, tmp.written(_small_star(_large_star(links)), "links")
        tmp.drop(before)
        found = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = tmp.written(links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), "components")
    tmp.drop(links)
    return out


def _large_star(links: DataFrame) -> DataFrame:
    """Links every larger neighbour of an id with the smallest of its neighbours and itself."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Links every smaller neighbour of an id, and itself, with the smallest of them."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
