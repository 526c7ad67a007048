"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import release, settle


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Per node the least of itself and its neighbours; aggregated before the shuffle, so hubs do no harm."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of the undirected ``edges`` (BIGINT columns ``a``, ``b``); a component is named
    by its least node. Rows with a null end are left out; loops make single-node components. Raises if ``max_rounds``
    do not suffice (the steps need a logarithmic number)."""
    pairs = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter(F.col("u").isNotNull() & F.col("v").isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    links = settle(pairs.filter("u <> v").distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbour(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v").distinct()
        least = _least_neighbour(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
        before, links = links, settle(small.filter("u <> v").distinct(), "links")
        release(before)
        # The steps leave a set of stars unchanged: then every node points straight at its least one.
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            labels = links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
            return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        state = now
    raise RuntimeError(f"no fixed point within {max_rounds} rounds")
