"""Connected components of a link table too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.session import store


def _hung_on_least(links: DataFrame) -> DataFrame:
    """Every u with its neighbours v gives (v, least of u and all v) where that is another node.

    The leasts are stored first, so both sides of the join are plain shuffles and adaptive
    execution can split a node with very many neighbours.
    """
    least = store(links.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low")))
    return links.join(least, "u").select("u", "v", "low")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with a link; a component is named by its least node.

    Alternates large-star and small-star steps until the links are stars around their least
    node and no longer change. Each round is stored in the shared folder, which cuts the
    lineage; only a count and a checksum come to the driver. Rounds grow with the logarithm of
    the longest chain. Nulls and self-links are dropped, repeats are one link.
    """
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).dropna().where("u <> v").distinct()
    now = store(now)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hung_on_least(both).where("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = store(large)
        small = _hung_on_least(large)
        small = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            small.select("u", F.col("low").alias("v")))
        now = store(small.distinct())
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
