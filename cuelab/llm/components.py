"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise


def _star_large(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbourhood."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    found = both.where("v > u").join(least.hint("merge"), "u")
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _star_small(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    found = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for every node of ``links`` (columns ``u``, ``v``, whole numbers).

    Links to itself, repeated ones and either direction are fine; links with a null end are left out.
    Rounds of two joins each, as many as the logarithm of the longest way; every round is written to
    the shared folder. No component is gathered anywhere.
    """
    links = materialise(links.select("u", "v").where("u <> v").distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
        if not state[0]:
            break
        links = materialise(_star_small(_star_large(links)), "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
