"""Places and running sums in groups of any size: a group is cut into ranges, so no task holds it whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelab.workspace import materialise


def running(df: DataFrame, key: str, order: list[Column], sums: tuple[str, ...] = (), label: str = "ranges") -> DataFrame:
    """``df`` with ``place`` (from 1) and ``size`` of its group ``key``, and ``upto_x`` and ``all_x`` of each sum ``x``.

    The rows are dealt out by ranges of (key, order) and written; each range counts and sums what it has of
    a key, and a key meets only one row per range. ``key`` is never null, the sums are whole numbers.
    """
    columns = df.columns
    tied = df.withColumn("tie", F.monotonically_increasing_id())
    dealt = materialise(tied.repartitionByRange(F.col(key), *order, F.col("tie")).withColumn("part", F.spark_partition_id()), label)
    here = Window.partitionBy("part", key).orderBy(*order, "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select(*columns, "part", F.count("*").over(here).alias("place_here"), *[F.sum(x).over(here).alias(f"here_{x}") for x in sums])
    parts = dealt.groupBy("part", key).agg(F.count("*").alias("n"), *[F.sum(x).alias(x) for x in sums])
    whole = Window.partitionBy(key)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "part", key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("places_before"), F.sum("n").over(whole).alias("size"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"before_{x}") for x in sums], *[F.sum(x).over(whole).alias(f"all_{x}") for x in sums],
    )
    joined = local.join(offsets.hint("merge"), ["part", key])
    upto = [(F.col(f"before_{x}") + F.col(f"here_{x}")).alias(f"upto_{x}") for x in sums]
    return joined.select(*columns, (F.col("places_before") + F.col("place_here")).alias("place"), "size", *upto, *[f"all_{x}" for x in sums])
