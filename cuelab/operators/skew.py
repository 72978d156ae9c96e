"""Joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.functions.text import first_bits

#: Keys that ``hot_keys`` lists at most.
HOT_KEYS = 100_000
#: A key with more rows is spread over several tasks, and the most tasks it is spread over.
ROWS_PER_TASK = 100_000
MOST_SALTS = 10_000
#: Keys a join spreads at most, and those its sketch keeps track of in each task.
SPREAD_KEYS, TRACKED_KEYS = 1_000, 16_384


def hot_keys(df: DataFrame, key: str, more_than: int = ROWS_PER_TASK, k: int = HOT_KEYS) -> DataFrame:
    """The values of a key with more than so many rows, and their ``count``; the ``k`` most
    frequent ones at most, whatever the data.

    A key that does not make the list holds less than 1/k of the rows. Ties are broken by the
    key, so a recomputation gives the same answer.
    """
    counts = df.groupBy(key).count().filter(F.col("count") > more_than)
    return counts.orderBy(F.desc("count"), F.asc(key)).limit(k)


def heavy_keys(
    df: DataFrame, key: str, more_than: int = ROWS_PER_TASK, k: int = SPREAD_KEYS, tracked: int = TRACKED_KEYS
) -> list[tuple[int, int]]:
    """About the same for a whole-number key by a mergeable sketch: one scan, no shuffle by key.

    At most ``k`` pairs reach the driver, and there they stay the same whatever is computed again. A
    key may be missed if it has less than some thousandth of the rows, and counts are estimates.
    """
    return rows_and_heavy_keys(df, key, more_than, k, tracked)[1]


def rows_and_heavy_keys(
    df: DataFrame, key: str, more_than: int = ROWS_PER_TASK, k: int = SPREAD_KEYS, tracked: int = TRACKED_KEYS
) -> tuple[int, list[tuple[int, int]]]:
    """The number of rows, and ``heavy_keys``, in one scan."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("top")).first()
    return found["n"], [(r["item"], r["count"]) for r in found["top"] or [] if r["item"] is not None and r["count"] > more_than]


def key_digest(columns: Sequence[str]) -> Column:
    """One key of 16 bytes for several columns: equal where they all are, missing cells included."""
    return first_bits(F.sha2(key_text(columns), 256))


def key_text(columns: Sequence[str]) -> Column:
    """Several columns as one text. Each value is written with its length, so no two rows of cells look the same."""
    parts = []
    for c in columns:
        text = F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    row_id: str,
    rows_per_task: int = ROWS_PER_TASK,
    most_salts: int = MOST_SALTS,
    digested: bool = False,
) -> DataFrame:
    """Null-safe equi-join of a skewed left side with a right side that has few rows per key.

    A left key with more than ``rows_per_task`` rows is spread by ``row_id`` over as many
    partitions as it takes (``most_salts`` at most), and its right rows are copied there; all others
    join as usual, and without such a key it is a plain join. The keys are looked for when the join is
    made (``heavy_keys``: a sketch over the left side, which should come from files); the list has at
    most ``SPREAD_KEYS`` pairs of numbers, which is why it may be broadcast. Neither side is, whatever
    its estimated size. The result does not depend on the list; adaptive execution splits what
    it misses. ``how`` is ``left``, ``inner``, ``left_semi`` or ``left_anti``. With ``digested``, ``on`` is one column that
    is a digest already (NULL matches nothing): a right side that was grouped by it is not shuffled again.
    """
    on = list(on)
    left_cols, right_cols = left.columns, [c for c in right.columns if c not in on]
    keys = {"__k": F.col(on[0]) if digested else key_digest(on), "__h": F.xxhash64(*on)}
    lh, rh = left.withColumns(keys), right.select(*right_cols, *[v.alias(k) for k, v in keys.items()])
    values = [] if how in ("left_semi", "left_anti") else right_cols
    heavy = heavy_keys(lh.select("__h"), "__h", rows_per_task)
    if not heavy:
        return lh.drop("__h").join(rh.drop("__h").hint("merge"), "__k", how).select(*left_cols, *values)
    salts = [(h, min(-(-n // rows_per_task), most_salts)) for h, n in heavy]
    hot = F.broadcast(left.sparkSession.createDataFrame(salts, "__h bigint, __salts int"))

    spread = F.pmod(F.xxhash64(row_id), F.col("__salts")).cast("int")
    ls = lh.join(hot, "__h", "left").withColumn("__salt", F.coalesce(spread, F.lit(0)))
    copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
    rs = rh.join(hot, "__h", "left").withColumn("__salt", F.explode(copies))

    # Estimates miss the growth by explode, so the choice is not left to them.
    joined = ls.drop("__h", "__salts").join(rs.drop("__h", "__salts").hint("merge"), ["__k", "__salt"], how)
    return joined.select(*left_cols, *values)
