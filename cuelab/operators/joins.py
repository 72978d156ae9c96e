"""Bringing the results of earlier stages to the examples, and finding what is left to do."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelab.functions.text import text_key
from cuelab.operators.skew import ROWS_PER_TASK, key_digest, salted_join


def attach(
    examples: DataFrame,
    results: DataFrame,
    value_cols: Sequence[str],
    keys: Sequence[str] = ("model", "example_id"),
) -> DataFrame:
    """Left join on the identity of an example: one result row per example and model at most.

    Both sides grow with the data and the size estimates miss the growth by explode, so a
    broadcast is ruled out here and in the other joins of stage tables.
    """
    return examples.join(results.select(*keys, *value_cols).hint("merge"), list(keys), "left")


def _keyed(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """With one digest of the keys and the text, ``__text``: rows are grouped and joined by it alone, so once shuffled they stay."""
    return df.withColumn("__text", text_key(F.col(text_col))).withColumn("__text", key_digest([*keys, "__text"]))


def attach_by_text(
    examples: DataFrame,
    results: DataFrame,
    value_cols: Sequence[str],
    text_col: str = "biased_sentence",
    keys: Sequence[str] = ("model",),
    row_id: str = "example_id",
    rows_per_task: int = ROWS_PER_TASK,
    last_by: Sequence[str] = (),
    every: bool = False,
) -> DataFrame:
    """Left join on the text itself, for results that carry no example id: one row per example.

    Copies of a text would multiply: n examples with n results make n² rows. So results are first
    reduced to one per text, the last by the columns ``last_by`` (of equal ones the greatest digest
    of the values); ``n_copies`` says how many there were, 1 for unmatched examples. With ``every``
    each distinct value of a text gives a row with its number: for labels and scores, of
    which there are few, not for texts that a model wrote.
    """
    keyed_results = _keyed(results, keys, text_col)
    n_copies = F.count(F.lit(1)).alias("n_copies")
    if every:
        distinct = keyed_results.groupBy("__text", *value_cols).agg(n_copies)
    else:
        last = F.max_by(F.struct(*value_cols), F.struct(*last_by, F.xxhash64(*value_cols)))
        distinct = keyed_results.groupBy("__text").agg(last.alias("__last"), n_copies).select("__text", "__last.*", "n_copies")
    keyed = _keyed(examples, keys, text_col)
    out = salted_join(keyed, distinct, ["__text"], row_id=row_id, rows_per_task=rows_per_task, digested=True).drop("__text")
    return out.withColumn("n_copies", F.coalesce("n_copies", F.lit(1)))


def remaining(
    todo: DataFrame, done: DataFrame, keys: Sequence[str] = ("example_id", "condition", "model")
) -> DataFrame:
    """Rows whose key is not among the finished ones. Missing key cells match each other. The key
    should identify a row; for texts there is ``remaining_by_text``. Name the column with most values first:
    rows are sorted by the keys in their order, and the start of the first one decides most comparisons."""
    finished = done.select(*keys).hint("merge").alias("d")
    t = todo.alias("t")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}"))
    return t.join(finished, cond, "left_anti")


def remaining_by_text(
    todo: DataFrame,
    done: DataFrame,
    text_col: str,
    keys: Sequence[str] = ("model", "condition"),
    row_id: str = "example_id",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rows whose text is not among the finished ones, for results that carry no example id.

    Copies of one text are reduced to one on the finished side, with the set of ``keys`` under which it is finished, and spread out on the
    other. Rows are dealt out by the text alone: those of a text lie side by side in the shuffle files, where its digest then counts once.
    """
    def name(df: DataFrame):
        return df.withColumn("__text", key_digest([text_col]))  # missing texts are one value

    finished = name(done.select(*keys, text_col)).groupBy("__text").agg(F.collect_set(F.struct(*keys)).alias("__finished"))
    left = salted_join(name(todo), finished, ["__text"], row_id=row_id, rows_per_task=rows_per_task, digested=True)

    def same(x):
        return reduce(and_, [x[k].eqNullSafe(F.col(k)) for k in keys], F.lit(True))

    return left.filter(~F.coalesce(F.exists("__finished", same), F.lit(False))).select(*todo.columns)


def reindex(result: DataFrame, col: str, wanted: Sequence[str]) -> DataFrame:
    """One fixed list of values in its order: absent ones as rows of NULL, others dropped.

    The list is a literal of the caller; ``<col>_ord`` is its position.
    """
    spark = result.sparkSession
    names = spark.createDataFrame(list(enumerate(wanted)), f"{col}_ord int, {col} string")
    return names.join(result.hint("merge").filter(F.col(col).isin(list(wanted))), col, "left").orderBy(f"{col}_ord")
