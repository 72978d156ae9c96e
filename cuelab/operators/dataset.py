"""Assembling the labelled dataset: clean rows, union, permutation, samples, dedup.

Sorting, positions and large samples read their input twice: write a table made by model calls
first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelab.fixed_values import ALL_CONDITIONS, CLEAN_CONDITIONS, NONE
from cuelab.functions.text import first_bits, shuffle_key, text_key
from cuelab.operators.skew import ROWS_PER_TASK, heavy_keys

DATASET_COLUMNS = ["example_id", "original_sentence", "biased_sentence", "label", "biases"]

# Largest n for which Spark cuts every group to its first n rows before the shuffle.
_GROUP_LIMIT = 1000


def example_id(sentence_id: Column, plan_ord: Column, variant: Column | None = None) -> Column:
    """Identity of an example: the sentence's own id, its plan row and the prompt variant.

    Not derived from the text, so copies of a sentence remain separate examples.
    """
    parts = [sentence_id.cast("string"), plan_ord.cast("string")]
    if variant is not None:
        parts.append(variant)
    return F.concat_ws(":", *parts)


def sentence_of(example: Column) -> Column:
    """An id without its last part: what the examples of a sentence (and prompt variant) have in common."""
    last = F.substring_index(example, ":", -1)
    return F.when(F.contains(example, F.lit(":")), F.left(example, F.length(example) - F.length(last))).otherwise(example)


def clean_rows(base: DataFrame, text_col: str = "sentence", id_col: str = "sentence_id") -> DataFrame:
    """The base sentences as examples without a cue."""
    return base.select(
        example_id(F.col(id_col), F.lit(0)).alias("example_id"),
        F.col(text_col).alias("original_sentence"),
        F.col(text_col).alias("biased_sentence"),
        F.col("label"),
        F.lit(NONE).alias("biases"),
    )


def with_text_keys(examples: DataFrame) -> DataFrame:
    """Add ``original_key`` and ``biased_key``, digests of the two texts. Made once here, they go
    through the stages in place of the texts, for the operators that group or join by text."""
    return examples.withColumns(
        {
            "original_key": text_key(F.col("original_sentence")),
            "biased_key": text_key(F.col("biased_sentence")),
        }
    )


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; columns that a part lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def assemble(injected: DataFrame, base: DataFrame) -> DataFrame:
    """Injected examples and clean ones together, in the columns of the dataset."""
    return union_all([injected.select(*DATASET_COLUMNS), clean_rows(base)])


def shuffled(df: DataFrame, seed: int = 42, key: str = "example_id") -> DataFrame:
    """The rows in a seeded random order: a range-partitioned sort on a keyed hash."""
    return df.withColumn("__s", shuffle_key(F.col(key), seed)).orderBy("__s", key).drop("__s")


def _sliced(df: DataFrame, seed: int, key: str, group: Column, digits: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their hash ``__s`` and its leading digits ``__slice``, and the number of
    rows before each slice (``__offset``), per group ``__g``.

    The hash is uniform over rows, so slices are even however the groups are: with more rows take
    more digits. A group has 16^digits slices at most.
    """
    if not 1 <= digits <= 5:
        raise ValueError("digits must be 1 to 5")
    keyed = df.withColumns({"__g": group, "__s": shuffle_key(F.col(key), seed)})
    keyed = keyed.withColumn("__slice", F.substring("__s", 1, digits))
    sizes = keyed.groupBy("__g", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    return keyed, sizes.select("__g", "__slice", offset)


def _rank_in_slice(key: str) -> Column:
    return F.row_number().over(Window.partitionBy("__g", "__slice").orderBy("__s", key))


def shuffle_position(
    df: DataFrame, seed: int = 42, key: str = "example_id", digits: int = 4
) -> DataFrame:
    """Add ``position``, the 0-based place of each row in the seeded order of ``shuffled``.

    No global window over rows: they are ranked inside slices of the hash, and the sizes of the
    slices before give the offset. The offsets are broadcast: 16^digits rows at most.
    """
    keyed, offsets = _sliced(df, seed, key, F.lit(""), digits)
    ranked = keyed.withColumn("__r", _rank_in_slice(key))
    return ranked.join(F.broadcast(offsets), ["__g", "__slice"]).select(
        *df.columns, (F.col("__offset") + F.col("__r") - 1).alias("position")
    )


def _first(df: DataFrame, groups: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group. Spark cuts each group to n rows per task before the
    shuffle, as long as n is not above ``_GROUP_LIMIT``."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")


def _sample(df: DataFrame, group: Column, n: int, seed: int, key: str, digits: int) -> DataFrame:
    if n > _GROUP_LIMIT:
        keyed, offsets = _sliced(df, seed, key, group, digits)
        # The join leaves the rows partitioned as the ranking needs them.
        near = keyed.join(offsets.filter(F.col("__offset") < n).hint("merge"), ["__g", "__slice"])
        ranked = near.withColumn("__r", _rank_in_slice(key))
        return ranked.filter(F.col("__offset") + F.col("__r") <= n).select(*df.columns)
    # With very many tasks, n rows of each are still many for one task: so first per set of tasks.
    keyed = df.withColumns(
        {
            "__g": group,
            "__s": shuffle_key(F.col(key), seed),
            "__task": F.pmod(F.spark_partition_id(), F.lit(256)),
        }
    )
    order = ["__s", key]
    return _first(_first(keyed, ["__g", "__task"], order, n), ["__g"], order, n).select(*df.columns)


def stratified_sample(
    df: DataFrame, by: str, n: int, seed: int = 42, key: str = "sentence_id", digits: int = 3
) -> DataFrame:
    """``n`` rows of every stratum, or all of a smaller one, chosen by a keyed hash.

    A stratum is never pulled into one task. Up to 1000 rows per stratum every task passes on
    its first n, in two rounds. Beyond that the strata are cut in slices of the hash: slices behind
    the n-th row are left out, and rows are ranked inside single slices.
    """
    # One name per stratum that is never missing, so that plain equality joins them.
    group = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    return _sample(df, group, n, seed, key, digits)


def random_sample(
    df: DataFrame, n: int, key: Sequence[str], seed: int = 42, digits: int = 3
) -> DataFrame:
    """A seeded uniform sample of ``n`` rows, or all of them; ``key`` identifies a row."""
    keyed = df.withColumn("__id", F.concat_ws("|", *[F.col(c).cast("string") for c in key]))
    return _sample(keyed, F.lit(""), n, seed, "__id", digits).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order.

    The filter on the rank lets every task drop all but its own last row per key before the
    shuffle, so a key with many copies travels as one row per task.
    """
    return _first(df, keys, [F.col(c).desc() for c in order], 1)


def keep_last_predictions(
    df: DataFrame,
    order: Sequence[str] = ("seq",),
    original: str = "original_sentence",
    biased: str = "biased_sentence",
    conditions: Sequence[str] = ALL_CONDITIONS,
    clean: Sequence[str] = CLEAN_CONDITIONS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One prediction per model, condition and text: the original text for the ``clean`` conditions,
    the biased text for the others. Rows of conditions that are not listed are left out. ``original`` and
    ``biased`` may name the columns of ``with_text_keys`` as well.

    Rows are dealt out by the text alone, so that those of one text lie side by side in the shuffle files, where its digest then counts once.
    Texts with more than ``rows_per_task`` rows (``heavy_keys``, a scan of ``df``, which should come from files) are dealt by model and
    condition too, and every task first drops all but its own last row of each.
    """
    df = df.filter(F.col("condition").isin(list(conditions)))
    text = F.when(F.col("condition").isin(list(clean)), F.col(original)).otherwise(F.col(biased))
    keys = [c for c in ("model", "condition") if c in df.columns]
    keyed = df.withColumn("__text", first_bits(F.sha2(text, 256)))
    hashed = F.xxhash64("__text")
    heavy = [h for h, _ in heavy_keys(keyed.select(hashed.alias("__h")), "__h", rows_per_task)]
    rest = keyed.filter(~hashed.isin(heavy)) if heavy else keyed
    last = keep_last(rest.repartition("__text"), ["__text", *keys], order)
    if heavy:
        last = last.unionByName(keep_last(keyed.filter(hashed.isin(heavy)), ["__text", *keys], order))
    return last.drop("__text")
