"""Summaries of judge scores and sentiment predictions, error samples, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import COT_CONDITIONS, CUES, ERROR_TYPES, JUDGE_SCORES
from cuelab.functions.numbers import round_half_even
from cuelab.functions.sentiment import format_failure
from cuelab.functions.text import shuffle_key
from cuelab.operators.dataset import random_sample
from cuelab.operators.generate import STAGES
from cuelab.operators.metrics import accuracy, class_contingency, class_report, ratio, with_totals
from cuelab.workspace import materialise

PARSE_FAILURE = -1


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Number of rows per value, the most frequent first; missing cells are not counted."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(col))
    )


def composition(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``part`` (the column), ``value`` and ``n`` for several columns of few values, in one scan: their
    combinations are counted first. Missing cells are not counted; unsorted, as tables between steps are."""
    cells = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    parts = F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).cast("string").alias("value")) for c in cols])
    long = cells.select(F.explode(parts).alias("c"), "n").select("c.*", "n").filter(F.col("value").isNotNull())
    return long.groupBy("part", "value").agg(F.sum("n").alias("n"))


def null_rate(df: DataFrame, col: str, by: Sequence[str] = ("model",)) -> DataFrame:
    """Number and percentage of missing cells."""
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(col).isNull()).alias("missing")
    )
    return c.select(*by, "rows", "missing", (ratio(F.col("missing"), F.col("rows")) * 100).alias("missing_pct"))


def failures_by_stage(df: DataFrame, by: Sequence[str] = ("model",), stages: Sequence[str] = STAGES) -> DataFrame:
    """Per group its ``rows`` and, as ``failed_<stage>``, how many of them a stage could not answer; ``missing``: rows with any
    failure. ``df`` carries ``errors`` (see ``jobs.with_errors``)."""
    failed = [F.count_if(F.map_contains_key("errors", s)).alias(f"failed_{s}") for s in stages]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("errors") > 0).alias("missing"), *failed)


# --- judge scores ------------------------------------------------------------


def judge_summary(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rows, readable answers, parse failures, and the rate of each score over readable rows."""
    valid = ~F.col("trigger_removed").eqNullSafe(F.lit(PARSE_FAILURE))
    sums = [F.sum(F.when(valid, F.col(s)).otherwise(0)).alias(f"__{s}") for s in JUDGE_SCORES]
    c = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_evaluated"), F.count_if(valid).alias("valid_responses"), *sums
    )
    rates = [ratio(F.col(f"__{s}"), F.col("valid_responses")).alias(f"{s}_rate") for s in JUDGE_SCORES]
    failures = (F.col("total_evaluated") - F.col("valid_responses")).alias("parse_failures")
    return c.select(*by, "total_evaluated", "valid_responses", failures, *rates)


def _score_sums(df: DataFrame, scores: Sequence[str], groups: Sequence[str], valid: Column) -> DataFrame:
    """``__n`` valid rows and the sum of each score over them. A condition inside the sums rather
    than a filter: scores parsed in the same plan would be parsed once more for the filter."""
    sums = [F.sum(F.when(valid, F.col(s)).otherwise(0)).alias(f"__{s}") for s in scores]
    return df.groupBy(*groups).agg(F.count_if(valid).alias("__n"), *sums).filter(F.col("__n") > 0)


def judge_per_combination(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean of each score over readable rows, per exact ``biases`` cell."""
    valid = F.col("trigger_removed") != PARSE_FAILURE
    c = _score_sums(df.filter(F.col("biases").isNotNull()), JUDGE_SCORES, [*by, "biases"], valid)
    return c.select(*by, "biases", *[ratio(F.col(f"__{s}"), F.col("__n")).alias(s) for s in JUDGE_SCORES])


def removal_by_cue(
    df: DataFrame,
    scores: Sequence[str] = ("trigger_removed", "facts_preserved"),
    by: Sequence[str] = ("model",),
    failures: str = "exclude",
    cues: Sequence[str] = CUES,
) -> DataFrame:
    """Percentage of each score per cue, alone (``Single``) and in a pair (``Pairwise``).

    ``failures="include"`` averages the -1 of unreadable answers in. Rows are first summed per
    ``biases`` cell, so that only this small table is spread over the cues.
    """
    if failures not in ("exclude", "include"):
        raise ValueError("failures must be exclude or include")
    counted = F.col("trigger_removed").isNotNull()
    if failures == "exclude":
        counted = F.col("trigger_removed") != PARSE_FAILURE
    cells = _score_sums(df, scores, [*by, "biases"], counted)
    subset = F.when(F.col("biases") == F.col("bias_type"), "Single").when(
        F.contains("biases", "bias_type") & F.contains(F.col("biases"), F.lit(",")), "Pairwise"
    )
    spread = (
        cells.withColumn("bias_type", F.explode(F.array(*[F.lit(c) for c in cues])))
        .withColumn("subset", subset)
        .filter(F.col("subset").isNotNull())
    )
    out = spread.groupBy(*by, "bias_type", "subset").agg(
        F.sum("__n").alias("rows"), *[F.sum(f"__{s}").alias(f"__{s}") for s in scores]
    )
    return out.select(
        *by, "bias_type", "subset", "rows",
        *[(ratio(F.col(f"__{s}"), F.col("rows")) * 100).alias(f"{s}_pct") for s in scores],
    )


def error_rows(df: DataFrame, carry: Sequence[str] = ("model",), rewrite_col: str = "detected_bias_rewrite") -> DataFrame:
    """One row per failed score of a judged rewrite, up to three per rewrite, in one scan."""
    failed = F.array_compact(
        F.array(*[F.when(F.col(s) == 0, F.lit(name)) for s, name in ERROR_TYPES.items()])
    )
    return df.select(
        *carry,
        F.col("biases").alias("bias_type"),
        F.explode(failed).alias("error_type"),
        "original_sentence",
        "biased_sentence",
        F.col(rewrite_col).alias("model_rewrite"),
    )


#: Candidates for a sample that a first bound on the hash should leave, as a multiple of the sample.
_CANDIDATES = 20


def error_sample(
    df: DataFrame, n: int = 100, seed: int = 42, key: Sequence[str] = ("model", "example_id"),
    rewrite_col: str = "detected_bias_rewrite",
) -> DataFrame:
    """A seeded uniform sample of the error rows, sorted for reading.

    The sample has the least hashes of key and error. From the number of rows follows a bound that leaves some
    times ``n`` of them; rows above it are dropped by their key, before scores are looked at or texts carried.
    If fewer than ``n`` errors lie below it, the bound is raised, in the end to all rows: the result is
    exactly that of sorting all errors. Rows are counted, and the candidates written, when the sample is made.
    """
    def hashed(error: Column) -> Column:
        return shuffle_key(F.concat_ws("|", *[F.col(c).cast("string") for c in key], error), seed)

    rows, space = max(df.count(), 1), 16**8
    bound = _CANDIDATES * n * space // (rows * len(ERROR_TYPES)) + 1
    while bound < space:
        below = F.lit(f"{bound:08x}")
        near = df.filter(F.exists(F.array(*[hashed(F.lit(e)) for e in ERROR_TYPES.values()]), lambda h: h < below))
        errors = error_rows(near, carry=list(key), rewrite_col=rewrite_col).filter(hashed(F.col("error_type")) < below)
        errors = materialise(errors, "error-candidates")
        if errors.count() >= n:
            break
        bound *= 64
    else:
        errors = error_rows(df, carry=list(key), rewrite_col=rewrite_col)
    sampled = random_sample(errors, n, [*key, "error_type"], seed)
    return sampled.orderBy("error_type", "bias_type", *key)


# --- sentiment predictions ---------------------------------------------------


def condition_accuracy(df: DataFrame, by: Sequence[str] = ("model", "condition")) -> DataFrame:
    return accuracy(df, "label", "parsed_sentiment", by)


def add_accuracy(
    report: DataFrame, predictions: DataFrame, by: Sequence[str] = ("model", "condition")
) -> DataFrame:
    """A stored report with the accuracy of its group beside every row; a missing prediction
    counts as wrong. Groups without predictions have none."""
    scores = condition_accuracy(predictions, by).drop("rows")
    return report.join(scores.hint("merge"), list(by), "left")


def report_with_accuracy(
    predictions: DataFrame, by: Sequence[str] = ("model", "condition"), totals: Sequence[str] = ()
) -> DataFrame:
    """The report of each group with its accuracy beside every row, and with ``totals``, columns of ``by``, of all their
    values together: all from one contingency table, so predictions are read once."""
    cells = class_contingency(predictions, "label", "parsed_sentiment", by)
    return class_report(with_totals(cells, by, totals) if totals else cells, by=by)


def _in_pair() -> Column:
    return F.coalesce(F.contains(F.col("biases"), F.lit(",")), F.lit(False))


def pairwise_accuracy(df: DataFrame, by: Sequence[str] = ("model", "condition")) -> DataFrame:
    """Accuracy on rows with more than one cue."""
    return condition_accuracy(df.filter(_in_pair()), by)


def single_cue_accuracy(df: DataFrame, by: Sequence[str] = ("model", "biases", "condition")) -> DataFrame:
    """Accuracy per single cue."""
    return condition_accuracy(df.filter(~_in_pair() & F.col("biases").isin(CUES)), by)


def cot_format_failures(df: DataFrame, by: Sequence[str] = ("model", "condition")) -> DataFrame:
    """Chain-of-thought answers that name no sentiment: number and percentage."""
    c = (
        df.filter(F.col("condition").isin(COT_CONDITIONS))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(format_failure(F.col("predicted_sentiment"))).alias("format_failures"),
        )
    )
    pct = (ratio(F.col("format_failures"), F.col("total")) * 100).alias("failure_rate_pct")
    return c.select(*by, "total", "format_failures", pct)


# --- layout ------------------------------------------------------------------


def pivot(
    df: DataFrame, index: Sequence[str], column: str, values: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Wide table with a fixed list of column values; gaps are NULL.

    One measure gives columns named ``<value>``, several give ``<value>_<measure>``.
    """
    aggs = [F.first(m, ignorenulls=True).alias(m) for m in measures]
    return df.groupBy(*index).pivot(column, list(values)).agg(*aggs)


def rounded(df: DataFrame, digits: int, cols: Sequence[str]) -> DataFrame:
    """Round for display as Python does. Scores are kept unrounded until export."""
    return df.withColumns({c: round_half_even(F.col(c), digits) for c in cols})


def report_layout(report: DataFrame) -> DataFrame:
    """A report as the usual Python one looks on file: its groups, then one row per class under
    the names ``precision, recall, f1-score, support``, in order."""
    scores = ["class", "precision", "recall", "f1", "support"]
    groups = [c for c in report.columns if c not in scores and c not in ("class_ord", "accuracy")]
    rest = [c for c in ("accuracy",) if c in report.columns]
    ordered = report.orderBy(*groups, "class_ord").select(*groups, *scores, *rest)
    return ordered.withColumnRenamed("f1", "f1-score")
