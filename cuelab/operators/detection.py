"""The tables of detection scores, one function each.

They take the detections of any number of models: ``biases`` as a comma-joined cell,
``predicted_biases`` as a list or as such a cell, and the columns named in ``by``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import CUE_CLASSES, CUES, NONE
from cuelab.functions.labels import join_labels, known_labels, label_set, label_set_without_none
from cuelab.operators import metrics as M
from cuelab.operators.analysis import pivot
from cuelab.plans.conditions import is_clean

_MODEL = ("model",)
#: Stands for the labels of a call without a response: it is no class, so it is never right.
NO_RESPONSE = "no response"


def _cells(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of rows per group and pair of cells. Cells take few values, so they are counted
    first and parsed afterwards."""
    is_list = df.schema["predicted_biases"].dataType.typeName() == "array"
    counted = df.groupBy(*by, "biases", "predicted_biases").agg(F.count(F.lit(1)).alias("n"))
    cell = join_labels(F.col("predicted_biases")) if is_list else F.col("predicted_biases")
    if "error" in df.columns:  # then a missing cell is a call without a response, not a blank answer
        cell = F.coalesce(cell, F.lit(NO_RESPONSE))
    return counted.withColumn("predicted_biases", cell)


def _contingency(
    df: DataFrame, read: Callable[[Column], Column], classes: Sequence[str], by: Sequence[str]
) -> DataFrame:
    gold, pred = read(F.col("biases")), read(F.col("predicted_biases"))
    return M.label_contingency(_cells(df, by), gold, pred, classes, by, weight="n")


def _all_classes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _contingency(df, label_set, CUE_CLASSES, by)


def _cues_only(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return _contingency(df.filter(~is_clean(F.col("biases"))), label_set_without_none, CUES, by)


def detection_report(df: DataFrame, by: Sequence[str] = _MODEL, totals: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, support of the six cues and ``none``, with four averages. With ``totals``, columns of ``by``, also
    for all their values together (``metrics.ALL``)."""
    cells = _all_classes(df, by)
    return M.label_report(M.with_totals(cells, by, totals) if totals else cells, CUE_CLASSES, by)


def f1_per_cue(df: DataFrame, by: Sequence[str] = _MODEL) -> DataFrame:
    return M.f1_per_class(_all_classes(df, by), CUE_CLASSES, by)


def single_vs_pairwise_f1(df: DataFrame, by: Sequence[str] = _MODEL) -> DataFrame:
    """Macro-F1 over the cues, on rows with one cue and on rows with two."""
    return M.single_vs_pairwise(_cues_only(df, by), CUES, by)


def cue_pairs() -> list[tuple[str, str]]:
    plain = [c for c in CUES if c != "framing"]
    return [*combinations(plain, 2), *[("framing", c) for c in plain]]


def pair_f1(df: DataFrame, by: Sequence[str] = _MODEL) -> DataFrame:
    """Macro-F1 of every pair over its own two cues."""
    return M.pair_f1(_cues_only(df, by), cue_pairs(), CUES, by)


def none_class(df: DataFrame, by: Sequence[str] = _MODEL) -> DataFrame:
    """Precision, recall and F1 of the answer ``none``, by equality of the whole cell."""
    return M.class_vs_rest(_cells(df, by), F.col("biases"), F.col("predicted_biases"), NONE, by, weight="n")


def prompt_sensitivity(
    df: DataFrame, variants: Sequence[str], by: Sequence[str] = _MODEL, variant_col: str = "prompt_variant"
) -> DataFrame:
    """Macro-F1 over the cues per prompt variant, one column per variant. Labels are compared
    with case and unknown ones ignored."""
    groups = [*by, variant_col]
    rows = df.filter(~is_clean(F.col("biases")))
    scores = M.macro_f1(_contingency(rows, known_labels, CUES, groups), CUES, groups)
    return pivot(scores, by, variant_col, variants, ["macro_f1"])
