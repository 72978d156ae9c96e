"""Label sets: reading them from model answers and from comma-joined cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelab.fixed_values import CUES, NONE
from cuelab.functions.text import strip, text_array


def prediction_cell(text: Column, cues: Sequence[str] = CUES) -> Column:
    """Cues named anywhere in a model answer, in fixed order and comma-joined; ``none`` when there
    are none.

    Plain substring matching: ``reframing`` counts as framing, ``no anchoring`` as anchoring.
    """
    low = F.lower(text)
    named = F.concat_ws(",", *[F.when(F.contains(low, F.lit(c)), F.lit(c)) for c in cues])
    return F.when(named == "", F.lit(NONE)).otherwise(named)


def parse_predictions(text: Column, cues: Sequence[str] = CUES) -> Column:
    """``prediction_cell`` as a list."""
    return F.split(prediction_cell(text, cues), ",")


def _cells(text: Column, lower: bool = True) -> Column:
    cells = F.transform(F.split(text, ",", -1), lambda c: strip(F.lower(c) if lower else c))
    return F.filter(cells, lambda c: c != "")


def _is_none(text: Column) -> Column:
    return text.isNull() | F.lower(strip(text)).isin("", NONE)


def parse_gold(text: Column) -> Column:
    """Labels of a comma-joined cell; missing, blank and ``none`` cells give ``[none]``.

    Unknown labels stay, and a cell of bare commas gives an empty list.
    """
    return F.when(_is_none(text), text_array([NONE])).otherwise(_cells(text))


def label_set(text: Column) -> Column:
    """``parse_gold`` as a set: each label once."""
    return F.array_distinct(parse_gold(text))


def label_set_without_none(text: Column) -> Column:
    """The set of labels other than ``none``; missing cells give the empty set."""
    empty = F.array().cast("array<string>")
    return F.when(_is_none(text), empty).otherwise(
        F.array_distinct(F.array_remove(_cells(text), F.lit(NONE)))
    )


def known_labels(text: Column, cues: Sequence[str] = CUES) -> Column:
    """Known labels only, compared with case; missing cells give the empty set."""
    empty = F.array().cast("array<string>")
    known = F.array_intersect(_cells(text, lower=False), text_array(cues))
    return F.when(text.isNull() | text.isin("", NONE), empty).otherwise(known)


def join_labels(labels: Column) -> Column:
    return F.array_join(labels, ",")


def pair_key(labels: Column) -> Column:
    """Name of a label combination that does not depend on the order of its labels."""
    return F.array_join(F.array_sort(labels), ",")


def label_mask(labels: Column, classes: Sequence[str]) -> Column:
    """One bit per class; labels outside ``classes`` leave no trace."""
    known = text_array(classes)
    bit = lambda mask, c: mask.bitwiseOR(F.call_function("shiftleft", F.lit(1), (F.array_position(known, c) - 1).cast("int")))
    return F.coalesce(F.aggregate(F.array_intersect(labels, known), F.lit(0), bit), F.lit(0))
