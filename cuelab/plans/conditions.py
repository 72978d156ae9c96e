"""The nine sentiment conditions as a table of (population, input, prompt, parser)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import ALL_CONDITIONS, CLEAN_CONDITIONS, COT_CONDITIONS, NONE
from cuelab.plans.injection import explode_when
from cuelab.plans.prompts import TASK_TEMPLATES, TaskTemplates, render


@dataclass(frozen=True)
class Condition:
    ord: int
    name: str
    input_col: str
    system: str
    template: str
    labels_col: str | None = None
    clean: bool = False  # whether it asks about the original sentences of clean rows
    parser: str = "plain"  # or "cot"


def sentiment_conditions(
    names: Sequence[str] = ALL_CONDITIONS, templates: TaskTemplates = TASK_TEMPLATES
) -> list[Condition]:
    t = templates
    spec = {
        "1_clean_baseline": ("original_sentence", t.sentiment_system, t.sentiment, None),
        "2_no_defense": ("biased_sentence", t.sentiment_system, t.sentiment, None),
        "3_generic_defense": ("biased_sentence", t.sentiment_system, t.generic, None),
        "4_cot": ("biased_sentence", t.cot_system, t.cot, None),
        "4_cot_clean": ("original_sentence", t.cot_system, t.cot, None),
        "5_targeted_detected": ("biased_sentence", t.sentiment_system, t.targeted, "predicted_biases"),
        "6_targeted_gold": ("biased_sentence", t.sentiment_system, t.targeted, "biases"),
        "7_rewrite_detected": ("detected_bias_rewrite", t.sentiment_system, t.sentiment, None),
        "8_rewrite_gold": ("true_bias_rewrite", t.sentiment_system, t.sentiment, None),
    }
    unknown = set(names) - set(spec)
    if unknown:
        raise ValueError(f"unknown conditions: {sorted(unknown)}")
    return [
        Condition(ALL_CONDITIONS.index(n), n, *spec[n], clean=n in CLEAN_CONDITIONS, parser="cot" if n in COT_CONDITIONS else "plain")
        for n in ALL_CONDITIONS
        if n in set(names)
    ]


def is_clean(biases: Column) -> Column:
    """Clean rows; a missing ``biases`` cell counts as not clean."""
    return biases.eqNullSafe(F.lit(NONE))


def split_biased_clean(df: DataFrame, biases_col: str = "biases") -> tuple[DataFrame, DataFrame]:
    clean = is_clean(F.col(biases_col))
    return df.filter(~clean), df.filter(clean)


def open_conditions(conditions: Sequence[Condition], finished: str | None = None) -> list[Column]:
    """For each condition whether a row is asked under it: those of its population that are not in the array ``finished``."""
    clean = is_clean(F.col("biases"))

    def open_(name: str) -> Column:
        return ~F.coalesce(F.array_contains(F.col(finished), name), F.lit(False)) if finished else F.lit(True)

    return [(clean if c.clean else ~clean) & open_(c.name) for c in conditions]


def expand_conditions(examples: DataFrame, conditions: Sequence[Condition], finished: str | None = None) -> DataFrame:
    """Each example with each condition of its population: adds ``condition, condition_ord,
    parser``. The population is a property of the example, so clean conditions never meet biased
    rows. Conditions in the array column ``finished`` are left out. Only constants are exploded; the
    prompt is added to the exploded rows."""
    rows = [
        (
            asked,
            F.struct(
                F.lit(c.name).alias("condition"),
                F.lit(c.ord).alias("condition_ord"),
                F.lit(c.parser).alias("parser"),
            ),
        )
        for c, asked in zip(conditions, open_conditions(conditions, finished))
    ]
    return explode_when(examples, rows, "__cond").select(*examples.columns, "__cond.*")


def condition_prompt(conditions: Sequence[Condition], missing: str | None = None) -> Column:
    """The user prompt of a row by its ``condition``."""
    out: Column | None = None
    for c in conditions:
        slots = {"sentence": F.col(c.input_col)}
        if c.labels_col:
            slots["bias_type"] = F.col(c.labels_col)
        here, value = F.col("condition") == c.name, render(c.template, slots, missing)
        out = F.when(here, value) if out is None else out.when(here, value)
    return out
