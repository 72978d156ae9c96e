"""The fan-out plan: which cues, alone and in pairs, go into which sentences.

The plan is a few dozen constants. It is expanded with ``explode`` over an array literal, so a
sentence and its plan rows meet inside one task: no join, no shuffle, nothing broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import CUES, NONE
from cuelab.functions.text import sql_text, text_array
from cuelab.plans.prompts import InjectionTemplates, render

FRAMED_LABELS = ("positive", "negative")


@dataclass(frozen=True)
class PlanRow:
    """One combination. ``labels`` limits it to sentences with these labels (None: all)."""

    ord: int
    stage1: str | None
    stage2: str | None = None
    labels: tuple[str, ...] | None = None
    shared: bool = False  # the first call is shared by all rows with the same first cue

    @property
    def biases(self) -> str:
        return ",".join(c for c in (self.stage1, self.stage2) if c) or NONE


def bias_plan(
    cues: Sequence[str] = CUES,
    framed_labels: Sequence[str] = FRAMED_LABELS,
    clean: bool = True,
    singles: bool = True,
    pairs: bool = True,
) -> list[PlanRow]:
    """``none``, the single cues, framing, the pairs of plain cues, framing with each plain cue."""
    plain = [c for c in cues if c != "framing"]
    framed = tuple(framed_labels)
    keep: list[tuple] = []
    if clean:
        keep.append((None, None, None, False))
    if singles:
        keep += [(c, None, None, False) for c in plain]
        keep.append(("framing", None, framed, False))
    if pairs:
        keep += [(a, b, None, False) for a, b in combinations(plain, 2)]
        keep += [("framing", c, framed, True) for c in plain]
    # Ordinals belong to the whole plan, so that a partial plan keeps them.
    full = {(r[0], r[1]): i for i, r in enumerate(_full_order(plain))}
    return [PlanRow(full[(s1, s2)], s1, s2, lab, sh) for s1, s2, lab, sh in keep]


def _full_order(plain: Sequence[str]) -> list[tuple]:
    return (
        [(None, None)]
        + [(c, None) for c in plain]
        + [("framing", None)]
        + list(combinations(plain, 2))
        + [("framing", c) for c in plain]
    )


def explode_when(df: DataFrame, rows: Sequence[tuple[Column, Column]], name: str) -> DataFrame:
    """Explode the structs whose condition holds; a row for which none holds is gone."""
    items = F.array_compact(F.array(*[F.when(cond, item) for cond, item in rows]))
    return df.withColumn(name, F.explode(items))


def expand_plan(
    base: DataFrame,
    plan: Sequence[PlanRow],
    label_col: str = "label",
    variants: Sequence[str] = ("main",),
) -> DataFrame:
    """Each sentence with each plan row that applies to it: adds ``plan_ord, biases, stage1,
    stage2, prompt_variant``."""
    rows = [
        f"named_struct('labels', {_labels(r.labels)}, 'plan_ord', {r.ord}, 'biases', {sql_text(r.biases)}, "
        f"'stage1', {sql_text(r.stage1)}, 'stage2', {sql_text(r.stage2)}, 'prompt_variant', {sql_text(v)})"
        for v in variants
        for r in plan
    ]
    return _explode_rows(base, rows, label_col)


def _labels(labels: Sequence[str] | None) -> str:
    return "CAST(NULL AS ARRAY<STRING>)" if labels is None else f"array({', '.join(map(sql_text, labels))})"


def _explode_rows(base: DataFrame, rows: Sequence[str], label_col: str) -> DataFrame:
    """Each row of ``base`` with the constant structs that apply to its label."""
    label = "`" + label_col.replace("`", "``") + "`"
    if not rows:
        raise ValueError("the plan is empty")
    all_rows = f"filter(array({', '.join(rows)}), r -> r.labels IS NULL OR array_contains(r.labels, {label}))"
    exploded = base.select("*", F.expr(f"explode({all_rows})").alias("__row"))
    return exploded.select(*base.columns, F.col("__row").dropFields("labels").alias("__row")).select(*base.columns, "__row.*")


def expand_first_calls(
    base: DataFrame,
    plan: Sequence[PlanRow],
    label_col: str = "label",
    variants: Sequence[str] = ("main",),
) -> DataFrame:
    """Each sentence with each *first* call the plan needs.

    Adds ``call_ord, stage1, prompt_variant`` and ``finish``: an array of ``(plan_ord, biases,
    stage2)`` that says what the first response is used for. Plan rows marked ``shared`` use one
    first response together, the others make one call each.
    """
    calls: dict[object, list[PlanRow]] = {}
    for r in plan:
        if r.stage1 is not None:
            calls.setdefault(("shared", r.stage1) if r.shared else r.ord, []).append(r)
    rows = []
    for v in variants:
        for uses in calls.values():
            first = uses[0]
            finish = ", ".join(
                f"named_struct('plan_ord', {u.ord}, 'biases', {sql_text(u.biases)}, 'stage2', {sql_text(u.stage2)})" for u in uses
            )
            rows.append(
                f"named_struct('labels', {_labels(first.labels)}, 'call_ord', {first.ord}, 'stage1', {sql_text(first.stage1)}, "
                f"'prompt_variant', {sql_text(v)}, 'finish', array({finish}))"
            )
    return _explode_rows(base, rows, label_col)


def injection_prompt(
    cue: Column,
    label: Column,
    variant: Column,
    sentence: Column,
    templates: Mapping[str, InjectionTemplates],
) -> Column:
    """The user prompt that asks for one cue; NULL where no template applies."""
    prompt: Column | None = None

    def add(cond: Column, template: str) -> None:
        nonlocal prompt
        value = render(template, {"sentence": sentence})
        prompt = F.when(cond, value) if prompt is None else prompt.when(cond, value)

    for name, t in templates.items():
        for c, template in t.cues.items():
            add((variant == name) & (cue == c), template)
        for lab, template in t.framing.items():
            add((variant == name) & (cue == "framing") & (label == lab), template)
    return prompt


def expand_models(df: DataFrame, models: Sequence[str], variants: Sequence[str] | None = None) -> DataFrame:
    """Each row once per model (and per variant): the grid of runs as columns."""
    if not models:
        raise ValueError("name at least one model")
    out = df.withColumn("model", F.explode(text_array(models)))
    if variants is not None:
        out = out.withColumn("prompt_variant", F.explode(text_array(variants)))
    return out
