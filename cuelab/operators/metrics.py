"""Precision, recall, F1 and accuracy, for label sets and for single labels.

Both families start from a contingency table: one pass over the rows counts each distinct
(gold, predicted) combination. With k classes it has at most 4^k rows per group, map-side
aggregation does nearly all of the work, and every score is a small query on top of it.

Ratios are formed from whole-number counts once, at the end. Scores therefore do not depend on
how the rows were partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import CUE_CLASSES, CUES, NONE, SENTIMENTS
from cuelab.functions.labels import label_mask
from cuelab.functions.text import sql_text


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def total(columns: Sequence[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out + c
    return out


#: Stands for all models together where a report has totals.
ALL = "(all)"


def with_totals(contingency: DataFrame, by: Sequence[str], over: Sequence[str] = ("model",), name: str = ALL) -> DataFrame:
    """A contingency table with its rows once more for all values of ``over`` together, called ``name`` there.

    Grouping sets over the few counted cells: the rows behind them are read and counted once. Missing groups are groups of
    their own. Scores of ``name`` are those of the pooled rows, not means of scores.
    """
    if not set(over) <= set(by):
        raise ValueError("totals are over columns of the groups")
    cells = [c for c in contingency.columns if c != "n"]
    rest = [c for c in cells if c not in over]
    sets = contingency.groupingSets([[F.col(c) for c in cells], [F.col(c) for c in rest]], *cells)
    summed = sets.agg(F.sum("n").alias("n"), F.grouping(over[0]).alias("__total"))
    named = {c: F.when(F.col("__total") == 1, F.lit(name)).otherwise(F.col(c).cast("string")) for c in over}
    return summed.withColumns(named).select(*contingency.columns)


# --- label sets --------------------------------------------------------------


def label_contingency(
    df: DataFrame,
    gold: Column,
    pred: Column,
    classes: Sequence[str] = CUE_CLASSES,
    by: Sequence[str] = ("model",),
    weight: str | None = None,
) -> DataFrame:
    """Counts per group of (gold set, predicted set), the sets as bit masks over ``classes``.

    ``gold_size`` is the number of gold labels, those outside ``classes`` included. Rows that
    stand for several name their number in ``weight``.
    """
    return (
        df.select(
            *by,
            (F.col(weight) if weight else F.lit(1).cast("bigint")).alias("__w"),
            F.size(gold).alias("gold_size"),
            label_mask(gold, classes).alias("gold"),
            F.coalesce(label_mask(pred, classes), F.lit(0)).alias("pred"),  # no prediction: the empty set
        )
        .groupBy(*by, "gold_size", "gold", "pred")
        .agg(F.sum("__w").alias("n"))
    )


def _counts(i: int, gold: str, pred: str) -> list[Column]:
    """Right answers, answers and gold rows of class ``i``, given the conditions in SQL."""
    conditions = {"tp": f"{gold} AND {pred}", "pp": pred, "sup": gold}
    return [F.expr(f"sum(CASE WHEN {c} THEN n ELSE 0 END) AS {name}_{i}") for name, c in conditions.items()]


def _class_counts(classes: Sequence[str]) -> list[Column]:
    return [c for i in range(len(classes)) for c in _counts(i, f"(gold & {1 << i}) <> 0", f"(pred & {1 << i}) <> 0")]


def _ratio_sql(a: str, b: str) -> str:
    """``ratio`` in SQL: the tables have dozens of cells, and each is one text here instead of ten calls."""
    return f"(CASE WHEN ({b}) = 0 THEN 0.0D ELSE CAST(({a}) AS DOUBLE) / CAST(({b}) AS DOUBLE) END)"


def _f1_sql(i: int) -> str:
    return _ratio_sql(f"2 * tp_{i}", f"pp_{i} + sup_{i}")


def _f1(i: int) -> Column:
    return F.expr(_f1_sql(i))


def _sum_sql(parts: Sequence[str]) -> str:
    return "(" + " + ".join(parts) + ")"


def _row_sql(i: int, name: str, precision: str, recall: str, f1: str, support: str) -> str:
    """One row of a report; ``name`` is an SQL expression."""
    return f"named_struct('class_ord', {i}, 'class', {name}, 'precision', {precision}, 'recall', {recall}, 'f1', {f1}, 'support', {support})"


class _Scores:
    """The scores of k classes from their counts, in SQL."""

    def __init__(self, k: int):
        n = range(k)
        self.p = [_ratio_sql(f"tp_{i}", f"pp_{i}") for i in n]
        self.r = [_ratio_sql(f"tp_{i}", f"sup_{i}") for i in n]
        self.f = [_f1_sql(i) for i in n]
        self.tp, self.pp, self.sup = (_sum_sql([f"{x}_{i}" for i in n]) for x in ("tp", "pp", "sup"))
        self.micro = _ratio_sql(self.tp, self.pp), _ratio_sql(self.tp, self.sup), _ratio_sql(f"2 * {self.tp}", f"{self.pp} + {self.sup}")
        self.macro = tuple(f"({_sum_sql(x)} / {k})" for x in (self.p, self.r, self.f))
        weights = [[f"{x} * CAST(sup_{i} AS DOUBLE)" for i, x in enumerate(xs)] for xs in (self.p, self.r, self.f)]
        self.weighted = tuple(_ratio_sql(_sum_sql(w), self.sup) for w in weights)


def _sample_sums(k: int) -> tuple[list[Column], int]:
    """Sums over rows of |T∩P|/|P|, |T∩P|/|T| and 2|T∩P|/(|T|+|P|), each times the least common
    multiple of the possible denominators: exact whole numbers."""
    unit = lcm(*range(1, 2 * k + 1))
    both = F.bit_count(F.col("gold").bitwiseAND(F.col("pred"))).cast("bigint")
    t, p = F.bit_count("gold").cast("bigint"), F.bit_count("pred").cast("bigint")

    def summed(a: Column, b: Column, name: str) -> Column:
        scaled = F.when(b == 0, F.lit(0).cast("bigint")).otherwise(a * (F.lit(unit) / b).cast("bigint"))
        return F.sum(scaled.cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")).alias(name)

    return [summed(both, p, "s_p"), summed(both, t, "s_r"), summed(2 * both, t + p, "s_f")], unit


def label_report(contingency: DataFrame, classes: Sequence[str] = CUE_CLASSES, by: Sequence[str] = ("model",)) -> DataFrame:
    """Precision, recall, F1 and support of every class and of the micro, macro, weighted and
    samples averages, one row each: ``by..., class_ord, class, precision, recall, f1, support``."""
    k = len(classes)
    sums, unit = _sample_sums(k)
    c = contingency.groupBy(*by).agg(*_class_counts(classes), *sums, F.sum("n").alias("rows"))

    x = _Scores(k)
    mean = [_ratio_sql(name, f"rows * CAST({unit} AS BIGINT)") for name in ("s_p", "s_r", "s_f")]
    rows = [_row_sql(i, sql_text(name), x.p[i], x.r[i], x.f[i], f"sup_{i}") for i, name in enumerate(classes)]
    for i, (name, scores) in enumerate([("micro avg", x.micro), ("macro avg", x.macro), ("weighted avg", x.weighted), ("samples avg", mean)]):
        rows.append(_row_sql(k + i, sql_text(name), *scores, x.sup))
    return c.select(*by, F.expr(f"inline(array({', '.join(rows)}))"))


def f1_per_class(contingency: DataFrame, classes: Sequence[str] = CUE_CLASSES, by: Sequence[str] = ("model",)) -> DataFrame:
    """F1 of every class."""
    c = contingency.groupBy(*by).agg(*_class_counts(classes))
    rows = [f"named_struct('class', {sql_text(name)}, 'f1', {_f1_sql(i)})" for i, name in enumerate(classes)]
    return c.select(*by, F.expr(f"inline(array({', '.join(rows)}))"))


def macro_f1(contingency: DataFrame, classes: Sequence[str] = CUES, by: Sequence[str] = ("model",)) -> DataFrame:
    """Unweighted mean F1 over the classes."""
    k = len(classes)
    c = contingency.groupBy(*by).agg(*_class_counts(classes), F.sum("n").alias("rows"))
    return c.select(*by, F.expr(f"{_Scores(k).macro[2]} AS macro_f1"), "rows")


def single_vs_pairwise(contingency: DataFrame, classes: Sequence[str] = CUES, by: Sequence[str] = ("model",)) -> DataFrame:
    """Macro-F1 on rows with one gold label and on rows with two. The contingency must be built
    from the rows with a cue."""
    subset = F.when(F.col("gold_size") == 1, "Single").when(F.col("gold_size") == 2, "Pairwise")
    c = contingency.withColumn("subset", subset).filter(F.col("subset").isNotNull())
    return macro_f1(c, classes, [*by, "subset"])


def pair_f1(
    contingency: DataFrame,
    pairs: Sequence[tuple[str, str]],
    classes: Sequence[str] = CUES,
    by: Sequence[str] = ("model",),
) -> DataFrame:
    """Macro-F1 of each combination of two gold labels over these two classes only."""
    index = {name: i for i, name in enumerate(classes)}
    named = " ".join(f"WHEN {1 << index[a] | 1 << index[b]} THEN {sql_text(f'{a},{b}')}" for a, b in pairs)
    means = " ".join(f"WHEN {sql_text(f'{a},{b}')} THEN (({_f1_sql(index[a])} + {_f1_sql(index[b])}) / 2)" for a, b in pairs)
    c = contingency.filter(F.col("gold_size") == 2).withColumn("combination", F.expr(f"CASE gold {named} END"))
    c = c.filter(F.col("combination").isNotNull())
    c = c.groupBy(*by, "combination").agg(*_class_counts(classes), F.sum("n").alias("rows"))
    return c.select(*by, "combination", F.expr(f"CASE combination {means} END AS macro_f1"), "rows")


def class_vs_rest(
    df: DataFrame,
    gold: Column,
    pred: Column,
    value: str = NONE,
    by: Sequence[str] = ("model",),
    weight: str | None = None,
) -> DataFrame:
    """Precision, recall and F1 of one value by exact equality; missing cells differ from it."""
    g, p = gold.eqNullSafe(F.lit(value)), pred.eqNullSafe(F.lit(value))
    w = F.col(weight) if weight else F.lit(1).cast("bigint")

    def count(cond: Column, name: str) -> Column:
        return F.sum(F.when(cond, w).otherwise(0)).alias(name)

    c = df.groupBy(*by).agg(count(g & p, "tp"), count(p, "pp"), count(g, "sup"))
    return c.select(
        *by,
        ratio(F.col("tp"), F.col("pp")).alias("precision"),
        ratio(F.col("tp"), F.col("sup")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("pp") + F.col("sup")).alias("f1"),
    )


# --- single labels -----------------------------------------------------------


def class_contingency(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Counts per group of (gold label, predicted label)."""
    return (
        df.select(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred"))
        .groupBy(*by, "gold", "pred")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def class_report(
    contingency: DataFrame,
    classes: Sequence[str] = SENTIMENTS,
    by: Sequence[str] = ("model", "condition"),
    fill_accuracy_row: bool = False,
) -> DataFrame:
    """Scores of every class, accuracy, macro and weighted averages, one row each, and the
    accuracy of the group beside every row.

    Where labels outside ``classes`` occur the accuracy row is a micro average over ``classes``.
    The accuracy row holds its value under ``f1``; ``fill_accuracy_row`` repeats it in all four
    columns, as the tables of the usual Python report do once transposed.
    """
    k = len(classes)
    names = [sql_text(c) for c in classes]
    known = ", ".join(names)
    aggs = [c for i, x in enumerate(names) for c in _counts(i, f"gold <=> {x}", f"pred <=> {x}")]
    inside = f"coalesce(gold IN ({known}) AND pred IN ({known}), FALSE)"
    c = contingency.groupBy(*by).agg(
        *aggs,
        F.sum("n").alias("rows"),
        F.expr(f"sum(CASE WHEN NOT {inside} THEN n ELSE 0 END) AS outside"),
        F.expr("sum(CASE WHEN gold = pred THEN n ELSE 0 END) AS equal"),
    )
    x = _Scores(k)
    hits = _ratio_sql("equal", "rows")
    blank = hits if fill_accuracy_row else "CAST(NULL AS DOUBLE)"
    number = blank if fill_accuracy_row else "CAST(rows AS DOUBLE)"
    all_gold = f"CAST({x.sup} AS DOUBLE)"

    def covered(yes: str, no: str) -> str:
        return f"(CASE WHEN outside = 0 THEN {yes} ELSE {no} END)"

    rows = [_row_sql(i, name, x.p[i], x.r[i], x.f[i], f"CAST(sup_{i} AS DOUBLE)") for i, name in enumerate(names)]
    rows += [
        _row_sql(
            k, covered("'accuracy'", "'micro avg'"), covered(blank, x.micro[0]), covered(blank, x.micro[1]), covered(hits, x.micro[2]),
            covered(number, all_gold),
        ),
        _row_sql(k + 1, "'macro avg'", *x.macro, all_gold),
        _row_sql(k + 2, "'weighted avg'", *x.weighted, all_gold),
    ]
    return c.select(*by, F.expr(f"{hits} AS accuracy"), F.expr(f"inline(array({', '.join(rows)}))"))


def accuracy(df: DataFrame, gold: str, pred: str, by: Sequence[str]) -> DataFrame:
    """Share of rows whose prediction equals the label; a missing prediction is wrong."""
    hit = F.coalesce(F.col(gold) == F.col(pred), F.lit(False))
    return df.groupBy(*by).agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("rows")).select(
        *by, ratio(F.col("hits"), F.col("rows")).alias("accuracy"), "rows"
    )
