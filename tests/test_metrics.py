import random

import pytest
from pyspark.sql import functions as F

from cuelab.fixed_values import CUE_CLASSES, CUES
from cuelab.operators import analysis as A
from cuelab.operators import detection as T
from cuelab.operators import metrics as M
from tests.conftest import values

EPS = 1e-12


def report_of(df, key="class"):
    return {r[key]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in df.collect()}


def test_hand_example(spark):
    rows = [("m", ["a"], ["a"]), ("m", ["a", "b"], ["a"]), ("m", ["b"], ["none"]), ("m", ["none"], ["none"])]
    df = spark.createDataFrame(rows, "model string, g array<string>, p array<string>")
    classes = ["a", "b", "none"]
    got = report_of(M.label_report(M.label_contingency(df, F.col("g"), F.col("p"), classes), classes))
    want = {
        "a": (1, 1, 1, 2),
        "b": (0, 0, 0, 2),
        "none": (1 / 2, 1, 2 / 3, 1),
        "micro avg": (3 / 4, 3 / 5, 2 / 3, 5),
        "macro avg": (1 / 2, 2 / 3, 5 / 9, 5),
        "weighted avg": (1 / 2, 3 / 5, 8 / 15, 5),
        "samples avg": (3 / 4, 5 / 8, 2 / 3, 5),
    }
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=EPS)


def div(a, b):
    return a / b if b else 0.0


def brute_report(pairs, classes):
    """Scores of label sets, row by row."""
    out, k = {}, len(classes)
    pairs = [(set(g) & set(classes), set(p) & set(classes)) for g, p in pairs]
    tp = [sum(c in g and c in p for g, p in pairs) for c in classes]
    pp = [sum(c in p for _, p in pairs) for c in classes]
    sup = [sum(c in g for g, _ in pairs) for c in classes]
    for i, c in enumerate(classes):
        out[c] = (div(tp[i], pp[i]), div(tp[i], sup[i]), div(2 * tp[i], pp[i] + sup[i]), sup[i])
    total = sum(sup)
    out["micro avg"] = (div(sum(tp), sum(pp)), div(sum(tp), total), div(2 * sum(tp), sum(pp) + total), total)
    for j, name in ((None, "macro avg"), (1, "weighted avg")):
        w = sup if j else [1] * k
        out[name] = tuple(div(sum(out[c][m] * w[i] for i, c in enumerate(classes)), sum(w)) for m in range(3)) + (total,)
    n = len(pairs)
    out["samples avg"] = (
        sum(div(len(g & p), len(p)) for g, p in pairs) / n,
        sum(div(len(g & p), len(g)) for g, p in pairs) / n,
        sum(div(2 * len(g & p), len(g) + len(p)) for g, p in pairs) / n,
        total,
    )
    return out


def random_rows(seed, n=400):
    rng = random.Random(seed)
    words = CUE_CLASSES + ["unknown"]
    rows = []
    for i in range(n):
        gold = ",".join(rng.sample(words, rng.randint(0, 3))) if rng.random() < 0.9 else None
        pred = ",".join(rng.sample(words, rng.randint(0, 3))) if rng.random() < 0.9 else None
        rows.append((rng.choice("xy"), gold, pred))
    return rows


def py_labels(cell):
    if cell is None or cell.strip() == "" or cell.strip().lower() == "none":
        return ["none"]
    return [c.strip().lower() for c in cell.split(",") if c.strip()]


@pytest.mark.parametrize("seed", [1, 2])
def test_report_against_brute_force(spark, seed):
    rows = random_rows(seed)
    df = spark.createDataFrame(rows, "model string, biases string, predicted_biases string").repartition(5)
    report = T.detection_report(df).collect()
    f1 = {(r["model"], r["class"]): r["f1"] for r in T.f1_per_cue(df).collect()}
    for model in "xy":
        want = brute_report([(py_labels(g), py_labels(p)) for m, g, p in rows if m == model], CUE_CLASSES)
        got = {r["class"]: (r["precision"], r["recall"], r["f1"], r["support"]) for r in report if r["model"] == model}
        assert got.keys() == want.keys()
        for name in want:
            assert got[name] == pytest.approx(want[name], abs=EPS)
        for c in CUE_CLASSES:
            assert f1[model, c] == pytest.approx(want[c][2], abs=EPS)
        per_class = [want[c][2] for c in CUE_CLASSES]
        assert min(per_class) <= got["micro avg"][2] <= max(per_class)


def test_single_pairwise_and_pairs(spark):
    rows = random_rows(3)
    df = spark.createDataFrame(rows, "model string, biases string, predicted_biases string")

    def no_none(cell):
        return set(py_labels(cell)) - {"none"}

    got = {(r["model"], r["subset"]): r["macro_f1"] for r in T.single_vs_pairwise_f1(df).collect()}
    pairs = {(r["model"], r["combination"]): r["macro_f1"] for r in T.pair_f1(df).collect()}
    for model in "xy":
        mine = [(no_none(g), no_none(p)) for m, g, p in rows if m == model and g != "none"]
        for subset, size in (("Single", 1), ("Pairwise", 2)):
            chosen = [(g, p) for g, p in mine if len(g) == size]
            want = brute_report(chosen, CUES)["macro avg"][2]
            assert got[model, subset] == pytest.approx(want, abs=EPS)
        for a, b in T.cue_pairs():
            chosen = [(g, p) for g, p in mine if g == {a, b}]
            if not chosen:
                assert (model, f"{a},{b}") not in pairs
                continue
            want = brute_report(chosen, [a, b])
            assert pairs[model, f"{a},{b}"] == pytest.approx(want["macro avg"][2], abs=EPS)
            # Precision is 1 or 0 here, so F1 follows from recall.
            for c in (a, b):
                assert want[c][2] == pytest.approx(div(2 * want[c][1], 1 + want[c][1]))


def test_none_class(spark):
    rows = [("m", "none", "none"), ("m", "none", "herding"), ("m", None, "none"), ("m", "herding", None)]
    df = spark.createDataFrame(rows, "model string, biases string, predicted_biases string")
    assert values(T.none_class(df)) == [("m", 0.5, 0.5, 0.5)]


def test_prompt_sensitivity_compares_with_case(spark):
    rows = [("m", "main", "herding", "herding"), ("m", "alt", "herding", "Herding"), ("m", "alt", "none", "herding")]
    df = spark.createDataFrame(rows, "model string, prompt_variant string, biases string, predicted_biases string")
    assert values(T.prompt_sensitivity(df, ["main", "alt", "gone"])) == [("m", 1 / 6, 0.0, None)]


def brute_classes(pairs, classes):
    out = {}
    n = len(pairs)
    for c in classes:
        tp = sum(g == c and p == c for g, p in pairs)
        pp, sup = sum(p == c for _, p in pairs), sum(g == c for g, _ in pairs)
        out[c] = (div(tp, pp), div(tp, sup), div(2 * tp, pp + sup), sup)
    return out, sum(g == p for g, p in pairs) / n


def test_class_report(spark):
    rng = random.Random(5)
    words = ["positive", "neutral", "negative"]
    rows = [("c", rng.choice(words), rng.choice(words)) for _ in range(200)]
    df = spark.createDataFrame(rows, "condition string, label string, parsed string")
    report = M.class_report(M.class_contingency(df, "label", "parsed", ["condition"]), by=["condition"])
    got = report_of(report)
    want, accuracy = brute_classes([(g, p) for _, g, p in rows], words)
    for w in words:
        assert got[w] == pytest.approx(want[w], abs=EPS)
    assert got["accuracy"] == (None, None, pytest.approx(accuracy), 200)
    assert all(r["accuracy"] == pytest.approx(accuracy) for r in report.collect())
    macro = [sum(want[w][i] for w in words) / 3 for i in range(3)]
    assert got["macro avg"][:3] == pytest.approx(macro)
    filled = M.class_report(M.class_contingency(df, "label", "parsed", ["condition"]), by=["condition"], fill_accuracy_row=True)
    assert report_of(filled)["accuracy"] == pytest.approx((accuracy,) * 4)


def test_class_report_with_other_labels(spark):
    rows = [("c", "positive", "positive"), ("c", "odd", "neutral"), ("c", "negative", None)]
    df = spark.createDataFrame(rows, "condition string, label string, parsed string")
    got = report_of(M.class_report(M.class_contingency(df, "label", "parsed", ["condition"]), by=["condition"]))
    assert "accuracy" not in got
    assert got["micro avg"] == (1 / 2, 1 / 2, 1 / 2, 2)


def test_accuracy_counts_missing_as_wrong(spark):
    rows = [("m", "c", "positive", "positive"), ("m", "c", "positive", None)]
    df = spark.createDataFrame(rows, "model string, condition string, label string, parsed_sentiment string")
    assert values(A.condition_accuracy(df)) == [("m", "c", 0.5, 2)]


def judgements(spark):
    rows = [
        ("m", "1", "herding", 1, 1, 0),
        ("m", "2", "herding", 0, 1, 1),
        ("m", "3", "herding,recency", -1, -1, -1),
        ("m", "4", "herding,recency", 1, 0, 0),
        ("m", "5", None, 1, 1, 1),
        ("n", "6", "recency", -1, -1, -1),
    ]
    df = spark.createDataFrame(
        rows, "model string, example_id string, biases string, trigger_removed int, facts_preserved int, natural_language int"
    )
    return df.withColumns({c: F.concat(F.lit(c), "example_id") for c in ("original_sentence", "biased_sentence", "detected_bias_rewrite")})


def test_judge_summary(spark):
    got = {r["model"]: r.asDict() for r in A.judge_summary(judgements(spark)).collect()}
    assert got["m"]["total_evaluated"] == 5 and got["m"]["valid_responses"] == 4 and got["m"]["parse_failures"] == 1
    assert got["m"]["trigger_removed_rate"] == 0.75 and got["m"]["natural_language_rate"] == 0.5
    assert got["n"]["valid_responses"] == 0 and got["n"]["trigger_removed_rate"] == 0.0


def test_judge_per_combination(spark):
    got = values(A.judge_per_combination(judgements(spark)))
    assert got == [("m", "herding", 0.5, 1.0, 0.5), ("m", "herding,recency", 1.0, 0.0, 0.0)]


def test_removal(spark):
    without = values(A.removal_by_cue(judgements(spark)))
    assert without == [
        ("m", "herding", "Pairwise", 1, 100.0, 0.0),
        ("m", "herding", "Single", 2, 50.0, 100.0),
        ("m", "recency", "Pairwise", 1, 100.0, 0.0),
    ]
    with_failures = values(A.removal_by_cue(judgements(spark), failures="include"))
    assert ("m", "herding", "Pairwise", 2, 0.0, -50.0) in with_failures
    assert ("n", "recency", "Single", 1, -100.0, -100.0) in with_failures


def test_error_rows(spark):
    got = values(A.error_rows(judgements(spark), carry=["example_id"]), "example_id", "error_type")
    assert got == [
        ("1", "unnatural"),
        ("2", "trigger_retained"),
        ("4", "fact_damaged"),
        ("4", "unnatural"),
    ]
    sample = A.error_sample(judgements(spark), n=3)
    assert sample.count() == 3
    order = [(r["error_type"], r["bias_type"]) for r in sample.collect()]
    assert order == sorted(order)
    assert A.error_sample(judgements(spark), n=100).count() == 4


def test_cot_failures_and_pivot(spark):
    rows = [("m", "4_cot", "mixed"), ("m", "4_cot", "Positive"), ("m", "4_cot_clean", None), ("m", "2_no_defense", "x")]
    df = spark.createDataFrame(rows, "model string, condition string, predicted_sentiment string")
    failures = A.cot_format_failures(df)
    assert values(failures) == [("m", "4_cot", 2, 1, 50.0), ("m", "4_cot_clean", 1, 1, 100.0)]
    wide = A.pivot(failures, ["model"], "condition", ["4_cot", "4_cot_clean", "none"], ["total", "failure_rate_pct"])
    assert wide.columns == [
        "model", "4_cot_total", "4_cot_failure_rate_pct", "4_cot_clean_total", "4_cot_clean_failure_rate_pct",
        "none_total", "none_failure_rate_pct",
    ]


def test_null_rate(spark):
    df = spark.createDataFrame([("m", None), ("m", "a"), ("m", "b"), ("m", None)], "model string, x string")
    assert values(A.null_rate(df, "x")) == [("m", 4, 2, 50.0)]


def test_add_accuracy(spark):
    rows = [("m", "c", "positive", "positive"), ("m", "c", "neutral", None)]
    df = spark.createDataFrame(rows, "model string, condition string, label string, parsed_sentiment string")
    report = spark.createDataFrame([("m", "c", "x"), ("m", "d", "x")], "model string, condition string, class string")
    assert values(A.add_accuracy(report, df)) == [("m", "c", "x", 0.5), ("m", "d", "x", None)]


def test_rounding(spark):
    df = spark.createDataFrame([(0.0625,), (0.6666,)], "x double")
    assert values(A.rounded(df, 3, ["x"])) == [(0.062,), (0.667,)]


def test_report_layout(spark):
    rows = [("m", "c", "positive", "positive"), ("m", "c", "neutral", "negative")]
    df = spark.createDataFrame(rows, "model string, condition string, label string, parsed string")
    by = ["model", "condition"]
    out = A.report_layout(M.class_report(M.class_contingency(df, "label", "parsed", by), by=by))
    assert out.columns == ["model", "condition", "class", "precision", "recall", "f1-score", "support", "accuracy"]
    assert [r["class"] for r in out.collect()] == [
        "positive", "neutral", "negative", "accuracy", "macro avg", "weighted avg",
    ]
