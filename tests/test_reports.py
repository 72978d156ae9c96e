"""Totals over groups, failures carried from stage to stage, limits handed to the backend."""

import pytest
from pyspark.sql import functions as F

from cuelab.operators import analysis as A
from cuelab.operators import detection as T
from cuelab.operators import jobs as J
from cuelab.operators import metrics as M
from cuelab.operators.generate import Call, Params, generate
from queries import recipe as R
from tests.conftest import plan_of, values

SF = "/root/testdata/sf0.001"


def predictions(spark):
    data = [("a", "c", "positive", "positive", 5), ("a", "c", "negative", "positive", 2), ("b", "c", "positive", None, 3), ("b", "d", "neutral", "neutral", 4), (None, "c", "neutral", "odd", 1)]
    rows = [r[:4] for r in data for _ in range(r[4])]
    return spark.createDataFrame(rows, "model string, condition string, label string, parsed_sentiment string")


def test_totals_are_the_report_of_all_rows(spark):
    p = predictions(spark)
    got = A.report_with_accuracy(p, totals=["model"])
    by_hand = A.report_with_accuracy(p.withColumn("model", F.lit(M.ALL)))
    assert values(got.filter(F.col("model") == M.ALL)) == values(by_hand)
    assert values(got.filter(~F.col("model").eqNullSafe(M.ALL))) == values(A.report_with_accuracy(p))
    both = A.report_with_accuracy(p, totals=["model", "condition"])
    assert values(both.filter(F.col("condition") == M.ALL).select("accuracy").distinct()) == [(9 / 15,)]


def test_totals_read_the_rows_once(spark):
    p = R.predictions(spark, SF)
    assert plan_of(A.report_with_accuracy(p, totals=["model"])).count("FileScan") == 1
    assert plan_of(T.detection_report(R.detection_cells(spark, SF), totals=["model"])).count("FileScan") == 1


def test_totals_of_detections(spark):
    d = R.detection_cells(spark, SF)
    got = T.detection_report(d, totals=["model"])
    assert values(got.filter(F.col("model") == M.ALL)) == values(T.detection_report(d.withColumn("model", F.lit(M.ALL))))
    assert got.filter(F.col("model") != M.ALL).count() == 33


def test_totals_over_a_column_that_is_no_group(spark):
    with pytest.raises(ValueError):
        A.report_with_accuracy(predictions(spark), totals=["biases"])


def echo(*bad):
    """Answers with the prompt; refuses those that hold one of these words."""

    def factory(params):
        def call(requests):
            for r in requests:
                if any(b in r.user for b in bad):
                    raise RuntimeError(f"refused {len(requests)}")
            return [r.user for r in requests]

        return call

    return factory


ONCE = Params(attempts=1, backoff_s=0.0, batch_size=1)


def examples(spark):
    rows = [("m", str(i), f"orig{i}", f"text{i}" + (" xdetect" if i == 1 else " xrewrite" if i == 2 else " xsent" if i == 3 else ""), "positive", "herding") for i in range(5)]
    return spark.createDataFrame(rows, "model string, example_id string, original_sentence string, biased_sentence string, label string, biases string")


def pipeline(spark, df):
    d = J.detect(df, echo("xdetect"), params=ONCE)
    r = J.rewrite(d, echo("xrewrite"), params=ONCE)
    return d, r


def test_failures_are_told_by_stage(spark):
    d, r = pipeline(spark, J.with_errors(examples(spark)))
    errors = {x.example_id: x.errors for x in d.collect()}
    assert errors == {"0": {}, "1": {"detect": "raw_model_response: RuntimeError: refused 1"}, "2": {}, "3": {}, "4": {}}
    p = J.classify_under_conditions(r, echo("xsent"), params=ONCE, keep=["model", "example_id", "label"])
    assert "errors" in p.columns
    rows = {(x.example_id, x.condition): x for x in p.collect()}
    assert set(rows["1", "5_targeted_detected"].errors) == {"detect", "sentiment"}  # no labels, so no prompt
    assert rows["1", "5_targeted_detected"].errors["sentiment"] == J.NOT_ASKED
    assert set(rows["2", "2_no_defense"].errors) == {"rewrite"} and rows["2", "2_no_defense"].error is None
    assert set(rows["2", "8_rewrite_gold"].errors) == {"rewrite", "sentiment"}
    assert set(rows["3", "2_no_defense"].errors) == {"sentiment"} and rows["3", "2_no_defense"].parsed_sentiment is None
    assert rows["0", "2_no_defense"].errors == {}
    by = {x.condition: x for x in A.failures_by_stage(p, ["condition"]).collect()}
    assert (by["2_no_defense"].rows, by["2_no_defense"].missing, by["2_no_defense"].failed_detect, by["2_no_defense"].failed_sentiment) == (5, 3, 1, 1)
    assert by["8_rewrite_gold"].failed_sentiment == 2 and by["8_rewrite_gold"].failed_judge == 0
    j = J.judge(r, echo("xjudge", "text4"), params=ONCE)
    assert {x.example_id: sorted(x.errors) for x in j.collect()} == {"0": [], "1": ["detect"], "2": ["rewrite"], "3": [], "4": ["judge"]} | {"1": ["detect"]}


def test_without_the_map_nothing_changes(spark):
    d, r = pipeline(spark, examples(spark))
    assert "errors" not in d.columns and "errors" not in r.columns and d.filter("error is not null").count() == 1


def test_a_stored_error_is_taken_along_and_a_new_one_replaces_it(spark):
    d = J.detect(examples(spark), echo("xdetect"), params=ONCE).drop("raw_model_response", "predicted_biases")
    noted = J.with_errors(d, "detect")
    assert {x.example_id: sorted(x.errors) for x in noted.collect()}["1"] == ["detect"]
    again = J.detect(noted, echo("text0"), params=ONCE)
    assert {x.example_id: sorted(x.errors) for x in again.collect()} == {"0": ["detect"], "1": [], "2": [], "3": [], "4": []}
    assert J.with_errors(noted).columns == noted.columns


def test_failed_calls_are_support_but_never_right(spark):
    d = J.detect(J.with_errors(examples(spark)), echo("xdetect", "xsent"), params=ONCE)
    r = {x["class"]: x for x in T.detection_report(d).collect()}
    assert r["herding"].support == 5 and r["none"].recall == 0 and r["herding"].recall == 0.0
    good = J.detect(J.with_errors(examples(spark)), lambda p: lambda rs: ["herding"] * len(rs), params=ONCE)
    assert {x["class"]: x for x in T.detection_report(good).collect()}["herding"].recall == 1.0


def test_limits_reach_the_backend(spark):
    def telling(params):
        return lambda requests: [f"{params.max_in_tokens} {params.max_out_tokens} {params.temperature} {params.top_k}" for _ in requests]

    df = spark.createDataFrame([("p",)], "prompt string")
    out = generate(df, telling, [Call("r")], Params(max_in_tokens=7, max_out_tokens=9, temperature=0.5, top_k=3))
    assert out.first()["r"] == "7 9 0.5 3"
