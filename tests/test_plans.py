from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelab.fixed_values import ALL_CONDITIONS, BIASED_CONDITIONS, CLEAN_CONDITIONS
from cuelab.operators import generate, jobs
from cuelab.plans.conditions import expand_conditions, sentiment_conditions, split_biased_clean
from cuelab.plans.injection import bias_plan, expand_first_calls, expand_models, expand_plan
from cuelab.plans.prompts import render
from tests.conftest import plan_of, values


def base_table(spark, positive, negative, neutral):
    labels = ["positive"] * positive + ["negative"] * negative + ["neutral"] * neutral
    rows = [(i, f"sentence {i}", label) for i, label in enumerate(labels)]
    return spark.createDataFrame(rows, "sentence_id long, sentence string, label string")


def test_combinations_per_sentence(spark):
    counts = expand_plan(base_table(spark, 1, 1, 1), bias_plan()).groupBy("label").count()
    assert values(counts) == [("negative", 22), ("neutral", 16), ("positive", 22)]


def test_size_of_the_published_dataset(spark):
    base = base_table(spark, 52, 49, 49)
    rows = expand_plan(base, bias_plan())
    assert rows.count() == 3006
    assert rows.filter("biases != 'none'").count() == 2856
    assert rows.filter("biases like 'framing%' and label = 'neutral'").count() == 0


def test_number_of_calls(spark):
    base = base_table(spark, 52, 49, 49)
    first = expand_first_calls(base, bias_plan(clean=False))
    second = first.select(F.inline("finish")).filter("stage2 is not null")
    assert first.count() + second.count() == 4457


def test_expansion_is_map_only(spark):
    plan = plan_of(expand_models(expand_plan(base_table(spark, 2, 2, 2), bias_plan()), ["a", "b"]))
    assert "Exchange" not in plan and "Join" not in plan


def test_render(spark):
    df = spark.createDataFrame([("has {b} inside", "B", None)], "a string, b string, n string")
    row = df.select(
        render("{{x}} {a} and {b}", {"a": F.col("a"), "b": F.col("b")}).alias("p"),
        render("{n}", {"n": F.col("n")}).alias("null"),
        render("say {n}!", {"n": F.col("n")}, missing="nan").alias("shown"),
        render("", {}).alias("empty"),
    ).first()
    assert tuple(row) == ("{x} has {b} inside and B", None, "say nan!", "")


def examples(spark):
    rows = [
        ("1", "o1", "o1", "none", "none", "d1", "g1"),
        ("2", "o2", "b2", "herding", "recency", "d2", "g2"),
        ("3", "o3", "b3", None, None, None, "g3"),
    ]
    return spark.createDataFrame(
        rows,
        "example_id string, original_sentence string, biased_sentence string, biases string, "
        "predicted_biases string, detected_bias_rewrite string, true_bias_rewrite string",
    )


def test_conditions_and_populations(spark):
    got = values(expand_conditions(examples(spark), sentiment_conditions()), "example_id", "condition")
    want = [("1", c) for c in CLEAN_CONDITIONS] + [(i, c) for i in "23" for c in BIASED_CONDITIONS]
    assert got == sorted(want, key=repr)


def test_finished_conditions_are_left_out_before_the_expansion(spark):
    rows = examples(spark).withColumn("model", F.lit("m"))
    whole = jobs.condition_prompts(rows)
    done = whole.filter("condition like '4%' or example_id = '3'").select("model", "condition", "example_id")
    left = jobs.condition_prompts(rows, done=done.unionByName(done))
    assert values(left.drop("prompt")) == values(whole.filter("condition not like '4%' and example_id <> '3'").drop("prompt"))
    assert "Exchange" not in plan_of(left).split("Generate")[0]
    empty = jobs.condition_prompts(rows, done=done.limit(0))
    assert values(empty) == values(whole)


def test_condition_prompts(spark):
    prompts = jobs.condition_prompts(examples(spark))
    by_key = {(r["example_id"], r["condition"]): r for r in prompts.collect()}
    assert "o1" in by_key["1", "1_clean_baseline"]["prompt"]
    assert "recency" in by_key["2", "5_targeted_detected"]["prompt"]
    assert "herding" in by_key["2", "6_targeted_gold"]["prompt"]
    assert "d2" in by_key["2", "7_rewrite_detected"]["prompt"]
    assert "g2" in by_key["2", "8_rewrite_gold"]["prompt"]
    assert by_key["3", "5_targeted_detected"]["prompt"] is None
    assert Counter(r["parser"] for r in by_key.values()) == {"cot": 3, "plain": 13}
    shown = jobs.condition_prompts(examples(spark), missing="nan").filter("example_id = '3' and condition like '5%'")
    assert "nan" in shown.first()["prompt"]


def test_some_conditions(spark):
    assert [c.name for c in sentiment_conditions(["4_cot", "2_no_defense"])] == ["2_no_defense", "4_cot"]
    assert [c.name for c in sentiment_conditions()] == ALL_CONDITIONS
    with pytest.raises(ValueError):
        sentiment_conditions(["9"])


def test_missing_cell_is_not_clean(spark):
    biased, clean = split_biased_clean(examples(spark))
    assert values(biased, "example_id") == [("2",), ("3",)] and values(clean, "example_id") == [("1",)]


def test_prompts_filled_in_by_the_worker_are_those_of_the_plan(spark):
    import json

    def echo(params):
        return lambda requests: [json.dumps([r.system, r.user]) for r in requests]

    texts = [("a 100 % {sentence} %s", "none", "herding"), ("b", "herding", None), (None, "anchoring", "none"), ("d", None, "x"), (None, "none", None)]
    rows = spark.createDataFrame(
        [(m, str(i % 4), t, t and t + "!", b, p, t and t + " gold", None if i == 1 else f"{m}{i}") for m in "xy" for i, (t, b, p) in enumerate(texts)],
        "model string, example_id string, original_sentence string, biased_sentence string, biases string, predicted_biases string, "
        "true_bias_rewrite string, detected_bias_rewrite string",
    )
    done = spark.createDataFrame([("x", "1", "2_no_defense"), ("x", "1", "2_no_defense"), ("y", "0", "1_clean_baseline"), ("z", "1", "4_cot"), ("x", None, "4_cot"), ("x", "3", None)], "model string, example_id string, condition string")
    once = generate.Params(attempts=1, backoff_s=0.0, batch_size=3)
    for missing in (None, "nan"):
        for finished in (None, done, done.limit(0)):
            for keep in (None, ["example_id"], ["model", "condition_ord", "example_id", "biased_sentence"]):
                prompts = jobs.condition_prompts(rows, missing=missing, done=finished, keep=keep)
                expected = jobs.condition_answers(prompts, echo, params=once)
                got = jobs.classify_under_conditions(rows, echo, params=once, missing=missing, done=finished, keep=keep)
                assert got.columns == expected.columns and got.dtypes == expected.dtypes
                assert values(got) == values(expected)
    marked = jobs.with_finished(rows, done)
    assert values(jobs.classify_under_conditions(marked, echo, params=once)) == values(jobs.classify_under_conditions(rows, echo, params=once, done=done))


def test_texts_go_to_python_once_for_all_conditions(spark):
    rows = examples(spark)
    out = jobs.classify_under_conditions(rows, lambda p: lambda rs: ["positive"] * len(rs), keep=["example_id"])
    plan = plan_of(out)
    assert "Generate" not in plan.split("MapInArrow", 1)[1] and "Sentence:" not in plan  # neither exploded nor rendered before Python
    done = rows.selectExpr("'m' as model", "example_id", "'4_cot' as condition")
    joined = plan_of(jobs.with_finished(rows.withColumn("model", F.lit("m")), done))
    dealt = [line for line in joined.split("\n") if "Exchange hashpartitioning" in line]
    assert dealt and all("model" not in line for line in dealt)


def test_examples_meet_what_is_finished_in_packed_sentences(spark, monkeypatch):
    """Texts were shuffled whole, once for each example and model of a sentence."""
    ids = ["1:1", "1:2", "1:2", "12:1", "a:b:1", "plain", "", None, ":"]
    rows = [(m, e, None if i == 3 else f"text {e} " * 50, [m or "", None], {"k": None}) for i, e in enumerate(ids) for m in ("x", "y", None)]
    df = spark.createDataFrame(rows, "model string, example_id string, `a text` string, labels array<string>, errors map<string,string>").coalesce(2)
    done = [("x", "1:2", "c1"), ("x", "1:2", "c2"), ("x", "1:2", "c1"), ("y", None, "c1"), (None, "12:1", "c3"), ("x", "plain", None), ("z", "1:1", "c1"), ("x", "2:1", "c1")]
    ended = spark.createDataFrame(done, "model string, example_id string, condition string")
    want = sorted(((*r, sorted(c for m, e, c in set(done) if (m, e) == r[:2] and c)) for r in rows), key=repr)

    def got(*parts):
        out = jobs.with_finished(*parts)
        assert out.columns == [*df.columns, jobs.FINISHED]
        return sorted(((*tuple(r)[:-1], sorted(r[-1] or [])) for r in out.collect()), key=repr)

    for most in (10_000, 0):  # dealt by sentences, by whole ids
        monkeypatch.setattr(jobs, "SENTENCE_ROWS", most)
        assert got(df, ended) == want
        assert got(df.limit(0), ended) == []
        assert [r[:-1] for r in got(df, ended.limit(0))] == [r[:-1] for r in want]
    plan = plan_of(jobs.with_finished(df, ended))
    assert "a text" not in plan.split("SortMergeJoin", 1)[1].split("MapInArrow", 1)[0]
