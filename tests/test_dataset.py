import random
import re

import pytest
from pyspark.sql import functions as F

from cuelab.operators import dataset as D
from cuelab.operators.diversify import ALL_STEPS, AUTHORITY, OVERCONFIDENCE, Step, diversify, step
from tests.conftest import plan_of, values


def texts(spark, cases):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "example_id string, biased_sentence string")


def run(spark, steps, cases, **kw):
    out = diversify(texts(spark, cases), steps, **kw)
    return [r["biased_sentence"] for r in out.orderBy(F.col("example_id").cast("int")).collect()]


def test_first_find_of_the_list_and_first_occurrence(spark):
    z = step("z", OVERCONFIDENCE.finds, ["Z"])
    cases = [
        "a pattern expected to hold, expected to hold",
        "SET TO REMAIN\nset to remain",
        "nothing here",
        None,
        "poised to continue and showing no signs of changing",
        "a level showing no signs of changing",
    ]
    assert run(spark, [z], cases, probability=1.0) == [
        "a pattern Z, expected to hold",
        "Z\nset to remain",
        "nothing here",
        None,
        "poised to continue and Z",
        "a level Z",
    ]


def test_sources_come_before_phrases(spark):
    z = Step("z", AUTHORITY.finds, (("Z",),) * len(AUTHORITY.finds))
    cases = ["per UBS, as reported by Reuters", "paper Reuters", "by the S&P per s&p", "Reuters alone", "cited by JP  Morgan"]
    assert run(spark, [z], cases, probability=1.0) == [
        "per UBS, Z", "paZ", "by the S&P Z", "Reuters alone", "cited by JP  Morgan",
    ]


def test_unicode_case(spark):
    s = step("s", ["kiss"], ["-"])
    assert run(spark, [s], ["KISS", "Kiss kiss", "İ kiss"], probability=1.0) == ["-", "- kiss", "İ -"]


def test_special_characters(spark):
    s = step("s", ["a.b (c)"], [r"$1 \ {x}"])
    assert run(spark, [s], ["axb (c) A.B (C)!"], probability=1.0) == [r"axb (c) $1 \ {x}!"]


def test_probability(spark):
    cases = ["expected to hold"] * 2000
    assert run(spark, ALL_STEPS, cases, probability=0.0) == cases
    kept = sum(t == "expected to hold" for t in run(spark, [OVERCONFIDENCE], cases))
    assert 0.25 < kept / 2000 < 0.35
    seen = set(run(spark, [OVERCONFIDENCE], cases)) - {"expected to hold"}
    assert seen == set(OVERCONFIDENCE.options[0])
    assert run(spark, [OVERCONFIDENCE], cases, seed=1) != run(spark, [OVERCONFIDENCE], cases, seed=2)


def test_options_belong_to_their_find(spark):
    s = Step("s", ("one", "two"), (("1",), ("2", "zwei")))
    assert set(run(spark, [s], ["two"] * 50, probability=1.0)) == {"2", "zwei"}
    assert set(run(spark, [s], ["two one"] * 50, probability=1.0)) == {"two 1"}


def test_independent_of_partitions(spark):
    df = texts(spark, ["as reported by UBS, expected to hold, a modest rise"] * 200)
    assert values(diversify(df.repartition(1))) == values(diversify(df.repartition(7)))


def test_letters_that_are_ascii_in_another_case(spark):
    kiss, like = step("kiss", ["a kiss"], ["-"]), step("like", ["ßé like"], ["é$"])
    cases = ["é A KISS a kiss", "a kıss, a kiss", "ſ a kiſs a kiss", "a \u212aiss a kiss", "a kİss", "SSÉ ßÉ LIKE ßé like", "", None, "é"]
    wants = ["é - a kiss", "-, a kiss", "ſ - a kiss", "- a kiss", "a kİss", "SSÉ é$ ßé like", "", None, "é"]
    assert run(spark, [kiss, like], cases, probability=1.0) == wants


def test_a_text_is_not_gone_through_in_the_jvm_for_each_find(spark):
    plan = plan_of(diversify(texts(spark, ["a modest rise"])))
    assert plan.count("ArrowEvalPython") == 1
    assert "Contains(" not in plan and "lower(" not in plan


def test_later_steps_see_what_earlier_ones_wrote(spark):
    steps = [step("one", ["a"], ["É b"]), step("two", ["é B"], ["c"]), step("three", ["x"], ["y"])]
    assert run(spark, steps, ["-a-", "é b x"], probability=1.0) == ["-c-", "c y"]


def test_keep_last(spark):
    rows = [("c", "s1", 1), ("c", "s1", 3), ("c", "s2", 2), ("d", "s1", 4)]
    df = spark.createDataFrame(rows, "condition string, s string, seq long")
    kept = D.keep_last(df, ["condition", "s"], ["seq"])
    assert values(kept, "seq") == [(2,), (3,), (4,)]
    assert values(D.keep_last(kept, ["condition", "s"], ["seq"])) == values(kept)


def test_keep_last_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("seq"))
    plan = plan_of(D.keep_last(df, ["k"], ["seq"]))
    assert plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan[plan.rindex("WindowGroupLimit") :].split("\n")[0]


def test_keep_last_predictions(spark):
    rows = [
        ("m", "1_clean_baseline", "o", "x", 1),
        ("m", "1_clean_baseline", "o", "y", 2),
        ("m", "2_no_defense", "o", "x", 3),
        ("m", "2_no_defense", "p", "x", 4),
        ("m", "2_no_defense", "o", "y", 5),
        ("n", "2_no_defense", "o", "y", 6),
    ]
    df = spark.createDataFrame(rows, "model string, condition string, original_sentence string, biased_sentence string, seq int")
    assert values(D.keep_last_predictions(df), "seq") == [(2,), (4,), (5,), (6,)]


def test_shuffle_position_is_a_permutation(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("example_id"))
    out = D.shuffle_position(df.repartition(3))
    assert [r[0] for r in out.orderBy("position").select("position").collect()] == list(range(5000))
    in_order = [r[0] for r in out.orderBy("position").select("example_id").collect()]
    assert in_order == [r[0] for r in D.shuffled(df).collect()]
    assert in_order != sorted(in_order, key=int)
    assert values(out) == values(D.shuffle_position(df.repartition(8), digits=1))


def test_large_sample_moves_rows_once(spark):
    plan = plan_of(D.stratified_sample(strata(spark), "label", 1500))
    moves = re.findall(r"Exchange hashpartitioning\(__g#\d+, __slice#\d+,", plan[: plan.index("HashAggregate")])
    assert len(moves) == 2  # one per side of the join, none for the ranking
    assert "Broadcast" not in plan


def strata(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a"] * 8 + ["b"])) for i in range(9000)]
    return spark.createDataFrame(rows, "sentence_id long, label string")


@pytest.mark.parametrize("n", [1, 10, 1001, 1500, 20000])
def test_stratified_sample(spark, n):
    df = strata(spark)
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    sample = D.stratified_sample(df, "label", n)
    got = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    assert got == {label: min(n, size) for label, size in sizes.items()}
    assert sample.dropDuplicates(["sentence_id"]).count() == sample.count()
    assert D.stratified_sample(df.withColumn("label", F.nullif("label", F.lit("b"))), "label", n).count() == sample.count()
    # A larger sample contains a smaller one, whichever way it is drawn.
    small = {r[0] for r in D.stratified_sample(df, "label", 5).select("sentence_id").collect()}
    if n >= 5:
        assert small <= {r[0] for r in sample.select("sentence_id").collect()}


@pytest.mark.parametrize("n", [1, 100, 1200, 10**6])
def test_random_sample(spark, n):
    df = strata(spark)
    sample = D.random_sample(df.repartition(5), n, ["sentence_id", "label"])
    assert sample.count() == min(n, 9000)
    assert values(sample) == values(D.random_sample(df.repartition(3), n, ["sentence_id", "label"]))


def test_small_samples_are_cut_in_two_rounds(spark):
    plan = plan_of(D.stratified_sample(strata(spark), "label", 10))
    assert plan.count("row_number(), 10, Partial") == 2
    assert "Partial" in plan.split("Exchange")[1]  # the round over sets of tasks feeds the last one


def test_assemble(spark):
    base = spark.createDataFrame([(1, "s", "neutral")], "sentence_id long, sentence string, label string")
    injected = spark.createDataFrame(
        [("1:1", "s", "s!", "neutral", "herding", 7)],
        "example_id string, original_sentence string, biased_sentence string, label string, biases string, extra int",
    )
    assert values(D.assemble(injected, base)) == [
        ("1:0", "s", "s", "neutral", "none"),
        ("1:1", "s", "s!", "neutral", "herding"),
    ]


def test_union_fills_gaps(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2, 3)], "x int, y int")
    assert values(D.union_all([a, b])) == [(1, None), (2, 3)]


def test_keep_last_deals_rows_by_their_text_alone(spark):
    """With the digest of text, model and condition as the key each row shuffled a digest of its own."""
    texts = ["a", "b", None, "a", "c"]
    rows = [(m, c, t, t and t + "!", i) for i, t in enumerate(texts) for m in ("x", "y", None) for c in ("1_clean_baseline", "2_no_defense", "other")]
    df = spark.createDataFrame(rows, "model string, condition string, original_sentence string, biased_sentence string, seq int")
    want = {}
    for m, c, original, biased, seq in rows:
        if c != "other":
            want[m, c, original if c == "1_clean_baseline" else biased] = seq
    want = sorted(((m, c, seq) for (m, c, _), seq in want.items()), key=repr)
    for most in (100_000, 7, 0):  # no text, some texts, all texts are dealt by model and condition as well
        got = D.keep_last_predictions(df, rows_per_task=most)
        assert got.columns == df.columns and sorted(map(tuple, got.select("model", "condition", "seq").collect()), key=repr) == want
    dealt = [line for line in plan_of(D.keep_last_predictions(df)).split("\n") if "hashpartitioning" in line]
    assert dealt and all("model" not in line and "condition" not in line and "__text" in line for line in dealt)
