import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuelab.operators import joins as N
from cuelab.operators.skew import heavy_keys, hot_keys, salted_join
from tests.conftest import plan_of, values


def skewed(spark, n=3000):
    """A third of all rows on one key, some on the missing key."""
    rng = random.Random(4)
    keys = [None if i % 50 == 0 else "hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}" for i in range(n)]
    return spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")


def lookup(spark):
    rows = [(f"k{i}", i) for i in range(0, 500, 2)] + [("hot", -1), (None, -2)]
    return spark.createDataFrame(rows, "k string, v int")


@pytest.mark.parametrize("rows_per_task", [7, 100, 10**6])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how, rows_per_task):
    left, right = skewed(spark), lookup(spark)
    plain = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), how)
    want = plain.select("l.id", "l.k", "r.v") if how in ("left", "inner") else plain
    got = salted_join(left, right, ["k"], how, row_id="id", rows_per_task=rows_per_task)
    assert values(got) == values(want)


def test_salted_join_spreads_the_hot_key(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = salted_join(skewed(spark), lookup(spark), ["k"], "left", row_id="id", rows_per_task=50)
        sizes = out.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count()
        sizes = [r["count"] for r in sizes.collect()]
        plan = plan_of(out)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    assert "SortMergeJoin" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    # What is broadcast is the list of hot keys, cut to its size when it was found: no scan stands under it.
    under = plan.split("BroadcastExchange")[1:]
    assert under and len(heavy_keys(skewed(spark).select(F.xxhash64("k").alias("h")), "h", 0, k=3)) == 3
    assert plan.count("Scan ExistingRDD[__h#") + plan.count("LocalTableScan [__h#") >= 1


def test_several_keys_do_not_run_together(spark):
    a = spark.createDataFrame([(1, "1", "11"), (2, "11", "1"), (3, None, "-"), (4, "-", None)], "id int, a string, b string")
    b = spark.createDataFrame([("1", "11", "x"), (None, "-", "y")], "a string, b string, v string")
    got = salted_join(a, b, ["a", "b"], row_id="id")
    assert values(got, "id", "v") == [(1, "x"), (2, None), (3, "y"), (4, None)]


def test_hot_keys_are_bounded_and_repeatable(spark):
    df = skewed(spark)
    assert hot_keys(df, "k", 0, 3).count() == 3
    assert values(hot_keys(df.repartition(7), "k", 0, 20)) == values(hot_keys(df.repartition(2), "k", 0, 20))
    assert values(hot_keys(df, "k", 500)) == [("hot", df.filter("k = 'hot'").count())]
    assert hot_keys(df, "k").count() == 0


def test_heavy_keys_by_sketch(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-7)).otherwise(F.col("id")).alias("k"))
    assert heavy_keys(df, "k", 500) == [(-7, 10_000)]
    assert heavy_keys(df, "k", 20_000) == heavy_keys(df.limit(0), "k", 0) == []
    [(key, n)] = heavy_keys(df.repartition(5), "k", 500, k=3, tracked=64)  # far fewer counters than keys
    assert key == -7 and abs(n - 10_000) < 2_000


def test_salting_does_not_change_the_rows(spark):
    df = skewed(spark).withColumn("id", F.monotonically_increasing_id())
    right = df.select("k").distinct().withColumn("v", F.concat(F.lit("v"), "k"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        few = right.filter("k <> 'hot'") if how == "left_anti" else right
        salted = salted_join(df, few, ["k"], how, row_id="id", rows_per_task=10)
        plain = salted_join(df, few, ["k"], how, row_id="id")
        assert "__salt" in plan_of(salted) and "__salt" not in plan_of(plain)
        assert values(salted) == values(plain)


def test_attach(spark):
    ex = spark.createDataFrame([("m", "1"), ("m", "2")], "model string, example_id string")
    res = spark.createDataFrame([("m", "1", "x", 0), ("n", "2", "y", 0)], "model string, example_id string, v string, w int")
    assert values(N.attach(ex, res, ["v"])) == [("m", "1", "x"), ("m", "2", None)]


def test_attach_by_text_is_the_left_join_with_copies_counted(spark):
    rng = random.Random(9)
    ex = [("m", str(i), rng.choice(["a", "b", "c", None])) for i in range(60)]
    res = [("m", rng.choice(["a", "b", "d", None]), rng.choice(["x", "y", None])) for _ in range(40)]
    e = spark.createDataFrame(ex, "model string, example_id string, biased_sentence string")
    r = spark.createDataFrame(res, "model string, biased_sentence string, v string")
    got = Counter()
    for row in N.attach_by_text(e, r, ["v"], every=True).collect():
        got[row["example_id"], row["v"]] += row["n_copies"]
    want = Counter()
    for _, i, text in ex:
        hits = [v for _, t, v in res if t == text]
        for v in hits or [None]:
            want[i, v] += 1
    assert got == want


def test_copies_do_not_multiply(spark):
    text = spark.range(2000).select(F.lit("m").alias("model"), F.col("id").cast("string").alias("example_id"), F.lit("same").alias("biased_sentence"))
    found = text.select("model", "biased_sentence", (F.col("example_id").cast("int") % 4).alias("v"))
    out = N.attach_by_text(text, found, ["v"], rows_per_task=100, every=True)
    assert out.count() == 8000
    assert out.agg(F.sum("n_copies")).first()[0] == 2000 * 2000
    own = text.select("model", "biased_sentence", F.col("example_id").cast("int").alias("seq"), F.concat(F.lit("r"), "example_id").alias("v"))
    out = N.attach_by_text(text, own, ["v"], rows_per_task=100, last_by=["seq"])
    assert values(out.select("v", "n_copies").distinct()) == [("r1999", 2000)] and out.count() == 2000
    assert N.attach_by_text(text, own, ["v"]).select("v").distinct().count() == 1


def test_remaining(spark):
    todo = spark.createDataFrame([("m", "c", "1"), ("m", "c", "2"), ("m", "d", "1"), ("m", None, "3")], "model string, condition string, example_id string")
    done = spark.createDataFrame([("m", "c", "1"), ("m", "c", "1"), ("m", None, "3")], "model string, condition string, example_id string")
    assert values(N.remaining(todo, done)) == [("m", "c", "2"), ("m", "d", "1")]
    assert values(N.remaining(todo, done.limit(0))) == values(todo)


def test_remaining_by_text(spark):
    schema = "model string, condition string, example_id string, t string"
    todo = spark.createDataFrame([("m", "c", str(i), t) for i, t in enumerate(["a", "b", None, "a"])], schema)
    done = spark.createDataFrame([("m", "c", "9", "a"), ("m", "c", "8", None), ("m", "d", "7", "b")], schema)
    assert values(N.remaining_by_text(todo, done, "t"), "t") == [("b",)]


def test_stage_joins_never_broadcast_by_estimate(spark):
    ex = spark.createDataFrame([("m", "c", "1", "t")], "model string, condition string, example_id string, biased_sentence string")
    for df in (N.remaining(ex, ex), N.attach(ex, ex.withColumn("v", F.lit(1)), ["v"])):
        assert "SortMergeJoin" in plan_of(df) and "Broadcast" not in plan_of(df)


def test_reindex(spark):
    df = spark.createDataFrame([("a", 1), ("z", 2)], "model string, n int")
    got = [tuple(r) for r in N.reindex(df, "model", ["b", "a"]).select("model_ord", "model", "n").collect()]
    assert got == [(0, "b", None), (1, "a", 1)]


def test_remaining_by_text_deals_rows_by_their_text_alone(spark):
    """With the digest of text, model and condition as the key each row shuffled a digest of its own."""
    todo = [(m, c, t, f"{m}{c}{t}{i}") for m in ("x", None) for c in ("1", "2") for t in ("a", "b", None) for i in (0, 1)]
    done = [("x", "1", "a"), ("x", "1", "a"), (None, "2", None), ("x", None, "b"), ("z", "2", "b")]
    t = spark.createDataFrame(todo, "model string, condition string, text string, example_id string")
    d = spark.createDataFrame(done, "model string, condition string, text string")
    want = sorted((r for r in todo if r[:3] not in done), key=repr)
    for most in (100_000, 1):
        got = N.remaining_by_text(t, d, "text", rows_per_task=most)
        assert got.columns == t.columns and sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted(map(tuple, N.remaining_by_text(t, d.limit(0), "text").collect()), key=repr) == sorted(todo, key=repr)
    plan = plan_of(N.remaining_by_text(t, d, "text"))
    assert all("model" not in line and "condition" not in line for line in plan.split("\n") if "hashpartitioning" in line)
