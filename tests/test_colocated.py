"""Stage tables in common buckets: the joins shuffle nothing, hot keys are spread, another session reads them."""

import pytest
from pyspark.sql import functions as F

from cuelab.operators.joins import attach_by_text, remaining
from cuelab.sources import colocated as B
from queries.registry import QUERIES
from tests.conftest import plan_of, values

SF = "/root/testdata/sf0.001"


def rows(spark):
    """A third of all rows under one key; missing cells, keys without results, results without rows."""
    data = [("m", f"t{i % 40}" if i % 3 else "hot", i) for i in range(3000)] + [("m", None, 5000), (None, "t1", 5001), ("m", "lonely", 5002), ("m", "", 5003)]
    return spark.createDataFrame(data, "model string, text string, example_id int")


def results(spark):
    data = [("m", f"t{i}", f"v{i}") for i in range(0, 40, 2)] + [("m", "hot", "vh"), ("m", None, "vn"), (None, "t1", "w"), ("m", "absent", "x"), ("m", "", None)]
    return spark.createDataFrame(data, "model string, text string, value string")


@pytest.fixture(params=[100, 10**6], ids=["spread", "plain"])
def tables(request, spark, tmp_path):
    one, other = str(tmp_path / "examples"), str(tmp_path / "results")
    B.write_examples(rows(spark), one, ["model", "text"], "example_id", 8, rows_per_task=request.param)
    B.write_results(results(spark), other, one)
    return one, other


def test_join_equals_the_plain_one(spark, tables):
    got = B.join_buckets(spark, *tables, ["model", "text", "example_id"], ["value"])
    same = F.col("a.model").eqNullSafe(F.col("b.model")) & F.col("a.text").eqNullSafe(F.col("b.text"))
    want = rows(spark).alias("a").join(results(spark).alias("b"), same, "left").select("a.*", "b.value")
    assert values(got) == values(want) and got.count() == 3004
    left = B.join_buckets(spark, *tables, ["model", "text", "example_id"], how="left_anti")
    assert values(left) == values(remaining(rows(spark), results(spark), ["model", "text"]))
    inner = B.join_buckets(spark, *tables, ["example_id"], ["value"], "inner")
    assert inner.count() == got.count() - left.count()
    by_text = attach_by_text(rows(spark), results(spark), ["value"], "text", every=True).select("model", "text", "example_id", "value")
    assert values(got.where("text is not null")) == values(by_text.where("text is not null"))


def test_nothing_is_shuffled(spark, tables):
    for how in ("left", "left_anti", "inner"):
        joined = B.join_buckets(spark, *tables, ["example_id"], ["value"] if how != "left_anti" else [], how)
        plan = plan_of(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2


@pytest.mark.parametrize("name", ["colocated_detections", "colocated_by_text", "colocated_resume"])
def test_the_queries_join_without_an_exchange(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_hot_keys_lie_in_several_buckets(spark, tables):
    salts = {r[0]: r[1] for r in B.read_buckets(spark, tables[0]).groupBy("text").agg(F.countDistinct(B.SALT)).collect()}
    spread = B._about(spark, tables[0])["heavy"] != []
    assert salts["hot"] == (10 if spread else 1) and salts["lonely"] == 1
    files = {r[0] for r in B.read_buckets(spark, tables[0]).where("text = 'hot'").select("_metadata.file_name").distinct().collect()}
    assert (len(files) > 1) == spread


def test_another_session_reads_the_buckets(spark, tables):
    other = spark.newSession()
    for path in tables:
        other.sql(f"DROP TABLE IF EXISTS {B._name(path)}")  # the files stay, as they do when a session ends
        assert not other.catalog.tableExists(B._name(path))
    joined = B.join_buckets(other, *tables, ["example_id"], ["value"])
    assert "Exchange" not in plan_of(joined) and joined.count() == 3004


def test_tables_of_other_buckets_are_refused(spark, tables, tmp_path):
    B.write_examples(rows(spark), str(tmp_path / "x"), ["model", "text"], "example_id", 4)
    with pytest.raises(ValueError):
        B.join_buckets(spark, str(tmp_path / "x"), tables[1], ["example_id"], ["value"])


def test_empty_tables(spark, tmp_path):
    one, other = str(tmp_path / "a"), str(tmp_path / "b")
    B.write_examples(rows(spark).limit(0), one, ["model", "text"], "example_id", 4)
    B.write_results(results(spark).limit(0), other, one)
    assert B.join_buckets(spark, one, other, ["example_id"], ["value"]).count() == 0
    B.write_examples(rows(spark), one, ["model", "text"], "example_id", 4)  # written anew
    B.write_results(results(spark).limit(0), other, one)
    assert B.join_buckets(spark, one, other, ["example_id"], how="left_anti").count() == 3004


def test_rows_of_an_example_are_dealt_together_and_told_apart(spark, tmp_path):
    """Each condition of an example had a digest of its own in files and shuffles."""
    rows = [(m, c, e) for m in ("x", None) for c in ("1", "2", None) for e in ("7:1", "7:2", None)]
    done = [("x", "1", "7:1"), (None, None, "7:1"), ("x", None, None), ("y", "1", "7:2")]
    schema, by = "model string, condition string, example_id string", ["model", "condition", "example_id"]
    for most in (100_000, 2):
        one, other = str(tmp_path / f"examples{most}"), str(tmp_path / f"done{most}")
        B.write_examples(spark.createDataFrame(rows, schema), one, by, "example_id", 4, rows_per_task=most)
        B.write_results(spark.createDataFrame(done, schema).withColumn("n", F.lit(1)), other, one)
        assert spark.read.parquet(one).select(B.KEY).distinct().count() == 3
        left = B.join_buckets(spark, one, other, by, how="left_anti")
        assert sorted(map(tuple, left.collect()), key=repr) == sorted((r for r in rows if r not in done), key=repr)
        assert "Exchange" not in plan_of(left)
        both = B.join_buckets(spark, one, other, by, ["n"])
        assert {tuple(r)[:3] for r in both.filter("n = 1").collect()} == set(rows) & set(done) and both.count() == len(rows)
