"""Which files of which folders are read, told by their names alone."""

import os

import pytest
from pyspark.sql import functions as F

from cuelab.operators import analysis as A
from cuelab.sources import discovery as S
from tests.conftest import plan_of, values

FILES = {
    "b/debiased_sentences_2.csv": 2, "b/debiased_sentences_10.csv": 10, "b/debiased_sentences_.csv.bak": 9, "b/predictions_b.csv": 1, "b/report_b.csv": 1,
    "a x/predictions_a x.csv": 1, "a x/report_b.csv": 7, "c+é%/debiased_sentences_[1]*.csv": 3, "c+é%/predictions_c+é%.csv": 4, "c+é%/report_c+é%.csv": 5,
    "skipped/debiased_sentences_1.csv": 8, "_hidden/debiased_sentences_1.csv": 6, "b/deep/debiased_sentences_0.csv": 6, "b/_debiased_sentences_0.csv": 6, "top.csv": 6,
    "e/debiased_sentences_1.csv": 0,
}


@pytest.fixture
def root(tmp_path):
    for name, n in FILES.items():
        path = tmp_path / "r" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x\n" + "".join(f"{n}\n" for _ in range(n)))
    (tmp_path / "r" / "empty").mkdir()
    return str(tmp_path / "r")


def test_manifest_lists_one_level_and_reads_nothing(spark, root):
    m = S.file_manifest(spark, root)
    got = {f"{r.model}/{r.name}": r.size for r in m.collect()}
    visible = {f for f in FILES if f.count("/") == 1 and not f.startswith("_") and "/_" not in f}
    assert set(got) == visible and got["b/debiased_sentences_2.csv"] == os.path.getsize(f"{root}/b/debiased_sentences_2.csv")
    assert "content" not in plan_of(m)


def test_first_file_of_each_folder(spark, root):
    m = S.file_manifest(spark, root)
    first = values(S.first_files(m, "debiased_sentences_*.csv", skip=["skipped"]), "model", "name")
    assert first == [("b", "debiased_sentences_10.csv"), ("c+é%", "debiased_sentences_[1]*.csv"), ("e", "debiased_sentences_1.csv")]
    d = S.discover_first(spark, root, _schema(spark), "debiased_sentences_*.csv", skip=["skipped"])
    assert values(d.groupBy("model", "x").count()) == [("b", "10", 10), ("c+é%", "3", 3)]


def test_large_files_without_line_breaks_in_cells_are_split(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "p_m.csv").write_text("x,y\n" + "".join(f'{i},"a,{i}"\n' for i in range(5000)) + ",\n")
    schema = spark.createDataFrame([], "x string, y string").schema
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        first = S.discover_first(spark, str(tmp_path), schema, "p_*.csv", multiLine=False)
        whole = S.discover_complete(spark, str(tmp_path), {"p": ("p_{model}.csv", schema)}, multiLine=False)[0]["p"]
        for d in (first, whole):
            per = d.groupBy(F.spark_partition_id()).count().collect()
            assert len(per) > 4 and max(r["count"] for r in per) < 2500
            assert sorted(d.collect(), key=str) == sorted(S.discover_first(spark, str(tmp_path), schema, "p_*.csv").collect(), key=str)
            assert d.count() == 5001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _schema(spark):
    return spark.createDataFrame([], "x string").schema


def test_folders_with_all_files(spark, root):
    needed = {"p": ("predictions_{model}.csv", _schema(spark)), "r": ("report_{model}.csv", _schema(spark))}
    tables, report = S.discover_complete(spark, root, needed)
    assert values(tables["p"]) == [("1", "b")] + [("4", "c+é%")] * 4
    assert values(tables["r"].distinct()) == [("1", "b"), ("5", "c+é%")]
    assert values(report.select("model", F.array_join("missing", ","))) == [
        ("a x", "r"), ("b", ""), ("c+é%", ""), ("e", "p,r"), ("skipped", "p,r"),
    ]
    tables, _ = S.discover_complete(spark, root, needed, skip=["b", "c+é%"])
    assert tables["p"].columns == ["x", "model"] and tables["p"].count() == 0


def test_nothing_there(spark, root, tmp_path):
    assert S.file_manifest(spark, f"{root}/empty").count() == 0
    assert S.file_manifest(spark, str(tmp_path / "absent")).count() == 0
    assert S.discover_first(spark, str(tmp_path / "absent"), _schema(spark), "*.csv").count() == 0


def test_patterns():
    with pytest.raises(ValueError):
        S._like("a*b*c", F.lit("m"))


# --- samples of errors


def judged(spark, rows, bad):
    """Every ``bad``-th row has an error or more."""
    data = [("m", str(i), "anchoring", *[0 if i % bad == 0 and i % (s + 2) == 0 else 1 for s in range(3)], f"o{i}", f"b{i}", f"r{i}") for i in range(rows)]
    return spark.createDataFrame(
        data, "model string, example_id string, biases string, trigger_removed int, facts_preserved int, natural_language int, "
        "original_sentence string, biased_sentence string, detected_bias_rewrite string",
    )


@pytest.mark.parametrize("rows, bad, n", [(3000, 1, 5), (3000, 1, 100), (3000, 500, 5), (3000, 500, 100), (50, 1, 100), (0, 1, 10), (400, 1000, 3)])
def test_error_sample_is_that_of_a_full_sort(spark, rows, bad, n):
    df = judged(spark, rows, bad)
    errors = A.error_rows(df, carry=["model", "example_id"])
    want = values(A.random_sample(errors, n, ["model", "example_id", "error_type"], 42), "example_id", "error_type", "model_rewrite")
    got = A.error_sample(df, n)
    assert values(got, "example_id", "error_type", "model_rewrite") == want and len(want) == min(n, errors.count())
    assert got.columns == errors.columns
