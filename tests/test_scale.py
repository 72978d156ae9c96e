"""What is shuffled, written and held stays small: keys of 16 bytes, one shuffle a side, bounded buckets, short slices."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuelab.operators import dataset as D
from cuelab.operators import joins as N
from cuelab.operators.joins import remaining
from cuelab.operators.generate import SLICE_BYTES, Call, Params, _arrow_caller, _slices, generate_distinct
from cuelab.operators.skew import key_digest
from cuelab.sources import colocated as B
from cuelab.sources import files, places
from cuelab.sources.batches import BatchTable
from tests.conftest import plan_of, values


@pytest.fixture
def texts(spark, tmp_path):
    rows = [("m" if i % 2 else None, f"e{i}", f"text {i % 40}" if i % 40 else None, i) for i in range(200)]
    spark.createDataFrame(rows, "model string, example_id string, text string, seq long").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_digests_tell_cells_apart_and_have_16_bytes(spark):
    rows = [("a", None), (None, "a"), ("", "a"), ("a", ""), (None, None), ("", ""), ("1:a", "b"), ("1", "ab")]
    keys = spark.createDataFrame(rows, "a string, b string").select(key_digest(["a", "b"]).alias("k"))
    found = {bytes(r["k"]) for r in keys.collect()}
    assert len(found) == len(rows) and {len(k) for k in found} == {16}


def test_results_by_text_are_shuffled_once(texts):
    out = N.attach_by_text(texts.drop("seq"), texts.select("model", "text", "seq"), ["seq"], "text", last_by=["seq"])
    assert plan_of(out).split("Initial Plan")[0].count("Exchange") == 2
    last = {}
    for r in texts.orderBy("seq").collect():
        last[r["model"], r["text"]] = r["seq"]
    assert all(r["seq"] == last[r["model"], r["text"]] and r["n_copies"] > 1 for r in out.collect())
    left = N.remaining_by_text(texts, texts.where("seq < 30"), "text", keys=["model"])
    assert plan_of(left).split("Initial Plan")[0].count("Exchange") == 2
    # a missing text and a missing model that are done cover the others
    done = {(r["model"], r["text"]) for r in texts.where("seq < 30").collect()}
    assert values(left, "example_id") == sorted((r["example_id"],) for r in texts.collect() if (r["model"], r["text"]) not in done)


def test_keep_last_predictions_goes_by_one_short_key(spark):
    rows = [("m", "2_no_defense", "o", "x", 1), (None, "2_no_defense", "o", "x", 2), ("m", "2_no_defense", "o", None, 3), ("m", "2_no_defense", "p", "x", 4)]
    df = spark.createDataFrame(rows, "model string, condition string, original_sentence string, biased_sentence string, seq int")
    kept = D.keep_last_predictions(df)
    assert values(kept, "seq") == [(2,), (3,), (4,)]
    (shuffle,) = [x for x in plan_of(kept).split("Initial Plan")[0].split("\n") if "Exchange" in x]
    assert shuffle.split("hashpartitioning(")[1].startswith("__text#") and "model#" not in shuffle


def test_tables_with_many_rows_get_more_buckets(spark, texts, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 20)
    examples, results = str(tmp_path / "examples"), str(tmp_path / "results")
    B.write_examples(texts, examples, ["model", "example_id"], "example_id", 4)
    B.write_results(texts.select("model", "example_id", "seq"), results, examples)
    assert B._about(spark, examples)["buckets"] == B._about(spark, results)["buckets"] == 10
    joined = B.join_buckets(spark, examples, results, ["example_id"], ["seq"])
    assert "Exchange" not in plan_of(joined)
    assert values(joined) == values(texts, "example_id", "seq")


def test_compressed_csv_comes_back(spark, tmp_path):
    rows = [(f"e{i}", "a line\nand \"quotes\", commas " * 200, None if i % 3 else "") for i in range(50)]
    df = spark.createDataFrame(rows, "id string, text string, cell string").coalesce(1)
    sizes = {}
    for how in ("none", "gzip"):
        path = str(tmp_path / how)
        files.write_csv(df, path, compression=how)
        back = files.scan_csv(spark, path, df.schema)
        assert values(back, "id", "text") == values(df, "id", "text")
        sizes[how] = sum((tmp_path / how / f).stat().st_size for f in places.files_below(spark, path) if f.startswith("part"))
    assert sizes["gzip"] * 10 < sizes["none"]


def test_long_arrow_batches_are_gone_through_in_slices():
    prompts = [f"{i} " + "x" * 3000 for i in range(5000)] + [None] * 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(5007)), pa.array(prompts)], names=["id", "prompt"])
    sent = []

    def factory(params):
        return lambda requests: sent.append(len(requests)) or [r.user.split()[0] for r in requests]

    run = _arrow_caller(factory, [Call("response")], Params(batch_size=32), ["id"], "error")
    out = list(run(iter([batch, batch.slice(0, 0), batch.slice(5000)])))
    assert max(b.nbytes for b in _slices(batch, 32)) < 2 * SLICE_BYTES and len(out) > 3
    got = pa.Table.from_batches(out).to_pydict()
    assert got["id"] == [*range(5007), *range(5000, 5007)]
    assert got["response"] == [*map(str, range(5000)), *[None] * 14] and set(got["error"]) == {None}
    assert sent == [32] * (5000 // 32) + [5000 % 32]  # as without slices


def test_batches_of_odd_names_find_their_places(spark, tmp_path):
    names = ["a b", "x:y", "ü%20", "1/2", None]
    df = spark.createDataFrame([(n, i) for n in names for i in range(3)], "model string, i int").repartition(2)
    table = BatchTable(spark, str(tmp_path / "t u" / "v%20w"), ["model"])
    assert table.commit(df, "nightly-all~1-00000001")
    assert values(spark.read.schema(df.schema).parquet(table.path), "i", "model") == values(df, "i", "model")
    assert table.commit(df.limit(0), "none")  # a batch without a row


def test_settings_of_file_systems_are_made_once(spark, tmp_path):
    places.exists(spark, str(tmp_path))
    first = places._SETTINGS[spark]
    assert places.exists(spark, str(tmp_path)) and places._SETTINGS[spark] is first


def test_equal_prompts_are_dropped_without_sorting_them(spark):
    df = spark.createDataFrame([(i, f"p{i % 3}") for i in range(9)] + [(9, None)], "id long, prompt string")
    out = generate_distinct(df, lambda p: lambda rs: [r.user + "!" for r in rs], Call("r"), Params(attempts=1), row_id="id")
    assert values(out, "id", "r") == sorted([(i, f"p{i % 3}!") for i in range(9)] + [(9, None)], key=repr)
    assert "SortAggregate" not in plan_of(out)


def test_keys_are_sorted_by_the_id_first(spark):
    rows = spark.createDataFrame([("m", c, str(i)) for c in "ab" for i in range(5)] + [(None, "a", None)], "model string, condition string, example_id string")
    done = rows.filter("condition = 'a' and (example_id is null or example_id < '3')")
    left = remaining(rows, done)
    assert values(left) == sorted(r for r in values(rows) if r[1] == "b" or r[2] in ("3", "4"))
    sorts = [line for line in plan_of(left).split("\n") if "Sort [" in line]
    assert sorts and all(line.split("Sort [", 1)[1].startswith("coalesce(example_id") for line in sorts)
