import pytest
from pyspark.sql import functions as F

from cuelab.operators import jobs as J
from cuelab.operators.generate import Call, Params, classify, generate, generate_distinct
from cuelab.plans.injection import bias_plan
from tests.conftest import values

QUICK = Params(backoff_s=0.0, batch_size=4)


def echo(params):
    return lambda requests: [f" {r.system}>{r.user} " for r in requests]


def prompts(spark, n=50):
    return spark.range(n).select(F.col("id").cast("string").alias("example_id"), F.concat(F.lit("p"), "id").alias("prompt"))


def test_one_answer_per_row(spark):
    df = prompts(spark)
    want = [(str(i), f"s>p{i}", None) for i in range(50)]
    for parts in (1, 8):
        out = generate(df, echo, [Call("r", "prompt", "s")], QUICK, partitions=parts, spread_by=["example_id"], drop=["prompt"])
        assert values(out, "example_id", "r", "error") == sorted(want, key=repr)
        assert out.columns == ["example_id", "r", "error"]


def test_several_calls_in_one_pass(spark):
    df = spark.createDataFrame([("a", "b", "x"), ("c", None, "y")], "p string, q string, s string")
    out = generate(df, echo, [Call("r1", "p", system_col="s"), Call("r2", "q", "t")], QUICK)
    assert values(out, "r1", "r2", "error") == [("x>a", "t>b", None), ("y>c", None, None)]
    assert str(out._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1


def test_only_real_prompts_are_sent(spark, tmp_path):
    log = str(tmp_path / "sent")

    def counting(params):
        def call(requests):
            with open(log, "a") as f:
                f.writelines(r.user + "\n" for r in requests)
            return [r.user for r in requests]

        return call

    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "prompt string").coalesce(1)
    assert values(generate(df, counting, [Call("r")], QUICK), "r") == [("a",), ("a",), ("b",), (None,)]
    assert sorted(open(log).read().split()) == ["a", "a", "b"]


def test_stop_strings(spark):
    params = Params(stop=("<end>", "p"), backoff_s=0.0)
    out = generate(prompts(spark, 1), lambda p: lambda rs: [" p0 <end> " for _ in rs], [Call("r")], params)
    assert values(out, "r") == [("0 ",)]


def refuse(word):
    def factory(params):
        def call(requests):
            if any(word in r.user for r in requests):
                raise RuntimeError("no")
            return [r.user for r in requests]

        return call

    return factory


def test_a_bad_prompt_does_not_take_others_down(spark):
    out = generate(prompts(spark, 20), refuse("7"), [Call("r")], QUICK)
    bad = {"7", "17"}
    for r in out.collect():
        if r["example_id"] in bad:
            assert r["r"] is None and r["error"] == "r: RuntimeError: no"
        else:
            assert r["r"] == r["prompt"] and r["error"] is None


def test_fail_fast(spark):
    with pytest.raises(Exception, match="RuntimeError"):
        generate(prompts(spark, 20), refuse("7"), [Call("r")], Params(backoff_s=0.0, fail_fast=True)).collect()


def test_retries(spark):
    def flaky(params):
        state = {"n": 0}

        def call(requests):
            state["n"] += 1
            if state["n"] % 3:
                raise OSError("again")
            return [r.user for r in requests]

        return call

    out = generate(prompts(spark, 30).coalesce(1), flaky, [Call("r")], QUICK)
    assert out.filter("error is not null or r != prompt").count() == 0
    once = Params(backoff_s=0.0, attempts=1, batch_size=100)
    assert generate(prompts(spark, 30).coalesce(1), flaky, [Call("r")], once).filter("error is not null").count() == 20


def test_wrong_number_of_answers_is_an_error(spark):
    out = generate(prompts(spark, 3), lambda p: lambda rs: [], [Call("r")], QUICK)
    assert out.filter("error like 'r: ValueError%'").count() == 3


def test_distinct_prompts_are_sent_once(spark, tmp_path):
    log = str(tmp_path / "sent")

    def counting(params):
        def call(requests):
            with open(log, "a") as f:
                f.writelines(f"{r.system}|{r.user}\n" for r in requests)
            return [r.user.upper() for r in requests]

        return call

    rows = [(i, ["hot", "a", "b"][i % 3] if i % 5 else None, "s" if i % 2 else "t") for i in range(90)]
    df = spark.createDataFrame(rows, "id int, prompt string, sys string")
    out = generate_distinct(df, counting, Call("r", "prompt", system_col="sys"), QUICK, row_id="id")
    assert values(out, "id", "r") == sorted(((i, p.upper() if p else None) for i, p, _ in rows), key=repr)
    sent = open(log).read().split()
    assert len(sent) == len(set(sent)) == 6


def test_classify(spark):
    df = spark.createDataFrame([("good",), ("bad",), ("?",), (None,)], "t string")

    def make():
        return lambda texts: [{"good": "Positive", "bad": "Negative"}.get(t, "Odd") for t in texts]

    out = classify(df, "t", make, {"Positive": "positive", "Negative": "negative"}, out_col="c", batch_size=2)
    assert values(out, "t", "c") == [("?", None), ("bad", "negative"), ("good", "positive"), (None, None)]


def base(spark):
    rows = [(1, "up", "positive"), (2, "down", "negative"), (3, "flat", "neutral")]
    return spark.createDataFrame(rows, "sentence_id long, sentence string, label string")


def tagged(params):
    # One mark per call, and a line break that the second call must not see.
    return lambda requests: [f"<{r.user}\n>" for r in requests]


@pytest.fixture(scope="module")
def tiny_templates():
    from cuelab.plans.prompts import InjectionTemplates

    cues = {c: c + ":{sentence}" for c in ("anchoring", "authority", "herding", "recency", "overconfidence")}
    framing = {"positive": "neg:{sentence}", "negative": "pos:{sentence}"}
    return {"main": InjectionTemplates("sys", cues, framing)}


def test_injection(spark, tiny_templates):
    out = J.inject(base(spark), tagged, templates=tiny_templates)
    got = {(r["original_sentence"], r["biases"]): r["biased_sentence"] for r in out.collect()}
    assert len(got) == 21 + 21 + 15
    assert got["up", "herding"] == "<herding:up\n>"
    assert got["up", "framing"] == "<neg:up\n>"
    assert got["down", "framing,recency"] == "<recency:<pos:down>\n>"
    assert got["flat", "anchoring,herding"] == "<herding:<anchoring:flat>\n>"
    assert out.filter("error is not null").count() == 0


def test_injection_without_original_texts(spark, tiny_templates, monkeypatch):
    whole = J.inject(base(spark), tagged, templates=tiny_templates)
    written = []
    monkeypatch.setattr(J, "materialise", lambda df, label: written.append(df.columns) or df)
    lean = J.inject(base(spark), tagged, templates=tiny_templates, original=False)
    assert written and all("original_sentence" not in c for c in written)
    assert lean.columns == [c for c in whole.columns if c != "original_sentence"]
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.drop("original_sentence").collect()))


def test_injection_calls_are_counted(spark, tiny_templates, tmp_path):
    log = str(tmp_path / "sent")

    def counting(params):
        def call(requests):
            with open(log, "a") as f:
                f.writelines("x\n" for _ in requests)
            return ["y" for _ in requests]

        return call

    J.inject(base(spark), counting, templates=tiny_templates).collect()
    shared = len(open(log).read().split())
    # 5 singles + 10 first + 10 second calls each; framing of two sentences: 1 + 1 + 5 each.
    assert shared == 3 * 25 + 2 * 7
    open(log, "w").close()
    J.inject(base(spark), counting, templates=tiny_templates, reuse_first_stage=False).collect()
    assert len(open(log).read().split()) == 3 * 25 + 2 * 11


def test_failed_second_call_is_no_sentence(spark, tiny_templates):
    out = J.inject(base(spark), refuse("recency:up"), bias_plan(clean=False), templates=tiny_templates,
                   params=Params(backoff_s=0.0))
    failed = out.filter("error is not null")
    # One single, and the second calls do not hold the text "recency:up" but the first answers.
    assert values(failed, "biases", "biased_sentence") == [("recency", None), ("recency,overconfidence", None)]


def test_stages_end_to_end(spark):
    rows = [("1", "o", "b herding", "positive", "herding"), ("2", "o", "o", "positive", "none"), ("3", "q", "c", "neutral", None)]
    ds = spark.createDataFrame(rows, "example_id string, original_sentence string, biased_sentence string, label string, biases string")

    def detector(params):
        return lambda rs: ["Herding!" if "b herding" in r.user else "none" for r in rs]

    found = J.detect(ds, detector)
    assert values(found, "example_id", "predicted_biases") == [("1", ["herding"]), ("2", ["none"]), ("3", ["none"])]

    rewritten = J.rewrite(found, lambda p: lambda rs: [r.user.split("\n")[0] for r in rs])
    assert values(rewritten, "example_id", "true_bias_rewrite", "detected_bias_rewrite") == [
        ("1", "Cues to take out: herding", "Cues to take out: herding"),
        ("2", "Cues to take out: none", "Cues to take out: none"),
        ("3", None, "Cues to take out: none"),
    ]
    judged = J.judge(rewritten, lambda p: lambda rs: ['{"trigger_removed":1}' for _ in rs])
    assert values(judged, "example_id", "trigger_removed", "facts_preserved") == [("1", 1, 0), ("3", 1, 0)]
    gold = J.judge(rewritten, lambda p: lambda rs: [r.user for r in rs], labels_col="biases", rewrite_col="true_bias_rewrite")
    assert gold.filter("example_id = '3'").first()["judge_response"] is None

    answers = J.classify_under_conditions(rewritten, lambda p: lambda rs: ["positive. FINAL ANSWER: negative" for _ in rs])
    got = {(r["example_id"], r["condition"]): r["parsed_sentiment"] for r in answers.collect()}
    assert len(got) == 2 + 7 + 7
    assert got["1", "4_cot"] == got["2", "4_cot_clean"] == "negative" and got["1", "2_no_defense"] == "positive"

    assert J.detect(found, detector, keep=["example_id"]).columns == [
        "example_id", "raw_model_response", "error", "predicted_biases",
    ]
    lean = J.classify_under_conditions(rewritten, echo, keep=["example_id"])
    assert set(lean.columns) == {"example_id", "condition", "predicted_sentiment", "error", "parsed_sentiment"}


def test_baseline_classifier(spark):
    rows = [("1", "good", "bad", "herding"), ("2", "good", "good", "none")]
    ds = spark.createDataFrame(rows, "example_id string, original_sentence string, biased_sentence string, biases string")
    out = J.classify_baseline(ds, lambda: lambda ts: [t for t in ts], {"good": "positive", "bad": "negative"})
    assert values(out, "condition", "parsed_sentiment") == [("1_clean_baseline", "positive"), ("2_no_defense", "negative")]


def test_no_response_is_never_an_answer(spark):
    from cuelab.operators import detection, jobs

    def down(params):
        def call(requests):
            raise RuntimeError("down")

        return call

    rows = [("m", i, f"text {i}", f"biased {i}", "none" if i % 2 else "framing", "neutral", None, f"r {i}") for i in range(6)]
    kind = "model string, example_id long, original_sentence string, biased_sentence string, biases string, label string, detected_bias_rewrite string, true_bias_rewrite string"
    table = spark.createDataFrame(rows, kind)
    params = Params(attempts=1, backoff_s=0)
    found = jobs.detect(table, down, params=params).cache()
    assert found.where("predicted_biases is not null or error is null").count() == 0
    assert all(not r["recall"] for r in detection.detection_report(found).collect())
    answers = jobs.classify_under_conditions(found, down, params=params).cache()
    assert answers.where("parsed_sentiment is not null or error is null").count() == 0
    unasked = answers.where(answers["condition"] == "7_rewrite_detected")
    assert {r["error"] for r in unasked.collect()} == {jobs.NOT_ASKED}


def test_distinct_keeps_system_prompts_apart(spark):
    def echo(params):
        return lambda requests: [f"{r.system}|{r.user}" for r in requests]

    table = spark.createDataFrame([(0, "a", "p"), (1, "b", "p"), (2, None, "p"), (3, "a", "p"), (4, "c", "p")], "id long, who string, prompt string")
    call = Call("out", "prompt", system_by=("who", {"a": "S1", "b": "S2", "c": ""}))
    got = {r["id"]: r["out"] for r in generate_distinct(table, echo, call, row_id="id").collect()}
    assert got == {r["id"]: r["out"] for r in generate(table, echo, [call]).collect()}
    assert got[0] == got[3] == "S1|p" and got[1] == "S2|p" and got[2] == "None|p" and got[4] == "|p"


class Clock:
    """Time that passes only while somebody sleeps, or by ``tick`` with each call."""

    def __init__(self, tick=0.0):
        self.now, self.tick, self.slept = 0.0, tick, []

    def time(self):
        return self.now

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def caller(backend, clock, calls=1, **params):
    from cuelab.operators.generate import _Caller

    return _Caller(backend, [Call(f"r{i}") for i in range(calls)], Params(**{"backoff_s": 30.0, "batch_size": 4, **params}), clock.time, clock.sleep)


def batch_of(words):
    import pyarrow as pa

    return pa.RecordBatch.from_pydict({"prompt": list(words)})


def test_others_go_on_while_a_request_waits():
    clock, sent = Clock(), []

    def backend(requests):
        clock.now += 1
        sent.append((clock.now, [r.user for r in requests]))
        if any(r.user == "bad" for r in requests):
            raise OSError("busy")
        return [r.user.upper() for r in requests]

    c = caller(backend, clock)
    first = c.first_attempt(c.rows(batch_of(["a", "bad", "b"])))
    assert [r.answers for r in first] == [["A"], ["B"]] and not clock.slept
    for _ in range(20):  # other batches, until the time has come
        assert len(c.first_attempt(c.rows(batch_of("cd")))) == 2
        assert not [r for rows in c.again() for r in rows] and not clock.slept
    clock.now += 30
    assert [rows for rows in c.again()] == [[]]  # the second attempt fails as well
    assert not clock.slept and len(c.waiting) == 1
    last = [r for rows in c.again(finish=True) for r in rows]
    assert len(clock.slept) == 1 and 25 < clock.slept[0] <= 30
    assert [type(r.problems[0]) for r in last] == [OSError] and not c.waiting
    assert sum("bad" in users for _, users in sent) == 4  # once with its batch, then three attempts


def test_waiting_rows_wait_together():
    """Three hundred passing failures cost one wait, not three hundred."""
    clock, seen = Clock(), set()

    def backend(requests):
        new = [r.user for r in requests if r.user not in seen]
        if len(requests) == 1:
            seen.update(new)
        if new:
            raise OSError("busy")
        return [r.user for r in requests]

    c = caller(backend, clock)
    words = [f"w{i}" for i in range(300)]
    assert c.first_attempt(c.rows(batch_of(words))) == []
    done = [r.answers[0] for rows in c.again(finish=True) for r in rows]
    assert sorted(done) == sorted(words) and clock.slept == [30.0]


def test_only_so_many_rows_wait(monkeypatch):
    from cuelab.operators import generate as G

    monkeypatch.setattr(G, "MOST_WAITING", 5)
    clock = Clock()

    def backend(requests):
        raise OSError("down")

    c = caller(backend, clock, attempts=2)
    assert c.first_attempt(c.rows(batch_of("abcdefgh"))) == []
    out = [r for rows in c.again() for r in rows]
    assert clock.slept == [30.0] and len(out) == 8 and not c.waiting


def test_each_call_of_a_row_is_tried_again_for_itself():
    clock, sent = Clock(), []

    def backend(requests):
        sent.extend((r.user, r.system) for r in requests)
        if len([x for x in sent if x == (requests[0].user, "s2")]) == 1 and requests[0].system == "s2":
            raise OSError("busy")
        return [f"{r.user}{r.system}" for r in requests]

    from cuelab.operators.generate import _Caller

    calls = [Call("a", system="s1"), Call("b", system="s2")]
    c = _Caller(backend, calls, Params(backoff_s=5.0, batch_size=1), clock.time, clock.sleep)
    assert c.first_attempt(c.rows(batch_of(["x"]))) == []
    (row,) = [r for rows in c.again(finish=True) for r in rows]
    assert row.answers == ["xs1", "xs2"] and not row.problems and sent.count(("x", "s1")) == 1


def test_retries_with_a_wait_give_the_same_rows(spark):
    def flaky(params):
        seen = set()

        def call(requests):
            for r in requests:
                if r.user.endswith("3") or (r.user.endswith("7") and (len(requests) > 1 or r.user not in seen)):
                    seen.update([r.user] if len(requests) == 1 else [])
                    raise OSError("busy")
            return [r.user + "!" for r in requests]

        return call

    params = Params(backoff_s=0.05, batch_size=4)
    out = generate(prompts(spark, 200).withColumn("more", F.array(F.lit(1), F.length("prompt"))), flaky, [Call("r")], params)
    for r in out.collect():
        bad = r["prompt"].endswith("3")
        assert r["r"] == (None if bad else r["prompt"] + "!") and r["error"] == ("r: OSError: busy" if bad else None)
        assert r["more"] == [1, len(r["prompt"])]
    assert out.count() == 200


def test_failed_rows_are_let_go_without_the_garbage_collector():
    """A kept exception held its row through the traceback, and the row its whole Arrow batch, until a full collection."""
    import gc

    import pyarrow as pa

    from cuelab.operators.generate import _arrow_caller, _Row

    def factory(params):
        def call(requests):
            raise RuntimeError("refused")

        return call

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["a"] * 5)], names=["id", "prompt"])
    run = _arrow_caller(factory, [Call("response", "prompt")], Params(attempts=1, backoff_s=0.0, batch_size=2), ["id"], "error")
    gc.collect()
    gc.disable()
    try:
        errors = [e for out in run(iter([batch])) for e in out.column("error").to_pylist()]
        left = sum(isinstance(x, _Row) for x in gc.get_objects())
    finally:
        gc.enable()
    assert errors == ["response: RuntimeError: refused"] * 5
    assert left == 0
