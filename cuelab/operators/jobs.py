"""The stages that call a model: prompts in, parsed answers out.

Each job is lazy except where a second call builds on the first. Write a job's result before
using it twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import replace
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelab.functions.judge import parse_judge
from cuelab.functions.labels import parse_predictions
from cuelab.functions.sentiment import parse_with
from cuelab.functions.text import strip_nonprintable, text_array
from cuelab.operators.dataset import example_id, sentence_of, union_all
from cuelab.operators.generate import (
    DETECT,
    INJECT,
    JUDGE,
    REWRITE,
    SENTIMENT,
    BackendFactory,
    Call,
    Params,
    Wording,
    classify,
    generate,
    generate_worded,
)
from cuelab.plans.conditions import (
    Condition,
    condition_prompt,
    expand_conditions,
    is_clean,
    open_conditions,
    sentiment_conditions,
)
from cuelab.plans.injection import (
    PlanRow,
    bias_plan,
    expand_first_calls,
    injection_prompt,
)
from cuelab.operators.skew import heavy_keys
from cuelab.plans.prompts import INJECTION_TEMPLATES, TASK_TEMPLATES, InjectionTemplates, TaskTemplates, render
from cuelab.workspace import materialise


#: Where the failures of all stages are kept, by stage.
ERRORS = "errors"


def with_errors(df: DataFrame, stage: str | None = None) -> DataFrame:
    """Have failures carried on: adds ``errors``, a map of stage to message, which every job then hands on and adds to.

    Without it a row has the ``error`` of the last stage only. A table that comes from a ``stage`` brings its ``error`` along.
    """
    if ERRORS not in df.columns:
        df = df.withColumn(ERRORS, F.create_map().cast("map<string,string>"))
    return _noted(df, stage) if stage and "error" in df.columns else df


def _noted(df: DataFrame, stage: str) -> DataFrame:
    """The ``error`` of a stage among the ``errors``, if they are carried; a later run of the stage replaces its message."""
    if ERRORS not in df.columns:
        return df
    others = F.map_filter(ERRORS, lambda k, _: k != stage)
    own = F.create_map(F.lit(stage), F.col("error"))
    return df.withColumn(ERRORS, F.when(F.col("error").isNotNull(), F.map_concat(others, own)).otherwise(others))


def _carried(df: DataFrame, keep: Sequence[str] | None) -> DataFrame:
    """Only these columns and the prompts go through Python; all of them when none are named."""
    if keep is None:
        return df
    extra = [c for c in df.columns if c in ("prompt", "parser", "condition", ERRORS) or c.startswith("__")]
    return df.select(*keep, *[c for c in extra if c not in keep])


#: The error of a row that had no prompt, so that no call was made.
NOT_ASKED = "no prompt"


def _spread(df: DataFrame, partitions: int | None) -> dict:
    """Rows of one prompt table are told apart by these columns, and evenly spread by them."""
    ids = ("model", "condition", "example_id", "call_id")
    return {"partitions": partitions, "spread_by": [c for c in ids if c in df.columns]}


def detect(
    examples: DataFrame,
    factory: BackendFactory,
    templates: TaskTemplates = TASK_TEMPLATES,
    params: Params = DETECT,
    text_col: str = "biased_sentence",
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Ask which cues a text carries: adds ``raw_model_response, predicted_biases, error``.

    Without a response there are no labels: NULL, which metrics count as the empty set, not as ``none``.
    """
    prompt = render(templates.detect, {"sentence": F.col(text_col)})
    asked = _carried(examples.drop("error").withColumn("prompt", prompt), keep)
    call = Call("raw_model_response", "prompt", templates.detect_system)
    answered = generate(asked, factory, [call], params, drop=["prompt"], **_spread(asked, partitions))
    answered = _noted(answered, "detect")
    labels = parse_predictions(F.col("raw_model_response"))
    return answered.withColumn("predicted_biases", F.when(F.col("raw_model_response").isNotNull(), labels))


def _as_text(df: DataFrame, col: str) -> Column:
    """A label column as the text shown in prompts."""
    value = F.col(col)
    return F.array_join(value, ",") if df.schema[col].dataType.typeName() == "array" else value


def rewrite(
    detections: DataFrame,
    factory: BackendFactory,
    templates: TaskTemplates = TASK_TEMPLATES,
    params: Params = REWRITE,
    text_col: str = "biased_sentence",
    missing: str | None = None,
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Ask to take the cues out, once told the gold labels and once the detected ones.

    Both calls of a row happen in one pass. Clean rows are rewritten too. A row without detected
    labels gets no second rewrite, unless ``missing`` names the text to show instead.
    """

    def prompt(labels: str) -> Column:
        slots = {"predicted_biases": _as_text(detections, labels), "sentence": F.col(text_col)}
        return render(templates.rewrite, slots, missing)

    asked = detections.drop("error").withColumns(
        {"__gold_prompt": prompt("biases"), "__detected_prompt": prompt("predicted_biases")}
    )
    asked = _carried(asked, keep)
    calls = [
        Call("true_bias_rewrite", "__gold_prompt", templates.rewrite_system),
        Call("detected_bias_rewrite", "__detected_prompt", templates.rewrite_system),
    ]
    answered = generate(asked, factory, calls, params, drop=["__gold_prompt", "__detected_prompt"], **_spread(asked, partitions))
    return _noted(answered, "rewrite")


def judge(
    rewrites: DataFrame,
    factory: BackendFactory,
    templates: TaskTemplates = TASK_TEMPLATES,
    params: Params = JUDGE,
    labels_col: str = "predicted_biases",
    rewrite_col: str = "detected_bias_rewrite",
    missing: str | None = None,
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Have rewrites of rows with a cue scored: adds ``judge_response`` and the three scores.

    Judging by gold labels goes with the rewrite made from gold labels: name both columns.
    """
    asked = rewrites.filter(~is_clean(F.col("biases")))
    slots = {
        "original_sentence": F.col("original_sentence"),
        "biased_sentence": F.col("biased_sentence"),
        "debiased_sentence": F.col(rewrite_col),
        "predicted_biases": _as_text(rewrites, labels_col),
    }
    asked = _carried(asked.drop("error").withColumn("prompt", render(templates.judge, slots, missing)), keep)
    call = Call("judge_response", "prompt", templates.judge_system)
    answered = _noted(generate(asked, factory, [call], params, drop=["prompt"], **_spread(asked, partitions)), "judge")
    columns = answered.columns
    return answered.withColumn("__scores", parse_judge(F.col("judge_response"))).select(*columns, "__scores.*")


#: The conditions that an example is done with.
FINISHED = "__finished"
#: With more finished rows of a sentence the examples are dealt out one by one.
SENTENCE_ROWS = 10_000


def with_finished(rewrites: DataFrame, done: DataFrame) -> DataFrame:
    """Beside each example the set of conditions in ``done``: one join per example, not one per condition.

    The rows are dealt out by the sentence that their ids begin with. Those of a sentence that follow each other have texts in common and
    travel as one compressed cell (``_packed``); what is finished meets them where they are unpacked. If ``done``, which
    should come from files, has a sentence with more than ``SENTENCE_ROWS`` rows, ids are not of that form, and whole ids are dealt.
    """
    keys = [k for k in ("example_id", "model") if k in rewrites.columns]
    (same, *others) = keys
    ended = done.filter(F.col("condition").isNotNull()).select(*keys, "condition")
    # one name that is never missing for each id, and where its rows go
    name = F.coalesce(F.concat(F.lit("+"), F.col(same).cast("string")), F.lit("-"))
    home = sentence_of(name) if same == "example_id" else name
    if heavy_keys(ended.select(F.xxhash64(home).alias("__h")), "__h", SENTENCE_ROWS):
        home = name
    for k in others:
        name = F.concat(name, F.lit("\x00"), F.coalesce(F.concat(F.lit("+"), F.col(k).cast("string")), F.lit("-")))
    ended = ended.select(home.alias("__home"), F.struct(name.alias("name"), "condition").alias("__one"))
    sets = ended.groupBy("__home").agg(F.collect_set("__one").alias("__ended")).hint("merge")
    told = rewrites.withColumns({"__home": home, "__name": name})
    found = told.mapInArrow(_packed, "__home string, __rows binary").join(sets, "__home", "left")
    schema = T.StructType([*rewrites.schema.fields, T.StructField(FINISHED, T.ArrayType(T.StringType()))])
    return found.select("__rows", "__ended").mapInArrow(_unpacked, schema)


#: Rows are packed up to about so many bytes.
PACK_BYTES = 4 << 20


def _packed(batches: Iterator) -> Iterator:
    """For each run of rows with the same ``__home`` a cell that holds the rows, compressed: zstd finds texts again from row to row and from
    column to column, which the codecs of shuffles, with blocks of 32 KB, do not."""
    import numpy as np
    import pyarrow as pa

    codec = pa.Codec("zstd")
    for batch in batches:
        homes = batch.column("__home").to_pylist()
        rows = batch.select([n for n in batch.schema.names if n != "__home"])
        most = max(PACK_BYTES * max(batch.num_rows, 1) // max(batch.nbytes, 1), 1)
        starts = [i for i, h in enumerate(homes) if not i or h != homes[i - 1]]
        starts = np.concatenate([np.arange(a, b, most) for a, b in zip(starts, [*starts[1:], len(homes)])]).tolist() if starts else []
        cells = []
        for a, b in zip(starts, [*starts[1:], len(homes)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows.slice(a, b - a))
            plain = sink.getvalue()
            cells.append(plain.size.to_bytes(8, "little") + codec.compress(plain, asbytes=True))
        yield pa.RecordBatch.from_arrays([pa.array([homes[a] for a in starts], pa.string()), pa.array(cells, pa.binary())], names=["__home", "__rows"])


def _unpacked(batches: Iterator) -> Iterator:
    """The rows of ``_packed`` with the conditions that each is done with."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    for batch in batches:
        ended = batch.column("__ended")
        pairs = ended.flatten()
        names, conditions = pairs.field("name").to_pylist(), pairs.field("condition").to_pylist()
        at, held, size = 0, [], 0
        for cell, n in zip(batch.column("__rows"), ended.value_lengths().to_pylist()):
            done: dict[str, list[str]] = {}
            for i in range(at, at + (n or 0)):
                done.setdefault(names[i], []).append(conditions[i])
            at += n or 0
            cell = cell.as_buffer()
            plain = codec.decompress(cell.slice(8), int.from_bytes(cell.slice(0, 8).to_pybytes(), "little"))
            for rows in pa.ipc.open_stream(plain):
                own = [done.get(x) for x in rows.column("__name").to_pylist()]
                kept = [n for n in rows.schema.names if n != "__name"]
                held.append(pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), pa.array(own, pa.list_(pa.string()))], names=[*kept, FINISHED]))
                size += rows.nbytes
            if size >= PACK_BYTES:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def condition_prompts(
    rewrites: DataFrame,
    conditions: Sequence[Condition] | None = None,
    missing: str | None = None,
    done: DataFrame | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The prompt table of the sentiment conditions, without the keys already ``done`` (or those
    that ``with_finished`` has marked); of the other columns those in ``keep``, or all. Finished
    conditions are taken out before the expansion, so texts are shuffled once per example."""
    conditions = conditions or sentiment_conditions()
    examples = _shown(rewrites)
    if done is not None:
        examples = with_finished(examples, done)
    finished = FINISHED if FINISHED in examples.columns else None
    rows = expand_conditions(examples, conditions, finished).drop(FINISHED)
    return _carried(rows.withColumn("prompt", condition_prompt(conditions, missing)), keep)


def _shown(rewrites: DataFrame) -> DataFrame:
    """The examples with their labels as prompts show them."""
    examples = rewrites.drop("error")
    if "predicted_biases" in examples.columns:
        examples = examples.withColumn("predicted_biases", _as_text(examples, "predicted_biases"))
    return examples


def condition_answers(
    prompts: DataFrame,
    factory: BackendFactory,
    conditions: Sequence[Condition] | None = None,
    params: Params = SENTIMENT,
    partitions: int | None = None,
) -> DataFrame:
    """Send a prompt table of sentiment conditions: adds ``predicted_sentiment, error,
    parsed_sentiment``. The answer is parsed in the same plan, so no partial result lacks it. Rows
    without a response have no sentiment (NULL, never right); those without a prompt say so in ``error``."""
    systems = {c.name: c.system for c in conditions or sentiment_conditions()}
    call = Call("predicted_sentiment", "prompt", system_by=("condition", systems))
    return _parsed(generate(prompts, factory, [call], params, drop=["prompt"], **_spread(prompts, partitions)))


def _parsed(answered: DataFrame) -> DataFrame:
    response, error = F.col("predicted_sentiment"), F.col("error")
    parsed = answered.withColumns({
        "parsed_sentiment": F.when(response.isNotNull(), parse_with(F.col("parser"), response)),
        "error": F.when(response.isNull() & error.isNull(), F.lit(NOT_ASKED)).otherwise(error),
    }).drop("parser")
    return _noted(parsed, "sentiment")


def classify_under_conditions(
    rewrites: DataFrame,
    factory: BackendFactory,
    conditions: Sequence[Condition] | None = None,
    params: Params = SENTIMENT,
    missing: str | None = None,
    done: DataFrame | None = None,
    keep: Sequence[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Ask for the sentiment under each condition: one row per example and condition.

    With ``keep`` only the named columns go along: ids will do, since the texts are in the tables
    of the stages before. The rows are those of ``condition_answers`` to ``condition_prompts``, but each text of an example
    is sent to Python once, not once for each condition that asks about it.
    """
    conditions = list(conditions or sentiment_conditions())
    rows, asking = asked_rows(rewrites, conditions, done, keep)
    return answers_of(rows, asking, factory, params, missing, partitions)


class Asking(NamedTuple):
    """What makes answers of ``asked_rows``: the conditions that rows name by number, the text columns by their names in them, and the
    columns of the result before the answer."""

    conditions: list[Condition]
    texts: dict[str, str]
    order: list[str]


#: The numbers of the conditions that a row is asked under.
ASKED = "__asked"


def asked_rows(
    rewrites: DataFrame,
    conditions: Sequence[Condition],
    done: DataFrame | None = None,
    keep: Sequence[str] | None = None,
    among: Sequence[Condition] | None = None,
) -> tuple[DataFrame, Asking]:
    """A row for each example that is still to be asked about: what ``keep`` names, its texts once, and the numbers of its conditions
    ``among`` these (``conditions`` themselves when none are named)."""
    among = list(among or conditions)
    chosen = [among.index(c) for c in conditions]
    examples = _shown(rewrites)
    columns = [c for c in examples.columns if c != FINISHED]
    facts = ("condition", "condition_ord", "parser")
    extra = [c for c in columns if c == ERRORS or c.startswith("__")]
    kept = columns if keep is None else [*(c for c in keep if c not in facts), *(c for c in extra if c not in keep)]
    # A text that is only for conditions of the other population is left behind, also by the join with what is done.
    asked, texts, names = open_conditions(conditions), [], {}
    for name in dict.fromkeys(n for c in conditions for n in (c.input_col, c.labels_col) if n):
        if name in kept and examples.schema[name].dataType.typeName() == "string":
            names[name] = name
            continue
        needed = reduce(or_, [a for c, a in zip(conditions, asked) if name in (c.input_col, c.labels_col)])
        names[name] = f"__slot_{name}"
        texts.append(F.when(needed, F.col(name).cast("string")).alias(names[name]))
    numbers = F.array_compact(F.array(*[F.when(a, F.lit(i)) for i, a in zip(chosen, asked)]))
    more = [k for k in ("model", "example_id") if done is not None and k in columns and k not in kept]
    more += [FINISHED] if FINISHED in examples.columns else []
    rows = examples.select(*kept, *more, *texts, numbers.alias(ASKED))
    if done is not None:
        rows = with_finished(rows, done)
    if FINISHED in rows.columns:
        done_with = F.transform(FINISHED, lambda name: F.array_position(text_array([c.name for c in among]), name).cast("int") - 1)
        rows = rows.withColumn(ASKED, F.array_except(ASKED, F.coalesce(done_with, F.array().cast("array<int>"))))
    rows = rows.select(*kept, *[v for k, v in names.items() if k != v], ASKED).filter(F.size(ASKED) > 0)
    order = [*columns, "condition", "condition_ord"] if keep is None else [*keep, *(c for c in [*extra, "condition"] if c not in keep)]
    return rows, Asking(among, names, order)


def answers_of(
    rows: DataFrame, asking: Asking, factory: BackendFactory, params: Params = SENTIMENT, missing: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Ask what ``asked_rows`` names: a row for each example and condition. The rows may have been written in between."""
    conditions, names, order = asking
    there = set(rows.columns)

    def wording(c: Condition) -> Wording:
        slots = {"sentence": c.input_col} | ({"bias_type": c.labels_col} if c.labels_col else {})
        if not {names.get(v) for v in slots.values()} <= there:  # no row is asked under it
            return Wording("", {})
        return Wording(c.template, {k: names[v] for k, v in slots.items()}, c.system, missing)

    answered = generate_worded(
        rows, factory, "predicted_sentiment", [wording(c) for c in conditions], params, asked_col=ASKED, number_col="__number",
        drop=[v for k, v in names.items() if k != v and v in there], **_spread(rows, partitions),
    )
    at = F.col("__number") + 1
    told = {
        "condition": F.element_at(text_array([c.name for c in conditions]), at),
        "condition_ord": F.element_at(F.array(*[F.lit(c.ord) for c in conditions]), at),
        "parser": F.element_at(text_array([c.parser for c in conditions]), at),
    }
    answered = answered.withColumns(told).select(*order, *(c for c in ["parser"] if c not in order), "predicted_sentiment", "error")
    return _parsed(answered)


def classify_baseline(
    examples: DataFrame,
    make_classifier: Callable[[], Callable[[Sequence[str]], Sequence[str]]],
    label_map: Mapping[str, str],
    batch_size: int = 32,
) -> DataFrame:
    """Predictions of a fixed classifier, in the form of the sentiment conditions: clean rows by
    their original text (``1_clean_baseline``), the others by the text with cues
    (``2_no_defense``)."""
    clean = is_clean(F.col("biases"))
    rows = examples.withColumns(
        {
            "condition": F.when(clean, "1_clean_baseline").otherwise("2_no_defense"),
            "__text": F.when(clean, F.col("original_sentence")).otherwise(F.col("biased_sentence")),
        }
    )
    out = classify(rows, "__text", make_classifier, label_map, batch_size=batch_size).drop("__text")
    return out.withColumn("parsed_sentiment", F.col("predicted_sentiment"))


def inject(
    base: DataFrame,
    factory: BackendFactory,
    plan: Sequence[PlanRow] | None = None,
    variants: Sequence[str] = ("main",),
    templates: Mapping[str, InjectionTemplates] = INJECTION_TEMPLATES,
    params: Params = INJECT,
    reuse_first_stage: bool = True,
    text_col: str = "sentence",
    label_col: str = "label",
    id_col: str = "sentence_id",
    partitions: int | None = None,
    original: bool = True,
) -> DataFrame:
    """Work the cues of the plan into each sentence, pairs by two calls in a row.

    The first responses are written once; pairs of framing share one of them when
    ``reuse_first_stage`` is set. Before the second call characters that cannot be printed are
    taken out. Columns: the dataset's, ``plan_ord``, ``prompt_variant`` and ``error``. Without ``original`` there is no
    ``original_sentence``: each sentence then goes through the calls in its prompts alone.
    """
    plan = [r for r in (plan if plan is not None else bias_plan(clean=False)) if r.stage1 is not None]
    if not reuse_first_stage:
        plan = [replace(r, shared=False) for r in plan]
    named = base.select(
        F.col(id_col).alias("sentence_id"),
        F.col(text_col).alias("original_sentence"),
        F.col(label_col).alias("label"),
    )

    systems = {name: t.system for name, t in templates.items()}

    def called(df: DataFrame, cue: str, sentence: str, out: str, error: str) -> DataFrame:
        prompt = injection_prompt(F.col(cue), F.col("label"), F.col("prompt_variant"), F.col(sentence), templates)
        asked = df.withColumn("__prompt", prompt)
        call = Call(out, "__prompt", system_by=("prompt_variant", systems))
        drop = {"__prompt", cue, sentence} - ({"original_sentence"} if original else set())
        return generate(
            asked, factory, [call], params, drop=drop, error_col=error, **_spread(asked, partitions)
        )

    first = expand_first_calls(named, plan, "label", variants)
    first = first.withColumn("call_id", example_id(F.col("sentence_id"), F.col("call_ord"), F.col("prompt_variant")))
    first = called(first, "stage1", "original_sentence", "first", "error")
    pairs = any(r.stage2 for r in plan)
    if pairs:
        first = materialise(first, "first-calls")

    uses = first.select("*", F.inline("finish")).drop("finish", "call_ord", "call_id").withColumn(
        "example_id", example_id(F.col("sentence_id"), F.col("plan_ord"), F.col("prompt_variant"))
    )
    single = uses.filter(F.col("stage2").isNull()).withColumnRenamed("first", "biased_sentence")
    if pairs:
        # Only pairs go through Python again.
        begun = uses.filter(F.col("stage2").isNotNull()).withColumn("__mid", strip_nonprintable(F.col("first")))
        begun = begun.drop("first").withColumnRenamed("error", "__error1")
        ended = called(begun, "stage2", "__mid", "biased_sentence", "__error2")
        ended = ended.withColumn("error", F.coalesce("__error1", "__error2"))
        uses = union_all([single.drop("stage2"), ended.drop("__error1", "__error2")])
    else:
        uses = single
    texts = ["original_sentence", "biased_sentence"] if original else ["biased_sentence"]
    return uses.select("example_id", *texts, "label", "biases", "plan_ord", "prompt_variant", "error")
