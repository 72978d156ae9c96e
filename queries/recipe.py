"""Stage tables derived from the driver's tables, as DataFrames.

``documents`` stands for the base sentences, whole texts included. Everything after it follows by
rules on ids, so that the same tables can be written in SQL (see ``queries/sql.py``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelab.fixed_values import FRAMING_OPTIONS, HERDING_FINDS, OVERCONFIDENCE_FINDS
from cuelab.functions.judge import parse_judge
from cuelab.functions.labels import parse_predictions, prediction_cell
from cuelab.functions.sentiment import parse_with
from cuelab.functions.text import text_array
from cuelab.operators.dataset import example_id, with_text_keys
from cuelab.operators.diversify import AUTHORITY
from cuelab.plans.conditions import expand_conditions, sentiment_conditions
from cuelab.plans.injection import bias_plan, expand_models, expand_plan

# A phrase for each cue; several for those that are diversified, chosen by sentence and plan row.
PHRASES = {
    "anchoring": ["against 4.2 million in 2007"],
    "authority": list(AUTHORITY.finds),
    "framing": list(FRAMING_OPTIONS),
    "herding": HERDING_FINDS,
    "recency": ["as of this very morning"],
    "overconfidence": [f.upper() if i % 2 else f for i, f in enumerate(OVERCONFIDENCE_FINDS)],
}

# model: (factors and bar of the rule that decides whether it answers correctly)
MODELS = {"model_a": (31, 17, 6), "model_b": (37, 11, 4), "model_c": (41, 13, 8)}

CANNED_LABELS = [
    "None", "none", "anchoring, recency", "  AUTHORITY", "framing,herding",
    "no bias, none of them", "overconfidence; also anchoring", "N/A",
]
CANNED_SENTIMENTS = [
    "Positive.", "negative, not positive", "Neutral to negative", "mixed", "",
    "Looks positive. FINAL ANSWER: negative",
    "final answer: negative ... Final Answer: neutral",
    "positive tone. FINAL ANSWER: unclear",
]
CANNED_JUDGE = [
    '{"trigger_removed":1,"facts_preserved":0,"natural_language":1}',
    '```json\n{"trigger_removed":1,"facts_preserved":1,"natural_language":1}\n```',
    '```\n{"trigger_removed": 0, "facts_preserved": 1, "natural_language": 0}```',
    '```JSON\n{"trigger_removed":1}\n```',
    '{"facts_preserved":1}',
    "{}",
    '{"trigger_removed":null}',
    '{"trigger_removed":"yes"}',
    '{"trigger_removed":2}',
    '{"trigger_removed":1} extra',
    '{"trigger_removed":1,"facts_preserved":1,"natural_language":1,"why":"kept {x} and }"}',
    '{"trigger_removed":1,"detail":{"a":1,"b":[{}]},"natural_language":1}',
    '{"trigger_removed":1},{"trigger_removed":1}',
    '{"trigger_removed":1}] {x}',
    "junk",
    "",
    '  {"trigger_removed":1,"facts_preserved":1,"natural_language":0}  ',
]


def pick(words: Sequence[str], number: Column) -> Column:
    return F.element_at(text_array(words), (F.pmod(number, F.lit(len(words))) + 1).cast("int"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on a scan that is too small to be split; a large scan is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def base(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    third = F.pmod(F.col("doc_id"), F.lit(3))
    label = F.when(third == 0, "positive").when(third == 1, "negative").otherwise("neutral")
    return docs.select(F.col("doc_id").alias("sentence_id"), F.col("text").alias("sentence"), label.alias("label"))


def _phrase(cue: Column) -> Column:
    number = F.col("sentence_id") + F.col("plan_ord")
    out = None
    for name, phrases in PHRASES.items():
        value = pick(phrases, number)
        out = F.when(cue == name, value) if out is None else out.when(cue == name, value)
    return out


def plan_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences with the plan, ids only."""
    rows = expand_plan(base(spark, sf), bias_plan())
    return rows.withColumn("example_id", example_id(F.col("sentence_id"), F.col("plan_ord")))


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    parts = [F.col("sentence")]
    for stage in ("stage1", "stage2"):
        parts.append(F.coalesce(F.concat(F.lit(" "), _phrase(F.col(stage))), F.lit("")))
    rows = plan_rows(spark, sf).select(
        "example_id",
        F.col("sentence").alias("original_sentence"),
        F.concat(*parts).alias("biased_sentence"),
        "label",
        "biases",
        "sentence_id",
        "plan_ord",
    )
    return with_text_keys(rows)


def _per_model(rule) -> Column:
    out = None
    for m, numbers in MODELS.items():
        value = rule(*numbers)
        here = F.col("model") == m
        out = F.when(here, value) if out is None else out.when(here, value)
    return out


def _raw_detections(spark: SparkSession, sf: str) -> DataFrame:
    sid, ord_ = F.col("sentence_id"), F.col("plan_ord")
    right = _per_model(lambda a, b, bar: F.pmod(sid * a + ord_ * b, F.lit(10)) < bar)
    raw = F.when(right, F.upper("biases")).otherwise(pick(CANNED_LABELS, sid * 7 + ord_ * 5))
    return expand_models(dataset(spark, sf), list(MODELS)).withColumn("raw_model_response", raw)


def detections(spark: SparkSession, sf: str) -> DataFrame:
    return _raw_detections(spark, sf).withColumn(
        "predicted_biases", parse_predictions(F.col("raw_model_response"))
    )


def detection_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Detections as a stage hands them on: predicted labels as one comma-joined cell."""
    return _raw_detections(spark, sf).withColumn("predicted_biases", prediction_cell(F.col("raw_model_response")))


def rewrites(spark: SparkSession, sf: str) -> DataFrame:
    detected = F.concat(F.col("model"), F.lit(" detected: "), F.col("original_sentence"))
    gold = F.concat(F.col("model"), F.lit(" gold: "), F.col("original_sentence"))
    return detection_cells(spark, sf).withColumns(
        {"true_bias_rewrite": gold, "detected_bias_rewrite": detected}
    )


def judge_responses(spark: SparkSession, sf: str) -> DataFrame:
    raw = pick(CANNED_JUDGE, F.col("sentence_id") * 13 + F.col("plan_ord") * 7 + _per_model(lambda a, b, c: F.lit(a)))
    return rewrites(spark, sf).filter(F.col("biases") != "none").withColumn("judge_response", raw)


def judgements(spark: SparkSession, sf: str) -> DataFrame:
    rows = judge_responses(spark, sf)
    columns = rows.columns
    return rows.withColumn("__s", parse_judge(F.col("judge_response"))).select(*columns, "__s.*")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Sentiment answers of every model under every condition, with a running number."""
    conditions = sentiment_conditions()
    rows = expand_conditions(rewrites(spark, sf), conditions)
    sid, ord_, c = F.col("sentence_id"), F.col("plan_ord"), F.col("condition_ord")
    right = _per_model(lambda a, b, bar: F.pmod(sid * b + ord_ * a + c, F.lit(10)) < bar)
    raw = F.when(right, F.concat(F.lit("FINAL ANSWER: "), "label")).otherwise(
        pick(CANNED_SENTIMENTS, sid * 5 + ord_ * 3 + c)
    )
    seq = (c * 1000 + ord_).cast("bigint") * 1000000000 + sid
    return (
        rows.withColumn("predicted_sentiment", raw)
        .withColumn("parsed_sentiment", parse_with(F.col("parser"), F.col("predicted_sentiment")))
        .withColumn("seq", seq)
    )


# --- backends without a model: pure functions of the prompt -------------------


def digest_number(system: str | None, user: str) -> int:
    return int(hashlib.md5(f"{system}\n{user}".encode()).hexdigest()[:8], 16)


def canned_backend(answers: Sequence[str]):
    """A backend that picks an answer by the md5 of system and user prompt."""
    answers = list(answers)

    def factory(params):
        return lambda requests: [answers[digest_number(r.system, r.user) % len(answers)] for r in requests]

    return factory


def digest_backend(tag: str):
    """A backend that answers with the md5 of what it was sent, blanks around it."""

    def factory(params):
        def call(requests):
            return [f"  {tag} {hashlib.md5(f'{r.system}|{r.user}'.encode()).hexdigest()}\n" for r in requests]

        return call

    return factory


def length_backend(params):
    return lambda requests: [str(len(r.user)) for r in requests]


def refusing(inner, word: str):
    """Refuses every prompt that holds the word, and the whole batch with it."""

    def factory(params):
        backend = inner(params)

        def call(requests):
            if any(word in r.user for r in requests):
                raise RuntimeError("refused")
            return backend(requests)

        return call

    return factory


def failing(inner, every: int = 7):
    """Never answers the prompts whose digest is a multiple of a number."""

    def factory(params):
        backend = inner(params)

        def call(requests):
            if any(digest_number(r.system, r.user) % every == 0 for r in requests):
                raise TimeoutError("no answer")
            return backend(requests)

        return call

    return factory


def stumbling(inner, word: str):
    """Fails the first time that it is sent a prompt with the word alone, and any batch that holds a new one."""

    def factory(params):
        backend, met = inner(params), set()

        def call(requests):
            new = {digest_number(r.system, r.user) for r in requests if word in r.user} - met
            if len(requests) == 1:
                met.update(new)
            if new:
                raise ConnectionError("try again")
            return backend(requests)

        return call

    return factory


def length_classifier():
    """Batched stand-in for a fixed classifier: a class by the length of the text."""
    names = ["Positive", "Negative", "Neutral", "Other"]
    return lambda texts: [names[len(t) % 4] for t in texts]
