"""The table of each stage. Parquet between stages; CSV only at the edges."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


BASE = _table(sentence=_S, label=_S)
DATASET = _table(example_id=_S, original_sentence=_S, biased_sentence=_S, label=_S, biases=_S)
DETECTIONS = T.StructType(
    DATASET.fields + _table(model=_S, raw_model_response=_S, predicted_biases=T.ArrayType(_S)).fields
)
REWRITES = T.StructType(
    DATASET.fields
    + _table(
        model=_S, predicted_biases=T.ArrayType(_S), true_bias_rewrite=_S, detected_bias_rewrite=_S
    ).fields
)
JUDGEMENTS = T.StructType(
    REWRITES.fields
    + _table(
        judge_response=_S,
        trigger_removed=T.IntegerType(),
        facts_preserved=T.IntegerType(),
        natural_language=T.IntegerType(),
    ).fields
)
PREDICTIONS = T.StructType(
    DATASET.fields + _table(model=_S, condition=_S, predicted_sentiment=_S, parsed_sentiment=_S).fields
)
PROMPTS = _table(example_id=_S, model=_S, prompt=_S)
