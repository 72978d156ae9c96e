"""Judge answers: a small JSON object of 0/1 scores, possibly inside a code fence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelab.fixed_values import JUDGE_SCORES
from cuelab.functions.text import strip


def _unfence(text: Column) -> Column:
    out = strip(text)
    for fence in (r"^```json", r"^```", r"```\z"):
        out = F.regexp_replace(out, fence, "")
    return strip(out)


def parse_judge(text: Column, scores: list[str] = JUDGE_SCORES) -> Column:
    """A struct of integer scores.

    A key that is absent counts 0. Anything else that is not an object of whole-number
    values makes every score -1: broken JSON, text after the object, null, words. Other keys may
    hold anything. An object that repeats a key is broken here.
    """
    body = _unfence(text)
    # The JSON reader tolerates text after the object; inside an array and inside another object it does not.
    inside = F.concat(F.lit("["), body, F.lit("]")), F.concat(F.lit('{"r":'), body, F.lit("}"))
    alone = body.startswith("{") & F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull()
    parsed = F.try_parse_json(F.when(alone, body))

    def score(key: str) -> Column:
        path = f"$.{key}"
        absent = F.variant_get(parsed, path, "variant").isNull()
        return F.when(absent, F.lit(0)).otherwise(F.try_variant_get(parsed, path, "int"))

    values = [score(k) for k in scores]
    readable = parsed.isNotNull()
    for v in values:
        readable = readable & v.isNotNull()
    return F.struct(
        *[F.when(readable, v).otherwise(F.lit(-1)).alias(k) for k, v in zip(scores, values)]
    )
