"""Random inputs against short restatements of the rules in plain Python."""

import json
import random
import re

from pyspark.sql import functions as F

from cuelab.fixed_values import CUES
from cuelab.functions import labels as L
from cuelab.functions import sentiment as S
from cuelab.functions import text as X
from cuelab.functions.judge import parse_judge
from cuelab.operators.diversify import ALL_STEPS, diversify
from tests.test_functions import apply

PIECES = CUES + [
    "none", "None", "positive", "NEGATIVE", "neutral", "final answer:", "Final Answer:", ",", " ", "\n", "\t", "é", "ß", "İ",
    "😀", " ", "​", "```", "```json", "{", "}", '"', "x", "no ",
]


def texts(seed, n=400):
    rng = random.Random(seed)
    made = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    return [t.upper() if rng.random() < 0.2 else t for t in made] + [None]


def test_parsers(spark):
    cases = texts(1)

    def cues(t):
        return [c for c in CUES if t and c in t.lower()] or ["none"]

    def gold(t):
        if t is None or t.strip().lower() in ("", "none"):
            return ["none"]
        return [c.strip().lower() for c in t.split(",") if c.strip()]

    def word(t):
        return next((w for w in ("positive", "negative", "neutral") if t and w in t.lower()), None)

    def cot(t):
        return word(re.split("final answer:", t.lower())[-1] if t else t) or word(t) or "neutral"

    assert apply(spark, L.parse_predictions, cases) == [cues(t) for t in cases]
    assert apply(spark, L.parse_gold, cases) == [gold(t) for t in cases]
    assert apply(spark, S.parse_sentiment, cases) == [word(t) or "neutral" for t in cases]
    assert apply(spark, S.parse_sentiment_cot, cases) == [cot(t) for t in cases]
    assert apply(spark, S.format_failure, cases) == [word(t) is None for t in cases]
    assert apply(spark, X.strip, cases) == [t and t.strip() for t in cases]
    printable = [t and "".join(c for c in t if c.isprintable()) for t in cases]
    assert apply(spark, X.strip_nonprintable, cases) == printable


def test_judge(spark):
    rng = random.Random(2)
    keys = ["trigger_removed", "facts_preserved", "natural_language", "other"]
    cells = [0, 1, 2, -3, 0.9, 1.5, True, False, None, "1", " 0 ", "yes", "0.5", ""]

    def made():
        body = json.dumps({k: rng.choice(cells) for k in rng.sample(keys, rng.randint(0, 4))}, indent=rng.choice([None, 1]))
        head = rng.choice(["", "", "```json\n", "```", "\n ", "Answer: "])
        tail = rng.choice(["", "", "\n```", "```", " \n", " ok"])
        return head + body + tail

    def want(t):
        t = t.strip()
        for head in ("```json", "```"):
            t = t.removeprefix(head)
        t = t.removesuffix("```").strip()
        try:
            found = json.loads(t)
            return tuple(int(found.get(k, 0)) for k in keys[:3])
        except (ValueError, TypeError):
            return (-1, -1, -1)

    cases = [made() for _ in range(600)]
    assert [tuple(r) for r in apply(spark, parse_judge, cases)] == [want(t) for t in cases]


def test_diversify(spark):
    rng = random.Random(3)
    words = [f for s in ALL_STEPS for f in rng.sample(s.finds, 4)] + ["and", "the", "PER", "Reuters", "a", "solid", "İ", "$1"]
    cases = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(500)]
    cases = [t.upper() if rng.random() < 0.2 else t for t in cases]
    import hashlib

    def draws(step, key):
        d = hashlib.md5(f"42|{step}|{key}".encode()).hexdigest()
        return int(d[:8], 16), int(d[8:16], 16)

    def want(i, text):
        for s in ALL_STEPS:
            keep, choice = draws(s.name, i)
            hit = next((n for n, f in enumerate(s.finds) if f.lower() in text.lower()), None)
            if keep > int(0.7 * 2**32) or hit is None:
                continue
            option = s.options[hit][choice % len(s.options[hit])]
            text = re.sub(re.escape(s.finds[hit]), lambda _: option, text, count=1, flags=re.I)
        return text

    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(cases)], "example_id string, biased_sentence string")
    got = [r["biased_sentence"] for r in diversify(df).orderBy(F.col("example_id").cast("int")).collect()]
    assert got == [want(i, t) for i, t in enumerate(cases)]
