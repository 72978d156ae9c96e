"""The stage tables of ``queries/recipe.py`` once more, as common table expressions for DuckDB.

Written from the rules, not from the Spark code, so that both sides can disagree.
"""

from __future__ import annotations

from collections.abc import Sequence

from cuelab.fixed_values import ALL_CONDITIONS, CLEAN_CONDITIONS, CUE_CLASSES, CUES, SENTIMENTS
from queries.recipe import CANNED_JUDGE, CANNED_LABELS, CANNED_SENTIMENTS, MODELS, PHRASES

PLAIN = ["anchoring", "authority", "herding", "recency", "overconfidence"]
PAIRS = [(PLAIN[i], PLAIN[j]) for i in range(5) for j in range(i + 1, 5)]


def s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(words: Sequence[str]) -> str:
    return "[" + ", ".join(s(w) for w in words) + "]"


def pick(words: Sequence[str], number: str) -> str:
    return f"{lst(words)}[(({number}) % {len(words)}) + 1]"


WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def draw(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


# --- plan and dataset ---------------------------------------------------------

_plan = [("none", None, None)]
_plan += [(c, c, None) for c in PLAIN]
_plan += [("framing", "framing", None)]
_plan += [(f"{a},{b}", a, b) for a, b in PAIRS]
_plan += [(f"framing,{c}", "framing", c) for c in PLAIN]


def _nullable(x: str | None) -> str:
    return "NULL::VARCHAR" if x is None else s(x)


PLAN_VALUES = ", ".join(f"({i}, {s(b)}, {_nullable(x)}, {_nullable(y)})" for i, (b, x, y) in enumerate(_plan))


def _phrase(stage: str) -> str:
    whens = " ".join(f"WHEN {s(c)} THEN {pick(p, 'sentence_id + plan_ord')}" for c, p in PHRASES.items())
    return f"coalesce(' ' || CASE {stage} {whens} END, '')"


BASE = """base AS (
  SELECT doc_id AS sentence_id, text AS sentence,
         CASE doc_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END AS label
  FROM documents)"""
PLAN = f"plan AS (SELECT * FROM (VALUES {PLAN_VALUES}) v(plan_ord, biases, stage1, stage2))"
DATASET = f"""dataset AS (
  SELECT sentence_id || ':' || plan_ord AS example_id, sentence AS original_sentence,
         sentence || {_phrase('stage1')} || {_phrase('stage2')} AS biased_sentence,
         label, biases, sentence_id, plan_ord, stage1, stage2
  FROM base, plan WHERE NOT (stage1 IS NOT DISTINCT FROM 'framing' AND label = 'neutral'))"""


def predicted(x: str, cues: Sequence[str] = CUES) -> str:
    found = f"list_filter({lst(cues)}, lambda c: contains(lower({x}), c))"
    return f"(CASE WHEN {x} IS NULL OR len({found}) = 0 THEN ['none'] ELSE {found} END)"


def _model_case(rule) -> str:
    return "CASE model " + " ".join(f"WHEN {s(m)} THEN {rule(*n)}" for m, n in MODELS.items()) + " END"


_MODEL_VALUES = ", ".join(f"({s(m)})" for m in MODELS)
MODELS_CTE = f"models AS (SELECT * FROM (VALUES {_MODEL_VALUES}) v(model))"
DETECTIONS = f"""raw_detections AS (
  SELECT dataset.*, model,
         CASE WHEN {_model_case(lambda a, b, bar: f'(sentence_id*{a} + plan_ord*{b}) % 10 < {bar}')}
              THEN upper(biases) ELSE {pick(CANNED_LABELS, 'sentence_id*7 + plan_ord*5')} END AS raw_model_response
  FROM dataset, models),
detections AS (
  SELECT *, array_to_string({predicted('raw_model_response')}, ',') AS predicted_biases FROM raw_detections)"""
REWRITES = """rewrites AS (
  SELECT *, model || ' gold: ' || original_sentence AS true_bias_rewrite,
         model || ' detected: ' || original_sentence AS detected_bias_rewrite FROM detections)"""


# --- judge ----------------------------------------------------------------------


def judge_columns(raw: str = "judge_response") -> str:
    """The three scores of a response, for objects of numbers, booleans and short strings."""
    body = strip(raw)
    for fence in ("^```json", "^```", "```$"):
        body = f"regexp_replace({body}, '{fence}', '')"
    return strip(body)


def judge_ctes(source: str, raw: str = "judge_response", out: str = "judgements") -> str:
    keys = ["trigger_removed", "facts_preserved", "natural_language"]

    def score(k: str) -> str:
        return f"""CASE json_type(j, '$.{k}') WHEN 'NULL' THEN NULL
             WHEN 'BOOLEAN' THEN (j->>'{k}')::BOOLEAN::INT
             WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match(j->>'{k}', ' *[+-]?[0-9]+ *') THEN (j->>'{k}')::INT END
             ELSE CASE WHEN json_type(j, '$.{k}') IS NULL THEN 0 ELSE trunc((j->>'{k}')::DOUBLE)::INT END END"""

    return f"""{out}_body AS (SELECT *, {judge_columns(raw)} AS body FROM {source}),
{out}_json AS (
  SELECT *, CASE WHEN CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' END THEN body::JSON END AS j
  FROM {out}_body),
{out}_scores AS (SELECT *, {', '.join(f'{score(k)} AS s{i}' for i, k in enumerate(keys))} FROM {out}_json),
{out} AS (
  SELECT * EXCLUDE (body, j, s0, s1, s2), {', '.join(
      f'CASE WHEN j IS NULL OR s0 IS NULL OR s1 IS NULL OR s2 IS NULL THEN -1 ELSE s{i} END::INT AS {k}'
      for i, k in enumerate(keys))}
  FROM {out}_scores)"""


JUDGED = f"""judge_raw AS (
  SELECT *, {pick(CANNED_JUDGE, f"sentence_id*13 + plan_ord*7 + {_model_case(lambda a, b, c: a)}")} AS judge_response
  FROM rewrites WHERE biases <> 'none'),
{judge_ctes('judge_raw')}"""


# --- conditions -----------------------------------------------------------------

_COND_VALUES = ", ".join(
    f"({i}, {s(c)}, {str(c in CLEAN_CONDITIONS).upper()}, {s('cot' if c.startswith('4_') else 'plain')})"
    for i, c in enumerate(ALL_CONDITIONS)
)
CONDITIONS = f"conditions AS (SELECT * FROM (VALUES {_COND_VALUES}) v(condition_ord, condition, clean, parser))"


def sentiment_word(x: str) -> str:
    return (
        f"CASE WHEN contains(lower({x}), 'positive') THEN 'positive' "
        f"WHEN contains(lower({x}), 'negative') THEN 'negative' "
        f"WHEN contains(lower({x}), 'neutral') THEN 'neutral' END"
    )


def plain_sentiment(x: str) -> str:
    return f"coalesce({sentiment_word(x)}, 'neutral')"


def cot_sentiment(x: str) -> str:
    last = f"string_split(lower({x}), 'final answer:')[-1]"
    return f"coalesce({sentiment_word(last)}, {sentiment_word(x)}, 'neutral')"


PREDICTIONS = f"""asked AS (
  SELECT rewrites.*, condition, condition_ord, parser,
         CASE WHEN {_model_case(lambda a, b, bar: f'(sentence_id*{b} + plan_ord*{a} + condition_ord) % 10 < {bar}')}
              THEN 'FINAL ANSWER: ' || label
              ELSE {pick(CANNED_SENTIMENTS, 'sentence_id*5 + plan_ord*3 + condition_ord')} END AS predicted_sentiment
  FROM rewrites, conditions WHERE clean = (biases = 'none')),
predictions AS (
  SELECT *, CASE parser WHEN 'cot' THEN {cot_sentiment('predicted_sentiment')}
                        ELSE {plain_sentiment('predicted_sentiment')} END AS parsed_sentiment,
         (condition_ord*1000 + plan_ord)::BIGINT * 1000000000 + sentence_id AS seq
  FROM asked)"""

_NEEDS = {
    "base": [],
    "plan": [],
    "models": [],
    "conditions": [],
    "dataset": ["base", "plan"],
    "detections": ["dataset", "models"],
    "rewrites": ["detections"],
    "judgements": ["rewrites"],
    "predictions": ["rewrites", "conditions"],
}
_TEXT = {
    "base": BASE,
    "plan": PLAN,
    "models": MODELS_CTE,
    "conditions": CONDITIONS,
    "dataset": DATASET,
    "detections": DETECTIONS,
    "rewrites": REWRITES,
    "judgements": JUDGED,
    "predictions": PREDICTIONS,
}


def using(names: str, select: str, *more: str) -> str:
    """A statement on the named stage tables and further expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [_TEXT[n] for n in order] + list(more)
    return f"WITH {', '.join(parts)} {select}" if parts else select


# --- scores ----------------------------------------------------------------------


def label_list(x: str) -> str:
    cells = f"list_filter(list_transform(string_split({x}, ','), lambda c: {strip('lower(c)')}), lambda c: c <> '')"
    return f"(CASE WHEN {x} IS NULL OR lower({strip(x)}) IN ('', 'none') THEN ['none'] ELSE {cells} END)"


def class_counts(gold: str, pred: str, classes: Sequence[str]) -> str:
    out = []
    for i, c in enumerate(classes):
        g, p = f"list_contains({gold}, {s(c)})", f"list_contains({pred}, {s(c)})"
        out.append(f"count(*) FILTER (WHERE {g} AND {p}) AS tp{i}")
        out.append(f"count(*) FILTER (WHERE {p}) AS pp{i}")
        out.append(f"count(*) FILTER (WHERE {g}) AS sup{i}")
    return ", ".join(out)


def f1_of(i: int) -> str:
    return div(f"2*tp{i}", f"pp{i} + sup{i}")


def mean(parts: Sequence[str]) -> str:
    return f"(({' + '.join(parts)}) / {len(parts)})"


def _weighted(parts: Sequence[str]) -> str:
    k = len(parts)
    top = " + ".join(f"{x} * sup{i}::DOUBLE" for i, x in enumerate(parts))
    return div(top, " + ".join(f"sup{i}" for i in range(k)))


def averages(k: int, ord_from: int, prefix: str) -> list[str]:
    """Rows of the macro and weighted averages over k classes."""
    p = [div(f"tp{i}", f"pp{i}") for i in range(k)]
    r = [div(f"tp{i}", f"sup{i}") for i in range(k)]
    f = [f1_of(i) for i in range(k)]
    sup = " + ".join(f"sup{i}" for i in range(k))
    return [
        f"SELECT {prefix}, {ord_from} AS class_ord, 'macro avg' AS class, {mean(p)} AS precision, "
        f"{mean(r)} AS recall, {mean(f)} AS f1, {sup} AS support FROM c",
        f"SELECT {prefix}, {ord_from + 1}, 'weighted avg', {_weighted(p)}, {_weighted(r)}, {_weighted(f)}, {sup} FROM c",
    ]


def label_report() -> str:
    k = len(CUE_CLASSES)
    sets = f"""sets AS (
  SELECT model, list_filter(list_distinct({label_list('biases')}), lambda x: list_contains({lst(CUE_CLASSES)}, x)) AS t,
         list_filter(list_distinct({label_list('predicted_biases')}), lambda x: list_contains({lst(CUE_CLASSES)}, x)) AS p
  FROM detections)"""
    both = "len(list_intersect(t, p))"
    unit = 360360
    scaled = [
        f"sum(CASE WHEN len(p) = 0 THEN 0 ELSE {both} * ({unit} // len(p)) END) AS s_p",
        f"sum(CASE WHEN len(t) = 0 THEN 0 ELSE {both} * ({unit} // len(t)) END) AS s_r",
        f"sum(CASE WHEN len(t) + len(p) = 0 THEN 0 ELSE 2 * {both} * ({unit} // (len(t) + len(p))) END) AS s_f",
    ]
    counts = f"c AS (SELECT model, {class_counts('t', 'p', CUE_CLASSES)}, {', '.join(scaled)}, count(*) AS n FROM sets GROUP BY model)"
    tp, pp, sup = (" + ".join(f"{x}{i}" for i in range(k)) for x in ("tp", "pp", "sup"))
    rows = [
        f"SELECT model, {i} AS class_ord, {s(c)} AS class, {div(f'tp{i}', f'pp{i}')} AS precision, "
        f"{div(f'tp{i}', f'sup{i}')} AS recall, {f1_of(i)} AS f1, sup{i} AS support FROM c"
        for i, c in enumerate(CUE_CLASSES)
    ]
    rows.append(
        f"SELECT model, {k}, 'micro avg', {div(tp, pp)}, {div(tp, sup)}, {div(f'2*({tp})', f'{pp} + {sup}')}, {sup} FROM c"
    )
    rows += averages(k, k + 1, "model")
    rows.append(
        f"SELECT model, {k + 3}, 'samples avg', {div('s_p', f'n*{unit}')}, {div('s_r', f'n*{unit}')}, "
        f"{div('s_f', f'n*{unit}')}, {sup} FROM c"
    )
    body = " UNION ALL ".join(rows)
    return using(
        "detections",
        f"SELECT model, class_ord::INT AS class_ord, class, precision, recall, f1, support::BIGINT AS support FROM ({body})",
        sets,
        counts,
    )


def class_report(source: str, gold: str, pred: str, by: str, classes: Sequence[str] = SENTIMENTS) -> str:
    """Everything after the source tables: a list of expressions and the final select."""
    k = len(classes)
    agg = []
    for i, c in enumerate(classes):
        g, p = f"{gold} IS NOT DISTINCT FROM {s(c)}", f"{pred} IS NOT DISTINCT FROM {s(c)}"
        agg += [
            f"count(*) FILTER (WHERE {g} AND {p}) AS tp{i}",
            f"count(*) FILTER (WHERE {p}) AS pp{i}",
            f"count(*) FILTER (WHERE {g}) AS sup{i}",
        ]
    c = f"""c AS (SELECT {by}, {', '.join(agg)}, count(*) AS n,
  count(*) FILTER (WHERE {gold} = {pred}) AS hits FROM {source} GROUP BY ALL)"""
    rows = [
        f"SELECT {by}, {i} AS class_ord, {s(name)} AS class, {div(f'tp{i}', f'pp{i}')} AS precision, "
        f"{div(f'tp{i}', f'sup{i}')} AS recall, {f1_of(i)} AS f1, sup{i} AS support, n, hits FROM c"
        for i, name in enumerate(classes)
    ]
    rows.append(f"SELECT {by}, {k}, 'accuracy', NULL, NULL, {div('hits', 'n')}, n, n, hits FROM c")
    rows += [x.replace(" FROM c", ", n, hits FROM c") for x in averages(k, k + 1, by)]
    return c, (
        f"SELECT {by}, {div('hits', 'n')} AS accuracy, class_ord::INT AS class_ord, class, precision, recall, f1, "
        f"support::DOUBLE AS support FROM ({' UNION ALL '.join(rows)})"
    )
