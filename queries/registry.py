"""Every operator as a query over the driver's tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelab import schemas
from cuelab.fixed_values import (
    ALL_CONDITIONS,
    CLEAN_CONDITIONS,
    COT_CONDITIONS,
    CUE_CLASSES,
    CUES,
    ERROR_TYPES,
    MISSING_TOKENS,
    REPLACE_PROBABILITY,
    SENTIMENTS,
)
from cuelab.functions import labels as L
from cuelab.functions import sentiment as S
from cuelab.functions import text as X
from cuelab.functions.judge import parse_judge
from cuelab.operators import analysis as A
from cuelab.operators import dataset as D
from cuelab.operators import detection as T
from cuelab.operators import jobs as J
from cuelab.operators import joins as N
from cuelab.operators import metrics as M
from cuelab.operators.diversify import ALL_STEPS, AUTHORITY, FRAMING, HERDING, OVERCONFIDENCE, Step, diversify
from cuelab.operators.generate import SENTIMENT, Call, Params, generate, generate_distinct
from cuelab.plans.conditions import split_biased_clean
from cuelab.plans.injection import bias_plan, expand_models, expand_plan
from cuelab.plans.prompts import INJECTION_TEMPLATES, TASK_TEMPLATES, render
from cuelab.sources import colocated as B
from cuelab.sources import discovery, files, places
from cuelab.sources.batches import BatchTable
from cuelab.streaming.incremental import generate_stream, latest_predictions, run_conditions
from cuelab.workspace import fresh_path, materialise
from queries import recipe as R
from queries import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUICK = Params(backoff_s=0.0)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def col(name: str):
    return F.col(name)


def digest(*names: str):
    """Long texts are compared by md5 of the whole text."""
    return [F.md5(n).alias(n) for n in names]


def digest_sql(*names: str) -> str:
    return ", ".join(f"md5({n}) AS {n}" for n in names)


# --- plan, prompts ------------------------------------------------------------


@query(
    "injection_plan",
    Q.using("dataset", "SELECT sentence_id, label, plan_ord::INT AS plan_ord, biases, stage1, stage2 FROM dataset"),
)
def injection_plan(spark, sf):
    return expand_plan(R.base(spark, sf), bias_plan()).select(
        "sentence_id", "label", "plan_ord", "biases", "stage1", "stage2"
    )


def _prompt_sql(variant: str, cue: str, label: str, sentence: str) -> str:
    whens = []
    for name, t in INJECTION_TEMPLATES.items():
        for c, template in t.cues.items():
            head, tail = template.split("{sentence}")
            whens.append(f"WHEN {variant} = {Q.s(name)} AND {cue} = {Q.s(c)} THEN {Q.s(head)} || {sentence} || {Q.s(tail)}")
        for lab, template in t.framing.items():
            head, tail = template.split("{sentence}")
            whens.append(
                f"WHEN {variant} = {Q.s(name)} AND {cue} = 'framing' AND {label} = {Q.s(lab)} "
                f"THEN {Q.s(head)} || {sentence} || {Q.s(tail)}"
            )
    return f"CASE {' '.join(whens)} END"


_VARIANTS = ", ".join(f"({Q.s(v)})" for v in INJECTION_TEMPLATES)


@query(
    "plan_variants",
    Q.using(
        "dataset",
        "SELECT sentence_id, prompt_variant, plan_ord::INT AS plan_ord, "
        f"md5({_prompt_sql('prompt_variant', 'stage1', 'label', 'original_sentence')}) AS prompt "
        "FROM dataset, variants WHERE stage1 IS NOT NULL",
        f"variants AS (SELECT * FROM (VALUES {_VARIANTS}) v(prompt_variant))",
    ),
)
def plan_variants(spark, sf):
    rows = expand_plan(R.base(spark, sf), bias_plan(clean=False), variants=list(INJECTION_TEMPLATES))
    prompt = J.injection_prompt(col("stage1"), col("label"), col("prompt_variant"), col("sentence"), INJECTION_TEMPLATES)
    return rows.select("sentence_id", "prompt_variant", "plan_ord", F.md5(prompt).alias("prompt"))


def _template_sql(template: str, slots: dict[str, str]) -> str:
    from string import Formatter

    parts = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(Q.s(text))
        if slot is not None:
            parts.append(slots[slot])
    return "(" + " || ".join(parts) + ")"


@query(
    "render_prompt",
    Q.using(
        "dataset",
        f"SELECT example_id, md5({_template_sql(TASK_TEMPLATES.detect, {'sentence': 'biased_sentence'})}) AS prompt FROM dataset",
    ),
)
def render_prompt(spark, sf):
    prompt = render(TASK_TEMPLATES.detect, {"sentence": col("biased_sentence")})
    return R.dataset(spark, sf).select("example_id", F.md5(prompt).alias("prompt"))


_REWRITE_SLOTS = {"predicted_biases": "biases", "sentence": "biased_sentence"}
_JUDGE_SLOTS = {
    "original_sentence": "original_sentence",
    "biased_sentence": "biased_sentence",
    "predicted_biases": "predicted_biases",
    "debiased_sentence": "detected_bias_rewrite",
}


@query(
    "render_multi",
    Q.using(
        "rewrites",
        f"SELECT model, example_id, md5({_template_sql(TASK_TEMPLATES.rewrite, _REWRITE_SLOTS)}) AS rewrite_prompt, "
        f"md5({_template_sql(TASK_TEMPLATES.judge, _JUDGE_SLOTS)}) AS judge_prompt FROM rewrites",
    ),
)
def render_multi(spark, sf):
    def filled(template, slots):
        return F.md5(render(template, {k: col(v) for k, v in slots.items()}))

    return R.rewrites(spark, sf).select(
        "model",
        "example_id",
        filled(TASK_TEMPLATES.rewrite, _REWRITE_SLOTS).alias("rewrite_prompt"),
        filled(TASK_TEMPLATES.judge, _JUDGE_SLOTS).alias("judge_prompt"),
    )


@query(
    "model_grid",
    Q.using(
        "dataset models",
        "SELECT example_id, model, prompt_variant FROM dataset, models, variants",
        f"variants AS (SELECT * FROM (VALUES {_VARIANTS}) v(prompt_variant))",
    ),
)
def model_grid(spark, sf):
    return expand_models(R.plan_rows(spark, sf), list(R.MODELS), list(INJECTION_TEMPLATES)).select(
        "example_id", "model", "prompt_variant"
    )


# --- parsers --------------------------------------------------------------------

# Model answers: the canned ones, and every turn and page as an answer that nobody planned.
_ANSWERS_SQL = """SELECT model || ':' || example_id AS id, raw_model_response AS response FROM detections
  UNION ALL SELECT 'conversation:' || conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'page:' || page_id, html FROM pages"""


def _loose_text(spark, sf):
    turns = R.table(spark, sf, "conversations").select(
        F.concat_ws(":", F.lit("conversation"), "conv_id", "turn").alias("id"), F.col("text").alias("response")
    )
    pages = R.table(spark, sf, "pages").select(
        F.concat_ws(":", F.lit("page"), "page_id").alias("id"), F.col("html").alias("response")
    )
    return turns.unionByName(pages)


def _answers(spark, sf):
    canned = R.detections(spark, sf).select(
        F.concat_ws(":", "model", "example_id").alias("id"), F.col("raw_model_response").alias("response")
    )
    return canned.unionByName(_loose_text(spark, sf))


@query(
    "parse_predictions",
    Q.using(
        "detections",
        f"SELECT id, array_to_string({Q.predicted('response')}, ',') AS predicted_biases FROM answers",
        f"answers AS ({_ANSWERS_SQL})",
    ),
)
def parse_predictions(spark, sf):
    return _answers(spark, sf).select("id", L.join_labels(L.parse_predictions(col("response"))).alias("predicted_biases"))


@query(
    "parse_gold",
    Q.using(
        "detections",
        f"SELECT id, array_to_string({Q.label_list('response')}, '|') AS labels FROM answers",
        f"answers AS ({_ANSWERS_SQL})",
    ),
)
def parse_gold(spark, sf):
    return _answers(spark, sf).select("id", F.array_join(L.parse_gold(col("response")), "|").alias("labels"))


_KNOWN_SQL = (
    f"(CASE WHEN response IS NULL OR response IN ('', 'none') THEN [] ELSE list_filter(list_transform("
    f"string_split(response, ','), lambda c: {Q.strip('c')}), lambda c: list_contains({Q.lst(CUES)}, c)) END)"
)


@query(
    "parse_label_sets",
    Q.using(
        "detections",
        "SELECT id, array_to_string(list_sort(list_distinct(g)), '|') AS with_none, "
        "array_to_string(list_sort(list_filter(list_distinct(g), lambda c: c <> 'none')), '|') AS without_none, "
        "array_to_string(list_sort(list_distinct(k)), '|') AS known FROM parsed",
        f"answers AS ({_ANSWERS_SQL})",
        f"parsed AS (SELECT id, {Q.label_list('response')} AS g, {_KNOWN_SQL} AS k FROM answers)",
    ),
)
def parse_label_sets(spark, sf):
    r = col("response")

    def text(labels):
        return F.array_join(F.array_sort(labels), "|")

    return _answers(spark, sf).select(
        "id",
        text(L.label_set(r)).alias("with_none"),
        text(L.label_set_without_none(r)).alias("without_none"),
        text(L.known_labels(r)).alias("known"),
    )


_SENTIMENT_ANSWERS_SQL = """SELECT model || ':' || condition || ':' || example_id AS id, predicted_sentiment AS response FROM predictions
  UNION ALL SELECT 'conversation:' || conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'page:' || page_id, html FROM pages"""


def _sentiment_answers(spark, sf):
    canned = R.predictions(spark, sf).select(
        F.concat_ws(":", "model", "condition", "example_id").alias("id"), F.col("predicted_sentiment").alias("response")
    )
    return canned.unionByName(_loose_text(spark, sf))


@query(
    "parse_sentiment",
    Q.using(
        "predictions",
        f"SELECT id, {Q.plain_sentiment('response')} AS sentiment FROM answers",
        f"answers AS ({_SENTIMENT_ANSWERS_SQL})",
    ),
)
def parse_sentiment(spark, sf):
    return _sentiment_answers(spark, sf).select("id", S.parse_sentiment(col("response")).alias("sentiment"))


@query(
    "parse_cot",
    Q.using(
        "predictions",
        f"SELECT id, {Q.cot_sentiment('response')} AS sentiment FROM answers",
        f"answers AS ({_SENTIMENT_ANSWERS_SQL})",
    ),
)
def parse_cot(spark, sf):
    return _sentiment_answers(spark, sf).select("id", S.parse_sentiment_cot(col("response")).alias("sentiment"))


@query(
    "parse_judge",
    Q.using(
        "judgements",
        "SELECT id, trigger_removed, facts_preserved, natural_language FROM parsed",
        """answers AS (SELECT model || ':' || example_id AS id, judge_response AS response FROM judge_raw
  UNION ALL SELECT 'conversation:' || conv_id || ':' || turn, text FROM conversations
  UNION ALL SELECT 'page:' || page_id, html FROM pages)""",
        Q.judge_ctes("answers", "response", "parsed"),
    ),
)
def parse_judge_answers(spark, sf):
    canned = R.judge_responses(spark, sf).select(
        F.concat_ws(":", "model", "example_id").alias("id"), F.col("judge_response").alias("response")
    )
    answers = canned.unionByName(_loose_text(spark, sf))
    return answers.withColumn("s", parse_judge(col("response"))).select("id", "s.*")


# Characters that must go, between the words of whole documents.
_ODD = "\t\n" + chr(0xA0) + chr(0x200B) + chr(0xFEFF) + " " + chr(0x3000)


@query(
    "strip_nonprintable",
    f"""SELECT doc_id, md5(regexp_replace(text || {Q.s(_ODD)} || replace(text, ' ', {Q.s(_ODD[2:4] + ' ')}),
        '{Q.UNPRINTABLE}', '', 'g')) AS printable FROM documents""",
)
def strip_nonprintable(spark, sf):
    odd = F.concat(col("text"), F.lit(_ODD), F.replace(col("text"), F.lit(" "), F.lit(_ODD[2:4] + " ")))
    return R.table(spark, sf, "documents").select("doc_id", F.md5(X.strip_nonprintable(odd)).alias("printable"))


@query(
    "clean_response",
    f"""SELECT conv_id, turn, md5(replace(replace({Q.strip("chr(10) || ' ' || text || '</s> ' || chr(160) || chr(9)")},
        '</s>', ''), 'on', '')) AS response FROM conversations""",
)
def clean_response(spark, sf):
    raw = F.concat(F.lit("\n "), col("text"), F.lit("</s> " + chr(0xA0) + "\t"))
    return R.table(spark, sf, "conversations").select(
        "conv_id", "turn", F.md5(X.clean_response(raw, ["</s>", "on"])).alias("response")
    )


# --- scores of label sets -------------------------------------------------------


@query("detection_report", Q.label_report())
def detection_report(spark, sf):
    return T.detection_report(R.detections(spark, sf))


_SETS = f"""sets AS (SELECT model, biases, {Q.label_list('biases')} AS t, {Q.label_list('predicted_biases')} AS p FROM detections)"""


@query(
    "f1_per_bias",
    Q.using(
        "detections",
        " UNION ALL ".join(
            f"SELECT model, {Q.s(c)} AS class, {Q.f1_of(i)} AS f1 FROM c" for i, c in enumerate(CUE_CLASSES)
        ),
        _SETS,
        f"c AS (SELECT model, {Q.class_counts('t', 'p', CUE_CLASSES)} FROM sets GROUP BY model)",
    ),
)
def f1_per_bias(spark, sf):
    return T.f1_per_cue(R.detections(spark, sf))


@query(
    "single_vs_pairwise_f1",
    Q.using(
        "detections",
        f"SELECT model, subset, {Q.mean([Q.f1_of(i) for i in range(6)])} AS macro_f1, n AS rows FROM c",
        _SETS,
        f"""c AS (SELECT model, CASE len(t) WHEN 1 THEN 'Single' ELSE 'Pairwise' END AS subset, count(*) AS n,
            {Q.class_counts('t', 'p', CUES)} FROM sets WHERE biases <> 'none' AND len(t) IN (1, 2) GROUP BY ALL)""",
    ),
)
def single_vs_pairwise_f1(spark, sf):
    return T.single_vs_pairwise_f1(R.detection_cells(spark, sf))


_PAIR_LIST = Q.PAIRS + [("framing", c) for c in Q.PLAIN]


def _pair_sql(a: str, b: str) -> str:
    n = {c: i for i, c in enumerate(CUES)}
    return (
        f"SELECT model, '{a},{b}' AS combination, ({Q.f1_of(n[a])} + {Q.f1_of(n[b])}) / 2 AS macro_f1, n AS rows "
        f"FROM c WHERE k = '{','.join(sorted([a, b]))}'"
    )


@query(
    "pair_f1",
    Q.using(
        "detections",
        " UNION ALL ".join(_pair_sql(a, b) for a, b in _PAIR_LIST),
        _SETS,
        f"""c AS (SELECT model, array_to_string(list_sort(t), ',') AS k, count(*) AS n, {Q.class_counts('t', 'p', CUES)}
            FROM sets WHERE len(t) = 2 GROUP BY ALL)""",
    ),
)
def pair_f1(spark, sf):
    return T.pair_f1(R.detection_cells(spark, sf))


@query(
    "none_class_prf",
    Q.using(
        "detections",
        f"SELECT model, {Q.div('tp', 'pp')} AS precision, {Q.div('tp', 'sup')} AS recall, {Q.div('2*tp', 'pp + sup')} AS f1 FROM c",
        """c AS (SELECT model, count(*) FILTER (WHERE biases = 'none' AND predicted_biases = 'none') AS tp,
           count(*) FILTER (WHERE predicted_biases = 'none') AS pp, count(*) FILTER (WHERE biases = 'none') AS sup
           FROM detections GROUP BY model)""",
    ),
)
def none_class_prf(spark, sf):
    return T.none_class(R.detections(spark, sf))


@query(
    "prompt_sensitivity_f1",
    Q.using(
        "detections",
        "SELECT model, max(f) FILTER (WHERE v = 'main') AS main, max(f) FILTER (WHERE v = 'alt_1') AS alt_1, "
        "max(f) FILTER (WHERE v = 'alt_2') AS alt_2 FROM f GROUP BY model",
        f"""sets AS (SELECT model, v, string_split(biases, ',') AS t, list_filter(list_transform(string_split(
              CASE v WHEN 'main' THEN predicted_biases WHEN 'alt_1' THEN raw_model_response
              ELSE lower(raw_model_response) END, ','), lambda x: trim(x)),
              lambda x: list_contains({Q.lst(CUES)}, x)) AS p
            FROM detections, (VALUES ('main'), ('alt_1'), ('alt_2')) x(v) WHERE biases <> 'none')""",
        f"c AS (SELECT model, v, {Q.class_counts('t', 'p', CUES)} FROM sets GROUP BY ALL)",
        f"f AS (SELECT model, v, {Q.mean([Q.f1_of(i) for i in range(6)])} AS f FROM c)",
    ),
)
def prompt_sensitivity_f1(spark, sf):
    # The variants stand for three runs: label cells, raw answers, raw answers in lower case.
    variants, raw = list(INJECTION_TEMPLATES), col("raw_model_response")
    d = R.detection_cells(spark, sf).withColumn("prompt_variant", F.explode(F.array(*[F.lit(v) for v in variants])))
    read = (
        F.when(col("prompt_variant") == "main", col("predicted_biases"))
        .when(col("prompt_variant") == "alt_1", raw)
        .otherwise(F.lower(raw))
    )
    return T.prompt_sensitivity(d.withColumn("predicted_biases", read), variants)


# --- scores of sentiment ----------------------------------------------------------

_SENT_C, _SENT_SELECT = Q.class_report("predictions", "label", "parsed_sentiment", "model, condition")


@query("sentiment_report", Q.using("predictions", f"SELECT * EXCLUDE (accuracy) FROM ({_SENT_SELECT})", _SENT_C))
def sentiment_report(spark, sf):
    by = ["model", "condition"]
    c = M.class_contingency(R.predictions(spark, sf), "label", "parsed_sentiment", by)
    return M.class_report(c, by=by).drop("accuracy")


@query("report_with_accuracy", Q.using("predictions", _SENT_SELECT, _SENT_C))
def report_with_accuracy(spark, sf):
    return A.report_with_accuracy(R.predictions(spark, sf))


_ALL_SQL = f"SELECT * FROM {{0}} UNION ALL BY NAME SELECT * REPLACE ({Q.s(M.ALL)} AS model) FROM {{0}}"
_ALL_C, _ALL_SELECT = Q.class_report("pooled", "label", "parsed_sentiment", "model, condition")


@query("report_all_models", Q.using("predictions", _ALL_SELECT, f"pooled AS ({_ALL_SQL.format('predictions')})", _ALL_C))
def report_all_models(spark, sf):
    return A.report_with_accuracy(R.predictions(spark, sf), totals=["model"])


@query("stored_report_with_accuracy", Q.using("predictions", _SENT_SELECT, _SENT_C))
def stored_report_with_accuracy(spark, sf):
    # A report that was written before is completed from the predictions.
    path = fresh_path(spark, "report")
    sentiment_report(spark, sf).write.parquet(path)
    return A.add_accuracy(spark.read.parquet(path), R.predictions(spark, sf))


@query("detection_report_all", Q.label_report().replace("FROM detections)", f"FROM ({_ALL_SQL.format('detections')}))"))
def detection_report_all(spark, sf):
    return T.detection_report(R.detection_cells(spark, sf), totals=["model"])


_LABEL_C, _LABEL_SELECT = Q.class_report("gold", "quality", "toxic", "source", ["0", "1"])


@query(
    "labels_report",
    f"""WITH gold AS (SELECT source, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic
        FROM documents JOIN labels USING (doc_id)), {_LABEL_C} {_LABEL_SELECT}""",
)
def labels_report(spark, sf):
    docs = R.table(spark, sf, "documents").select("doc_id", "source")
    gold = R.table(spark, sf, "labels").select(
        "doc_id", col("quality").cast("string").alias("quality"), col("toxic").cast("string").alias("toxic")
    )
    c = M.class_contingency(docs.join(gold, "doc_id"), "quality", "toxic", ["source"])
    return M.class_report(c, ["0", "1"], ["source"])


@query(
    "condition_accuracy",
    Q.using(
        "predictions",
        f"SELECT model, condition, {Q.div('count(*) FILTER (WHERE label = parsed_sentiment)', 'count(*)')} AS accuracy, "
        "count(*) AS rows FROM predictions GROUP BY ALL",
    ),
)
def condition_accuracy(spark, sf):
    return A.condition_accuracy(R.predictions(spark, sf))


@query(
    "pairwise_accuracy",
    Q.using(
        "predictions",
        f"SELECT model, condition, {Q.div('count(*) FILTER (WHERE label = parsed_sentiment)', 'count(*)')} AS accuracy, "
        "count(*) AS rows FROM predictions WHERE biases LIKE '%,%' GROUP BY ALL",
    ),
)
def pairwise_accuracy(spark, sf):
    return A.pairwise_accuracy(R.predictions(spark, sf))


@query(
    "single_bias_accuracy",
    Q.using(
        "predictions",
        f"SELECT model, biases, condition, {Q.div('count(*) FILTER (WHERE label = parsed_sentiment)', 'count(*)')} AS accuracy, "
        "count(*) AS rows FROM predictions WHERE biases NOT LIKE '%,%' AND biases <> 'none' GROUP BY ALL",
    ),
)
def single_bias_accuracy(spark, sf):
    return A.single_cue_accuracy(R.predictions(spark, sf))


_FAIL_SQL = " AND ".join(f"NOT contains(lower(coalesce(predicted_sentiment, '')), '{w}')" for w in SENTIMENTS)
_COT_SQL = f"""cot AS (SELECT model, condition, count(*) AS total, count(*) FILTER (WHERE {_FAIL_SQL}) AS format_failures
  FROM predictions WHERE condition IN ({', '.join(Q.s(c) for c in COT_CONDITIONS)}) GROUP BY ALL),
cot_pct AS (SELECT *, {Q.div('format_failures', 'total')} * 100 AS failure_rate_pct FROM cot)"""


@query("cot_format_failures", Q.using("predictions", "SELECT * FROM cot_pct", _COT_SQL))
def cot_format_failures(spark, sf):
    return A.cot_format_failures(R.predictions(spark, sf))


@query(
    "pivot_cot",
    Q.using(
        "predictions",
        "SELECT model, "
        + ", ".join(
            f'max({m}) FILTER (WHERE condition = {Q.s(c)}) AS "{c}_{m}"'
            for c in COT_CONDITIONS
            for m in ("total", "format_failures", "failure_rate_pct")
        )
        + " FROM cot_pct GROUP BY model",
        _COT_SQL,
    ),
)
def pivot_cot(spark, sf):
    measures = ["total", "format_failures", "failure_rate_pct"]
    return A.pivot(cot_format_failures(spark, sf), ["model"], "condition", COT_CONDITIONS, measures)


_LOST_SQL = "predicted_sentiment = ''"


@query(
    "null_prediction_rate",
    Q.using(
        "predictions",
        f"SELECT model, count(*) AS rows, count(*) FILTER (WHERE m) AS missing, "
        f"{Q.div('count(*) FILTER (WHERE m)', 'count(*)')} * 100 AS missing_pct, "
        f"{Q.div('count(*) FILTER (WHERE NOT m AND label = parsed_sentiment)', 'count(*)')} AS accuracy "
        f"FROM (SELECT *, {_LOST_SQL} AS m FROM predictions) GROUP BY model",
    ),
)
def null_prediction_rate(spark, sf):
    # A blank answer has no parsed cell: it is missing and counts as wrong.
    answered = col("predicted_sentiment") != ""
    p = R.predictions(spark, sf).withColumn("parsed_sentiment", F.when(answered, col("parsed_sentiment")))
    rates, scores = A.null_rate(p, "parsed_sentiment"), M.accuracy(p, "label", "parsed_sentiment", ["model"])
    return rates.join(scores.drop("rows"), "model")


# --- judge scores ---------------------------------------------------------------

_JUDGE_SCORES = ["trigger_removed", "facts_preserved", "natural_language"]


@query(
    "judge_summary",
    Q.using(
        "judgements",
        "SELECT model, count(*) AS total_evaluated, count(*) FILTER (WHERE trigger_removed <> -1) AS valid_responses, "
        "count(*) FILTER (WHERE trigger_removed = -1) AS parse_failures, "
        + ", ".join(
            Q.div(f"sum({x}) FILTER (WHERE trigger_removed <> -1)", "count(*) FILTER (WHERE trigger_removed <> -1)")
            + f" AS {x}_rate"
            for x in _JUDGE_SCORES
        )
        + " FROM judgements GROUP BY model",
    ),
)
def judge_summary(spark, sf):
    return A.judge_summary(R.judgements(spark, sf))


@query(
    "judge_per_bias",
    Q.using(
        "judgements",
        "SELECT model, biases, "
        + ", ".join(f"{Q.div(f'sum({x})', 'count(*)')} AS {x}" for x in _JUDGE_SCORES)
        + " FROM judgements WHERE trigger_removed <> -1 GROUP BY ALL",
    ),
)
def judge_per_bias(spark, sf):
    return A.judge_per_combination(R.judgements(spark, sf))


def _removal_sql(where: str) -> str:
    cues = ", ".join(f"({Q.s(c)})" for c in CUES)
    return f"""removal AS (SELECT model, bias_type, CASE WHEN contains(biases, ',') THEN 'Pairwise' ELSE 'Single' END AS subset,
  count(*) AS rows, {Q.div('sum(trigger_removed)', 'count(*)')} * 100 AS trigger_removed_pct,
  {Q.div('sum(facts_preserved)', 'count(*)')} * 100 AS facts_preserved_pct
  FROM judgements, (VALUES {cues}) c(bias_type)
  WHERE (biases = bias_type OR (contains(biases, ',') AND contains(biases, bias_type))){where} GROUP BY ALL)"""


@query(
    "removal_by_bias_subset",
    Q.using("judgements", "SELECT * FROM removal", _removal_sql(" AND trigger_removed <> -1")),
)
def removal_by_bias_subset(spark, sf):
    return A.removal_by_cue(R.judgements(spark, sf))


_WANTED = ["model_c", "model_a", "model_x", "model_b"]


@query(
    "pivot_removal",
    Q.using(
        "judgements",
        "SELECT bias_type, subset, "
        + ", ".join(f"max(trigger_removed_pct) FILTER (WHERE model = '{m}') AS {m}" for m in _WANTED)
        + " FROM removal GROUP BY ALL",
        _removal_sql(""),
    ),
)
def pivot_removal(spark, sf):
    r = A.removal_by_cue(R.judgements(spark, sf), failures="include")
    return A.pivot(r, ["bias_type", "subset"], "model", _WANTED, ["trigger_removed_pct"])


@query(
    "reindex_models",
    Q.using(
        "judgements",
        "SELECT model_ord, model, total_evaluated, valid_responses FROM (VALUES "
        + ", ".join(f"({i}, '{m}')" for i, m in enumerate(_WANTED))
        + ") w(model_ord, model) LEFT JOIN (SELECT model, count(*) AS total_evaluated, "
        "count(*) FILTER (WHERE trigger_removed <> -1) AS valid_responses FROM judgements GROUP BY model) USING (model)",
    ),
)
def reindex_models(spark, sf):
    summary = A.judge_summary(R.judgements(spark, sf)).select("model", "total_evaluated", "valid_responses")
    return N.reindex(summary, "model", _WANTED)


_ERRORS_SQL = "errors AS (" + " UNION ALL ".join(
    f"SELECT model, example_id, biases AS bias_type, {Q.s(name)} AS error_type, original_sentence, biased_sentence, "
    f"detected_bias_rewrite AS model_rewrite FROM judgements WHERE {score} = 0"
    for score, name in ERROR_TYPES.items()
) + ")"
_ERROR_TEXTS = ("original_sentence", "biased_sentence", "model_rewrite")


@query(
    "error_rows",
    Q.using(
        "judgements",
        f"SELECT model, example_id, bias_type, error_type, {digest_sql(*_ERROR_TEXTS)} FROM errors",
        _ERRORS_SQL,
    ),
)
def error_rows(spark, sf):
    e = A.error_rows(R.judgements(spark, sf), carry=["model", "example_id"])
    return e.select("model", "example_id", "bias_type", "error_type", *digest(*_ERROR_TEXTS))


@query(
    "error_sample",
    Q.using(
        "judgements",
        f"SELECT model, example_id, bias_type, error_type, {digest_sql(*_ERROR_TEXTS)} FROM errors "
        "ORDER BY md5('42|' || model || '|' || example_id || '|' || error_type), model, example_id, error_type LIMIT 100",
        _ERRORS_SQL,
    ),
)
def error_sample(spark, sf):
    e = A.error_sample(R.judgements(spark, sf))
    return e.select("model", "example_id", "bias_type", "error_type", *digest(*_ERROR_TEXTS))


_RATES = {
    "step": ("(doc_id % 20000) / 2000.0::DOUBLE", lambda: F.pmod("doc_id", F.lit(20000)) / F.lit(2000.0)),
    "sixteenth": ("(doc_id % 4001 - 2000) / 16.0::DOUBLE", lambda: (F.pmod("doc_id", F.lit(4001)) - 2000) / F.lit(16.0)),
    "seventh": ("length(text) / 7.0::DOUBLE", lambda: F.length("text") / F.lit(7.0)),
    "small": ("length(text) / 1e9::DOUBLE", lambda: F.length("text") / F.lit(1e9)),
}
_DIGITS = (1, 2, 3, 6)


@query(
    "round_rates",
    "SELECT doc_id, "
    + ", ".join(f"format('{{:.{d}f}}', {sql})::DOUBLE + 0 AS {name}_{d}" for name, (sql, _) in _RATES.items() for d in _DIGITS)
    + " FROM documents",
)
def round_rates(spark, sf):
    # Steps of 0.0005 (of which few are true ties), of 1/16 (all of them ties at three digits), and others.
    d = R.table(spark, sf, "documents").select(
        "doc_id", *[x().cast("double").alias(f"{name}_{d}") for name, (_, x) in _RATES.items() for d in _DIGITS]
    )
    for digits in _DIGITS:
        d = A.rounded(d, digits, [f"{name}_{digits}" for name in _RATES])
    return d.select("doc_id", *[(col(c) + 0.0).alias(c) for c in d.columns if c != "doc_id"])


@query(
    "composition",
    Q.using(
        "dataset",
        """SELECT 'label' AS part, label AS value, count(*) AS n FROM dataset GROUP BY label
           UNION ALL SELECT 'biases', biases, count(*) FROM dataset GROUP BY biases""",
    ),
)
def composition(spark, sf):
    return A.composition(R.dataset(spark, sf), ["label", "biases"])


# --- dataset ----------------------------------------------------------------------


@query(
    "split_biased_clean",
    Q.using(
        "dataset",
        "SELECT part, count(*) AS n, sum(('0x' || substr(md5(biased_sentence), 1, 8))::BIGINT)::BIGINT AS texts FROM "
        "(SELECT *, CASE WHEN biases IS NOT DISTINCT FROM 'none' THEN 'clean' ELSE 'biased' END AS part FROM "
        "(SELECT biased_sentence, nullif(biases, 'herding,recency') AS biases FROM dataset)) GROUP BY part",
    ),
)
def split_biased_clean_counts(spark, sf):
    # Some cells are missing: they belong to the biased part.
    d = R.dataset(spark, sf).withColumn("biases", F.nullif(col("biases"), F.lit("herding,recency")))
    number = F.conv(F.substring(F.md5("biased_sentence"), 1, 8), 16, 10).cast("bigint")
    parts = [p.select(F.lit(name).alias("part"), number.alias("t")) for name, p in zip(("biased", "clean"), split_biased_clean(d))]
    return D.union_all(parts).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("texts"))


@query(
    "assemble_dataset",
    Q.using(
        "dataset",
        f"SELECT example_id, label, biases, {digest_sql('original_sentence', 'biased_sentence')} FROM dataset",
    ),
)
def assemble_dataset(spark, sf):
    injected = R.dataset(spark, sf).filter(col("biases") != "none")
    whole = D.shuffled(D.assemble(injected, R.base(spark, sf)))
    return whole.select("example_id", "label", "biases", *digest("original_sentence", "biased_sentence"))


@query(
    "shuffle_rank",
    Q.using(
        "dataset",
        "SELECT example_id, biases, row_number() OVER (ORDER BY md5('42|' || example_id), example_id) - 1 AS position FROM dataset",
    ),
)
def shuffle_rank(spark, sf):
    return D.shuffle_position(R.plan_rows(spark, sf).select("example_id", "biases"))


@query(
    "stratified_sample",
    Q.using(
        "base",
        "SELECT sentence_id, label, md5(sentence) AS sentence FROM base "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || sentence_id), sentence_id) <= 10",
    ),
)
def stratified_sample(spark, sf):
    return D.stratified_sample(R.base(spark, sf), "label", 10).select("sentence_id", "label", *digest("sentence"))


@query(
    "stratified_sample_large",
    Q.using(
        "dataset",
        "SELECT example_id, biases FROM dataset "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7|' || example_id), example_id) <= 1500",
    ),
)
def stratified_sample_large(spark, sf):
    rows = R.plan_rows(spark, sf).select("example_id", "label", "biases")
    return D.stratified_sample(rows, "label", 1500, seed=7, key="example_id").select("example_id", "biases")


@query(
    "dedup_keep_last",
    Q.using(
        "predictions",
        f"""SELECT model, condition, example_id, seq, parsed_sentiment FROM predictions
            QUALIFY row_number() OVER (PARTITION BY model, condition, CASE WHEN condition IN
            ({', '.join(Q.s(c) for c in CLEAN_CONDITIONS)}) THEN original_sentence ELSE biased_sentence END
            ORDER BY seq DESC) = 1""",
    ),
)
def dedup_keep_last(spark, sf):
    kept = D.keep_last_predictions(R.predictions(spark, sf), original="original_key", biased="biased_key")
    return kept.select("model", "condition", "example_id", "seq", "parsed_sentiment")


@query(
    "sensitivity_plan",
    Q.using(
        "dataset",
        "SELECT sentence_id, prompt_variant, plan_ord::INT AS plan_ord, biases, "
        f"md5({_prompt_sql('prompt_variant', 'stage1', 'label', 'original_sentence')}) AS prompt "
        "FROM dataset JOIN chosen USING (sentence_id), (VALUES ('alt_1'), ('alt_2')) v(prompt_variant) WHERE biases <> 'none'",
        "chosen AS (SELECT sentence_id FROM base "
        "QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || sentence_id), sentence_id) <= 10)",
    ),
)
def sensitivity_plan(spark, sf):
    # The sample of the sensitivity study: ten sentences per label, under the other two wordings.
    sample = D.stratified_sample(R.base(spark, sf), "label", 10)
    rows = expand_plan(sample, bias_plan(clean=False), variants=["alt_1", "alt_2"])
    prompt = J.injection_prompt(col("stage1"), col("label"), col("prompt_variant"), col("sentence"), INJECTION_TEMPLATES)
    return rows.select("sentence_id", "prompt_variant", "plan_ord", "biases", F.md5(prompt).alias("prompt"))


# --- diversification ---------------------------------------------------------------


def _step_sql(step: Step, text: str, seed: int = 42, p: float = REPLACE_PROBABILITY) -> str:
    """One step over a text expression of a table with ``example_id``."""
    finds = Q.lst(step.finds)
    digest_ = f"md5('{seed}|{step.name}|' || example_id)"

    def number(part: int) -> str:
        return f"('0x' || substr({digest_}, {8 * part + 1}, 8))::BIGINT"

    find = f"list_filter({finds}, lambda f: contains(lower({text}), lower(f)))[1]"
    options = "[" + ", ".join(Q.lst(o) for o in step.options) + "]" if len(set(step.options)) > 1 else None
    own = f"{options}[list_position({finds}, {find})]" if options else Q.lst(step.options[0])
    option = f"{own}[{number(1)} % len({own}) + 1]"
    return (
        f"CASE WHEN {number(0)} <= {int(p * 2**32)} AND {find} IS NOT NULL "
        f"THEN regexp_replace({text}, '(?i)' || regexp_escape({find}), {option}) ELSE {text} END"
    )


def _diversify_sql(*steps: Step) -> str:
    ctes, source = [], "dataset"
    for i, st in enumerate(steps):
        ctes.append(f"step{i} AS (SELECT example_id, biases, {_step_sql(st, 'biased_sentence')} AS biased_sentence FROM {source})")
        source = f"step{i}"
    return Q.using("dataset", f"SELECT example_id, biases, {digest_sql('biased_sentence')} FROM {source}", *ctes)


def _diversified(spark, sf, *steps: Step):
    d = R.dataset(spark, sf).select("example_id", "biases", "biased_sentence")
    return diversify(d, steps).select("example_id", "biases", *digest("biased_sentence"))


@query("diversify_authority", _diversify_sql(AUTHORITY))
def diversify_authority(spark, sf):
    return _diversified(spark, sf, AUTHORITY)


@query("diversify_herding", _diversify_sql(HERDING))
def diversify_herding(spark, sf):
    return _diversified(spark, sf, HERDING)


@query("diversify_overconf", _diversify_sql(OVERCONFIDENCE))
def diversify_overconf(spark, sf):
    return _diversified(spark, sf, OVERCONFIDENCE)


@query("diversify_framing", _diversify_sql(FRAMING))
def diversify_framing(spark, sf):
    return _diversified(spark, sf, FRAMING)


@query("diversify_all", _diversify_sql(*ALL_STEPS))
def diversify_all(spark, sf):
    return _diversified(spark, sf, *ALL_STEPS)


# --- model calls ---------------------------------------------------------------------


def _digest_answer(tag: str, system: str, prompt: str) -> str:
    return f"('{tag} ' || md5({system} || '|' || {prompt}))"


def _canned_answer(answers, system: str, prompt: str) -> str:
    number = f"('0x' || substr(md5({system} || chr(10) || {prompt}), 1, 8))::BIGINT"
    return Q.strip(Q.pick(answers, number))


@query(
    "generate_batch",
    Q.using("dataset", f"SELECT example_id, {_digest_answer('out', Q.s('be brief'), 'biased_sentence')} AS response FROM dataset"),
)
def generate_batch(spark, sf):
    d = R.dataset(spark, sf).select("example_id", F.col("biased_sentence").alias("prompt"))
    out = generate(d, R.digest_backend("out"), [Call("response", "prompt", "be brief")], QUICK, drop=["prompt"])
    return out.select("example_id", "response")


@query(
    "generate_distinct",
    Q.using("dataset", f"SELECT example_id, {_digest_answer('out', Q.s('be brief'), 'original_sentence')} AS response FROM dataset"),
)
def generate_distinct_prompts(spark, sf):
    d = R.dataset(spark, sf).select("example_id", F.col("original_sentence").alias("prompt"))
    out = generate_distinct(d, R.digest_backend("out"), Call("response", "prompt", "be brief"), QUICK, row_id="example_id")
    return out.select("example_id", "response")


@query(
    "generate_errors",
    Q.using(
        "base",
        """SELECT sentence_id, CASE WHEN contains(sentence, 'the') THEN NULL ELSE length(sentence)::VARCHAR END AS response,
           CASE WHEN contains(sentence, 'the') THEN 'response: RuntimeError: refused' END AS error FROM base""",
    ),
)
def generate_errors(spark, sf):
    d = R.base(spark, sf).select("sentence_id", F.col("sentence").alias("prompt"))
    return generate(d, R.refusing(R.length_backend, "the"), [Call("response")], QUICK, drop=["prompt"])


@query(
    "generate_retry",
    Q.using(
        "base",
        """SELECT sentence_id, CASE WHEN contains(sentence, 'tion') THEN NULL ELSE length(sentence)::VARCHAR END AS response,
           CASE WHEN contains(sentence, 'tion') THEN 'response: RuntimeError: refused' END AS error FROM base""",
    ),
)
def generate_retry(spark, sf):
    # Prompts with one word fail once, those with another fail always; both wait their turn while others go on.
    d = R.base(spark, sf).select("sentence_id", F.col("sentence").alias("prompt"))
    backend = R.refusing(R.stumbling(R.length_backend, "the"), "tion")
    return generate(d, backend, [Call("response")], Params(backoff_s=0.5), drop=["prompt"])


_LABEL_ANSWERS = R.CANNED_LABELS + CUES
_DETECT_PROMPT = _template_sql(TASK_TEMPLATES.detect, {"sentence": "biased_sentence"})


@query(
    "detect_labels",
    Q.using(
        "dataset",
        f"SELECT example_id, raw_model_response, array_to_string({Q.predicted('raw_model_response')}, ',') AS predicted_biases FROM a",
        f"a AS (SELECT example_id, {_canned_answer(_LABEL_ANSWERS, Q.s(TASK_TEMPLATES.detect_system), _DETECT_PROMPT)} "
        "AS raw_model_response FROM dataset)",
    ),
)
def detect_labels(spark, sf):
    d = J.detect(R.dataset(spark, sf).select("example_id", "biased_sentence"), R.canned_backend(_LABEL_ANSWERS))
    return d.select("example_id", "raw_model_response", L.join_labels(col("predicted_biases")).alias("predicted_biases"))


def _rewrite_sql(labels: str) -> str:
    prompt = _template_sql(TASK_TEMPLATES.rewrite, {"predicted_biases": labels, "sentence": "biased_sentence"})
    return _digest_answer("rewritten", Q.s(TASK_TEMPLATES.rewrite_system), prompt)


@query(
    "rewrite_two_sources",
    Q.using(
        "detections",
        f"SELECT model, example_id, {_rewrite_sql('biases')} AS true_bias_rewrite, "
        f"{_rewrite_sql('predicted_biases')} AS detected_bias_rewrite FROM detections",
    ),
)
def rewrite_two_sources(spark, sf):
    r = J.rewrite(R.detections(spark, sf), R.digest_backend("rewritten"), keep=["model", "example_id"])
    return r.select("model", "example_id", "true_bias_rewrite", "detected_bias_rewrite")


_JUDGE_PROMPT = _template_sql(TASK_TEMPLATES.judge, _JUDGE_SLOTS)


@query(
    "judge_scores",
    Q.using(
        "rewrites",
        "SELECT model, example_id, trigger_removed, facts_preserved, natural_language FROM scored",
        f"a AS (SELECT model, example_id, {_canned_answer(R.CANNED_JUDGE, Q.s(TASK_TEMPLATES.judge_system), _JUDGE_PROMPT)} "
        "AS judge_response FROM rewrites WHERE biases <> 'none')",
        Q.judge_ctes("a", "judge_response", "scored"),
    ),
)
def judge_scores(spark, sf):
    j = J.judge(R.rewrites(spark, sf), R.canned_backend(R.CANNED_JUDGE), keep=["model", "example_id"])
    return j.select("model", "example_id", *_JUDGE_SCORES)


def _condition_sql() -> tuple[str, str]:
    from cuelab.plans.conditions import sentiment_conditions

    prompts, systems = [], []
    for c in sentiment_conditions():
        slots = {"sentence": c.input_col}
        if c.labels_col:
            slots["bias_type"] = c.labels_col
        prompts.append(f"WHEN {Q.s(c.name)} THEN {_template_sql(c.template, slots)}")
        systems.append(f"WHEN {Q.s(c.name)} THEN {Q.s(c.system)}")
    return f"CASE condition {' '.join(systems)} END", f"CASE condition {' '.join(prompts)} END"


_SYS, _PROMPT = _condition_sql()


@query(
    "defense_conditions",
    Q.using(
        "rewrites conditions",
        f"""SELECT model, condition, example_id, predicted_sentiment, CASE parser WHEN 'cot' THEN
            {Q.cot_sentiment('predicted_sentiment')} ELSE {Q.plain_sentiment('predicted_sentiment')} END AS parsed_sentiment FROM a""",
        f"""a AS (SELECT model, condition, parser, example_id, {_canned_answer(R.CANNED_SENTIMENTS, 'sys', 'prompt')} AS predicted_sentiment
            FROM (SELECT *, {_SYS} AS sys, {_PROMPT} AS prompt FROM rewrites, conditions WHERE clean = (biases = 'none')))""",
    ),
)
def defense_conditions(spark, sf):
    keep = ["model", "example_id"]
    p = J.classify_under_conditions(R.rewrites(spark, sf), R.canned_backend(R.CANNED_SENTIMENTS), keep=keep)
    return p.select("model", "condition", "example_id", "predicted_sentiment", "parsed_sentiment")


# --- jobs of which some calls fail ---------------------------------------------------------

_FAILS = "(('0x' || substr(md5({0} || chr(10) || {1}), 1, 8))::BIGINT % 7 = 0)"
_ONCE = Params(attempts=1, backoff_s=0.0, batch_size=4)
_DETECT_SYS, _REWRITE_SYS = Q.s(TASK_TEMPLATES.detect_system), Q.s(TASK_TEMPLATES.rewrite_system)
_FAILING_DETECTIONS = f"""found AS (SELECT 'm' AS model, *, CASE WHEN NOT {_FAILS.format(_DETECT_SYS, _DETECT_PROMPT)}
  THEN {_canned_answer(_LABEL_ANSWERS, _DETECT_SYS, _DETECT_PROMPT)} END AS raw_model_response FROM dataset),
detections AS (SELECT *, CASE WHEN raw_model_response IS NOT NULL THEN array_to_string({Q.predicted('raw_model_response')}, ',') END AS predicted_biases FROM found)"""


def _failing_detections(spark, sf):
    rows = R.dataset(spark, sf).withColumn("model", F.lit("m"))
    return J.detect(J.with_errors(rows), R.failing(R.canned_backend(_LABEL_ANSWERS)), params=_ONCE)


_FAILED_REPORT = Q.label_report()
_FAILED_REPORT = "WITH " + ", ".join([Q.BASE, Q.PLAN, Q.DATASET, _FAILING_DETECTIONS]) + ", sets AS" + _FAILED_REPORT.split("sets AS", 1)[1]


@query("detect_with_failures", _FAILED_REPORT.replace("predicted_biases IS NULL OR", "FALSE OR").replace("(predicted_biases", "(coalesce(predicted_biases, 'no response')"))
def detect_with_failures(spark, sf):
    # Calls without an answer count as support of their classes and as no answer of any.
    return T.detection_report(_failing_detections(spark, sf))


def _failing_rewrite(labels: str) -> str:
    prompt = _template_sql(TASK_TEMPLATES.rewrite, {"predicted_biases": labels, "sentence": "biased_sentence"})
    return f"CASE WHEN {labels} IS NOT NULL AND NOT {_FAILS.format(_REWRITE_SYS, prompt)} THEN {_digest_answer('rewritten', _REWRITE_SYS, prompt)} END"


def _rewrite_failed(labels: str) -> str:
    prompt = _template_sql(TASK_TEMPLATES.rewrite, {"predicted_biases": labels, "sentence": "biased_sentence"})
    return f"coalesce({labels} IS NOT NULL AND {_FAILS.format(_REWRITE_SYS, prompt)}, FALSE)"


@query(
    "conditions_with_failures",
    Q.using(
        "dataset conditions",
        f"""SELECT model, condition, count(*) AS rows, count(*) FILTER (d OR r OR s) AS missing, count(*) FILTER (d) AS failed_detect,
            count(*) FILTER (r) AS failed_rewrite, count(*) FILTER (s) AS failed_sentiment,
            {Q.div("count(*) FILTER (NOT s AND label = parsed)", "count(*)")} AS accuracy
            FROM (SELECT *, CASE parser WHEN 'cot' THEN {Q.cot_sentiment('raw')} ELSE {Q.plain_sentiment('raw')} END AS parsed FROM answered)
            GROUP BY model, condition""",
        _FAILING_DETECTIONS,
        f"""rewritten AS (SELECT * EXCLUDE (raw_model_response), raw_model_response IS NULL AS d,
            {_failing_rewrite('biases')} AS true_bias_rewrite, {_failing_rewrite('predicted_biases')} AS detected_bias_rewrite,
            {_rewrite_failed('biases')} OR {_rewrite_failed('predicted_biases')} AS r FROM detections)""",
        f"asked AS (SELECT *, {_SYS} AS sys, {_PROMPT} AS prompt FROM rewritten, conditions WHERE clean = (biases = 'none'))",
        f"""answered AS (SELECT model, condition, parser, label, d, r, coalesce({_FAILS.format('sys', 'prompt')}, TRUE) AS s,
            {_canned_answer(R.CANNED_SENTIMENTS, 'sys', 'prompt')} AS raw FROM asked)""",
    ),
)
def conditions_with_failures(spark, sf):
    # A failed detection leaves no labels to name, so later prompts are missing too; every failure is told by its stage.
    d = materialise(_failing_detections(spark, sf), "detections")
    r = materialise(J.rewrite(d, R.failing(R.digest_backend("rewritten")), params=_ONCE), "rewrites")
    p = J.classify_under_conditions(r, R.failing(R.canned_backend(R.CANNED_SENTIMENTS)), params=_ONCE, keep=["model", "example_id", "label"])
    p = materialise(p, "answers")
    by = ["model", "condition"]
    failures = A.failures_by_stage(p, by, ["detect", "rewrite", "sentiment"])
    return failures.join(A.condition_accuracy(p, by).drop("rows"), by)


# --- the study of three wordings: injected, detected and scored each for itself -------------------


def _variant_sql() -> str:
    system = "CASE prompt_variant " + " ".join(f"WHEN {Q.s(v)} THEN {Q.s(t.system)}" for v, t in INJECTION_TEMPLATES.items()) + " END"
    first = _digest_answer("text", system, _prompt_sql("prompt_variant", "stage1", "label", "original_sentence"))
    second = _digest_answer("text", system, _prompt_sql("prompt_variant", "stage2", "label", "mid"))
    classes = Q.class_counts("t", "p", CUES)
    return Q.using(
        "dataset",
        "SELECT 'm' AS model, " + ", ".join(f"max(f) FILTER (WHERE v = {Q.s(v)}) AS {v}" for v in INJECTION_TEMPLATES) + " FROM f",
        f"variants AS (SELECT * FROM (VALUES {_VARIANTS}) v(prompt_variant))",
        f"begun AS (SELECT dataset.*, prompt_variant, {first} AS mid FROM dataset, variants WHERE stage1 IS NOT NULL)",
        f"""injected AS (SELECT * EXCLUDE (biased_sentence), CASE WHEN stage2 IS NULL THEN mid ELSE {second} END AS biased_sentence FROM begun)""",
        f"found AS (SELECT biases, prompt_variant, {_canned_answer(_LABEL_ANSWERS, _DETECT_SYS, _DETECT_PROMPT)} AS raw FROM injected)",
        f"sets AS (SELECT prompt_variant AS v, list_filter(string_split(biases, ','), x -> list_contains({Q.lst(CUES)}, x)) AS t, "
        f"list_filter({Q.predicted('raw')}, x -> list_contains({Q.lst(CUES)}, x)) AS p FROM found)".replace("x ->", "lambda x:"),
        f"c AS (SELECT v, {classes} FROM sets GROUP BY v)",
        f"f AS (SELECT v, {Q.mean([Q.f1_of(i) for i in range(6)])} AS f FROM c)",
    )


@query("sensitivity_run", _variant_sql())
def sensitivity_run(spark, sf):
    variants = list(INJECTION_TEMPLATES)
    injected = J.inject(R.base(spark, sf), R.digest_backend("text"), bias_plan(clean=False), variants=variants, original=False)
    found = J.detect(injected.withColumn("model", F.lit("m")), R.canned_backend(_LABEL_ANSWERS), keep=["model", "example_id", "biases", "prompt_variant"])
    return T.prompt_sensitivity(found, variants)


@query(
    "classify_batch",
    Q.using(
        "dataset",
        """SELECT example_id, CASE WHEN biases = 'none' THEN '1_clean_baseline' ELSE '2_no_defense' END AS condition,
           CASE length(biased_sentence) % 4 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' END
           AS predicted_sentiment FROM dataset""",
    ),
)
def classify_batch(spark, sf):
    label_map = {"Positive": "positive", "Negative": "negative", "Neutral": "neutral"}
    d = J.classify_baseline(R.dataset(spark, sf), R.length_classifier, label_map)
    return d.select("example_id", "condition", "predicted_sentiment")


_INJECT_SYS = Q.s(INJECTION_TEMPLATES["main"].system)


def _inject_sql(where: str) -> str:
    first = _digest_answer("text", _INJECT_SYS, _prompt_sql("'main'", "stage1", "label", "original_sentence"))
    second = _digest_answer("text", _INJECT_SYS, _prompt_sql("'main'", "stage2", "label", "mid"))
    return Q.using(
        "dataset",
        "SELECT example_id || ':main' AS example_id, label, biases, "
        f"CASE WHEN stage2 IS NULL THEN mid ELSE {second} END AS biased_sentence, "
        "md5(original_sentence) AS original_sentence FROM a",
        f"a AS (SELECT *, {first} AS mid FROM dataset WHERE {where})",
    )


def _injected(spark, sf, **parts):
    out = J.inject(R.base(spark, sf), R.digest_backend("text"), bias_plan(clean=False, **parts))
    return out.select("example_id", "label", "biases", "biased_sentence", *digest("original_sentence"))


@query("inject_single", _inject_sql("stage1 IS NOT NULL AND stage2 IS NULL"))
def inject_single(spark, sf):
    return _injected(spark, sf, pairs=False)


@query("inject_pairwise", _inject_sql("stage2 IS NOT NULL"))
def inject_pairwise(spark, sf):
    return _injected(spark, sf, singles=False)


@query("inject_all", _inject_sql("stage1 IS NOT NULL"))
def inject_all(spark, sf):
    return _injected(spark, sf)


@query("generate_stream")
def generate_stream_run(spark, sf):
    # Two runs with new files in between: the second one processes the new files only.
    source, sink, mark = (fresh_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    d = R.dataset(spark, sf).select(*schemas.DATASET.names)
    clean = col("biases") == "none"

    def stage(rows):
        out = J.detect(rows, R.canned_backend(_LABEL_ANSWERS))
        return out.select("example_id", "raw_model_response", L.join_labels(col("predicted_biases")).alias("predicted_biases"))

    for part in (d.filter(clean), d.filter(~clean)):
        part.write.mode("append").parquet(source)
        generate_stream(spark, source, schemas.DATASET, stage, sink, mark, files_per_batch=16)
    return spark.read.parquet(sink)


ORACLES["generate_stream"] = ORACLES["detect_labels"]


@query("resume_conditions", ORACLES["defense_conditions"])
def resume_conditions(spark, sf):
    # A first run of two conditions, one of which failed on some prompts; then the rest is asked.
    path = fresh_path(spark, "predictions")
    rows, keep = R.rewrites(spark, sf), ["model", "example_id"]
    picky = R.refusing(R.canned_backend(R.CANNED_SENTIMENTS), "the")
    once = replace(SENTIMENT, attempts=1, backoff_s=0.0)
    run_conditions(rows, picky, path, conditions=["2_no_defense", "4_cot_clean"], mode="replace", params=once, keep=keep)
    run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, one_by_one=False, keep=keep)
    return latest_predictions(spark, path).select(
        "model", "condition", "example_id", "predicted_sentiment", "parsed_sentiment"
    )


def _predictions(spark, path):
    columns = "model", "condition", "example_id", "predicted_sentiment", "parsed_sentiment"
    return latest_predictions(spark, path).select(*columns)


@query("resume_in_batches", ORACLES["defense_conditions"])
def resume_in_batches(spark, sf):
    # Both runs commit their answers batch by batch; the second one asks for what failed.
    path = fresh_path(spark, "predictions")
    rows, keep = R.rewrites(spark, sf), ["model", "example_id"]
    picky = R.refusing(R.canned_backend(R.CANNED_SENTIMENTS), "the")
    once = replace(SENTIMENT, attempts=1, backoff_s=0.0)
    how = {"one_by_one": False, "checkpoint_every": 20_000, "files_per_batch": 64, "keep": keep}
    run_conditions(rows, picky, path, params=once, **how)
    run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, **how)
    return _predictions(spark, path)


class _Killed(BatchTable):
    """Dies when the files of its second batch are written, before any of them is in the table."""

    def publish(self, key):
        if key.endswith("1"):
            raise RuntimeError("killed")
        super().publish(key)


@query("resume_after_kill", ORACLES["defense_conditions"])
def resume_after_kill(spark, sf):
    # The table itself is compared, not the latest row of each key: no answer is there twice.
    path = fresh_path(spark, "predictions")
    rows, keep = R.rewrites(spark, sf), ["model", "example_id"]
    how = {"one_by_one": False, "checkpoint_every": 20_000, "files_per_batch": 6, "keep": keep, "run": "nightly"}
    try:
        run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, batch_table=_Killed, **how)
    except Exception as e:
        if "killed" not in str(e):
            raise
    run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, **how)
    return spark.read.parquet(path).select("model", "condition", "example_id", "predicted_sentiment", "parsed_sentiment")


@query("override_run", ORACLES["defense_conditions"])
def override_run(spark, sf):
    # Nothing of the first run is left.
    path = fresh_path(spark, "predictions")
    rows, keep = R.rewrites(spark, sf), ["model", "example_id"]
    run_conditions(rows, R.canned_backend(["other"]), path, conditions=["2_no_defense", "3_generic_defense"], keep=keep)
    run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, mode="override", one_by_one=False, keep=keep)
    return _predictions(spark, path)


@query("override_failed", ORACLES["defense_conditions"])
def override_failed(spark, sf):
    # A run that fails half way leaves the table as it was.
    path = fresh_path(spark, "predictions")
    rows, keep = R.rewrites(spark, sf), ["model", "example_id"]
    run_conditions(rows, R.canned_backend(R.CANNED_SENTIMENTS), path, one_by_one=False, keep=keep)
    strict = replace(SENTIMENT, attempts=1, backoff_s=0.0, fail_fast=True)
    try:
        run_conditions(rows, R.refusing(R.canned_backend(["other"]), "the"), path, mode="override", params=strict, keep=keep)
    except PySparkException as e:
        if "refused" not in str(e):
            raise
    return spark.read.parquet(path).select("model", "condition", "example_id", "predicted_sentiment", "parsed_sentiment")


# --- joins --------------------------------------------------------------------------


def _ids(spark, sf):
    return expand_models(R.dataset(spark, sf), list(R.MODELS))


# Answers that a CSV file between the stages would lose are not there.
_FOUND_SQL = "raw_model_response NOT IN (" + ", ".join(Q.s(t) for t in MISSING_TOKENS) + ")"


def _found(df):
    return df.filter(X.missing_to_null(col("raw_model_response")).isNotNull())


# Blank answers are asked for again.
_DONE_SQL = "predicted_sentiment <> ''"


def _done(df):
    return df.filter(col("predicted_sentiment") != "")


@query(
    "attach_detections",
    Q.using(
        "detections",
        f"SELECT model, example_id, CASE WHEN {_FOUND_SQL} THEN predicted_biases END AS predicted_biases FROM detections",
    ),
)
def attach_detections(spark, sf):
    found = _found(R.detection_cells(spark, sf)).select("model", "example_id", "predicted_biases")
    return N.attach(_ids(spark, sf), found, ["predicted_biases"]).select("model", "example_id", "predicted_biases")


@query(
    "attach_detections_by_text",
    Q.using(
        "detections",
        "SELECT d.model, d.example_id, r.predicted_biases, count(*) AS n_copies FROM detections d "
        "LEFT JOIN done r ON d.model = r.model AND d.biased_sentence = r.biased_sentence GROUP BY ALL",
        f"done AS (SELECT model, biased_sentence, predicted_biases FROM detections WHERE {_FOUND_SQL})",
    ),
)
def attach_detections_by_text(spark, sf):
    found = _found(R.detection_cells(spark, sf)).select("model", "biased_key", "predicted_biases")
    examples = _ids(spark, sf).select("model", "example_id", "biased_key")
    out = N.attach_by_text(examples, found, ["predicted_biases"], "biased_key", every=True)
    return out.select("model", "example_id", "predicted_biases", "n_copies")


@query(
    "attach_rewrites",
    Q.using(
        "rewrites",
        "SELECT d.model, d.example_id, r.detected_bias_rewrite, r.true_bias_rewrite, coalesce(l.n, 1) AS n_copies "
        "FROM (SELECT * FROM keyed WHERE biases <> 'none') d LEFT JOIN done l USING (model, text) "
        "LEFT JOIN keyed r ON r.model = d.model AND r.example_id = l.last_id",
        # long texts are read once; from here on there are digests only
        "keyed AS MATERIALIZED (SELECT model, example_id, biases, raw_model_response, md5(biased_sentence) AS text, "
        "md5(detected_bias_rewrite || ' ' || example_id) AS detected_bias_rewrite, md5(true_bias_rewrite || ' ' || example_id) AS true_bias_rewrite FROM rewrites)",
        f"done AS (SELECT model, text, max(example_id) AS last_id, count(*) AS n FROM keyed WHERE {_FOUND_SQL} GROUP BY ALL)",
    ),
)
def attach_rewrites(spark, sf):
    texts = ["detected_bias_rewrite", "true_bias_rewrite"]
    # No two copies of a text have the same rewrite: each example gets the last one. As in the SQL, long texts are read
    # once; from here on there are digests only.
    own = {t: F.concat_ws(" ", t, "example_id") for t in texts}
    own = {t: F.when(col(t).isNotNull(), v) for t, v in own.items()}
    found = _found(R.rewrites(spark, sf)).withColumns(own).select("model", "biased_key", "example_id", *digest(*texts))
    biased, _ = split_biased_clean(_ids(spark, sf))
    out = N.attach_by_text(biased.select("model", "example_id", "biased_key"), found, texts, "biased_key", last_by=["example_id"])
    return out.select("model", "example_id", *texts, "n_copies")


@query(
    "resume_anti_join",
    Q.using(
        "predictions",
        f"SELECT model, condition, example_id FROM predictions WHERE NOT {_DONE_SQL}",
    ),
)
def resume_anti_join(spark, sf):
    p = R.predictions(spark, sf).select("model", "condition", "example_id", "predicted_sentiment")
    return N.remaining(p, _done(p)).select("model", "condition", "example_id")


@query(
    "resume_by_text",
    Q.using(
        "predictions",
        "SELECT model, condition, example_id FROM keyed ANTI JOIN finished USING (model, condition, text)",
        f"""keyed AS MATERIALIZED (SELECT model, condition, example_id, {_DONE_SQL} AS done, coalesce(md5(CASE
            WHEN biases = 'framing' THEN NULL WHEN condition IN ({', '.join(Q.s(c) for c in CLEAN_CONDITIONS)})
            THEN original_sentence ELSE biased_sentence END), '') AS text FROM predictions),
            finished AS (SELECT DISTINCT model, condition, text FROM keyed WHERE done)""",
    ),
)
def resume_by_text(spark, sf):
    # Some texts are missing: a missing text that is done covers the others.
    text = F.when(col("condition").isin(CLEAN_CONDITIONS), col("original_key")).otherwise(col("biased_key"))
    text = F.when(col("biases") != "framing", text)
    p = R.predictions(spark, sf).select("model", "condition", "example_id", "predicted_sentiment", text.alias("text"))
    left = N.remaining_by_text(p, _done(p), "text")
    return left.select("model", "condition", "example_id")


# The same joins between tables that a stage before has left in common buckets.

#: Where this session has written them.
_STAGES: dict[tuple, str] = {}


def _stage(spark, sf, name, write):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGES:
        path = fresh_path(spark, name)
        write(path)
        _STAGES[key] = path
    return _STAGES[key]


def _buckets(spark):
    return 2 * spark.sparkContext.defaultParallelism


def _examples_by_id(spark, sf):
    rows = _ids(spark, sf).select("model", "example_id")
    return _stage(spark, sf, "examples-by-id", lambda p: B.write_examples(rows, p, ["model", "example_id"], "example_id", _buckets(spark)))


def _examples_by_text(spark, sf):
    rows = _ids(spark, sf).select("model", "example_id", "biased_key")
    return _stage(spark, sf, "examples-by-text", lambda p: B.write_examples(rows, p, ["model", "biased_key"], "example_id", _buckets(spark)))


def _answers_by_id(spark, sf):
    rows = R.predictions(spark, sf).select("model", "condition", "example_id", "predicted_sentiment")
    by = ["model", "condition", "example_id"]
    return _stage(spark, sf, "answers-by-id", lambda p: B.write_examples(rows, p, by, "example_id", _buckets(spark)))


@query("colocated_detections", ORACLES["attach_detections"])
def colocated_detections(spark, sf):
    examples = _examples_by_id(spark, sf)
    found = _found(R.detection_cells(spark, sf)).select("model", "example_id", "predicted_biases")
    results = _stage(spark, sf, "detections-by-id", lambda p: B.write_results(found, p, examples))
    return B.join_buckets(spark, examples, results, ["model", "example_id"], ["predicted_biases"])


@query("colocated_by_text", ORACLES["attach_detections_by_text"])
def colocated_by_text(spark, sf):
    examples = _examples_by_text(spark, sf)
    found = _found(R.detection_cells(spark, sf)).select("model", "biased_key", "predicted_biases")
    labels = found.groupBy("model", "biased_key", "predicted_biases").agg(F.count("*").alias("n"))
    results = _stage(spark, sf, "detections-by-text", lambda p: B.write_results(labels, p, examples))
    out = B.join_buckets(spark, examples, results, ["model", "example_id"], ["predicted_biases", "n"])
    return out.select("model", "example_id", "predicted_biases", F.coalesce("n", F.lit(1)).cast("bigint").alias("n_copies"))


@query("colocated_resume", ORACLES["resume_anti_join"])
def colocated_resume(spark, sf):
    answers = _answers_by_id(spark, sf)
    done = _done(R.predictions(spark, sf)).select("model", "condition", "example_id")
    finished = _stage(spark, sf, "finished-by-id", lambda p: B.write_results(done, p, answers))
    return B.join_buckets(spark, answers, finished, ["model", "condition", "example_id"], how="left_anti")


# --- sources and sinks ----------------------------------------------------------------

_CSV_TEXT = "example_id", "original_sentence", "biased_sentence", "label", "biases", "raw_model_response"


def _missing_sql(x: str) -> str:
    return f"CASE WHEN {x} IN ({', '.join(Q.s(t) for t in MISSING_TOKENS)}) THEN NULL ELSE {x} END"


@query(
    "csv_scan_na",
    Q.using(
        "dataset",
        "SELECT example_id, label, biases, md5(original_sentence) AS original_sentence, md5(biased_sentence) AS biased_sentence, "
        f"{_missing_sql('raw_model_response')} AS raw_model_response FROM "
        f"(SELECT *, {Q.pick(R.CANNED_LABELS + MISSING_TOKENS, 'sentence_id + plan_ord')} AS raw_model_response FROM dataset)",
    ),
)
def csv_scan_na(spark, sf):
    path = fresh_path(spark, "csv")
    answer = R.pick(R.CANNED_LABELS + MISSING_TOKENS, col("sentence_id") + col("plan_ord"))
    d = R.dataset(spark, sf).withColumn("raw_model_response", answer).select(*_CSV_TEXT)
    files.write_csv(d, path, compression="gzip")
    back = files.scan_csv(spark, path, d.schema)
    return back.select("example_id", "label", "biases", "raw_model_response", *digest("original_sentence", "biased_sentence"))


_LINES_SQL = """lines AS (SELECT regexp_replace(line, '[^\\x{0}-\\x{FF}]', '?', 'g') AS line
  FROM (SELECT unnest(string_split(text || '@' || source, chr(10))) AS line FROM documents))"""
_LAST_AT = "length(line) - length(string_split(line, '@')[-1])"


@query(
    "parse_last_at",
    f"""WITH {_LINES_SQL} SELECT {Q.strip(f"substr(line, 1, {_LAST_AT} - 1)")} AS sentence,
        {Q.strip("string_split(line, '@')[-1]")} AS label FROM lines WHERE contains(line, '@')""",
)
def parse_last_at(spark, sf):
    path = fresh_path(spark, "phrases")
    lines = R.table(spark, sf, "documents").select(
        F.explode(F.split(F.concat_ws("@", "text", "source"), "\n")).alias("line")
    )
    (
        lines.write.option("encoding", "ISO-8859-1")
        .options(sep="\u0001", quote="\u0002", emptyValue="")
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )
    return files.scan_phrase_file(spark, path)


@query(
    "scan_models",
    Q.using(
        "detections",
        "SELECT model, example_id, predicted_biases FROM detections WHERE model IN ('model_a', 'model_c')",
    ),
)
def scan_models(spark, sf):
    path = fresh_path(spark, "models")
    d = R.detection_cells(spark, sf).select("model", "example_id", "predicted_biases")
    files.write_table(d, path, rebalance=True)
    found = files.scan_models(spark, path, models=["model_a", "model_c", "model_x"])
    return found.select("model", "example_id", "predicted_biases")


@query(
    "scan_skip",
    Q.using("detections", "SELECT model, example_id, predicted_biases FROM detections WHERE model <> 'model_b'"),
)
def scan_skip(spark, sf):
    root = fresh_path(spark, "results")
    d = R.detection_cells(spark, sf).select("model", "example_id", "predicted_biases")
    d.write.option("header", True).partitionBy("model").csv(root)
    schema = d.drop("model").schema
    found = files.discover_models(spark, root, schema, "part-*.csv", skip=["model=model_b"])
    return found.withColumn("model", F.substring_index("model", "=", -1))


def _put_csv(spark, df, path):
    """One CSV file of that name."""
    folder = fresh_path(spark, "csv")
    files.write_csv(df.coalesce(1), folder)
    (name,) = [f for f in places.files_below(spark, folder) if f.endswith(".csv")]
    places.move(spark, f"{folder}/{name}", path)


@query(
    "discover_folders",
    Q.using(
        "detections",
        "SELECT 'first' AS rule, model, example_id, predicted_biases FROM detections WHERE model = 'model_a' AND biases = 'none' "
        "UNION ALL SELECT 'complete', model, example_id, predicted_biases FROM detections WHERE model = 'model_c' "
        "UNION ALL SELECT 'missing', * FROM (VALUES ('model_a', NULL, 'report'), ('model_b', NULL, 'predictions'))",
    ),
)
def discover_folders(spark, sf):
    # model_a: two files of detections, no report. model_b: skipped for one rule, no predictions. model_c: no detections, else all files.
    root = fresh_path(spark, "results")
    d = R.detection_cells(spark, sf).select("model", "biases", "example_id", "predicted_biases")
    of = {m: d.filter(col("model") == m).select("example_id", "predicted_biases") for m in R.MODELS}
    clean = d.filter((col("model") == "model_a") & (col("biases") == "none")).select("example_id", "predicted_biases")
    report = spark.createDataFrame([("none", 1)], "class string, support int")
    _put_csv(spark, clean, f"{root}/model_a/debiased_sentences_1.csv")
    _put_csv(spark, of["model_a"], f"{root}/model_a/debiased_sentences_2.csv")
    _put_csv(spark, of["model_a"], f"{root}/model_a/predictions_model_a.csv")
    _put_csv(spark, of["model_b"], f"{root}/model_b/debiased_sentences_1.csv")
    _put_csv(spark, report, f"{root}/model_b/classification_report_model_b.csv")
    _put_csv(spark, of["model_c"], f"{root}/model_c/predictions_model_c.csv")
    _put_csv(spark, report, f"{root}/model_c/classification_report_model_c.csv")
    # Ids and labels have no line breaks, so large files can be split.
    first = discovery.discover_first(spark, root, clean.schema, "debiased_sentences_*.csv", skip=["model_b"], multiLine=False)
    needed = {"predictions": ("predictions_{model}.csv", clean.schema), "report": ("classification_report_{model}.csv", report.schema)}
    whole, folders = discovery.discover_complete(spark, root, needed, multiLine=False)
    missing = folders.select("model", F.lit(None).cast("string").alias("example_id"), F.explode("missing").alias("predicted_biases"))
    parts = {"first": first, "complete": whole["predictions"], "missing": missing}
    return D.union_all([p.select(F.lit(rule).alias("rule"), "model", "example_id", "predicted_biases") for rule, p in parts.items()])


@query(
    "replace_condition",
    Q.using(
        "predictions",
        "SELECT model, condition, example_id, CASE WHEN condition = '4_cot' THEN 'asked again' ELSE parsed_sentiment END "
        "AS parsed_sentiment FROM predictions WHERE condition <> '3_generic_defense'",
    ),
)
def replace_condition(spark, sf):
    path = fresh_path(spark, "predictions")
    p = R.predictions(spark, sf).select("model", "condition", "example_id", "parsed_sentiment")
    files.replace_partitions(p, path)
    again = p.filter(col("condition") == "4_cot").withColumn("parsed_sentiment", F.lit("asked again"))
    # The other condition has no rows any more.
    chosen = F.explode(F.array(F.lit("4_cot"), F.lit("3_generic_defense"))).alias("condition")
    cleared = spark.createDataFrame([(m,) for m in R.MODELS], "model string").select("model", chosen)
    files.replace_partitions(again, path, cleared=cleared)
    return spark.read.parquet(path).select("model", "condition", "example_id", "parsed_sentiment")



@query("csv_sink", ORACLES["detection_report"])
def csv_sink(spark, sf):
    path = fresh_path(spark, "report")
    report = detection_report(spark, sf)
    files.write_csv(report, path)
    return files.scan_csv(spark, path, report.schema)
