"""Quality rules by robust multivariate outliers.

Base rules judge a text by its own counts. Beyond them, each language and source has a minimum-covariance-
determinant estimate of where its texts lie in four transformed statistics; a text whose Mahalanobis
distance from it is too large goes. The estimate starts at the medians and is refined by concentration
steps: the share ``CORE`` of rows with the smallest distances gives the next mean and covariance. Groups
with few rows are estimated together, by language, then all together. DataFrame functions only.

Statistics are rounded to thousandths and summed as whole numbers, so results do not depend on the
partitioning. Ranks come from histograms of small bins, so no group is sorted or gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .shared import WHITE, WHITE_RUN, col, free_name, side, text_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MOST_REPEATED = 50, 50
#: Smallest group with an estimate of its own, and the smallest with any; rows of less than that stay.
GROUP_ROWS, LEAST_ROWS = 40, 8
#: Share of rows in the core, and the number of concentration steps.
CORE, STEPS = 0.75, 3
#: Deviations below these are never unusual, however alike the core is (same order as ``features``).
FLOORS = (0.1, 0.35, 0.4, 0.12)
#: Squared distance beyond which a row goes: of 10,000 rows of a normal distribution in four dimensions, one.
CUT = 23.51
UNIT = 1000


def _chi_squared_4(q: float) -> float:
    return 1 - math.exp(-q / 2) * (1 + q / 2)


def _chi_squared_6(q: float) -> float:
    return 1 - math.exp(-q / 2) * (1 + q / 2 + q * q / 8)


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows in four dimensions is multiplied by."""
    low, high = 0.0, 100.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_squared_4(middle) < share else (low, middle)
    return share / _chi_squared_6(low)


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the counts of the whole text, and their column names (changed where ``docs`` has such a column)."""
    own = docs.columns
    name = {k: free_name(docs, k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")}
    t = {k: free_name(docs, f"tmp_{k}") for k in ("body", "words", "grams", "lines", "places")}
    body, words, grams, lines, places = (col(t[k]) for k in ("body", "words", "grams", "lines", "places"))
    keep = [col(c) for c in own]
    staged = docs.withColumn(t["body"], text_of(text))
    trimmed = F.btrim(body, F.lit(WHITE))
    staged = staged.withColumn(t["words"], F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITE_RUN)))
    staged = staged.withColumn(t["lines"], F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    hashed = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    staged = staged.withColumn(t["grams"], F.when(F.size(words) >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    staged = staged.select(
        *keep,
        F.size(words).cast("bigint").alias(name["n_words"]),
        F.length(F.translate(body, WHITE, "")).cast("bigint").alias(name["word_chars"]),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("bigint").alias(name["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias(name["n_dup_lines"]),
        F.when(F.size(grams) > F.size(F.array_distinct(grams)), grams).alias(t["grams"]),
    )
    # places of windows that occur twice: equal neighbours after sorting (only for texts that have any)
    ordered = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    staged = staged.withColumn(t["places"], ordered)
    same = lambda x, k: F.coalesce(F.get(places, k)["h"] == x["h"], F.lit(False))
    twice = F.sort_array(F.transform(F.filter(places, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    staged = staged.withColumn(t["places"], twice)
    # a window covers three words, or as many as there are up to the next one
    reach = F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3))))
    covered = F.coalesce(F.aggregate(reach, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    n_words = col(name["n_words"])
    staged = staged.withColumn(name["n_repeat_words"], covered).drop(t["places"], t["grams"])
    failed = (n_words < MIN_WORDS) | (100 * col(name["n_repeat_words"]) > MOST_REPEATED * n_words)
    return staged.withColumn(name["base_failed"], failed), name


def features(name: dict[str, str]) -> list[Column]:
    """Letters a word, symbols a word, repeated lines, share of repeated words: transformed, in thousandths."""
    words = F.greatest(col(name["n_words"]), F.lit(1)).cast("double")
    raw = (
        F.log(F.greatest(col(name["word_chars"]), F.lit(1)) / words),
        F.log1p(20 * col(name["n_symbols"]) / words),
        F.log1p(col(name["n_dup_lines"]).cast("double")),
        col(name["n_repeat_words"]) / words,
    )
    return [F.round(UNIT * x).cast("bigint") for x in raw]


X = [f"x{i}" for i in range(4)]


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance: forward substitution with the Cholesky factor ``l00`` to ``l33``."""
    y: list[Column] = []
    for i in range(4):
        rest = x[i] - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * y[j]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _bin(distance: Column) -> Column:
    """Sixteen bins for each doubling."""
    return F.floor(16 * F.log2(1 + distance)).cast("int")


def _factor(rows: DataFrame) -> DataFrame:
    """Means ``m`` and the Cholesky factor of the covariance from the sums of each group."""
    n = F.col("n").cast("double")
    out = rows.select("g", *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(4)], *[
        (consistency(CORE) * (F.col(f"s{i}{j}") / n - (F.col(f"s{i}") / n) * (F.col(f"s{j}") / n))
         + F.lit((FLOORS[i] * UNIT) ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
        for i in range(4) for j in range(i + 1)
    ])
    for i in range(4):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.drop(*[f"c{i}{j}" for i in range(4) for j in range(i + 1)])


def _reached(counts: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """The least ``value`` up to which at least ``share`` of each group's rows lie. ``counts``: a row per group and value."""
    upto = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    cumulated = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return cumulated.where(F.col("upto") >= share * F.col("all")).groupBy(*by).agg(F.min(value).alias("reached"))


def estimates(rows: DataFrame) -> DataFrame:
    """Per group ``g`` of a written table (``g``, ``x0`` to ``x3``): mean ``m`` and Cholesky factor ``l``; a row per group."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(x) / 16).alias("at")) for i, x in enumerate(X)])).alias("b")
    counts = rows.select("g", bins).groupBy("g", "b.dim", "b.at").agg(F.count("*").alias("n"))
    medians = _reached(counts, ["g", "dim"], "at", 0.5)
    start = medians.groupBy("g").agg(*[(F.max(F.when(F.col("dim") == i, F.col("reached"))) * 16 + 8).cast("double").alias(f"m{i}") for i in range(4)])
    for i in range(4):
        for j in range(i + 1):
            start = start.withColumn(f"l{i}{j}", F.lit(FLOORS[i] * UNIT if i == j else 0.0))
    now = materialise(start, "centres")
    x = [F.col(c) for c in X]
    for _ in range(STEPS):
        near = rows.join(side(now, 200), "g").select("g", *X, _bin(_distance(x)).alias("at"))
        counts = near.groupBy("g", "at").agg(F.count("*").alias("n"))
        reach = materialise(_reached(counts, ["g"], "at", CORE), "cores")
        core = near.join(side(reach, 100), "g").where("at <= reached")
        products = [F.sum(x[i] * x[j]).alias(f"s{i}{j}") for i in range(4) for j in range(i + 1)]
        sums = core.groupBy("g").agg(F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(4)], *products)
        now = materialise(_factor(sums), "centres")
    return now


def judge_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", drop_text: bool = False) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` (without ``text`` if asked) with the counts, ``base_failed`` and ``kept``; and the names of these columns.

    ``kept`` is false if ``base_failed``, else the verdict of the group's estimate; rows of groups with
    fewer than ``LEAST_ROWS`` rows that pass the base rules stay. Null text has no words and fails the base.
    Null languages and sources are values of their own. Repeated rows count each. An empty table gives one.
    """
    counted, name = with_statistics(docs, text)
    counted = counted.drop(text) if drop_text else counted
    name["kept"] = free_name(docs, "kept")
    counted = materialise(counted, "statistics")  # read several times from here on
    failed = col(name["base_failed"])
    pair, alone = F.to_json(F.struct(col(lang).alias("lang"), col(source).alias("source"))), F.to_json(F.struct(col(lang).alias("lang")))
    passed = counted.where(~failed)
    sizes = passed.groupBy(pair.alias("pair"), alone.alias("alone")).agg(F.count("*").alias("n"))
    big = F.col("n") >= GROUP_ROWS
    of_lang = F.sum(F.when(~big, F.col("n")).otherwise(0)).over(Window.partitionBy("alone"))
    group = F.when(big, F.col("pair")).when(of_lang >= GROUP_ROWS, F.col("alone")).otherwise("{}")
    groups = materialise(sizes.select("pair", group.alias("g")), "groups")
    rows = passed.select(pair.alias("pair"), *[f.alias(x) for f, x in zip(features(name), X)])
    rows = materialise(rows.join(side(groups, 200), "pair").select("g", *X), "features")
    many = rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_ROWS)
    found = estimates(rows).join(many.select("g"), "g", "left_semi")
    found = materialise(groups.join(found, "g").drop("g"), "estimates")
    t_pair = free_name(counted, "pair_of_row")
    numbers = [c for c in found.columns if c != "pair"]
    inner = [c for c in counted.columns]
    whole = free_name(counted, "whole_row")
    nested = counted.select(F.struct(*[col(c) for c in inner]).alias(whole), pair.alias(t_pair), failed.alias("fail"), *[f.alias(x) for f, x in zip(features(name), X)])
    params = found.withColumnRenamed("pair", t_pair).select(t_pair, *numbers)
    judged = nested.join(side(params, 300), t_pair, "left")
    far = F.coalesce(_distance([F.col(c) for c in X]) > CUT, F.lit(False))
    return judged.select(f"{whole}.*", (~F.col("fail") & ~far).alias(name["kept"])), name


def drop_poor(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with its own columns."""
    judged, name = judge_quality(docs, text, lang, source)
    return judged.where(col(name["kept"])).select(*[col(c) for c in docs.columns])
