"""URL filters: host-suffix and path-prefix expressions met with rules by short hash, then by full digest.

A URL is expanded into the expressions that rules of the given lengths could equal, each is hashed, and
short hash prefixes are equi-joined with those of the rules; the full digest confirms and the longest
rule wins. DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .shared import col, side

#: Bytes of the digest that the join key has.
KEY_BYTES = 4


def _lower(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without."""
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (host and path, null if none fits) and ``verdict`` of each row.

    ``rules``: ``host``, ``path``, ``verdict``. A rule fits its host and all subdomains if the path starts with
    its path. Of those that fit the longest wins (host and path together, then the longer host, then
    ``block`` before ``allow``, so repeated rules are fine); without one the verdict is ``default``. Rules with a null field or an
    empty host are left out. Null urls and urls without ``://`` have empty host and path. Repeated pages
    give repeated rows; other columns are left out. A URL becomes one expression for each pair of
    lengths (host, path) that rules have, if it has such a suffix and prefix.
    """
    rules = rules.select(_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    rules = rules.where("rule_host <> '' and rule_path is not null and rule_verdict is not null").distinct()
    rules = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))).withColumn("key", F.substring("digest", 1, 2 * KEY_BYTES))
    rules = materialise(rules, "url-rules")
    by_host: dict[int, list[int]] = {}
    for h, p in rules.select(F.length("rule_host"), F.length("rule_path")).distinct().collect():  # lengths only: a few hundred
        by_host.setdefault(h, []).append(p)
    lengths = F.from_json(F.lit(json.dumps([{"h": h, "p": p} for h, p in by_host.items()])), "array<struct<h:int,p:array<int>>>")

    rows = pages.select(col(id).alias(id), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    n = F.length("host")

    def ends_a_label(h: Column) -> Column:
        return (h == n) | ((h < n) & (F.substring(F.col("host"), n - h, F.lit(1)) == "."))

    asked = rows.select("host", "path").distinct()
    asked = asked.select("host", "path", F.explode(F.filter(lengths, lambda x: ends_a_label(x["h"]))).alias("x"))
    asked = asked.select("host", "path", F.col("x.h").alias("h"), F.explode(F.filter("x.p", lambda p: p <= F.length("path"))).alias("p"))
    suffix = F.substring(F.col("host"), n - F.col("h") + 1, F.col("h"))
    asked = asked.select("host", "path", _digest(suffix, F.substring(F.col("path"), F.lit(1), F.col("p"))).alias("asked"))
    asked = asked.withColumn("key", F.substring("asked", 1, 2 * KEY_BYTES))
    met = asked.join(side(rules, 300), "key").where("asked = digest")
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "rule_verdict"), rank).alias("best"))
    joined = rows.join(best.hint("merge"), ["host", "path"], "left")
    rule = F.concat("best.rule_host", "best.rule_path")
    return joined.select(col(id), "host", "path", rule.alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
