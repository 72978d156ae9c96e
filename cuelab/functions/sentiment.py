"""Sentiment words in model answers, plain and after a chain of thought."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelab.fixed_values import FINAL_ANSWER, SENTIMENTS


def _first_named(low: Column) -> Column:
    # By precedence, not by position: positive, then negative, then neutral.
    return (
        F.when(F.contains(low, F.lit("positive")), F.lit("positive"))
        .when(F.contains(low, F.lit("negative")), F.lit("negative"))
        .when(F.contains(low, F.lit("neutral")), F.lit("neutral"))
    )


def parse_sentiment(text: Column) -> Column:
    """The sentiment an answer names; neutral when it names none."""
    return F.coalesce(_first_named(F.lower(text)), F.lit("neutral"))


def parse_sentiment_cot(text: Column) -> Column:
    """The sentiment after the last final-answer mark, else the one named anywhere."""
    low = F.lower(text)
    # Without a mark substring_index gives the whole text back, which is the fallback anyway.
    answer = F.substring_index(low, FINAL_ANSWER, -1)
    return F.coalesce(_first_named(answer), _first_named(low), F.lit("neutral"))


def format_failure(text: Column) -> Column:
    """True when an answer names no sentiment at all, or is missing."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = F.lit(False)
    for word in SENTIMENTS:
        named = named | F.contains(low, F.lit(word))
    return ~named


def parse_with(parser: Column, text: Column) -> Column:
    """Choose the parser by a column: ``cot`` or anything else for the plain one."""
    return F.when(parser == "cot", parse_sentiment_cot(text)).otherwise(parse_sentiment(text))
