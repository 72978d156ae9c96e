"""Helpers that several operators use."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelab.workspace import materialise

#: The white space of the contracts: space and 9 to 13.
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast up to this size, counted before; beyond it the join is shuffled.
BROADCAST_BYTES = 16 << 20


#: Objects that a Python worker keeps: tokenizers, models, tables. One, so that a stage does not hold those of the stage before.
MOST_OBJECTS = 1


def col(name: str) -> Column:
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_of(name: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_row_tag(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once with a number for each row, which tells apart rows that repeat everything."""
    tag = free_name(df, "row_tag")
    return materialise(df.withColumn(tag, F.monotonically_increasing_id()), label), tag


def side(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table as the small side of a join: broadcast if a count shows it small, else merged."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df.hint("merge")


def vocabulary(spark: SparkSession, path: str):
    """The bytes of a vocabulary file, a few MB, sent to the executors once."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def per_worker(kind: str, data: bytes, build: Callable):
    """``build(data)``, once in each Python worker and kept between its tasks; the last ``MOST_OBJECTS`` are kept."""
    name = "_cuelab_llm_objects"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (kind, hashlib.md5(data).digest())
    if key not in store:
        kept = [k for k in store if isinstance(k, tuple)]
        for old in kept[: max(0, len(kept) - MOST_OBJECTS + 1)]:
            del store[old]
        store[key] = build(data)
    return store[key]


def blocks(texts: Sequence[str], most_chars: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch, each with at most so many characters or one text; with the place of the first."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text) > most_chars:
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held
