"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Rows whose length is unique are settled by it, then rows whose length and prefix hash are; the full hash
is made only for the rest. Which rows those are is told to the tasks by residues of the keys: a table
with at most ``RESIDUES`` numbers, whatever the data; a row let through by chance is hashed without need.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .shared import WHITE_RUN, col, free_name, side, text_of, with_row_tag

#: The prefix that is hashed, in letters.
PREFIX = 256
#: The residues of surviving keys that are broadcast are below this.
RESIDUES = 1 << 20


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(text_of(text), WHITE_RUN, " ")


def _residue(*key: str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(RESIDUES))


def _survivors(rows: DataFrame, *key: str) -> DataFrame:
    """Residues of the keys that several rows share: at most ``RESIDUES`` of them, so they are broadcast."""
    shared = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return F.broadcast(shared.select(_residue(*key).alias("residue")).distinct())


def _digests(docs: DataFrame, text: str, carried: list[Column]) -> DataFrame:
    """``carried`` with ``len``, ``head`` and ``digest``, the full hash (null for rows that the length or the prefix settles)."""
    body = docs.select(*carried, normalised(text).alias("norm"))
    keyed = body.withColumn("len", F.length("norm")).withColumn("head", F.xxhash64(F.substring("norm", 1, PREFIX)))
    slim = materialise(keyed.select("len", "head"), "text-keys")
    lengths = _survivors(slim, "len")
    of_length = slim.withColumn("residue", _residue("len")).join(lengths, "residue", "left_semi").drop("residue")
    prefixes = _survivors(of_length, "len", "head").withColumn("hit", F.lit(True))
    marked = keyed.withColumn("residue", _residue("len", "head")).join(prefixes, "residue", "left")
    return marked.withColumn("digest", F.when(F.col("hit"), F.unhex(F.sha2("norm", 256)))).drop("norm", "residue", "hit")


def _groups(rows: DataFrame) -> DataFrame:
    """Per text that several rows share: the first of them by id (null last), then by tag; and how many there are."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tag").alias("tag"))
    found = rows.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    return found.select("digest", F.col("o.id").alias("keep_id"), F.col("o.tag").alias("keep_tag"), F.col("n").alias("group_size"))


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept``, and the columns of ``carry``.

    Texts are equal if they are after ``normalised``. Of equal ones the row with the least id stays (null
    ids come last, and of rows that repeat their id one stays). Null text counts as empty. Other columns are
    left out.
    """
    carry = carry or {}
    carried = [col(id).alias("id"), *[c.alias(f"carried_{k}") for k, c in carry.items()]]
    rows, tag = with_row_tag(_digests(docs, text, carried), "text-digests")
    rows = rows.withColumnRenamed(tag, "tag")
    # rows without a full hash meet nothing; a key of their own spreads them over all tasks
    rows = rows.withColumn("digest", F.coalesce("digest", F.col("tag").cast("string").cast("binary")))
    joined = rows.join(_groups(rows).hint("merge"), "digest", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        F.col("id").alias(id),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        *[F.col(f"carried_{k}").alias(k) for k in carry],
    )


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text: that with the least id. Columns and other rows stay as they are."""
    whole, key = free_name(docs, "whole_row"), F.struct(*[col(c) for c in docs.columns])
    carried = [key.alias(whole), col(id).alias("id")]
    rows, tag = with_row_tag(_digests(docs, text, carried), "documents-with-digests")
    rows = rows.withColumnRenamed(tag, "tag")
    found = _groups(rows.select("id", "tag", "digest").where("digest is not null"))
    # only rows with a full hash can be copies; dropped ones are told by their tag
    dropped = rows.select("digest", "tag").where("digest is not null").join(found.hint("merge"), "digest").where("tag <> keep_tag").select("tag")
    return rows.join(side(materialise(dropped, "exact-copies"), 16), "tag", "left_anti").select(f"{whole}.*")
