"""Which result files there are, folder by folder, before any of them is read.

Results lie in one folder per model, ``<root>/<model>/<file>``. The manifest is a table of the files: names, sizes, times; no content is read
for it. Rules on it choose what is read: the first matching file of each folder, or the folders that hold all
the files an analysis needs. What reaches the driver is the list of paths to read, as for any scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelab.sources.files import scan_csv

#: Stands for the name of the folder in the name of a file.
FOLDER = "{model}"


def file_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``model`` (the folder), ``name``, ``path``, ``size``, ``modified`` of the files one level below ``root``.

    Hidden files and folders (``_`` or ``.`` first) are left out, and so are deeper levels. A root without such files gives an empty table.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(f"{root.rstrip('/')}/*/")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, modificationTime timestamp, length bigint")
    above = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    place = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" + re.escape(above) + r"/([^/_.][^/]*)/([^/_.][^/]*)$"
    named = files.select(
        F.regexp_extract("path", place, 1).alias("model"), F.regexp_extract("path", place, 2).alias("name"), "path",
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    )
    return named.where("model <> ''")


def _like(pattern: str, folder: Column) -> Column:
    """A name with one ``*`` for any letters and ``{model}`` for the folder, as a condition on ``name``."""
    head, star, tail = pattern.partition("*")
    if "*" in tail:
        raise ValueError("one * at most")
    first, last = (F.replace(F.lit(x), F.lit(FOLDER), folder) for x in (head, tail))
    name = F.col("name")
    if not star:
        return name == first
    return F.startswith(name, first) & F.endswith(name, last) & (F.length(name) >= F.length(first) + F.length(last))


def first_files(manifest: DataFrame, pattern: str, skip: Sequence[str] = ()) -> DataFrame:
    """``model``, ``name`` and ``path`` of the first matching file by name in each folder; folders in ``skip`` and those without one give no row."""
    rows = manifest.where(_like(pattern, F.col("model")) & ~F.col("model").isin(list(skip)))
    first = rows.groupBy("model").agg(F.min(F.struct("name", "path")).alias("f"))
    return first.select("model", "f.*")


def folder_report(manifest: DataFrame, needed: Mapping[str, str], skip: Sequence[str] = ()) -> DataFrame:
    """Per folder the path of each needed file (the first by name), null where there is none, and ``missing``: the kinds without a file."""
    rows = manifest.where(~F.col("model").isin(list(skip)))
    found = [F.min(F.when(_like(pattern, F.col("model")), F.struct("name", "path"))).alias(kind) for kind, pattern in needed.items()]
    per = rows.groupBy("model").agg(*found)
    lacks = F.array_compact(F.array(*[F.when(F.col(kind).isNull(), F.lit(kind)) for kind in needed]))
    return per.select("model", *[F.col(kind)["path"].alias(kind) for kind in needed], lacks.alias("missing"))


def _read(spark: SparkSession, paths: list[str], schema: T.StructType, **options) -> DataFrame:
    """The rows of these files with the folder as ``model``."""
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("model", T.StringType())]))
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)  # written as in a URI
    # letters that would stand for others in the path of a scan
    quoted = ["".join(f"\\{c}" if c in "*?[]{}\\" else c for c in p) for p in paths]
    return scan_csv(spark, quoted, schema, **options).select("*", F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))).alias("model"))


def discover_first(
    spark: SparkSession, root: str, schema: T.StructType, pattern: str, skip: Sequence[str] = (), **options
) -> DataFrame:
    """The rows of the first matching CSV file of each folder, with ``model``. ``options`` go to ``scan_csv``: with ``multiLine=False``,
    for files without line breaks inside of cells, a large file is many tasks."""
    chosen = first_files(file_manifest(spark, root), pattern, skip)
    return _read(spark, [r["path"] for r in chosen.orderBy("model").collect()], schema, **options)


def discover_complete(
    spark: SparkSession, root: str, needed: Mapping[str, tuple[str, T.StructType]], skip: Sequence[str] = (), **options
) -> tuple[dict[str, DataFrame], DataFrame]:
    """A table per kind of file, from the folders that hold all kinds; and the report on all folders.

    ``needed`` names the pattern and the columns of each kind; ``options`` are those of ``discover_first``.
    """
    report = folder_report(file_manifest(spark, root), {kind: pattern for kind, (pattern, _) in needed.items()}, skip)
    whole = report.where(F.size("missing") == 0).orderBy("model").collect()
    return {kind: _read(spark, [r[kind] for r in whole], schema, **options) for kind, (_, schema) in needed.items()}, report
