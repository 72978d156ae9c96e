"""Stage tables that meet in the same buckets, so that joins between them shuffle nothing.

A table of examples is written once in buckets of a key; tables of results are written in the same buckets. Each later join reads
bucket by bucket. A key with very many rows would make one bucket, and so one task, too large: when the examples are written such keys are
looked for (``heavy_keys``) and spread over several buckets by the row id; results of such a key are copied to
all of them. A key that holds the row id is dealt by that alone: rows that differ in the rest of the key, as the conditions of an example, then
lie side by side, so the digest counts once for them in files and shuffles, and they are told apart where they meet. What the buckets are is kept in a small file beside the table, so another session can read it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelab.operators.skew import MOST_SALTS, ROWS_PER_TASK, key_digest, key_text, rows_and_heavy_keys
from cuelab.sources import places

KEY, SALT = "bucket_key", "bucket_salt"
#: Rows of a bucket, about: a task sorts them in memory.
ROWS_PER_BUCKET = 2_000_000
#: Files that start like this are not read as rows.
_ABOUT = "_buckets.json"


def _name(path: str) -> str:
    return "colocated_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()


def _about(spark: SparkSession, path: str) -> dict:
    return json.loads(places.read_text(spark, f"{path.rstrip('/')}/{_ABOUT}"))


def _salts(spark: SparkSession, heavy: Sequence[Sequence[int]]) -> DataFrame:
    """The listed keys and over how many buckets each is spread: ``SPREAD_KEYS`` pairs of numbers at most."""
    return F.broadcast(spark.createDataFrame([tuple(x) for x in heavy], "__h bigint, __salts int"))


def _write(df: DataFrame, path: str, by: Sequence[str], dealt: Sequence[str], buckets: int, heavy: list) -> DataFrame:
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {_name(path)}")
    # one task a bucket, so one file a bucket
    df.repartition(buckets, KEY, SALT).write.bucketBy(buckets, KEY, SALT).sortBy(KEY, SALT).option("path", path).mode("overwrite").format("parquet").saveAsTable(_name(path))
    about = {"by": list(by), "dealt": list(dealt), "buckets": buckets, "heavy": heavy, "schema": json.loads(df.schema.json())}
    places.write_text(spark, f"{path.rstrip('/')}/{_ABOUT}", json.dumps(about))
    return read_buckets(spark, path)


def write_examples(df: DataFrame, path: str, by: Sequence[str], row_id: str, buckets: int, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Write rows in buckets of the columns ``by``, in ``buckets`` of them or as many as ``ROWS_PER_BUCKET`` asks for. Missing
    cells are values. Keys with more than ``rows_per_task``
    rows are spread by ``row_id``; ``df`` is read once to find them and once to write it, so it should come from files."""
    spark = df.sparkSession
    dealt = [row_id] if row_id in by else list(by)
    keyed = df.withColumns({KEY: key_digest(dealt), "__h": F.xxhash64(*dealt)})
    rows, found = rows_and_heavy_keys(keyed.select("__h"), "__h", rows_per_task)
    buckets = max(buckets, -(-rows // ROWS_PER_BUCKET))
    heavy = [[h, min(-(-n // rows_per_task), MOST_SALTS)] for h, n in found]
    if heavy:
        spread = F.pmod(F.xxhash64(*(by if row_id in by else [row_id])), F.col("__salts")).cast("int")
        keyed = keyed.join(_salts(spark, heavy), "__h", "left").withColumn(SALT, F.coalesce(spread, F.lit(0))).drop("__salts")
    else:
        keyed = keyed.withColumn(SALT, F.lit(0))
    return _write(keyed.select(*df.columns, KEY, SALT), path, by, dealt, buckets, heavy)


def write_results(df: DataFrame, path: str, examples: str) -> DataFrame:
    """Write results, few rows per key, in the buckets of the table at ``examples``."""
    spark = df.sparkSession
    about = _about(spark, examples)
    by, heavy, dealt = about["by"], about["heavy"], about.get("dealt", about["by"])
    keyed = df.withColumns({KEY: key_digest(dealt), "__h": F.xxhash64(*dealt)})
    if heavy:
        copies = F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)
        keyed = keyed.join(_salts(spark, heavy), "__h", "left").withColumn(SALT, F.explode(copies))
    else:
        keyed = keyed.withColumn(SALT, F.lit(0))
    return _write(keyed.select(*df.columns, KEY, SALT), path, by, dealt, about["buckets"], heavy)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A table written by this module, with its buckets; also one that another session wrote."""
    if not spark.catalog.tableExists(_name(path)):
        about = _about(spark, path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(about["schema"]).fields)
        place = path.rstrip("/").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_name(path)} ({columns}) USING parquet CLUSTERED BY ({KEY}, {SALT}) SORTED BY ({KEY}, {SALT}) "
            f"INTO {about['buckets']} BUCKETS LOCATION '{place}'"
        )
    return spark.table(_name(path))


def join_buckets(spark: SparkSession, examples: str, results: str, columns: Sequence[str], values: Sequence[str] = (), how: str = "left") -> DataFrame:
    """``columns`` of the examples with ``values`` of their results (none for semi and anti joins). Nothing is shuffled.

    A key that several results share gives a row for each of them.
    """
    one, other = _about(spark, examples), _about(spark, results)
    by, dealt = one["by"], one.get("dealt", one["by"])
    if any(one[k] != other[k] for k in ("by", "buckets", "heavy")) or dealt != other.get("dealt", other["by"]):
        raise ValueError("these tables are not written in the same buckets")
    rest = [c for c in by if c not in dealt]
    sides = []
    for path, kept, marks in ((examples, columns, ("__x", "__xs")), (results, values, ("__y", "__ys"))):
        named = {marks[0]: F.xxhash64(*rest), marks[1]: key_text(rest)} if rest else {}
        sides.append(read_buckets(spark, path).select(KEY, SALT, *kept, *[v.alias(k) for k, v in named.items()]))
    left, right = sides[0].alias("l"), sides[1].hint("merge").alias("r")
    same = (F.col(f"l.{KEY}") == F.col(f"r.{KEY}")) & (F.col(f"l.{SALT}") == F.col(f"r.{SALT}"))
    if rest:  # not as equalities of columns, which the buckets would not serve
        same = same & (F.col("__x").bitwiseXOR(F.col("__y")) == 0) & F.array_contains(F.array("__xs"), F.col("__ys"))
    joined = left.join(right, same, how)
    return joined.select(*[F.col(f"l.`{c}`") for c in columns], *[F.col(f"r.`{c}`") for c in (values if how in ("left", "inner") else ())])
