"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments. With at most three differing bits, at most one
segment differs in two or more, so two of the three segments differ in at most one each. For such a
pair of segments, the nearest codewords of one fingerprint are among the codewords within four bits
of the other (see ``golay``): every fingerprint is put down under one key per pair of segments and
asked for under the few combinations of its near codewords. Candidates are verified in the join.
Only distinct fingerprints are joined, so copies do not multiply; links are between fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .components import components
from .golay import Golay
from .shared import col, free_name, per_worker, side, text_of, with_row_tag

#: Bits of the three segments, from the highest on.
SEGMENTS = (22, 21, 21)
#: The scheme finds all pairs up to here.
MOST_BITS = 3


def fingerprint(text: str, shingle: int = 3) -> int:
    """Bits that are set in over half of the shingles' XXH64 (seed 42); signed, 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and white space 9-13 and 32
    if not words:
        return 0
    n, digest = len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(b" ".join(words), 42)]
    else:
        joined, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        starts = [0] + [e + 1 for e in ends[: n - shingle]]
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])]
    total = np.zeros(64, np.int64)
    array = np.array(hashes, np.uint64).astype(">u8")
    for k in range(0, len(array), 1 << 16):
        bits = np.unpackbits(array[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(shingle: int = 3):
    """The fingerprint column function, for texts without nulls."""

    @F.arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fingerprint(t, shingle) for t in batch.to_pylist()], pa.int64())

    return of


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    out, left = [], 64
    for n in SEGMENTS:
        left -= n
        out.append(((prints.view(np.uint64) >> np.uint64(left)) & np.uint64((1 << n) - 1)).astype(np.int64))
    return out


PAIRS = ((0, 1), (0, 2), (1, 2))


def _keys(batches: Iterator[pa.RecordBatch], put: bool) -> Iterator[pa.RecordBatch]:
    golay = per_worker("golay", b"", lambda _: Golay())
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), 2000):
            prints = whole[at : at + 2000]
            segments = _segments(prints)
            near = [golay.nearest(s)[:, None] if put else golay.within_four(s) for s in segments]
            for number, (a, b) in enumerate(PAIRS):
                key = (near[a][:, :, None] << 12) | near[b][:, None, :]
                good = (near[a][:, :, None] >= 0) & (near[b][:, None, :] >= 0)
                row = np.broadcast_to(np.arange(len(prints))[:, None, None], key.shape)[good]
                columns = [pa.array((number << 24 | key[good]).astype(np.int32)), pa.array(prints[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "fp"])


def near_pairs(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """All links ``u`` < ``v`` of distinct fingerprints (column ``fp``) with at most ``most_bits`` differing bits."""
    if not 0 <= most_bits <= MOST_BITS:
        raise ValueError(f"the keys find pairs of up to {MOST_BITS} differing bits")
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = prints.select("fp").repartition(tasks, "fp")  # a fingerprint becomes many keys
    put = prints.mapInArrow(lambda b: _keys(b, True), "key int, fp bigint").select(F.col("key").alias("put"), F.col("fp").alias("u"))
    ask = prints.mapInArrow(lambda b: _keys(b, False), "key int, fp bigint").select(F.col("key").alias("asked"), F.col("fp").alias("v"))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most_bits
    return ask.join(put.hint("merge"), (F.col("asked") == F.col("put")) & (F.col("u") < F.col("v")) & close).select("u", "v")


def groups(prints: DataFrame, id: str, most_bits: int = MOST_BITS) -> DataFrame:
    """For each fingerprint of a written table (``fp``, ``id``): ``first_id``, the least id in its component, and ``component``, its least fingerprint."""
    distinct = materialise(prints.groupBy("fp").agg(F.min(col(id)).alias("first_id")), "fingerprints")
    linked = components(near_pairs(distinct, most_bits)).withColumnRenamed("node", "fp")
    linked = materialise(distinct.join(linked.hint("merge"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("component")), "components")
    firsts = linked.groupBy("component").agg(F.min("first_id").alias("least"))
    return linked.join(firsts.hint("merge"), "component").select("fp", F.col("least").alias("first_id"), "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = MOST_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``fingerprint`` (16 hex digits) and ``component_id`` of each row.

    ``component_id`` is the least id that links of at most ``most_bits`` differing bits reach, itself
    included; null ids count only if there is no other. Null and empty texts have fingerprint zero and are
    linked like any other. Repeated rows give repeated rows; other columns are left out.
    """
    prints = docs.select(col(id).alias(id), fingerprints(shingle)(text_of(text)).alias("fp"))
    prints = materialise(prints, "fingerprints-of-rows")
    joined = prints.join(groups(prints, id, most_bits).hint("merge"), "fp")
    return joined.select(col(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, most_bits: int = MOST_BITS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the least id (of repeated ids, the first written)."""
    columns = docs.columns
    fp = free_name(docs, "fp")
    tagged, tag = with_row_tag(docs.withColumn(fp, fingerprints(shingle)(text_of(text))), "documents-with-fingerprints")
    rows = tagged.select(col(id).alias("id"), F.col(tag).alias("tag"), F.col(fp).alias("fp"))
    of = groups(rows, "id", most_bits)
    rows = rows.join(of.hint("merge"), "fp")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("tag"))  # null ids last
    keep = rows.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("n")).where("n > 1")
    keep = keep.select("component", F.col("o.tag").alias("keep"))
    dropped = rows.join(keep.hint("merge"), "component").where("tag <> keep").select(F.col("tag").alias(tag))
    dropped = materialise(dropped, "near-duplicates")
    return tagged.join(side(dropped, 16), tag, "left_anti").select(*[col(c) for c in columns])
