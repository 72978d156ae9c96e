"""Best-fit packing of token sequences by exact complements.

Everything about which lengths go together is decided on the histogram of lengths, which has at most
``capacity`` entries however many documents there are: combinations that fill a sequence exactly are
looked up by single, pair and triple sums and consumed as often as the counts allow, the rest goes by
best fit, longest first, whole groups of equal bins at a time (``plan``). The plan says which ranks of
a length go to which run of sequences; pieces get their ranks in parallel, by hash slices of each
length, so a length that a third of all rows share is spread over all tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelab.workspace import materialise

from .encode import Encoder
from .shared import col, per_worker, text_of, vocabulary


class _Complements:
    """Counts by length, and the combinations of one, two or three of them that fill a gap exactly."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] else None

    def pair(self, gap: int, most: int | None = None) -> tuple[int, ...] | None:
        """The pair with the longest first part (at most ``most``) whose sum is ``gap``."""
        top = min(gap - 1, most or gap - 1)
        a = np.arange(top, (gap - 1) // 2, -1)
        if not len(a):
            return None
        b = gap - a
        fits = np.flatnonzero((self.left[a] > 0) & (self.left[b] > (a == b)))
        return (int(a[fits[0]]), int(b[fits[0]])) if len(fits) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for a in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if self.left[a]:
                self.left[a] -= 1
                two = self.pair(gap - a, a)
                self.left[a] += 1
                if two:
                    return (a, *two)
        return None

    def take(self, lengths: tuple[int, ...]) -> int:
        """Consume a combination as often as the counts allow."""
        need = Counter(lengths)
        n = min(int(self.left[x]) // k for x, k in need.items())
        for x, k in need.items():
            self.left[x] -= n * k
        return n


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (lengths, in order of their place) and how many sequences get each.

    ``counts``: how many pieces have each length, 1 to ``capacity``.
    """
    stock, out = _Complements(counts, capacity), []
    if stock.left[capacity]:
        out.append(((capacity,), stock.take((capacity,))))
    for find in (stock.single, stock.pair, stock.triple):
        for length in range(capacity - 1, 0, -1):
            while stock.left[length]:
                stock.left[length] -= 1
                rest = find(capacity - length)
                stock.left[length] += 1
                if rest is None:
                    break
                out.append(((length, *rest), stock.take((length, *rest))))
    # bins of equal filling are one group; best fit puts a piece where the least room is left
    groups: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = defaultdict(list)

    def put(filling: tuple[int, ...], n: int) -> None:
        if filling not in groups:
            by_room[capacity - sum(filling)].append(filling)
        groups[filling] = groups.get(filling, 0) + n

    for length in range(capacity, 0, -1):
        todo = int(stock.left[length])
        while todo:
            room = next((r for r in range(length, capacity) if by_room.get(r)), None)
            if room is None:
                each = capacity // length
                if todo >= each:
                    put((length,) * each, todo // each)
                if todo % each:
                    put((length,) * (todo % each), 1)
                break
            filling = by_room[room][-1]
            each = min(room // length, todo)
            bins = min(groups[filling], todo // each)
            groups[filling] -= bins
            if not groups[filling]:
                del groups[filling]
                by_room[room].pop()
            put(filling + (length,) * each, bins)
            todo -= bins * each
    return out + list(groups.items())


def slots(fillings: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) for each place of each filling."""
    used: Counter = Counter()
    out, sequence = [], 0
    for lengths, n in fillings:
        offset = 0
        for x in lengths:
            out.append((x, used[x], used[x] + n, sequence, offset))
            used[x] += n
            offset += x
        sequence += n
    return out


def place(pieces: DataFrame, capacity: int, id: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with ``length`` 1 to ``capacity``.

    Rows are not merged or dropped; repeated rows are packed each. The columns ``id`` and ``piece`` order
    pieces of one length.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    table = slots(plan(counts, capacity))  # a few per length
    kind = "length bigint, rank_from bigint, rank_to bigint, first_sequence bigint, offset bigint"
    table = F.broadcast(spark.createDataFrame(table, kind))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(col(id), "piece"), F.lit(slices)))
    per_slice = sliced.groupBy("length", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = sliced.withColumn("rank", F.row_number().over(Window.partitionBy("length", "slice").orderBy(col(id), "piece")))
    ranked = ranked.join(per_slice.hint("merge"), ["length", "slice"]).withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(table, ["length"]).where("rank >= rank_from and rank < rank_to")
    sequence = (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id")
    return placed.select(*[col(c) for c in pieces.columns], sequence, "offset")


def pieces_of(docs: DataFrame, vocab: str, capacity: int, end_id: int, id: str, text: str, with_ids: bool) -> DataFrame:
    """Token ids of each row's whole text with ``end_id``, cut into pieces; the first takes what doesn't fill a piece."""
    data = vocabulary(docs.sparkSession, vocab)
    kind = T.StructType([T.StructField(id, docs.schema[id].dataType)])
    kind = kind.add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    kind = kind.add("ids", T.BinaryType()) if with_ids else kind
    last = np.uint32(end_id).tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker("encoder", data.value, Encoder)
        for batch in batches:
            row, piece, start, length, crc, body = [], [], [], [], [], []
            for i, ids in enumerate(encoder.ids(batch.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                at, to = 0, n % capacity or capacity
                while at < n:
                    part = ids[4 * at : 4 * to]
                    row.append(i)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        body.append(part)
                    at, to = to, to + capacity
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)] + [pa.array(body, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return docs.select(col(id).alias(id), text_of(text).alias("body")).mapInArrow(cut, kind)


def pack(docs: DataFrame, vocab: str, capacity: int = 1024, end_id: int = 2, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every row's token ids into as few sequences of ``capacity`` as the plan finds.

    One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``
    (and the ``ids``, little-endian 32-bit, if asked for). Null text is empty: one token, the end. Null and
    repeated ids are packed like others, each row for itself. No rows: no sequences. Other columns of
    ``docs`` are left out.
    """
    pieces = materialise(pieces_of(docs, vocab, capacity, end_id, id, text, with_ids), "pieces")
    return place(pieces, capacity, id)
