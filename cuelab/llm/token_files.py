"""Token-ID files: canonical length-limited Huffman codes from global counts, in independent blocks.

A table is a folder of two Parquet tables. ``codes`` has one row: the length of every id's code (the
codes follow from the lengths) and the longest length. ``blocks`` has whole documents in ascending order
of their ids, about ``BLOCK_TOKENS`` a block: their codes, each document from a full byte on, and
checkpoints: the bit offset of every ``STEP``-th token of each document. From a checkpoint on,
decoding needs nothing before it, so all stretches of a block are decoded side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelab.workspace import fresh_path

from .encode import Encoder
from .shared import col, per_worker, text_of, vocabulary

#: No code is longer; a decoding table has 2 ** LONGEST entries.
LONGEST = 20
#: Tokens between checkpoints, and tokens after which a block ends (a longer document is one block).
STEP, BLOCK_TOKENS = 512, 1 << 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of the best prefix code without codes over ``longest`` (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    level, rows = weights, []
    is_symbol = np.ones(len(weights), bool)
    for _ in range(longest - 1):
        rows.append(is_symbol)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        place = np.argsort(both, kind="stable")
        level, is_symbol = both[place], place < len(weights)
    rows.append(is_symbol)
    take = 2 * len(weights) - 2
    for is_symbol in reversed(rows):
        symbols = int(is_symbol[:take].sum())
        out[order[:symbols]] += 1
        take = 2 * (take - symbols)
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: shorter first, then by id, each the next number of its length."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    code, last = 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= n - last
        last = n
        ids = order[lengths[order] == n]
        codes[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP, sizes: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The codes of documents of ``sizes`` ids (else of one), each from a full byte on, and the bit offset of every ``step``-th id of each."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    lasts = np.cumsum(sizes)
    bits = np.diff(np.append(0, ends)[lasts], prepend=0)
    filled = -bits % 8
    starts += np.repeat(np.cumsum(filled) - filled, sizes)
    n_bits = int((bits + filled).sum())
    words = np.zeros((n_bits >> 5) + 2, np.uint64)
    if len(ids):
        at = starts >> 5  # a code lies in one 32-bit word or two
        shifted = codes[ids] << (64 - size - (starts & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[first]] = np.add.reduceat(shifted >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    inside = np.arange(len(ids)) - np.repeat(lasts - sizes, sizes)
    return words.astype(">u4").tobytes()[: n_bits // 8], starts[inside % step == 0]


class Decoder:
    """Table-driven decoding: the next ``longest`` bits lead to an id and the length of its code."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.longest = max(1, int(lengths.max(initial=0)))
        self.ids = np.zeros(1 << self.longest, np.uint32)
        self.sizes = np.zeros(1 << self.longest, np.uint8)
        codes, used = canonical(lengths), np.flatnonzero(lengths)
        used = used[np.argsort(codes[used] << (self.longest - lengths[used].astype(np.uint64)), kind="stable")]
        reach = 1 << (self.longest - lengths[used].astype(np.int64))
        self.ids[: reach.sum()] = np.repeat(used, reach)
        self.sizes[: reach.sum()] = np.repeat(lengths[used], reach)

    def decode(self, payload: bytes, offsets: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
        """``tokens[k]`` ids from each bit offset on, all stretches in step."""
        bits = np.frombuffer(payload + b"\0\0\0\0", np.uint8)
        out = np.zeros((int(tokens.max(initial=0)), len(offsets)), np.uint32)
        order = np.argsort(-tokens, kind="stable")  # longest first: those still going are a prefix
        at, tokens_left = offsets[order].astype(np.int64), tokens[order]
        for k in range(len(out)):
            going = int(np.searchsorted(-tokens_left, -k, side="left"))
            place = at[:going]
            byte = place >> 3
            window = (bits[byte].astype(np.uint32) << 24) | (bits[byte + 1].astype(np.uint32) << 16)
            window |= (bits[byte + 2].astype(np.uint32) << 8) | bits[byte + 3]
            code = (window << (place & 7).astype(np.uint32)) >> np.uint32(32 - self.longest)
            out[k, :going] = self.ids[code]
            at[:going] += self.sizes[code]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [out[:n, k] for k, n in zip(back, tokens)]


def _tokens(docs: DataFrame, vocab: str, end_id: int, id: str, text: str) -> DataFrame:
    """``id`` and ``ids``: each row's ids with the end, as 16-bit numbers where the vocabulary allows, else 32-bit."""
    data = vocabulary(docs.sparkSession, vocab)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_buffer(data.value).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, last = per_worker("encoder", data.value, Encoder), np.uint32(end_id).tobytes()
        for batch in batches:
            ids = (np.frombuffer(x + last, "<u4") for x in encoder.ids(batch.to_pylist()))
            yield pa.array([x.astype(f"<u{width}").tobytes() for x in ids], pa.binary())

    return docs.select(col(id).alias(id), F.lit(width).alias("width"), encode(text_of(text)).alias("ids"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            ids = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"<u{batch.column(0)[0].as_py()}")
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["token", "n"])


def write_token_files(docs: DataFrame, vocab: str, path: str, end_id: int = 0, id: str = "doc_id", text: str = "text") -> str:
    """Write the ids of every whole text, ``end_id`` after each, in ascending order of ``id`` (nulls first).

    Null text is empty: only the end. Rows with the same id stand next to each other, in no fixed order of
    their own. An empty table gives empty files. ``id`` is a whole number; other columns are left out.
    Returns ``path``, a folder that all executors reach.
    """
    spark = docs.sparkSession
    ids_path = fresh_path(spark, "token-ids")  # encoded once; counts and codes read it
    _tokens(docs, vocab, end_id, id, text).write.option("compression", "zstd").parquet(ids_path)
    ids = spark.read.parquet(ids_path)
    counted = ids.select("width", "ids").mapInArrow(_count, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    table = counted.collect()  # at most one row per id of the vocabulary
    counts = np.zeros(max((r[0] for r in table), default=0) + 1, np.int64)
    for token, n in table:
        counts[token] = n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), LONGEST)], "lengths binary, longest int").coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast(lengths.tobytes())

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _to_blocks(batches, np.frombuffer(sent.value, np.uint8))

    kind = "part int, block int, first_token bigint, n_tokens bigint, ids array<bigint>, doc_tokens array<bigint>, checkpoints binary, codes binary"
    # ranges of what is written: finding their bounds must not run the coding
    rows = ids.select(col(id), "width", "ids").repartitionByRange(col(id)).sortWithinPartitions(col(id))
    rows.mapInArrow(to_blocks, kind).write.parquet(f"{path}/blocks")
    return path


def _to_blocks(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    part, number, first, codes = TaskContext.get().partitionId(), 0, 0, canonical(lengths)
    ids, bodies, held = [], [], 0

    def block() -> pa.RecordBatch:
        nonlocal number, first, ids, bodies, held
        sizes = np.array([len(x) for x in bodies], np.int64)
        payload, marks = encode_ids(np.concatenate(bodies), codes, lengths, sizes=sizes)
        row = [part, number, first, held, ids, sizes, marks.astype("<i8").tobytes(), payload]
        number, first = number + 1, first + held
        ids, bodies, held = [], [], 0
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = "part block first_token n_tokens ids doc_tokens checkpoints codes".split()
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    for batch in batches:
        for doc, width, body in zip(*(batch.column(k).to_pylist() for k in range(3))):
            ids.append(doc)
            bodies.append(np.frombuffer(body, f"<u{width}"))
            held += len(bodies[-1])
            if held >= BLOCK_TOKENS:
                yield block()
    if ids:
        yield block()


def _decode_blocks(decoder: Decoder, blocks: list[dict]) -> pa.RecordBatch:
    """The documents of some blocks; all stretches of all of them are decoded side by side."""
    payload, marks, before = [], [], 0
    for r in blocks:
        payload.append(r["codes"])
        marks.append(np.frombuffer(r["checkpoints"], "<i8") + 8 * before)
        before += len(r["codes"])
    sizes = np.concatenate([np.array(r["doc_tokens"], np.int64) for r in blocks])
    stretches = -(-sizes // STEP)
    tokens = np.full(int(stretches.sum()), STEP, np.int64)
    tokens[np.cumsum(stretches) - 1] = sizes - STEP * (stretches - 1)
    flat = np.concatenate(decoder.decode(b"".join(payload), np.concatenate(marks), tokens)).astype("<u4")
    ends = np.cumsum(sizes)
    bodies = [flat[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
    counts = [len(r["ids"]) for r in blocks]
    firsts = np.repeat([r["first_token"] for r in blocks], counts)
    inside = ends - sizes - np.repeat(np.cumsum([0] + [r["n_tokens"] for r in blocks[:-1]]), counts)
    columns = [pa.array(np.repeat([r["part"] for r in blocks], counts), pa.int32()), pa.array([i for r in blocks for i in r["ids"]], pa.int64())]
    columns += [pa.array(firsts + inside, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids"])


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in all files), ``n_tokens``, ``ids`` (little-endian 32-bit) of each document."""
    (lengths, _), *_ = spark.read.parquet(f"{path}/codes").collect()  # one row
    sent = spark.sparkContext.broadcast(bytes(lengths))
    table = spark.read.parquet(f"{path}/blocks")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker("huffman", sent.value, lambda d: Decoder(np.frombuffer(d, np.uint8)))
        for batch in batches:
            held: list[dict] = []
            for r in batch.to_pylist():
                held.append(r)
                if sum(x["n_tokens"] for x in held) >= 8 * BLOCK_TOKENS:
                    yield _decode_blocks(decoder, held)
                    held = []
            if held:
                yield _decode_blocks(decoder, held)

    docs = table.mapInArrow(decode, "part int, doc_id bigint, start bigint, n_tokens bigint, ids binary")
    parts = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per file
    before, rows = 0, []
    for part, n in sorted(parts):
        rows.append((part, before))
        before += n
    bases = F.broadcast(spark.createDataFrame(rows, "part int, base bigint"))
    return docs.join(bases, ["part"]).select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")
