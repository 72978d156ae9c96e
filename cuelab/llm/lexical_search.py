"""Ranked search: the Best Position Algorithm over impact lists.

One pass over the texts keeps, of each document, its number of terms and the counts of terms that some item
asks for. Documents are then worked off in blocks: a term's impact list has the documents of the block by
falling contribution, and a table of places finds a document in any list directly. Reading goes down all
lists of an item at once; each document met is looked up in every list, so all its places count as seen. The
best position of a list is the last one before which nothing is unseen; what the lists have there bounds the
score of any document not met. Reading stops when that bound is strictly below the k-th score so far, so
equal scores are all known. A task carries each item's best k from block to block, and with them the bound.

Items are taken in blocks of a bounded size; only they, and document counts of their terms, are broadcast.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .running import running
from .shared import col, text_of

#: Bytes of item texts that are searched for at once, besides one item.
ITEM_BYTES = 1 << 17
#: Cells of the table of places (terms x documents), and documents in a block.
PLACES, MOST_DOCS, LEAST_DOCS = 1 << 24, 8192, 256
#: Positions read from each list in the first round; twice as many in each later one.
FIRST_ROUND = 8
#: Lists of best documents are merged in so many heaps for each item, then these.
HEAPS = 64
#: Bytes of a text that are split at once.
PIECE = 1 << 20

_UPPER = bytes(range(65, 91))
#: ASCII letters and digits and everything beyond ASCII stay, A-Z in lower case; the rest are separators.
_TABLE = bytes(c + 32 if c in _UPPER else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in pieces, so that a long text needs no list of all of them."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else text.rfind(b" ", at, at + PIECE)
        if end < 0:
            end = text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


def _counted(number: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = number.get
        for batch in batches:
            size, ids, counts = [], [], []
            for text in batch.column(1).to_pylist():
                n, found = 0, Counter()
                for words in terms(text):
                    n += len(words)
                    found.update(x for x in map(get, words) if x is not None)
                size.append(n)
                ids.append(list(found))
                counts.append(list(found.values()))
            kinds = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *map(pa.array, (ids, counts), kinds)], names=["id", "n", "terms", "counts"])

    return run


class _Block:
    """Impact lists of some documents, and where each document is in them."""

    def __init__(self, n: np.ndarray, of: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, n_docs: int, all_terms: int):
        if 25 * int(n.max(initial=0)) * n_docs < 1 << 63:
            relative = 25 * n * n_docs // all_terms
        else:
            relative = np.array([25 * int(x) * n_docs // all_terms for x in n], np.int64)
        m = 75 + relative
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[of]))
        order = np.lexsort((of, -impact, term))
        self.doc, term = of[order], term[order]
        self.impact = np.append(impact[order], 0)  # a place past the end for documents that a list lacks
        self.start = np.searchsorted(term, np.arange(len(weight) + 1))
        self.place = np.full((len(weight), len(n)), len(order), np.int32)
        self.place[term, self.doc] = np.arange(len(order))
        self.docs = len(n)

    def search(self, asked: np.ndarray, times: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and documents that may be among the best ``k``. ``known``: the best scores so far, falling, at most ``k``."""
        start, length = self.start[asked], self.start[asked + 1] - self.start[asked]
        has = length > 0
        asked, times, start, length = asked[has], times[has], start[has], length[has]
        seen, met = np.zeros(len(self.impact), bool), np.zeros(self.docs, bool)
        best = np.zeros(len(asked), np.int64)
        scores, docs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        top, read, step = known, 0, FIRST_ROUND
        while True:
            bound = int((times * np.where(best < length, self.impact[start + np.maximum(best - 1, 0)], 0)).sum())
            if bound == 0 or (len(top) == k and bound < top[-1]):
                return np.concatenate(scores), np.concatenate(docs)
            rows = read + np.arange(step)
            lines = (start[:, None] + rows)[rows < length[:, None]]
            new = self.doc[lines]
            new = np.unique(new[~met[new]])
            met[new] = True
            places = self.place[asked[:, None], new]
            seen[places] = True
            score = times @ self.impact[places]
            scores.append(score)
            docs.append(new)
            top = np.sort(np.concatenate([top, score]))[::-1][:k]
            read, step = read + step, 2 * step
            for i in np.flatnonzero(best < length):
                rest = seen[start[i] + best[i] : start[i] + length[i]]
                gap = int(rest.argmin())
                best[i] = length[i] if rest[gap] else best[i] + gap


def _searched(items: list[tuple[int, list[int], list[int]]], weight: np.ndarray, n_docs: int, all_terms: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = {tag: (none, none, none.astype(bool)) for tag, _, _ in items}  # score, id, whether the id is null
        asked = [(tag, np.array(t, np.int64), np.array(c, np.int64)) for tag, t, c in items]
        most = max(LEAST_DOCS, min(MOST_DOCS, PLACES // max(1, len(weight))))

        def block(batch: pa.RecordBatch) -> None:
            ids = batch.column(0)
            null, id = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            lists = batch.column(2)
            of = np.repeat(np.arange(len(id)), lists.value_lengths().to_numpy())
            term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
            lists = _Block(batch.column(1).to_numpy(), of, term, tf, weight, n_docs, all_terms)
            for tag, t, c in asked:
                known = best[tag]
                score, doc = lists.search(t, c, k, known[0])
                good = score > 0
                every = [np.concatenate(x) for x in zip(known, (score[good], id[doc[good]], null[doc[good]]))]
                first = np.lexsort((every[1], every[2], -every[0]))[:k]
                best[tag] = tuple(x[first] for x in every)

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                block(batch.slice(at, most))
        for tag, (score, id, null) in best.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array([tag] * len(score), pa.int64()), pa.array(id, mask=null), pa.array(score)], names=["tag", "id", "score"])

    return run


def _search_items(docs: DataFrame, asked: list[tuple[int, bytes]], k: int) -> DataFrame | None:
    """``tag``, ``id``, ``score``: the best ``k`` of each task for each item; nothing if no document has a term."""
    number: dict[bytes, int] = {}
    items = []
    for tag, text in asked:
        counts = Counter(number.setdefault(x, len(number)) for words in terms(text) for x in words)
        if counts:
            items.append((tag, list(counts), list(counts.values())))
    counted = materialise(docs.mapInArrow(_counted(number), "id bigint, n bigint, terms array<int>, counts array<bigint>"), "term-counts")
    n_docs, all_terms = counted.where("n > 0").agg(F.count("*"), F.sum("n")).first()
    if not n_docs or not items:
        return None
    held = np.zeros(len(number), np.int64)
    for term, n in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():
        held[term] = n  # a row per term of these items
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in held], np.int64)
    return counted.where(F.size("terms") > 0).mapInArrow(_searched(items, weight, n_docs, all_terms, k), "tag bigint, id bigint, score bigint")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: ``item_id``, ``rank`` (from 1), ``id``, ``score``.

    Equal scores go by id, null ids last. Every row of ``items`` is an item of its own, also where ids are
    null or repeated; every row of ``docs`` is a document. Null texts have no terms. Items without terms and
    empty tables give no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    bodies = docs.select(col(id).cast("bigint").alias("id"), text_of(text).cast("binary").alias("text"))
    sized = items.select(col(item_id).alias("item_id"), text_of(item_text).cast("binary").alias("text"), F.lit(0).alias("all"))
    sized = sized.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    sized = running(sized, "all", [F.col("item_id"), F.col("text")], ("n_bytes",), "items")
    sized = materialise(sized.select("item_id", "text", F.col("place").alias("tag"), F.floor(F.col("upto_n_bytes") / ITEM_BYTES).alias("part")), "numbered-items")
    found = []
    for (part,) in sized.select("part").distinct().orderBy("part").collect():
        asked = [(r.tag, bytes(r.text)) for r in sized.where(F.col("part") == part).orderBy("tag").collect()]
        result = _search_items(bodies, asked, k)
        if result is not None:
            found.append(materialise(result, "best-of-tasks").withColumn("heap", F.pmod(F.xxhash64("id", "score"), F.lit(HEAPS))))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    if not found:
        empty = spark.range(0).select(F.col("id").alias("tag"), "id", F.col("id").alias("score"), F.lit(0).alias("heap"))
        found = [empty]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    heaps = every.withColumn("rank", F.row_number().over(Window.partitionBy("tag", "heap").orderBy(*order))).where(F.col("rank") <= k)
    best = heaps.withColumn("rank", F.row_number().over(Window.partitionBy("tag").orderBy(*order))).where(F.col("rank") <= k)
    named = best.join(sized.select("tag", "item_id").hint("merge"), "tag")
    return named.select(F.col("item_id").alias(item_id), "rank", F.col("id").alias(id), "score")
