"""Byte-level BPE by corpus-level merge replay, and its inverse.

The distinct pre-tokens of a block of texts form one row of bytes with walls between them. An inverted
index leads from each rank to the places where its pair stands; the merges are applied in the order of
their ranks, each at all its places, and only the touched neighbours enter the index anew.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, free_name, per_worker, text_of, vocabulary


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each word: of all neighbours that form a token, the lowest rank first, then the leftmost."""
    single = [bytes((i,)) for i in range(256)]
    part: list[bytes | None] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    index: dict[int, list[int]] = {}
    rank_of = ranks.get
    for word in words:
        at = len(part)
        starts.append(at)
        n = len(word)
        part += [single[b] for b in word]
        if n:
            after += range(at + 1, at + n)
            after.append(-1)
            before.append(-1)
            before += range(at, at + n - 1)
        for k in range(n - 1):
            r = rank_of(word[k : k + 2])
            if r is not None:
                index.setdefault(r, []).append(at + k)
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places = index.pop(rank, None)
        if places is None:
            continue
        places.sort()
        put_off: list[int] = []
        wall = -1  # a word that got a lower rank meanwhile waits up to here
        for i in places:
            if i <= wall:
                put_off.append(i)
                continue
            left, j = part[i], after[i]
            if left is None or j < 0:
                continue
            merged = left + part[j]
            if rank_of(merged) != rank:
                continue  # a neighbour has changed meanwhile
            part[i], part[j] = merged, None
            k = after[i] = after[j]
            h = before[i]
            lowest = rank
            if k >= 0:
                before[k] = i
                r = rank_of(merged + part[k])
                if r is not None:
                    if r not in index:
                        index[r] = [i]
                        heapq.heappush(heap, r)
                    else:
                        index[r].append(i)
                    lowest = min(lowest, r)
            if h >= 0:
                r = rank_of(part[h] + merged)
                if r is not None:
                    if r not in index:
                        index[r] = [h]
                        heapq.heappush(heap, r)
                    else:
                        index[r].append(h)
                    lowest = min(lowest, r)
            if lowest < rank:
                wall = i
                while after[wall] >= 0:
                    wall = after[wall]
        if put_off:
            index.setdefault(rank, []).extend(put_off)
            heapq.heappush(heap, rank)
    out = []
    for start, word in zip(starts, words):
        ids, i = [], start if word else -1
        while i >= 0:
            ids.append(ranks[part[i]])
            i = after[i]
        out.append(ids)
    return out


#: Letters up to here have the same class in every Unicode version; a test goes through them.
_PLAIN = re.compile("[\x00-\u0557]*\\Z")


class Classes:
    """Stand-ins for letters whose class (letter, number, space, other) differs between two Unicode versions.

    Patterns are matched by ``regex`` here and by tiktoken's own engine there; letters of late versions of
    Unicode are unassigned in one of them. Which class tiktoken sees is asked of tiktoken: two letters
    that its pattern does not part are one token where their bytes are in the ranks.
    """

    _STAND_INS = {"L": "z", "N": "1", "O": "#", "S": "\u2003"}

    def __init__(self, pattern: str) -> None:
        import regex

        self.pattern, self.seen, self.table = pattern, set(), {}
        self.here = [(k, regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"), ("O", ""))]

    def learn(self, letters: set[str]) -> None:
        import tiktoken

        ranks = {bytes((i,)): i for i in range(256)}
        for x in letters:
            for y in "a1!":
                ranks.setdefault((y + x).encode(), len(ranks))
        asked = tiktoken.Encoding("classes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        for x in letters:
            there = next((k for k, y in zip("LNO", "a1!") if len(asked.encode_ordinary(y + x)) == 1), "S")
            if there != next(k for k, p in self.here if p.match(x)):
                self.table[ord(x)] = self._STAND_INS[there]
        self.seen |= letters

    def plain(self, text: str) -> str:
        """The text with stand-ins, of the same length."""
        if _PLAIN.match(text):
            return text
        if new := {x for x in set(text).difference(self.seen) if x > "\u0557"}:
            self.learn(new)
        return text.translate(self.table) if self.table else text


class Replayer:
    """``ids(texts)``: little-endian unsigned 32-bit ids of each text."""

    #: Words kept for later blocks; beyond it the store is emptied.
    MOST_WORDS, MOST_CHARS = 900_000, 16 << 20

    def __init__(self, data: bytes, pattern: str) -> None:
        import regex

        self.ranks, self.split = read_ranks(data), regex.compile(pattern)
        self.classes = Classes(pattern)
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def words(self, text: str) -> list[str]:
        plain = self.classes.plain(text)
        if plain is text:
            return self.split.findall(text)
        return [text[m.start() : m.end()] for m in self.split.finditer(plain)]

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, block in blocks(texts):
            if len(self.known) > self.MOST_WORDS or self.chars > self.MOST_CHARS:
                self.known, self.chars = {}, 0
            words = [self.words(t) for t in block]
            new = list({w for ws in words for w in ws}.difference(self.known))
            self.chars += sum(map(len, new))
            spelled = [w.encode() for w in new]
            whole = [self.ranks.get(w) for w in spelled]
            merged = iter(replay([w for w, r in zip(spelled, whole) if r is None], self.ranks))
            for w, r in zip(new, whole):
                self.known[w] = array("I", next(merged) if r is None else (r,)).tobytes()
            get = self.known.__getitem__
            out += [b"".join(map(get, ws)) for ws in words]
        return out


def encoded(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """``array<int>`` of ids of a text without nulls, by the ranks, each match of ``pattern`` separately."""
    data = vocabulary(spark, ranks_path)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        replayer = per_worker("replay " + pattern, data.value, lambda d: Replayer(d, pattern))
        for batch in batches:
            yield _as_lists(replayer.ids(batch.to_pylist()))

    return encode(text)


def decoded(spark: SparkSession, ids: Column, ranks_path: str) -> Column:
    """The bytes that an ``array<int>`` of ids stands for; null for null, an error for an unknown id."""
    data = vocabulary(spark, ranks_path)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = per_worker("tokens", data.value, lambda d: {r: t for t, r in read_ranks(d).items()})
        for batch in batches:
            yield _decode(batch, tokens)

    return decode(ids)


def round_trip(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """``ids`` as of ``encoded`` and ``bytes`` as of ``decoded``, made from these ids, in one visit to a Python worker.

    Two functions one after the other would have two workers a core, each with the stores of both in time.
    """
    data = vocabulary(spark, ranks_path)

    @F.arrow_udf("ids array<int>, bytes binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        replayer = per_worker("replay " + pattern, data.value, lambda d: Replayer(d, pattern))
        tokens = {r: t for t, r in replayer.ranks.items()}
        for batch in batches:
            ids = _as_lists(replayer.ids(batch.to_pylist()))
            yield pa.StructArray.from_arrays([ids, _decode(ids, tokens)], names=["ids", "bytes"])

    return both(text)


def _as_lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in ids])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _decode(ids: pa.Array, tokens: dict[int, bytes]) -> pa.Array:
    get = tokens.__getitem__
    return pa.array([None if x is None else b"".join(map(get, x.tolist())) for x in _lists(ids)], pa.binary())


def _lists(batch: pa.Array) -> Iterator[np.ndarray | None]:
    values, ends = batch.values.to_numpy(), batch.offsets.to_numpy()
    for i, there in enumerate(batch.is_valid().to_pylist()):
        yield values[ends[i] : ends[i + 1]] if there else None


def with_ids(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` without ``text`` and with ``ids`` (array<int>) of each row's whole text; null text has no ids.

    One row for each row, whatever the other columns hold. A map over the texts, no shuffle. A column that
    is already called ``into`` keeps its name, and the ids get underscores before theirs.
    """
    rest = docs.drop(text)
    return docs.withColumn(free_name(rest, into), encoded(docs.sparkSession, text_of(text), ranks_path, pattern)).select(
        *rest.columns, free_name(rest, into)
    )
