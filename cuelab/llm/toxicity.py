"""Toxicity by class-conditional Kneser-Ney models.

One bigram model is counted on toxic texts and one on ordinary texts. Absolute discounting takes the same
from every count, and what it frees goes to backoff distributions that both models share: the weights
of the backoff and the continuation counts are pooled. So an expression that is rare, or equally common
in both, weighs nothing, and ``log P(toxic) - log P(ordinary)`` of a word tells how much it speaks for
toxicity. A text is compared as a whole and in its one and two most toxic words (each after the word before
it), all normalised by length, since a few expressions make a long text toxic. A logistic curve fitted on
training rows, each scored by a model without its half, makes it 0 to 1.

Words and pairs are counted, and the logistic curve is fitted, over all labelled training rows. What a word says is drawn
to nothing, and what a pair says to what its second word says, the more the less the texts that have it differ from chance:
by the share that ``EVIDENCE`` has in their G squared, so two texts can be enough and hundreds count almost whole, and a pair
with no more than ``EVIDENCE`` says what its second word says. Pairs are counted between words of two texts or more; a word of
a single text is not in the vocabulary, as its pairs would say no more.

Words and pairs without that evidence weigh exactly nothing, so workers that score hold only the others. For the counting of
pairs workers hold all words of the vocabulary (``Numbers``), the driver their names; counts are gathered of the words with evidence
alone. What they hold is bounded by ``MOST_WORDS``, ``MOST_TOLD`` and ``MOST_PAIRS``. A model beyond one of them is not cut: all of it stays in
tables (``Tables``), and texts meet it word by word in joins, with the same scores. Every text is scored.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelab.workspace import materialise

from .shared import blocks, col, free_name, per_worker, side, text_of, with_row_tag

#: Training rows up to which the driver fits the logistic curve itself; of more the steps are summed up by Spark.
MOST_TOXIC, MOST_ORDINARY = 8_000, 16_000
#: Words whose pairs are counted by number, words and pairs that workers score by; a larger model stays in tables.
MOST_WORDS, MOST_TOLD, MOST_PAIRS = 1 << 23, 1 << 20, 1 << 22
#: G squared of the texts of each class that have an expression, against the share of the classes, that chance can have.
EVIDENCE, DISCOUNT = 6.0, 0.75
THRESHOLD = 0.3
#: The rest of the id's checksum that is never learned from.
HELD_OUT = 2

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(col(id).cast("string")) % 4 == HELD_OUT, F.lit(False))


@dataclass
class Ratios:
    """Log-likelihood ratios of words and of pairs (``first * size + second``, ascending)."""

    words: np.ndarray
    pairs: np.ndarray
    of_pairs: np.ndarray

    def of(self, ids: np.ndarray) -> np.ndarray:
        """The ratio of each word after the one before; 0 for unknown words (-1)."""
        if not len(self.words):
            return np.zeros(len(ids))
        out = np.where(ids >= 0, self.words[ids], 0.0)
        if len(ids) > 1 and len(self.pairs):
            keys = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.words) + ids[1:], -1)
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            known = self.pairs[at] == keys
            out[1:][known] = self.of_pairs[at[known]]
        return out

    def features(self, ids: np.ndarray) -> tuple[float, float, float]:
        """Length-normalised: of the whole text, of its most toxic word, and of its two most toxic words."""
        if not len(ids):
            return 0.0, 0.0, 0.0
        ratio = self.of(ids)
        best = np.sort(np.partition(ratio, -2)[-2:]) if len(ratio) > 1 else ratio
        return float(ratio.mean()), float(best[-1]), float(best.mean())


def evidence(docs: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """G squared of ``docs`` (ordinary, toxic texts that have an expression) against the classes' numbers of texts."""
    expected = docs.sum(1, keepdims=True) * (texts / max(texts.sum(), 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * np.where(docs > 0, docs * np.log(docs / expected), 0.0).sum(1)


def _of_words(words: np.ndarray, continued: np.ndarray, total: np.ndarray, seen: int, places: float) -> np.ndarray:
    """P(w) of each class; ``total``: all counts of each class, ``seen``: the words that have any, ``places``: all of ``continued`` + 1."""
    shared = (continued + 1.0) / places
    return (words - DISCOUNT).clip(0) / total.clip(1) + (DISCOUNT * seen / total.clip(1).sum()) * shared[:, None]


def _of_pairs(pair_counts: np.ndarray, first: np.ndarray, followers: np.ndarray, of_second: np.ndarray) -> np.ndarray:
    """P(w | v) of each class, from the counts of each pair and of its first word, the followers of that, and P(w) of the second."""
    weight = DISCOUNT * followers.clip(1) / first.sum(1).clip(1)
    return (pair_counts - DISCOUNT).clip(0) / first.clip(1) + weight[:, None] * of_second


def _ratio(p: np.ndarray) -> np.ndarray:
    """Nothing where neither class has a word to learn from."""
    p = np.where(p.any(1)[:, None], p, 1.0)
    return np.log(p[:, 1]) - np.log(p[:, 0])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (the last is the constant), slightly drawn to zero; Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    pull = np.array([1e-2] * (x.shape[1] - 1) + [1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logistic_over(rows: DataFrame, x: list[str], y: str) -> np.ndarray:
    """``_logistic`` of a written table: each step's sums are made by Spark, so that the rows stay where they are."""
    names = [*x, None]
    value = [F.col(c) if c else F.lit(1.0) for c in names]
    at = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    w = np.zeros(len(names))
    pull = np.array([1e-2] * len(x) + [1e-4])
    for _ in range(50):
        z = sum((v * float(k) for v, k in zip(value, w)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        told = rows.select(*x, y, p.alias("p"))
        first = [F.sum(v * (F.col("p") - F.col(y))) for v in value]
        second = [F.sum(value[i] * value[j] * F.col("p") * (1 - F.col("p"))) for i, j in at]
        sums = told.agg(*[s.alias(f"s{i}") for i, s in enumerate(first + second)]).first()
        grad, curve = np.array(sums[: len(names)]) + pull * w, np.diag(pull)
        for (i, j), v in zip(at, sums[len(names) :]):
            curve[i, j] += v
            if i != j:
                curve[j, i] += v
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _digest(word: Column) -> Column:
    """The first 8 bytes of a word's md5."""
    return F.unhex(F.left(F.md5(word), F.lit(16)))


@dataclass
class Numbers:
    """The words of a vocabulary, numbered in the order of their digests (``_digest``): a binary search finds a word, no hash table is built."""

    names: pa.Array
    digests: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> Numbers:
        """From the columns ``word`` and ``digest``."""
        digests = np.frombuffer(table.column("digest").combine_chunks().cast(pa.binary(8)).buffers()[1] or b"", ">u8", table.num_rows).astype(np.uint64)
        order = np.argsort(digests, kind="stable")
        return Numbers(table.column("word").combine_chunks().take(pa.array(order)), digests[order])

    def dump(self) -> bytes:
        return pickle.dumps((self.names, self.digests))

    @staticmethod
    def load(data: bytes) -> Numbers:
        return Numbers(*pickle.loads(data))

    def __len__(self) -> int:
        return len(self.digests)

    def find(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for those that are not there."""
        out = np.full(len(words), -1, np.int64)
        if not len(words) or not len(self):
            return out
        wanted = np.frombuffer(b"".join([hashlib.md5(w.encode()).digest()[:8] for w in words]), ">u8").astype(np.uint64)
        at, asked = np.searchsorted(self.digests, wanted), pa.array(words, self.names.type)
        open_ = (at < len(self)) & (self.digests[np.minimum(at, len(self) - 1)] == wanted)
        while open_.any():  # once, but for words that share a digest
            rows = np.flatnonzero(open_)
            same = pc.equal(self.names.take(pa.array(at[rows])), asked.take(pa.array(rows))).to_numpy(zero_copy_only=False)
            out[rows[same]] = at[rows[same]]
            at[rows] += 1
            open_[rows[same]] = False
            open_ &= (at < len(self)) & (self.digests[np.minimum(at, len(self) - 1)] == wanted)
        return out


@dataclass
class Model:
    """Words and their numbers, ratios, and the weights of the features and the constant."""

    vocabulary: dict[str, int]
    ratios: Ratios | None
    weights: tuple[float, ...]

    def dump(self) -> bytes:
        """Plain values: workers need not have this module."""
        r = self.ratios
        return pickle.dumps((self.vocabulary, r and (r.words, r.pairs, r.of_pairs), self.weights))

    @staticmethod
    def load(data: bytes) -> Model:
        vocabulary, ratios, weights = pickle.loads(data)
        return Model(vocabulary, ratios and Ratios(*ratios), weights)

    def ids(self, text: str) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def score(self, text: str) -> float:
        if self.ratios is None:
            return self.weights[0]
        x = np.dot((*self.ratios.features(self.ids(text)), 1.0), self.weights)
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


CELLS = [f"{k}{i}" for k in "dc" for i in range(4)]  # texts and occurrences: ordinary half 0 and 1, toxic half 0 and 1


def _table(name: str, keys: pa.Array, places: np.ndarray, owners: np.ndarray, cells: np.ndarray) -> pa.RecordBatch:
    """A row per key with ``CELLS``, from the place of each occurrence's key, the text it is in and each text's cell."""
    at, counts = np.unique(places * len(cells) + owners, return_counts=True)  # once for each key and text
    at = at // len(cells) * 4 + cells[at % len(cells)]
    d, c = np.bincount(at, minlength=4 * len(keys)), np.bincount(at, counts, 4 * len(keys))
    columns = [pa.array(np.ascontiguousarray(x[k::4]).astype(np.int64)) for x in (d, c) for k in range(4)]
    return pa.RecordBatch.from_arrays([keys, *columns], names=[name, *CELLS])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, block in blocks(batch.column(1).to_pylist(), 3 << 22):
            yield cells[at : at + len(block)], block


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cells, block in _texts(batches):
        number: dict[str, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int64) for t in block]
        owners = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        yield _table("word", pa.array(list(number), pa.string()), np.concatenate(ids), owners, cells)


def _strength(texts: np.ndarray) -> Column:
    """The most of ``evidence`` in both halves and in each of them, so that a half's own choice stays open."""

    def of(halves: tuple[int, ...]) -> Column:
        o, t = (sum((F.col(f"d{2 * y + h}") for h in halves[1:]), F.col(f"d{2 * y + halves[0]}")) for y in (0, 1))
        whole = [float(sum(texts[2 * y + h] for h in halves)) for y in (0, 1)]
        if not all(whole):
            return F.lit(0.0)
        part = lambda n, y: F.when(n > 0, n * F.log(n / ((o + t) * F.lit(whole[y] / sum(whole))))).otherwise(0.0)
        return 2 * (part(o, 0) + part(t, 1))

    return F.greatest(of((0, 1)), of((0,)), of((1,)))


#: The halves that a model is made of: both, and each alone to score the rows of the other.
SETS = ((0, 1), (0,), (1,))


def _classes(cells: np.ndarray, halves: tuple[int, ...]) -> np.ndarray:
    """Ordinary and toxic of these halves, from the four cells in the last dimension."""
    return np.stack([cells[..., list(halves)].sum(-1), cells[..., [2 + h for h in halves]].sum(-1)], -1)


def _told(docs: np.ndarray, numbers: np.ndarray, halves: tuple[int, ...]) -> np.ndarray:
    """The share of a ratio that its evidence leaves."""
    return 1 - EVIDENCE / np.maximum(evidence(_classes(docs, halves), _classes(numbers, halves)), EVIDENCE)


def _word_pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row with ``CELLS`` for each pair of neighbours, as two words."""
    for cells, block in _texts(batches):
        number: dict[str, int] = {}
        ids = [np.fromiter((number.setdefault(w, len(number)) for w in words_of(t)), np.int64) for t in block]
        size = max(len(number), 1)
        keys, places = np.unique(np.concatenate([x[:-1] * size + x[1:] for x in ids]), return_inverse=True)
        owners = np.repeat(np.arange(len(ids)), [max(len(x) - 1, 0) for x in ids])
        table, names = _table("pair", pa.array(keys), places, owners, cells), pa.array(list(number), pa.string())
        sides = [names.take(pa.array(keys // size)), names.take(pa.array(keys % size))]
        yield pa.RecordBatch.from_arrays([*sides, *table.columns[1:]], names=["first", "second", *CELLS])


def _in_sets() -> list[Column]:
    """The numbers of rows of all, of half 0, of half 1."""
    return [F.count("*"), *(F.count_if(F.col(f"d{h}") + F.col(f"d{h + 2}") > 0) for h in (0, 1))]


def _neighbours(pairs: DataFrame, by: str, name: str) -> DataFrame:
    """In how many different pairs each word is, by ``SETS``."""
    return pairs.groupBy(F.col(by).alias("word")).agg(*[c.alias(f"{name}{i}") for i, c in enumerate(_in_sets())])


def _class_sums(cells: list[Column], halves: tuple[int, ...]) -> list[Column]:
    """All ordinary and all toxic occurrences of words in these halves, and the number of words that have any."""
    o, t = (sum((cells[2 * y + h] for h in halves[1:]), cells[2 * y + halves[0]]) for y in (0, 1))
    return [F.sum(o), F.sum(t), F.count_if(o + t > 0)]


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in names], -1)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each text has each word after each other; a row without a word for a text that has none."""
    for batch in batches:
        tags, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, block in blocks(batch.column(2).to_pylist(), 1 << 20):
            tag, part, first, second, n = [], [], [], [], []
            for i, text in enumerate(block, at):
                words = words_of(text)
                found = Counter(zip([None, *words], words)) or {(None, None): 0}
                tag += [tags[i]] * len(found)
                part += [parts[i]] * len(found)
                first += [k[0] for k in found]
                second += [k[1] for k in found]
                n += found.values()
            columns = [pa.array(tag, pa.int64()), pa.array(part, pa.int32()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=["tag", "part", "first", "second", "n"])


@dataclass
class Tables:
    """A model that no worker holds: ``words`` (``word``) and ``pairs`` (``first``, ``second``) with their ratios ``r0`` to ``r2``
    by ``SETS``, and the weights of the features and the constant."""

    words: DataFrame
    pairs: DataFrame
    weights: tuple[float, ...] = ()

    @staticmethod
    def of(every: DataFrame, words: DataFrame, numbers: np.ndarray) -> Tables:
        """From the rows to learn from (``cell``, ``body``), the vocabulary with its ``CELLS`` and the numbers of texts."""
        longs = ", ".join(f"{c} bigint" for c in CELLS)
        counted = every.mapInArrow(_word_pair_counts, f"first string, second string, {longs}")
        pairs = counted.groupBy("first", "second").agg(*[F.sum(c).alias(c) for c in CELLS])
        for at in ("first", "second"):
            pairs = pairs.join(words.select(F.col("word").alias(at)).hint("merge"), at, "left_semi")
        pairs = materialise(pairs, "pairs")
        full = words
        for by, name in (("second", "b"), ("first", "a")):  # how many words come before and after
            full = full.join(_neighbours(pairs, by, name).hint("merge"), "word", "left")
        full = materialise(full.na.fill(0), "words")

        cells = [F.col(f"c{k}") for k in range(4)]
        sums = full.agg(*[c.alias(f"{i}{k}") for i, h in enumerate(SETS) for k, c in enumerate(
            [*_class_sums(cells, h), F.sum(F.col(f"b{i}") + 1)])]).first()
        sums = np.array([float(v or 0) for v in sums]).reshape(len(SETS), 4)
        known = [f"{k}{i}" for k in "wp" for i in range(2 * len(SETS))] + [f"r{i}" for i in range(len(SETS))]

        def word_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t, before = _matrix(batch, CELLS), _matrix(batch, ["b0", "b1", "b2"])
                counts = [_classes(t[:, 4:], s) for s in SETS]
                of = [_of_words(c, before[:, i], sums[i, :2], sums[i, 2], sums[i, 3]) for i, c in enumerate(counts)]
                ratios = [_ratio(p) * _told(t[:, :4], numbers, s) for p, s in zip(of, SETS)]
                values = [*np.concatenate([*counts, *of], 1).T, *ratios]
                columns = [batch.column("word"), *(batch.column(f"a{i}") for i in range(len(SETS))), *map(pa.array, values)]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "a0", "a1", "a2", *known])

        doubles = ", ".join(f"{n} double" for n in known)
        rated = materialise(full.mapInArrow(word_ratios, f"word string, a0 bigint, a1 bigint, a2 bigint, {doubles}"), "words")

        def pair_ratios(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t, first, of = (_matrix(batch, n) for n in (CELLS, known[:6], known[6:12]))
                after, second = _matrix(batch, ["a0", "a1", "a2"]), _matrix(batch, known[12:])
                out = []
                for i, s in enumerate(SETS):
                    two = slice(2 * i, 2 * i + 2)
                    own = _ratio(_of_pairs(_classes(t[:, 4:], s), first[:, two], after[:, i], of[:, two]))
                    out.append(pa.array(second[:, i] + (own - second[:, i]) * _told(t[:, :4], numbers, s)))
                yield pa.RecordBatch.from_arrays([batch.column("first"), batch.column("second"), *out], names=["first", "second", *known[12:]])

        firsts = rated.select(F.col("word").alias("first"), "a0", "a1", "a2", *known[:6]).hint("merge")
        seconds = rated.select(F.col("word").alias("second"), *known[6:]).hint("merge")
        strong = pairs.where(_strength(numbers) >= EVIDENCE).join(firsts, "first").join(seconds, "second")
        strong = strong.mapInArrow(pair_ratios, "first string, second string, r0 double, r1 double, r2 double")
        return Tables(rated.select("word", "r0", "r1", "r2"), materialise(strong, "pairs"))

    def features(self, texts: DataFrame) -> DataFrame:
        """``tag``, ``whole``, ``one``, ``two`` of each ``body``, by the set ``part``; ``tag`` tells the texts apart."""
        tokens = texts.select("tag", "part", "body").mapInArrow(_tokens, "tag bigint, part int, first string, second string, n bigint")

        def ratio(side: str) -> Column:
            return F.element_at(F.array(*[F.col(f"{side}.r{i}") for i in range(len(SETS))]), F.col("part") + 1)

        p, w = self.pairs.hint("merge").alias("p"), self.words.hint("merge").alias("w")
        same = (F.col("t.first") == F.col("p.first")) & (F.col("t.second") == F.col("p.second"))
        found = tokens.alias("t").join(p, same, "left").select("t.*", ratio("p").alias("of_pair")).alias("t")
        found = found.join(w, F.col("t.second") == F.col("w.word"), "left")
        found = found.select("tag", "n", F.coalesce("of_pair", ratio("w"), F.lit(0.0)).alias("r"))
        most = F.flatten(F.collect_list(F.array_repeat("r", F.least("n", F.lit(2)).cast("int"))))  # no more than the text's words
        per = found.groupBy("tag").agg(F.sum(F.col("n") * F.col("r")).alias("sum"), F.sum("n").alias("n"), F.slice(F.sort_array(most, False), 1, 2).alias("best"))
        one, two = F.get("best", F.lit(0)), F.get("best", F.lit(1))
        named = {"whole": F.col("sum") / F.nullif(F.col("n"), F.lit(0)), "one": one, "two": (one + F.coalesce(two, one)) / 2}
        return per.select("tag", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in named.items()])

    def scored(self, docs: DataFrame, text: str, name: str) -> DataFrame:
        """``docs`` with the score of each row as ``name``."""
        tagged, tag = with_row_tag(docs, "toxic-rows")
        x = self.features(tagged.select(col(tag).alias("tag"), F.lit(0).alias("part"), text_of(text).alias("body")))
        z = sum((F.col(c) * w for c, w in zip(("whole", "one", "two"), self.weights)), F.lit(self.weights[-1]))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
        return tagged.join(x.select(F.col("tag").alias(tag), p.alias(name)), tag).drop(tag)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | Tables:
    """The model from labelled rows that are not held out. Rows without a label or an id are left out; of repeated
    labels the highest holds. With labels of one kind only (or none), every score is that label (or 0)."""
    spark = docs.sparkSession
    train = labels.where(col(label).isNotNull() & col(id).isNotNull() & ~held_out(id))
    train = train.groupBy(col(id).alias("id")).agg(F.max(col(label).cast("int")).alias("y"))
    there = {r[0]: r[1] for r in train.groupBy("y").count().collect()}
    if not there.get(0) or not there.get(1):
        return Model({}, None, (float(bool(there.get(1))),))
    cell = (F.col("y") * 2 + F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2))).cast("int").alias("cell")
    train = materialise(train.select("id", cell), "labels")
    numbers = {r[0]: r[1] for r in train.groupBy("cell").count().collect()}
    numbers = np.array([numbers.get(k, 0) for k in range(4)], np.float64)
    bodies = docs.select(col(id).alias("id"), text_of(text).alias("body"))
    every = bodies.join(side(train, 32), "id").select("cell", "body")

    sums = [F.sum(c).alias(c) for c in CELLS]
    longs = ", ".join(f"{c} bigint" for c in CELLS)
    words = materialise(every.mapInArrow(_word_counts, f"word string, {longs}").groupBy("word").agg(*sums), "words")
    strength, in_texts = _strength(numbers), sum((F.col(f"d{k}") for k in (1, 2, 3)), F.col("d0"))
    words = words.where(in_texts > 1)
    if words.count() > MOST_WORDS:
        return _fitted_tables(bodies, train, Tables.of(every, words, numbers))
    numbered = Numbers.of(words.select("word", _digest(F.col("word")).alias("digest")).toArrow())  # bounded: MOST_WORDS
    size, sent = len(numbered), spark.sparkContext.broadcast(numbered.dump())

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = per_worker("toxic-words", sent.value, Numbers.load)
        for cells, block in _texts(batches):
            met: dict[str, int] = {}
            ids = [np.fromiter((met.setdefault(w, len(met)) for w in words_of(t)), np.int64) for t in block]
            at = numbers.find(list(met))
            keys, owners = [], []
            for i, x in enumerate(ids):
                x = at[x]
                k = (x[:-1] * size + x[1:])[(x[:-1] >= 0) & (x[1:] >= 0)]
                keys.append(k)
                owners.append(np.full(len(k), i))
            once, places = np.unique(np.concatenate(keys), return_inverse=True)
            yield _table("pair", pa.array(once), places, np.concatenate(owners), cells)

    pairs = materialise(every.mapInArrow(pair_counts, f"pair bigint, {longs}").groupBy("pair").agg(*sums), "pairs")

    strong = pairs.where(strength >= EVIDENCE)  # the others say what their second word says
    if strong.count() > MOST_PAIRS:
        return _fitted_tables(bodies, train, Tables.of(every, words, numbers))

    kept = strong.toArrow()  # bounded: MOST_PAIRS
    order = np.argsort(kept.column("pair").to_numpy())
    keys, of_pairs = kept.column("pair").to_numpy()[order], np.stack([kept.column(c).to_numpy().astype(np.float64)[order] for c in CELLS], -1)
    del kept
    first, second = keys // max(size, 1), keys % max(size, 1)
    told = words.where(strength > EVIDENCE * (1 - 1e-9))
    if told.count() > MOST_TOLD:
        return _fitted_tables(bodies, train, Tables.of(every, words, numbers))
    told = numbered.find(told.select("word").toArrow().column("word").to_pylist())
    used = np.unique(np.concatenate([told, first, second]))  # every other word weighs nothing, alone and in pairs
    if len(used) > MOST_TOLD:
        return _fitted_tables(bodies, train, Tables.of(every, words, numbers))
    names = numbered.names.take(pa.array(used))

    def of_used(rows: DataFrame, key: str, values: list[str], keys: pa.Array) -> np.ndarray:
        """The values of the used words, in their order: 0 where there is no row."""
        chosen = spark.createDataFrame(pa.table({key: keys, "place": np.arange(len(keys), dtype=np.int64)})) if len(keys) else None
        out = np.zeros((len(keys), len(values)))
        if chosen is not None:
            found = rows.join(F.broadcast(chosen), key).select("place", *values).toArrow()  # bounded: MOST_TOLD
            out[found.column("place").to_numpy()] = np.stack([found.column(c).to_numpy() for c in values], -1)
        return out

    of_words = of_used(words, "word", CELLS, names)
    number, sides = F.lit(max(size, 1)).cast("bigint"), []
    for at in (F.col("pair") % number, F.floor((F.col("pair") - F.col("pair") % number) / number).cast("bigint")):
        sides.append(of_used(_neighbours(pairs.withColumn("at", at), "at", "n"), "word", ["n0", "n1", "n2"], pa.array(used, pa.int64())))
    continued, followers = sides
    cells = [F.col(f"c{k}") for k in range(4)]
    sums = words.agg(*[c.alias(f"{i}{k}") for i, h in enumerate(SETS) for k, c in enumerate(_class_sums(cells, h))]).first()
    sums = np.array([float(v or 0) for v in sums]).reshape(len(SETS), 3)
    places = [float(v) + size for v in pairs.agg(*_in_sets()).first()]
    vocabulary = {w: i for i, w in enumerate(names.to_pylist())}
    one, two = np.searchsorted(used, first), np.searchsorted(used, second)
    used_keys = one * len(used) + two

    def ratios(halves: tuple[int, ...]) -> Ratios:
        n = SETS.index(halves)
        counts, told = _classes(of_words[:, 4:], halves), [_told(t[:, :4], numbers, halves) for t in (of_words, of_pairs)]
        of_word = _of_words(counts, continued[:, n], sums[n, :2], sums[n, 2], places[n])
        own = _ratio(_of_pairs(_classes(of_pairs[:, 4:], halves), counts[one], followers[one, n], of_word[two]))
        words = _ratio(of_word) * told[0]
        return Ratios(words, used_keys, words[two] + (own - words[two]) * told[1])

    plain = spark.sparkContext.broadcast(Model(vocabulary, None, (0.0,)).dump())
    halves = spark.sparkContext.broadcast([Model({}, ratios(h), (0.0,)).dump() for h in ((1,), (0,))])

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = per_worker("toxic-model", plain.value, Model.load)
        others = [Model.load(h).ratios for h in halves.value]
        for batch in batches:
            cells = batch.column(0).to_pylist()
            x = [others[c % 2].features(model.ids(t)) for c, t in zip(cells, batch.column(1).to_pylist())]
            columns = [pa.array([c // 2 for c in cells], pa.int32())] + [pa.array([v[k] for v in x], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "whole", "one", "two"])

    table = every.mapInArrow(cross, "y int, whole double, one double, two double")
    return Model(vocabulary, ratios((0, 1)), _curve(materialise(table, "features")))


def _curve(rows: DataFrame) -> tuple[float, ...]:
    """The weights of a written table of ``y`` and features: all of its rows, on the driver if they are few."""
    x = ["whole", "one", "two"]
    there = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    if there.get(0, 0) > MOST_ORDINARY or there.get(1, 0) > MOST_TOXIC:
        return tuple(map(float, _logistic_over(rows, x, "y")))
    table = rows.toPandas()  # bounded: MOST_ORDINARY and MOST_TOXIC
    return tuple(map(float, _logistic(table[x].to_numpy(), table["y"].to_numpy(np.float64))))


def _fitted_tables(bodies: DataFrame, train: DataFrame, model: Tables) -> Tables:
    """The model in tables with its curve; each training row is scored by the half that it is not in."""
    rows, tag = with_row_tag(bodies.join(side(train, 32), "id").select("cell", "body"), "labelled-texts")
    rows = rows.withColumnRenamed(tag, "tag").withColumn("part", 2 - F.col("cell") % 2)
    found = model.features(rows).join(rows.select("tag", (F.col("cell") / 2).cast("int").alias("y")).hint("merge"), "tag")
    return replace(model, weights=_curve(materialise(found.drop("tag"), "features")))


def scorer(docs: DataFrame, model: Model):
    """The column function that scores texts without nulls."""
    sent = docs.sparkSession.sparkContext.broadcast(model.dump())

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = per_worker("toxic-model", sent.value, Model.load)
        for batch in batches:
            out: list[float] = []
            for _, block in blocks(batch.to_pylist()):
                out += [model.score(t) for t in block]
            yield pa.array(out, pa.float64())

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on) of each row's whole text.

    Null text is empty and gets the score of no evidence. Repeated rows give repeated rows; rows with a null
    id count as not held out and are never learned from. Other columns are left out, and no score uses any.
    """
    model = fit(docs, labels, id, text)
    if isinstance(model, Tables):
        rows = docs.select(col(id).alias("id"), col(text).alias("body"))
        scored = model.scored(rows, "body", "score").select(F.col("id").alias(id), held_out("id").alias("held_out"), "score")
    else:
        scored = docs.select(col(id).alias(id), held_out(id).alias("held_out"), scorer(docs, model)(text_of(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with its own columns."""
    model = fit(docs, labels, id, text)
    if isinstance(model, Tables):
        name = free_name(docs, "score")
        return model.scored(docs, text, name).where(col(name) < THRESHOLD).select(*map(col, docs.columns))
    return docs.where(scorer(docs, model)(text_of(text)) < THRESHOLD)
