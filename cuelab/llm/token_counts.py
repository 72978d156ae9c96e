"""Token counts with the whole-token shortcut.

Which strings of the vocabulary encode alone as one token is proved once, with the library itself
(``whole_tokens``). A pre-token among them counts one without any merge; only the others are merged,
each distinct one once. Texts are cut at spaces first, which this kind of tokenizer drops, and each
distinct stretch is counted once.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, col, per_worker, text_of, vocabulary


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free one."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Stretches of these letters are split by ``regex``, which tests show to agree here with the library's
#: own splitting; others are split by the library, whose Unicode version may differ.
_PLAIN = re.compile("[\x00-\u024f]*\\Z")


class Counter:
    """Counts of tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them."""

    MOST_STRETCHES, MOST_CHARS = 400_000, 8 << 20

    def __init__(self, data: bytes, whole: frozenset[str] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(data)
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        before = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        kinds = [s["type"] for s in steps], [b["type"] for b in before]
        self.pattern = None
        if kinds == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and before[0]["invert"] and before[0]["behavior"] == "Removed":
            self.pattern = regex.compile(before[0]["pattern"]["Regex"])  # only what it matches is kept; it matches no white space
        special = [re.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = re.compile("|".join(special) or r"(?!)")
        self.letters = byte_letters()
        self.whole = whole if whole is not None else frozenset()
        self.merged: dict[str, int] = {}
        self.counts: dict[str, int] = {}
        self.chars = 0

    def spelled(self, piece: str) -> str:
        """The letters that stand for the bytes of a pre-token."""
        return piece if piece.isascii() and piece.isalnum() else "".join([self.letters[b] for b in piece.encode()])

    def merge(self, spelled: str) -> int:
        """Tokens of one pre-token, by the merges."""
        return len(self.tokenizer.model.tokenize(spelled))

    def stretch(self, text: str) -> int:
        if self.pattern is None or self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text = text.lower() if text.isascii() else self.tokenizer.normalizer.normalize_str(text)
        if _PLAIN.match(text):
            pieces = [self.spelled(x) for x in self.pattern.findall(text)]
        else:
            pieces = [x for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        n = 0
        for piece in pieces:
            if piece in self.whole:
                n += 1
                continue
            k = self.merged.get(piece)
            if k is None:
                k = self.merged[piece] = self.merge(piece)
                self.chars += len(piece)
            n += k
        return n

    def count(self, texts: list[str]) -> list[int]:
        if self.pattern is None:
            return [self.stretch(t) for t in texts]
        out: list[int] = []
        for _, block in blocks(texts):
            if len(self.counts) + len(self.merged) > self.MOST_STRETCHES or self.chars > self.MOST_CHARS:
                self.counts, self.merged, self.chars = {}, {}, 0
            parts = [t.split(" ") for t in block]
            for x in {x for p in parts for x in p}.difference(self.counts):
                self.counts[x] = self.stretch(x)
                self.chars += len(x)
            known = self.counts.__getitem__
            out += [sum(map(known, p)) for p in parts]
        return out


def whole_tokens(data: bytes) -> frozenset[str]:
    """Pre-tokens, spelled in byte letters, that encode alone as one token: each is proved with the library."""
    counter = Counter(data)
    if counter.pattern is None:
        return frozenset()
    back = {v: k for k, v in counter.letters.items()}
    end = json.loads(data)["model"].get("end_of_word_suffix") or ""
    out = set()
    for token in counter.tokenizer.get_vocab(with_added_tokens=False):
        word = token.removesuffix(end)
        if (end and word == token) or not all(c in back for c in word):
            continue
        try:
            text = bytes(back[c] for c in word).decode()
        except UnicodeDecodeError:
            continue
        if [x for x, _ in counter.tokenizer.pre_tokenizer.pre_tokenize_str(text)] == [word] and counter.merge(word) == 1:
            out.add(word)
    return frozenset(out)


def token_counts(docs: DataFrame, vocab: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each row's whole text, without special tokens added.

    One row for each row of ``docs``, repeated ones too; null text is empty (0, 0); null ids stay null; other
    columns are left out. No shuffle: a map over the texts. ``vocab`` is a tokenizers file; kinds without
    the proved shortcut are encoded by the library as a whole.
    """
    spark: SparkSession = docs.sparkSession
    data = vocabulary(spark, vocab)
    whole = spark.sparkContext.broadcast(whole_tokens(data.value))  # at most the vocabulary

    @F.arrow_udf("bigint")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = per_worker("counts", data.value, lambda d: Counter(d, whole.value))
        for batch in batches:
            yield pa.array(counter.count(batch.to_pylist()), pa.int64())

    body = text_of(text)
    return docs.select(col(id).alias(id), F.octet_length(body).cast("bigint").alias("n_bytes"), count(body).alias("n_tokens"))
