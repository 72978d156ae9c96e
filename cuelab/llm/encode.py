"""Token ids by the tokenizers library, each distinct stretch between spaces encoded once.

A byte-level pre-tokenizer starts a new piece at every space that stands before a non-space, so a
text can be cut there and the stretches encoded alone. Where a space stands between white space, or
between white space and the end, it is not cut. Stretches are cut further before the library gets
them (``_parts``), so that it sees each word once, not once with each mark that follows it. A text with a special token
goes to the library whole, and so do all texts of other kinds of tokenizers.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import blocks

_BEFORE_WORD = re.compile(r" (?=[^\s᠎])")


_TAIL = ".,;:!?%*$&#"


def _parts(before: str, stretch: str) -> tuple[str, ...]:
    """A stretch and the space before it, cut where any byte-level pre-tokenizer cuts too.

    That is around a line feed between two non-spaces, and between a letter or number and the marks at
    the end. Stretches that may hold a special token stay whole.
    """
    if "<" in stretch:
        return (before + stretch,)
    if "\n" not in stretch:
        return _marks(before, stretch)
    out, held = [], []
    for line in stretch.split("\n"):
        if held and line and held[-1] and not _white(held[-1][-1]) and not _white(line[0]):
            out += [*_marks("" if out else before, "\n".join(held)), "\n"]
            held = []
        held.append(line)
    return (*out, *_marks("" if out else before, "\n".join(held)))


def _white(char: str) -> bool:
    return char.isspace() or char == "᠎"


def _white_at(array: pa.StringArray, words: list[str], place: int, empty: bool) -> np.ndarray:
    """Which words have white space at their first (0) or last (-1) place; ``empty`` for the empty ones."""
    offsets = np.frombuffer(array.buffers()[1], "<i4")[array.offset : array.offset + len(words) + 1]
    out = np.full(len(words), empty)
    there = np.flatnonzero(np.diff(offsets))
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    edge = data[offsets[there] if place == 0 else offsets[there + 1] - 1]
    out[there] = False
    maybe = there[(edge <= 32) | (edge >= 128)]  # only these bytes may belong to white space
    out[maybe] = [_white(words[i][place]) for i in maybe.tolist()]
    return out


def _marks(before: str, line: str) -> tuple[str, ...]:
    word = line.rstrip(_TAIL)
    if len(word) < len(line) and word and word[-1].isascii() and word[-1].isalnum():
        return (before + word, line[len(word) :])
    return (before + line,)


class _Store(dict):
    """The ids of stretches. When full, those seen since the last time are kept as long again, the others go."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def missing(self, wanted: set[str]) -> set[str]:
        """What of ``wanted`` is not known."""
        new = wanted.difference(self)
        if self.old and new:
            again = [x for x in new if x in self.old]
            self.keep(again, [self.old[x] for x in again])
            new.difference_update(again)
        return new

    def keep(self, stretches: list[str], ids: list[bytes]) -> None:
        self.update(zip(stretches, ids))
        self.chars += sum(map(len, stretches))

    def age(self, most: int, most_chars: int) -> None:
        if len(self) > most or self.chars > most_chars:
            self.old = dict(self)
            self.clear()
            self.chars = 0


class Encoder:
    """``ids(texts)``: little-endian unsigned 32-bit ids of each text, without added special tokens."""

    #: Stretches kept for later blocks and tasks in each of the two stores, before those not seen again go.
    MOST_STRETCHES, MOST_CHARS = 500_000, 8 << 20
    #: Characters of a block: its distinct stretches are looked up in the stores once.
    BLOCK_CHARS = 4 << 20

    def __init__(self, data: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(data)
        before = spec.get("pre_tokenizer") or {}
        self.cut = (
            spec.get("normalizer") is None
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
            and not any(
                t.get("lstrip") or t.get("rstrip") or t.get("single_word") or " " in t["content"] or "<" not in t["content"]
                for t in spec.get("added_tokens", [])
            )
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        self.first, self.later = _Store(), _Store()  # by stretch: without a space before it, and after one

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 5000):
            for e in self.tokenizer.encode_batch_fast(texts[at : at + 5000], add_special_tokens=False):
                out.append(array("I", e.ids).tobytes())
        return out

    def _encode_lines(self, words: list[str], before: str) -> list[bytes]:
        """The ids of words without white space or ``<``: as lines of one text, since a line feed between such is one token."""
        out: list[bytes] = []
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([before + ("\n" + before).join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * np.flatnonzero(ids == self.feed)
            body = ids.tobytes()
            out += [body[a:b] for a, b in zip([0, *(ends + 4).tolist()], [*ends.tolist(), len(body)])]
        return out

    def _add(self, store: _Store, new: set[str], before: str) -> None:
        plain = [x for x in new if x.isprintable() and " " not in x and "<" not in x and x] if self.feed is not None else []
        store.keep(plain, self._encode_lines(plain, before))
        others = list(new.difference(plain))
        store.keep(others, self._encode([before + x for x in others]))

    def _learn(self, store: _Store, wanted: set[str], before: str) -> None:
        whole, cut = set(), {}
        for x in store.missing(wanted):
            parts = (x,) if x.isalnum() else _parts(before, x)
            if len(parts) == 1:
                whole.add(x)
            else:
                cut[x] = (parts[0][len(before) :], parts[1:])
        self._add(store, whole | store.missing({h for h, _ in cut.values()}.difference(whole)), before)
        self._add(self.first, self.first.missing({p for _, rest in cut.values() for p in rest}), "")
        known = self.first.__getitem__
        store.keep(list(cut), [store[h] + b"".join(map(known, rest)) for h, rest in cut.values()])

    def _stretched(self, lists: pa.ListArray, cut_at_spaces: bool) -> list[bytes | None]:
        """The ids of texts that are given as their stretches. With ``cut_at_spaces`` texts were cut at every space: None for
        those that must not be. Each distinct stretch is looked up once, the ids are gathered by its number."""
        offsets, flat = lists.offsets.to_numpy(), lists.values
        is_head = np.zeros(len(flat), bool)
        is_head[offsets[:-1]] = True
        heads = flat.take(lists.offsets[:-1]).dictionary_encode()
        rest = flat.filter(pa.array(~is_head)).dictionary_encode()
        firsts, laters = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (heads, rest))
        number = np.empty(len(flat), np.int32)
        number[is_head] = heads.indices.to_numpy()
        number[~is_head] = rest.indices.to_numpy() + np.int32(len(firsts))
        odd: list[int] = []
        if cut_at_spaces:  # a space with white space before it and, or the end, behind it; an empty stretch is next to a space or the end
            before = np.concatenate([_white_at(heads.dictionary, firsts, -1, False), _white_at(rest.dictionary, laters, -1, True)])
            behind = np.concatenate([np.zeros(len(firsts), bool), _white_at(rest.dictionary, laters, 0, True)])
            inside = np.flatnonzero(before[number[:-1]] & behind[number[1:]] & ~is_head[1:])
            odd = np.unique(np.searchsorted(offsets, inside, side="right") - 1).tolist()
        self._learn(self.first, set(firsts), "")
        self._learn(self.later, set(laters), " ")
        bodies = [*map(self.first.__getitem__, firsts), *map(self.later.__getitem__, laters)]
        table = np.frombuffer(b"".join(bodies), "<u4")
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies)) // 4
        starts = np.cumsum(sizes) - sizes
        size = sizes[number]
        ends = np.cumsum(size)
        at = np.repeat(starts[number] - (ends - size), size)
        at += np.arange(len(at))
        ids = table[at].tobytes()
        stops = (4 * ends[offsets[1:] - 1]).tolist()
        out: list[bytes | None] = [ids[a:b] for a, b in zip([0, *stops], stops)]
        for k in odd:
            out[k] = None
        return out

    def _block(self, texts: list[str]) -> list[bytes]:
        for store in (self.first, self.later):
            store.age(self.MOST_STRETCHES, self.MOST_CHARS)
        out = self._stretched(pc.split_pattern(pa.array(texts, pa.string()), " "), True)
        odd = [k for k, ids in enumerate(out) if ids is None]
        if odd:
            lists = pa.array([_BEFORE_WORD.split(texts[k]) for k in odd], pa.list_(pa.string()))
            for k, ids in zip(odd, self._stretched(lists, False)):
                out[k] = ids
        whole = [k for k, t in enumerate(texts) if "<" in t and any(s in t for s in self.special)]
        for k, ids in zip(whole, self._encode([texts[k] for k in whole])):
            out[k] = ids
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for _, block in blocks(texts, self.BLOCK_CHARS if self.cut else 1 << 21):
            out += self._block(block) if self.cut else self._encode(block)
        return out
