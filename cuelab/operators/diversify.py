"""Seeded replacement of stock phrases, so that they do not give a cue away."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelab.fixed_values import (
    AUTHORITY_FIND_PHRASES,
    AUTHORITY_NEW_PHRASES,
    AUTHORITY_SOURCES,
    FRAMING_OPTIONS,
    HERDING_FINDS,
    HERDING_OPTIONS,
    OVERCONFIDENCE_FINDS,
    OVERCONFIDENCE_OPTIONS,
    REPLACE_PROBABILITY,
)
from cuelab.functions.text import keyed_draw


@dataclass(frozen=True)
class Step:
    """Phrases to look for, in order, each with the options that may take its place."""

    name: str
    finds: tuple[str, ...]
    options: tuple[tuple[str, ...], ...]


def step(name: str, finds: Sequence[str], options: Sequence[str]) -> Step:
    """A step whose finds share one list of options."""
    return Step(name, tuple(finds), (tuple(options),) * len(finds))


AUTHORITY = step(
    "authority",
    [f"{phrase} {source}" for source in AUTHORITY_SOURCES for phrase in AUTHORITY_FIND_PHRASES],
    [f"{phrase} {source}" for phrase in AUTHORITY_NEW_PHRASES for source in AUTHORITY_SOURCES],
)
HERDING = step("herding", HERDING_FINDS, HERDING_OPTIONS)
OVERCONFIDENCE = step("overconfidence", OVERCONFIDENCE_FINDS, OVERCONFIDENCE_OPTIONS)
FRAMING = Step("framing", tuple(FRAMING_OPTIONS), tuple(tuple(o) for o in FRAMING_OPTIONS.values()))

ALL_STEPS = (AUTHORITY, HERDING, OVERCONFIDENCE, FRAMING)


# Letters beyond ASCII that are ASCII in lower case, and all that a pattern without regard to case takes for ASCII.
_LOWER_IS_ASCII = {"\u212a".encode(): b"k", "\u0130".encode(): "i\u0307".encode()}
_LIKE_ASCII = [*_LOWER_IS_ASCII, "\u0131".encode(), "\u017f".encode()]


class _Finder:
    """The finds of a step in UTF-8 texts.

    Neighbours in the list with the same last word are looked for only where that word occurs:
    for the 88 authority phrases a text without any of the institutions takes 11 scans. ASCII finds are looked for
    among bytes; with others the text becomes a Python text.
    """

    def __init__(self, finds: Sequence[str]) -> None:
        self.finds = finds
        self.low = [f.lower().encode() for f in finds]
        self.ascii = all(f.isascii() for f in finds)
        places = groupby(range(len(finds)), key=lambda i: self.low[i].rpartition(b" ")[2])
        self.groups = [(word, list(group)) for word, group in places]

    def lower(self, text: bytes) -> bytes:
        if not self.ascii:
            return text.decode(errors="replace").lower().encode()
        low = text.lower()
        if not low.isascii():
            for letter, plain in _LOWER_IS_ASCII.items():
                low = low.replace(letter, plain)
        return low

    def first(self, low: bytes) -> int | None:
        """Position in the list of the first find that occurs in a lower-case text."""
        for word, group in self.groups:
            if word in low:
                for i in group:
                    if self.low[i] in low:
                        return i
        return None

    def replaced(self, text: bytes, i: int, option: str) -> bytes:
        """The text with the first occurrence of a find replaced; case is ignored."""
        if text.isascii() or self.ascii and not any(letter in text for letter in _LIKE_ASCII):
            head, found, tail = text.lower().partition(self.low[i])
            return text[: len(head)] + option.encode() + text[len(head) + len(found) :]
        whole = text.decode(errors="replace")
        return re.sub(re.escape(self.finds[i]), lambda _: option, whole, count=1, flags=re.IGNORECASE).encode()


def _replacer(steps: Sequence[Step]) -> Callable[..., pa.Array]:
    """From texts and, for each step, the draws of the rows that take it: the texts that change, else NULL."""

    def replace(texts: pa.Array, *draws: pa.Array) -> pa.Array:
        finders = [_Finder(s.finds) for s in steps]
        out = []
        for text, *drawn in zip(texts.cast(pa.binary()), *(d.to_pylist() for d in draws)):
            old = new = text.as_py()
            lows: dict[bool, bytes] = {}  # made when a step needs it, and again only when the text has changed
            for s, finder, draw in zip(steps, finders, drawn):
                if draw is None or new is None:
                    continue
                low = lows.get(finder.ascii)
                if low is None:
                    low = lows[finder.ascii] = finder.lower(new)
                which = finder.first(low)
                if which is not None:
                    options = s.options[which]
                    new = finder.replaced(new, which, options[draw % len(options)])
                    lows = {}
            out.append(None if new is old else new)
        return pa.array(out, pa.binary()).view(pa.string())

    return replace


def diversify(
    df: DataFrame,
    steps: Sequence[Step] = ALL_STEPS,
    *,
    text_col: str = "biased_sentence",
    key_col: str = "example_id",
    probability: float = REPLACE_PROBABILITY,
    seed: int = 42,
) -> DataFrame:
    """Apply the steps one after the other to every row.

    In each step, with the given probability, the first find *of the list* that occurs in the
    text has its first occurrence replaced by a random option of its own; case is ignored. The
    draws depend on the key, the seed and the step, not on the order of rows. A map-only
    operation without a shuffle. Texts go through Python once for all steps: its search among bytes
    jumps, where the JVM takes a slow pass over a text for each find and for each lower case.
    """
    if not steps or probability <= 0:
        return df
    draws = []
    for s in steps:
        drawn = keyed_draw(F.col(key_col), seed, s.name) <= int(probability * 2**32)
        draws.append(F.when(drawn, keyed_draw(F.col(key_col), seed, s.name, part=1)))
    text = F.col(text_col)
    # Texts that no step was drawn for are not sent to Python, and those that stay are not sent back.
    changed = F.arrow_udf(_replacer(steps), "string")(F.when(F.coalesce(*draws).isNotNull(), text), *draws)
    return df.withColumn(text_col, F.coalesce(changed, text))
