"""Column expressions on plain text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelab.fixed_values import MISSING_TOKENS, NON_PRINTABLE, WHITESPACE_RANGES


def sql_text(word: str | None) -> str:
    """A literal in an SQL expression. Constant tables are written as one expression: built column by column they cost
    the driver thousands of calls."""
    if word is None:
        return "CAST(NULL AS STRING)"
    plain = word.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0")
    return f"'{plain}'"


def text_array(words: Sequence[str]) -> Column:
    """A constant array of texts."""
    return F.expr(f"array({', '.join(map(sql_text, words))})")


_WHITESPACE = "".join(chr(c) for a, b in WHITESPACE_RANGES for c in range(a, b + 1))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends (``F.trim`` alone removes blanks only)."""
    return F.btrim(text, F.lit(_WHITESPACE))


# Plain characters are told by the first range alone, before the long class is looked at.
_NON_PRINTABLE = rf"[\x{{00}}-\x{{1F}}\x{{7F}}-\x{{10FFFF}}&&{NON_PRINTABLE}]"


def strip_nonprintable(text: Column) -> Column:
    """Delete control, format and private-use characters and every space but U+0020."""
    return F.regexp_replace(text, _NON_PRINTABLE, "")


def clean_response(text: Column, stop: Sequence[str] = ()) -> Column:
    """Strip a model response, then delete each stop string in order (no second strip)."""
    out = strip(text)
    for word in stop:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def missing_to_null(text: Column) -> Column:
    """NULL for the cells a pandas CSV scan reads as missing; ``none`` in lower case stays."""
    return F.when(~text.isin(MISSING_TOKENS), text)


def keyed_draw(key: Column, seed: int | str, purpose: str, part: int = 0) -> Column:
    """A uniform integer in [0, 2^32) that depends on the key, seed and purpose only.

    One md5 gives four independent draws (``part`` 0..3), so a row's draws do not change
    with partitioning, retries or the order of rows.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|{purpose}|"), key.cast("string")))
    return F.conv(F.substring(digest, 8 * part + 1, 8), 16, 10).cast("bigint")


def shuffle_key(key: Column, seed: int | str) -> Column:
    """Sort key of a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def text_key(text: Column) -> Column:
    """A key that is equal where texts are equal. Long texts are grouped, joined and shuffled by this digest, so
    that a text itself only travels where the result holds it: the first 128 bits of SHA-256 in 24 characters."""
    return F.base64(first_bits(F.sha2(text, 256)))


def first_bits(digest: Column) -> Column:
    """The first 128 bits of a digest in hexadecimal digits, as 16 bytes: those of 10^12 texts differ but for a chance of 10^-14."""
    return F.unhex(F.left(digest, F.lit(32)))
