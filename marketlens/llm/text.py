"""Words of a text, as columns and inside tasks. A word is a run of anything but ASCII white space."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, x20 and x09 to x0D, for Java's regular expressions and for translate().
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
SPACE_CHARS = " \t\n\x0b\f\r"
WORD = "[^ \\t\\n\\x0B\\f\\r]+"

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: Column) -> Column:
    """The words of a text in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def n_words(text: Column) -> Column:
    """The number of words; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; ``bytes.split`` cuts at exactly the white space meant here."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lowered(text: str | None) -> list[bytes]:
    """As ``split``, with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def hashes(tokens: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words, from the hashes of the words; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = h[:m].copy()
    for j in range(1, n):
        out = out * MULTIPLIER + h[j : j + m]
    return mix(out)
