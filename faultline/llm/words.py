"""Words of many texts at once, as 64-bit hashes in numpy arrays.

Texts are laid end to end as UTF-8 bytes; a word's hash is the difference of two prefix sums
of table values times powers of an odd number, mixed with the word's length. No Python object
is made for a word, and memory stays near a hundred bytes for each byte of a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

U = np.uint64
CHUNK = 1 << 19
SPACES = b" \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15
_rows = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _rows.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    hashes: np.ndarray  #: a hash for each word, in order
    text: np.ndarray  #: number of the text that has the word
    start: np.ndarray  #: first byte in ``data``
    end: np.ndarray  #: byte behind the last
    data: np.ndarray  #: the bytes of all texts, each followed by a line feed
    begin: np.ndarray  #: where each text begins in ``data``, and the end of ``data``


def is_word(separators: bytes = SPACES) -> np.ndarray:
    out = np.ones(256, dtype=bool)
    out[list(separators)] = False
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    return mix(a * U(0xD6E8FEB86659FD93) + b)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=U), np.full(size, pow(_BASE, -1, 2**64), dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers; those of ordinary chunks are kept, those of very long texts are not."""
    return _powers(2 * CHUNK) if n <= 2 * CHUNK else _powers.__wrapped__(n)


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the number of the first; a longer text is a run of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) + 1 > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return data, begin


def spans_of(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of each run of true values; the last value must be false."""
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_VALUES[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def split(texts: list[bytes], word: np.ndarray, lower: bool = True) -> Words:
    """Words of a chunk of texts; ``word`` says of each byte whether it belongs to a word."""
    data, begin = laid_out(texts)
    if lower:
        data = LOWER[data]
    start, end = spans_of(word[data])
    return Words(hashes_of(data, start, end), np.searchsorted(begin, start, side="right") - 1, start, end, data, begin)


def encoded(values: list) -> list[bytes]:
    """UTF-8 bytes of strings; null is empty."""
    return [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in values]


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every ``n``-word shingle; a text of fewer words, but not none, is one shingle."""
    h, t = w.hashes, w.text
    count = np.bincount(t, minlength=len(w.begin) - 1)
    if n == 1 or not len(h):
        return h, t
    m = max(0, len(h) - n + 1)
    roll = h[:m]
    for k in range(1, n):
        roll = pair(roll, h[k : m + k])
    whole = t[:m] == t[n - 1 : n - 1 + m]
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return roll[whole], t[:m][whole]
    first = np.searchsorted(t, short)
    own = h[first]
    for k in range(1, n - 1):
        has = count[short] > k
        own = np.where(has, pair(own, h[np.minimum(first + k, len(h) - 1)]), own)
    own = mix(own + count[short].astype(U))
    out, of = np.concatenate([roll[whole], own]), np.concatenate([t[:m][whole], short])
    order = np.argsort(of, kind="stable")
    return out[order], of[order]
