"""Tests of randomness for short strings over a known alphabet.

Of each string: chi-squared of its symbols against equal frequencies, the number of runs in the lower and
upper half of the alphabet, and the correlation of neighbouring symbols. Each becomes a value that is near a
standard normal one if symbols are drawn evenly and on their own. The squares are added, so that the total distance says how
far from random a string is in any way; frequencies that are more even than random ones lower it.
"""

from __future__ import annotations

import numpy as np

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Encodings from the narrowest alphabet to the widest; a string has the first one that holds all its characters.
ENCODINGS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "lower": LOWER,
    "upper": UPPER,
    "base32": UPPER + "234567",
    "lower_digits": DIGITS + LOWER,
    "upper_digits": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "alphanumeric": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
NAMES = list(ENCODINGS)
#: Symbols of all encodings; byte classes for counts of neighbours.
SYMBOLS = DIGITS + UPPER + LOWER + "+/-_"
CLASS = np.full(256, -1, np.int16)
CLASS[[ord(c) for c in SYMBOLS]] = np.arange(len(SYMBOLS))
#: Place of each symbol class in each encoding, or -1.
PLACE = np.array([[alphabet.find(c) for c in SYMBOLS] for alphabet in ENCODINGS.values()], np.int16)
SIZE = np.array([len(a) for a in ENCODINGS.values()])
OTHER_CASE = 0.02


def encoding_of(classes: np.ndarray) -> int:
    """The narrowest encoding of a string of symbol classes, or -1."""
    fits = (PLACE[:, np.unique(classes)] >= 0).all(axis=1)
    return int(fits.argmax()) if fits.any() else -1


def distances(symbols: np.ndarray, k: int) -> np.ndarray:
    """How far each row of ``symbols`` (numbers under ``k``, all rows of one length) is from random: about 3 if it is random."""
    rows, n = symbols.shape
    if n < 4:
        return np.zeros(rows)
    counts = np.zeros((rows, k))
    np.add.at(counts, (np.repeat(np.arange(rows), n), symbols.ravel()), 1)
    chi = k / n * (counts**2).sum(axis=1) - n
    uniform = (chi - (k - 1)) / np.sqrt(2 * (k - 1) * (n - 1) / n)
    half = symbols >= (k + 1) // 2
    high = half.sum(axis=1).astype(float)
    both = 2 * high * (n - high)
    runs = 1 + (half[:, 1:] != half[:, :-1]).sum(axis=1)
    spread = both * (both - n) / (n * n * (n - 1.0))
    mixed = np.where(spread > 0, (runs - both / n - 1) / np.sqrt(np.maximum(spread, 1e-9)), -np.sqrt(n))
    x = symbols - symbols.mean(axis=1, keepdims=True)
    own = (x**2).sum(axis=1)
    lag = np.where(own > 0, (x * np.roll(x, -1, axis=1)).sum(axis=1) / np.maximum(own, 1e-9), 1.0)
    serial = (lag + 1 / (n - 1)) * (n - 1) * np.sqrt((n - 2)) / n
    return uniform * np.abs(uniform) + mixed**2 + serial**2


def softened(pairs: np.ndarray) -> np.ndarray:
    """Counts of neighbours with a share of those in the other case, and a trace of all.

    Capital letters follow each other as small ones do, also where a corpus has few of them.
    """
    fold = np.array([SYMBOLS.index(c.lower()) for c in SYMBOLS])
    joint = np.zeros_like(pairs)
    np.add.at(joint, (fold[:, None], fold[None, :]), pairs)
    return pairs + OTHER_CASE * joint[np.ix_(fold, fold)] + 1e-6 * (pairs.sum() + 1)


def ordinary(pairs: np.ndarray, encoding: int, n: int, draws: int, seed: int) -> np.ndarray:
    """Distances of ``draws`` strings of ``n`` symbols that follow one another as in ordinary text.

    ``pairs`` are softened counts of neighbours of symbol classes in the corpus; the chain moves within the encoding's symbols.
    """
    classes = np.flatnonzero(PLACE[encoding] >= 0)
    classes = classes[np.argsort(PLACE[encoding][classes])]
    counts = pairs[np.ix_(classes, classes)]
    step = np.cumsum(counts / counts.sum(axis=1, keepdims=True), axis=1)
    begin = np.cumsum(counts.sum(axis=1) / counts.sum())
    random = np.random.Generator(np.random.PCG64([seed, encoding, n])).random((n, draws))
    k = len(classes)
    out = np.empty((draws, n), np.int64)
    out[:, 0] = np.minimum(np.searchsorted(begin, random[0]), k - 1)
    for i in range(1, n):
        out[:, i] = np.minimum((step[out[:, i - 1]] < random[i][:, None]).sum(axis=1), k - 1)
    return distances(out, k)
