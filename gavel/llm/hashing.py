"""Hashes of words over byte arrays.

Words are runs of ASCII letters and digits and of bytes beyond ASCII, with A-Z lower-cased, or,
with ``BETWEEN_SPACES``, runs of anything but ``[\\x20\\x09-\\x0D]``. A slice of texts is hashed at a
time, by prefix sums of a polynomial, without a loop over words; a text longer than a slice is
worked through in pieces cut between words, so that per-byte arrays stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

RADIX = 0x9E3779B97F4A7C15 | 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BETWEEN_SPACES = np.ones(256, bool)
BETWEEN_SPACES[[*range(9, 14), 32]] = False
#: Bytes of one piece of a long text.
PIECE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """RADIX ** k and its inverse modulo 2 ** 64, for k below n."""
    both = []
    for base in (RADIX, pow(RADIX, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def pieces(data: np.ndarray, at: np.ndarray, inside: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """The texts at ``at`` as pieces of about ``size`` bytes cut between words: number of the first text, and offsets."""
    low, high = int(at[0]), int(at[-1])
    while True:
        end = min(high, low + size)
        if end < high:
            gaps = np.flatnonzero(~inside[data[low:end]])
            while not len(gaps) and end < high:  # one word fills the piece: it ends further on
                more = min(high, end + size)
                gaps = np.flatnonzero(~inside[data[end:more]]) + (end - low)
                end = more
            end = low + int(gaps[-1]) + 1 if len(gaps) and end < high else end
        first = int(np.searchsorted(at, low, "right")) - 1 if low > at[0] else 0
        last = int(np.searchsorted(at, end, "left")) if end < high else len(at) - 1
        yield first, np.clip(at[first : last + 1], low, end)
        if end >= high:
            return
        low = end


def word_bounds(data: np.ndarray, at: np.ndarray, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first byte and end of every word of the texts at ``at``, counted from the first text on."""
    low, high = int(at[0]), int(at[-1])
    inside = in_word[data[low:high]]
    fresh = np.zeros(len(inside) + 1, bool)
    fresh[at - low] = True  # a text's end is a word's end too
    first = np.flatnonzero(inside & (~np.r_[False, inside[:-1]] | fresh[:-1])) if len(inside) else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (~np.r_[inside[1:], False] | fresh[1:])) + 1 if len(inside) else np.zeros(0, np.int64)
    return np.searchsorted(at, first + low, "right") - 1, first, end


def word_hashes(data: np.ndarray, at: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None, in_word: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of every word of the texts at ``at``, in order: a polynomial over its bytes."""
    owner, (words,) = stem_hashes(data, at, (), tables, in_word)
    return owner, words


def stem_hashes(
    data: np.ndarray, at: np.ndarray, stems: tuple[int, ...], tables: tuple[np.ndarray, np.ndarray] | None = None, in_word: np.ndarray = IN_WORD
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Owner and hashes of every word: of the whole word, and of its first bytes for each size in ``stems``."""
    owners, found = [], []
    for text, own in pieces(data, at, in_word):
        owner, first, end = word_bounds(data, own, in_word)
        owners.append(owner + text)
        found.append(run_hashes_of(data[int(own[0]) : int(own[-1])], first, [end, *[np.minimum(end, first + n) for n in stems]], tables))
    return np.concatenate(owners), [np.concatenate(x) for x in zip(*found, strict=True)]


def run_hashes_of(part: np.ndarray, first: np.ndarray, ends: list[np.ndarray], tables: tuple[np.ndarray, np.ndarray] | None = None) -> list[np.ndarray]:
    """Hashes of runs of bytes, A-Z lower-cased, that begin at ``first``, for several ends each."""
    up, down = tables if tables is not None and len(tables[0]) > len(part) else powers(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((LOWER[part].astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
    before, turn = sums[first], down[first]
    return [mixed((sums[end] - before) * turn) for end in ends]


def run_hashes(part: np.ndarray, first: np.ndarray, end: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    return run_hashes_of(part, first, [end], tables)[0]
