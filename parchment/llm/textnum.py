"""Words of many texts as arrays of 64-bit hashes, computed by numpy a block of bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Classes of bytes: 0 parts words, 1 belongs to a word, 2 to a run of signs. Bytes over 0x7F belong to words.
WORDS = np.zeros(256, np.uint8)
WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
WORDS_AND_SIGNS = WORDS.copy()
WORDS_AND_SIGNS[[c for c in range(0x21, 0x7F) if not WORDS[c]]] = 2


def tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As np.unique gives them of keys of 0 and more: each once in order, where it is first, the number of each key, and counts.

    Keys and places are sorted as one number, which takes a fraction of an argsort. Low bits of the key that have no room
    there are looked at afterwards, and if they are out of order, keys are sorted the usual way.
    """
    n = len(keys)
    place = np.uint64(max(n - 1, 0).bit_length())
    drop = np.uint64(max(0, int(keys.max()).bit_length() + int(place) - 64) if n else 0)
    both = keys.astype(np.uint64)
    both >>= drop
    both <<= place
    both |= np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << int(place)) - 1)).astype(np.int32 if n < 1 << 31 else np.int64)
    there = keys[order] if drop else (both >> place).astype(keys.dtype)
    del both
    if drop and (there[1:] < there[:-1]).any():
        order = np.argsort(keys, kind="stable")
        there = keys[order]
    new = np.ones(n, bool)
    np.not_equal(there[1:], there[:-1], out=new[1:])
    number = np.empty(n, order.dtype)
    number[order] = np.cumsum(new, dtype=order.dtype) - 1
    begins = np.flatnonzero(new)
    return there[begins], order[begins], number, np.diff(begins, append=n)


def word_hashes(texts: list[bytes], classes: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the words of all texts, and for each text the index of its first word (one entry more at the end).

    For each length in prefixes also the indexes of the longer words and the hashes of so many first bytes of them.
    """
    block = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    kind = np.concatenate(([0], classes[block], [0])).astype(np.uint8)
    edges = np.flatnonzero(kind[1:] != kind[:-1])
    starts, ends = edges[:-1], edges[1:]
    real = kind[starts + 1] != 0 if len(edges) else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    power, inverse = tables(len(block) + 1)
    sums = np.zeros(len(block) + 1, np.uint64)
    np.cumsum((block.astype(np.uint64) + np.uint64(1)) * power[: len(block)], out=sums[1:])
    of = lambda s, e: mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
    firsts = [(w := np.flatnonzero(ends - starts > n), of(starts[w], starts[w] + n)) for n in prefixes]
    return of(starts, ends), np.searchsorted(starts, at), firsts


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about most bytes together; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
