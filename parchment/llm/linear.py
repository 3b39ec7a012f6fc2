"""Hashed word features of texts and logistic regression on them, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from parchment.llm.textnum import WORDS, WORDS_AND_SIGNS, blocks, mix, word_hashes

_NEXT, _SAME, _PREFIX = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Features:
    """Which features a text has: words and word pairs, each hashed to one of 2**bits indexes.

    A word that repeats the one before it also has the feature "same pair", whatever the word. prefixes adds the
    first so many bytes of longer words. signs makes runs of punctuation words of their own. fold ignores case.
    """

    bits: int = 18
    pairs: bool = True
    signs: bool = True
    fold: bool = False
    prefixes: tuple[int, ...] = ()

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Feature indexes of all texts one after another, and where each text begins (one entry more at the end)."""
        coded = [((t.lower() if self.fold else t) or "").encode("utf-8", "replace") if t else b"" for t in texts]
        hashes, first, begun = word_hashes(coded, WORDS_AND_SIGNS if self.signs else WORDS, self.prefixes)
        own = np.repeat(np.arange(len(texts)), np.diff(first))
        parts, owners = [hashes], [own]
        if self.pairs and len(hashes) > 1:
            inside = np.flatnonzero(own[1:] == own[:-1])
            a, b = hashes[inside], hashes[inside + 1]
            same = a == b
            parts += [mix(a * _NEXT + b), np.full(int(same.sum()), _SAME)]
            owners += [own[inside], own[inside][same]]
        for n, (words, h) in zip(self.prefixes, begun, strict=True):
            parts.append(mix(h + np.uint64(n * int(_PREFIX) % (1 << 64))))
            owners.append(own[words])
        index, owner = np.concatenate(parts) >> np.uint64(64 - self.bits), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return index[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(texts) + 1))

    def rows(self, texts: list[str | None]) -> SparseRows:
        """Sparse rows: distinct indexes and values; a value is the count over the root of the number of features."""
        out = SparseRows()
        for lo, hi in blocks([(t or "").encode("utf-8", "replace") for t in texts]):
            index, first = self.of(texts[lo:hi])
            for s, e in zip(first[:-1], first[1:], strict=True):
                at, n = np.unique(index[s:e], return_counts=True)
                out.add(at, n, float(np.sqrt(max(1, e - s))))
        return out


class SparseRows:
    """Rows of indexes and counts, one after another in two buffers of 32 bits a number; a row is worked out when it is asked for."""

    def __init__(self) -> None:
        self.at, self.n, self.ends, self.root = array("i"), array("i"), [0], []

    def add(self, at: np.ndarray, n: np.ndarray, root: float) -> None:
        self.at.frombytes(at.astype(np.int32).tobytes())
        self.n.frombytes(n.astype(np.int32).tobytes())
        self.ends.append(len(self.at))
        self.root.append(root)

    def __len__(self) -> int:
        return len(self.root)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        s, e = self.ends[i : i + 2]
        return np.array(self.at[s:e], np.int64), np.array(self.n[s:e], np.int64) / self.root[i]


class WithMore:
    """Rows with further features, whose indexes come after dim: a row of more for each."""

    def __init__(self, rows: SparseRows, more: np.ndarray, dim: int) -> None:
        self.rows, self.more, self.at = rows, more, dim + np.arange(more.shape[1])

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, x = self.rows[i]
        return np.append(at, self.at), np.append(x, self.more[i])


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader logistic regression over dim features and a bias, as the last index."""

    dim: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(self.dim + 1), np.zeros(self.dim + 1)

    def _weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, only: np.ndarray | None = None, seed: int = 7) -> np.ndarray:
        """Weights after some passes over the rows (of these numbers), each in another order; they are float32 and the last is the bias."""
        order, own = np.random.default_rng(seed), np.arange(len(rows)) if only is None else only
        for _ in range(self.epochs):
            for i in own[order.permutation(len(own))].tolist():
                at, x = rows[i]
                at, x = np.append(at, self.dim), np.append(x, 1.0)
                w = self._weights(at)
                g = (sigmoid(float(w @ x)) - labels[i]) * x
                more = self.n[at] + g * g
                self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
                self.n[at] = more
        return self._weights(slice(None)).astype(np.float32)


def margins(features: Features, weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Sparse dot products of the texts' features with the weights, plus the bias, a block of texts at a time."""
    out = np.full(len(texts), float(weights[-1]))
    for lo, hi in blocks([(t or "").encode("utf-8", "replace") for t in texts]):
        index, first = features.of(texts[lo:hi])
        sums = np.concatenate(([0.0], np.cumsum(weights[index], dtype=np.float64)))
        n = np.diff(first)
        out[lo:hi] += (sums[first[1:]] - sums[first[:-1]]) / np.sqrt(np.maximum(1, n))
    return out
