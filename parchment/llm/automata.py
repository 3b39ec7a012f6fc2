"""Weighted acyclic automata over sequences of words: transducers that give each prefix of what they hold its weight.

They are kept as arrays, and all but build() and compose() take the states of one depth in a step.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from parchment.llm.textnum import distinct, mix

#: Ends a sequence that is asked for; no word is empty, and it comes before all words.
END = b""


def compressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def decompressed(blob: bytes) -> bytes:
    return pa.decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(lengths, dtype=starts.dtype)
    out = np.repeat(starts - (ends - lengths.astype(starts.dtype)), lengths)
    out += np.arange(len(out), dtype=starts.dtype)
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.min_scalar_type(most) if most < 1 << 32 else np.int64)


def _array(data: bytes, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _parted(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of all words of an array, and their lengths."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return (words.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(words) and words.buffers()[2] else b""), np.diff(offsets)


@dataclass(frozen=True, eq=False)
class Transducer:
    """Arcs of each state: number of the word, weight, and the state that it leads to. State 0 has none.

    The arcs of state s are first[s] up to first[s + 1]. The weight of an arc is the sum of the weights of the sequences that go
    over it, so that of the last arc of a prefix is the weight of the prefix. data and lengths are those of the words, by number.
    """

    data: bytes
    lengths: np.ndarray
    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    to: np.ndarray
    root: int

    def packed(self) -> bytes:
        steps = np.diff(self.to, prepend=0)
        steps = steps.astype(np.int8 if len(steps) and -128 <= steps.min() and steps.max() < 128 else np.int64)
        return compressed(pickle.dumps((self.data, *map(_narrow, (self.lengths, np.diff(self.first), self.label, self.weight)), steps, self.root), 5))

    @classmethod
    def unpacked(cls, blob: bytes) -> Transducer:
        data, lengths, n, label, weight, steps, root = pickle.loads(decompressed(blob))
        kind = np.int32 if len(label) < 1 << 30 else np.int64
        return cls(data, lengths, np.concatenate(([0], np.cumsum(n)), dtype=kind), label, weight, np.cumsum(steps, dtype=kind), root)

    @cached_property
    def words(self) -> pa.Array:
        return _array(self.data, self.lengths)

    @cached_property
    def states(self) -> list[tuple[tuple[bytes, int, int], ...]]:
        words, first = self.words.to_pylist(), self.first.tolist()
        arcs = list(zip([words[k] for k in self.label.tolist()], self.weight.tolist(), self.to.tolist(), strict=True))
        return [tuple(arcs[a:b]) for a, b in zip(first, first[1:])]  # noqa: B905

    def paths(self) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
        """For each length the prefixes that have it, as columns of numbers of words, and their weights."""
        columns: list[np.ndarray] = []
        state, n = np.array([self.root]), np.diff(self.first)
        while n[state].sum():
            arcs, own = runs(self.first[state], n[state]), np.repeat(np.arange(len(state)), n[state])
            columns = [*(c[own] for c in columns), self.label[arcs]]
            yield columns, self.weight[arcs]
            state = self.to[arcs]

    def prefixes(self) -> Iterator[tuple[tuple[bytes, ...], int]]:
        """All prefixes in order, and their weights."""
        words = self.words.to_pylist()
        yield from sorted((tuple(words[k] for k in own), n) for columns, weights in self.paths() for *own, n in zip(*(c.tolist() for c in columns), weights.tolist(), strict=True))


class _States:
    def __init__(self) -> None:
        self.states: list[tuple] = [()]
        self.known: dict[tuple, int] = {(): 0}

    def of(self, arcs: tuple) -> int:
        found = self.known.get(arcs)
        if found is None:
            found = self.known[arcs] = len(self.states)
            self.states.append(arcs)
        return found


def build(sequences: Iterable[tuple[tuple[bytes, ...], int]]) -> Transducer:
    """The minimal automaton of sequences, which come in order, and their weights; equal ones are added up.

    It is built as they come: when a sequence leaves the path of the one before it, the states of that path below the fork
    can get no more arcs, and each becomes the known state with its arcs, or a new one.
    """
    states = _States()
    words: list[bytes] = []
    weights: list[int] = []
    arcs: list[list] = [[]]
    for sequence, weight in sequences:
        same = 0
        for a, b in zip(words, sequence):  # noqa: B905
            if a != b:
                break
            weights[same] += weight
            same += 1
        while len(words) > same:
            state = states.of(tuple(arcs.pop()))
            arcs[-1].append((words.pop(), weights.pop(), state))
        for word in sequence[same:]:
            words.append(word)
            weights.append(weight)
            arcs.append([])
    while words:
        state = states.of(tuple(arcs.pop()))
        arcs[-1].append((words.pop(), weights.pop(), state))
    root = states.of(tuple(arcs[0]))
    known = sorted({word for own in states.states for word, _, _ in own})
    number = {word: k for k, word in enumerate(known)}
    rows = np.array([(number[word], n, to) for own in states.states for word, n, to in own], np.int64).reshape(-1, 3)
    first = np.concatenate(([0], np.cumsum([len(own) for own in states.states])))
    return Transducer(b"".join(known), np.array([len(w) for w in known], np.int64), first, *rows.T, root)


def tree(data: bytes, lengths: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Transducer:
    """The automaton of levels, in which no states are shared: number of word, weight and number of arcs that follow, of the prefixes of each length in order."""
    label, weight, n = ([level[k] for level in levels] for k in range(3))
    size = sum(map(len, label))
    first = np.concatenate(([0, 0, len(label[0]) if label else 0], *n), dtype=np.int64)
    none = np.zeros(0, np.int64)
    return Transducer(data, lengths, np.cumsum(first), np.concatenate(label or [none]), np.concatenate(weight or [none]), np.arange(2, size + 2), 1)


def _shared(data: bytes, lengths: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Transducer:
    """The automaton of levels (parent, number of word, weight) with equal states as one.

    From the longest prefixes up, states whose arcs have one hash are neighbours in its order, and those equal to the neighbour become one with it.
    """
    none = np.zeros(0, np.int64)
    n_arcs, labels, weights, tos, known = [np.zeros(1, np.int64)], [none], [none], [none], 1
    to = np.zeros(len(levels[-1][0]) if levels else 1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        parent, label, weight = levels[depth]
        starts = np.flatnonzero(np.diff(parent, prepend=-1))
        n = np.diff(np.append(starts, len(parent)))
        hashes = np.add.reduceat(mix(mix(mix(label.astype(np.uint64)) + weight.astype(np.uint64)) + to.astype(np.uint64)), starts) + n.astype(np.uint64)
        order = np.argsort(hashes, kind="stable")
        a, b = order[:-1], order[1:]
        like = np.flatnonzero((hashes[a] == hashes[b]) & (n[a] == n[b]))
        x, y = runs(starts[a[like]], n[a[like]]), runs(starts[b[like]], n[b[like]])
        same = (label[x] == label[y]) & (weight[x] == weight[y]) & (to[x] == to[y])
        new = np.ones(len(order), bool)
        if len(like):
            new[1 + like] = ~np.logical_and.reduceat(same, np.cumsum(n[a[like]]) - n[a[like]])
        arcs = runs(starts[order[new]], n[order[new]])
        for into, own in ((n_arcs, n[order[new]]), (labels, label[arcs]), (weights, weight[arcs]), (tos, to[arcs])):
            into.append(own)
        above = np.zeros(len(levels[depth - 1][0]) if depth else 1, np.int64)
        above[parent[starts[order]]] = known + np.cumsum(new) - 1
        to, known = above, known + int(new.sum())
    first = np.concatenate(([0], np.cumsum(np.concatenate(n_arcs))))
    return Transducer(data, lengths, first, np.concatenate(labels), np.concatenate(weights), np.concatenate(tos), int(to[0]))


def union(parts: Iterable[Transducer], least: int = 0, share: bool = True) -> Transducer:
    """The automaton of the sequences of all parts, weights added up. Prefixes that weigh less than least go.

    All parts are walked at once: a prefix is the states that the parts have for it. Without share, equal states stay apart.
    """
    data, sizes, state, at_state, lists = [], [], [], 0, [[], [], [], []]
    for p in parts:
        data.append(p.data)
        sizes.append(p.lengths)
        state.append(at_state + p.root)
        for into, own in zip(lists, (_narrow(np.diff(p.first)), p.label, p.weight, p.to + at_state), strict=True):
            into.append(own)
        at_state += len(p.first) - 1
    words = _array(b"".join(data), np.concatenate(sizes).astype(np.int64)).dictionary_encode()
    at, number, bits = 0, words.indices.to_numpy(), np.int64(len(words.dictionary).bit_length())
    for k, own in enumerate(sizes):
        lists[1][k], at = number[at : at + len(own)][lists[1][k]], at + len(own)
    state, prefix, words = np.array(state), np.zeros(len(state), np.int32), words.dictionary
    del data, sizes, number
    # each list goes as its array comes, and the arcs of a state follow those of the state before
    to, weight, label, n_arcs = (np.concatenate(lists.pop()) for _ in range(4))
    first = np.cumsum(n_arcs, dtype=np.int32 if len(label) < 1 << 31 else np.int64) - n_arcs
    levels = []
    while (n := n_arcs[state]).any():
        arcs = runs(first[state], n)
        found, _, prefix, _ = distinct(np.repeat(prefix.astype(np.int64) << bits, n) | label[arcs])
        total = np.bincount(prefix, weight[arcs], len(found)).astype(np.int64)
        if len(few := np.flatnonzero(total < least)):
            stays = np.ones(len(found), bool)
            stays[few] = False
            on = stays[prefix]
            arcs, prefix = arcs[on], (np.cumsum(stays) - 1)[prefix[on]]
            found, total = found[stays], total[stays]
        if not len(found):
            break
        levels.append((found >> bits, found & (1 << bits) - 1, total))
        state = to[arcs]
    used, numbers = np.unique(np.concatenate([x for _, x, _ in levels] or [np.zeros(0, np.int64)]), return_inverse=True)
    own = np.split(numbers, np.cumsum([len(x) for _, x, _ in levels])[:-1])
    levels = [(parent, x, total) for (parent, _, total), x in zip(levels, own, strict=False)]
    data, lengths = _parted(words.take(pa.array(used)))
    if share:
        return _shared(data, lengths, levels)
    after = [*(np.bincount(below, minlength=len(x)) for (below, _, _), (_, x, _) in zip(levels[1:], levels, strict=False)), *(np.zeros(len(x), np.int64) for _, x, _ in levels[-1:])]
    return tree(data, lengths, [(x, total, n) for (_, x, total), n in zip(levels, after, strict=True)])


def compose(asked: Transducer, counts: Transducer) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """The sequences of asked that end with END, without it, and what they weigh in counts, which must hold them.

    Both automata are walked in step, so what sequences have in common is looked up once.
    """
    arcs: dict[int, dict] = {}
    todo: list[tuple[tuple[bytes, ...], int, int, int]] = [((), 0, asked.root, counts.root)]
    while todo:
        words, weight, a, c = todo.pop()
        if c not in arcs:
            arcs[c] = {word: (n, to) for word, n, to in counts.states[c]}
        for word, _, to in asked.states[a]:
            if word == END:
                yield words, weight
            elif word in arcs[c]:
                n, on = arcs[c][word]
                todo.append(((*words, word), n, to, on))
