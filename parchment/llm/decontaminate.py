"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words scans each text once.

A window of 13 words always holds a whole one of the pieces of 7 words that its item is cut into. So the automaton has
the pieces, not the windows, and is about as large as the items. A text without any piece ends there. In the others, the hash
that rolls over each 13 words is looked up among those of all windows, and what is found is compared word by word. So a
text takes time in proportion to its words, however often they repeat in it or in an item.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column, inside, packed, unpacked, write_table
from parchment.llm.textnum import mix
from parchment.sources.scratch import scratch_path

#: Bytes that make words, after lower-casing A-Z: digits, letters, and all of other characters; the rest part words.
_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of an item in one segment at most; a longer item is several, which overlap by a window less one word.
SEGMENT_WORDS = 20_000


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TO_WORDS).split()


class Matcher:
    """An automaton over the pieces of items (id, words), and the different windows of each length with the items that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int) -> None:
        self.width, self.automaton = width, ahocorasick.Automaton()
        step = (width + 1) // 2
        for _, words in items:
            for at in range(0, len(words) - step + 1, step) if len(words) >= width else (0,):
                self.automaton.add_word(f" {b' '.join(words[at : at + step] if len(words) >= width else words).decode('latin-1')} ", True)
        if items:
            self.automaton.make_automaton()
        names = sorted({item for item, _ in items})
        self.names, of_name = np.array(names, object), {name: k for k, name in enumerate(names)}
        self.number: dict[bytes, int] = {}
        ids = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64) for _, words in items]
        self.words = np.concatenate([np.zeros(0, np.int64), *ids])
        starts = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        places: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (item, words) in enumerate(items):
            n = min(width, len(words))
            places.setdefault(n, []).append((np.arange(starts[k], starts[k] + len(words) - n + 1), of_name[item]))
        self.windows = {n: self._distinct(n, np.concatenate([p for p, _ in own]), np.repeat([i for _, i in own], [len(p) for p, _ in own])) for n, own in places.items()}

    def _rolled(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each n numbers that follow each other."""
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        mixed = mix(ids.astype(np.uint64))
        for k in range(n):
            out = out * _ROLL + mixed[k : k + len(out)]
        return mix(out)

    def _distinct(self, n: int, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes of the different windows of n words, where each stands, and the items that have it, one list after another."""
        hashes = self._rolled(self.words, n)[at]
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        group = np.cumsum(new) - 1
        if (self._at(at, n) != self._at(at[new][group], n)).any():
            raise RuntimeError("two windows have one hash of 64 bits")
        once = np.concatenate(([True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])))
        first = np.searchsorted(group[once], np.arange(group[-1] + 2))
        return hashes[new], at[new], first, item[once]

    def _at(self, at: np.ndarray, n: int) -> np.ndarray:
        return self.words[at[:, None] + np.arange(n)]

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Ranges of words that windows cover (first, and last not included), and the items that have these windows, in order."""
        if not words or not len(self.automaton) or next(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "), None) is None:
            return [], []
        ids = np.fromiter((self.number.get(w, 0) for w in words), np.int64, len(words))
        edges, items = np.zeros(len(words) + 1, np.int64), []
        for n, (hashes, at, first, item) in self.windows.items():
            rolled = self._rolled(ids, n)
            found = np.minimum(np.searchsorted(hashes, rolled), len(hashes) - 1)
            here = np.flatnonzero(hashes[found] == rolled)
            here = here[(ids[here[:, None] + np.arange(n)] == self._at(at[found[here]], n)).all(axis=1)]
            np.add.at(edges, here, 1)
            np.add.at(edges, here + n, -1)
            items += [item[first[g] : first[g + 1]] for g in np.unique(found[here])]
        change = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(edges)[:-1] > 0, [False]))))
        return list(zip(change[::2].tolist(), change[1::2].tolist(), strict=True)), self.names[np.unique(np.concatenate(items))].tolist() if items else []


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def in_text(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of code points of the original text."""
    if not ranges:
        return []
    raw = (text or "").encode("utf-8", "replace")
    place = [(m.start(), m.end()) for m in _WORD.finditer(raw.translate(_TO_WORDS))]
    return [(len(raw[: place[s][0]].decode()), len(raw[: place[e - 1][1]].decode())) for s, e in ranges]


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_HIT = "struct<n_words:bigint,words:array<struct<first:int,last:int>>,items:array<string>,chars:array<struct<first:int,last:int>>>"
_HIT_ARROW = pa.struct([("n_words", pa.int64()), ("words", _RANGE), ("items", pa.list_(pa.string())), ("chars", _RANGE)])
_matchers: dict[str, Matcher] = {}


def _hit(text: str | None, words: list[bytes], ranges: list[tuple[int, int]], items: list[str]) -> dict:
    pairs = lambda found: [{"first": a, "last": b} for a, b in found]
    return {"n_words": len(words), "words": pairs(ranges), "items": sorted(set(items)), "chars": pairs(in_text(text, ranges))}


def _scanner(block: Broadcast, width: int):
    name = uuid.uuid4().hex

    @F.arrow_udf(_HIT)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _matchers:  # built once in each Python worker; one at a time
            _matchers.clear()
            _matchers[name] = Matcher([(item, words.split()) for item, words in block.value], width)
        for texts in batches:
            out = []
            for text in texts.to_pylist():
                words = words_of(text)
                out.append(_hit(text, words, *_matchers[name].find(words)))
            yield pa.array(out, _HIT_ARROW)

    return scanned


def _put_together():
    @F.arrow_udf(_HIT)
    def together(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        """Of a text and the hits of all blocks on it, the hits as of one block."""
        for texts, found in batches:
            out = []
            for text, hits in zip(texts.to_pylist(), found.to_pylist(), strict=True):
                ranges = merged([(r["first"], r["last"]) for h in hits or [] for r in h["words"]])
                out.append(_hit(text, words_of(text), ranges, [i for h in hits or [] for i in h["items"]]))
            yield pa.array(out, _HIT_ARROW)

    return together


def segments(benchmark: DataFrame, item_col: str, text_col: str, width: int, most: int = SEGMENT_WORDS) -> DataFrame:
    """The items' words (item, words: joined by spaces, bytes) in segments, each once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            out = []
            for row in got.to_pylist():
                words = words_of(row["text"])
                out += [(str(row["item"]), b" ".join(words[at : at + most])) for at in range(0, max(1, len(words) - width + 1), most - width + 1) if words]
            items, texts = [i for i, _ in out], [w for _, w in out]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary()), pa.array([len(i) + len(w) for i, w in out], pa.int64())], ["item", "words", "bytes"])

    rows = benchmark.select(column(item_col).cast("string").alias("item"), column(text_col).alias("text"))
    return write_table(rows.mapInArrow(cut, "item string, words binary, bytes long").groupBy("item", "words").agg(F.first("bytes").alias("bytes")), "benchmark-words")


def deal(cut: DataFrame, block_bytes: int) -> tuple[Column, int]:
    """Which block a segment is in, and how many blocks there are: as many as it takes for none to be over twice block_bytes.

    Segments are different, so their hashes part them. Where single ones are larger than a block, four such may be one.
    """
    total, largest = cut.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    blocks = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item", "words"), F.lit(blocks)).cast("int")
        if blocks == 1 or (cut.groupBy(block.alias("block")).agg(F.sum("bytes").alias("n")).agg(F.max("n")).first()[0] <= max(2 * block_bytes, 4 * largest)):
            return block, blocks
        blocks *= 2


def find_contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", text_col: str = "text", width: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """docs with n_words, n_hit, items, spans and contaminated.

    Texts are lower-cased (A-Z) and cut into words of digits, letters and characters over U+007F. A window is width
    consecutive words of an item, or all words of an item of fewer. A word of a text inside any occurrence of a
    window is hit. items has the ids of the items that occur, as strings and sorted so; spans the hit ranges as code
    points of the original text, first included and last not. A text is contaminated if words are hit and they
    make up a twentieth of all or more. Null and empty texts have no words, and items without words no windows.
    A null item id is the item "None". Columns of docs with the new names are replaced; other names are free.

    The benchmark's words are broadcast in blocks of about block_bytes, of which deal() checks the size; the automaton and the windows take some 100 bytes for each. With one
    block, as of any usual benchmark, nothing is shuffled. With more, docs are written with a number for each row, each block is
    scanned for and its hits written before the next is read, and hits meet their rows by the number.
    """
    cut = segments(benchmark, item_col, item_text_col, width)
    block, blocks = deal(cut, block_bytes)
    new = ("n_words", "n_hit", "items", "spans", "contaminated")

    def scan(k: int) -> Column:
        held = cut.filter(block == k).select("item", "words").collect()
        return _scanner(docs.sparkSession.sparkContext.broadcast([(r["item"], bytes(r["words"])) for r in held]), width)(text)

    rows, text = docs.select(packed(docs, *new)), F.coalesce(inside(text_col), F.lit(""))
    if blocks == 1:
        met = rows.withColumn("hit", scan(0))
    else:
        rows = write_table(rows.withColumn("at", F.monotonically_increasing_id()), "texts")
        path = scratch_path(docs.sparkSession, "hits")
        for k in range(blocks):
            found = rows.select("at", scan(k).alias("hit")).filter(F.size("hit.items") > 0)
            found.write.mode("append").parquet(path)
        hits = docs.sparkSession.read.schema(found.schema).parquet(path)
        met = rows.join(hits.groupBy("at").agg(F.collect_list("hit").alias("hits")), "at", "left")
        met = met.withColumn("hit", _put_together()(text, F.col("hits")))
    n_hit = F.aggregate("hit.words", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    met = met.select("row", "hit", n_hit.alias("n_hit"))
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("hit.n_words"))
    return met.select(*unpacked(met), F.col("hit.n_words").alias("n_words"), "n_hit", F.col("hit.items").alias("items"), F.col("hit.chars").alias("spans"), dirty.alias("contaminated"))
