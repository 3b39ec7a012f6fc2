"""Phrase collocation mining: counts of word sequences in weighted acyclic automata, and how strongly phrases hold together.

Texts are cut into pieces and words, and gathered in chunks, numbered and written. A chunk sends each word and each pair of neighbours, as a
48-bit hash with its count, to the buckets of the hashes; these add up and send back, as one bit each, which are frequent. No
phrase holds a word or pair that isn't, so at each position a chunk takes the frequent words that follow, up to the longest phrase,
while their pairs are frequent. A phrase occurs as often as it is a prefix of these sequences. A chunk sorts them by prefix range, the range of a
hash of the first two words, and builds a count transducer for each range. The transducers of a range are united, weights
added up. The parts that phrases are cut into are asked for by range as well: an automaton of them is composed with that of the counts.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm import automata
from parchment.llm.common import column, join_groups, shuffle_partitions, write_table
from parchment.llm.textnum import distinct, mix, tables

#: Bytes after lower-casing A-Z: what parts pieces is a line feed, what parts words a space.
_TO_PIECES = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in b".,;:!?" or 0x0A <= c <= 0x0D else 0x20 if c == 0x09 else c for c in range(256))
#: Words of a chunk, unless one text has more; and bytes whose words are found at once.
CHUNK_WORDS, BLOCK = 1 << 20, 1 << 20
_PAIR, _BITS = np.uint64(0xA24BAED4963EE407), 48
#: Words and pairs of a bucket, about.
_BUCKET_KEYS = 4 << 20
#: Words of a prefix range, about, and arcs that are united at once.
_RANGE_WORDS, _UNION_ARCS = 2 << 20, 3 << 20


def cut(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a block: begin, end, 64-bit hash, and whether the next word is in the same piece."""
    a = np.frombuffer(block, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate(([False], (a != 0x20) & (a != 0x0A), [False]))))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    piece = np.cumsum(a == 0x0A, dtype=np.int32)[starts] if len(a) else starts
    follows = np.zeros(len(starts), bool)
    follows[:-1] = piece[1:] == piece[:-1]
    return starts, ends, hashes, follows


class _Chunk:
    """The words of texts by language: numbers of words, and whether the next word follows in the same piece."""

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, ...]]] = {}
        self.blocks: list[bytes] = []
        self.n = self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        block = b"\n".join([*texts, b""]).translate(_TO_PIECES)
        starts, ends, hashes, follows = cut(block)
        self.parts.setdefault(lang, []).append((starts + self.size, ends - starts, hashes, follows))
        self.blocks.append(block)
        self.size += len(block)
        self.n += len(hashes)

    def row(self) -> tuple[list[str], list[int], bytes]:
        langs = sorted(self.parts)
        starts, lengths, hashes, follows = (np.concatenate([part[k] for lang in langs for part in self.parts[lang]]) for k in range(4))
        n = [sum(len(part[0]) for part in self.parts[lang]) for lang in langs]
        _, first, ids, _ = distinct(hashes)
        # each word with the byte after it, which parts words; then a line feed there
        lengths = lengths[first] + 1
        words = np.frombuffer(b"".join(self.blocks), np.uint8)[automata.runs(starts[first], lengths)]
        words[np.cumsum(lengths) - 1] = 0x0A
        return langs, n, automata.compressed(pickle.dumps((langs, n, ids.astype(np.int32), np.packbits(follows), words.tobytes()), 5))


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, waiting, size = _Chunk(), {}, {}

    def row() -> pa.RecordBatch:
        langs, n, blob = chunk.row()
        return pa.RecordBatch.from_arrays([pa.array([langs], pa.list_(pa.string())), pa.array([n], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["langs", "n_words", "blob"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            coded = text.encode("utf-8", "replace")
            waiting.setdefault(lang, []).append(coded)
            size[lang] = size.get(lang, 0) + len(coded)
            if size[lang] >= BLOCK:
                chunk.add(lang, waiting.pop(lang))
                del size[lang]
            if chunk.n >= CHUNK_WORDS:
                yield row()
                chunk = _Chunk()
    for lang, texts in waiting.items():
        chunk.add(lang, texts)
        if chunk.n >= CHUNK_WORDS:
            yield row()
            chunk = _Chunk()
    if chunk.n:
        yield row()


def _read(blob: bytes) -> tuple[list[str], list[np.ndarray], list[np.ndarray], bytes, np.ndarray]:
    langs, n, ids, follows, words = pickle.loads(automata.decompressed(blob))
    ends = np.cumsum(n)[:-1]
    return langs, np.split(ids, ends), np.split(np.unpackbits(follows, count=len(ids)).astype(bool), ends), words, cut(words)[2]


def _salt(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.sha256(lang.encode("utf-8", "replace")).digest()[:8], np.uint64)[0]


def _keys(lang: str, ids: np.ndarray, follows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the words of a language, and of the pairs of which the first is at a place that follows."""
    own = mix(hashes ^ _salt(lang))[ids]
    at = np.flatnonzero(follows)
    shift = np.uint64(64 - _BITS)
    return mix(own) >> shift, mix(own[at] * _PAIR + own[at + 1]) >> shift


def _bounds(buckets: int) -> np.ndarray:
    return np.array([(k << _BITS) // buckets for k in range(buckets + 1)], np.uint64)


def _all_keys(chunk: tuple) -> np.ndarray:
    """The hashes of a chunk as _read() gives it: of its words, and after these of its pairs."""
    langs, ids, follows, _, hashes = chunk
    own = [_keys(lang, i, f, hashes) for lang, i, f in zip(langs, ids, follows, strict=True)]
    return np.concatenate([k for both in zip(*own, strict=True) for k in both])


def _marks(chunks: DataFrame, buckets: int, least: int) -> DataFrame:
    """For each chunk and bucket, a bit for each of the chunk's hashes there: whether all chunks together have it least times."""
    kind = np.uint8 if least < 256 else np.uint32

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets)
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob"), strict=True):
                keys, n = np.unique(_all_keys(_read(blob.as_py())), return_counts=True)
                at = np.searchsorted(keys, bounds)
                raw, n = keys.view(np.uint8).reshape(-1, 8)[:, : _BITS // 8], np.minimum(n, least).astype(kind)
                full = [b for b in range(buckets) if at[b + 1] > at[b]]
                columns = [pa.array(full, pa.int32()), pa.array([chunk] * len(full), pa.int64())]
                columns += [pa.array([v[at[b] : at[b + 1]].tobytes() for b in full], pa.binary()) for v in (raw, n)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "hashes", "n"])

    def marked(rows: pa.Table) -> pa.Table:
        raw = [np.frombuffer(h.as_py(), np.uint8).reshape(-1, _BITS // 8) for h in rows.column("hashes")]
        wide = np.zeros((sum(map(len, raw)), 8), np.uint8)
        wide[:, : _BITS // 8] = np.concatenate(raw)
        _, _, kind_of, _ = distinct(wide.view(np.uint64).ravel())
        n = np.concatenate([np.frombuffer(c.as_py(), kind) for c in rows.column("n")])
        often = (np.bincount(kind_of, n) >= least)[kind_of]
        bits = [np.packbits(b).tobytes() for b in np.split(often, np.cumsum([len(r) for r in raw])[:-1])]
        return pa.table([rows.column("chunk"), rows.column("bucket"), pa.array(bits, pa.binary())], ["chunk", "bucket", "bits"])

    sent = chunks.select("chunk", "blob").mapInArrow(counted, "bucket int, chunk long, hashes binary, n binary")
    return sent.groupBy("bucket").applyInArrow(marked, "chunk long, bucket int, bits binary")


def _tag(lang: bytes, words: int) -> bytes:
    return (b"1" if words == 1 else b"2") + lang


def _ranges_of(lang: str, parts: list[bytes], ranges: int) -> np.ndarray:
    """The prefix range of each part, words with a space between: that of its word, or of its first two words."""
    _, _, hashes, follows = cut(b"\n".join([*parts, b""]))
    begins = np.flatnonzero(~np.concatenate(([False], follows[:-1])))
    word, pair = _keys(lang, np.arange(len(hashes)), follows, hashes)
    key = word[begins]
    several = np.flatnonzero(follows[begins])
    key[several] = pair[np.searchsorted(np.flatnonzero(follows), begins[several])]
    return (key % np.uint64(ranges)).astype(np.int64)


def _trees(blob: bytes, marks: list[dict], buckets: int, ranges: int, longest: int) -> Iterator[tuple[int, automata.Transducer]]:
    """Of each prefix range the automaton of the sequences of a chunk, tag before words. No states are shared yet."""
    chunk = _read(blob)
    langs, ids, follows, words, _ = chunk
    each = _all_keys(chunk)
    # the last word of a language isn't followed
    lang, own, after = np.repeat(np.arange(len(langs)), [len(i) for i in ids]), np.concatenate(ids).astype(np.int64), np.flatnonzero(np.concatenate(follows))
    range_of = np.zeros(len(own), np.int32)
    range_of[after] = each[len(own) :] % np.uint64(ranges)
    placed = (each[: len(own)] % np.uint64(ranges)).astype(np.int32)
    keys, _, kind_of, _ = distinct(each)
    at, often = np.searchsorted(keys, _bounds(buckets)), np.zeros(len(keys), bool)
    for m in marks:
        lo, hi = at[m["bucket"]], at[m["bucket"] + 1]
        often[lo:hi] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=hi - lo).astype(bool)
    often = often[kind_of]
    frequent, joined = often[: len(own)], np.zeros(len(own) + longest, bool)
    joined[after] = often[len(own) :]
    del each, keys, kind_of, after, often
    starts, ends = cut(words)[:2]
    n_words = len(starts)
    # numbers of words take so many bits
    bits = n_words.bit_length()
    low = (1 << bits) - 1

    # words by themselves: range, tag, word and how often
    at = np.flatnonzero(frequent)
    singles, first, _, n_single = distinct(lang[at] << bits | own[at])
    alone = placed[at[first]], 2 * (singles >> bits), singles & low, n_single, np.zeros(len(singles), np.int64)
    # pairs by range, then tag and words; below them what comes next, as long as pairs are frequent
    at = np.flatnonzero(joined[: len(own)])
    pairs, first, prefix, n_pair = distinct((lang[at] << bits | own[at]) << bits | own[at + 1] if len(at) else at)
    order = np.argsort(range_of[at[first]], kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(len(order))
    prefix, pairs, place = number[prefix], pairs[order], range_of[at[first[order]]].astype(np.int64)
    del lang, placed, range_of, first, number
    levels = [((pairs & low).astype(np.int32), n_pair[order].astype(np.int32))]
    above = []
    for k in range(2, longest):
        on = joined[at + k - 1]
        at, prefix = at[on], prefix[on]
        found, _, prefix, n = distinct(prefix.astype(np.int64) << bits | own[at + k])
        above.append((found >> bits).astype(np.int32))
        levels.append(((found & low).astype(np.int32), n.astype(np.int32)))
    heads = pairs >> bits
    starts_of = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(heads, prepend=-1) != 0))
    n_below = np.diff(np.append(starts_of, len(pairs)))
    sums = np.add.reduceat(levels[0][1], starts_of) if len(starts_of) else starts_of
    headed = place[starts_of], 2 * (heads[starts_of] >> bits) + 1, heads[starts_of] & low, sums, n_below
    places, tags, label, weight, below = (np.concatenate(x) for x in zip(alone, headed, strict=True))
    order = np.argsort(places * (2 * len(langs)) + tags, kind="stable")
    places, tags, label, weight, below = (x[order] for x in (places, tags, label, weight, below))
    starts_of = np.flatnonzero((np.diff(places, prepend=-1) != 0) | (np.diff(tags, prepend=-1) != 0))
    if not len(starts_of):
        return
    # number of word, weight and number of arcs that follow, by length of the prefix
    levels = [(label, weight, below), *((x, w, np.bincount(p, minlength=len(x))) for (x, w), p in zip(levels[:-1], above, strict=True)), (*levels[-1], np.zeros(len(levels[-1][0]), np.int64))]
    levels = [(n_words + tags[starts_of], np.add.reduceat(weight, starts_of), np.diff(np.append(starts_of, len(tags)))), *levels]
    text = [_tag(x.encode("utf-8", "replace"), k) for x in langs for k in (1, 2)]
    raw = np.frombuffer(words + b"".join(text), np.uint8)
    sizes = np.concatenate((ends - starts, [len(x) for x in text]))
    starts = np.concatenate((starts, len(words) + np.cumsum([0, *map(len, text)])[:-1]))
    present, begins = np.unique(places[starts_of], return_index=True)
    bounds = [np.append(begins, len(starts_of))]
    for _, _, n in levels[:-1]:
        bounds.append(np.concatenate(([0], np.cumsum(n)))[bounds[-1]])
    number = np.empty(len(sizes), np.int64)
    for k, r in enumerate(present.tolist()):
        mine = [tuple(x[b[k] : b[k + 1]] for x in level) for level, b in zip(levels, bounds, strict=True)]
        used = np.sort(np.concatenate([x for x, _, _ in mine]).astype(np.int32))
        used = used[np.diff(used, prepend=np.int32(-1)) != 0]
        number[used] = np.arange(len(used))
        yield r, automata.tree(raw[automata.runs(starts[used], sizes[used])].tobytes(), sizes[used], [(number[x], w, n) for x, w, n in mine])


def _transducers(chunks: DataFrame, marks: DataFrame, buckets: int, ranges: int, longest: int, least: int) -> DataFrame:
    """range and the count transducer of all chunks there, without the prefixes that occur less than least times."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, marks in zip(batch.column("blob"), batch.column("marks"), strict=True):
                own = [(r, len(t.label), t.packed()) for r, t in _trees(blob.as_py(), marks.as_py(), buckets, ranges, longest)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["range", "n_arcs", "blob"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a range follow each other; they are united some at a time."""
        at, parts, n, most = None, [], 0, _UNION_ARCS

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([automata.union(map(automata.Transducer.unpacked, parts), least).packed()], pa.binary())], ["range", "blob"])

        for batch in batches:
            for r, blob, n_arcs in zip(batch.column("range").to_pylist(), batch.column("blob"), batch.column("n_arcs").to_pylist(), strict=True):
                if r != at:
                    if parts:
                        yield done()
                    at, parts, n, most = r, [], 0, _UNION_ARCS
                parts.append(blob.as_py())
                n += n_arcs
                if n > most and len(parts) > 1:
                    both = automata.union(map(automata.Transducer.unpacked, parts), share=False)
                    parts, n = [both.packed()], len(both.label)
                    most = n + max(n, _UNION_ARCS)
        if parts:
            yield done()

    of_chunk = marks.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("marks"))
    sent = chunks.select("chunk", "blob").join(of_chunk, "chunk").select("blob", "marks").mapInArrow(built, "range int, n_arcs long, blob binary")
    return write_table(sent.repartition("range").sortWithinPartitions("range").mapInArrow(united, "range int, blob binary"), "count-transducers")


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("blob"):
            counts = automata.Transducer.unpacked(blob.as_py())
            words = counts.words.cast(pa.binary()).cast(pa.string())
            tags = pc.utf8_slice_codeunits(words, 1)
            for (tag, *rest), n in counts.paths():
                for at in range(0, len(n) if len(rest) > 1 else 0, 1 << 16):
                    some = slice(at, at + (1 << 16))
                    phrase = pc.binary_join_element_wise(*[words.take(pa.array(c[some])) for c in rest], " ")
                    yield pa.RecordBatch.from_arrays([tags.take(pa.array(tag[some])), phrase, pa.array(n[some].astype(np.int64))], ["lang", "phrase", "a"])


def _looked_up(asked: DataFrame, counts: DataFrame, ranges: int) -> DataFrame:
    """lang, part and its count, for parts asked for (lang, part), each once."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                at = _ranges_of(lang, [part.encode() for part in own.column("part").to_pylist()], ranges)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), own.column("lang"), own.column("part")], ["range", "lang", "part"])

    def composed(parts: pa.Table, held: pa.Table) -> pa.Table:
        rows = zip(parts.column("lang").to_pylist(), parts.column("part").to_pylist(), strict=True)
        words = sorted((_tag(lang.encode(), part.count(" ") + 1), *part.encode().split(b" "), automata.END) for lang, part in rows)
        found = [x for blob in held.column("blob") for x in automata.compose(automata.build((w, 1) for w in words), automata.Transducer.unpacked(blob.as_py()))]
        return pa.table([pa.array([w[0][1:].decode() for w, _ in found], pa.string()), pa.array([b" ".join(w[1:]).decode() for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["lang", "part", "f"])

    return asked.mapInArrow(placed, "range int, lang string, part string").groupBy("range").cogroup(counts.groupBy("range")).applyInArrow(composed, "lang string, part string, f long")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ", -1)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, longest: int = 4, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: of each language the first phrases by score, then a, both falling, then in byte order.

    A-Z are lower-cased, texts are cut at .,;:!? and U+000A to U+000D into pieces and these at spaces and tabs into words. n is the number
    of words of the language, a how often the phrase occurs within pieces. Phrases have 2 to longest words and occur least
    times. Cut after some words, l and r count the parts, and score is floor(2000000 * a / (l + r)); of all cuts
    the one of the lowest score counts, the first of several. A phrase whose words lie one after another in a longer one, itself kept or not,
    with 80 % of its count or more, goes. All numbers are exact.

    Null texts count as empty, a null language as "und". Repeated rows count as often as they occur. An empty table, and a language
    without phrases, give no rows. No other column of docs is read, so names can't clash.

    Hashes only decide what is looked at: two that are equal let more through, and counts are of the words themselves. (Within a chunk
    words are told apart by 64 bits.) A task holds one chunk, bucket or range; a word or pair however frequent is one number for each
    chunk, and one arc in each of their transducers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(column(lang_col), F.lit("und")).alias("lang"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    chunks = write_table(rows.mapInArrow(_chunked, "langs array<string>, n_words array<bigint>, blob binary").withColumn("chunk", F.monotonically_increasing_id()), "word-chunks")
    totals = chunks.select(F.explode(F.arrays_zip("langs", "n_words")).alias("z")).groupBy(F.col("z.langs").alias("lang")).agg(F.sum("z.n_words").alias("n"))
    words = chunks.select(F.sum(F.aggregate("n_words", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-words // _RANGE_WORDS))
    buckets = max(shuffle_partitions(spark), -(-words // _BUCKET_KEYS))
    marks = _marks(chunks, buckets, least)
    counts = _transducers(chunks, marks, buckets, ranges, longest, least)

    phrases = write_table(counts.select("blob").mapInArrow(_phrases, "lang string, phrase string, a long"), "phrases")
    w = F.col("w")
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))))
    within = phrases.select("lang", "a", _words(F.col("phrase")).alias("w")).filter(F.size("w") > 2).select("lang", F.explode(inside).alias("phrase"), "a")
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    big = lambda c: F.col(c).cast("decimal(22,0)")
    kept = phrases.join(within, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * big("longer") < 80 * big("a"))).select("lang", "phrase", "a")
    kept = write_table(kept, "kept-phrases")

    cuts = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.array(*[F.struct(k.alias("k"), F.lit(left).alias("left"), F.array_join(part, " ").alias("part")) for left, part in ((True, F.slice(w, F.lit(1), k)), (False, F.slice(w, k + 1, F.size(w) - k)))])))
    parts = kept.select("lang", "phrase", "a", _words(F.col("phrase")).alias("w")).select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    asked = write_table(parts.groupBy("lang", "part").agg(F.count("*").alias("n_asked")), "parts")
    found = _looked_up(asked.select("lang", "part"), counts, ranges)
    found = write_table(asked.join(found, ["lang", "part"]), "part-counts")
    met = join_groups(parts, found, ["lang", "part"], "n_asked", F.xxhash64("phrase", "k", "left"), how="inner")
    sides = met.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.expr("cast(cast(a as decimal(22,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(22,0)) + cast(r as decimal(22,0))) as bigint)")
    scored = sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.*")

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first ones of a language are among the first ones of its shares
    share = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = scored.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*best))).filter(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
