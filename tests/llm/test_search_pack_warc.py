import gzip
import hashlib
import io
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import decontaminate, packing, queries, warc

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, spans string"


def plain_hits(text, items, width=13):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(width, len(own))
        for w in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == w:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short é item"), (3, None), (4, "..."), (5, "b b b")]
TEXTS = [
    None, "", "nothing here", "xx short É item short é ITEM, é", "b b b b b", "zero one two, three four five six\nseven eight nine ten eleven twelve thirteen! end", "short é items", "a short é item " * 3000,
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen " + "pad " * 300,
]


@pytest.mark.parametrize("block", [1 << 20, 1])
def test_contamination_cases(spark, block):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], DOCS)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect()}
    for i, t in enumerate(TEXTS):
        n, hits, items = plain_hits(t, ITEMS)
        assert (got[i].n_words, got[i].n_hit, got[i].items) == (n, hits, items)
        assert got[i].contaminated == (hits > 0 and 20 * hits >= n)
    assert [TEXTS[5][s.first : s.last] for s in got[5].spans] == [TEXTS[5][5:-5]]
    assert [TEXTS[3][s.first : s.last] for s in got[3].spans] == ["short é ITEM"]
    none = decontaminate.find_contamination(docs, bench.limit(0)).collect()
    assert not any(r.contaminated for r in none) and decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_best_fit_holds_its_promises():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 8193, 3000)
    for least in packing.LENGTHS:
        bins, offsets, lengths, contents = packing.best_fit(sizes, packing.LENGTHS, least)
        assert (np.bincount(bins, sizes) == contents).all() and (contents <= lengths).all()
        shorter = [max((x for x in packing.LENGTHS if x < n), default=0) for n in lengths]
        assert (contents > shorter).all()
        ends = defaultdict(int)
        for b, o, s in sorted(zip(bins, offsets, sizes, strict=True)):
            assert o == ends[b]
            ends[b] += s


def test_best_fit_equals_plain():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 400, 300)
    room, where = [], []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(left, b) for b, left in enumerate(room) if left >= sizes[i]]
        if fits:
            left, b = min(fits)
            room[b] -= int(sizes[i])
        else:
            room.append(1024 - int(sizes[i]))
            b = len(room) - 1
        where.append((int(i), b))
    bins = packing.best_fit(sizes, (512, 1024), 1024)[0]
    assert dict(where) == dict(enumerate(bins.tolist()))


def test_packing_query(spark):
    words = {r.doc_id: len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text)) + 1 for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op8_packing(spark, SF).collect()
    held, bins = defaultdict(list), defaultdict(list)
    for r in got:
        held[r.doc_id].append((r.start, r.n_tokens))
        bins[r.bin].append(r)
    for d, n in words.items():
        at = 0
        for start, size in sorted(held[d]):
            assert start == at
            at += size
        assert at == n
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
        assert rows[0].bin_tokens == at <= rows[0].bin_length and rows[0].bin_length in packing.LENGTHS
        assert rows[0].bin_length == min(x for x in packing.LENGTHS if x >= at)
    full = sum(r[0].bin_tokens for r in bins.values()) / sum(r[0].bin_length for r in bins.values())
    assert full > 0.98


def test_packing_odd_rows(spark):
    rows = [(None, 5), (1, None), (2, 0), (3, -1), (4, 20_000), (5, 8192), (5, 8192), (6, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n long"), F.col("n")).collect()
    assert sorted((r.doc_id or 0, r.part, r.n_tokens) for r in got) == [(0, 0, 5), (4, 0, 8192), (4, 1, 8192), (4, 2, 3616), (5, 0, 8192), (5, 0, 8192), (6, 0, 1)]
    assert packing.pack(spark.createDataFrame([], "doc_id long, n long"), F.col("n")).count() == 0


def archive(records):
    return b"".join(records)


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_reader_takes_pieces_of_any_size(size):
    payloads = [b"", b"\r\n\r\n<p>", "é".encode() * 5000, bytes(range(256)) * 300]
    raw = archive([warc.record(i, f"http://x/{i}", p) for i, p in enumerate(payloads)] + [warc.record(9, "u", payloads[2], original=2)])
    got = list(warc.read_records(raw[i : i + size] for i in range(0, len(raw), size)))
    assert [r["payload"] for r in got[:4]] == payloads and all(r["verified"] for r in got)
    assert [r["payload_digest"] for r in got] == [hashlib.sha1(p).hexdigest() for p in [*payloads, payloads[2]]]
    assert got[4]["headers"]["WARC-Type"] == "revisit" and got[4]["payload"] is None and got[4]["payload_bytes"] == 10_000


def test_archives_are_gzip_and_damage_is_seen():
    raw = archive([warc.record(1, "u", b"payload"), warc.record(2, "u", b"other")])
    assert gzip.GzipFile(fileobj=io.BytesIO(raw)).read().count(b"WARC/1.1") == 2
    with pytest.raises(ValueError):
        list(warc.read_records([raw[:-20]]))
    plain = gzip.decompress(warc.record(1, "u", b"payload"))
    assert not next(warc.read_records([warc.gzip_member(plain.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))]))["verified"]
    with pytest.raises(ValueError):
        list(warc.read_records([warc.gzip_member(plain + b"x")]))
    assert list(warc.read_records([])) == []


def test_archive_round_trip(spark):
    same = "x" * 1200
    rows = [(1, "a", same), (2, "b", same), (3, "c", same), (4, "d", "small"), (5, "e", "small"), (6, None, None), (7, "f\nX: y", ""), (None, "g", "ü" * 40_000), (3, "c", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pieces = warc.write_archives(pages, chunk_bytes=50)
    got = warc.read_archives(pieces).collect()
    assert len(got) == len(rows) and all(r.verified for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.page].append((r.record_type, r.refers_to))
    assert by["1"] == by["2"] == [("revisit", "3")] and by["3"] == [("response", None)] * 2 and by["4"] == by["5"] == [("response", None)]
    assert {r.page: bytes(r.payload).decode() for r in got if r.payload is not None} == {str(i) if i else None: h or "" for i, _, h in rows if i not in (1, 2)}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
