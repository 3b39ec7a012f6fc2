"""WARC archives: a writer, and a sequential reader with one gzip member for each record.

An archive is a stream of bytes. Tables hold it in pieces (archive, chunk, data), so that it goes through Spark's own
storage; the pieces of an archive in order of chunk are the bytes of a .warc.gz file.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import column, join_groups, write_table

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PIECE = 1 << 16


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(named: str | None) -> str | None:
    """A SHA-1 digest as a record names it, in base 32 or hexadecimal, as lower-case hexadecimal; null for any other."""
    kind, _, value = (named or "").strip().partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else base64.b32decode(value, casefold=True).hex()
    except binascii.Error:
        return None


def _urn(page: object) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str | None) -> str | None:
    return (urn or "").removeprefix("<urn:page:").removesuffix(">") or None


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page: object, url: str | None, payload: bytes, original: object = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member: a response, or a revisit of the page original, which has no payload of its own.

    Both name the digest and the length of the full payload. Line ends in a URL are left out.
    """
    block = _HTTP if original is not None else _HTTP + payload
    head = {
        "WARC-Type": "response" if original is None else "revisit", "WARC-Record-ID": _urn(page), "WARC-Date": date, "WARC-Target-URI": "".join((url or "").splitlines()),
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": _sha1(payload), "WARC-Block-Digest": _sha1(block), "X-Payload-Length": str(len(payload)),
    }
    if original is not None:
        head |= {"WARC-Refers-To": _urn(original), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": str(len(block))}).items())
    return gzip_member(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


class _Stream:
    """The content of one gzip member after another, decompressed as it is asked for."""

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self.chunks, self.data, self.ready, self.member = iter(chunks), b"", b"", None

    def next_member(self) -> bool:
        while not self.data:
            if (more := next(self.chunks, None)) is None:
                return False
            self.data = more
        self.member, self.ready = zlib.decompressobj(31), b""
        return True

    def more(self) -> bytes:
        """The next piece of this member; none at its end."""
        while not self.member.eof:
            if not self.data:
                self.data = next(self.chunks, b"")
                if not self.data:
                    raise ValueError("the archive ends inside a record")
            piece = self.member.decompress(self.data, _PIECE)
            self.data = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
            if piece:
                return piece
        return b""

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.ready.find(mark, seen)) < 0:
            seen = max(0, len(self.ready) - len(mark) + 1)
            if not (piece := self.more()):
                raise ValueError("a record ends inside its head")
            self.ready += piece
        head, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return head

    def take(self, n: int) -> Iterator[bytes]:
        while n > 0:
            piece = self.ready or self.more()
            if not piece:
                raise ValueError("a record is shorter than its Content-Length")
            yield piece[:n]
            self.ready, n = piece[n:], n - len(piece[:n])


def read_records(chunks: Iterable[bytes], keep_payload: bool = True) -> Iterator[dict]:
    """Each record of an archive given in pieces of any size: type, id, refers_to, uri, headers, payload, payload_bytes, payload_digest, verified.

    Only one record is in memory, and without keep_payload only a piece of it. Names of headers count whatever their
    case; headers has them as they are written. A line that begins with a blank goes on with the header before it. The payload of an HTTP message is
    what follows its head, of any other record its whole block. For a revisit payload_bytes and payload_digest are
    those that it names, 0 and null if it names none. verified: the digests of block and payload that the record names are right; null if it names none that is a
    SHA-1. A stream that is cut off, or framed otherwise than by Content-Length and two line ends, raises ValueError; an
    empty one has no records.
    """
    stream = _Stream(chunks)
    while stream.next_member():
        lines = re.sub(r"\r\n[ \t]+", " ", stream.until(b"\r\n\r\n").decode("utf-8", "replace")).split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        named_as = {name.strip(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
        head = {name.lower(): value for name, value in named_as.items()}
        if not head.get("content-length", "").isdigit():
            raise ValueError("a record has no Content-Length")
        kind, http = head.get("warc-type", ""), b"" if head.get("content-type", "").lower().startswith("application/http") else None
        block, payload, length, kept, seen = hashlib.sha1(), hashlib.sha1(), 0, [], 0
        for piece in stream.take(int(head["content-length"])):
            block.update(piece)
            if http is not None:
                http += piece
                if (at := http.find(b"\r\n\r\n", seen)) < 0:
                    seen = max(0, len(http) - 3)
                    continue
                piece, http = http[at + 4 :], None
            payload.update(piece)
            length += len(piece)
            if keep_payload:
                kept.append(piece)
        rest = stream.ready
        while piece := stream.more():
            rest += piece
        if rest != b"\r\n\r\n":
            raise ValueError("a record isn't framed by its Content-Length")
        revisit, named = kind == "revisit", _hex(head.get("warc-payload-digest"))
        checks = [(_hex(head.get("warc-block-digest")), block), *([] if revisit else [(named, payload)])]
        checks = [want == h.hexdigest() for want, h in checks if want is not None]
        full = head.get("x-payload-length", "")
        yield {
            "type": kind, "id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "headers": named_as, "payload": b"".join(kept) if keep_payload and not revisit else None, "payload_bytes": (int(full) if full.isdigit() else 0) if revisit else length,
            "payload_digest": named if revisit else payload.hexdigest(), "verified": all(checks) if checks else None,
        }


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 1000, chunk_bytes: int = 1 << 20, archive_bytes: int = 256 << 20) -> DataFrame:
    """Archives of one record for each row of pages, as pieces: archive long, chunk int, data binary.

    The payload is the HTML in UTF-8, null as empty. Of rows with equal payloads of at least least_bytes, the one
    with the largest id is a response (so are rows that repeat that id), the others revisit it. Payloads are compared by SHA-1
    and length. Each task writes archives of its own, and begins a new one once one has archive_bytes. Very many equal payloads are not dealt by their digest: see
    join_groups. Null URLs are empty, null ids make records without one. An empty table makes no pieces.
    """
    payload = F.encode(F.coalesce(column(html_col), F.lit("")), "utf-8")
    rows = pages.select(column(id_col).cast("string").alias("page"), column(id_col).alias("id"), column(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload")})
    equal = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1")
    equal = write_table(equal, "equal-payloads")
    rows = join_groups(rows, equal, ["digest", "bytes"], "n", F.xxhash64("page", "url"))
    rows = rows.select("page", "url", "payload", F.when(F.col("original") != F.col("id"), F.col("original")).cast("string").alias("original"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, chunk, held, written = TaskContext.get().partitionId() << 32, 0, bytearray(), 0
        for batch in batches:
            for page, url, payload, original in batch.itertuples(index=False):
                held += record(page, url, bytes(payload), original)
                while len(held) >= chunk_bytes:
                    yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [bytes(held[:chunk_bytes])]})
                    del held[:chunk_bytes]
                    chunk, written = chunk + 1, written + chunk_bytes
                if written + len(held) >= archive_bytes:
                    yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [bytes(held)]})
                    held.clear()
                    archive, chunk, written = archive + 1, 0, 0
        if held:
            yield pd.DataFrame({"archive": [archive], "chunk": [chunk], "data": [bytes(held)]})

    return rows.mapInPandas(write, "archive long, chunk int, data binary")


def read_archives(pieces: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of archives in pieces: page, record_type, refers_to, url, payload, payload_bytes, payload_digest, verified.

    An archive is read by one task from its first piece to its last, without being held as a whole. Pieces may come in any
    order; rows with a null archive or chunk are left out, and a piece of the same archive and chunk as another breaks it. page and refers_to are the ids of
    records that write_archives made, and the whole record ids of others.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = ((row.archive, bytes(row.data)) for batch in batches for row in batch.itertuples(index=False))
        following = next(pieces, None)

        def chunks() -> Iterator[bytes]:
            nonlocal following
            archive = following[0]
            while following is not None and following[0] == archive:
                yield following[1]
                following = next(pieces, None)

        while following is not None:
            out, size = [], 0
            for r in read_records(chunks(), keep_payload):
                out.append((_page(r["id"]), r["type"], _page(r["refers_to"]), r["uri"], r["payload"], r["payload_bytes"], r["payload_digest"], r["verified"]))
                size += len(r["payload"] or b"") + 200
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=names)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["page", "record_type", "refers_to", "url", "payload", "payload_bytes", "payload_digest", "verified"]
    dealt = pieces.select("archive", "chunk", "data").dropna(subset=["archive", "chunk"]).repartition("archive").sortWithinPartitions("archive", "chunk")
    return dealt.mapInPandas(read, "page string, record_type string, refers_to string, url string, payload binary, payload_bytes long, payload_digest string, verified boolean")
