"""Web archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames with some records each, then two frames that decompressors skip:
an index that maps record identifiers to a frame and an offset in it, and the seek table of the seekable format
(compressed and decompressed size of each frame). To read one record, one frame is decompressed; its place is found
by binary search in the index, which is sorted by identifier.

A response holds an HTTP message with the payload as its body. A record whose payload is equal to an earlier one's is
a revisit: it carries the message's head, the digest and the length, not the payload. Pages have no time of capture;
WARC-Date is when the job began to write, the same in all of its records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh_folder, session_defaults, skew_join, written
from .common import frequent as hot_keys
from .files import new_file, open_input, open_output

#: Fixed values of the seekable format: magic of skippable frames (the first of 16 kinds and the seek table's), of its footer.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Shorter payloads are never revisits.
MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 128 << 20
INDEX_ENTRY = struct.Struct("<BqII")
#: So many entries of the index are read at once when a search has come down to them.
INDEX_RUN = 256
#: A payload is frequent if more than one in so many of all repeated rows have it: fewer than so many payloads are.
FREQUENT = 1000
EOL = b"\r\n"


def _line(name: str, value: object) -> bytes:
    return f"{name}: {value}".encode() + EOL


def record_id(page_id: int | None) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{"" if page_id is None else page_id}').urn}>"


def _id(text: str) -> int | None:
    return int(text) if text else None


def _page(page_id: int | None) -> str:
    return "" if page_id is None else str(page_id)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: a response, or with refers_to a revisit. X-Page-ID and X-Refers-To-Page-ID have the table's identifiers."""
    head = b"HTTP/1.1 200 OK" + EOL + _line("Content-Type", "text/html; charset=utf-8") + _line("Content-Length", len(payload)) + EOL
    body = head if refers_to is not None else head + payload
    out = b"WARC/1.1" + EOL + _line("WARC-Type", "response" if refers_to is None else "revisit") + _line("WARC-Record-ID", record_id(page_id)) + _line("WARC-Date", date) + _line("X-Page-ID", _page(page_id))
    if url is not None:
        out += _line("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    out += _line("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()) + _line("X-Payload-Length", len(payload))
    if refers_to is not None:
        out += _line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest") + _line("WARC-Refers-To", record_id(refers_to)) + _line("X-Refers-To-Page-ID", _page(refers_to))
    return out + _line("Content-Type", "application/http;msgtype=response") + _line("Content-Length", len(body)) + EOL + body + EOL + EOL


def payload(block: bytes) -> bytes:
    """The body of the HTTP message in a record's block."""
    return block[block.index(EOL + EOL) + 4 :]


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The headers and block of the record at a place, and the place after it."""
    end = raw.index(EOL + EOL, at)
    first, *lines = raw[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(headers["Content-Length"])
    return headers, raw[start:stop], stop + 4


class BundleWriter:
    def __init__(self, path: str):
        self.path, self.out = path, open_output(path)
        self.zstd = zstandard.ZstdCompressor(level=3)
        self.frame, self.frame_size = [], 0
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[bool, int, int, int]] = []
        self.size = self.n = 0

    def add(self, page_id: int | None, raw: bytes) -> None:
        self.index.append((page_id is not None, page_id or 0, len(self.frames), self.frame_size))
        self.frame.append(raw)
        self.frame_size += len(raw)
        self.n += 1
        if self.frame_size >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        packed = self.zstd.compress(b"".join(self.frame))
        self.frames.append((len(packed), self.frame_size))
        self.out.write(packed)
        self.size += len(packed)
        self.frame, self.frame_size = [], 0

    def close(self) -> tuple[str, int]:
        if self.frame:
            self._end_frame()
        # by identifier, null first; of equal ones in the order written
        index = b"".join(INDEX_ENTRY.pack(*x) for x in sorted(self.index))
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0)]
        table = b"".join(struct.pack("<II", *x) for x in entries) + struct.pack("<IBI", len(entries), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()
        return self.path, self.n


class Bundle:
    def __init__(self, path: str):
        self.file = open_input(path)
        size = self.file.size()
        self.file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(size - 9 - 8 * n)
        entries = list(struct.iter_unpack("<II", self.file.read(8 * n)))
        self.places, at = [], 0
        for packed, whole in entries:
            self.places.append((at, packed, whole))
            at += packed
        self.index_place = self.places.pop()
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, whole = self.places[k]
        self.file.seek(at)
        return self.zstd.decompress(self.file.read(packed), max_output_size=whole)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        for k in range(len(self.places)):
            raw, at = self.frame(k), 0
            while at < len(raw):
                headers, body, at = parse(raw, at)
                yield headers, body

    def _entries(self, first: int, n: int) -> list[tuple[int, int, int, int]]:
        n = min(n, (self.index_place[1] - 8) // INDEX_ENTRY.size - first)
        self.file.seek(self.index_place[0] + 8 + first * INDEX_ENTRY.size)
        return list(INDEX_ENTRY.iter_unpack(self.file.read(n * INDEX_ENTRY.size)))

    def place(self, page_id: int | None) -> tuple[int, int] | None:
        """Where a record lies: frame and offset in it. Of rows with equal identifiers, the first."""
        asked, low, high = (page_id is not None, page_id or 0), 0, (self.index_place[1] - 8) // INDEX_ENTRY.size
        while high - low > INDEX_RUN:  # the first entry not below what is asked is in low..high
            middle = (low + high) // 2
            if self._entries(middle, 1)[0][:2] < asked:
                low = middle + 1
            else:
                high = middle
        return next((x[2:] for x in self._entries(low, high - low + 1) if x[:2] == asked), None)

    def get(self, page_id: int | None) -> tuple[dict[str, str], bytes] | None:
        where = self.place(page_id)
        return parse(self.frame(where[0]), where[1])[:2] if where else None


def write_bundles(pages: DataFrame) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the manifest (path, n_records).

    The payload is the html in UTF-8, null being empty. Of rows with equal payloads of MIN_REVISIT bytes or more,
    that with the smallest page_id is the response and the others revisit it. Null page_ids count as largest and
    are responses if all are null; a row that repeats the response's page_id is a response as well. An empty table
    has no bundle.
    """
    spark = pages.sparkSession
    session_defaults(spark)
    long = F.octet_length("html") >= MIN_REVISIT
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.when(long, F.unhex(F.sha2(F.encode("html", "UTF-8"), 256))))
    groups = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    scratch = Scratch(spark)
    firsts = scratch.written(groups.where("n > 1"), "warc-firsts")
    # fewer than FREQUENT rows, whatever the input: these are broadcast, so that the rows of a frequent payload stay where they are
    total = firsts.agg(F.sum("n")).first()[0] or 0
    frequent = firsts.where(F.col("n") * FREQUENT > total).select("digest", F.col("first").alias("frequent_first"), F.lit(True).alias("frequent"))
    rest = firsts.where(F.col("n") * FREQUENT <= total).select(F.col("digest").alias("key"), "first")
    # rows that have no partner go by a key of 8 bytes, which no digest is, and so don't meet in one task
    own = F.unhex(F.lpad(F.hex(F.xxhash64("page_id", "url")), 16, "0"))
    keyed = rows.join(F.broadcast(frequent), "digest", "left").withColumn("key", F.when(F.col("digest").isNotNull() & F.col("frequent").isNull(), F.col("digest")).otherwise(own))
    first = F.coalesce("frequent_first", "first")
    # a payload that is not frequent by that measure may still have more rows than a task should get: they are dealt to slices
    counts = firsts.where(F.col("n") * FREQUENT <= total).select(F.col("digest").alias("key"), F.col("n").alias("size"))
    joined = skew_join(keyed, rest, "key", F.struct("page_id", "url"), hot_keys(counts, scratch), "left").select("page_id", "url", "html", F.when(first.isNotNull() & ~F.col("page_id").eqNullSafe(first), first).alias("refers_to"))
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = fresh_folder(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done = None, []
        for batch in batches:
            for page_id, url, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or BundleWriter(new_file(folder, ".warc.zst"))
                bundle.add(page_id, record(page_id, url, text.encode("utf-8", "surrogatepass"), refers_to, date))
                if bundle.size >= BUNDLE_BYTES:
                    done.append(bundle.close())
                    bundle = None
        if bundle is not None:
            done.append(bundle.close())
        if done:
            paths, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "n_records"])

    manifest = written(joined.mapInArrow(write, "path string, n_records bigint"), "warc-manifest")
    scratch.clear()
    return manifest


def read_bundles(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, read from the bundles.

    A response's digest and length are taken from its payload and must be those in its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for headers, block in Bundle(path):
                    body = payload(block)
                    digest, length = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response" and (hashlib.sha256(body).hexdigest(), len(body)) != (digest, length):
                        raise ValueError(f"{path}: {headers['WARC-Record-ID']} is damaged")
                    rows.append((_id(headers["X-Page-ID"]), length, digest, headers["WARC-Type"], _id(headers.get("X-Refers-To-Page-ID", ""))))
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
