"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier, in blocks of about 64 KB. In a block, a key is written
as the number of bytes it shares with the key before and the rest; the block is then compressed. After the
blocks come a sparse index (the last key of each block and where the block lies), a Bloom filter over the
identifiers, and a footer of fixed size. A look-up reads the footer, asks the filter, finds the block by binary
search in the index, and reads that block only.

    block    (shared, rest, length: varints; rest of the key; ids)*, zstd
    index    (key length: u8; key; offset: u64; length: u32)*
    footer   magic 8s, index offset u64, index length u64, filter offset u64, filter length u64,
             documents u64, ids u64, bytes of an id u32, crc32 of index and filter u32

All numbers are little-endian, but for the identifier in a key, which is big-endian with its sign turned so that
byte order is number order: 0 for null, or 1 and eight bytes; then four bytes that count rows of equal identifier.
Null identifiers come first.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_folder, mix64, session_defaults, texts, written
from .files import new_file, open_input, open_output
from .vocab import unit_encoder

TOKENIZER, END = "byte_bpe_50k.json", 2
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
#: Text that a task gets at most, on average.
TASK_BYTES = 64 << 20
FOOTER = struct.Struct("<8sQQQQQQII")
ENTRY = struct.Struct("<QI")
MAGIC = b"SSTBLIDS"
BITS, HASHES = 10, 7


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return (b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", repeat)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    """The places (rows: hashes) of identifiers in a filter of so many bits."""
    a = mix64(ids.astype(np.int64).view(np.uint64))
    b = mix64(a) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(k) * b) % np.uint64(size) for k in range(HASHES)])


class ShardWriter:
    """Writes one shard; documents must come in key order."""

    def __init__(self, path: str, width: int):
        self.path, self.width, self.out = path, width, open_output(path)
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.block, self.block_size, self.key = [], 0, b""
        self.index: list[bytes] = []
        self.ids: list[int] = []
        self.at = self.n_docs = self.n_ids = self.repeat = 0
        self.first = self.last = None

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.repeat = self.repeat + 1 if self.n_docs and doc_id == self.last else 0
        key = key_of(doc_id, self.repeat)
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.key) and key[shared] == self.key[shared]:
                shared += 1
        entry = varint(shared) + varint(len(key) - shared) + varint(len(ids)) + key[shared:] + ids
        self.block.append(entry)
        self.block_size += len(entry)
        self.first = doc_id if not self.n_docs else self.first
        self.key, self.last = key, doc_id
        self.n_docs += 1
        self.n_ids += len(ids) // self.width
        if doc_id is not None:
            self.ids.append(doc_id)
        if self.block_size >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        packed = self.zstd.compress(b"".join(self.block))
        self.index.append(bytes([len(self.key)]) + self.key + ENTRY.pack(self.at, len(packed)))
        self.out.write(packed)
        self.at += len(packed)
        self.block, self.block_size = [], 0

    def close(self) -> tuple[str, int | None, int | None, int, int]:
        if self.block:
            self._end_block()
        size = max(64, -(-len(self.ids) * BITS // 64) * 64)
        bits = np.zeros(size, bool)
        if self.ids:
            bits[_bits(np.array(self.ids, np.int64), size).ravel()] = True
        index, bloom = b"".join(self.index), np.packbits(bits, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(MAGIC, self.at, len(index), self.at + len(index), len(bloom), self.n_docs, self.n_ids, self.width, zlib.crc32(index + bloom)))
        self.out.close()
        return self.path, self.first, self.last, self.n_docs, self.n_ids


class Shard:
    """Reads one shard: all of it in order, or one identifier."""

    def __init__(self, path: str):
        self.file = open_input(path)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        magic, index_at, index_len, bloom_at, bloom_len, self.n_docs, self.n_ids, self.width, crc = FOOTER.unpack(self.file.read(FOOTER.size))
        self.file.seek(index_at)
        index = self.file.read(index_len)
        self.bloom = self.file.read(bloom_len)
        if magic != MAGIC or zlib.crc32(index + self.bloom) != crc:
            raise ValueError(f"{path} is not a whole shard")
        self.keys, self.places, at = [], [], 0
        while at < len(index):
            n = index[at]
            self.keys.append(index[at + 1 : at + 1 + n])
            self.places.append(ENTRY.unpack_from(index, at + 1 + n))
            at += 1 + n + ENTRY.size
        self.zstd = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        at, length = self.places[k]
        self.file.seek(at)
        raw = self.zstd.decompress(self.file.read(length))
        key, i = b"", 0
        while i < len(raw):
            numbers = []
            for _ in range(3):
                n = shift = 0
                while raw[i] > 127:
                    n |= (raw[i] & 127) << shift
                    shift += 7
                    i += 1
                numbers.append(n | raw[i] << shift)
                i += 1
            shared, rest, length = numbers
            key = key[:shared] + raw[i : i + rest]
            i += rest
            yield key, raw[i : i + length]
            i += length

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.places)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        if doc_id is None:
            return True
        at = _bits(np.array([doc_id]), len(self.bloom) * 8)[:, 0]
        return all(self.bloom[int(b) >> 3] >> (int(b) & 7) & 1 for b in at)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier, or None."""
        if not self.may_hold(doc_id):
            return None
        k = bisect_left(self.keys, key_of(doc_id))
        for key, ids in self.block(k) if k < len(self.keys) else ():
            if id_of(key) == doc_id:
                return np.frombuffer(ids, f"<u{self.width}")
        return None


def write_shards(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """Encodes every text (null: empty) of docs (doc_id, text), appends end, and writes shards; returns their manifest.

    The manifest (path, first_id, last_id, n_docs, n_ids, part, number) has a row per shard: the task that wrote it, and its number
    there, which are the order of the shards. Documents are dealt out by ranges of
    doc_id and, among rows of equal doc_id, of the texts' hashes, so that no identifier (or its absence) fills a
    task; repeated rows are all kept. An empty table has no shard.
    """
    spark = docs.sparkSession
    session_defaults(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    folder = fresh_folder(spark, "sstable")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = unit_encoder(tokenizer)
        tail = np.array([end], encoder.dtype).tobytes()
        shard, part, done = None, TaskContext.get().partitionId(), []
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True):
                if shard is not None and shard.at >= SHARD_BYTES:
                    done.append((*shard.close(), part, len(done)))
                    shard = None
                if shard is None:
                    shard = ShardWriter(new_file(folder, ".sst"), encoder.dtype.itemsize)
                shard.add(doc_id, ids + tail)
        if shard is not None:
            done.append((*shard.close(), part, len(done)))
        if done:
            columns = zip(*done, strict=True)
            kinds = (pa.string(), *(pa.int64(),) * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "first_id", "last_id", "n_docs", "n_ids", "part", "number"])

    dealt = docs.repartitionByRange(tasks, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return written(dealt.mapInArrow(write, "path string, first_id bigint, last_id bigint, n_docs bigint, n_ids bigint, part bigint, number bigint"), "sstable-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, read from its shard."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # a row per shard, not per document
    shards = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = (pa.int64(),) * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, start in zip(*(batch.column(c).to_pylist() for c in ("path", "start")), strict=True):
                shard, rows = Shard(path), []
                for doc_id, raw in shard:
                    ids = np.frombuffer(raw, f"<u{shard.width}")
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    return shards.repartition(n, "path").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
