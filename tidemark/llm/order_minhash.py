"""Document fingerprints by order MinHash.

A text's k-mers are numbered by occurrence, so that repeats differ. For each of SKETCHES hash functions, the L
k-mers of smallest hash are taken in the order in which they stand in the text, and the tuple is hashed. Two texts
agree in a sketch with a probability that falls as their edit distance grows: to agree they must share k-mers and
have them in the same order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import code_points, mix64, session_defaults, written

K, L, SKETCHES = 6, 2, 32
#: k-mers of one block of hashes, so that memory doesn't grow with the text.
BLOCK = 1 << 15
#: k-mers that are numbered in one go, about; longer texts go in parts.
RUN = 1 << 20
TASK_BYTES = 64 << 20
_ODD = (mix64(np.arange(SKETCHES)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASK = (mix64(np.arange(SKETCHES) + 1000) >> np.uint64(32)).astype(np.uint32)


def kmers(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The hashes (64 bits) of a text's k-mers in order, and the hashes (32 bits) of each with its occurrence number.

    A text shorter than K is one k-mer; an empty one has none.
    """
    points = code_points(text)
    k = min(K, len(points))
    n = len(points) - k + 1
    if not k:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    h, ids = np.empty(n, np.uint64), np.empty(n, np.uint32)
    with np.errstate(over="ignore"):
        for a in range(0, n, RUN):
            own = np.full(min(RUN, n - a), k, np.uint64)
            for j in range(k):
                own *= np.uint64(0x100000001B3)
                own += points[a + j : a + j + len(own)]
            h[a : a + len(own)] = mix64(own)
        # k-mers of one kind have equal first bits, so that a long text is numbered in parts by these
        split = (-(-n // RUN) - 1).bit_length()
        top = (h >> np.uint64(48)).astype(np.uint16) if split else None
        for part in range(1 << split):
            _number(h, np.arange(n) if top is None else np.flatnonzero(top >> np.uint16(16 - split) == part), ids)
    return h, ids


def _number(h: np.ndarray, places: np.ndarray, ids: np.ndarray) -> None:
    """Sets ids at the places (ascending; with a kind, all of its places) to the hashes of k-mers with their occurrence numbers."""
    if not len(places):
        return
    # sort by hash, then place; a k-mer's number is its distance from the first of its kind
    bits = np.uint64(max(1, len(h).bit_length()))
    key = (h[places] >> bits << bits) | places.astype(np.uint64)
    key.sort()
    kind = key >> bits
    first = np.r_[True, kind[1:] != kind[:-1]]
    at = np.arange(len(key))
    number = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ids[place] = (mix64(h[place] ^ (number * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(32)).astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """SKETCHES 32-bit sketches; all are 0 for an empty text. With fewer than L k-mers, a tuple has those there are."""
    h, ids = kmers(text)
    if not len(h):
        return np.zeros(SKETCHES, np.uint32)
    row = np.arange(SKETCHES)
    values, places = [], []
    for start in range(0, len(ids), BLOCK):
        block = (ids[None, start : start + BLOCK] ^ _MASK[:, None]) * _ODD[:, None]
        for _ in range(min(L, block.shape[1])):
            at = block.argmin(axis=1)
            values.append(block[row, at].copy())
            places.append(at + start)
            block[row, at] = np.uint32(0xFFFFFFFF)
    values, places = np.stack(values, axis=1), np.stack(places, axis=1)
    if values.shape[1] > L:
        own = np.argsort(values, axis=1, kind="stable")[:, :L]
        places = np.take_along_axis(places, own, axis=1)
    places.sort(axis=1)
    out = np.full(SKETCHES, places.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(places.shape[1]):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[places[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of sketches in which two fingerprints agree."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the beginning of the following text as there is."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = {"part": pa.int32(), "kind": pa.int32(), "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "text": pa.string()}
_SCHEMA = "part int, kind int, doc_id bigint, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
#: Rows of the first pass: finished; the first of a partition; the last of a partition, whose successor is in another.
DONE, HEAD, OPEN = 0, 1, 2


def _finished(part: int, doc_id: int | None, text: str, own: np.ndarray, next_text: str, next_print: np.ndarray) -> tuple:
    changed = edited(text, next_text)
    other = own if changed == text else fingerprint(changed)
    return part, DONE, doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), own.tobytes(), other.tobytes(), likeness(own, other), likeness(own, next_print), None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "") + 200
        if size >= 4 << 20:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _FIELDS.values(), strict=True)], names=list(_FIELDS))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and how like it is to its edited text's and to the next document's.

    The next document is the one before in order of doc_id (null doc_ids count as smallest; rows of equal doc_id come
    in order of their texts' hashes); the last one's next is the first. Null text is empty. Returns doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next. An only document is its
    own next; an empty table gives no rows.

    Documents are dealt out by ranges of doc_id, once. A partition's last document waits, with its text, for the
    next partition's first one; there are two such rows a partition, which meet in a join.
    """
    spark = docs.sparkSession
    session_defaults(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found():
            before = None
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = fingerprint(text)
                    if before is None:
                        yield part, HEAD, doc_id, len(text), None, own.tobytes(), None, None, None, text
                    else:
                        yield _finished(part, *before, text, own)
                    before = doc_id, text, own
            if before is not None:
                doc_id, text, own = before
                yield part, OPEN, doc_id, len(text), None, own.tobytes(), None, None, None, text

        yield from _batches(found())

    first = written(dealt.mapInArrow(walk, _SCHEMA), "order-minhash")
    heads = first.where(f"kind = {HEAD}").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # a row per partition: the next partition that has rows, and after the last the first
    parts = first.where(f"kind = {HEAD}").select("part")
    chain = parts.withColumn("next_part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    waiting = first.where(f"kind = {OPEN}").select("part", "doc_id", "text", "fingerprint").join(chain, "part").join(heads, "next_part").select("part", "doc_id", "text", "fingerprint", "next_text", "next_print")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for part, doc_id, text, own, next_text, next_print in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield _finished(part, doc_id, text, np.frombuffer(own, np.uint32), next_text, np.frombuffer(next_print, np.uint32))

        yield from _batches(found())

    both = first.where(f"kind = {DONE}").unionByName(waiting.mapInArrow(finish, _SCHEMA))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return both.select("doc_id", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next")
