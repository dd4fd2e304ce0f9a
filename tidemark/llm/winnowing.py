"""Benchmark decontamination by winnowing.

A window is a run of words of a benchmark item. In every window of a text, the k-gram with the smallest hash is
kept as a fingerprint. Whatever a document and an item share over a whole window, they have the same window, which
keeps the same k-gram on both sides: no shared window is missed. Fingerprints of both sides are joined, and a hit is
extended to the windows that chose this k-gram, each of which is looked for among the items' windows.

Items shorter than a window are one window each; they have fingerprints of their own by their length, of which there
are fewer than the words of a window.

No pair of a document and an item is made: documents meet distinct fingerprints and distinct windows (one row each),
windows name the group of items that have them by an additive hash, and items are listed once for each set of groups
that some document has. Texts that are equal are one text. The only things that every task gets are the lengths of
windows and a bitmap of the items' fingerprints of MOST_BITS at most; with more fingerprints it lets more through to
the join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, counted, free, frequent, map_batches, quoted, session_defaults, skew_join, texts, written
from .words import ALPHANUMERIC, grams, hashed

WINDOW = 10
LEAST_BITS, MOST_BITS = 16, 27
#: The second place of a fingerprint in the bitmap begins at this bit.
SECOND = 27
#: Bits of the bitmap for each fingerprint.
SPARSE = 16
#: Texts of so many characters are worked on together; windows of a block.
TOGETHER, BLOCK = 1 << 20, 1 << 16
#: Rows (a few hashes each) of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000


def gram_size(window: int) -> int:
    """The k of a window's k-grams: as many k-grams in a window as words in a k-gram, or one more."""
    return (window + 1) // 2


def winnow(words: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window inside a row: where it starts, where the k-gram is that it keeps (the first of equals), and the fingerprint."""
    k, out = gram_size(window), []
    for a in range(0, len(words) - window + 1, BLOCK):
        h = words[a : a + BLOCK + window - 1]
        g, n = grams(h, k), len(h) - window + 1
        best, at = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, window - k + 1):
            less = g[j : j + n] < best
            best[less], at[less] = g[j : j + n][less], j
        start = np.flatnonzero(row[a : a + n] == row[a + window - 1 : a + window - 1 + n])
        out.append((a + start, a + start + at[start], best[start]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start, at, best = (np.concatenate(x) for x in zip(*out, strict=True))
    return start, at, grams(best, 1) ^ np.uint64(window)


def _groups(batch_texts: list[str]) -> list[tuple[int, list[str]]]:
    """Neighbouring texts of TOGETHER characters in all, or a longer one by itself, with the number of the first."""
    out, size = [], 0
    for i, t in enumerate(batch_texts):
        if not out or size + len(t) > TOGETHER:
            out.append((i, []))
            size = 0
        out[-1][1].append(t)
        size += len(t)
    return out


def _item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """item (its id as a text), n, fp and gram of every window of every item."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, cols = batch.column("item"), [[], [], [], []]
        for first, some in _groups(texts(batch)):
            words, row = hashed(some, ALPHANUMERIC)
            size = np.bincount(row, minlength=len(some))
            for n in range(1, window + 1):
                own = np.flatnonzero(size[row] == n) if n < window else np.flatnonzero(size[row] >= window)
                h, r = words[own], row[own]
                start, _, fp = winnow(h, r, n)
                for c, x in zip(cols, (first + r[start], np.full(len(start), n), fp, grams(h, n, start)), strict=True):
                    c.append(x)
        at, n, fp, gram = (np.concatenate(c) for c in cols)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(n, pa.int32()), pa.array(fp.view(np.int64)), pa.array(gram.view(np.int64))], names=["item", "n", "fp", "gram"])

    return map_batches(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text")), step, "item string, n int, fp bigint, gram bigint")


def _places(fp: Column, bits: int) -> list[Column]:
    """The two places of a fingerprint in the bitmap: its highest bits, and those from SECOND on."""
    return [F.shiftrightunsigned(fp, 64 - bits), F.shiftrightunsigned(F.shiftleft(fp, SECOND), 64 - bits)]


def _bitmap(fps: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """The bitmap of n fingerprints, as 64-bit words, and the number of bits of a place. Words are put together by Spark; 2**21 of them come to the driver at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, (SPARSE * n - 1).bit_length()))
    place = F.explode(F.array(*_places(F.col("fp"), bits)))
    words = fps.select(place.alias("p")).groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out, bits


def _in_bitmap(fp: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    there = np.ones(len(fp), bool)
    for shift in (0, SECOND):
        p = (fp << np.uint64(shift)) >> np.uint64(64 - bits)
        there &= ((bitmap[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)
    return there


_GRAMS = "array<struct<n: int, start: int, fp: bigint, grams: array<bigint>>>"


def _scan(docs: DataFrame, windows: list[int], bitmap: Broadcast, bits: int) -> DataFrame:
    """doc_id, n_words, key (a digest of the text; null without fingerprints of an item) and its fingerprints: of each, the windows in a row that chose it, as hashes."""
    kind = pa.list_(pa.struct([("n", pa.int32()), ("start", pa.int32()), ("fp", pa.int64()), ("grams", pa.list_(pa.int64()))]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_, sizes, keys, counts, parts = texts(batch), [], [], [], []
        for _, some in _groups(all_):
            words, row = hashed(some, ALPHANUMERIC)
            sizes.append(np.bincount(row, minlength=len(some)))
            first = np.r_[0, np.cumsum(sizes[-1])]
            per, found = np.zeros(len(some), np.int64), []
            for n in windows:
                start, at, fp = winnow(words, row, n)
                there = _in_bitmap(fp, bitmap.value, bits)
                start, at, fp = start[there], at[there], fp[there]
                begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
                found.append((row[start[begin]], np.full(len(begin), n), start[begin] - first[row[start[begin]]], fp[begin], np.diff(np.r_[begin, len(start)]), grams(words, n, start)))
            if found:
                r, n, s, fp, size = (np.concatenate([f[i] for f in found]) for i in range(5))
                order, whole = np.argsort(r, kind="stable"), np.concatenate([f[5] for f in found])
                ends = np.cumsum(size)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(whole.view(np.int64)))
                rows = pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(s, pa.int32()), pa.array(fp.view(np.int64)), lists], fields=list(kind.value_type))
                parts.append(rows.take(pa.array(order)))
                per += np.bincount(r, minlength=len(some))
            counts.append(per)
        n_found = np.concatenate(counts)
        keys = [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if n else None for t, n in zip(all_, n_found, strict=True)]
        flat = pa.concat_arrays(parts) if parts else pa.array([], kind.value_type)
        nested = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_found)], pa.int32()), flat)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes), pa.int64()), pa.array(keys, pa.binary()), nested], names=["doc_id", "n_words", "key", "found"])

    return map_batches(docs, step, f"doc_id bigint, n_words bigint, key binary, found {_GRAMS}")


def _meet(rows: DataFrame, table: DataFrame, key: str, spread: str, scratch: Scratch) -> DataFrame:
    """rows joined with a written table of one row for each key: it is broadcast if it is small, else rows of frequent keys are dealt to slices. rows is read twice."""
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key)
    return skew_join(rows, table, key, spread, frequent(counted(rows, key), scratch))


def _set_name(*cols: str) -> Column:
    """A name of the set of the group's values, from sums that don't depend on their order. Null values don't count; a set of none has no name."""
    x = [F.bit_xor(F.when(F.col(cols[0]).isNotNull(), F.xxhash64(*cols, F.lit(seed)))) for seed in (1, 2)]
    return F.when(F.count(cols[0]) > 0, F.md5(F.concat_ws(".", F.count(cols[0]), *x).cast("binary")))


def find(docs: DataFrame, items: DataFrame, window: int, scratch: Scratch, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: doc_id, n_words and key of every document; key, start and end (in words) of the runs of hit words in each text; key, n_items and items_sha256."""
    session_defaults(docs.sparkSession)
    keep = scratch.written
    owned = keep(_item_windows(items, window, item_id, text), "leaks-items")
    windows = sorted(r["n"] for r in owned.select("n").distinct().collect())  # window rows at most
    fps = keep(owned.select("fp").distinct(), "leaks-fingerprints")
    bitmap, bits = _bitmap(fps, fps.count())
    scanned = keep(_scan(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), windows, docs.sparkSession.sparkContext.broadcast(bitmap), bits), "leaks-documents")
    texts_ = scanned.where("key is not null").groupBy("key").agg(F.first("found").alias("found"))
    marked = keep(texts_.select("key", F.explode("found").alias("x")).select("key", "x.*"), "leaks-candidates")
    joined = keep(_meet(marked, fps, "fp", "key", scratch).select("key", "n", "start", F.posexplode("grams").alias("i", "gram")).select("key", "n", (F.col("start") + F.col("i")).alias("start"), "gram"), "leaks-windows")
    items_of = keep(owned.select("gram", "item").distinct(), "leaks-owners")
    groups = keep(items_of.groupBy("gram").agg(_set_name("item").alias("members")), "leaks-groups")
    hits = keep(_meet(joined, groups, "gram", "key", scratch).select("key", "n", "start", "members"), "leaks-hits")

    # windows that touch or overlap are one run; a text's rows are no more than its words
    w = Window.partitionBy("key").orderBy("start")
    ends = hits.groupBy("key", "start").agg(F.max(F.col("start") + F.col("n")).alias("end"))
    fresh = ends.withColumn("new", F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("new").over(w)).groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")

    pairs = keep(hits.where("members is not null").select("key", "members").distinct(), "leaks-members")
    sets = keep(pairs.groupBy("key").agg(_set_name("members").alias("name")), "leaks-sets")
    one = sets.groupBy("name").agg(F.min("key").alias("key"))
    of_group = groups.where("members is not null").groupBy("members").agg(F.min("gram").alias("gram")).join(items_of, "gram").where("item is not null").select("members", "item")
    named = pairs.join(one, "key").select("name", "members").join(of_group, "members").select("name", "item").distinct()
    lists = keep(named.groupBy("name").agg(F.count("*").alias("n_items"), F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list("item")), ","), "UTF-8"), 256).alias("items_sha256")), "leaks-lists")
    return scanned.select("doc_id", "n_words", "key"), runs, _meet(sets, lists, "name", "key", scratch).drop("name")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document of docs (doc_id, text), against items (item_id, text).

    A word is hit if it is inside an occurrence of a window of some item. items_sha256 is of the ids of the items with
    an occurring window, sorted as strings and joined by commas; of no item, of the empty string. The list of one
    document's items is put together in one place, as its digest needs it. A null or empty text has no words, and
    an item without words has no window. Repeated items count once; an item without an id hits words, but is not
    listed. Repeated documents each get their row. Of an empty table of items, nothing is hit.
    """
    scratch = Scratch(docs.sparkSession)
    scanned, runs, items_ = find(docs, items, window, scratch, item_id)
    hit = runs.groupBy("key").agg(F.sum(F.col("end") - F.col("start")).cast("bigint").alias("n_hit"))
    by_text = scratch.written(hit.join(items_, "key", "left"), "leaks-texts")
    turn = scanned.where("key is not null").withColumn("turn", F.monotonically_increasing_id())
    rows = turn.join(F.broadcast(by_text), "key", "left") if by_text.count() <= BROADCAST_ROWS else skew_join(turn, by_text, "key", "turn", frequent(counted(turn, "key"), scratch), "left")
    rows = rows.unionByName(scanned.where("key is null"), allowMissingColumns=True)
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("bigint")), F.sha2(F.lit("").cast("binary"), 256)
    found = rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
    out = written(found, "leaks-found")
    scratch.clear()
    return out


def hit_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_id: str = "item_id") -> DataFrame:
    """doc_id, start and end: the runs of hit words of each document, as numbers of words from 0, without the end. Repeated rows have theirs once each."""
    scratch = Scratch(docs.sparkSession)
    scanned, runs, _ = find(docs, items, window, scratch, item_id)
    turn = scanned.where("key is not null").withColumn("turn", F.monotonically_increasing_id())
    # texts with hits by their digest: dealt to slices where copies are many
    listed = scratch.written(runs.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "leaks-runs")
    out = written(_meet(turn.select("doc_id", "key", "turn"), listed, "key", "turn", scratch).select("doc_id", F.explode("runs").alias("r")).select("doc_id", "r.start", "r.end"), "leaks-spans")
    scratch.clear()
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_percent: int = 0, item_id: str = "item_id") -> DataFrame:
    """The documents of docs, with their own columns, of whose words at most so many percent are hit. Rows of equal doc_id each need to be so."""
    found = contamination(docs, items, window, item_id)
    bad = found.where(f"100 * n_hit > {most_percent} * n_words").select(F.col("doc_id").alias("leak_id")).distinct()
    (own,) = free(docs, "leak_id")
    bad = bad.withColumnRenamed("leak_id", own)
    return docs.join(bad, docs["doc_id"].cast("bigint").eqNullSafe(bad[own]), "left_anti").select(*quoted(docs))
