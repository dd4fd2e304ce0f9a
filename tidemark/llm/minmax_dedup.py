"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles. Documents with equal sets are one class, so that copies cost
nothing further. For each hash function, a class keeps the smallest and the largest hash of its set: two values of
its signature from one evaluation. Values are banded; classes that agree in a band are candidates, and a link
holds if the intersection of the full sets is at least threshold percent of their union.

Candidates are never all pairs of a bucket. First each class is compared with one class of its bucket; linked
classes then form components. What is left are pairs of a bucket whose components differ. Of these, only those
are compared that have enough in common by a bound: shingles that no other class of such a bucket has (an edit
makes some) can't be in an intersection, and bits in which two sets' parity bitmaps differ are hashes that only one of
them has. Of the classes of buckets with many such ones, only those meet that share one of their rarest
shingles (a prefix filter): a pair that is similar enough always does. The bounds drop no pair that is similar enough.

A bucket, a shingle or a class may hold any share of the rows. Wherever rows meet a table by such a key, the rows of
a frequent key are dealt to slices and the table's row is repeated for each, or stay where they are if the table has so few rows that it is broadcast (skew_join); where more than a slice of
rows of a bucket or a shingle meet each other, they are a grid of slices by slices. No task gets more than a few thousand rows of a key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, SLICE, Scratch, counted, ddl, free, frequent, map_batches, mix64, quoted, session_defaults, skew_join, texts, with_columns, written
from .components import components
from .words import NOT_SPACE, hashed

SHINGLE, THRESHOLD = 5, 80
#: Hash functions; each gives two values.
FUNCTIONS = 50
#: The chance at most that a pair at the threshold is no candidate.
MISS = 1e-5
#: Rows of a table that may be broadcast (8 bytes each); beyond that, it is joined by shuffle.
BROADCAST_ROWS = 1_000_000

#: 64-bit words of a set's bitmap: 1024 bits; a power of two of words.
PARITY = [f"parity_{i}" for i in range(16)]

_XOR = mix64(np.arange(FUNCTIONS) + 7000)
_ODD = mix64(np.arange(FUNCTIONS) + 9000) | np.uint64(1)


def rows_per_band(threshold: int, values: int = 2 * FUNCTIONS, miss: float = MISS) -> int:
    """The longest bands with which a pair at the threshold shares none with a chance of at most miss."""
    t = threshold / 100
    return max(r for r in range(1, values + 1) if r == 1 or (1 - t**r) ** (values // r) <= miss)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, in order; words are runs of characters other than ASCII white space, A-Z lower-cased."""
    return hashed([text], NOT_SPACE)[0]


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; of fewer than k words, the one of the whole sequence; of none, nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, len(words) if len(words) < k else k, np.uint64)
        for j in range(min(k, len(words))):
            h = h * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n]
        h = mix64(h)
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def band_keys(own: np.ndarray, rows: int) -> np.ndarray:
    """One key per band: of rows values of the signature, which has all minima first and then all maxima."""
    low, high = np.empty(FUNCTIONS, np.uint64), np.empty(FUNCTIONS, np.uint64)
    with np.errstate(over="ignore"):
        for start in range(0, len(own), 1 << 14):
            block = (own[None, start : start + (1 << 14)] ^ _XOR[:, None]) * _ODD[:, None]
            a, b = block.min(axis=1), block.max(axis=1)
            low, high = (a, b) if not start else (np.minimum(low, a), np.maximum(high, b))
        bands = 2 * FUNCTIONS // rows
        values = np.r_[low, high][: bands * rows].reshape(bands, rows)
        key = np.arange(bands, dtype=np.uint64)
        for j in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return key.view(np.int64)


def set_digest(own: np.ndarray) -> bytes:
    """A class's name, by which all documents with this set are one."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _describe(docs: DataFrame, k: int, rows: int) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, nodes, keys = [], [], []
        for text in texts(batch):
            own = shingles(text, k)
            n.append(len(own))
            nodes.append(set_digest(own) if len(own) else None)
            keys.append(band_keys(own, rows) if len(own) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "keys"])

    return map_batches(docs.select("doc_id", "text"), step, "doc_id bigint, n bigint, node binary, keys array<bigint>")


def _few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df (a written table), to be broadcast if it has so many rows at most: BROADCAST_ROWS (each a digest, and a long maybe), if not given."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if rows is None else rows) else df


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, own) for the wanted classes (node, doc_id): the full set of each, made again from a document's text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        nodes, sets = [], []
        for node, text in zip(batch.column("node").to_pylist(), texts(batch), strict=True):
            own = shingles(text, k)
            # another document may have the same doc_id
            if len(own) and (digest := set_digest(own)) == (node or digest):
                nodes.append(digest)
                sets.append(own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "own"])

    rows = map_batches(docs.select("doc_id", "text").join(_few(wanted.where("doc_id is not null")), "doc_id").select("node", "text"), step, "node binary, own binary")
    if not wanted.where("doc_id is null").limit(1).count():
        return rows.dropDuplicates(["node"])
    # of classes without any doc_id, the sets of all documents without one
    lost = docs.where("doc_id is null").select(F.lit(None).cast("binary").alias("node"), "text")
    nameless = map_batches(lost, step, "node binary, own binary").join(wanted.where("doc_id is null").select("node"), "node", "left_semi")
    return rows.unionByName(nameless).dropDuplicates(["node"])


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar enough. A class that is in many pairs has its set in each slice of them."""
    first, second = (frequent(counted(pairs, c), scratch) for c in ("u", "v"))
    own = sets.select(F.col("node").alias("u"), F.col("own").alias("a"))
    both = own.join(F.broadcast(pairs), "u") if first is None and pairs.count() <= FEW_ROWS else skew_join(pairs, own, "u", "v", first)
    both = skew_join(both, sets.select(F.col("node").alias("v"), F.col("own").alias("b")), "v", "u", second).select("u", "v", "a", "b")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            keep.append(100 * common >= threshold * (len(x) + len(y) - common))
        return batch.filter(pa.array(keep, pa.bool_())).select(["u", "v"])

    return scratch.written(map_batches(both, step, "u binary, v binary"), "dedup-links")


def _classes(described: DataFrame) -> DataFrame:
    """(node, doc_id, size, n, keys) of the classes of what _describe() gives; doc_id is the smallest, size the number of documents."""
    return described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("keys").alias("keys"))


def link_classes(docs: DataFrame, classes: DataFrame, k: int, threshold: int, scratch: Scratch) -> DataFrame:
    """(node, label) for all classes that are linked with another one; classes is what _classes() gives for docs, written."""
    keep = scratch.written
    bands = classes.select(F.explode("keys").alias("key"), "node", "n", "doc_id")
    # of each bucket, one class that all others are compared with; buckets of one class end here
    anchors = bands.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("node").alias("turn"), "node", "n")).alias("anchor")).where("size > 1")
    anchors = keep(anchors.select("key", "size", F.col("anchor.node").alias("other"), F.col("anchor.n").alias("other_n")), "dedup-anchors")
    # what is found for each bucket has as many rows at most
    few = anchors.count() <= FEW_ROWS
    hot = None if few else frequent(anchors.select("key", "size"), scratch)
    near = F.expr(f"100 * least(n, other_n) >= {threshold} * greatest(n, other_n)")
    shared = keep(skew_join(bands, anchors.drop("size"), "key", "node", hot, few=few), "dedup-buckets")
    ordered = [F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")]
    pairs = keep(shared.where(near & (F.col("node") != F.col("other"))).select(*ordered).distinct(), "dedup-pairs")
    buckets = shared.select("key", "node", "n")
    members = keep(shared.select("node", "doc_id").distinct(), "dedup-members")
    sets = keep(_sets(docs, members, k), "dedup-sets")
    labels = keep(components(_linked(pairs, sets, threshold, scratch), scratch), "dedup-stars")
    rows = keep(buckets.join(_few(labels, FEW_ROWS), "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")), "dedup-rows")
    apart = rows.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key")
    rows = keep(skew_join(rows, apart, "key", "node", hot, few=few), "dedup-apart")
    # what a class may have in common with any other one here: its shingles that another class here has too
    there = sets.join(_few(keep(rows.select("node").distinct(), "dedup-nodes")), "node", "left_semi")
    short = keep(map_batches(there, _tokens, "node binary, token array<int>"), "dedup-tokens")
    tokens = short.select("node", F.explode("token").alias("token"))
    common = keep(counted(tokens, "token").where("size > 1"), "dedup-common")
    several = common.count() <= BROADCAST_ROWS
    most = skew_join(tokens, common.select(F.col("key").alias("token")), "token", "node", None if several else frequent(common, scratch), few=several).groupBy("node").agg(F.count("*").alias("most"))
    rows = rows.join(most, "node").select("key", "node", "n", "label", F.least("most", "n").alias("most"))
    # a class that can't be similar enough to one of the shortest of its bucket, or of the best length, is done there
    bounds = rows.groupBy("key").agg(F.min("n").alias("shortest"))
    rows = skew_join(rows, bounds, "key", "node", hot, few=few).withColumn("best", F.greatest("most", "shortest")).where(f"100 * most >= {threshold} * (n + best - most)").select("key", "node", "n", "label", "most")
    rows = keep(rows, "dedup-open")
    # then with the class of the bucket that has the least of its own, as the middle of a group does
    middle = rows.groupBy("key").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "node", "n", "most", "label")).alias("m")).select("key", *(F.col(f"m.{c}").alias(f"other_{c}") for c in ("node", "n", "label", "most")))
    both_most = F.expr(f"100 * least(most, other_most) >= {threshold} * (n + other_n - least(most, other_most))")
    unlike = near & (F.col("label") != F.col("other_label")) & both_most
    pair = [F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v")]
    second = keep(skew_join(rows, middle, "key", "node", hot, few=few).where(unlike).select(*pair).distinct().join(_few(pairs, FEW_ROWS), ["u", "v"], "left_anti"), "dedup-pairs")
    more = _linked(second, sets, threshold, scratch)
    if more.limit(1).count():
        labels = keep(components(_as_links(labels).unionByName(more), scratch), "dedup-stars")
        rows = keep(rows.drop("label").join(_few(labels, FEW_ROWS), "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"), "most"), "dedup-open")
    tops = keep(_tops(rows), "dedup-tops")
    meet = skew_join(rows, tops, "key", "node", hot, few=few)
    if tops.where(F.col("size") > SLICE).limit(1).count():
        # of the classes of large buckets only those meet that share one of their rarest shingles, as every pair that
        # is similar enough does; they meet by shingle and not by bucket too, so that a pair of many buckets meets no more often
        large = tops.where(F.col("size") > SLICE).select("key")
        wide = keep(skew_join(rows, large, "key", "node", hot, few=few).select("node", "n", "label", "most").distinct(), "dedup-wide")
        theirs = short.join(wide, "node").select("node", "n", "label", "most", F.explode("token").alias("token"))
        wide = keep(_rarest(theirs, common, threshold, scratch).withColumnRenamed("token", "key"), "dedup-wide")
        places = keep(_tops(wide), "dedup-tops")
        many = places.count() > FEW_ROWS
        wide = skew_join(wide, places, "key", "node", frequent(places, scratch) if many else None, few=not many)
        meet = meet.where(F.col("size") <= SLICE).unionByName(wide)
    maps = map_batches(sets.join(_few(keep(rows.select("node").distinct(), "dedup-nodes")), "node", "left_semi"), _parities, f"node binary, {', '.join(f'{c} bigint' for c in PARITY)}")
    open_ = keep(meet.join(maps, "node"), "dedup-open")
    # where many meet nevertheless is a grid: each class is in one row of it and all columns on one side, and the other way round on the other side
    slices = F.ceil(F.col("size") / SLICE).cast("int")
    own, all_ = F.pmod(F.xxhash64("node"), slices).cast("int"), F.explode(F.sequence(F.lit(0), slices - 1))
    left = open_.where("label <> top").withColumn("row", own).withColumn("column", all_).drop("top", "size")
    others = open_.withColumn("column", own).withColumn("row", all_).select("key", "row", "column", *(F.col(c).alias(f"other_{c}") for c in ("node", "n", "label", "most", "top", *PARITY)))
    once = (F.col("other_label") == F.col("other_top")) | (F.col("node") < F.col("other_node"))
    found = left.join(others, ["key", "row", "column"]).where(unlike & once & _near_parity(threshold))
    fresh = found.select(*pair).distinct().join(_few(pairs, FEW_ROWS), ["u", "v"], "left_anti").join(_few(second, FEW_ROWS), ["u", "v"], "left_anti")
    more = _linked(keep(fresh, "dedup-pairs"), sets, threshold, scratch)
    if not more.limit(1).count():
        return labels
    return components(_as_links(labels).unionByName(more), scratch)


def _tops(rows: DataFrame) -> DataFrame:
    """Of each key with classes (key, node, label) of more than one label: the number of them, and the label that most have."""
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
    return parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("top")).where("parts > 1").select("key", "size", F.col("top.label").alias("top"))


def _rarest(tokens: DataFrame, common: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Of each set's tokens (node, n, most, token; more columns may be there), the rarest ones, of which two sets that are similar enough share one.

    Such sets have at least threshold percent of either in common. In one order for all sets, a set's tokens without
    the last ones, one fewer than that, hold the first one that they share. The order is by the number in common
    (key, size), so that tokens which no other set has come first; these are not in tokens with a match.
    """
    few = common.count() <= BROADCAST_ROWS
    ranked = skew_join(tokens, common.select(F.col("key").alias("token"), "size"), "token", "node", None if few else frequent(common, scratch), few=few)
    turn = F.row_number().over(Window.partitionBy("node").orderBy("size", "token"))
    return ranked.withColumn("turn", turn).where(f"turn <= most - ({threshold} * n + 99) div 100 + 1").select(*tokens.columns).distinct()


def _as_links(labels: DataFrame) -> DataFrame:
    return labels.select(F.col("node").alias("u"), F.col("label").alias("v"))


def _tokens(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Sets with 31 bits of each hash. Where two shingles look alike by that, a class only seems to have more in common."""
    short = [(np.frombuffer(x, np.uint64) >> np.uint64(33)).astype(np.int32) for x in batch.column("own").to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, pa.list_(pa.int32()))], names=["node", "token"])


def _parities(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Bitmaps of sets: each bit says whether an odd number of the set's hashes begin with the bit's number."""
    sets = [np.frombuffer(x, np.uint64) for x in batch.column("own").to_pylist()]
    shift, size = np.uint64(64 - (64 * len(PARITY)).bit_length() + 1), 64 * len(PARITY)
    odd = np.array([np.bincount((x >> shift).astype(np.int64), minlength=size) & 1 for x in sets], np.uint8)
    words = np.packbits(odd, axis=1).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(words[:, i]) for i in range(len(PARITY)))], names=["node", *PARITY])


def _near_parity(threshold: int) -> Column:
    """Can sets with these bitmaps be similar enough? Each bit that differs stands for a hash that only one of them has, so that no such pair is lost."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"other_{c}"))) for c in PARITY[1:]), F.bit_count(F.col(PARITY[0]).bitwiseXOR(F.col(f"other_{PARITY[0]}"))))
    return apart * (100 + threshold) <= (F.col("n") + F.col("other_n")) * (100 - threshold)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document of docs (doc_id, text).

    component_id is the smallest doc_id of the documents that are linked with this one, directly or through others,
    itself included; kept says that it is this document's. A document without words (null, empty, only white
    space) is linked with nothing: its component_id is its own doc_id. Rows of equal doc_id and text are all in one
    component, and a null doc_id never is the smallest while another one is there; if all are null, component_id is
    null and kept is true. An empty table gives no rows.
    """
    return _components(docs, k, threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _components(docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """doc_id, n, node, component_id and rep_node of every document, written; the tables on the way to it are deleted."""
    session_defaults(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = scratch.written(_describe(docs, k, rows_per_band(threshold)), "dedup-documents")
    classes = scratch.written(_classes(described), "dedup-classes")
    labels = scratch.written(link_classes(docs, classes, k, threshold, scratch), "dedup-labels")
    slim = described.select("doc_id", "n", "node")
    named = classes.join(_few(labels, FEW_ROWS), "node", "left").select("node", F.col("doc_id").alias("first"), F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("rep"))
    by_node = named.join(least, "label").select("node", F.col("rep.first").alias("component_id"), F.col("rep.node").alias("rep_node"))
    # a class may hold any share of the rows
    hot = frequent(classes.select(F.col("node").alias("key"), "size"), scratch)
    numbered = slim.where("node is not null").withColumn("turn", F.monotonically_increasing_id())
    out = skew_join(numbered, by_node, "node", "turn", hot).select("doc_id", "n", "node", "component_id", "rep_node")
    empty = slim.where("node is null").select("doc_id", "n", "node", F.col("doc_id").alias("component_id"), F.col("node").alias("rep_node"))
    found = written(out.unionByName(empty), "dedup-found")
    scratch.clear()
    return found


def drop_near_duplicates(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component of docs, with its own columns, whatever their names: one with the smallest doc_id.

    Of repeated rows, one stays. Documents without words all stay.
    """
    found = _components(docs, k, threshold)
    (own_node,) = free(docs, "dedup_node")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("node").eqNullSafe(F.col("rep_node"))
    repeated = written(found.where(stays & F.col("node").isNotNull()).groupBy("doc_id", "node").agg(F.count("*").alias("n_rows")).where("n_rows > 1").select("doc_id", "node"), "dedup-repeated")
    gone = _few(written(found.where(~stays).select("doc_id", "node").distinct(), "dedup-gone"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x, k) for x in texts(batch)]
        return with_columns(batch, **{own_node: pa.array([set_digest(x) if len(x) else None for x in sets], pa.binary())})

    own = map_batches(docs, step, ddl(docs, f"`{own_node}` binary"))
    meets = lambda other: own["doc_id"].eqNullSafe(other["doc_id"]) & own[own_node].eqNullSafe(other["node"])
    left = own.join(gone, meets(gone), "left_anti")
    if repeated.limit(1).count():
        again = left.join(repeated, meets(repeated), "left_semi").dropDuplicates(["doc_id", own_node])
        left = left.join(repeated, meets(repeated), "left_anti").unionByName(again)
    return left.select(*quoted(docs))
