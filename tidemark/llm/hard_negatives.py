"""Hard negatives by exact search in inverted lists of k-means clusters.

Each row belongs to the list of its nearest centroid, and each list has a radius, the largest distance of one of its
rows from the centroid. By Cauchy and Schwarz the inner product of an anchor a with any row of a list lies within
a.c -+ |a| r. An anchor first visits the few lists with the highest upper bound (the probe). The k-th best score
found there can only rise; so the lists that are left are visited in a second pass if their bound doesn't fall
strictly below it (rows that tie with the k-th are needed), and lists that lie outside an anchor's window of scores
are skipped. Results are those of a full search.

The index is a table sorted by list and dealt to tasks by ranges, so that a list of any size is spread over tasks.
Anchors are a table of the shared folder, too: a task holds a chunk of the index and reads the anchors through, block
by block, so that neither passes through the driver or has to fit into a task. What every task gets are the centroids
and radii, MOST_CLUSTERS at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_batches, mix64, session_defaults, written
from .files import open_input

#: Fixed values of the contract: scale of the components; numbers of positives and negatives; the window of a negative's score in percent of the positive's.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
#: k-means sees so many rows at most, those with the smallest hash of their id, and has the square root of the number of all rows as clusters, within bounds.
SAMPLE_ROWS, MOST_CLUSTERS, ROUNDS = 16_384, 512, 8
#: Lists that an anchor visits first.
PROBE = 4
#: Rows of the index that a task holds at a time; anchors of a block; rows that meet a block at a time.
CHUNK, BLOCK, CELL = 1 << 15, 512, 1 << 12
#: Scores stay below this, so that doubles hold them exactly and a score and a place fit into 64 bits.
MOST_SCORE = 1 << 50
_NONE = np.iinfo(np.int64).min


def _matrix(cells: list[bytes]) -> np.ndarray:
    """Vectors (binary, 32-bit integers) as rows of doubles; shorter ones are filled up with zeros."""
    wide = max((len(c) for c in cells), default=0) // 4
    return np.array([np.frombuffer(c.ljust(4 * wide, b"\0"), "<i4") for c in cells], float).reshape(len(cells), wide)


def _fit(x: np.ndarray, wide: int) -> np.ndarray:
    return x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1])))


def scaled_rows(rows: DataFrame, vec_id: str, label: str, vector: str, anchor: Column) -> DataFrame:
    """vec_id, label, vec (binary) and anchor of the rows that take part: with an id, a label and a vector without null or non-finite components."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    some = rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & finite)
    some = some.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), x.cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec = []
        for v in batch.column("x"):
            v = np.floor(SCALE * np.asarray(v.values.to_numpy(zero_copy_only=False), float))
            most = math.isqrt(MOST_SCORE // max(1, len(v)))
            vec.append(np.clip(v, -most, most).astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(vec, pa.binary()), batch.column("anchor")], names=["vec_id", "label", "vec", "anchor"])

    return map_batches(some, step, "vec_id bigint, label bigint, vec binary, anchor boolean")


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1) if len(x) else np.zeros(0, np.int64)


def fit_centroids(rows: DataFrame, n: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from evenly dealt rows of a sample of SAMPLE_ROWS, which comes to the driver."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE_ROWS).select("vec").toArrow()
    x = _matrix(sample.column("vec").to_pylist())
    k = max(1, min(MOST_CLUSTERS, math.isqrt(n), len(x)))
    if not len(x):
        return np.zeros((1, 0))
    centroids = x[np.argsort(mix64(np.arange(len(x))), kind="stable")[:k]].copy()
    for _ in range(ROUNDS):
        at = _nearest(x, centroids)
        sums, sizes = np.zeros_like(centroids), np.bincount(at, minlength=k)
        np.add.at(sums, at, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def _indexed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with their list and the distance from its centroid, for which longer vectors than the centroids' count as well."""
    kept = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_CLUSTERS rows at most

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, c = _matrix(batch.column("vec").to_pylist()), kept.value
        wide = max(x.shape[1], c.shape[1])
        x, c = _fit(x, wide), _fit(c, wide)
        at = _nearest(x, c)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(np.sqrt(((x - c[at]) ** 2).sum(1)))], names=[*batch.schema.names, "list", "away"])

    return map_batches(rows, step, "vec_id bigint, label bigint, vec binary, anchor boolean, list int, away double")


class Bounds:
    """What an anchor's score with any row of a list lies between; a little wider than by the doubles."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray):
        self.centroids, self.radii = centroids, radii

    def __call__(self, x: np.ndarray, lists: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        wide = max(x.shape[1], self.centroids.shape[1])
        c, r = _fit(self.centroids[lists], wide), self.radii[lists]
        size = np.sqrt((x**2).sum(1))[:, None]
        middle, spread = _fit(x, wide) @ c.T, size * r[None, :]
        margin = 1e-9 * (size * np.sqrt((c**2).sum(1))[None, :] + spread) + 1e-3
        return middle - spread - margin, middle + spread + margin


def _best(scores: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, score, id) of each row's k best among ok; columns come in order of id, so that equal scores go to the smaller one."""
    width = scores.shape[1]
    some = np.flatnonzero(ok.any(axis=1))
    # score and place in one number: CELL places, and scores below MOST_SCORE
    both = np.where(ok[some], scores[some].astype(np.int64) * CELL + (CELL - 1 - np.arange(width)), _NONE)
    if width > k:
        at = np.argpartition(both, width - k, axis=1)[:, width - k :]
        both = np.take_along_axis(both, at, axis=1)
    else:
        at = np.broadcast_to(np.arange(width), both.shape)
    r, c = np.nonzero(both > _NONE)
    place = at[r, c]
    return some[r], scores[some[r], place].astype(np.int64), ids[place]


def _anchor_blocks(files: list[str], columns: list[str]) -> Iterator[pa.RecordBatch]:
    for f in files:
        with open_input(f) as stream:
            yield from pq.ParquetFile(stream).iter_batches(BLOCK, columns=columns)


def _search(index: DataFrame, anchors: DataFrame, bounds: Bounds, windows: bool, probe: bool, k: int) -> DataFrame:
    """anchor_key, place, vec_id and score of the best rows of each chunk of the index for each anchor; of positives, or of negatives in each window.

    anchors is a written table: anchor_key, vec_id, label, vec, probe (lists) and, for positives, least (a score below
    which nothing is needed); for negatives, arrays of the windows' low and high ends and least.
    """
    files = sorted(anchors.inputFiles())
    kept = index.sparkSession.sparkContext.broadcast(bounds)
    columns = ["anchor_key", "vec_id", "label", "vec", "probe", "least", *(["low", "high"] if windows else [])]

    def cells(chunk: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        lists, ids, labels = (chunk.column(c).to_numpy() for c in ("list", "vec_id", "label"))
        vec = chunk.column("vec").to_pylist()
        order = np.lexsort((ids, lists))
        cut = np.flatnonzero(np.r_[True, lists[order][1:] != lists[order][:-1], True])
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            for i in range(a, b, CELL):
                own = order[i : min(b, i + CELL)]
                yield int(lists[own[0]]), ids[own], labels[own], _matrix([vec[j] for j in own])

    def search(chunk: pa.Table) -> Iterator[pa.RecordBatch]:
        own = list(cells(chunk))
        there = np.array([c[0] for c in own])
        for block in _anchor_blocks(files, columns):
            x, keys = _matrix(block.column("vec").to_pylist()), block.column("anchor_key").to_numpy()
            ids, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
            below, above = kept.value(x, there)
            probes = block.column("probe")
            first = np.zeros((len(x), len(kept.value.radii)), bool)
            first[np.repeat(np.arange(len(x)), probes.value_lengths().to_numpy()), probes.flatten().to_numpy()] = True
            if windows:
                ends = [np.array([v + [None] * (POSITIVES - len(v)) for v in block.column(c).to_pylist()], float).reshape(len(x), POSITIVES) for c in ("low", "high", "least")]
                low, high = np.fmax(ends[0], ends[2]), ends[1]
            else:
                low, high = block.column("least").to_numpy(zero_copy_only=False)[:, None], np.full((len(x), 1), np.inf)
            found: list[tuple] = []
            for i, (at, row_ids, row_labels, rows) in enumerate(own):
                # a missing window is not a number, and nothing compares with it
                needed = ((low <= high) & (above[:, i, None] >= low) & (below[:, i, None] <= high)).any(axis=1) & (first[:, at] == probe)
                a = np.flatnonzero(needed)
                if not len(a):
                    continue
                wide = max(x.shape[1], rows.shape[1])
                scores = _fit(x[a], wide) @ _fit(rows, wide).T
                same = labels[a][:, None] == row_labels[None, :]
                other = ~same if windows else same & (ids[a][:, None] != row_ids[None, :])
                for w in range(low.shape[1]):
                    r, s, v = _best(scores, other & (scores >= low[a, w][:, None]) & (scores <= high[a, w][:, None]), row_ids, k)
                    found.append((keys[a[r]], np.full(len(r), w), v, s))
            if found:
                key, w, v, s = (np.concatenate(f) for f in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(w.astype(np.int32)), pa.array(v), pa.array(s)], names=["anchor_key", "place", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from search(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from search(pa.Table.from_batches(held))

    return index.select("list", "vec_id", "label", "vec").mapInArrow(run, "anchor_key bigint, place int, vec_id bigint, score bigint")


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and place, with their rank from 1; Spark cuts each task's rows to k before they are shuffled."""
    w = Window.partitionBy("anchor_key", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the rows for which anchor is true.

    A component x counts as floor(SCALE * x), and a score is the inner product of such vectors. A positive is one of
    the anchor's best rows of its label; a negative, one of the best rows of another label with
    low * positive <= 100 * negative <= high * positive. Equal scores go to the smaller id. Rows with a null id, label or
    vector or a null or non-finite component take no part. A row is no positive of an anchor with its id. Repeated rows
    count each time, but a repeated anchor once. Vectors of different lengths are filled up with zeros. Components are
    cut where scores could pass 2**50 (beyond 16384 for 64 of them). An anchor without positives, or a positive without negatives, has no row.
    """
    spark = rows.sparkSession
    session_defaults(spark)
    scratch = Scratch(spark)
    keep = scratch.written
    base = keep(scaled_rows(rows, vec_id, label, vector, anchor), "negatives-rows")
    n = base.count()
    centroids = fit_centroids(base, n)
    placed = _indexed(base, centroids)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["list", F.xxhash64("vec_id"), "vec_id"]
    index = keep(placed.repartitionByRange(parts, *order).sortWithinPartitions("list", "vec_id"), "negatives-index")
    radii = np.zeros(len(centroids))
    for r in index.groupBy("list").agg(F.max("away").alias("r")).collect():  # MOST_CLUSTERS rows at most
        radii[r["list"]] = r["r"]
    bounds = Bounds(centroids, radii * (1 + 1e-9))

    seeded = spark.sparkContext.broadcast(bounds)

    def probes(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, above = seeded.value(_matrix(batch.column("vec").to_pylist()))
        first = np.argsort(-above, axis=1, kind="stable")[:, :PROBE].astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(first), pa.list_(pa.int32()))], names=[*batch.schema.names, "probe"])

    asked = base.where("anchor").select("vec_id", "label", "vec").distinct()
    asked = asked.select(F.xxhash64("vec_id", "label", "vec").alias("anchor_key"), "vec_id", "label", "vec")
    anchors = keep(map_batches(asked, probes, "anchor_key bigint, vec_id bigint, label bigint, vec binary, probe array<int>").withColumn("least", F.lit(float("-inf"))), "negatives-anchors")
    near = keep(_top(_search(index, anchors, bounds, False, True, positives), positives), "negatives-near")
    least = near.where(F.col("rank") == positives).select("anchor_key", F.col("score").cast("double").alias("reached"))
    again = keep(anchors.join(least, "anchor_key", "left").withColumn("least", F.coalesce("reached", "least")).drop("reached"), "negatives-anchors")
    rest = _search(index, again, bounds, False, False, positives)
    best = keep(_top(near.drop("rank").unionByName(rest), positives).select("anchor_key", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")

    # integers s with low * p <= 100 * s <= high * p
    floor = lambda x: F.expr(f"({x} - pmod({x}, 100)) div 100")
    each = best.select("anchor_key", "place", (-floor(f"(-positive_score * {low})")).cast("double").alias("low"), floor(f"(positive_score * {high})").cast("double").alias("high"))
    arrays = each.groupBy("anchor_key").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # as many as positives
    opened = anchors.drop("least").join(arrays.select("anchor_key", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "anchor_key")
    opened = keep(opened.withColumn("least", F.transform("low", lambda x: F.lit(float("-inf")))), "negatives-anchors")
    near = keep(_top(_search(index, opened, bounds, True, True, negatives), negatives), "negatives-near")
    reached = near.where(F.col("rank") == negatives).groupBy("anchor_key").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("score").cast("double")))).alias("reached"))
    again = opened.join(reached, "anchor_key", "left").withColumn("least", F.transform("low", lambda x, i: F.coalesce(F.try_element_at("reached", i), F.lit(float("-inf")))))
    rest = _search(index, keep(again.drop("reached"), "negatives-anchors"), bounds, True, False, negatives)
    last = _top(near.drop("rank").unionByName(rest), negatives)
    names = anchors.select("anchor_key", F.col("vec_id").alias("anchor_id"))
    out = written(last.join(best, ["anchor_key", "place"]).join(names, "anchor_key").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-found")
    scratch.clear()
    return out
