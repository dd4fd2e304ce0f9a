"""Mixing sources to target weights along a curriculum.

A source's weight changes over training: w(t) = target * (1 - a + 2 a t) for t from 0 to 1, with a slope a of its
own between -1 and 1. The integral of w up to t is what the mix has taken from the source by then, and its inverse
gives each document, by the words that stand before it in the source's stream, its position in training. Sorting
by position puts all sources in their order.

A source's stream is its documents in a fixed pseudo-random order, again and again until the target is met; mix()
counts the words up to there, and mixed_documents() takes the last document whole if half of it or more lies before. The words before a document are a sum over its source, which may hold any share of
all rows: the source is cut into about sqrt(n) buckets of the pseudo-random order, whose sums are added first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_text, quoted, without, written

#: Fixed values of the contract.
WEIGHTS, MOST_REPEATS = (5, 2, 1), 3
#: Slopes of the sources' weights over training, repeating.
SLOPES = (-0.5, 0.5, 0.0)
#: A mix is a plan for so many sources at most; what is summed by source comes to the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Share:
    source: str | None
    size: int
    n_docs: int
    target: float
    slope: float


def targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[float]:
    """Shares of the sum of sizes by weight, none above most times its size; what is too much goes to the others by weight."""
    rest, out, open_ = sum(sizes), [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if rest * weights[i] > most * sizes[i] * total]
        if not full:
            for i in open_:
                out[i] = rest * weights[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
        rest -= sum(most * sizes[i] for i in full)
        done = set(full)
        open_ = [i for i in open_ if i not in done]
    return out


def sized(docs: DataFrame, size: str = "size", order: str = "mix_order") -> DataFrame:
    """docs with the number of words of each text (null: 0), and the place in the pseudo-random order (28 bits of a hash of doc_id, or of the text where that is null)."""
    place = F.conv(F.substring(F.md5(F.encode(F.coalesce(id_text(), "text"), "UTF-8")), 1, 7), 16, 10).cast("bigint")
    return docs.withColumns({size: F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")), order: F.coalesce(place, F.lit(0).cast("bigint"))})


def plan(docs: DataFrame, size: str = "size") -> list[Share]:
    """The sources' shares: sources in order of code points, null last, with WEIGHTS in turn."""
    rows = docs.groupBy("source").agg(F.sum(size).alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    found = targets([r["size"] for r in rows], [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))])
    return [Share(r["source"], r["size"], r["n"], t, SLOPES[i % len(SLOPES)]) for i, (r, t) in enumerate(zip(rows, found, strict=True))]


NEW = ("source_size", "target", "taken", "mix_slope", "mix_before")


def take(docs: DataFrame, shares: list[Share], size: str = "size", order: str = "mix_order") -> DataFrame:
    """docs (as sized() returns them) with source_size, target, taken, mix_slope and mix_before after their columns.

    taken: the words that the mix takes, repeats counted, at most MOST_REPEATS times the size. mix_before: the words
    before the document in one pass over its source. Documents without words take nothing. Rows of equal doc_id
    come in order of size and text; repeated rows share their words in either order. Columns of docs with one of the
    new names are replaced; other names that begin with mix_ are the operator's own.
    """
    spark = docs.sparkSession
    docs = without(docs, *NEW)
    rows = [
        (i, x.source, x.size, x.target, x.slope, max(1, math.isqrt(x.n_docs)), int(x.target // x.size) if x.size else 0, round(x.target - x.target // x.size * x.size) if x.size else 0)
        for i, x in enumerate(shares)
    ]
    small = spark.createDataFrame(rows, "mix_no int, mix_source string, source_size bigint, target double, mix_slope double, mix_buckets bigint, mix_whole bigint, mix_rest bigint")
    # at most MAX_SOURCES rows
    with_share = docs.join(F.broadcast(small), docs["source"].eqNullSafe(small["mix_source"])).withColumn("mix_bucket", F.expr(f"({order} * mix_buckets) div (1 << 28)"))
    sums = with_share.groupBy("mix_no", "mix_bucket").agg(F.sum(size).alias("mix_sum"))
    before = sums.select("mix_no", "mix_bucket", (F.sum("mix_sum").over(Window.partitionBy("mix_no").orderBy("mix_bucket")) - F.col("mix_sum")).alias("mix_start"))
    inside = Window.partitionBy("mix_no", "mix_bucket").orderBy(order, "doc_id", size, *(["text"] if "text" in docs.columns else []))
    out = with_share.join(before, ["mix_no", "mix_bucket"]).withColumn("mix_before", F.col("mix_start") + F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    part = F.greatest(F.lit(0).cast("bigint"), F.least(F.col(size), F.col("mix_rest") - F.col("mix_before")))
    return out.withColumn("taken", F.col(size) * F.col("mix_whole") + part).select(*quoted(docs), *NEW)


def position(copy: str | None = None):
    """When a copy (0 for the first) of a document of take() has its turn, from 0 to 1: the inverse of the integral of its source's weight."""
    done = F.col("mix_before") + (F.col(copy) * F.col("source_size") if copy else F.lit(0))
    share, a = F.least(F.lit(1.0), done / F.col("target")), F.col("mix_slope")
    return 2 * share / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * share))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and position (of the first copy; null if nothing is taken) of every document.

    Rows come in order of position, over all partitions, as the documents of the mix do; what isn't taken comes last.
    A null source is a source of its own.
    """
    slim = written(sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", "mix_order"), "mix-sizes")
    found = take(slim, plan(slim)).withColumn("at", F.when(F.col("taken") > 0, position()))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_last("at"), "mix_order", "doc_id"]
    ordered = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "size", "source_size", "target", "taken", F.round("at", 9).alias("position"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix in order of position, with their own columns, whatever their names: a row for each copy.

    Documents come whole, so that a source's words miss its target by half a document at most. Documents without
    words, and those of which less than half is taken, are left out.
    """
    rows = sized(docs.select("doc_id", "source", "text", F.struct(*quoted(docs)).alias("mix_row")))
    found = take(rows, plan(rows)).where("size > 0")
    part = F.col("taken") % F.col("size")
    times = F.expr("taken div size") + F.when(2 * part >= F.col("size"), F.when(part > 0, 1).otherwise(0)).otherwise(0)
    copies = found.withColumn("mix_times", times.cast("int")).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_times") - 1)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = copies.withColumn("mix_position", position("mix_copy")).repartitionByRange(n, "mix_position", "mix_order").sortWithinPartitions("mix_position", "mix_order", "doc_id")
    return ordered.select("mix_row.*")
