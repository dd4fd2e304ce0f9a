"""Null distributions of a return series: replications are rows, and every draw has a number of its own.

The generator's n-th draw depends on seed and n only, so that Spark makes the draws in any order on any executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

#: Returns of one series at most; so it can be broadcast.
MAX_RETURNS = 1_000_000
WORD = 0xFFFFFFFF
#: Fixed value: the step of the public-domain generator mulberry32.
GOLDEN = 0x6D2B79F5


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, by halves, so that no product leaves 64 bits."""
    high = a * F.shiftrightunsigned(b, 16)
    return (a * b.bitwiseAND(0xFFFF) + F.shiftleft(high.bitwiseAND(0xFFFF), 16)).bitwiseAND(WORD)


def draw(seed: int, number: Column) -> Column:
    """The number-th draw (from 0) of mulberry32, from 0 to less than 1."""
    x = (F.lit(seed) + (number.cast("bigint") + 1) * GOLDEN).bitwiseAND(WORD)
    x = _times(x.bitwiseXOR(F.shiftrightunsigned(x, 15)), x.bitwiseOR(F.lit(1)))
    x = x.bitwiseXOR((x + _times(x.bitwiseXOR(F.shiftrightunsigned(x, 7)), x.bitwiseOR(F.lit(61)))).bitwiseAND(WORD))
    return x.bitwiseXOR(F.shiftrightunsigned(x, 14)) / float(WORD + 1)


def block_bootstrap(spark: SparkSession, series: DataFrame, replications: int, block: int, seed: int) -> DataFrame:
    """replication, place, value: the centred series (i from 0, r), drawn anew in circular blocks of fixed length."""
    if not (32 <= replications <= 10_000 and 1 <= block <= 100_000 and 1 <= seed <= WORD):
        raise ValueError("32 to 10,000 replications, blocks of 1 to 100,000 and a 32-bit seed")
    total = series.agg(F.count("*").alias("n"), F.avg("r").alias("m")).first()
    n = total["n"]
    if not 0 < n <= MAX_RETURNS:
        raise ValueError(f"{n} returns")
    per, place = -(-n // block), F.col("id") % n
    replication = F.floor(F.col("id") / n)
    rows = spark.range(replications * n).select(replication.alias("replication"), place.alias("place"), F.floor(draw(seed, replication * per + F.floor(place / block)) * n).alias("start"))
    at = rows.withColumn("i", (F.col("start") + F.col("place") % block) % n)
    centred = series.select(F.col("i").cast("bigint").alias("i"), (F.col("r") - total["m"]).alias("value"))
    return at.join(F.broadcast(centred), "i").select("replication", "place", "value")


def sign_flips(spark: SparkSession, series: DataFrame, replications: int) -> DataFrame:
    """replication, place, value: the series with the sign of every second return turned, from the first or the second on."""
    flips = F.explode(F.sequence(F.lit(0), F.lit(replications - 1)))
    rows = series.select(flips.alias("replication"), F.col("i").alias("place"), "r")
    return rows.select("replication", "place", F.when((F.col("replication") + F.col("place")) % 2 == 0, F.col("r")).otherwise(-F.col("r")).alias("value"))


def generated(series: DataFrame, generate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The null series (replication, place, value) that a function makes of the observed one (i from 0, r).

    There are 32 to 10,000 replications, each with the places of the series, once each, and finite values; anything
    else is an error. Replications are counted by themselves, and only their number comes to the driver.
    """
    total = series.agg(F.count("*").alias("n"), F.max("i").alias("last")).first()
    n = total["n"]
    if not 0 < n <= MAX_RETURNS or total["last"] != n - 1:
        raise ValueError(f"{n} returns")
    made = written(generate(series).select("replication", "place", F.col("value").cast("double").alias("value")), "null-series")
    finite = F.coalesce(F.abs("value") < float("inf"), F.lit(False))
    places = made.groupBy("replication", "place").agg(F.count("*").alias("rows"), F.bool_and(finite).alias("finite"))
    whole = (F.count("*") == n) & (F.min("place") == 0) & (F.max("place") == n - 1) & (F.max("rows") == 1) & F.bool_and("finite")
    found = places.groupBy("replication").agg(F.coalesce(whole, F.lit(False)).alias("whole")).agg(F.count("*").alias("n"), F.coalesce(F.bool_and("whole"), F.lit(False)).alias("whole")).first()
    if not 32 <= found["n"] <= 10_000:
        raise ValueError(f"{found['n']} replications, not 32 to 10,000")
    if not found["whole"]:
        raise ValueError("a replication isn't as long as the series, or has a value that is no finite number")
    return made


def p_value(null: DataFrame, value: str, observed: float) -> DataFrame:
    """One row: replications, exceedances and (exceedances + 1) / (replications + 1)."""
    n = null.agg(F.count("*").alias("replications"), F.count_if(F.col(value) >= observed).alias("exceedances"))
    return n.withColumn("p_value", (F.col("exceedances") + 1) / (F.col("replications") + 1))
