"""Gates on a priced strategy: capacity, costs, contamination, chance, neighbours, trials, deflated Sharpe and stability.

Each gate is one row (gate, status, observed, threshold), so that a report is a union of rows and a verdict is one
aggregate over it. Whatever is measured over trades or returns is measured by Spark; the rows themselves are few.
Nothing to measure gives status `unavailable`, never a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The thresholds of the gates.
LEAST_RETURNS = 30
LEAST_FOLDS = 3
COST_MULTIPLE = 2.0
POSITIVE_FOLDS = 2 / 3
MOST_OF_ONE_FOLD = 0.6
LEAST_NEIGHBOURS = 2
POSITIVE_NEIGHBOURS = 2 / 3
ALPHA = 0.05
PROBABILITY = {"standard": 0.95, "higher": 0.99}

PASSED, FAILED, UNAVAILABLE = "passed", "failed", "unavailable"


def _row(df: DataFrame, gate: str, known: Column, ok: Column, observed: Column, threshold: float) -> DataFrame:
    """The gate's row from a one-row aggregate."""
    status = F.when(~F.coalesce(known, F.lit(False)), UNAVAILABLE).when(F.coalesce(ok, F.lit(False)), PASSED).otherwise(FAILED)
    return df.select(F.lit(gate).alias("gate"), status.alias("status"), observed.cast("double").alias("observed"), F.lit(float(threshold)).alias("threshold"))


def participation(change: str, capital: float, price: str = "price", volume: str = "volume") -> Column:
    """The share of a session's traded value that a trade takes; null where price or volume is missing or not above 0."""
    traded = F.col(price) * F.col(volume)
    return F.when((F.col(price) > 0) & (F.col(volume) > 0), F.abs(change) * capital / traded)


def capacity(trades: DataFrame, capital: float, most: float) -> DataFrame:
    """The largest participation of trades (change, price, volume). One trade without a volume fails the gate."""
    share = participation("change", capital)
    found = trades.agg(F.count("*").alias("n"), F.count(share).alias("priced"), F.max(share).alias("most"))
    return _row(found, "capacity", F.col("n") > 0, (F.col("priced") == F.col("n")) & (F.col("most") <= most), F.col("most"), most)


def _sharpe(r: Column, per_year: float) -> tuple[Column, Column]:
    """Number of returns, and annualised Sharpe (0 without dispersion)."""
    sd = F.coalesce(F.stddev_samp(r), F.lit(0.0))
    return F.count(r), F.when(sd > 0, F.avg(r) / sd * per_year**0.5).otherwise(0.0)


def cost_stress(returns: DataFrame, multiple: float = COST_MULTIPLE, per_year: float = 252.0) -> DataFrame:
    """Sharpe of returns (gross, cost) with costs multiplied: it must stay above 0."""
    n, sharpe = _sharpe(F.col("gross") - F.lit(multiple) * F.col("cost"), per_year)
    return _row(returns.agg(n.alias("n"), sharpe.alias("s")), "cost", F.col("n") >= LEAST_RETURNS, F.col("s") > 0, F.col("s"), 0.0)


def contamination(returns: DataFrame, cutoff: str, least: int = LEAST_RETURNS) -> DataFrame:
    """So many sessions at least lie after the cutoff that whoever made the strategy can't have seen past; returns has decision_time."""
    found = returns.agg(F.count("*").alias("n"), F.count_if(F.col("decision_time") > F.lit(cutoff).cast("timestamp_ntz")).alias("after"))
    return _row(found, "contamination", F.col("n") > 0, F.col("after") >= least, F.col("after"), least)


def chance(null: DataFrame, observed: float, alpha: float = ALPHA) -> DataFrame:
    """(exceedances + 1) / (replications + 1) of the statistics `value` of a null distribution."""
    found = null.agg(F.count("value").alias("n"), F.count_if(F.col("value") >= observed).alias("e"))
    p = (F.col("e") + 1) / (F.col("n") + 1)
    return _row(found, "null", F.col("n") > 0, p <= alpha, p, alpha)


def neighbours(results: DataFrame, own_lock: str) -> DataFrame:
    """Results (lock, sharpe) of other parameters near by: a lock counts once, by its worst result; most must be above 0."""
    others = results.where(F.col("lock") != own_lock).groupBy("lock").agg(F.min("sharpe").alias("sharpe"))
    found = others.agg(F.count("*").alias("n"), F.avg((F.col("sharpe") > 0).cast("double")).alias("share"))
    return _row(found, "parameter", F.col("n") >= LEAST_NEIGHBOURS, F.col("share") >= POSITIVE_NEIGHBOURS, F.col("share"), POSITIVE_NEIGHBOURS)


def trial_count(declared: int, attempts: DataFrame, family: DataFrame) -> DataFrame:
    """One row `trials`: what is declared, or the distinct attempts and experiments of the family (id) where those are more."""
    ids = attempts.select("id").distinct().agg(F.count("*").alias("a")).crossJoin(family.select("id").distinct().agg(F.count("*").alias("b")))
    return ids.select(F.greatest(F.lit(declared).cast("bigint"), F.col("a") + F.col("b")).alias("trials"))


def trials(counted: DataFrame, declared: int) -> DataFrame:
    """Fails if more trials are on record than were declared."""
    return _row(counted, "trials", F.col("trials").isNotNull(), F.col("trials") <= declared, F.col("trials"), declared)


def deflated(probability: DataFrame, tier: str = "standard") -> DataFrame:
    """The deflated Sharpe probability (one row: n, probability) against the tier's bound."""
    least = PROBABILITY[tier]
    return _row(probability, "deflated_sharpe", F.col("n") >= LEAST_RETURNS, F.col("probability") >= least, F.col("probability"), least)


def stability(returns: DataFrame) -> DataFrame:
    """Two thirds of the folds (fold, r) earn, and no fold makes up most of the sum of absolute fold returns."""
    folds = returns.groupBy("fold").agg(F.sum("r").alias("r"))
    total = F.sum(F.abs("r"))
    found = folds.agg(F.count("*").alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("share"), F.when(total > 0, F.max(F.abs("r")) / total).otherwise(1.0).alias("one"))
    return _row(found, "stability", F.col("n") >= LEAST_FOLDS, (F.col("share") >= POSITIVE_FOLDS) & (F.col("one") <= MOST_OF_ONE_FOLD), F.col("share"), POSITIVE_FOLDS)


def report(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def verdict(rows: DataFrame, required: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """One row `verdict` (or one for each of what `by` names): rejected if a gate failed or a required one is unavailable or missing, degraded if another one is unavailable, else accepted."""
    failed, unknown = F.col("status") == FAILED, F.col("status") == UNAVAILABLE
    needed = F.col("gate").isin(*required)
    found = rows.groupBy(*by).agg(F.coalesce(F.bool_or(failed | (unknown & needed)), F.lit(False)).alias("bad"), F.coalesce(F.bool_or(unknown), F.lit(False)).alias("open"), F.collect_set(F.when(needed, F.col("gate"))).alias("seen"))
    rejected = F.col("bad") | (F.size("seen") < len(set(required)))
    return found.select(*by, F.when(rejected, "rejected").when(F.col("open"), "degraded").otherwise("accepted").alias("verdict"))
