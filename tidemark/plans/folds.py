"""Walk-forward folds: train, purge, embargo, then out-of-sample sessions."""

from __future__ import annotations

from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .declaration import PlanError

FOLD_SCHEMA = "fold int, train_start int, train_end int, oos_start int, oos_end int"


@dataclass(frozen=True)
class Fold:
    fold: int
    train_start: int
    train_end: int
    oos_start: int
    oos_end: int


def folds(n_folds: int, train: int, oos: int, purge: int, embargo: int, hold: int, expanding: bool = True) -> list[Fold]:
    """Session ranges, ends included. Training never reaches into the gap, and the gap covers the holding period."""
    if purge < hold or embargo <= 0:
        raise PlanError("C2", "purge must cover the holding period, and embargo be positive")
    out = []
    for k in range(n_folds):
        end = train + k * oos - 1
        start = end + 1 + purge + embargo
        out.append(Fold(k, 0 if expanding else end - train + 1, end, start, start + oos - 1))
    return out


def fold_table(spark: SparkSession, plan: list[Fold]) -> DataFrame:
    return spark.createDataFrame([astuple(f) for f in plan], FOLD_SCHEMA)


def check_fits(plan: list[Fold], sessions: int) -> None:
    """A declared plan ends with the schedule's last session or before, and leaves no whole further window."""
    if not plan:
        raise PlanError("C2", "a plan without folds")
    last, size = max(f.oos_end for f in plan), plan[0].oos_end - plan[0].oos_start + 1
    if last >= sessions:
        raise PlanError("C2", f"the plan needs {last + 1} sessions, the schedule has {sessions}")
    if sessions - 1 - last >= size:
        raise PlanError("C2", f"the plan ends {sessions - 1 - last} sessions before the schedule")


def fitted_folds(sessions: DataFrame, train: int, oos: int, purge: int, embargo: int, hold: int) -> DataFrame:
    """The folds (expanding) that a schedule has room for, from the number of its sessions, the only column `n` of one row."""
    folds(1, train, oos, purge, embargo, hold)  # the parameters' own checks
    gap = purge + embargo
    k = F.col("fold")
    rows = sessions.select(F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - train - gap) / oos).cast("int")))).alias("fold"), "n").where(train + gap + (k + 1) * oos <= F.col("n"))
    end = train + k * oos - 1
    return rows.select("fold", F.lit(0).alias("train_start"), end.alias("train_end"), (end + 1 + gap).alias("oos_start"), (end + gap + oos).alias("oos_end"))


def block_folds(sessions: DataFrame, n_folds: int, warm_up: int, gap: int) -> DataFrame:
    """n_folds folds of equal blocks at the end of a schedule (its number of sessions is the only column `n` of one row): block k out of sample, trained on what lies between the warm-up and a gap before it.

    A block has floor((n - warm_up) / (n_folds + 1)) sessions; of a schedule too short for one, there are no folds.
    """
    if n_folds < 1 or warm_up < 0 or gap < 0:
        raise PlanError("C2", "folds, a warm-up and a gap can't be below 0")
    block, k = F.floor((F.col("n") - warm_up) / (n_folds + 1)).cast("int"), F.col("fold")
    rows = sessions.select("n", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))).alias("fold"))
    start = F.col("n").cast("int") - (n_folds - k) * F.col("block")
    made = rows.select("fold", F.lit(warm_up).alias("train_start"), (start - gap - 1).alias("train_end"), start.alias("oos_start"), (start + F.col("block") - 1).alias("oos_end"), "block")
    return made.where((F.col("block") > 0) & (F.col("train_end") >= warm_up)).drop("block")
