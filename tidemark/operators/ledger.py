"""Records of experiments: families, counts, priors to compare with, scores of suites, and whether a protocol was carried out whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .views import VIEW

#: Priors that a candidate is compared with.
MOST_PRIORS = 8


def set_digest(id_: str) -> list[Column]:
    """Aggregates part_0 to part_3: a digest of a set of identifiers whatever their order; the sums of four parts of each one's SHA-256. Identifiers must be distinct."""
    h = F.sha2(F.col(id_).cast("string"), 256)
    return [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"part_{i}") for i in range(4)]


def families(ledger: DataFrame, family: str, id_: str) -> DataFrame:
    """Each family's number of distinct members and their digest. Entries are brought down to members first, wherever they lie."""
    return ledger.select(family, id_).where(F.col(id_).isNotNull()).distinct().groupBy(family).agg(F.count("*").alias("members"), *set_digest(id_))


def summary(ledger: DataFrame, subject: str, status: str, order: list[str], states: tuple[str, ...]) -> DataFrame:
    """Each subject's entries, those of each state, and the state of its latest entry."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in states]
    return ledger.groupBy(subject).agg(F.count("*").alias("entries"), *counts, F.max_by(status, F.struct(*order)).alias("latest"))


def priors(ledger: DataFrame, candidate: dict[str, object], lock: str, order: list[str], most: int = MOST_PRIORS) -> DataFrame:
    """The latest entries that agree with the candidate in all its columns but the lock, in which they differ."""
    same = ledger
    for name, value in candidate.items():
        same = same.where(F.col(name) != F.lit(value) if name == lock else F.col(name).eqNullSafe(F.lit(value)))
    return same.orderBy(*map(F.desc, order)).limit(most)


def suite_scores(traps: DataFrame, honest: DataFrame) -> DataFrame:
    """One row: mean `weight` of the traps (0 without any), whether all have 1 (there must be some), and the share of honest runs that `passed` (0 without any)."""
    t = traps.agg(F.coalesce(F.avg("weight"), F.lit(0.0)).alias("safety"), F.coalesce(F.bool_and(F.col("weight") == 1), F.lit(False)).alias("safety_perfect"))
    h = honest.agg(F.coalesce(F.avg(F.col("passed").cast("double")), F.lit(0.0)).alias("competence"))
    return t.crossJoin(h)  # one row each


def topology(executions: DataFrame, expected: DataFrame) -> DataFrame:
    """Executions (fold, role, decision, source, evidence) against the decisions expected: keys with `fault`, none if the protocol was carried out whole.

    missing, unexpected and repeated executions; sources: a decision time read from more than one source, in any fold
    or role; evidence: one that several executions share. The first that applies is given.
    """
    done = executions.groupBy(*VIEW).agg(F.count("*").alias("done"), F.max("evidence").alias("evidence"))
    both = done.join(expected.select(*VIEW, F.lit(True).alias("wanted")).distinct(), list(VIEW), "full")
    at = executions.groupBy("decision").agg((F.count_distinct("source") > 1).alias("mixed"))
    shared = executions.groupBy("evidence").agg((F.count("*") > 1).alias("shared"))
    fault = F.when(F.col("done").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("done") > 1, "repeated").when(F.col("mixed"), "sources").when(F.col("shared"), "evidence")
    return both.join(at, "decision", "left").join(shared, "evidence", "left").select(*VIEW, fault.alias("fault")).where("fault is not null")
