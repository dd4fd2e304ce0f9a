"""Joins of point-in-time research: composite, admission with multiplicity, revisions as of a date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.declaration import PlanError
from . import guard


#: Whole numbers of sessions are clocks, too; they don't compare with times.
_NUMBER = "bigint"


def _sides(primary: DataFrame, membership: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, str]:
    """Both sides with their clocks as moments that compare, membership as one row for each key with the number of its rows, and the moments' type."""
    a = primary.withColumn("own_moment", guard.moment(primary, "available"))
    b = membership.withColumn("member_moment", guard.moment(membership, "member_available"))
    kinds = {df.schema[c].dataType.simpleString() for df, c in ((a, "own_moment"), (b, "member_moment"))}
    kind = _NUMBER if kinds == {_NUMBER} else "timestamp_ntz"
    if _NUMBER in kinds and len(kinds) > 1:
        raise PlanError("C1", "a number of a session doesn't compare with a time")
    a, b = (df.withColumn(c, F.col(c).cast(kind)) for df, c in ((a, "own_moment"), (b, "member_moment")))
    one = b.groupBy(*keys).agg(F.count("*").alias("member_rows"), F.max("member_moment").alias("member_moment"), F.bool_and("member").alias("member"))
    return a, one, kind


def composite(primary: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """primary (keys, available, tradable) with membership (keys, member_available, member): the later availability, and tradable and member.

    The later one is later as an instant, whatever types and zones the clocks are written in; it is a TIMESTAMP_NTZ
    in UTC (or a number, if both sides have numbers of sessions). Errors when the row is read, whichever of the new
    columns is asked for: a null or unreadable clock on either side (C1); missing or repeated membership, a primary key that repeats, a mask
    that doesn't say true or false (C4). Membership that no primary row has is let be; composite_audit() counts it.
    """
    a, one, kind = _sides(primary, membership, keys)
    rows = a.withColumn("own_rows", F.count("*").over(Window.partitionBy(*keys))).join(one, keys, "left")
    faults = (
        (F.col("member_rows").isNull(), "C4: a row has no membership"), (F.col("member_rows") > 1, "C4: a membership key repeats"), (F.col("own_rows") > 1, "C4: a primary key repeats"),
        (F.col("own_moment").isNull() | F.col("member_moment").isNull(), "C1: an availability is null or no instant"), (F.col("member").isNull() | F.col("tradable").isNull(), "C4: a mask is null"),
    )

    def checked(value: Column, to: str) -> Column:
        out = F
        for broken, says in faults:
            out = out.when(broken, F.raise_error(F.lit(says)).cast(to))
        return out.otherwise(value)

    new = {"available": checked(F.greatest("own_moment", "member_moment"), kind), "eligible": checked(F.col("member") & F.col("tradable"), "boolean")}
    return rows.withColumns(new | {"member_available": F.col("member_moment")}).drop("member_rows", "own_rows", "own_moment", "member_moment")


def composite_audit(primary: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """One row of what composite() would do, without its errors: rows of either side, and how each primary row ends.

    eligible_rows, dropped_by_mask (not tradable) and dropped_by_membership (tradable and no member) are of the rows
    that have all they need and add up to matched_rows; unmatched_rows have no membership or more than one row of it,
    repeated_rows share their key with another primary row, clock_faults lack an instant on a side, mask_faults a mask: each row counts
    once, in this order, and all add up to primary_rows. unused_rows is membership that no primary row has; later_membership counts eligible rows whose membership was known after the row itself.
    """
    a, one, _ = _sides(primary, membership, keys)
    own = a.withColumn("own_rows", F.count("*").over(Window.partitionBy(*keys)))
    both = own.join(one, keys, "full")
    row = F.col("own_rows").isNotNull()
    kinds = F.when(~row, "unused_rows").when(F.coalesce(F.col("member_rows"), F.lit(0)) != 1, "unmatched_rows").when(F.col("own_rows") > 1, "repeated_rows")
    kinds = kinds.when(F.col("own_moment").isNull() | F.col("member_moment").isNull(), "clock_faults").when(F.col("member").isNull() | F.col("tradable").isNull(), "mask_faults")
    kinds = kinds.when(~F.col("tradable"), "dropped_by_mask").when(~F.col("member"), "dropped_by_membership").otherwise("eligible_rows")
    n = lambda *names: F.count_if(F.col("kind").isin(*names))
    unused = F.sum(F.when(F.col("kind") == "unused_rows", F.col("member_rows")).otherwise(0))
    # membership counts once for each key, though several primary rows may share it
    share = F.when(row, F.col("member_rows") / F.col("own_rows")).otherwise(F.col("member_rows"))
    counts = both.withColumn("kind", kinds).agg(
        F.count_if(row).alias("primary_rows"), F.coalesce(F.round(F.sum(share)), F.lit(0.0)).cast("bigint").alias("membership_rows"), n("eligible_rows", "dropped_by_mask", "dropped_by_membership").alias("matched_rows"),
        *(n(k).alias(k) for k in ("eligible_rows", "dropped_by_mask", "dropped_by_membership", "unmatched_rows", "repeated_rows", "clock_faults", "mask_faults")), F.coalesce(unused, F.lit(0)).alias("unused_rows"),
        F.count_if((F.col("kind") == "eligible_rows") & (F.col("member_moment") > F.col("own_moment"))).alias("later_membership"),
    )
    parts = ("matched_rows", "unmatched_rows", "repeated_rows", "clock_faults", "mask_faults")
    balanced = F.col("primary_rows") == sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return counts.where(balanced | F.raise_error(F.lit("composite counts don't add up")).cast("boolean"))


def coverage(primary: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows of either side, matched and unused rows, and keys that repeat."""
    a = primary.groupBy(*keys).agg(F.count("*").alias("p"))
    b = membership.groupBy(*keys).agg(F.count("*").alias("m"))
    both = a.join(b, keys, "full").fillna(0, ["p", "m"])
    return both.agg(
        F.sum("p").alias("primary_rows"), F.sum("m").alias("membership_rows"), F.sum(F.when(F.col("m") > 0, F.col("p")).otherwise(0)).alias("matched_rows"),
        F.sum(F.when(F.col("p") == 0, F.col("m")).otherwise(0)).alias("unused_rows"), F.count_if((F.col("p") > 1) | (F.col("m") > 1)).alias("repeated_keys"),
    )


def excess(output: DataFrame, supplied: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that output has more often than supplied (n_output, n_supplied). Counts are compared, so that a frequent key costs one row."""
    a, b = (df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((output, "n_output"), (supplied, "n_supplied")))
    return a.join(b, keys, "left").fillna(0, ["n_supplied"]).where("n_output > n_supplied")


def revision_as_of(revisions: DataFrame, entity: str, period: str, effective: str, value: str) -> DataFrame:
    """For each revision, the value in force once it is effective: of the latest period known by then, its latest revision.

    A late revision of an older period doesn't displace a newer period.
    """
    w = Window.partitionBy(entity).orderBy(effective).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return revisions.withColumn("in_force", F.max_by(value, F.struct(period, effective)).over(w))


def revision_at(asks: DataFrame, revisions: DataFrame, entity: str, at: str, period: str, effective: str, value: str) -> DataFrame:
    """asks (entity, at) with in_force: of the latest period known at that time, its latest revision; null if nothing was known.

    Both sides go through one window by entity, so that no pair of an ask and a revision is made.
    """
    known = revisions.select(entity, F.col(effective).alias(at), F.struct(period, effective).alias("version"), F.col(value).alias("known"), F.lit(False).alias("ask"))
    both = known.unionByName(asks.select(entity, at, F.lit(True).alias("ask")), allowMissingColumns=True)
    w = Window.partitionBy(entity).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("in_force", F.max_by("known", "version").over(w)).where("ask").select(entity, at, "in_force")


def survivors(panel: DataFrame, sessions: int) -> DataFrame:
    """The entities with a row in the last so many sessions: what a list of today's members would hold."""
    last = panel.groupBy("entity").agg(F.max("t").alias("last"))
    return last.join(F.broadcast(last.agg(F.max("last").alias("end"))), F.col("last") > F.col("end") - sessions, "left_semi").select("entity")


def in_universe(panel: DataFrame, members: DataFrame, survivors_: DataFrame) -> DataFrame:
    """panel with `member` (a span since <= t < until of members holds t; an open end is null) and `survivor`.

    Ends of spans and rows go through one window by entity that adds up what is open, so that no row meets a span.
    """
    opened = members.select("entity", F.col("since").alias("t"), F.lit(1).alias("step"))
    closed = members.where("until is not null").select("entity", F.col("until").alias("t"), F.lit(-1).alias("step"))
    rows = panel.join(survivors_.select("entity", F.lit(True).alias("survivor")).distinct(), "entity", "left").withColumn("survivor", F.coalesce("survivor", F.lit(False)))
    both = rows.withColumn("step", F.lit(0)).unionByName(opened.unionByName(closed), allowMissingColumns=True)
    w = Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("member", F.sum("step").over(w) > 0).where("step = 0").drop("step")


def full_panel(panel: DataFrame, members: DataFrame, survivors_: DataFrame, revisions: DataFrame) -> DataFrame:
    """panel (entity, t, ...) with `member` (some span since <= t < until holds t; an open end is null), `survivor`, and the fundamental in force (`period`, `fundamental`, `known_at`).

    In force at t is, of the latest period known by then (revisions: entity, period, effective, value), the revision
    known last; a late revision of an older period doesn't displace a newer one. Prices, ends of spans, revisions and
    survivors are events of one window by entity, in order of t, so that there is one shuffle and no row meets a span or a revision.
    """
    version = F.struct("period", "effective", "value")
    events = [
        members.select("entity", F.col("since").alias("t"), F.lit(1).alias("event_step")), members.where("until is not null").select("entity", F.col("until").alias("t"), F.lit(-1).alias("event_step")),
        revisions.where("period is not null and effective is not null and value is not null").select("entity", F.col("effective").alias("t"), version.alias("event_version")), survivors_.select("entity", F.lit(True).alias("event_last")),
    ]
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), events, panel.withColumn("event_row", F.lit(True)))
    w = Window.partitionBy("entity").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = both.withColumns({"member": F.coalesce(F.sum("event_step").over(w), F.lit(0)) > 0, "in_force": F.max("event_version").over(w), "survivor": F.coalesce(F.bool_or("event_last").over(Window.partitionBy("entity")), F.lit(False))})
    rows = known.where("event_row")
    new = ("member", "survivor", "period", "fundamental", "known_at")
    of_version = {"period": F.col("in_force.period"), "fundamental": F.col("in_force.value"), "known_at": F.col("in_force.effective")}
    return rows.withColumns(of_version).select(*(f"`{c}`" for c in panel.columns if c not in new), *new)
