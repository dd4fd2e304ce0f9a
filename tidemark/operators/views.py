"""Views that a strategy may see at a decision, and what of its output is let in.

A decision belongs to a fold and a role: training is looked at once, at its end, and out-of-sample sessions one
decision at a time. Decisions are few (folds times sessions of the calendar); their number is checked before they
are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.declaration import PlanError

TRAIN, OUT_OF_SAMPLE = "train", "out-of-sample"
MAX_DECISIONS = 1_000_000
VIEW = ("fold", "role", "decision")


def _broken(code: str, text: str) -> Column:
    return F.raise_error(F.lit(f"{code}: {text}")).cast("boolean")


def decisions(folds: DataFrame, every: int) -> DataFrame:
    """fold, role, decision, hist_start: the end of each training range, and every so many sessions out of sample."""
    train = folds.select("fold", F.lit(TRAIN).alias("role"), F.col("train_end").alias("decision"), F.col("train_start").alias("hist_start"))
    oos = folds.select("fold", F.lit(OUT_OF_SAMPLE).alias("role"), F.explode(F.sequence("oos_start", "oos_end", F.lit(every))).alias("decision"), F.col("train_start").alias("hist_start"))
    return train.unionByName(oos)


def admissible(asked: DataFrame, folds: DataFrame) -> DataFrame:
    """asked (fold, role, decision), with hist_start. Training anywhere but at its end, a decision out of the fold's range, an unknown fold or role is an error (C2) when read."""
    role, at = F.col("role"), F.col("decision")
    ok = F.when(role == TRAIN, at == F.col("train_end")).when(role == OUT_OF_SAMPLE, at.between(F.col("oos_start"), F.col("oos_end")))
    known = asked.join(F.broadcast(folds), "fold", "left").where(F.coalesce(ok, F.lit(False)) | _broken("C2", "a decision is outside its role's range"))
    return known.select(*VIEW, F.col("train_start").alias("hist_start"))


def view(rows: DataFrame, asked: DataFrame, mask: str = "tradable") -> DataFrame:
    """The rows (t, mask) from hist_start to the decision, for each decision, without those that the mask takes out; a null mask is an error (C4)."""
    if (n := asked.count()) > MAX_DECISIONS:
        raise PlanError("C2", f"{n} decisions")
    seen = rows.join(F.broadcast(asked), F.col("t").between(F.col("hist_start"), F.col("decision"))).drop("hist_start")
    return seen.where(F.when(F.col(mask).isNull(), _broken("C4", "a mask is null")).otherwise(F.col(mask)))


def audit(rows: DataFrame, asked: DataFrame, mask: str = "tradable") -> DataFrame:
    """For each decision (any columns, hist_start and decision), how the rows of the source end: source, history, outside, masked, output and decision rows.

    Sessions are added up first and counted up to each of them, so that a decision looks up two sessions, the last
    one up to its decision and the last one before its history. The counts must balance, or it is an error.
    """
    if (n := asked.count()) > MAX_DECISIONS:
        raise PlanError("C2", f"{n} decisions")
    by_session = rows.groupBy("t").agg(F.count("*").alias("n"), F.count_if(mask).alias("ok"))
    # sessions and decisions are few: one window over both
    ends = asked.withColumn("ask", F.monotonically_increasing_id())
    edges = ends.select("ask", F.explode(F.array(F.struct(F.lit("to").alias("end"), F.col("decision").alias("t")), F.struct(F.lit("from").alias("end"), (F.col("hist_start") - 1).alias("t")))).alias("e")).select("ask", "e.end", "e.t")
    both = by_session.unionByName(edges, allowMissingColumns=True)
    whole, upto = Window.partitionBy(), Window.orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = Window.partitionBy("t")
    known = both.withColumns({"all_rows": F.sum("n").over(whole), "n_upto": F.sum("n").over(upto), "ok_upto": F.sum("ok").over(upto), "ok_here": F.sum("ok").over(at)}).where("end is not null")
    pick = lambda c, end: F.coalesce(F.max(F.when(F.col("end") == end, F.col(c))), F.lit(0))
    counts = known.groupBy("ask").agg(
        F.coalesce(F.max("all_rows"), F.lit(0)).alias("source_rows"), (pick("n_upto", "to") - pick("n_upto", "from")).alias("history_rows"), (pick("ok_upto", "to") - pick("ok_upto", "from")).alias("output_rows"), pick("ok_here", "to").alias("decision_rows"),
    )
    found = counts.withColumns({"outside_rows": F.col("source_rows") - F.col("history_rows"), "masked_rows": F.col("history_rows") - F.col("output_rows")})
    ok = (F.col("outside_rows") >= 0) & (F.col("masked_rows") >= 0) & (F.col("decision_rows") <= F.col("output_rows"))
    names = [c for c in asked.columns if c != "hist_start"]
    return ends.join(found.where(ok | _broken("C2", "a view's counts don't add up")), "ask").select(*names, "source_rows", "history_rows", "outside_rows", "masked_rows", "output_rows", "decision_rows")


def admitted(output: DataFrame, seen: DataFrame, entity: str = "entity") -> DataFrame:
    """Output rows (fold, role, decision, entity, t) that count: all of training, and out of sample those at the decision.

    A row after its decision is an error (C1), and so is a row more often than the view has it (C4).
    """
    keys = [*VIEW, entity, "t"]
    supplied = seen.groupBy(*keys).agg(F.count("*").alias("n_supplied"))
    counted = output.withColumn("n_output", F.count("*").over(Window.partitionBy(*keys))).join(supplied, keys, "left")
    future, more = F.col("t") > F.col("decision"), F.col("n_output") > F.coalesce("n_supplied", F.lit(0))
    keep = F.when(future, _broken("C1", "output of the future")).when(more, _broken("C4", "output that the view didn't have"))
    return counted.where(keep.otherwise((F.col("role") == TRAIN) | (F.col("t") == F.col("decision")))).drop("n_output", "n_supplied")


def admitted_by_range(output: DataFrame, rows: DataFrame, asked: DataFrame, entity: str = "entity", mask: str = "tradable") -> DataFrame:
    """As admitted(), for output of the views of rows (entity, t, mask) at asked, which are not made for it.

    How often a row may come is the same for every decision that sees its session, so that rows are counted once
    by entity and session, and the decision's range says whether it sees it. One shuffle of the output by entity and
    session serves this join and the count of its own rows. Output for a decision that isn't asked for is an error (C2).
    """
    if (n := asked.count()) > MAX_DECISIONS:
        raise PlanError("C2", f"{n} decisions")
    open_ = F.when(F.col(mask).isNull(), _broken("C4", "a mask is null")).otherwise(F.col(mask))
    supplied = rows.where(open_).groupBy(entity, "t").agg(F.count("*").alias("n_supplied"))
    ranged = output.join(F.broadcast(asked.select(*VIEW, "hist_start").distinct()), [*VIEW], "left").join(supplied, [entity, "t"], "left")
    counted = ranged.withColumn("n_output", F.count("*").over(Window.partitionBy(*VIEW, entity, "t")))
    t, seen = F.col("t"), F.when(F.col("t") >= F.col("hist_start"), F.col("n_supplied"))
    keep = F.when(F.col("hist_start").isNull(), _broken("C2", "output of a decision that isn't asked for")).when(t > F.col("decision"), _broken("C1", "output of the future"))
    keep = keep.when(F.col("n_output") > F.coalesce(seen, F.lit(0)), _broken("C4", "output that the view didn't have"))
    return counted.where(keep.otherwise((F.col("role") == TRAIN) | (t == F.col("decision")))).select(*output.columns)
