"""The as-of guard: rows that were not available at the decision time never come through."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.declaration import PlanError, ReadPlan


#: A text clock is a date, or a time with a zone.
DATE_TEXT, INSTANT_TEXT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"


#: Milliseconds that are an instant: some 270,000 years to either side of 1970.
MOST_MILLIS = 8_640_000_000_000_000


def clock_and_cutoff(df: DataFrame, clock: str, when: str) -> tuple[Column, Column]:
    """The clock column as an instant, null where it can't be read as one, and the cutoff (UTC) in the same type, whatever the session's zone.

    TIMESTAMP columns are instants; TIMESTAMP_NTZ and DATE columns are in UTC; a number is milliseconds since 1970 in
    UTC; a text is a date in UTC or a time with its zone, and anything else is no instant. A column of another type breaks C1.
    """
    kind, col = df.schema[clock].dataType.typeName(), F.col(f"`{clock}`")
    instant = F.expr(f"TIMESTAMP '{when} UTC'")
    if kind == "timestamp":
        return col, instant
    if kind in ("timestamp_ntz", "date"):
        return col.cast("timestamp_ntz"), F.lit(when).cast("timestamp_ntz")
    if kind == "string":
        text = F.trim(col)
        midnight = F.concat(text, F.lit("T00:00:00Z")).try_cast("timestamp")
        return F.when(text.rlike(DATE_TEXT), midnight).when(text.rlike(INSTANT_TEXT), text.try_cast("timestamp")), instant
    if kind in ("byte", "short", "integer", "long"):
        return F.when(F.abs(col.cast("decimal(20,0)")) <= MOST_MILLIS, F.timestamp_millis(col.cast("bigint"))), instant
    if kind in ("float", "double"):
        millis = F.when(~F.isnan(col) & (F.abs(col) <= MOST_MILLIS), F.floor(col))
        return F.timestamp_millis(millis), instant
    raise PlanError("C1", f"{clock} is a {kind}, not a clock")


def moment(df: DataFrame, clock: str) -> Column:
    """A clock as a time in UTC without a zone, whatever its type and the session's zone, null where it is no instant; so clocks of different types compare. Numbers of sessions stay numbers."""
    if df.schema[clock].dataType.typeName() in ("byte", "short", "integer", "long"):
        return F.col(f"`{clock}`").cast("bigint")
    col, _ = clock_and_cutoff(df, clock, "1970-01-01 00:00:00")
    if df.schema[clock].dataType.typeName() in ("timestamp_ntz", "date"):
        return col
    seconds = F.unix_micros(col).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    return F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def located(df: DataFrame) -> bool:
    """Whether df is a scan of files that knows each row's file and its number there."""
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def as_of(df: DataFrame, clock: str, when: str, locate: bool = False) -> Column:
    """clock <= when, and an error (C1) on a row whose clock is null or unreadable. With locate, the error names the row's file and number if df is a scan of Parquet files.

    It is said twice: plainly, for the scan to push down (with the nulls, so that none is dropped unseen), and in a
    form that no source may take over.
    """
    col, cutoff = clock_and_cutoff(df, clock, when)
    says = F.lit(f"C1: a row's {clock} is null or no instant")
    if locate and located(df):
        says = F.concat(says, F.lit(", row "), F.col("_metadata.row_index"), F.lit(" of "), F.col("_metadata.file_path"))
    broken = F.raise_error(says).cast("boolean")
    return ((col <= cutoff) | col.isNull()) & F.when(col.isNull(), broken).otherwise(col <= cutoff)


def require(df: DataFrame, plan: ReadPlan) -> None:
    """Every column of the plan is there once; a missing clock breaks C1, a missing mask C4."""
    d = plan.declaration
    if len(set(df.columns)) < len(df.columns):
        raise PlanError("CONFIG", "a column name repeats")
    for code, name in (("C1", d.clock), ("C1", d.event_time), ("C4", d.mask), ("CONFIG", d.entity), *(("CONFIG", c) for c in (*d.payload, *plan.columns))):
        if name and name not in df.columns:
            raise PlanError(code, f"{d.name} has no column {name}")


def guarded(df: DataFrame, plan: ReadPlan, observation: Observation | None = None, locate: bool = False) -> DataFrame:
    """The rows of df that were available, with the plan's columns. A null or unreadable clock is an error (C1), raised when rows are read; with locate it says where the row is.

    The observation, if given, gets input_rows, output_rows and dropped_rows as the result is computed.
    """
    require(df, plan)
    clock, when = plan.declaration.clock, plan.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    checked = df
    if observation is not None:
        checked = df.select(*(plan.scanned or df.columns))
        col, cutoff = clock_and_cutoff(checked, clock, when)
        ok = F.coalesce(col <= cutoff, F.lit(False))
        checked = checked.observe(observation, F.count("*").alias("input_rows"), F.count_if(ok).alias("output_rows"), F.count_if(~ok).alias("dropped_rows"))
    return checked.where(as_of(checked, clock, when, locate and observation is None)).select(*(plan.columns or df.columns))


def first_bad_clock(df: DataFrame, clock: str) -> DataFrame:
    """One row for each file of a scan that has rows whose clock is null or no instant: how many, and the number (from 0) and the clock, as a text, of the first one.

    df is a scan of Parquet files with columns added to it at most; each task keeps one row a file before anything is shuffled.
    """
    if not located(df):
        raise PlanError("CONFIG", "not a scan of files that number their rows")
    col, _ = clock_and_cutoff(df, clock, "1970-01-01 00:00:00")
    bad = df.where(col.isNull()).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(f"`{clock}`").cast("string").alias("clock"))
    return bad.groupBy("file").agg(F.count("*").alias("n_bad"), F.min("row").alias("row"), F.min_by("clock", "row").alias("clock"))


def audit(df: DataFrame, clock: str, when: str) -> DataFrame:
    """One row: input, output and dropped rows, and among the dropped ones those whose clock is null or unreadable."""
    col, cutoff = clock_and_cutoff(df, clock, when)
    ok = F.coalesce(col <= cutoff, F.lit(False))
    return df.agg(F.count("*").alias("input_rows"), F.count_if(ok).alias("output_rows"), F.count_if(~ok).alias("dropped_rows"), F.count_if(col.isNull()).alias("invalid_rows"))
