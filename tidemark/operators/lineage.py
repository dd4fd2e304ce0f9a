"""How rows' availability is known: by segments of event time that a declaration names."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.declaration import Declaration, PlanError


def _at(when: datetime) -> Column:
    return F.lit(when.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def check_segments(d: Declaration) -> None:
    """Segments follow one another without a gap, and only the last may be open."""
    for (_, until, _), (start, _, _) in zip(d.segments, d.segments[1:], strict=False):
        if until is None or until != start:
            raise PlanError("INVALID_SEGMENTS", f"{d.name}: segments leave a gap or overlap")
    if bad := {basis for _, _, basis in d.segments} - {"observed", "reconstructed", "assumed"}:
        raise PlanError("INVALID_SEGMENTS", f"{d.name}: {sorted(bad)}")


def basis(d: Declaration) -> Column:
    """The basis of the segment that the event time (a TIMESTAMP_NTZ in UTC) lies in, null outside of all."""
    check_segments(d)
    found = F.lit(None).cast("string")
    for start, until, name in reversed(d.segments):
        inside = F.col(d.event_time) >= _at(start)
        found = F.when(inside & (F.col(d.event_time) < _at(until)) if until else inside, name).otherwise(found)
    return found


def faults(df: DataFrame, d: Declaration, first_observed: datetime) -> DataFrame:
    """Rows that the declaration's segments don't bear out, with `fault`.

    INVALID_SEGMENTS: no segment has the row's event time. INVALID_VALUE: an observed row without availability.
    OBSERVED_BEFORE_LINEAGE: a row said to be observed before anybody looked.
    """
    at, available = F.col("basis"), F.col(d.clock)
    seen = F.when(available.isNull(), "INVALID_VALUE").when(available < _at(first_observed), "OBSERVED_BEFORE_LINEAGE")
    fault = F.when(at.isNull(), "INVALID_SEGMENTS").when(at == "observed", seen)
    return df.withColumn("basis", basis(d)).withColumn("fault", fault).where("fault is not null")
