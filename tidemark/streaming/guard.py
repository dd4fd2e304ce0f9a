"""The as-of guard on a stream: what isn't available yet is left out, and a clock that is no instant stops the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.guard import as_of


def guarded_stream(stream: DataFrame, clock: str, when: str, delay: str = "1 day") -> DataFrame:
    """The rows of a stream that were available at a time (UTC). The watermark on the clock (a TIMESTAMP) is for stateful operators after it, such as windowed sums or dropDuplicatesWithinWatermark."""
    watched = stream.withWatermark(clock, delay)
    return watched.where(as_of(watched, clock, when))
