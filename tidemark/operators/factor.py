"""Factors of a user's own: code with state along time, run by Spark for each entity as a table function.

A factor says which columns it makes, starts with a fresh state for each entity, and is given the entity's rows in
order of time, one by one. What it gives back is held to what it has seen: a row of a later time than the last one
that was read is an error (C1), and so is a row that was not given to it, or a row given back more often than it was
there (C4).
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..plans.declaration import PlanError
from ..session import ship_package
from . import joins

_SEEN = "factor_seen"


class Factor(ABC):
    #: The columns that it makes, as name and SQL type.
    columns: dict[str, str]

    @abstractmethod
    def start(self) -> None:
        """Forgets everything: a new entity begins."""

    @abstractmethod
    def step(self, row: Row) -> Iterator[tuple]:
        """Is given the next row; gives rows back, each a time and the values of the columns."""

    def end(self) -> Iterator[tuple]:
        """Is called after the entity's last row."""
        return iter(())


def compute(rows: DataFrame, factor: Factor, by: tuple[str, ...] = ("entity",), t: str = "t") -> DataFrame:
    """The rows that the factor gives for rows (by, t, and what it reads): by, t and its columns.

    by names an entity, and the view that it is seen in if there are several. Spark partitions by it and orders by t,
    so that a task holds one row at a time and the factor's own state. The result is checked by counts of (by, t), where
    it is read.
    """
    taken = {*(c.lower() for c in by), t.lower(), _SEEN}
    if not factor.columns or taken & {c.lower() for c in factor.columns}:
        raise PlanError("CONFIG", "a factor makes columns, with names of their own")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = StructType.fromDDL(", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, t)), f"`{_SEEN}` {kinds[t]}", *(f"`{c}` {kind}" for c, kind in factor.columns.items())]))
    names = list(by)

    class Run:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(schema=made)

        def __init__(self) -> None:
            self.key, self.last = None, None
            factor.start()

        def eval(self, row: Row):
            self.key, self.last = tuple(row[c] for c in names), row[t]
            for at, *values in factor.step(row):
                yield *self.key, at, self.last, *values

        def terminate(self):
            if self.key is not None:
                for at, *values in factor.end():
                    yield *self.key, at, self.last, *values

    ship_package(rows.sparkSession)
    run = F.udtf(Run)
    out = run(rows.asTable().partitionBy(*by).orderBy(t))
    future = F.raise_error(F.lit("C1: a factor's row is later than what it was given")).cast("boolean")
    return out.where(F.when(F.col(_SEEN) < F.col(t), future).otherwise(True)).drop(_SEEN)


def admitted(made: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """made, if no key is there more often than in given; else an error (C4) when it is read. made is read twice: it should be a written table."""
    more = joins.excess(made, given, keys).agg(F.count("*").alias("n_more"))  # one row
    broken = F.raise_error(F.lit("C4: a factor gave back rows that it was not given")).cast("boolean")
    return made.join(F.broadcast(more), F.when(F.col("n_more") > 0, broken).otherwise(True)).drop("n_more")
