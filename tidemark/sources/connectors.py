"""Connectors: sources that may take over part of a read, and say what they took.

A connector is given the request (the declaration, the plan, and where the source is) and gives a DataFrame. What it
says it took are hints for the reader of a report; the guard holds its rows whatever it says. `parts` is one that is
made of Spark's Python data sources: Parquet files read in parts, one for each row group, of which those that begin
after the decision time are never opened.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..plans.declaration import Declaration, PlanError, ReadPlan
from ..session import ship_package
from . import files


@dataclass(frozen=True)
class Capabilities:
    """What a connector can take over; nothing here is ever trusted."""

    projection: bool = False
    as_of: bool = False


@dataclass(frozen=True)
class Taken:
    """What a connector says that it took over of one read."""

    projection: bool = False
    as_of: bool = False


@dataclass(frozen=True)
class Request:
    plan: ReadPlan
    #: Where the source is: what the declaration's locator stands for.
    paths: tuple[str, ...]

    @property
    def declaration(self) -> Declaration:
        return self.plan.declaration


class Connector(ABC):
    #: Name and version of what reads, for reports.
    name: str
    version: str = "1"
    capabilities = Capabilities()

    def accepts(self, declaration: Declaration) -> bool:
        return True

    @abstractmethod
    def read(self, spark: SparkSession, request: Request) -> tuple[DataFrame, Taken]:
        """The source's rows, at least those that the plan needs, with its columns at least."""


def checked(connector: Connector, result: tuple[DataFrame, Taken], request: Request) -> tuple[DataFrame, Taken]:
    """A connector's result, which must be a table that has the plan's columns once each, and must not claim what the connector can't do."""
    df, taken = result
    if not isinstance(df, DataFrame) or not isinstance(taken, Taken):
        raise PlanError("SOURCE", f"{connector.name} gave no table")
    for claim in ("projection", "as_of"):
        if getattr(taken, claim) and not getattr(connector.capabilities, claim):
            raise PlanError("SOURCE", f"{connector.name} says that it took over {claim}, which it can't")
    if taken.projection and request.plan.scanned and set(df.columns) != set(request.plan.scanned):
        raise PlanError("SOURCE", f"{connector.name} says that it took over the columns, and gave others")
    return df, taken


def _open(path: str) -> pq.ParquetFile:
    system, place = fs.FileSystem.from_uri(path)
    return pq.ParquetFile(system.open_input_file(place))


@dataclass
class _Part(InputPartition):
    path: str
    group: int


class _PartsReader(DataSourceReader):
    """One part for each row group that may have rows known by then. A group whose clock has nulls, or no statistics, is always read: the guard must see such rows."""

    def __init__(self, options: dict[str, str]):
        self.paths, self.columns, self.clock = json.loads(options["paths"]), json.loads(options["columns"]), options["clock"]
        self.as_of = datetime.fromisoformat(options["as_of"]).astimezone(UTC)

    def _cutoff(self, kind: pa.DataType) -> datetime | None:
        """The decision time in the clock's type, or None if the clock isn't a timestamp."""
        return (self.as_of if kind.tz else self.as_of.replace(tzinfo=None)) if pa.types.is_timestamp(kind) else None

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            file = _open(path)
            at = file.schema_arrow.get_field_index(self.clock)
            cutoff = self._cutoff(file.schema_arrow.field(at).type) if at >= 0 else None
            leaf = next((i for i in range(file.metadata.num_columns) if file.metadata.schema.column(i).path == self.clock), None)
            for g in range(file.metadata.num_row_groups):
                known = file.metadata.row_group(g).column(leaf).statistics if leaf is not None else None
                late = known is not None and known.has_min_max and known.has_null_count and known.null_count == 0 and cutoff is not None and known.min > cutoff
                if not late:
                    out.append(_Part(path, g))
        return out or [_Part("", 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        file = _open(partition.path)
        cutoff = self._cutoff(file.schema_arrow.field(self.clock).type)
        for batch in file.iter_batches(row_groups=[partition.group], columns=self.columns):
            batch = batch.select(self.columns)
            if cutoff is not None:
                clock = batch.column(self.clock)
                late = pc.fill_null(pc.greater(clock, pa.scalar(cutoff, clock.type)), False)
                batch = batch.filter(pc.invert(late))
            if batch.num_rows:
                yield batch


class PartsSource(DataSource):
    """Options: paths and columns (JSON lists), clock, as_of (an instant)."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_parts"

    def schema(self) -> StructType:
        whole = _open(json.loads(self.options["paths"])[0]).schema_arrow
        # timestamps without a zone stay so
        return from_arrow_schema(pa.schema([whole.field(c) for c in json.loads(self.options["columns"])]), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PartsReader(dict(self.options))


class Parts(Connector):
    """Parquet files through the data source above: it takes over the plan's columns and, where the clock is a timestamp, its decision time."""

    name = "parts"
    capabilities = Capabilities(projection=True, as_of=True)

    def read(self, spark: SparkSession, request: Request) -> tuple[DataFrame, Taken]:
        ship_package(spark)
        spark.dataSource.register(PartsSource)
        paths = [f for p in request.paths for f in spark.read.parquet(p).inputFiles()]
        whole = spark.read.parquet(*request.paths).schema
        columns = list(request.plan.scanned or whole.names)
        clock = request.declaration.clock
        options = {"paths": json.dumps(sorted(paths)), "columns": json.dumps(columns), "clock": clock, "as_of": request.plan.as_of.isoformat()}
        took = clock in whole.names and whole[clock].dataType.typeName() in ("timestamp", "timestamp_ntz")
        return spark.read.format(PartsSource.name()).options(**options).load(), Taken(projection=bool(request.plan.scanned), as_of=took)


class FilesOf(Connector):
    """Spark's own reader of CSV or Parquet files, into which Spark pushes what it can by itself."""

    name = "spark"

    def __init__(self, kind: str):
        self.kind = kind

    def accepts(self, declaration: Declaration) -> bool:
        return declaration.kind == self.kind

    def read(self, spark: SparkSession, request: Request) -> tuple[DataFrame, Taken]:
        return files.read(spark, self.kind, list(request.paths)), Taken()
