"""Connectors by kind of source, reads that notice when their files change, and snapshots named by their content."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard, joins
from ..plans.declaration import Declaration, PlanError, ReadPlan, read_plan
from . import files
from .connectors import Connector, FilesOf, Parts, Request, Taken, checked

#: The simplest connector: it makes a DataFrame of a declaration's source, whole.
Source = Callable[[SparkSession, Declaration], DataFrame]


class Registry:
    """Connectors by kind. With a root, locators of files are portable ones under it; without, they are paths as Spark takes them."""

    def __init__(self, root: str | None = None) -> None:
        self._connectors: dict[str, Connector | Source] = {}
        self.root = root
        for kind in ("csv", "parquet"):
            self.register(kind, FilesOf(kind))
        self.register("parts", Parts())

    def register(self, kind: str, connector: Connector | Source) -> None:
        if kind in self._connectors:
            raise PlanError("CONFIG", f"{kind} has a connector")
        if not callable(connector) and not isinstance(connector, Connector):
            raise PlanError("CONFIG", f"{kind} is no connector")
        self._connectors[kind] = connector

    def kinds(self) -> list[str]:
        return sorted(self._connectors)

    def read(self, spark: SparkSession, plan: ReadPlan) -> DataFrame:
        """The plan's rows, by the connector of its declaration's kind and always through the guard, whatever the connector says that it has done."""
        return self.reported(spark, plan)[0]

    def reported(self, spark: SparkSession, plan: ReadPlan) -> tuple[DataFrame, Taken]:
        """The plan's rows, and what the connector says that it took over."""
        df, taken = self._source(spark, plan)
        return guard.guarded(df, plan, locate=plan.declaration.kind == "parquet"), taken

    def source(self, spark: SparkSession, d: Declaration) -> DataFrame:
        """All rows of a declared source, for connectors that are made of others."""
        return self._source(spark, ReadPlan(d, datetime.max.replace(tzinfo=UTC), (), ()))[0]

    def _source(self, spark: SparkSession, plan: ReadPlan) -> tuple[DataFrame, Taken]:
        d = plan.declaration
        if d.kind not in self._connectors:
            raise PlanError("CONFIG", f"no connector for {d.kind}")
        connector = self._connectors[d.kind]
        try:
            if not isinstance(connector, Connector):
                return connector(spark, d), Taken()
            if not connector.accepts(d):
                raise PlanError("CONFIG", f"{connector.name} doesn't read {d.name}")
            request = Request(plan, tuple(files.found(spark, self.root, d.locator) if self.root else [d.locator]))
            return checked(connector, connector.read(spark, request), request)
        except PlanError:
            raise
        except Exception as e:
            raise PlanError("SOURCE", redacted(str(e))) from None


def composite_connector(registry: Registry, primary: Declaration, membership: Declaration, member: str, keys: list[str]) -> Source:
    """A connector of primary's rows with the point-in-time membership of another source, on shared keys.

    It gives primary's columns with `available`, the later availability of both sides, and `eligible`, tradable and a
    member; the declaration of the composite has these as its clock and mask. It goes through the registry's guard
    like any source, at whatever time is asked, and is an error on missing or repeated membership when rows are read.
    """
    if not primary.available_time or not primary.mask or not membership.available_time:
        raise PlanError("CONFIG", "a composite needs an available_time on both sides, and a mask")

    def connect(spark: SparkSession, d: Declaration) -> DataFrame:
        a, b = registry.source(spark, primary), registry.source(spark, membership)
        a = a.withColumns({"available": F.col(primary.available_time), "tradable": F.col(primary.mask)})
        b = b.select(*keys, F.col(membership.available_time).alias("member_available"), F.col(member).alias("member"))
        return joins.composite(a, b, keys).drop("member", "member_available")

    return connect


def redacted(message: str) -> str:
    """A message without the values of passwords, tokens and keys, and without credentials in addresses."""
    message = re.sub(r"(?i)\b(password|passwd|secret|token|api[_-]?key)(\s*[=:]\s*)\S+", r"\1\2***", message)
    return re.sub(r"(\w+://)[^/\s@]+@", r"\1***@", message)


def point(registry: Registry, spark: SparkSession, d: Declaration, as_of: str, columns: list[str] | None = None) -> DataFrame:
    """What was known at as_of; of named columns, the mask comes along."""
    asked = [*columns, *([d.mask] if d.mask and d.mask not in columns else [])] if columns else None
    return registry.read(spark, read_plan(d, as_of, asked))


def panel(registry: Registry, spark: SparkSession, d: Declaration, as_of: str, columns: list[str] | None = None) -> DataFrame:
    """The same with entity, clocks and mask in front."""
    front = list(dict.fromkeys(c for c in (d.entity, d.event_time, d.available_time, d.mask) if c))
    return registry.read(spark, read_plan(d, as_of, [*front, *(columns or [])] if columns else None))


def _print(spark: SparkSession, path: str) -> str:
    """One digest of all files under a path: sums of their rows' hashes, so that no list of files meets in one place."""
    return rows_digest(files.manifest(spark, path))


@contextmanager
def unchanged(spark: SparkSession, path: str) -> Iterator[str]:
    """Gives the digest of the files under path, and is an error if they are others when the block ends; actions belong inside."""
    before = _print(spark, path)
    yield before
    if _print(spark, path) != before:
        raise PlanError("SOURCE_CHANGED", path)


def rows_digest(df: DataFrame) -> str:
    """A digest of a result's rows whatever their order: of columns by name, nulls apart from empty texts.

    Counts and sums of four parts of each row's hash add up on the executors, so that no list of hashes meets in one place.
    """
    cells = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in sorted(df.columns)]
    h = df.select(F.sha2(F.to_json(F.array(*cells)), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    total = h.agg(F.count("*").cast("string"), *parts).first()
    names = json.dumps(sorted((f.name, f.dataType.simpleString()) for f in df.schema.fields))
    spark = df.sparkSession
    return spark.range(1).select(F.sha2(F.concat_ws("|", F.lit(names), *(F.lit(x or "0") for x in total)), 256)).first()[0]


def _place(spark: SparkSession, path: str):
    """A path, and the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _published(df: DataFrame, path: str) -> None:
    """Writes df aside and renames it when whole, unless something is there already: an interrupted write is never taken for a whole one."""
    spark = df.sparkSession
    whole, system = _place(spark, path)
    folder, _, name = path.rpartition("/")
    aside, _ = _place(spark, f"{folder}/_{name}-{uuid.uuid4().hex}")
    if not system.exists(whole):
        df.write.parquet(aside.toString())
        if system.exists(whole) or not system.rename(aside, whole):  # another writer was first
            system.delete(aside, True)


def save_snapshot(df: DataFrame, store: str, clock: str | None = None) -> str:
    """Writes df as Parquet to a folder named by its digest, unless it is there already; gives the digest.

    With a clock, files are ranges of it, and a zone map is kept beside the snapshot: the smallest and largest clock and
    the number of rows without one, by file.
    """
    digest, spark = rows_digest(df), df.sparkSession
    if clock:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartitionByRange(n, clock).sortWithinPartitions(clock)
    _published(df, f"{store}/{digest}")
    if clock:
        saved = spark.read.parquet(f"{store}/{digest}")
        rows = saved.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), guard.moment(saved, clock).alias("m"))
        _published(rows.groupBy("file").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.count_if(F.col("m").isNull()).alias("without"), F.count("*").alias("n")), f"{store}/{digest}.{clock}.zones")
    return digest


def _there(spark: SparkSession, store: str, digest: str, name: str = "") -> str:
    if not re.fullmatch("[0-9a-f]{64}", digest):
        raise PlanError("CONFIG", "not a digest")
    place, system = _place(spark, f"{store}/{digest}{name}")
    if not system.exists(place):
        raise PlanError("READ_SET_UNAVAILABLE", f"{digest}{name} is not in the store")
    return place.toString()


def load_snapshot(spark: SparkSession, store: str, digest: str) -> DataFrame:
    """The snapshot, if its rows still are what its name says; one that isn't there is READ_SET_UNAVAILABLE."""
    df = spark.read.parquet(_there(spark, store, digest))
    if rows_digest(df) != digest:
        raise PlanError("SNAPSHOT_CORRUPT", digest)
    return df


def snapshot_as_of(spark: SparkSession, store: str, digest: str, d: Declaration, as_of: str, columns: list[str] | None = None) -> DataFrame:
    """What of a snapshot with a zone map was known at as_of, through the guard. Files of which nothing was known are not read; those with rows without a clock are.

    The rows aren't checked against the snapshot's name, which needs all of them; load_snapshot() does that.
    """
    folder, plan = _there(spark, store, digest), read_plan(d, as_of, columns)
    zones = spark.read.parquet(_there(spark, store, digest, f".{d.clock}.zones"))
    if zones.schema["first"].dataType.typeName() == "long":
        cutoff = F.lit(int(plan.as_of.timestamp() * 1000))
    else:
        cutoff = F.lit(plan.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    names = sorted(r["file"] for r in zones.where((F.col("without") > 0) | (F.col("first") <= cutoff)).select("file").collect())  # a name for each file
    whole = spark.read.parquet(folder)
    known = spark.read.schema(whole.schema).parquet(*(f"{folder}/{n}" for n in names)) if names else whole.limit(0)
    return guard.guarded(known, plan, locate=bool(names))
