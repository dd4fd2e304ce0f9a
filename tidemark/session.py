"""The Spark session: defaults of our own, this package on the executors, and the folder that all of them share."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf has further settings, with _ for the dots in their names."""
    builder = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, unless they find it by PYTHONPATH as the driver does."""
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == PACKAGE.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if on_path or context.applicationId in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="tidemark-")
    context.addPyFile(shutil.make_archive(f"{folder}/{PACKAGE.name}", "zip", PACKAGE.parent, PACKAGE.name))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session with a local master may do without it."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: What written() has written, by application, until clear_written() deletes it.
_tables: dict[str, list[str]] = {}


def clear_written(spark: SparkSession) -> None:
    """Deletes all tables that written() made for this application. Results that read them must have been taken by then."""
    for path in _tables.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: its lineage ends there and no lost executor takes it along.

    Results read such tables after this returns, so that they stay until clear_written() is called.
    """
    path = fresh_folder(df.sparkSession, name)
    _tables.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one job: written() as it goes along, and deleted together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_folder(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            delete(self.spark, self.paths.pop())
