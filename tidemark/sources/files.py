"""Readers by kind, a locator's grammar, and manifests of what was read."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.declaration import PlanError
from ..session import ship_package


def read(spark: SparkSession, kind: str, paths: list[str], schema: str | None = None) -> DataFrame:
    """CSV (with header, strict) or Parquet from a list of paths in order."""
    if kind == "parquet":
        return spark.read.parquet(*sorted(paths))
    if kind == "csv":
        reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
        return reader.csv(sorted(paths), header=True, mode="FAILFAST", enforceSchema=False)
    raise ValueError(f"no reader for {kind}")


def locator(text: str) -> list[str]:
    """The segments of a relative locator with / * ? and whole-segment **; anything else in it is an error."""
    parts = text.split("/")
    if text.startswith("/") or any(p in ("", ".", "..") or re.search(r"[\[\]{}\\]", p) or ("**" in p and p != "**") for p in parts):
        raise ValueError(f"not a portable locator: {text!r}")
    return parts


def _pattern(parts: list[str]) -> re.Pattern[str]:
    """What a path under the root looks like, segment by segment; ** stands for any number of them."""
    out = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in p) + ("" if last else "/")
    return re.compile(out)


def found(spark: SparkSession, root: str, text: str) -> list[str]:
    """The files under root that a locator means, in order of their names; none is an error (SOURCE).

    Only the folder before the first wildcard is listed. On a local file system links must not lead out of root.
    """
    parts = locator(text)
    wild = next((k for k, p in enumerate(parts) if re.search(r"[*?]", p)), len(parts) - 1)
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = system.makeQualified(top)
    base = hadoop.Path(top, "/".join(parts[:wild])) if wild else top
    if not system.exists(base):
        raise PlanError("SOURCE", f"{text!r} is not there")
    prefix, form, names = top.toUri().getPath().rstrip("/") + "/", _pattern(parts), []
    listed = system.listFiles(base, True)
    while listed.hasNext():
        path = listed.next().getPath().toUri().getPath()
        if path.startswith(prefix) and form.fullmatch(path.removeprefix(prefix)):
            names.append(path.removeprefix(prefix))
    if not names:
        raise PlanError("SOURCE", f"{text!r} matches no file")
    if top.toUri().getScheme() == "file":
        real = os.path.realpath(prefix)
        if away := [n for n in names if os.path.commonpath([real, os.path.realpath(prefix + n)]) != real]:
            raise PlanError("SOURCE", f"{away[0]!r} leads out of its root")
    return [hadoop.Path(top, n).toString() for n in sorted(names)]


#: Bytes of a file that are hashed at a time; part of what a tree hash is.
RANGE = 64 << 20
#: Bytes that a task holds of a range.
_PIECE = 1 << 20


def uri(path: str) -> str:
    """A path as Spark names it, as Arrow's file systems do."""
    return re.sub(r"^file:/(?!/)", "file:///", path)


def _range_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, offset, size in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "size")), strict=True):
            system, place = fs.FileSystem.from_uri(uri(path))
            leaf, left = hashlib.sha256(offset.to_bytes(8, "big")), size
            with system.open_input_file(place) as f:
                f.seek(offset)
                while left and (piece := f.read(min(left, _PIECE))):
                    leaf.update(piece)
                    left -= len(piece)
            if left:
                raise OSError(f"{path} ends early")
            out.append(leaf.digest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "leaf"])


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """The files under a path that have no byte: Spark's readers pass over them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system, out = place.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if not system.getFileStatus(place).isDirectory():
        return out
    each = system.listFiles(place, True)
    while each.hasNext():
        status = each.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            out.append(status.getPath().toString())
    return out


def manifest(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """name (from the folder's path on), bytes and tree of each file under a path, of any size.

    tree is the SHA-256 of the hashes of the file's ranges in order; ranges are dealt to all tasks and read where they
    lie, a piece at a time. Files are listed by Spark, and their content is read by ranges only.
    """
    ship_package(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    top = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().getPath().rstrip("/") + "/"
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    if hollow := _empty_files(spark, path):
        listed = listed.unionByName(spark.createDataFrame([(p, 0) for p in hollow], "path string, length bigint"))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.expr(f"(length - 1) div {range_bytes}"))))
    ranges = listed.withColumn("part", first).withColumn("offset", F.col("part") * range_bytes).withColumn("size", F.least(F.lit(range_bytes).cast("bigint"), F.col("length") - F.col("offset")))
    # a hash of the range deals the parts of one file to many tasks
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranges.repartition(n, F.xxhash64("path", "offset")).select("path", "length", "offset", "size")
    leaves = dealt.mapInArrow(_range_hashes, "path string, length bigint, offset bigint, size bigint, leaf binary")
    # 32 bytes for each range of a file
    trees = leaves.groupBy("path", "length").agg(F.sort_array(F.collect_list(F.struct("offset", "leaf"))).alias("leaves"))
    tree = F.sha2(F.concat(F.encode(F.concat(F.col("length").cast("string"), F.lit("|")), "UTF-8"), F.encode(F.array_join(F.transform("leaves", lambda x: F.hex(x["leaf"])), ""), "UTF-8")), 256)
    place = F.regexp_replace("path", "^[a-z0-9+.-]+:(//[^/]*)?/", "/")
    name = F.when(F.startswith(place, F.lit(top)), F.substring(place, F.lit(len(top) + 1), F.length(place))).otherwise(F.element_at(F.split("path", "/"), -1))
    return trees.select(name.alias("name"), F.col("length").alias("bytes"), tree.alias("tree"))
