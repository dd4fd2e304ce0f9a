"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import Scratch, fresh_folder, shared_dir, ship_package, written

__all__ = ["Scratch", "fresh_folder", "shared_dir", "written"]

#: Words are runs of characters other than these six; fixed by the operators' contracts.
WORD = r"[^\x20\x09-\x0D]+"
WHITESPACE = " \t\n\v\f\r"
#: Lower-casing is of A-Z only where a contract asks for it.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Rows and bytes of an Arrow batch, so that long texts cannot fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20

#: Rows of a key that stay together; and how many keys may have more, at most: with more rows in all, a key has to have its share of them.
SLICE, HOT_KEYS = 1000, 100_000
#: Rows of a table that is broadcast for a join (of less than 100 bytes each); beyond that, both sides are shuffled.
FEW_ROWS = 250_000


def session_defaults(spark: SparkSession) -> None:
    """Keeps Arrow batches small (a session that already asks for smaller ones is left alone), and sends the package to executors that lack it."""
    ship_package(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int((spark.conf.get(key) or "0").rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frequent(counts: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(key, slices) of the keys of counts (key, size) that have more than SLICE rows and more than one of HOT_KEYS parts of all rows; so there are fewer than HOT_KEYS. None without any."""
    most, total = counts.agg(F.max("size"), F.sum("size")).first()
    bound = max(SLICE, (total or 0) // HOT_KEYS)
    if (most or 0) <= bound:
        return None
    return scratch.written(counts.where(F.col("size") > bound).select("key", F.ceil(F.col("size") / SLICE).cast("int").alias("slices")), "dedup-frequent")


def skew_join(rows: DataFrame, table: DataFrame, key: str, spread: str | Column, hot: DataFrame | None, how: str = "inner", few: bool = False) -> DataFrame:
    """rows joined with table (one row for each key) by key. Rows of a key in hot, as frequent() gives them, are dealt to its slices by spread, and the table's row is there for each slice. few says that the table has FEW_ROWS at most: then it is broadcast, the rows stay where they are, and hot may be None."""
    if few:
        return rows.join(F.broadcast(table), key, how)
    if hot is None:
        return rows.join(table, key, how)
    hot = F.broadcast(hot.withColumnRenamed("key", key))  # fewer than HOT_KEYS rows
    one = F.coalesce("slices", F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("slice", F.pmod(F.xxhash64(spread), one).cast("int")).drop("slices")
    spread_out = table.join(hot, key, "left").withColumn("slice", F.explode(F.sequence(F.lit(0), one - 1))).drop("slices")
    return dealt.join(spread_out, [key, "slice"], how).drop("slice")


def counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("size"))


def map_batches(df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, end: Callable[[], None] | None = None) -> DataFrame:
    """df.mapInArrow of a function from batch to batch; end is called when a task has no more of them, as its worker lives on. Columns whose names are more than letters, digits and _ (which mapInArrow may not read) have others meanwhile, if they come back in a schema by ddl()."""
    session_defaults(df.sparkSession)
    odd = [c for c in df.columns if not re.fullmatch(r"\w+", c)]
    meanwhile = dict(zip(odd, free(df, *(f"column_{i}" for i in range(len(odd)))), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield step(batch)
        finally:
            if end:
                end()

    if not odd or isinstance(schema, str):
        return df.mapInArrow(run, schema)
    fields = [StructField(meanwhile.get(f.name, f.name), f.dataType, f.nullable) for f in schema.fields]
    return df.toDF(*(meanwhile.get(c, c) for c in df.columns)).mapInArrow(run, StructType(fields)).toDF(*(f.name for f in schema.fields))


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with more columns at its end."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def ddl(df: DataFrame, more: str) -> StructType:
    """The schema of df, and more columns after it, as DDL says them."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def tick(name: str) -> str:
    """A column's name as Spark reads it, whatever is in it."""
    return f"`{name.replace('`', '``')}`"


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened by _ until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names."""
    low = {x.lower() for x in names}
    return df.select(*(tick(c) for c in df.columns if c.lower() not in low))


def quoted(df: DataFrame) -> list[str]:
    return [tick(c) for c in df.columns]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null is empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def id_text(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).cast("string")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32(doc_id as text) mod 5 = 0, or no doc_id."""
    return F.coalesce(F.crc32(F.encode(id_text(doc_id), "UTF-8")) % 5 == 0, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit integers (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
