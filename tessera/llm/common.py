"""Shared helpers: intermediate tables in the cluster's shared folder, and byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of any text: runs of anything but ASCII white space.
SPACES = b" \t\n\r\x0b\x0c"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every ASCII character that is neither letter nor digit into a space.
ALNUM = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
CONTINUATION = bytes(range(0x80, 0xC0))

#: The same words for Spark's own expressions, over text that keeps its case.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def work_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Intermediate tables of one run of an operator, as Parquet files in the shared folder.

    keep() writes a frame and reads it again, which cuts its lineage; a lost executor costs
    no more than the tasks that ran on it. drop() removes a table that nothing reads any more, close() all of them.
    An operator's result reads its last tables until it is itself written; then close_all() may go.
    """

    opened: ClassVar[list[Workspace]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.top, self.n = spark, f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        Workspace.opened.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        path = f"{self.top}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df.kept_at)

    def close(self) -> None:
        self._delete(self.top)
        Workspace.opened.remove(self)

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @classmethod
    def close_all(cls, *but: Workspace) -> None:
        """Deletes the tables of every operator that ran so far, but for these workspaces."""
        for w in [w for w in cls.opened if w not in but]:
            w.close()


def remainder(key: str, mod: int) -> Column:
    """crc32 of a key's text modulo mod; a null key has remainder 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def per_document(df: DataFrame, columns: list[str], fields: list[T.StructField], work: Callable[[bytes], tuple]) -> DataFrame:
    """columns of df, then fields, which work makes of each text (UTF-8; null: empty). Arrow batches, one row for a row."""
    schema = T.StructType([*(df.schema[c] for c in columns), *fields])
    arrow = pa.schema([(f.name, to_arrow(f.dataType)) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [work(x or b"") for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            cols = list(zip(*made, strict=True)) if made else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True))], names=schema.names)

    return df.select(*columns, F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def to_arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(to_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary()}[type(kind)]


#: A key that more than one in so many rows has is joined by itself: there are no more than these.
HOT_KEYS = 10_000


def join_by_key(rows: DataFrame, keys: DataFrame, on: list[str], weight: str, total: int) -> DataFrame:
    """rows joined (inner) with keys, one row for each key; weight: a column of keys, how many of rows have the key, total of them.

    Keys of more than total / HOT_KEYS rows are fewer than HOT_KEYS, so they can be broadcast whatever the rows hold; the rows of
    the others shuffle, and none of their keys has more than one in HOT_KEYS of all.
    """
    hot = F.broadcast(keys.where(F.col(weight) * HOT_KEYS > total).drop(weight))
    rest = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(weight) * HOT_KEYS <= total).drop(weight), on)
    return rows.join(hot, on).unionByName(rest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One in no more pieces than two a core is dealt over all cores, as its texts cost more to work on than to move.

    A large table has more pieces than that and stays as it is.
    """
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 2 * cores else df
