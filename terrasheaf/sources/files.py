"""Files of any store: Spark finds them; tasks read ranges where Arrow knows the store, else what Spark hands them."""

from __future__ import annotations

import tempfile
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stores that Arrow reads by range. Of others, a task gets whole files (2 GB at most) from Spark's binary reader.
RANGED = ("file", "s3", "s3a", "gs", "hdfs")
BLOCK_BYTES = 1 << 16


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); a temporary one on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, content) of files, folders or globs; a column that is not selected is not read."""
    return spark.read.format("binaryFile").load(path)


def open_file(path: str, content: bytes | None = None) -> pa.NativeFile:
    """A file to read at any place; content: its bytes, if Spark has read them."""
    if content is not None:
        return pa.BufferReader(content)
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":  # Spark writes file:/a, and escapes as in an address
        store, name = fs.LocalFileSystem(), urllib.parse.unquote("/" + rest.lstrip("/"))
    else:
        store, name = fs.FileSystem.from_uri(("s3" if scheme == "s3a" else scheme) + ":" + rest)
    return store.open_input_file(name)


def with_content(files: DataFrame) -> DataFrame:
    """(path, content): content only for stores that Arrow does not read by range, told by the first file."""
    first = files.select("path").first()
    if first is not None and first["path"].partition(":")[0] not in RANGED:
        return files.select("path", "content")
    return files.select("path", F.lit(None).cast("binary").alias("content"))


def renamed(spark: SparkSession, path: str, old: str, new: str) -> None:
    """The files of a folder that end in `old` end in `new` from now on: names alone pass through the driver."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(folder):
        name = status.getPath().getName()
        if status.isFile() and name.endswith(old) and not name.startswith(("_", ".")):
            store.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(status.getPath().getParent(), name.removesuffix(old) + new))
    spark.catalog.refreshByPath(path)


def running_totals(df: DataFrame, order: str, value: str, result: str) -> DataFrame:
    """df with the sum of `value` over all rows before, by a unique `order`.

    Rows are dealt by range and written; only the sums of ranges, one row each, reach the driver, and running sums are
    made inside the ranges."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "ranges")
    df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    before, total = [], 0
    for row in dealt.groupBy("_range").agg(F.sum(value).alias("n")).orderBy("_range").collect():
        before.append((row["_range"], total))
        total += row["n"]
    inner = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = spark.createDataFrame(before, "_range int, _before long")
    return dealt.join(F.broadcast(started), "_range").withColumn(result, F.col("_before") + inner).drop("_range", "_before")


class Blocks:
    """The bytes of an open file, read in blocks that are kept while the file is looked at."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.kept = file, file.size(), {}

    def __len__(self) -> int:
        return self.size

    def at(self, start: int, length: int) -> bytes:
        """length bytes from start on; past the end: an error."""
        if start < 0 or start + length > self.size:
            raise ValueError(f"{length} bytes at {start} lie outside a file of {self.size}")
        first, last = start // BLOCK_BYTES, max(start, start + length - 1) // BLOCK_BYTES
        if last - first > 4:  # a long range needs no blocks
            return self.file.read_at(length, start)
        for k in range(first, last + 1):
            if k not in self.kept:
                self.kept[k] = self.file.read_at(min(BLOCK_BYTES, self.size - k * BLOCK_BYTES), k * BLOCK_BYTES)
        whole = b"".join(self.kept[k] for k in range(first, last + 1))
        return whole[start - first * BLOCK_BYTES : start - first * BLOCK_BYTES + length]


def rows_of_files(files: DataFrame, schema: str, rows: Callable[[str, pa.NativeFile], list[tuple]]) -> DataFrame:
    """rows(path, open file) of every file of `files` (path, content), in tasks."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                with open_file(path.as_py(), content.as_py()) as file:
                    cols = list(zip(*rows(path.as_py(), file), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return files.mapInArrow(run, schema)
