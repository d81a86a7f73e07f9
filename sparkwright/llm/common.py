"""What the corpus operators share: reading tables, Arrow mapping, written intermediate tables."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.shipping import ship

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

def lower_text(text: str) -> str:
    """A text with A-Z lower-cased and nothing else, as the contracts ask; str.lower would change other letters too."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the corpus, read by Spark (the folder may be in any store that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of a table with any other columns; null texts become empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None) -> DataFrame:
    """df.mapInArrow of a function of one batch, or of slices of so many rows; batches of no rows are skipped.

    After each slice the worker gives back the memory that is free, so that a task's memory does not grow with its slices.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = rows or batch.num_rows
            for at in range(0, batch.num_rows, step or 1):
                if (out := fn(batch.slice(at, step))) is not None:
                    yield out
                if rows:
                    out = None
                    give_back()

    return map_batches(df, run, schema)


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim, where there is one."""
    return getattr(ctypes.CDLL(None) if os.name == "posix" else None, "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Returns the memory that this process has freed to the system; a worker that waits for tasks would keep it."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow on executors that have the package; after each task its worker gives back the memory that is free."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    ship(df.sparkSession)
    return df.mapInArrow(task, schema)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def apart(df: DataFrame) -> DataFrame:
    """df dealt out anew, so that a join on the key by which it was aggregated has a shuffle of its own on this side.

    Only then can Spark split a hot key's rows on the other side.
    """
    return df.repartition(partitions(df.sparkSession))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables: spark.checkpoint.dir, which driver and executors share.

    Where that is unset a temporary folder takes its place, but only if all runs on this machine; else it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or os.path.join(tempfile.gettempdir(), "sparkwright-shared")).rstrip("/")


class Tables:
    """Intermediate tables of one operator run, written to the shared folder and read again.

    A written table cuts the lineage and survives lost executors. drop() and keep_only() remove those that are no
    longer needed; what a returned DataFrame still reads goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back."""
        path, schema, conf = f"{self.root}/{name}", df.schema, self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # shuffle files go with the query that wrote them
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.root}/{name}")

    def keep_only(self, *names: str) -> None:
        """Removes all tables of this run but those of these names."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            self.drop(*(name for status in fs.listStatus(at) if (name := status.getPath().getName()) not in names))

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            self._remove(self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone, and with it the folder's use
            return


def in_sample(key: Column, salt: str, n: int, bound: int) -> Column:
    """Whether a row is among about bound of n rows, by a 63-bit hash of key; all rows if n is not more.

    The threshold is a share of 2**63, so it does not vanish for any number of rows.
    """
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1)
    return F.lit(True) if n <= bound else h < F.lit((bound << 63) // n)


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch]], schema: str, n_parts: int | None = None) -> DataFrame:
    """fn of each group of rows with equal keys, which come sorted to one task, one group after another.

    For many small groups; callers bound the size of a group. fn gets the keys' values and the group's rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            values = list(zip(*columns, strict=True))
            at = 0
            while at < len(values):
                end = at
                while end < len(values) and values[end] == values[at]:
                    end += 1
                if key is not None and values[at] != key:
                    yield from fn(key, pa.Table.from_batches(held))
                    held = []
                key = values[at]
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from fn(key, pa.Table.from_batches(held))

    dealt = df.repartition(n_parts or partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return map_batches(dealt, run, schema)
