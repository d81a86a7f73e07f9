"""Versioned tables on any file system that Spark knows.

A table is a list of Parquet parts, and the catalog a numbered JSON file that names every table's parts, the views and
the indexes. A commit writes the next version under another name and renames it to its number, which fails if that
number is taken: a version is never seen half-written, readers keep the version they began with, two writers cannot
both commit, and a rollback just forgets the new parts. Stores without such a rename are no place for a catalog. Deletions and updates rewrite only the parts
that hold rows they touch.
"""

from __future__ import annotations

import copy
import json
import os
import tempfile
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession
from pyspark.sql import types as T


class CatalogError(ValueError):
    """A table, view or index that exists already, is missing, or does not fit."""


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, or in a temporary folder where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise CatalogError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or os.path.join(tempfile.gettempdir(), "sparkwright-shared")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """A folder of some Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm = root.rstrip("/"), spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, content: str) -> bool:
        """Writes a new file, whole or not at all; false if there is one of that name already, also if it came up just now."""
        half = self._path(f"{name}.{uuid.uuid4().hex}.part")
        stream = self._fs.create(half, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(half, self._path(name), options)
        except Py4JJavaError:
            self._fs.delete(half, False)
            if self._fs.exists(self._path(name)):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def size(self, name: str) -> int:
        at = self._path(name)
        return self._fs.getContentSummary(at).getLength() if self._fs.exists(at) else 0


@dataclass
class Column:
    name: str
    kind: str  # int or varchar
    length: int = 0

    def spark_type(self) -> T.DataType:
        return T.IntegerType() if self.kind == "int" else T.StringType()

    def default(self) -> int | str:
        return 0 if self.kind == "int" else ""


@dataclass
class Index:
    name: str
    table: str
    column: str
    kind: str


@dataclass
class Table:
    name: str
    columns: list[Column]
    parts: list[str] = field(default_factory=list)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type()) for c in self.columns])

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise CatalogError(f"table {self.name} has no column {name}")


@dataclass
class Catalog:
    """What one version of the database holds."""

    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return copy.deepcopy(self)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise CatalogError(f"no table {name}")
        return self.tables[name]

    def indexes_of(self, table: str) -> list[Index]:
        return [i for i in self.indexes.values() if i.table == table]

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)

    @staticmethod
    def from_json(text: str) -> Catalog:
        x = json.loads(text)
        tables = {k: Table(v["name"], [Column(**c) for c in v["columns"]], v["parts"]) for k, v in x["tables"].items()}
        return Catalog(x["number"], tables, x["views"], {k: Index(**v) for k, v in x["indexes"].items()})


def latest(files: Files) -> tuple[Catalog, int]:
    """The last committed catalog and its number. One that cannot be read is an error: to pass over it would lose its commit."""
    numbers = [int(n[:-5]) for n in files.names("catalog") if n.endswith(".json")]
    if not numbers:
        return Catalog(), 0
    n = max(numbers)
    try:
        return Catalog.from_json(files.read(f"catalog/{n:012d}.json")), n
    except (ValueError, KeyError) as e:
        raise CatalogError(f"version {n} of the catalog cannot be read") from e
