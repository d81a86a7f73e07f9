"""A client in the manner of database drivers: connections, statements, result sets and their metadata."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from sparkwright.dialect import Command, parse
from sparkwright.session import Engine


def connect(spark: SparkSession, path: str) -> Connection:
    """A connection to the database in a folder."""
    return Connection(Engine(spark, path))


class Connection:
    """A transaction at a time; closing commits."""

    def __init__(self, engine: Engine):
        self.engine = engine

    def create_statement(self) -> Statement:
        return Statement(self)

    def commit(self) -> None:
        self.engine.commit()

    def rollback(self) -> None:
        self.engine.rollback()

    def close(self) -> None:
        self.engine.commit()

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind, *_) -> None:
        self.rollback() if kind else self.close()


class Statement:
    """Runs queries and changes; a change commits at once, a failed one is rolled back."""

    def __init__(self, connection: Connection):
        self.connection = connection

    def execute_query(self, sql: str) -> ResultSet:
        """The rows of a SELECT, or the lines of an EXPLAIN [ANALYZE]."""
        engine = self.connection.engine
        words = sql.split(None, 2)
        if words and words[0].lower() == "explain":
            command = parse(sql)
            assert isinstance(command, Command)
            text = engine.explain(command.text) if command.name == "explain" else str(engine.explain_analyze(command.text))
            return ResultSet(self.connection, engine.spark.createDataFrame([(x,) for x in text.split("\n")], "plan string"))
        return ResultSet(self.connection, engine.query(sql))

    def execute_update(self, sql: str) -> int:
        engine = self.connection.engine
        try:
            count = engine.update(sql)
        except Exception:
            engine.rollback()
            raise
        engine.commit()
        return count

    def close(self) -> None:
        """Nothing is held open."""


class MetaData:
    """Columns of a result, counted from 1."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def column_count(self) -> int:
        return len(self.schema)

    def column_name(self, i: int) -> str:
        return self.schema[i - 1].name

    def column_type(self, i: int) -> str:
        return self.schema[i - 1].dataType.simpleString()

    def column_display_size(self, i: int) -> int:
        numeric = isinstance(self.schema[i - 1].dataType, T.NumericType)
        return max(len(self.column_name(i)), 6 if numeric else 14) + 1


class ResultSet:
    """A cursor over a query's rows, which come from the executors partition by partition."""

    def __init__(self, connection: Connection, df: DataFrame):
        self.connection, self.df = connection, df
        self._rows: Iterator[Row] | None = None
        self._row: Row | None = None
        self._places = {name.lower(): i for i, name in enumerate(df.columns)}

    def next(self) -> bool:
        if self._rows is None:
            self._rows = self.df.toLocalIterator()
        self._row = next(self._rows, None)
        return self._row is not None

    def _value(self, column: str):
        if self._row is None:
            raise ValueError("no current row")
        return self._row[self._places[column.lower()]]

    def get_int(self, column: str) -> int:
        return int(self._value(column))

    def get_string(self, column: str) -> str:
        return str(self._value(column))

    def metadata(self) -> MetaData:
        return MetaData(self.df.schema)

    def close(self) -> None:
        self.connection.commit()
