"""The relational operators as functions of DataFrames; Catalyst chooses how they run unless a hint says otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwright.functions.aggregates import Aggregate, PandasCustom
from sparkwright.sources.storage import shared_path

#: Bytes, by Spark's estimate, up to which the inner side of an index join is broadcast.
SMALL_BYTES = 64 << 20


def project(df: DataFrame, *columns: str) -> DataFrame:
    """Columns in the order given; duplicates stay, rows are not made distinct."""
    return df.select(*(F.col(c) for c in columns))


def select(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def product(*sides: DataFrame) -> DataFrame:
    """All combinations of rows; equalities in a later filter make it an equi-join."""
    return reduce(lambda a, b: a.crossJoin(b), sides)


def product_chunked(left: DataFrame, right: DataFrame) -> DataFrame:
    """A product dealt out over tasks by blocks of both sides, so that neither is held whole."""
    return left.hint("shuffle_replicate_nl").crossJoin(right)


def _equal(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[x] == right[y] for x, y in pairs))


def join(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """An inner equi-join on pairs of columns, by the algorithm that Spark chooses."""
    return left.join(right, _equal(left, right, [*pairs]))


def join_hash(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A shuffled hash join; the left side is built."""
    return left.hint("shuffle_hash").join(right, _equal(left, right, [*pairs]))


def join_merge(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A sort-merge join."""
    return left.hint("merge").join(right, _equal(left, right, [*pairs]))


def join_index(outer: DataFrame, inner: DataFrame, *pairs: tuple[str, str], most_bytes: int = SMALL_BYTES) -> DataFrame:
    """A lookup of each outer row in the inner side, by broadcast if that is most_bytes or less by Spark's estimate, else by merge."""
    size = int(str(inner._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return outer.join(F.broadcast(inner) if size <= most_bytes else inner.hint("merge"), _equal(outer, inner, [*pairs]))


def group_by(df: DataFrame, keys: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """Keys and aggregates of each group; no rows in, no groups out.

    Spark does not mix pandas aggregates with others, so they are grouped on their own and joined by the keys.
    """
    sorts = [[a for a in aggregates if isinstance(a, PandasCustom) is python] for python in (False, True)]
    made = [df.groupBy(*keys).agg(*(a.column().alias(a.name) for a in some)) for some in sorts if some]
    if len(made) == 1:
        return made[0]
    plain, python = made
    renamed = python.select(*(F.col(k).alias(f"_{k}") for k in keys), *(a.name for a in sorts[1]))
    same = reduce(lambda a, b: a & b, (plain[k].eqNullSafe(renamed[f"_{k}"]) for k in keys))
    return plain.join(renamed, same).select(*keys, *(a.name for a in aggregates))


def sort(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending by the columns."""
    return df.orderBy(*columns)


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once to the session's shared folder and read from there."""
    path, schema = shared_path(df.sparkSession, "materialized"), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
