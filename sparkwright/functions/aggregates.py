"""Grouped aggregates: counts, maxima, and functions of the user's own.

Result columns are called countof<field> and maxof<field>. An aggregate of one's own is any object with an output
name and a column() to be aggregated; a Python one takes a grouped-aggregate pandas function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregate(Protocol):
    """What group_by takes."""

    @property
    def name(self) -> str: ...

    def column(self) -> Column: ...


@dataclass(frozen=True)
class Count:
    """The number of rows of a group."""

    field: str

    @property
    def name(self) -> str:
        return f"countof{self.field}"

    def column(self) -> Column:
        return F.count(self.field)


@dataclass(frozen=True)
class Max:
    """The largest value of a group, of the field's own type."""

    field: str

    @property
    def name(self) -> str:
        return f"maxof{self.field}"

    def column(self) -> Column:
        return F.max(self.field)


@dataclass(frozen=True)
class Custom:
    """An aggregate of one's own over a field: a function of Columns, which stays in the JVM."""

    label: str
    field: str
    of: Callable[[Column], Column]

    @property
    def name(self) -> str:
        return f"{self.label}of{self.field}"

    def column(self) -> Column:
        return self.of(F.col(self.field))


@dataclass(frozen=True)
class PandasCustom:
    """An aggregate of one's own as a function from a group's values, a pandas Series, to one value."""

    label: str
    field: str
    of: Callable[[pd.Series], object]
    returns: str

    @property
    def name(self) -> str:
        return f"{self.label}of{self.field}"

    def column(self) -> Column:
        of = self.of

        def over(values: pd.Series) -> float:
            return of(values)

        return F.pandas_udf(over, self.returns)(F.col(self.field))
