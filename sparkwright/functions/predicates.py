"""Equality predicates as columns, with the dialect's typing: values of different families are never equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwright.dialect import Constant, Name, Operand, Term


def family(kind: T.DataType) -> str:
    """text, number or the type's own name; only values of one family can be equal."""
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    return "number" if isinstance(kind, T.NumericType) else kind.typeName()


def column(name: Name) -> Column:
    return F.col(f"`{name.table}`.`{name.column}`" if name.table else f"`{name.column}`")


def operand(x: Operand) -> Column:
    return F.lit(x.value) if isinstance(x, Constant) else column(x)


def _family(x: Operand, df: DataFrame) -> str:
    if isinstance(x, Constant):
        return "text" if isinstance(x.value, str) else "number"
    return family(df.select(column(x)).schema[0].dataType)  # unknown and ambiguous columns fail here, in Spark's words


def term(t: Term, df: DataFrame) -> Column:
    """left = right over the columns of df; false if their families differ."""
    return operand(t.left) == operand(t.right) if _family(t.left, df) == _family(t.right, df) else F.lit(False)


def predicate(terms: tuple[Term, ...], df: DataFrame) -> Column:
    """The conjunction of terms; true for none."""
    return reduce(lambda a, b: a & b, (term(t, df) for t in terms), F.lit(True))


#: Catalyst's comparisons for equality.
_EQUALITIES = {"EqualTo", "EqualNullSafe", "In"}
_NUMBERS = {"byte", "short", "integer", "long", "float", "double", "decimal"}


def mixed_equalities(df: DataFrame) -> list[str]:
    """The equalities of an analysed query in which Spark itself casts between a text and a number."""
    sequence = lambda s: (s.apply(i) for i in range(s.size()))
    by_user = df.sparkSession._jvm.org.apache.spark.sql.catalyst.expressions.Cast.USER_SPECIFIED_CAST()
    named = lambda kind: "number" if (name := kind.typeName().split("(")[0]) in _NUMBERS else name
    out: list[str] = []

    def coerced(e) -> bool:
        if e.getClass().getSimpleName() != "Cast" or e.getTagValue(by_user).isDefined():
            return False
        return {named(e.dataType()), named(e.child().dataType())} == {"number", "string"}

    def walk_expression(e) -> None:
        children = list(sequence(e.children()))
        if e.getClass().getSimpleName() in _EQUALITIES and any(map(coerced, children)):
            out.append(e.sql())
        for c in children:
            walk_expression(c)

    def walk(plan) -> None:
        for e in sequence(plan.expressions()):
            walk_expression(e)
        for p in (*sequence(plan.children()), *sequence(plan.subqueries())):
            walk(p)

    walk(df._jdf.queryExecution().analyzed())
    return out


def constants(terms: tuple[Term, ...]) -> dict[Name, int | str]:
    """Columns that a term equates with a constant, by the first such term."""
    out: dict[Name, int | str] = {}
    for t in terms:
        for a, b in ((t.left, t.right), (t.right, t.left)):
            if isinstance(a, Name) and isinstance(b, Constant):
                out.setdefault(a, b.value)
    return out
