"""The command line: python -m sparkwright.cli FOLDER, interactive or with statements piped in."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from sparkwright import dialect
from sparkwright.dialect import Command, Select
from sparkwright.plans.explain import Measured
from sparkwright.session import Engine
from sparkwright.streaming import batches

WIDTH = 15
HELP = """Statements end with a semicolon:
  select ... from ... [where ...]         also any other SELECT of Spark SQL
  insert into t (f, ...) values (c, ...)  delete from t [where ...]  update t set f = e, ... [where ...]
  create table t (f int, g varchar(n))    create view v as select ...  create index i on t(f) [using hash|btree]
  explain [analyze] select ...            compare select ...  indexcmp select ...
  set | set planner heuristic|selinger|basic | set index on|off
  commit | rollback | help | exit"""


def table(df: DataFrame) -> Iterator[str]:
    """A result as lines of columns of WIDTH characters, fetched as they are printed."""
    cell = lambda x: str(x)[: WIDTH - 1].ljust(WIDTH)
    yield "".join(map(cell, df.columns))
    yield "-" * (WIDTH * len(df.columns))
    n = 0
    for row in df.toLocalIterator():
        n += 1
        yield "".join(map(cell, row))
    yield f"{n} rows"


def _compared(found: dict[str, Measured]) -> Iterator[str]:
    for i, (name, m) in enumerate(found.items()):
        if not i:
            yield str(m)
        yield f"{name}: {m.execution_ms:.1f} ms, rows={m.rows}"


def run(engine: Engine, sql: str) -> Iterator[str]:
    """What a statement prints. Changes are committed at once."""
    word = sql.strip().split(None, 1)[0].lower().rstrip(";")
    if word in ("help", "?"):
        yield HELP
        return
    if word in ("commit", "rollback"):
        getattr(engine, word)()
        return
    try:
        parsed = dialect.parse(sql)
    except dialect.DialectError:
        if word not in ("select", "with"):
            raise
        yield from table(engine.query(sql))
        return
    if isinstance(parsed, Select):
        yield from table(engine.query(sql))
    elif isinstance(parsed, Command):
        if parsed.setting:
            engine.set(*parsed.setting)
        if parsed.name == "set":
            yield from (f"{k} = {v}" for k, v in engine.settings().items())
        elif parsed.name == "explain":
            yield engine.explain(parsed.text)
        elif parsed.name == "explain analyze":
            yield str(engine.explain_analyze(parsed.text))
        else:
            yield from _compared(getattr(engine, parsed.name)(parsed.text))
    else:
        count = engine.update(sql)
        engine.commit()
        yield f"{count} rows"


def repl(engine: Engine, source: Iterable[str], out: TextIO) -> None:
    """Reads statements, which may go over several lines, until exit; an error ends only its statement."""
    for sql in batches.statements(source):
        if sql.strip().lower() in ("exit", "quit"):
            return
        try:
            for line in run(engine, sql):
                print(line, file=out)
        except Exception as e:  # noqa: BLE001  shown, and the transaction undone
            engine.rollback()
            print(f"error: {str(e).splitlines()[0]}", file=out)


def main(args: list[str]) -> int:
    engine = Engine(SparkSession.builder.appName("sparkwright").getOrCreate(), *islice(args, 1))
    if sys.stdin.isatty():
        print(HELP)
        repl(engine, sys.stdin, sys.stdout)
        return 0
    show = lambda sql: [print(line) for line in run(engine, sql)]
    try:
        print(f"{batches.load(engine, sys.stdin, on_query=show)} changes")
    except batches.BatchError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
