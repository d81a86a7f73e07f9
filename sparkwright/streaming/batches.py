"""Loading streams of statements: changes are committed in batches, and inserts of a batch are one append."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from sparkwright import dialect
from sparkwright.session import Engine

BATCH = 2000


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Statements as they complete in a stream of lines."""
    held = ""
    for line in lines:
        held += line if line.endswith("\n") else f"{line}\n"
        if ";" in line:
            *done, rest = dialect.split_statements(held + "\n") if not held.rstrip().endswith(";") else [*dialect.split_statements(held), ""]
            yield from done
            held = f"{rest}\n" if rest else ""
    yield from dialect.split_statements(held)


class BatchError(ValueError):
    """A statement of a batch failed; the batch is rolled back."""


def load(engine: Engine, source: Iterable[str], *, batch: int = BATCH, on_query: Callable[[str], None] | None = None) -> int:
    """Runs the changes of a stream, committing every batch of them; returns their number.

    A query commits what is pending and goes to on_query. A statement that fails rolls its batch back and ends the
    load, naming the statement; batches before it stay.
    """
    done = pending = 0
    for sql in statements(source):
        try:
            if sql.split(None, 1)[0].lower() in ("insert", "delete", "update", "create"):
                engine.update(sql)
                pending += 1
            else:
                engine.commit()
                done, pending = done + pending, 0
                if on_query:
                    on_query(sql)
        except Exception as e:
            engine.rollback()
            raise BatchError(f"{sql[:200]}: {e}") from e
        if pending == batch:
            engine.commit()
            done, pending = done + pending, 0
    engine.commit()
    return done + pending


def run_files(engine: Engine, *paths: str) -> int:
    """Runs scripts in one transaction; returns the number of changes. Queries are planned, so that errors show."""
    changes = 0
    try:
        for path in paths:
            with open(path, encoding="utf-8") as script:
                for sql in dialect.split_statements(script.read()):
                    if sql.split(None, 1)[0].lower() == "select":
                        _ = engine.query(sql).schema
                    else:
                        engine.update(sql)
                        changes += 1
    except Exception:
        engine.rollback()
        raise
    engine.commit()
    return changes
