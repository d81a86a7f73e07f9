"""Rows as comparable bags."""


def bag(rows):
    """Rows as a sorted list of tuples by column name."""
    out = [tuple(v for _, v in sorted(r.asDict(recursive=True).items())) for r in rows]
    return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))
