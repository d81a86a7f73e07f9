"""Relational operators."""

from sparkwright.operators.relational import (
    group_by,
    join,
    join_hash,
    join_index,
    join_merge,
    materialize,
    product,
    product_chunked,
    project,
    select,
    sort,
)

__all__ = ["group_by", "join", "join_hash", "join_index", "join_merge", "materialize", "product", "product_chunked", "project", "select", "sort"]
