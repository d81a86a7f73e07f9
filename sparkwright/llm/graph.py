"""Connected components of an edge table, by alternating large and small stars (Kiveris et al., 2014).

Every round is two aggregations and joins over the edges, written to the shared folder, so that neither the driver
nor any task holds a component, however large. A vertex of many edges is a skewed join key, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwright.llm.common import Tables, map_batches, partitions

#: Edges of which a task keeps a spanning forest at a time.
THINNED = 200_000

def forest_of_pairs(pairs: list[tuple]) -> list[tuple]:
    """Those of the pairs that make a spanning forest of their graph."""
    root: dict = {}

    def top(x):
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    out = []
    for x, y in pairs:
        if (p := top(x)) != (q := top(y)):
            root[p] = q
            out.append((x, y))
    return out



def thinned(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, fewer where many vertices share many neighbours: forests of those that meet at b."""
    schema, n_parts = edges.schema, partitions(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def forest() -> Iterator[pa.RecordBatch]:
            found = forest_of_pairs(held)
            held.clear()
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])

        for batch in batches:
            kind = batch.schema.field(0).type
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(held) >= THINNED:
                yield from forest()
        if held:
            yield from forest()

    return map_batches(edges.repartition(n_parts, "b"), run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is joined to the smallest of u and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are joined to the smallest of these; edges go from smaller a to larger b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    rest = edges.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(node, component): the smallest node that each node of edges (a, b) reaches; nodes without edges are absent."""
    tidy = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = tidy(thinned(tidy(edges.where("a is not null and b is not null and a <> b"))))
    now = tables.write(now, f"{name}-0")
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, step = state(now), 0
    while before[0]:
        step += 1
        now = tables.write(_small_star(_large_star(now)), f"{name}-{step}")
        tables.drop(f"{name}-{step - 1}")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
