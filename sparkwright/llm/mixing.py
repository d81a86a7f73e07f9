"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document draws an exponential key whose rate is its quality weight, so that ascending keys are a weighted
sample without replacement. A source whose target is k times its size or more gives k complete epochs of all its
documents first; the rest of its target is filled in key order, as far as running sums of sizes reach (the
document in which the target lies counts if at least half of it fits).

Running sums are taken in two levels, so that no source meets in one task: keys are cut into buckets by a monotone
function, sums run within (source, bucket), and the buckets' totals give each its start. Keys come from a hash of
doc_id and a seed, so that reruns agree; rows that are alike in key and text are interchangeable.

Nulls: a null text has size 0, a null source is a source of its own that comes last. Empty tables give no rows. Repeated
rows are documents of their own, each drawn once; those of equal keys, ids and ties are taken in any order. All columns of
the table come back, but for those that have the names of the result's own, which take their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwright.llm.common import WORD

#: Weights of the sources in the order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of all sizes, and the most epochs of a source.
SHARE, MOST_EPOCHS = 1.5, 2
#: Rows that a bucket of the largest source holds, about, and the least number of buckets.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 256


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """A document's sampling weight from 0.5 to 1.5: the fewer mark-up symbols a character, the more."""
    chars = F.length(text)
    plain = F.length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.lit(0.5) + (plain + F.lit(1)).cast("double") / (chars + F.lit(1)), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from the first 48 bits of a hash of doc_id and seed."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)
    return -F.log(u) / weight


def targets(totals: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources that would pass MOST_EPOCHS times their size stop there and the others share the excess by weight: in
    the order of cap over weight, the level at which the rest share what is left is right at the first source that
    it doesn't fill. Its windows hold one row for each source.
    """
    everything = Window.partitionBy()
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))).cast("int") + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * MOST_EPOCHS).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    ranked = (
        ranked.withColumn("place", F.row_number().over(order))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("caps_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weights_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all_size") * SHARE - F.col("caps_before")) / F.col("weights_left"))
    )
    level = F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.col("place"))).over(everything)
    return ranked.withColumn("level", level).select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, *, source_col: str = "source", id_col: str = "doc_id", ties: Column | None = None, seed: int = 0) -> DataFrame:
    """The rows of docs, all columns, with _size, _source_size, _target, _copies and _taken, which replace any of docs.

    _copies is how often the mix holds the document, _taken that many times its size. ties orders rows of equal
    keys and ids (a hash of the text, say).
    """
    n_buckets = max(LEAST_BUCKETS, docs.count() // BUCKET_ROWS)
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("_row"),  # so that no column of docs meets the names below
        size.cast("long").alias("_size"),
        exponential_key(F.col(id_col), weight, seed).alias("_key"),
        (ties if ties is not None else F.lit(0)).alias("_tie"),
        F.col(id_col).alias("_id"),
        F.col(source_col).cast("string").alias("_source"),
    )
    rows = rows.withColumn("_bucket", F.least(F.lit(n_buckets - 1), F.floor(n_buckets * (1 - F.exp(-F.col("_key"))))))

    # sources as (is null, name), so that joins need no null-safe comparison
    part = [F.col("_source").isNull().alias("_none"), F.coalesce("_source", F.lit("")).alias("_name"), F.col("_bucket")]
    buckets = rows.groupBy(*part).agg(F.sum("_size").alias("_bucket_size"))
    per_source = buckets.groupBy("_none", "_name").agg(F.sum("_bucket_size").alias("source_size"))
    goals = targets(per_source.select(F.when(~F.col("_none"), F.col("_name")).alias("source"), "source_size"))
    goals = goals.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_name"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    order = Window.partitionBy("_none", "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = buckets.withColumn("_start", F.sum("_bucket_size").over(order) - F.col("_bucket_size")).drop("_bucket_size").join(goals, ["_none", "_name"])

    within = Window.partitionBy("_none", "_name", "_bucket").orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({"_none": part[0], "_name": part[1]}).withColumn("_before", F.sum("_size").over(within) - F.col("_size")).join(starts, ["_none", "_name", "_bucket"])
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0))
    rest = F.col("_target") - F.col("_epochs") * F.col("_source_size")
    fits = (F.col("_size") > 0) & (2 * (F.col("_start") + F.col("_before")) + F.col("_size") <= 2 * F.col("_rest"))
    placed = placed.withColumn("_epochs", epochs.cast("long")).withColumn("_rest", rest).withColumn("_copies", F.col("_epochs") + fits.cast("long"))
    made = {"_size": F.col("_size"), "_source_size": F.col("_source_size"), "_target": F.col("_target"), "_copies": F.col("_copies"), "_taken": F.col("_copies") * F.col("_size")}
    return placed.select(*(F.col("_row")[c].alias(c) for c in docs.columns if c not in made), *(c.alias(n) for n, c in made.items()))
