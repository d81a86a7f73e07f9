"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Nulls, empty texts and repeated rows are treated as
the operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm import byte_bpe, line_dedup, mixing, near_dup, quality
from sparkwright.llm.common import WORD, Tables, load

#: Ids of documents to drop that may be broadcast; with more, the documents themselves are shuffled.
FEW_IDS = 1_000_000


def held(docs: DataFrame, *own: str) -> DataFrame:
    """The columns own of docs and all others in one, so that an operator's result columns replace none of them."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*others).alias("others") if others else F.lit(0).alias("others"))


def released(docs: DataFrame, *own: str) -> list[Column]:
    """The columns of docs, from held()."""
    return [F.col(c) if c in own else F.col("others")[c].alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules and the trees keep."""
    return quality.keep(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or resembles; one whose words all went with them goes."""
    found = line_dedup.dedup(held(docs, "doc_id", "text")).where((F.col("_n_removed") == 0) | F.col("_kept").rlike(WORD))
    changed, given = F.col("_n_removed") > 0, dict(zip(docs.columns, released(docs, "doc_id", "text"), strict=True))
    new = {"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}
    return found.select(*(F.when(changed, new[c]).otherwise(given[c]).alias(c) if c in new else given[c] for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8); of repeated rows, one."""
    found = Tables(spark, "near-dup-verdicts").write(near_dup.near_duplicates(docs).select("doc_id", "kept"), "verdicts")
    gone = found.where("not kept").select("doc_id").distinct()
    rest = docs.join(F.broadcast(gone) if gone.count() <= FEW_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = not found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    return rest.distinct() if repeated else rest


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that it takes n times is there n times."""
    text = F.col("text")
    own = ("doc_id", "text", "source")
    mixed = mixing.mix(held(docs, *own), mixing.words(text), mixing.quality_weight(text), ties=F.xxhash64(text))
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*released(docs, *own))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes that they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.round_trip(docs, path, pattern).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("near_dup", near_duplicates),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL can express neither the trees nor the edit join nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    tables, docs = Tables(spark, "pipeline"), load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return docs
