"""Every operator on nulls, empty texts, repeated rows, long texts, clashing column names and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkwright.llm import byte_bpe, licenses, line_dedup, mixing, near_dup, pii, quality, suffix_dedup, topk, toxicity

BPE = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
OPERATORS = {
    "lines": line_dedup.dedup,
    "mixing": lambda d: mixing.mix(d, mixing.words(F.col("text")), mixing.quality_weight(F.col("text")), ties=F.xxhash64("text")),
    "licenses": licenses.scan,
    "near_dup": near_dup.near_duplicates,
    "pii": lambda d: pii.find(d, pii.train(d)),
    "suffix": suffix_dedup.dedup,
    "toxicity": lambda d: toxicity.rate(d, None),
    "bpe": lambda d: byte_bpe.decode(byte_bpe.encode(d, *BPE), *BPE),
    "quality": lambda d: quality.assess(d, None),
}


@pytest.mark.parametrize("name", [*OPERATORS])
def test_edges(edges, clashing, empty, name):
    got = OPERATORS[name](clashing).collect()
    assert len(got) == edges.count()
    by_id = {r["doc_id"]: r for r in got}
    check = {
        "lines": lambda: by_id[1]["_kept"] is None and by_id[2]["_kept"] == "" and sorted(r["_n_removed"] for r in got if r["doc_id"] == 5) == [0, 1] and by_id[1]["_size"] == 7,
        "mixing": lambda: by_id[1]["_taken"] == 0 and by_id[2]["_size"] == 0 and by_id[7]["_size"] == 5000 and by_id[1]["_kept"] == 7,
        "licenses": lambda: by_id[1]["n_words"] == 0 and by_id[1]["matches"] == [] and by_id[7]["n_words"] == 5000,
        "near_dup": lambda: by_id[1]["n_shingles"] == 0 and by_id[4]["n_shingles"] == 1 and by_id[2]["component_id"] == 2 and by_id[None]["kept"] and by_id[None]["component_id"] is None,
        "pii": lambda: all(r["spans"] == [] for r in got),
        "suffix": lambda: by_id[1]["n_bytes"] == 0 and bytes(by_id[5]["kept"]).startswith(b"the same") and by_id[6]["spans"] == [],
        "toxicity": lambda: all(r["score"] == 0 for r in got),
        "bpe": lambda: by_id[1]["n_tokens"] == 0 and bytes(by_id[8]["decoded"]).decode() == "ÄÖÜ é😀 𝒳   \x00 end" and bytes(by_id[6]["decoded"]) == b"x" * 30_000,
        "quality": lambda: not by_id[1]["kept"] and by_id[5]["kept"] and not by_id[7]["kept"],
    }
    assert check[name]()
    assert OPERATORS[name](empty).collect() == []


def test_edges_with_fitted_models(edges, clashing, empty, docs, labels):
    """The operators that learn, with a model from the tables' own labels; equal rows have equal results."""
    trees, lexicon, field = quality.train(docs, labels), toxicity.train(docs, labels), pii.train(docs)
    assert trees is not None and lexicon is not None and field is not None
    fitted = {"quality": lambda d: quality.assess(d, trees), "toxicity": lambda d: toxicity.rate(d, lexicon), "pii": lambda d: pii.find(d, field)}
    for name, run in fitted.items():
        got = run(clashing).collect()
        assert len(got) == edges.count(), name
        assert len({str(r) for r in got if r.doc_id == 5}) == 1, name
        assert run(empty).collect() == [], name
        by_id = {r.doc_id: r for r in got}
        if name == "quality":
            assert not by_id[1].kept and not by_id[7].kept and all(0 <= r.score <= 1 for r in got)
        elif name == "toxicity":
            assert all(0 <= r.score < 0.5 for r in got) and by_id[1].score == by_id[2].score == 0
        else:
            assert all(r.spans == [] for r in got)
    kept = quality.keep(clashing, trees)
    assert kept.columns == clashing.columns and quality.keep(empty, trees).collect() == []


def test_keep(clashing):
    assert sorted(r.doc_id or 0 for r in quality.keep(clashing, None).collect()) == [0, 5, 5]


def test_training_without_labels(edges, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality.train(edges, labels) is None
        assert toxicity.train(edges, labels) is None


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -0.5]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (7, [0.0, 0.0]), (8, []), (9, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 5)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 16384), (0, 2, 1, 16384), (0, 3, 7, 0)]
    assert topk.top_k(df.where("1 = 2"), F.col("vec_id") % 50 == 0, 5).collect() == []
