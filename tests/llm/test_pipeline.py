"""The pipeline's stages in sequence against a plain version of what each decides."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as P
from sparkwright.llm.common import map_arrow, map_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir, docs):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dup", "mixing", "byte_bpe"]
    now, kept = docs, {}
    for name, stage in P.STAGES:
        now = stage(spark, now, sf_dir)
        kept[name] = now.collect()
        if name != "byte_bpe":
            assert now.columns == docs.columns
            now = spark.createDataFrame(kept[name], docs.schema)
    good = kept["quality_rules"]
    assert all(len(WORD.findall(r.text)) >= 10 for r in good) and 0 < len(good) < docs.count()
    seen, expected = set(), {}
    for r in sorted(good, key=lambda r: r.doc_id):  # no two different lines of these tables are within two edits
        out = []
        for x in r.text.split("\n"):
            if x:
                if x in seen:
                    continue
                seen.add(x)
            out.append(x)
        if WORD.search("\n".join(out)) or out == r.text.split("\n"):
            expected[r.doc_id] = "\n".join(out)
    assert {r.doc_id: r.text for r in kept["line_dedup"]} == expected
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"])

    def shingles(t):
        w = WORD.findall(t.encode().lower().decode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {r.doc_id: shingles(r.text) for r in kept["line_dedup"]}
    group = {i: i for i in sets}
    for _ in sets:
        new = {a: min([group[a], *(group[b] for b in sets if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))]) for a in sets}
        if new == group:
            break
        group = new
    assert {r.doc_id for r in kept["near_dup"]} == {i for i in sets if group[i] == i}
    copies = {}
    for r in kept["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= {r.doc_id for r in kept["near_dup"]} and max(copies.values()) <= 2
    assert sorted(r.doc_id for r in kept["byte_bpe"]) == sorted(r.doc_id for r in kept["mixing"])


def test_repeated_rows_and_nulls(spark, edges, sf_dir):
    """Of repeated rows one stays after the near-duplicate stage; rows without text or id pass it."""
    found = P.near_duplicates(spark, edges, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == [*((False, i) for i in range(1, 9)), (True, 0)]
    lines = P.lines(spark, edges.where(F.col("doc_id").isNull() | (F.col("doc_id") < 6)), sf_dir).collect()
    assert len(lines) == 6  # the second of the two equal rows has lost its only line, and goes with it
    assert sum(r.doc_id == 5 for r in lines) == 1


def test_every_stage_takes_edges_and_empty_tables(spark, clashing, empty, sf_dir):
    """Nulls, repeated rows and columns of any names pass through all stages; an empty table stays empty."""
    for name, stage in P.STAGES:
        out = stage(spark, clashing, sf_dir)
        rows = out.collect()
        assert stage(spark, empty, sf_dir).collect() == [], name
        if name == "byte_bpe":
            assert len(rows) == clashing.count()
        else:
            assert out.columns == clashing.columns, name
            given = {tuple(r) for r in clashing.drop("text", "n_chars").collect()}
            assert {tuple(r) for r in out.drop("text", "n_chars").collect()} <= given, name


def test_near_duplicates_go_without_a_shuffle_of_documents(spark, monkeypatch):
    """The few ids to drop are broadcast however large their table's file is; with many, the same rows stay."""
    text = "these words stand in two documents that differ in nothing but their number and their source"
    docs = spark.createDataFrame([(i, text if i < 3 else f"{text} {i}" * 3, "en", "a", 90) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = P.near_duplicates(spark, docs, "")
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        monkeypatch.setattr(P, "FEW_IDS", 0)
        many = P.near_duplicates(spark, docs, "")
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(few.collect()) == sorted(many.collect()) and {1, 2}.isdisjoint(r.doc_id for r in few.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_workers_give_back_memory(spark):
    """A worker that has freed 100 MB below something that it keeps does not hold them while it waits for tasks."""

    def run(batches):
        for _ in batches:
            import builtins
            import os

            import pyarrow as pa

            held = [bytes(1000) for _ in range(100_000)]
            builtins.kept_by_this_test = [bytes(1000) for _ in range(100)]
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([len(held)])], ["pid", "n"])

    (row,) = map_batches(spark.range(0, 1, 1, 1), run, "pid long, n long").collect()

    def resident():
        with open(f"/proc/{row.pid}/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) / 1024

    with_it = resident()
    assert row.n == 100_000 and with_it < 100, with_it


def test_slices_give_back_memory(spark):
    """What one slice of a batch has freed is not held while the next ones run."""

    def run(batch):
        import builtins

        import pyarrow as pa

        with open("/proc/self/smaps_rollup") as f:
            before = sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) // 1024
        held = [bytes(1000) for _ in range(100_000)]
        builtins.kept_by_slices = [*getattr(builtins, "kept_by_slices", []), *(bytes(1000) for _ in range(100))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([before] * len(batch)), pa.array([len(held)] * len(batch))], ["id", "before", "n"])

    found = map_arrow(spark.range(0, 3, 1, 1), run, "id long, before long, n long", 1).orderBy("id").collect()
    assert [r.n for r in found] == [100_000] * 3 and found[2].before - found[0].before < 50, found
