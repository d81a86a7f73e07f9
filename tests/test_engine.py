import io

import pytest
from pyspark.errors import AnalysisException

from sparkwright.cli import repl
from sparkwright.client import connect
from sparkwright.dialect import DialectError
from sparkwright.functions.aggregates import Count, Max, PandasCustom
from sparkwright.operators import relational as R
from sparkwright.session import Engine
from sparkwright.sources import fixtures
from sparkwright.sources.storage import CatalogError
from sparkwright.streaming.batches import BatchError, load, run_files


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"))
    e.update("create table t (a int, b int)")
    e.update("insert into t (a, b) values (1, 10), (2, 20), (1, 30)")
    e.commit()
    return e


def rows(engine, sql):
    return sorted(tuple(r) for r in engine.query(sql).collect())


def test_affected_rows(engine):
    assert engine.update("delete from t where a = 1") == 2
    assert engine.update("delete from t where a = 2") == 1
    assert rows(engine, "select a from t") == []
    engine.rollback()
    assert engine.update("update t set b = 0 where a = 1") == 2
    assert engine.update("update t set b = 0 where a = 1") == 2  # matched, though unchanged
    assert rows(engine, "select a, b from t") == [(1, 0), (1, 0), (2, 20)]


def test_update_from_column_and_several(engine):
    engine.update("update t set a = b, b = a where a = 2")
    assert rows(engine, "select a, b from t") == [(1, 10), (1, 30), (20, 2)]


def test_rollback_commit_and_reopen(engine, spark):
    engine.update("insert into t (a) values (7)")
    engine.rollback()
    assert len(rows(engine, "select a from t")) == 3
    engine.update("insert into t (a) values (7)")
    engine.commit()
    assert rows(Engine(spark, engine.files.root), "select b from t where a = 7") == [(0,)]


def test_two_writers(engine, spark):
    other = Engine(spark, engine.files.root)
    other.update("delete from t where a = 1")
    engine.update("delete from t where a = 2")
    other.commit()
    with pytest.raises(CatalogError):
        engine.commit()
    assert rows(engine, "select a from t") == [(2,)]


def test_snapshot(engine, spark):
    reader = Engine(spark, engine.files.root)
    engine.update("delete from t where a = 1")
    engine.commit()
    assert len(rows(reader, "select a from t")) == 3


def test_insert_checks(engine):
    engine.update("create table s (n varchar(3), i int)")
    for sql in ("insert into s (n) values ('long')", "insert into s (i) values ('x')", "insert into s (i) values (3000000000)", "insert into s (q) values (1)", "insert into nope (a) values (1)", "create table t (a int)", "insert into s (i, i) values (1, 2)"):
        with pytest.raises((CatalogError, DialectError)):
            engine.update(sql)
    engine.update("insert into s (i) values (-5)")
    assert rows(engine, "select n, i from s where i = -5") == [("", -5)]


def test_indexes(engine):
    engine.update("delete from t where 1 = 1")
    for i in range(60):
        engine.update(f"insert into t (a, b) values ({i % 10}, {i})")
    engine.update("create index h on t(a)")
    engine.update("create index g on t(a) using btree")
    for sql in ("create index h on t(b)", "create index x on t(a) using btree", "create index x on t(nope)"):
        with pytest.raises(CatalogError):
            engine.update(sql)
    assert engine.update("delete from t where a = 3") == 6
    assert engine.update("update t set a = 99 where a = 5") == 6
    engine.update("create index i on t(b) using btree")
    engine.commit()
    assert engine.best_index("t", "a").kind == "hash"
    for key in (3, 5, 99, 4):
        found = {}
        for index in ("on", "off"):
            engine.set("index", index)
            found[index] = rows(engine, f"select b from t where a = {key}")
        assert found["on"] == found["off"] and len(found["on"]) == {3: 0, 5: 0}.get(key, 6)
    assert rows(engine, "select indexname, indextype from idxcat") == [("g", "btree"), ("h", "hash"), ("i", "btree")]


def test_typing_and_names(engine):
    engine.update("create table s (n varchar(5))")
    engine.update("insert into s (n) values ('1')")
    assert rows(engine, "select a from t where a = '1'") == []
    assert rows(engine, "select a from t, s where a = n") == []
    assert rows(engine, "select A from T where 1 = 'x'") == []
    for sql in ("select nope from t", "select a from t where nope = 1", "select a from nope", "select a from t, t2"):
        with pytest.raises(AnalysisException):
            engine.query(sql).collect()
    engine.update("create table u (a int)")
    with pytest.raises(AnalysisException):
        engine.query("select a from t, u")
    assert rows(engine, "select t.a from t, u") == []  # an empty side gives an empty product


def test_views(engine):
    engine.update("create view v as select b from t where a = 1")
    engine.update("create view w as select b from v where b = 30")
    engine.commit()
    for planner in ("heuristic", "selinger", "basic"):
        engine.set("planner", planner)
        assert rows(engine, "select b from w") == [(30,)]
    with pytest.raises(CatalogError):
        engine.update("delete from v")


def test_superset(engine):
    assert rows(engine, "select a, count(*) as n from t group by a having count(*) > 1") == [(1, 2)]
    assert [r.b for r in engine.query("select b from t order by b desc limit 2").collect()] == [30, 20]


def test_equalities_beyond_the_dialect_keep_its_typing(engine):
    assert rows(engine, "select a from t where a = '2'") == []
    engine.update("create table s (c varchar(3))")
    engine.update("insert into s (c) values ('1'), ('x')")
    for sql in (
        "select a from t where a = '2' order by a",
        "select a from t where a in ('2', '3') order by a",
        "select b from t join s on a = c order by b",
        "select a from t where exists (select 1 from s where c = a) order by a",
        "select a from t where b in (select b from t where a = '1' order by b)",
    ):
        with pytest.raises(DialectError, match="compared with a number"):
            engine.query(sql)
    assert rows(engine, "select b from t join s on cast(a as string) = c order by b") == [(10,), (30,)]
    assert rows(engine, "select a from t where a = 2 and 1.0 = 1 order by a") == [(2,)]


def test_inspection(engine):
    sql = "select b from t where a = 1"
    assert "Scan parquet" in engine.explain(sql)
    measured = engine.explain_analyze(sql)
    assert measured.rows == 2 and "Rows Removed by Filter" in str(measured)
    assert {m.rows for m in engine.compare(sql).values()} == {2} and len(engine.compare(sql)) == 3
    assert [*engine.indexcmp(sql)] == ["index on", "index off"]
    assert engine.stats("t")["recs"] == 3 and engine.stats("t")["v_a"] == 2
    assert engine.settings() == {"planner": "heuristic", "index": "on"}


def test_client(engine, spark):
    with connect(spark, engine.files.root) as c:
        s = c.create_statement()
        assert s.execute_update("insert into t (a, b) values (5, 50)") == 1
        found = s.execute_query("select a, b from t where a = 5")
        assert found.metadata().column_count() == 2 and found.metadata().column_name(1) == "a"
        assert found.next() and found.get_int("B") == 50 and not found.next()
        found.close()
        assert s.execute_query("explain select a from t").next()
    assert rows(Engine(spark, engine.files.root), "select b from t where a = 5") == [(50,)]


def test_batches(engine):
    assert load(engine, ["insert into t (a) values (1);\n", "insert into t\n", " (a) values (2); insert into t (a) values (3)"], batch=2) == 3
    assert len(rows(engine, "select a from t")) == 6
    with pytest.raises(BatchError, match="nope"):
        load(engine, ["insert into t (a) values (4); insert into nope (a) values (1); insert into t (a) values (5);"])
    assert len(rows(engine, "select a from t")) == 6


def test_script(engine, tmp_path):
    (tmp_path / "s.sql").write_text("-- a comment; with a semicolon\ncreate table s (n int);\ninsert into s (n) values (1);select n from s;")
    assert run_files(engine, str(tmp_path / "s.sql")) == 2
    assert rows(engine, "select n from s") == [(1,)]


def test_repl(engine):
    out = io.StringIO()
    repl(engine, ["select a, b\n", "from t where a = 2;\n", "set planner basic;\n", "bad;\n", "help;\n", "exit;\n", "never;\n"], out)
    text = out.getvalue()
    assert "20" in text and "1 rows" in text and "planner = basic" in text and "error:" in text and "never" not in text


def test_fixture(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "students"))
    fixtures.create(e)
    assert e.stats("student")["recs"] == 5000 and e.stats("sect")["recs"] == 108
    assert e.query("select sname, dname from student, dept where majorid = did").count() == 5000
    assert e.query("select sid, title from student, enroll, sect, course where sid = studentid and sectionid = sectid and courseid = cid").count() == 5000


def test_operators(spark):
    df = spark.createDataFrame([(1, "x", 3), (1, "y", 5), (2, "z", 4)], "k int, s string, v int")
    grouped = R.group_by(df, ["k"], [Count("s"), Max("s"), Max("v"), PandasCustom("sum", "v", lambda x: int(x.sum()), "long")])
    assert sorted(tuple(r) for r in grouped.collect()) == [(1, 2, "y", 5, 8), (2, 1, "z", 4, 4)]
    empty = df.where("1 = 2")
    assert R.group_by(empty, ["k"], [Count("s")]).collect() == []
    assert R.sort(empty, "k").collect() == [] and R.product(empty, df).collect() == []
    assert R.project(df, "s", "k").columns == ["s", "k"]
    other = df.select(df.k.alias("k2"), df.v.alias("v2"))
    expected = sorted(tuple(r) for r in R.join(df, other, ("k", "k2")).collect())
    for join in (R.join_hash, R.join_merge, R.join_index):
        assert sorted(tuple(r) for r in join(df, other, ("k", "k2")).collect()) == expected
    assert sorted(tuple(r) for r in R.join_index(df, other, ("k", "k2"), most_bytes=1).collect()) == expected


@pytest.mark.parametrize(("join", "node"), [(R.join_hash, "ShuffledHashJoin"), (R.join_merge, "SortMergeJoin"), (R.join_index, "BroadcastHashJoin")])
def test_hints(spark, join, node):
    a, b = spark.range(10).withColumnRenamed("id", "a"), spark.range(10).withColumnRenamed("id", "b")
    assert node in join(a, b, ("a", "b"))._jdf.queryExecution().executedPlan().toString()


def test_pushdown(engine):
    """The filter and the two columns reach the scan."""
    plan = engine.query("select b from t where a = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(a,1)" in plan and "ReadSchema: struct<a:int,b:int>" in plan


def test_commit_is_whole(engine, spark):
    """A writer halted in the middle of a commit leaves the version before it; an unreadable version is never passed over."""
    import pytest

    from sparkwright.session import Engine
    from sparkwright.sources.storage import CatalogError

    engine.update("create table u (a int)")
    engine.update("insert into u (a) values (1)")
    engine.commit()
    root = engine.files.root
    path = engine.files._path("catalog/999999999999.json.halted.part")
    engine.files._fs.create(path, False).close()
    other = Engine(spark, root)
    other.update("insert into u (a) values (2)")
    other.commit()
    assert Engine(spark, root).query("select a from u").count() == 2
    assert not other.files.create(f"catalog/{other._last:012d}.json", "{}")
    engine.files._fs.create(engine.files._path(f"catalog/{other._last + 1:012d}.json"), False).close()
    with pytest.raises(CatalogError):
        Engine(spark, root)


def test_settings_are_the_callers(spark):
    from sparkwright.session import Engine

    caller = spark.newSession()
    caller.conf.set("spark.sql.files.maxPartitionBytes", "1234567")
    caller.conf.set("spark.sql.autoBroadcastJoinThreshold", "7654321")
    engine = Engine(caller)
    engine.set("planner", "basic")
    assert engine.spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    engine.set("planner", "heuristic")
    assert engine.spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "7654321"
    assert engine.spark.conf.get("spark.sql.files.maxPartitionBytes") == "1234567"


def test_compaction(engine):
    engine.update("create table c (a int)")
    for i in range(4):
        engine.update(f"insert into c (a) values ({i})")
        engine.commit()
    assert len(engine.catalog.table("c").parts) == 4
    assert engine.update("update c set a = 9 where a = 2") == 1
    engine.compact("c")
    engine.commit()
    assert len(engine.catalog.table("c").parts) == 1
    assert sorted(r.a for r in engine.query("select a from c").collect()) == [0, 1, 3, 9]
