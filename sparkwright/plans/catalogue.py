"""The registered queries of the relational engine and their DuckDB counterparts.

Each query runs through the engine's own path for its operator: the dialect, the operator functions, or changes to
copies of tables. The counterpart says in plain SQL what must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.functions.aggregates import Count, Custom, Max
from sparkwright.operators import relational as R
from sparkwright.session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: SQL that the engine and DuckDB both run as it stands.
SAME = {
    "scan_project": "select n_nationkey, n_name from nation",
    "select_eq_int": "select s_suppkey, s_name from supplier where s_nationkey = 3",
    "select_eq_string": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'",
    "select_conjunction": "select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_linestatus = 'O'",
    "select_field_eq_field": "select l_orderkey, l_linenumber from lineitem where l_linenumber = l_suppkey",
    "select_const_true": "select r_name from region where 1 = 1",
    "select_const_false": "select r_name from region where 1 = 2",
    "select_reversed": "select n_name from nation where 3 = n_regionkey",
    "product": "select r_name, n_name from region, nation",
    "equi_join": "select c_name, o_orderkey from customer, orders where c_custkey = o_custkey",
    "join_select": "select o_orderkey, c_name from customer, orders where c_custkey = o_custkey and c_mktsegment = 'BUILDING'",
    "join3": "select c_name, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey",
    "join5": "select s_name, o_orderkey, n_name, r_name from region, nation, supplier, lineitem, orders where r_regionkey = n_regionkey and n_nationkey = s_nationkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_orderpriority = '1-URGENT'",
    "join_multikey": "select c_custkey, s_suppkey from customer, supplier where c_nationkey = s_nationkey and c_custkey = s_suppkey",
    "join_mixed_product": "select c_name, o_orderkey, r_name from customer, orders, region where c_custkey = o_custkey",
    "spark_sql_group_order": "select l_returnflag, l_linestatus, count(*) as n, max(l_linenumber) as most from lineitem group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus",
    "spark_sql_join_on": "select n.n_name as n_name, r.r_name as r_name from nation n join region r on n.n_regionkey = r.r_regionkey",
}

JOIN = "select c_name, n_name from customer, nation where c_nationkey = n_nationkey"


def _engine(spark: SparkSession, sf_dir: str) -> Engine:
    engine = Engine(spark)
    engine.attach_folder(sf_dir, *TABLES)
    return engine


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _same(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _engine(spark, sf_dir).query(sql)


def _pair(join: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """customer joined with nation by one of the join operators."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        nation, customer = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
        return join(nation, customer).select("c_name", "n_name")

    return query


def _group(table: str, keys: list[str], *aggregates) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: R.group_by(_read(spark, sf_dir, table), keys, list(aggregates))


def _under(planner: str, index: str = "on", sql: str = JOIN) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _engine(spark, sf_dir)
        engine.set("planner", planner)
        engine.set("index", index)
        return engine.query(sql)

    return query


def product_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.product_chunked(_read(spark, sf_dir, "region"), _read(spark, sf_dir, "nation")).select("r_name", "n_name")


def group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.join(_read(spark, sf_dir, "customer"), _read(spark, sf_dir, "nation"), ("c_nationkey", "n_nationkey"))
    return R.group_by(joined, ["n_name"], [Count("c_custkey")])


def sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sort(R.project(_read(spark, sf_dir, "customer"), "c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")


def materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.materialize(R.project(_read(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.update("create view building as select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    return engine.query("select c_custkey, c_name from building where c_nationkey = 3")


def view_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    engine.update("create view building as select c_custkey, c_name, c_nationkey from customer where c_mktsegment = 'BUILDING'")
    engine.update("create view named as select c_name, n_name from building, nation where c_nationkey = n_nationkey")
    return engine.query("select c_name, n_name from named")


def _copied(spark: SparkSession, sf_dir: str, name: str, columns: str) -> Engine:
    """An engine with a private copy of some columns of a table, of the dialect's types."""
    engine = Engine(spark)
    engine.update(f"create table {name} ({columns})")
    engine.append(name, _read(spark, sf_dir, name))
    engine.commit()
    return engine


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "supplier", "s_suppkey int, s_nationkey int")
    engine.update("update supplier set s_nationkey = 99 where s_nationkey = 3")
    engine.commit()
    return engine.query("select s_suppkey, s_nationkey from supplier")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int")
    engine.update("delete from nation where n_regionkey = 1")
    engine.commit()
    return engine.query("select n_nationkey, n_name from nation")


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int")
    engine.update("insert into nation (n_nationkey, n_name) values (25, 'atlantis')")
    engine.commit()
    return engine.query("select n_nationkey, n_name, n_regionkey from nation")


def dml_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int")
    engine.update("delete from nation where n_regionkey = 1")
    engine.rollback()
    return engine.query("select n_nationkey, n_name from nation")


def index_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "customer", "c_custkey int, c_name varchar(25), c_nationkey int")
    engine.update("create index by_nation on customer(c_nationkey) using btree")
    engine.update("create index by_key on customer(c_custkey)")
    engine.commit()
    return engine.query("select c_custkey, c_name from customer where c_nationkey = 3")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, sf_dir)
    found = engine.stats("customer", exact=True)
    return engine.spark.createDataFrame([(found["recs"], found["v_c_nationkey"], found["v_c_mktsegment"])], "recs long, v_nationkey long, v_mktsegment long")


def _indexed(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _copied(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int")
    engine.update("create index by_region on nation(n_regionkey) using btree")
    engine.update("create index by_key on nation(n_nationkey)")
    engine.commit()
    return engine


def index_maintenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups after changes of an indexed table."""
    engine = _indexed(spark, sf_dir)
    engine.update("insert into nation (n_nationkey, n_name, n_regionkey) values (25, 'atlantis', 1)")
    engine.update("delete from nation where n_nationkey = 1")
    engine.update("update nation set n_regionkey = 1 where n_nationkey = 5")
    engine.commit()
    return engine.query("select n_nationkey, n_name from nation where n_regionkey = 1")


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).query("select indexname, tablename, fieldname, indextype from idxcat")


def index_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a lookup gives with and without index use."""
    engine = _indexed(spark, sf_dir)
    found = engine.indexcmp("select n_name from nation where n_regionkey = 1")
    return engine.spark.createDataFrame([(k, m.rows) for k, m in found.items()], "mode string, n_rows long")


def client_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a client's result set hands them over."""
    from sparkwright.client import Connection

    engine = _engine(spark, sf_dir)
    found = Connection(engine).create_statement().execute_query("select r_regionkey, r_name from region")
    rows = []
    while found.next():
        rows.append((int(found.get_int("r_regionkey")), found.get_string("r_name")))
    return engine.spark.createDataFrame(rows, "r_regionkey long, r_name string")


def batch_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of statements, committed in batches of three."""
    from sparkwright.streaming.batches import load

    engine = Engine(spark)
    names = [r.n_name for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name").collect()]
    lines = ["create table names (id int, name varchar(25));", *(f"insert into names (id, name)\n values ({i}, '{n}');" for i, n in enumerate(names)), "delete from names where id = 3;"]
    load(engine, lines, batch=3)
    return engine.query("select id, name from names")


def fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the generated student tables."""
    from sparkwright.sources.fixtures import tables

    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows")) for name, df in tables(spark).items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3]).union(counts[4])


def explain_analyze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row count that the measured plan reports at its root."""
    engine = _engine(spark, sf_dir)
    return engine.spark.createDataFrame([(engine.explain_analyze(JOIN).rows,)], "n_rows long")


def compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that every planner counts."""
    engine = _engine(spark, sf_dir)
    return engine.spark.createDataFrame([(k, m.rows) for k, m in engine.compare(JOIN).items()], "planner string, n_rows long")


def system_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _copied(spark, sf_dir, "nation", "n_nationkey int, n_name varchar(25), n_regionkey int")
    return engine.query("select fldname, length from fldcat where tblname = 'nation'")


KEY = ("n_nationkey", "c_nationkey")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _same(sql) for name, sql in SAME.items()},
    "select_cross_type": _same("select n_name from nation where n_nationkey = '3'"),
    "product_chunked": product_chunked,
    "join_hash": _pair(lambda a, b: R.join_hash(a, b, KEY)),
    "join_merge": _pair(lambda a, b: R.join_merge(a, b, KEY)),
    "join_index": _pair(lambda a, b: R.join_index(b, a, KEY[::-1])),
    "planner_basic": _under("basic"),
    "planner_selinger": _under("selinger"),
    "index_off": _under("heuristic", "off"),
    "group_count": _group("orders", ["o_custkey"], Count("o_orderkey")),
    "group_max_int": _group("lineitem", ["l_returnflag"], Max("l_linenumber")),
    "group_max_string": _group("nation", ["n_regionkey"], Max("n_name")),
    "group_multi": _group("lineitem", ["l_returnflag", "l_linestatus"], Count("l_orderkey"), Max("l_linenumber")),
    "group_custom_agg": _group("lineitem", ["l_returnflag"], Custom("spread", "l_linenumber", lambda c: F.max(c) - F.min(c))),
    "group_join": group_join,
    "sort": sort,
    "materialize": materialize,
    "view": view,
    "view_nested": view_nested,
    "dml_update": dml_update,
    "dml_delete": dml_delete,
    "dml_insert": dml_insert,
    "dml_rollback": dml_rollback,
    "index_select": index_select,
    "stats": stats,
    "explain_analyze": explain_analyze,
    "compare": compare,
    "system_catalog": system_catalog,
    "index_maintenance": index_maintenance,
    "index_catalog": index_catalog,
    "index_compare": index_compare,
    "client_result": client_result,
    "batch_load": batch_load,
    "fixture": fixture,
}

ORACLES = {
    **SAME,
    "select_cross_type": "select n_name from nation where 1 = 2",
    "product_chunked": SAME["product"],
    **dict.fromkeys(("join_hash", "join_merge", "join_index", "planner_basic", "planner_selinger", "index_off"), JOIN),
    "group_count": "select o_custkey, count(o_orderkey) as countofo_orderkey from orders group by o_custkey",
    "group_max_int": "select l_returnflag, max(l_linenumber) as maxofl_linenumber from lineitem group by l_returnflag",
    "group_max_string": "select n_regionkey, max(n_name) as maxofn_name from nation group by n_regionkey",
    "group_multi": "select l_returnflag, l_linestatus, count(l_orderkey) as countofl_orderkey, max(l_linenumber) as maxofl_linenumber from lineitem group by l_returnflag, l_linestatus",
    "group_custom_agg": "select l_returnflag, max(l_linenumber) - min(l_linenumber) as spreadofl_linenumber from lineitem group by l_returnflag",
    "group_join": "select n_name, count(c_custkey) as countofc_custkey from customer, nation where c_nationkey = n_nationkey group by n_name",
    "sort": "select c_custkey, c_nationkey from customer order by c_nationkey, c_custkey",
    "materialize": "select s_suppkey, s_nationkey from supplier",
    "view": "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3",
    "view_nested": "select c_name, n_name from customer, nation where c_nationkey = n_nationkey and c_mktsegment = 'BUILDING'",
    "dml_update": "select s_suppkey::int as s_suppkey, case when s_nationkey = 3 then 99 else s_nationkey end as s_nationkey from supplier",
    "dml_delete": "select n_nationkey, n_name from nation where not (n_regionkey = 1)",
    "dml_insert": "select n_nationkey, n_name, n_regionkey from nation union all select 25, 'atlantis', 0",
    "dml_rollback": "select n_nationkey, n_name from nation",
    "index_select": "select c_custkey::int as c_custkey, c_name from customer where c_nationkey = 3",
    "stats": "select count(*) as recs, count(distinct c_nationkey) as v_nationkey, count(distinct c_mktsegment) as v_mktsegment from customer",
    "explain_analyze": "select count(*) as n_rows from customer, nation where c_nationkey = n_nationkey",
    "compare": "select unnest(['heuristic', 'selinger', 'basic']) as planner, (select count(*) from customer, nation where c_nationkey = n_nationkey) as n_rows",
    "system_catalog": "select * from (values ('n_nationkey', 0), ('n_name', 25), ('n_regionkey', 0)) as t(fldname, length)",
    "index_maintenance": "select n_nationkey, n_name from nation where n_nationkey <> 1 and (n_regionkey = 1 or n_nationkey = 5) union all select 25, 'atlantis'",
    "index_catalog": "select * from (values ('by_region', 'nation', 'n_regionkey', 'btree'), ('by_key', 'nation', 'n_nationkey', 'hash')) as t(indexname, tablename, fieldname, indextype)",
    "index_compare": "select unnest(['index on', 'index off']) as mode, (select count(*) from nation where n_regionkey = 1) as n_rows",
    "client_result": "select r_regionkey, r_name from region",
    "batch_load": "select n_nationkey::int as id, n_name as name from nation where n_nationkey <> 3",
    "fixture": "select * from (values ('dept', 12), ('student', 5000), ('course', 36), ('sect', 108), ('enroll', 5000)) as t(name, n_rows)",
}
