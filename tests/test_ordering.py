"""Join orders, cost estimates and index costs of the engine."""

import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkwright.dialect import Constant, Name, Term
from sparkwright.plans.catalogue import QUERIES
from sparkwright.plans.ordering import Size, order
from sparkwright.session import Engine
from tests.bags import bag

JOIN5 = (
    "select s_name, o_orderkey, n_name, r_name from region, nation, supplier, lineitem, orders where r_regionkey = n_regionkey"
    " and n_nationkey = s_nationkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_orderpriority = '1-URGENT'"
)
FIVE = ("region", "nation", "supplier", "lineitem", "orders")


def passed(path, edges, rows, values):
    """(products, rows passed on) of an order, counted plainly."""
    here, products, cost = rows[path[0]], 0, 0.0
    for k, i in enumerate(path[1:], 1):
        met = [(a, b) for a, b in edges if (a == i and b in path[:k]) or (b == i and a in path[:k])]
        here *= rows[i]
        for a, b in met:
            here /= max(min(values[a], rows[a]), min(values[b], rows[b]))
        products, cost = products + (not met), cost + here
    return products, cost


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_order_against_all_permutations(data):
    n = data.draw(st.integers(2, 5))
    rows = [data.draw(st.integers(1, 1000)) for _ in range(n)]
    values = [data.draw(st.integers(1, 1000)) for _ in range(n)]
    pairs = [*itertools.combinations(range(n), 2)]
    edges = data.draw(st.lists(st.sampled_from(pairs), max_size=5, unique=True))
    tables = [f"t{i}" for i in range(n)]
    terms = [Term(Name("k", tables[a]), Name("k", tables[b])) for a, b in edges]
    found = order(tables, [["k"]] * n, terms, [Size(r, {"k": v}) for r, v in zip(rows, values, strict=True)])
    assert sorted(found) == [*range(n)]
    best = min(passed(p, edges, rows, values) for p in itertools.permutations(range(n)))
    got = passed(found, edges, rows, values)
    assert got[0] == best[0] and got[1] <= best[1] * (1 + 1e-9)


def test_order_of_many_tables_and_constants():
    n = 14
    tables = [f"t{i}" for i in range(n)]
    terms = [Term(Name("k", tables[i]), Name("k", tables[i + 1])) for i in range(n - 1)]
    found = order(tables, [["k", "f"]] * n, terms, [Size(100)] * n)
    assert sorted(found) == [*range(n)]
    assert all(any(abs(a - b) == 1 for b in found[:k]) for k, a in enumerate(found) if k)  # no product
    few = order(("a", "b", "c"), [["x"], ["x", "f"], ["x"]], [Term(Name("x", "a"), Name("x", "b")), Term(Name("x", "b"), Name("x", "c")), Term(Name("f"), Constant(1))], [Size(100, {"x": 10}), Size(1000, {"f": 1000, "x": 10}), Size(10)])
    assert few == [1, 2, 0]
    assert order((), [], [], []) == []


def leaves(df):
    """The tables of an optimized plan, in order of its leaves, known by one column each."""
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Relation \[(\w)_", text)


def test_selinger_orders_joins(spark, sf_dir):
    engine = Engine(spark)
    engine.attach_folder(sf_dir, *FIVE)
    heuristic = engine.query(JOIN5)
    for t in FIVE:
        engine.stats(t)
    engine.set("planner", "selinger")
    selinger = engine.query(JOIN5)
    assert leaves(heuristic) == ["r", "n", "s", "l", "o"] and leaves(selinger) != leaves(heuristic)
    assert bag(selinger.collect()) == bag(heuristic.collect()) == bag(QUERIES["join5"](spark, sf_dir).collect())
    assert "CartesianProduct" not in selinger._jdf.queryExecution().toString()


def test_statistics_hold_until_the_table_changes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"))
    engine.update("create table t (a int, b int)")
    engine.update("insert into t (a, b) values (1, 10), (2, 20), (1, 30)")
    engine.commit()
    engine.stats("t")
    assert engine._size("t", engine.table("t")).rows == 3
    engine.update("insert into t (a, b) values (3, 10)")
    changed = engine.table("t")
    assert engine._size("t", changed).distinct == {}  # Spark's estimate now
    engine.update("create index i on t (a) using btree")
    engine.commit()
    assert engine.index_cost("i") == {"blocks": 1, "recs": 2, "distinct": 3}
    text = engine.explain("select b from t where a = 1")
    assert re.search(r"-> Project  \(cost=0\.\.\d+ rows=\d+ width=\d+\)", text)
    assert "Index Scan using i (btree) on t\n  Index Cond: (a = 1)" in text
    engine.set("index", "off")
    assert "Index Cond" not in engine.explain("select b from t where a = 1")
    measured = str(engine.explain_analyze("select b from t where a = 1"))
    assert re.search(r"-> Project  \(actual time=[\d.]+ ms", measured) and re.search(r"-> Scan parquet\s+\(actual time=[\d.]+ ms rows=4\)", measured)
    engine.update("create table e (a int)")
    engine.update("create index j on e (a)")
    assert engine.index_cost("j") == {"blocks": 0, "recs": 0, "distinct": 1}
