"""Plan inspection: estimated plans, measured plans, and comparisons of planner modes and index use."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


#: Metrics of time and their units in a millisecond.
_TIMES = {"pipelineTime": 1, "scanTime": 1, "sortTime": 1, "aggTime": 1, "buildTime": 1, "shuffleWriteTime": 1e6}


@dataclass
class Node:
    """An operator of an executed plan with what Spark measured of it."""

    name: str
    detail: str
    metrics: dict[str, int]
    children: list[Node] = field(default_factory=list)

    @property
    def rows(self) -> int | None:
        return self.metrics.get("numOutputRows")

    @property
    def input_rows(self) -> int | None:
        """Rows that the children give, looking through operators that do not count."""
        known = [c.rows if c.rows is not None else c.input_rows for c in self.children]
        return sum(known) if known and None not in known else None

    @property
    def time_ms(self) -> float | None:
        """Task time that Spark measured at this operator, or of the generated code that it is the top of."""
        known = [self.metrics[m] / unit for m, unit in _TIMES.items() if m in self.metrics]
        return max(known) if known else None

    def lines(self, depth: int = 0) -> list[str]:
        actual = [f"time={self.time_ms:.1f} ms"] if self.time_ms is not None else []
        actual += [f"rows={self.rows}"] if self.rows is not None else []
        out = [f"{'  ' * depth}-> {self.name}" + (f"  (actual {' '.join(actual)})" if actual else "")]
        if self.detail:
            out.append(f"{'  ' * depth}     {self.detail[:160]}")
        if self.name == "Filter" and self.rows is not None and self.input_rows is not None:
            out.append(f"{'  ' * depth}     Rows Removed by Filter: {self.input_rows - self.rows}")
        spill = self.metrics.get("spillSize", 0)
        if spill:
            out.append(f"{'  ' * depth}     Spilled: {spill} bytes")
        return out + [line for c in self.children for line in c.lines(depth + 1)]


#: Operators that only wrap another one.
_WRAPPERS = re.compile(r"AdaptiveSparkPlan|WholeStageCodegen|InputAdapter|.*QueryStage|AQEShuffleRead|ColumnarToRow|ReusedExchange")


def _children(plan) -> list:
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return [plan.executedPlan()]
    if "QueryStage" in name:
        return [plan.plan()]
    found = plan.children()
    return [found.apply(i) for i in range(found.size())]


def _tree(plan) -> Node:
    children = [_tree(c) for c in _children(plan)]
    if _WRAPPERS.match(plan.nodeName()) and len(children) == 1:
        if plan.nodeName().startswith("WholeStageCodegen"):
            children[0].metrics["pipelineTime"] = plan.metrics().apply("pipelineTime").value()
        return children[0]
    metrics, names = {}, plan.metrics().keys().iterator()
    while names.hasNext():
        name = names.next()
        metrics[name] = plan.metrics().apply(name).value()
    return Node(re.sub(r" \(\d+\)$", "", plan.nodeName()).strip(), re.sub(r"#\d+L?", "", plan.simpleString(25)), metrics, children)


def executed(df: DataFrame) -> Node:
    """The tree of a plan that has run (after collect() on the same DataFrame)."""
    return _tree(df._jdf.queryExecution().executedPlan())


def costed(df: DataFrame) -> list[str]:
    """The optimized plan, a line a node: blocks (of 4096 bytes) read below it, rows and width as Spark estimates them."""

    def walk(plan, depth: int) -> tuple[int, list[str]]:
        found = plan.children()
        below = [walk(found.apply(i), depth + 1) for i in range(found.size())]
        stats, width = plan.stats(), max(plan.schema().defaultSize(), 1)
        size = int(str(stats.sizeInBytes()))
        blocks = sum(b for b, _ in below) if below else -(-size // 4096)
        rows = int(str(stats.rowCount().get())) if stats.rowCount().isDefined() else size // width
        line = f"{'  ' * depth}-> {plan.nodeName().strip()}  (cost=0..{blocks} rows={rows} width={width})"
        return blocks, [line, *(text for _, lines in below for text in lines)]

    return walk(df._jdf.queryExecution().optimizedPlan(), 0)[1]


def estimate(df: DataFrame) -> str:
    """Spark's formatted plan, and the optimizer's estimates."""
    execution = df._jdf.queryExecution()
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return execution.explainString(mode.fromString("formatted")) + "\n" + execution.explainString(mode.fromString("cost"))


@dataclass
class Measured:
    """A run of a query."""

    planning_ms: float
    execution_ms: float
    rows: int
    root: Node

    def __str__(self) -> str:
        return "\n".join([*self.root.lines(), f"Planning time: {self.planning_ms:.1f} ms", f"Execution time: {self.execution_ms:.1f} ms  rows={self.rows}"])


def analyze(make: Callable[[], DataFrame]) -> Measured:
    """Plans and runs a query; its rows are counted where they are, not fetched."""
    began = time.perf_counter()
    df = make()
    execution = df._jdf.queryExecution()
    execution.executedPlan()
    planned = time.perf_counter()
    rows = execution.toRdd().count()  # runs the very plan that is shown; a write or count() would plan anew
    ran = time.perf_counter()
    return Measured((planned - began) * 1e3, (ran - planned) * 1e3, rows, _tree(execution.executedPlan()))
