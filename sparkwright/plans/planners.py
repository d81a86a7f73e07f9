"""Planner modes and index use as settings of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: What each mode sets; heuristic is Spark's own default planning.
PLANNERS = {
    "heuristic": {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.cbo.enabled": "false",
        "spark.sql.cbo.joinReorder.enabled": "false",
    },
    "selinger": {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.cbo.enabled": "true",
        "spark.sql.cbo.joinReorder.enabled": "true",
    },
    "basic": {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.cbo.enabled": "false",
        "spark.sql.cbo.joinReorder.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.ReorderJoin,org.apache.spark.sql.catalyst.optimizer.CostBasedJoinReorder",
    },
}
INDEX = {"on": {"spark.sql.parquet.filterPushdown": "true"}, "off": {"spark.sql.parquet.filterPushdown": "false"}}


#: Every setting that some mode makes.
KEYS = sorted({k for mode in (*PLANNERS.values(), *INDEX.values()) for k in mode})


def apply(spark: SparkSession, planner: str, index: str, own: dict[str, str] | None = None) -> None:
    """Puts a session in a mode; what only other modes set goes back to own, the settings that the session came with."""
    wanted, own = PLANNERS[planner] | INDEX[index], own or {}
    for key in KEYS:
        if key in wanted:
            spark.conf.set(key, wanted[key])
        elif key in own:
            spark.conf.set(key, own[key])
        else:
            spark.conf.unset(key)
