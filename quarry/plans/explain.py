"""Plans as trees of plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_tree(df: DataFrame) -> dict:
    """{node, detail, rows, bytes, children} of the optimized plan; rows are known where statistics are."""

    def walk(node) -> dict:
        stats = node.stats()
        rows = stats.rowCount()
        children = node.children()
        return {
            "node": node.nodeName(),
            "detail": node.simpleString(25),
            "rows": int(str(rows.get())) if rows.isDefined() else None,
            "bytes": int(str(stats.sizeInBytes())),
            "children": [walk(children.apply(i)) for i in range(children.size())],
        }

    return walk(df._jdf.queryExecution().optimizedPlan())


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
