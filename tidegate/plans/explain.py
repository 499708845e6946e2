"""A query's optimized plan as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

SCHEMA = "id long, parent_id long, operation string, detail string, cost double, rows long"


def rows(df: DataFrame) -> list[tuple]:
    """(id, parent_id, operation, detail, cost, rows): cost is Catalyst's estimate of bytes, rows -1 if unknown."""
    out: list[tuple] = []

    def walk(node, parent: int | None) -> None:
        me = len(out) + 1
        stats = node.stats()
        n = stats.rowCount()
        out.append((me, parent, node.nodeName(), node.simpleString(120), float(str(stats.sizeInBytes())), int(str(n.get())) if n.isDefined() else -1))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), me)

    walk(df._jdf.queryExecution().optimizedPlan(), None)
    return out


def explain(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(rows(df), SCHEMA)


def filtered_columns(df: DataFrame) -> list[str]:
    """Columns that the plan filters or joins by, for advice on layout (partitioning, bucketing, sorting)."""
    found: list[str] = []

    def walk(node) -> None:
        if node.nodeName() in ("Filter", "Join"):
            condition = node.condition()
            condition = condition.get() if node.nodeName() == "Join" and condition.isDefined() else condition
            if node.nodeName() == "Filter" or hasattr(condition, "references"):
                refs = condition.references().toSeq()
                found.extend(refs.apply(i).name() for i in range(refs.size()))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().optimizedPlan())
    return found
