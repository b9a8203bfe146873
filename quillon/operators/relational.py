"""Relational operators of the dialect on DataFrames, planned by Catalyst.

Joins, grouping, sorting and limits are Spark's own; here are the shapes that differ: windows
over whole partitions, ranks with total orders, set operations by position, and top-k.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of a recursion at most.
RECURSION_LIMIT = 1024


def window_aggregate(df: DataFrame, function: Column, name: str, partition: list[str], order: list[Column] | None = None, running: bool = False) -> DataFrame:
    """df with function over the whole partition, even with an order; a running frame only if asked for."""
    spec = Window.partitionBy(*partition)
    if order:
        spec = spec.orderBy(*order)
        spec = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow if running else Window.unboundedFollowing)
    return df.withColumn(name, function.over(spec))


def ranked(df: DataFrame, kind: str, name: str, partition: list[str], order: list[Column]) -> DataFrame:
    """df with ROW_NUMBER, RANK or DENSE_RANK."""
    function = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank}[kind]()
    return df.withColumn(name, function.over(Window.partitionBy(*partition).orderBy(*order)).cast("bigint"))


def set_operation(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """UNION ALL, UNION, INTERSECT or EXCEPT by position, with the left side's names."""
    right = right.toDF(*left.columns)
    return {"UNION ALL": lambda: left.unionAll(right), "UNION": lambda: left.unionAll(right).distinct(), "INTERSECT": lambda: left.intersect(right), "EXCEPT": lambda: left.subtract(right)}[op]()


def top_k(df: DataFrame, order: list[Column], k: int, offset: int = 0) -> DataFrame:
    """Rows offset..offset+k-1 in order; Spark keeps offset+k rows a task, never sorts all."""
    return df.orderBy(*order).offset(offset).limit(k) if offset else df.orderBy(*order).limit(k)


def null_safe_anti(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left that are not in right, NULLs equal."""
    a, b = left.alias("a"), right.toDF(*left.columns).alias("b")
    condition = None
    for c in left.columns:
        same = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
        condition = same if condition is None else condition & same
    return a.join(b, condition, "left_anti")


def fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], DataFrame], limit: int = RECURSION_LIMIT) -> DataFrame:
    """Semi-naive recursion with UNION's set semantics: each round sees the rows that the last one found.

    `save` cuts lineage by writing rows where executors can be lost without losing them.
    """
    delta = save(first.distinct())
    seen = delta
    for _ in range(limit):
        if not delta.take(1):
            return seen
        delta = save(null_safe_anti(step(delta).toDF(*first.columns).distinct(), seen))
        seen = seen.unionAll(delta)
    if delta.take(1):
        raise RecursionError(f"the recursion did not end in {limit} rounds")
    return seen


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that more than one row has; rows with a NULL in the key do not count."""
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    return whole.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count("*").alias("rows")).where("rows > 1")
