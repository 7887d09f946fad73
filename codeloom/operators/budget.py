"""Packing ranked rows into a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stop_greedy(rows: DataFrame, order: list, cost: str, budget: int, header: str | None = None, header_cost: int = 0, by: list[str] | None = None) -> DataFrame:
    """The first rows, in order, whose running cost stays within the budget; a row whose `header` differs from the one before also pays header_cost. With `by`, a budget for each group."""
    w = Window.partitionBy(*(by or [])).orderBy(*order)
    own = F.col(cost)
    if header:
        fresh = ~F.lag(header).over(w).eqNullSafe(F.col(header)) | F.lag(header).over(w).isNull()
        own = own + F.when(fresh, header_cost).otherwise(0)
    spent = rows.withColumn("own_cost", own)
    return spent.withColumn("running", F.sum("own_cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("running") <= budget)


def skip_greedy(rows: DataFrame, order: list[str], cost: str, budget: int, by: str) -> DataFrame:
    """In order, each row that still fits the budget of its group; those that don't are skipped. Each group is ranked rows of one result, so it fits a task."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        for c in group.sort_values(order)[cost]:
            keep.append(c <= left)
            left -= c if keep[-1] else 0
        return group.sort_values(order)[keep]

    return rows.groupBy(by).applyInPandas(pack, rows.schema)
