"""Rankings, winners and frequencies (W1, G5, G6, L1, L2). Ties go to the smaller `order`, always given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(rows: DataFrame, group: str, score: str, order: str, name: str = "rank") -> DataFrame:
    """Place from 1; equal scores have different places."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order)))


def best_of_group(rows: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The best row of each group, the first of equals; Spark keeps one row a group before it shuffles."""
    return rank_in_group(rows, group, score, order, "__place").filter("__place = 1").drop("__place")


def top_winners(rows: DataFrame, group: str, score: str, order: str, n: int = 10) -> DataFrame:
    """L2: the n best of the groups' best rows."""
    return best_of_group(rows, group, score, order).orderBy(F.desc(score), group).limit(n)


def top_rows(rows: DataFrame, score: str, order: str, n: int) -> DataFrame:
    """L1"""
    return rows.orderBy(F.desc(score), order).limit(n)


def frequency(rows: DataFrame, item: str, group: str, order: str, n: int) -> DataFrame:
    """Place, item and the number of groups it stands in; ties by first appearance."""
    counted = rows.groupBy(item).agg(F.count_distinct(group).alias("frequency"), F.min(F.struct(group, order)).alias("__first"))
    top = counted.orderBy(F.desc("frequency"), "__first", item).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("frequency"), "__first", item))).select("place", item, "frequency")
