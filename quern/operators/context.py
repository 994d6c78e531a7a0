"""Context packing under a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

TRUNCATED = "\n[truncated]"


def prefix(items: DataFrame, budget: int = 4000, order: str = "ordinal", by: str = "query_id") -> DataFrame:
    """Items until the first that doesn't fit."""
    so_far = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("used", F.sum(F.length("content")).over(so_far)).where(F.col("used") <= budget)


def packed(items: DataFrame, budget: int = 12000, least: int = 500, by: str = "query_id") -> DataFrame:
    """items (query_id, ordinal, type, content, ...) that are admitted, in order, with truncated.

    A text that doesn't fit is cut to what is left if that is at least ``least`` characters, else passed over; graph items are always
    admitted and counted. What is admitted depends on all before, so an aggregate runs over a query's items: only their lengths, types and,
    for the ends of cut texts, the texts themselves. A query has at most a few dozen items.
    """
    n = F.struct(F.col("ordinal").alias("ordinal"), F.col("type").alias("type"), F.col("content").alias("content"))
    lists = items.groupBy(by).agg(F.array_sort(F.collect_list(n)).alias("items"))
    blank = F.struct(F.lit(0).cast("int").alias("used"), F.array().cast("array<struct<ordinal:int,content:string,truncated:boolean>>").alias("out"))

    def step(acc, x):
        size, left = F.length(x.content), F.lit(budget) - acc.used
        text = x.type.isin("vector", "graph_evidence")
        over = text & (acc.used + size > budget)
        cut = F.concat(F.regexp_replace(F.left(x.content, F.greatest(left, F.lit(0))), r"(?U)\s+$", ""), F.lit(TRUNCATED))
        content = F.when(over, cut).otherwise(x.content)
        add = F.struct((acc.used + F.length(content)).cast("int").alias("used"), F.concat(acc.out, F.array(F.struct(x.ordinal.cast("int").alias("ordinal"), content.alias("content"), over.alias("truncated")))).alias("out"))
        return F.when(over & (left < least), acc).otherwise(add)

    got = lists.select(by, F.explode(F.aggregate("items", blank, step, lambda a: a.out)).alias("x")).select(by, F.col("x.ordinal").alias("ordinal"), F.col("x.content").alias("packed"), F.col("x.truncated").alias("truncated"))
    return items.withColumn("ordinal", F.col("ordinal").cast("int")).join(got, [by, "ordinal"]).drop("content").withColumnRenamed("packed", "content")


def labelled(items: DataFrame) -> DataFrame:
    return items.withColumn("label", X.source_label(F.col("source"), F.col("page") if "page" in items.columns else F.lit(None).cast("int")))
