"""Running stock of products over all days, and purchases by store.

A product's days are cut into months. A month's movements are summed first; the stock carried into a month is a running
sum over one row a month, and days are filled in and summed within their month. So a product with most of all movements
never comes together in one task: no window holds more than its months, or the days of one month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_stock(moves: DataFrame) -> DataFrame:
    """product, day, moved, stock for every day from a product's first movement to its last.

    ``moves(product, day, quantity)``: what comes in is positive, what goes out negative; quantities are summed as
    decimal(28,4). Days without movements carry the stock on. A null quantity is 0; rows without a product or day don't
    count.
    """
    daily = moves.where("product is not null and day is not null").groupBy("product", F.col("day").cast("date").alias("day")).agg(F.sum(F.coalesce(F.col("quantity").cast("decimal(28,4)"), F.lit(0).cast("decimal(28,4)"))).cast("decimal(28,4)").alias("moved"))
    month = F.trunc("day", "month").alias("month")
    days = daily.groupBy("product", month).agg(F.sum("moved").cast("decimal(28,4)").alias("net"), F.min("day").alias("first"), F.max("day").alias("last"), F.map_from_entries(F.collect_list(F.struct("day", "moved"))).alias("moves"))
    spans = days.groupBy("product").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    every = spans.select("product", F.col("first").alias("_first"), F.col("last").alias("_last"), F.explode(F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))).alias("month"))
    order = W.partitionBy("product").orderBy("month")
    filled = every.join(days.select("product", "month", "net", "moves"), ["product", "month"], "left")
    opening = F.coalesce(F.sum("net").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(28,4)")
    filled = filled.withColumn("opening", opening)
    span = F.sequence(F.greatest("_first", "month"), F.least("_last", F.last_day("month")), F.expr("interval 1 day"))
    dated = filled.select("product", "month", "opening", "moves", F.explode(span).alias("day"))
    moved = F.coalesce(F.col("moves")[F.col("day")], F.lit(0)).cast("decimal(28,4)")
    within = W.partitionBy("product", "month").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = dated.withColumn("moved", moved)
    return rows.select("product", "day", "moved", (F.col("opening") + F.sum("moved").over(within)).cast("decimal(28,4)").alias("stock"))


def store_purchases(lines: DataFrame) -> DataFrame:
    """store, product, month, quantity, amount, share: what each store bought, and its part of the product's month."""
    rows = lines.groupBy("store", "product", F.trunc("day", "month").alias("month")).agg(F.sum("quantity").alias("quantity"), F.sum("amount").alias("amount"))
    whole = rows.groupBy("product", "month").agg(F.sum("quantity").alias("_all"))
    joined = rows.join(whole, ["product", "month"])
    return joined.select("store", "product", "month", "quantity", "amount", (F.col("quantity") / F.nullif("_all", F.lit(0))).alias("share"))
