"""Cost of model calls at several levels in one aggregation, and what cached prompts saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ["organization_id", "day", "vendor", "invoice_id"]
#: The dimensions of each level; its rows have nulls in the others.
LEVELS = {
    "all": [],
    "organization": ["organization_id"],
    "day": ["organization_id", "day"],
    "vendor": ["organization_id", "vendor"],
    "invoice": ["organization_id", "vendor", "invoice_id"],
}


def cost_report(calls: DataFrame) -> DataFrame:
    """level, the dimensions, calls, invoices, tokens, cost, saved and saved_share of ``calls``.

    ``calls(organization_id, day, vendor, invoice_id, tokens, cached_tokens, price_per_1k)``: tokens are billed, cached
    ones would have been without the cache; saved_share is their part of what all would have cost. A null in a dimension
    is a value of its own, told from a level's nulls by grouping_id; null numbers count as 0. Money is decimal, so sums
    don't depend on their order. Calls are first summed by all dimensions, so what the levels expand is a row an invoice
    and day, and each level combines before its shuffle.
    """
    price = F.coalesce(F.col("price_per_1k").cast("decimal(12,6)"), F.lit(0).cast("decimal(12,6)"))
    count = lambda c: F.coalesce(F.col(c).cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    money = lambda c: F.sum((count(c) * price / 1000).cast("decimal(28,9)")).cast("decimal(38,9)").alias(c)
    first = calls.groupBy(*DIMENSIONS).agg(F.count("*").alias("calls"), F.sum(count("tokens")).cast("long").alias("n"), money("tokens"), money("cached_tokens"))
    sums = [F.sum(c).alias(a) for c, a in (("calls", "calls"), ("n", "tokens"), ("tokens", "cost"), ("cached_tokens", "saved"))]
    rows = first.groupingSets([[F.col(c) for c in v] for v in LEVELS.values()], *DIMENSIONS).agg(_level().alias("level"), F.count_distinct("invoice_id").alias("invoices"), *sums)
    whole = (F.col("cost") + F.col("saved")).cast("double")
    return rows.select("level", *DIMENSIONS, "calls", "invoices", "tokens", "cost", "saved", (F.col("saved").cast("double") / F.nullif(whole, F.lit(0.0))).alias("saved_share"))


def cost_per_invoice(calls: DataFrame) -> DataFrame:
    """month, invoices, cost, per_invoice of ``calls(day, invoice_id, tokens, price_per_1k)``; invoices are summed up first."""
    money = (F.col("tokens").cast("decimal(18,0)") * F.col("price_per_1k").cast("decimal(12,6)") / 1000).cast("decimal(28,9)")
    each = calls.groupBy(F.trunc("day", "month").alias("month"), "invoice_id").agg(F.sum(money).alias("cost"))
    rows = each.groupBy("month").agg(F.count("*").alias("invoices"), F.sum("cost").cast("decimal(38,9)").alias("cost"))
    return rows.withColumn("per_invoice", F.col("cost").cast("double") / F.col("invoices"))


def tiered_cost(calls: DataFrame) -> DataFrame:
    """day, calls, retried, cost, blended: what a day's calls cost when failed ones are repeated with a larger model.

    ``calls(day, failed, cost_small, cost_large)``. blended is the mean cost of a call by the formula: the small model's
    mean cost, and the larger one's for the share of calls that are repeated.
    """
    rows = calls.groupBy("day").agg(F.count("*").alias("calls"), F.count_if("failed").alias("retried"), F.avg("cost_small").alias("_small"), F.avg(F.when(F.col("failed"), F.col("cost_large"))).alias("_large"))
    share = F.col("retried") / F.col("calls")
    blended = F.col("_small") + share * F.coalesce("_large", F.lit(0.0))
    return rows.select("day", "calls", "retried", (blended * F.col("calls")).alias("cost"), blended.alias("blended"))


def _level() -> Column:
    """The level of a row: grouping_id has a bit for each dimension that is left out, the first one highest."""
    out = F.lit(None).cast("string")
    for name, own in LEVELS.items():
        bits = sum(1 << (len(DIMENSIONS) - 1 - k) for k, d in enumerate(DIMENSIONS) if d not in own)
        out = F.when(F.grouping_id() == bits, name).otherwise(out)
    return out
