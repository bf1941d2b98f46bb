"""Vendor get-or-create for a whole batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTACT = ("address", "phone", "email")


def vendor_key(name: Column, tax_id: Column) -> Column:
    """Identity of a vendor: the tax id, else the exact name among vendors without one; null without a name."""
    return F.when(name.isNotNull(), F.when(tax_id.isNotNull(), F.concat(F.lit("T:"), tax_id)).otherwise(F.concat(F.lit("N:"), name)))


def vendor_id(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 32)


def upsert(batch: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The vendor dimension after ``batch(ord, vendor_name, vendor_tax_id, vendor_address, vendor_phone, vendor_email)``.

    The first row of a key creates the vendor; later ones fill blank contacts only, first known value first; stored
    values win. ``created`` tells new vendors. One aggregation for each key with map-side combine: a vendor with a third
    of all invoices costs no more than another.
    """
    keyed = batch.withColumn("vendor_key", vendor_key(F.col("vendor_name"), F.col("vendor_tax_id"))).where("vendor_key is not null")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c))).getField(c)
    new = keyed.groupBy("vendor_key").agg(
        F.min(F.struct("ord", "vendor_name")).getField("vendor_name").alias("name"),
        F.min("vendor_tax_id").alias("tax_id"),
        *[first(f"vendor_{c}").alias(c) for c in CONTACT],
        F.count("*").alias("invoices"),
    )
    new = new.withColumn("id", vendor_id(F.col("vendor_key")))
    if stored is None:
        return new.withColumn("created", F.lit(True))
    old = stored.select(vendor_key(F.col("name"), F.col("tax_id")).alias("vendor_key"), *[F.col(c).alias(f"_{c}") for c in ("id", "name", "tax_id", *CONTACT)])
    both = new.join(old, "vendor_key", "full")
    picked = [F.coalesce(f"_{c}", c).alias(c) for c in ("id", "name", "tax_id", *CONTACT)]
    return both.select("vendor_key", *picked, F.coalesce("invoices", F.lit(0)).alias("invoices"), F.col("_id").isNull().alias("created"))


def new_vendor_rows(batch: DataFrame) -> DataFrame:
    """Adds vendor_key and vendor_created (this row is the first of its key) to the rows of a batch."""
    keyed = batch.withColumn("vendor_key", vendor_key(F.col("vendor_name"), F.col("vendor_tax_id")))
    first = keyed.where("vendor_key is not null").groupBy("vendor_key").agg(F.min("ord").alias("_first"))
    return keyed.join(first, "vendor_key", "left").withColumn("vendor_created", F.coalesce(F.col("ord") == F.col("_first"), F.lit(False))).drop("_first")
