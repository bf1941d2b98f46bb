"""Extracted records to normalised records: one row an invoice, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import to_decimal
from ..functions.text import clean_text, currency_code, parse_iso_date, strip
from ..schemas import NORMALIZED_ITEM


def normalize_items(items: Column) -> Column:
    """Decimals and cleaned text of line items; a missing unit price or line total is derived from the other two.

    Each number is read once, in a first pass; the second takes it as often as it needs.
    """

    def read(i: Column) -> Column:
        number = lambda f, scale: to_decimal(i[f], scale).alias(f)
        return F.struct(strip(i["description"]).alias("description"), number("quantity", 4), number("unit_price", 4), number("line_total", 2), number("tax_rate", 4), i["confidence"].alias("confidence"))

    def derive(i: Column, index: Column) -> Column:
        quantity, price, total = i["quantity"], i["unit_price"], i["line_total"]
        price_derived = F.coalesce(price.isNull() & (quantity != 0) & total.isNotNull(), F.lit(False))
        total_derived = total.isNull() & quantity.isNotNull() & price.isNotNull()
        new_price = F.round(total / F.when(quantity != 0, quantity), 4).try_cast("decimal(18,4)")
        new_total = F.round(quantity * price, 2).try_cast("decimal(18,2)")
        return F.struct(
            F.nullif(i["description"], F.lit("")).alias("description"),
            quantity.alias("quantity"),
            F.when(price_derived, new_price).otherwise(price).alias("unit_price"),
            F.when(total_derived, new_total).otherwise(total).alias("line_total"),
            i["tax_rate"].try_cast("decimal(14,4)").alias("tax_rate"),
            i["confidence"].alias("confidence"),
            index.cast("int").alias("sort_order"),
            price_derived.alias("unit_price_derived"),
            total_derived.alias("line_total_derived"),
        )

    return F.transform(F.transform(items, read), derive)


def normalize_invoices(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Silver rows from bronze rows; ``keep`` names further columns to carry. The raw dates stay for the date rules.

    The header confidence falls back to the mean of the items' confidences.
    """
    known = F.filter(F.transform("line_items", lambda i: i["confidence"]), lambda c: c.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(known), F.lit(0))
    return df.select(
        *keep,
        clean_text(F.col("vendor.name")).alias("vendor_name"),
        clean_text(F.col("vendor.tax_id")).alias("vendor_tax_id"),
        clean_text(F.col("vendor.address")).alias("vendor_address"),
        clean_text(F.col("vendor.phone")).alias("vendor_phone"),
        clean_text(F.col("vendor.email")).alias("vendor_email"),
        clean_text(F.col("invoice_number")).alias("invoice_number"),
        parse_iso_date(F.col("invoice_date")).alias("invoice_date"),
        parse_iso_date(F.col("due_date")).alias("due_date"),
        currency_code(F.col("currency")).alias("currency"),
        clean_text(F.col("purchase_order")).alias("purchase_order"),
        clean_text(F.col("payment_terms")).alias("payment_terms"),
        *[to_decimal(F.col(c), 2).alias(c) for c in ("subtotal", "tax_amount", "discount_amount", "grand_total")],
        F.coalesce(normalize_items(F.col("line_items")), F.array().cast(f"array<{NORMALIZED_ITEM}>")).alias("line_items"),
        F.coalesce("confidence", mean).alias("ai_confidence"),
        clean_text(F.col("currency")).alias("raw_currency"),
        F.nullif(F.col("invoice_date"), F.lit("")).alias("raw_invoice_date"),
        F.nullif(F.col("due_date"), F.lit("")).alias("raw_due_date"),
    )
