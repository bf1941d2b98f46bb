"""Gold rows from validated silver rows: defaults, range checks, headers, items, status and stage logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import report_json

#: Column lengths of the stored tables; a longer value fails the whole invoice.
LENGTHS = {"vendor_name": 255, "vendor_tax_id": 100, "vendor_phone": 50, "vendor_email": 255, "invoice_number": 100, "currency": 10}


def row_id(*parts: Column) -> Column:
    """A stable id: the same input gives the same id in every run and retry."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def persistable() -> Column:
    """Whether every number and text of a silver row fits its stored column."""
    fits = lambda c, digits: F.coalesce(F.abs(c) < F.lit(10**digits), F.lit(True))
    header = [fits(F.col(c), 12) for c in ("subtotal", "tax_amount", "discount_amount", "grand_total")]
    short = [F.coalesce(F.length(c) <= n, F.lit(True)) for c, n in LENGTHS.items()]
    items = F.forall("line_items", lambda i: fits(i["quantity"], 8) & fits(i["unit_price"], 10) & fits(i["line_total"], 12) & fits(i["tax_rate"], 2))
    out = items
    for test in (*header, *short):
        out = out & test
    return out


def final_status(decision: Column) -> Column:
    return F.when(decision == "VALIDATED", "COMPLETED").otherwise("REVIEW_REQUIRED")


def invoice_rows(validated: DataFrame) -> DataFrame:
    """Headers: currency defaults to USD, a missing discount to 0; vendor_id only with a vendor name."""
    from .vendors import vendor_id, vendor_key

    money = lambda c, default=None: F.coalesce(F.col(c).try_cast("decimal(14,2)"), F.lit(default).cast("decimal(14,2)")).alias(c)
    return validated.select(
        row_id(F.lit("invoice"), F.col("document_id").cast("string")).alias("id"),
        F.col("document_id").cast("string").alias("document_id"),
        vendor_id(vendor_key(F.col("vendor_name"), F.col("vendor_tax_id"))).alias("vendor_id"),
        "invoice_number",
        "invoice_date",
        "due_date",
        money("subtotal"),
        money("tax_amount"),
        money("discount_amount", 0),
        money("grand_total"),
        F.coalesce("currency", F.lit("USD")).alias("currency"),
        "vendor_name",
        "vendor_tax_id",
        "vendor_address",
        F.col("decision").alias("status"),
        F.col("confidence.composite").cast("decimal(5,4)").alias("composite_confidence"),
    )


def item_rows(validated: DataFrame) -> DataFrame:
    """Line items with their defaults, one row each."""
    invoice = row_id(F.lit("invoice"), F.col("document_id").cast("string"))
    each = validated.select(invoice.alias("invoice_id"), F.explode("line_items").alias("i"))
    number = lambda c, kind: F.coalesce(F.col(f"i.{c}").try_cast(kind), F.lit(0).cast(kind)).alias(c)
    return each.select(
        row_id(F.col("invoice_id"), F.col("i.sort_order").cast("string")).alias("id"),
        "invoice_id",
        F.coalesce("i.description", F.lit("(no description)")).alias("description"),
        number("quantity", "decimal(12,4)"),
        number("unit_price", "decimal(14,4)"),
        number("line_total", "decimal(14,2)"),
        F.col("i.tax_rate").try_cast("decimal(6,4)").alias("tax_rate"),
        F.lit(0).cast("decimal(14,2)").alias("discount"),
        F.lit(None).cast("string").alias("product_sku"),
        F.col("i.sort_order").alias("sort_order"),
    )


def log_rows(df: DataFrame, stage: str, payload: Column, message: Column | str, status: Column | str = "SUCCESS", at: Column | None = None, duration: Column | None = None) -> DataFrame:
    """Stage log rows; ids follow from document and stage, so a repeated batch writes the same rows."""
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    document = F.col("document_id").cast("string")
    return df.select(
        row_id(document, F.lit(stage)).alias("id"),
        document.alias("document_id"),
        F.lit(stage).alias("stage"),
        col(status).alias("status"),
        col(message).alias("message"),
        payload.alias("payload"),
        (duration if duration is not None else F.lit(None)).cast("int").alias("duration_ms"),
        (at if at is not None else F.current_timestamp()).alias("created_at"),
    )


def validation_logs(validated: DataFrame) -> DataFrame:
    return log_rows(validated, "VALIDATION", report_json(), F.concat(F.lit("Decision: "), F.col("decision")))


def persistence_logs(saved: DataFrame) -> DataFrame:
    """Needs vendor_key and vendor_created beside the silver columns."""
    from .vendors import vendor_id

    payload = F.to_json(
        F.struct(
            row_id(F.lit("invoice"), F.col("document_id").cast("string")).alias("invoice_id"),
            vendor_id(F.col("vendor_key")).alias("vendor_id"),
            F.col("vendor_created"),
            F.size("line_items").alias("line_item_count"),
            final_status(F.col("decision")).alias("final_status"),
        ),
        {"ignoreNullFields": "false"},
    )
    return log_rows(saved, "PERSISTENCE", payload, F.concat(F.lit("Invoice persisted; document "), final_status(F.col("decision")), F.lit(".")))


def failure_logs(failed: DataFrame, stage: str, code: Column | str, detail: Column) -> DataFrame:
    """Failure rows; an unexpected error's text is cut to 500 characters."""
    col = F.lit(code) if isinstance(code, str) else code
    return log_rows(failed, stage, F.to_json(F.struct(col.alias("error_code"), F.substring(detail, 1, 500).alias("detail"))), F.substring(detail, 1, 500), "FAILURE")


def current_status(status_log: DataFrame) -> DataFrame:
    """The latest status of each document from an append-only log (document_id, seq, status)."""
    return status_log.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))


def key_violations(df: DataFrame, *key: str, nulls_distinct: bool = True) -> DataFrame:
    """Keys that occur more than once: what a unique constraint would refuse. Nulls are distinct, as in SQL."""
    rows = df
    if nulls_distinct:
        for k in key:
            rows = rows.where(F.col(k).isNotNull())
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
