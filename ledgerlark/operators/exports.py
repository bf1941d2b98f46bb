"""Invoice exports: JSON, text summary and line-item CSV, as columns; and bulk files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXPORT_VERSION
from ..functions.text import file_stem, fixed

# Headers of the CSV export and formats.
CSV_HEADERS = ("Description", "Quantity", "Unit Price", "Line Total", "Tax Rate (%)", "UPC")
FORMATS = ("json", "txt", "csv")
RULE = "-" * 48


def export_filename(invoice_number: Column, invoice_id: Column, kind: str = "json") -> Column:
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    return F.concat(file_stem(invoice_number, invoice_id), F.lit({"json": ".json", "txt": ".txt", "csv": "_items.csv"}[kind]))


def _vendor(field: str, fallback: str | None) -> Column:
    own = F.col(fallback) if fallback else F.lit(None).cast("string")
    return F.when(F.col("vendor").isNotNull(), F.col(f"vendor.{field}")).otherwise(own)


def _positions() -> Column:
    """Items in order with their positions; amounts as doubles."""
    sorted_ = F.array_sort(F.coalesce("items", F.array().cast(F_ITEMS)))
    num = lambda i, f: i[f].cast("double").alias(f)
    return F.transform(
        sorted_,
        lambda i, k: F.struct(
            (k + 1).cast("int").alias("position"), i["description"].alias("description"), num(i, "quantity"), num(i, "unit_price"), num(i, "line_total"), num(i, "tax_rate"), i["product_sku"].alias("sku_upc")
        ),
    )


F_ITEMS = "array<struct<sort_order:int,id:string,description:string,quantity:decimal(12,4),unit_price:decimal(14,4),line_total:decimal(14,2),tax_rate:decimal(6,4),product_sku:string>>"


def export_payload() -> Column:
    """The export object of a row of ``invoice_detail`` with filename, source_type, extraction_model and created_at."""
    num = lambda c, name: F.col(c).cast("double").alias(name)
    totals = F.struct(num("subtotal", "subtotal"), num("tax_amount", "tax"), num("discount_amount", "discount"), num("grand_total", "grand_total"))
    day = lambda c: F.col(c).cast("string").alias(c)
    header = F.struct("invoice_number", day("invoice_date"), day("due_date"), "currency", totals.alias("totals"))
    vendor = F.struct(
        _vendor("name", "vendor_name").alias("name"), _vendor("tax_id", "vendor_tax_id").alias("tax_id"), _vendor("address", "vendor_address").alias("address"), _vendor("phone", None).alias("phone"), _vendor("email", None).alias("email")
    )
    validation = F.struct("status", (F.col("status") == "REVIEW_REQUIRED").alias("review_required"), num("composite_confidence", "composite_confidence"))
    whole = F.unix_micros("created_at") % 1000000 == 0
    made = F.when(whole, F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")).alias("processed_at")
    processing = F.struct("filename", "source_type", "extraction_model", made)
    return F.struct(F.lit(EXPORT_VERSION).alias("schema_version"), F.col("id").alias("invoice_id"), "document_id", header.alias("invoice"), vendor.alias("vendor"), _positions().alias("line_items"), validation.alias("validation"), processing.alias("processing"))


def export_json() -> Column:
    return F.to_json(export_payload(), {"ignoreNullFields": "false"})


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("—"))


def _amount(c: Column) -> Column:
    return F.coalesce(F.format_number(c.cast("double"), 2), F.lit("—"))


def export_text() -> Column:
    """The text summary of a row of ``invoice_detail``."""
    block = lambda label, value: F.concat(F.lit(f"{label}:\n"), value, F.lit("\n"))
    day = lambda c: _shown(F.col(c))
    head = F.concat_ws(
        "\n", F.lit("Vendor\n------"), _shown(_vendor("name", "vendor_name")), F.lit(""), block("Invoice Number", _shown(F.col("invoice_number"))), block("Invoice Date", day("invoice_date")), block("Due Date", day("due_date")), block("Currency", _shown(F.col("currency"))), F.lit(f"{RULE}\n\nItems\n")
    )
    one = lambda i: F.concat_ws("\n", F.concat(i["position"].cast("string"), F.lit(".")), block("Description", _shown(i["description"])), block("Quantity", _amount(i["quantity"])), block("Unit Price", _amount(i["unit_price"])), block("Line Total", _amount(i["line_total"])))
    total = F.trim(F.concat(_amount(F.col("grand_total")), F.lit(" "), F.coalesce("currency", F.lit(""))))
    sure = F.when(F.col("composite_confidence").isNull(), "—").otherwise(F.concat(fixed(F.col("composite_confidence").cast("double") * 100, 1, True), F.lit("%")))
    tail = F.concat_ws(
        "\n",
        F.lit(f"{RULE}\n\nTotals\n"),
        block("Subtotal", _amount(F.col("subtotal"))),
        block("Tax", _amount(F.col("tax_amount"))),
        block("Discount", _amount(F.col("discount_amount"))),
        block("Grand Total", total),
        F.lit(f"{RULE}\n"),
        block("Validation Status", _shown(F.col("status"))),
        block("Confidence", sure),
        block("Review Required", F.when(F.col("status") == "REVIEW_REQUIRED", "Yes").otherwise("No")),
    )
    items = F.array_join(F.transform(_positions(), one), "\n")
    return F.concat_ws("\n", head, F.nullif(items, F.lit("")), tail)


def csv_rows(detail: DataFrame) -> DataFrame:
    """The rows of the line-item CSV, with the invoice id to write or split by; amounts as decimals' shortest text."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c.cast("decimal(20,4)").cast("string"), "0+$", ""), "\\.$", ".0")
    each = detail.select(F.col("id").alias("invoice_id"), F.explode(F.array_sort("items")).alias("i"))
    values = (F.col("i.description"), plain(F.col("i.quantity")), plain(F.col("i.unit_price")), plain(F.col("i.line_total")), F.coalesce(plain(F.col("i.tax_rate")), F.lit("")), F.coalesce("i.product_sku", F.lit("")))
    return each.select("invoice_id", F.col("i.sort_order").alias("sort_order"), *[v.alias(h) for v, h in zip(values, CSV_HEADERS, strict=True)])


def write_items_csv(detail: DataFrame, path: str) -> None:
    """A folder for each invoice with its CSV: CRLF lines, quotes doubled, nulls empty."""
    rows = csv_rows(detail)
    rows.repartition("invoice_id").sortWithinPartitions("invoice_id", "sort_order").drop("sort_order").write.partitionBy("invoice_id").options(header=True, lineSep="\r\n", escape='"', nullValue="", emptyValue="").csv(path)


def bulk_rows(invoices: DataFrame, items: DataFrame, status: str = "VALIDATED", from_date: str | None = None, to_date: str | None = None) -> DataFrame:
    """One row an item with the invoice's values repeated (planned feature; columns chosen here)."""
    kept = invoices.where(F.col("status") == status)
    if from_date:
        kept = kept.where(F.col("invoice_date") >= F.lit(from_date).cast("date"))
    if to_date:
        kept = kept.where(F.col("invoice_date") <= F.lit(to_date).cast("date"))
    i = items.select("invoice_id", "sort_order", "description", "quantity", "unit_price", "line_total", "tax_rate", "product_sku")
    head = kept.select(F.col("id").alias("invoice_id"), "invoice_number", "invoice_date", "due_date", "vendor_name", "vendor_tax_id", "currency", "subtotal", "tax_amount", "grand_total")
    return head.join(i, "invoice_id")


def erp_payload() -> Column:
    """A vendor bill for an ERP import, from a row of ``invoice_detail`` (planned feature; shape chosen here)."""
    line = lambda i: F.struct(i["description"].alias("name"), i["quantity"].alias("quantity"), i["unit_price"].alias("price_unit"))
    return F.to_json(F.struct(F.lit("in_invoice").alias("move_type"), _vendor("name", "vendor_name").alias("partner"), F.col("invoice_number").alias("ref"), F.col("invoice_date").cast("string").alias("invoice_date"), "currency", F.transform(_positions(), line).alias("invoice_line_ids")))
