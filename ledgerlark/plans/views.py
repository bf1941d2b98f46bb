"""The driver's tables seen as the domain: documents, invoices, items, vendors, logs, and bronze records.

Printed values that the tables lack follow from the keys, by the same formulas in DataFrame code here and in SQL, so
every rule meets rows that pass, fail and are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "REVIEW_REQUIRED").when(k % 3 == 0, "FAILED").otherwise("AI_PROCESSING")
    created = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"),
        F.concat(F.lit("invoice_"), k.cast("string"), F.lit(".pdf")).alias("filename"),
        status.alias("status"),
        F.when(k % 4 == 0, "ocr").otherwise("digital_pdf").alias("source_type"),
        created.alias("created_at"),
        F.timestamp_micros(F.unix_micros(created) + (k % 5000) * 1000).alias("updated_at"),
    )


DOCUMENTS_SQL = """docs AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'invoice_' || o_orderkey || '.pdf' AS filename,
  CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' WHEN o_orderstatus = 'O' THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 3 = 0 THEN 'FAILED' ELSE 'AI_PROCESSING' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN 'ocr' ELSE 'digital_pdf' END AS source_type, o_orderdate AS created_at, o_orderkey % 5000 AS ms FROM orders)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_custkey") % 97
    date = F.col("o_orderdate").cast("date")
    return (
        table(spark, sf_dir, "orders")
        .where("o_orderstatus <> 'P'")
        .select(
            F.concat(F.lit("I"), k.cast("string")).alias("id"),
            k.cast("string").alias("document_id"),
            F.concat(F.lit("V"), v.cast("string")).alias("vendor_id"),
            F.when(k % 13 != 0, F.concat(F.lit("INV-"), k.cast("string"))).alias("invoice_number"),
            date.alias("invoice_date"),
            F.date_add(date, (k % 45).cast("int")).alias("due_date"),
            F.lit(None).cast("decimal(14,2)").alias("subtotal"),
            F.when(k % 4 != 0, (k % 1000).cast("decimal(14,2)")).alias("tax_amount"),
            F.lit(0).cast("decimal(14,2)").alias("discount_amount"),
            F.col("o_totalprice").cast("decimal(14,2)").alias("grand_total"),
            F.when(k % 2 == 0, "USD").otherwise("EUR").alias("currency"),
            F.concat(F.lit("Vendor "), v.cast("string")).alias("vendor_name"),
            F.when(v % 5 != 0, F.concat(F.lit("TX"), v.cast("string"))).alias("vendor_tax_id"),
            F.lit(None).cast("string").alias("vendor_address"),
            F.when(F.col("o_orderstatus") == "F", "VALIDATED").otherwise("REVIEW_REQUIRED").alias("status"),
            F.when(k % 9 != 0, ((k * 37) % 10001 / 10000).cast("decimal(5,4)")).alias("composite_confidence"),
            F.lit("gpt-4o-mini").alias("extraction_model"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
        )
    )


INVOICES_SQL = """inv AS (SELECT 'I' || o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS document_id, 'V' || (o_custkey % 97) AS vendor_id,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'INV-' || o_orderkey END AS invoice_number, CAST(o_orderdate AS DATE) AS invoice_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS due_date, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 1000 AS DECIMAL(14,2)) END AS tax_amount,
  CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(14,2)) AS grand_total, CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
  'Vendor ' || (o_custkey % 97) AS vendor_name, CASE WHEN o_custkey % 97 % 5 <> 0 THEN 'TX' || (o_custkey % 97) END AS vendor_tax_id,
  CASE WHEN o_orderstatus = 'F' THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS status,
  CASE WHEN o_orderkey % 9 <> 0 THEN CAST((o_orderkey * 37) % 10001 / 10000.0 AS DECIMAL(5,4)) END AS composite_confidence, o_orderdate AS created_at
  FROM orders WHERE o_orderstatus <> 'P')"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored line items; sort_order is the place of the row in its order."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    k = F.col("l_orderkey").cast("string")
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("sort_order", F.row_number().over(w) - 1)
        .select(
            F.concat(k, F.lit("-"), F.col("sort_order").cast("string")).alias("id"),
            F.concat(F.lit("I"), k).alias("invoice_id"),
            F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("description"),
            F.col("l_quantity").cast("decimal(12,4)").alias("quantity"),
            (F.col("l_partkey") % 1000).cast("decimal(14,4)").alias("unit_price"),
            F.col("l_extendedprice").cast("decimal(14,2)").alias("line_total"),
            F.when(F.col("l_linenumber") % 3 != 0, F.lit(5).cast("decimal(6,4)")).alias("tax_rate"),
            F.when(F.col("l_partkey") % 2 == 0, F.lpad(F.col("l_partkey").cast("string"), 12, "0")).alias("product_sku"),
            "sort_order",
        )
    )


ITEMS_SQL = """it AS (SELECT *, 'I' || l_orderkey AS invoice_id, 'Part ' || l_partkey AS description,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS sort_order,
  CAST(CAST(l_extendedprice AS VARCHAR) AS DECIMAL(14,2)) AS line_total, CASE WHEN l_linenumber % 3 <> 0 THEN 5.0 END AS tax_rate,
  CASE WHEN l_partkey % 2 = 0 THEN lpad(CAST(l_partkey AS VARCHAR), 12, '0') END AS product_sku FROM lineitem)"""


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return (
        table(spark, sf_dir, "supplier")
        .where("s_suppkey < 97 and s_suppkey % 7 <> 0")
        .select(
            F.concat(F.lit("V"), s.cast("string")).alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("TX"), s.cast("string")).alias("tax_id"),
            F.when(s % 2 == 0, F.concat(F.lit("Street "), s.cast("string"))).alias("address"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("email"),
        )
    )


VENDORS_SQL = """ven AS (SELECT 'V' || s_suppkey AS id, s_name AS name, 'TX' || s_suppkey AS tax_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Street ' || s_suppkey END AS address
  FROM supplier WHERE s_suppkey < 97 AND s_suppkey % 7 <> 0)"""

_STAGE = {"view": "UPLOAD", "signup": "TEXT_EXTRACTION", "click": "AI_STRUCTURING", "error": "VALIDATION", "purchase": "PERSISTENCE"}


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.create_map(*[F.lit(x) for pair in _STAGE.items() for x in pair])[F.col("event_type")]
    n = F.get_json_object("props", "$.k")
    payload = F.when(F.col("event_type") == "click", F.concat(F.lit('{"total_tokens":'), n, F.lit(',"estimated_cost_usd":'), n, F.lit("e-6}"))).when(F.col("event_type") == "view", "{}").when(F.col("event_type") == "error", '{"error_code":"ERR_VALIDATION_FAILED"}')
    return table(spark, sf_dir, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.col("user_id").cast("string").alias("document_id"),
        stage.alias("stage"),
        F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("status"),
        F.col("event_type").alias("message"),
        payload.alias("payload"),
        F.floor("value").cast("int").alias("duration_ms"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


LOGS_SQL = """logs AS (SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, CAST(user_id AS VARCHAR) AS document_id,
  CASE event_type WHEN 'view' THEN 'UPLOAD' WHEN 'signup' THEN 'TEXT_EXTRACTION' WHEN 'click' THEN 'AI_STRUCTURING' WHEN 'error' THEN 'VALIDATION' WHEN 'purchase' THEN 'PERSISTENCE' END AS stage,
  CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS status, event_type AS message,
  CASE event_type WHEN 'click' THEN '{"total_tokens":' || json_extract_string(props, '$.k') || ',"estimated_cost_usd":' || json_extract_string(props, '$.k') || 'e-6}' WHEN 'view' THEN '{}' WHEN 'error' THEN '{"error_code":"ERR_VALIDATION_FAILED"}' END AS payload,
  CAST(floor(value) AS INTEGER) AS duration_ms, ts AS created_at FROM events)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze records with document_id, ord and ocr_confidence: an order with its lines as the array of items."""
    k, line, price = F.col("l_orderkey"), F.col("l_linenumber"), (F.col("l_partkey") % 1000) + 0.25
    off = k + line
    total = F.when(off % 19 != 0, F.col("l_quantity") * price + F.when(off % 17 == 0, 1.0).otherwise(0.0))
    rate = F.when(k % 3 == 0, None).when((k % 5 == 0) & (line % 2 == 0), 7.5).otherwise(5.0)
    item = F.struct(
        F.concat(F.lit(" Part "), F.col("l_partkey").cast("string")).alias("description"),
        F.col("l_quantity").alias("quantity"),
        F.when(line % 3 != 0, price).alias("unit_price"),
        total.alias("line_total"),
        rate.alias("tax_rate"),
        ((line % 8) / 8).alias("confidence"),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", item.alias("item"))
    lines = table(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["item"]).alias("line_items"), F.sum(total).alias("s"))
    o = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(lines, o == F.col("k"), "left")
    s = F.col("s") + F.when(o % 7 == 0, 1.0).otherwise(0.0)
    tax = F.when(o % 4 != 0, F.floor(s * 5) / 100)
    discount = F.when(o % 6 == 0, 1.5)
    grand = s + F.coalesce(tax, F.lit(0.0)) - F.coalesce(discount, F.lit(0.0)) + F.when(o % 23 == 0, 5.0).otherwise(0.0)
    date = F.col("o_orderdate").cast("date")
    text = F.when(o % 37 == 0, "15/01/2026").when(o % 41 != 0, date.cast("string"))
    v = F.col("o_custkey") % 97
    name = F.when(o % 31 != 0, F.concat(F.lit(" Vendor "), v.cast("string"), F.lit(" ")))
    vendor = F.struct(name.alias("name"), F.when(v % 5 != 0, F.concat(F.lit("TX"), v.cast("string"))).alias("tax_id"), F.when(o % 3 == 0, F.concat(F.lit("Street "), o.cast("string"))).alias("address"), F.lit(None).cast("string").alias("phone"), F.when(o % 11 == 0, F.concat(F.lit("ap"), o.cast("string"), F.lit("@acme.test"))).alias("email"))
    currency = F.element_at(F.array(F.lit("usd"), F.lit(" EUR "), F.lit("€"), F.lit("ZZZ"), F.lit(None)), (o % 5 + 1).cast("int"))
    return rows.select(
        o.cast("string").alias("document_id"),
        o.alias("ord"),
        F.when(o % 8 != 0, 0.5 + (o % 51) / 100).alias("ocr_confidence"),
        vendor.alias("vendor"),
        F.when(o % 13 != 0, F.concat(F.lit("INV-"), o.cast("string"))).alias("invoice_number"),
        text.alias("invoice_date"),
        F.date_add(date, (o % 45).cast("int") - 3).cast("string").alias("due_date"),
        currency.alias("currency"),
        F.when(o % 2 == 1, F.concat(F.lit("PO-"), o.cast("string"))).alias("purchase_order"),
        F.lit("Net 30").alias("payment_terms"),
        F.when(o % 11 != 0, s).alias("subtotal"),
        tax.alias("tax_amount"),
        discount.alias("discount_amount"),
        F.when(o % 29 != 0, grand).alias("grand_total"),
        "line_items",
        F.when(o % 3 != 0, (o % 100) / 100).alias("confidence"),
    )


def r4(x: str) -> str:
    """SQL of the half-even rounding to four places by exact binary value."""
    n = f"(CAST(({x}) * 1152921504606846976 AS HUGEINT) * 10000)"
    return f"(({n} // 1152921504606846976 + CASE WHEN {n} % 1152921504606846976 > 576460752303423488 OR ({n} % 1152921504606846976 = 576460752303423488 AND {n} // 1152921504606846976 % 2 = 1) THEN 1 ELSE 0 END) / 10000.0)"


#: The bronze records, normalised, in SQL: items (si), headers (sh).
SILVER_SQL = """li AS (SELECT l_orderkey AS k, l_linenumber AS n,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS INTEGER) AS i, l_partkey,
  CAST(l_quantity AS DECIMAL(18,4)) AS q, CASE WHEN l_linenumber % 3 <> 0 THEN CAST((l_partkey % 1000) + 0.25 AS DECIMAL(18,4)) END AS p0,
  CASE WHEN (l_orderkey + l_linenumber) % 19 <> 0 THEN CAST(l_quantity * ((l_partkey % 1000) + 0.25) + CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) END AS t0,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL WHEN l_orderkey % 5 = 0 AND l_linenumber % 2 = 0 THEN CAST(7.5 AS DECIMAL(14,4)) ELSE CAST(5 AS DECIMAL(14,4)) END AS r FROM lineitem),
si AS (SELECT k, i, n, l_partkey, q, r, p0 IS NULL AND q <> 0 AND t0 IS NOT NULL AS pd, t0 IS NULL AND p0 IS NOT NULL AND q IS NOT NULL AS td,
  CASE WHEN p0 IS NULL AND q <> 0 AND t0 IS NOT NULL THEN CAST(round(CAST(t0 AS DOUBLE) / CAST(q AS DOUBLE), 4) AS DECIMAL(18,4)) ELSE p0 END AS p,
  CASE WHEN t0 IS NULL AND p0 IS NOT NULL THEN CAST(round(q * p0, 2) AS DECIMAL(18,2)) ELSE t0 END AS t, t0 FROM li),
sums AS (SELECT k, sum(t0) AS s0, CAST(sum(t) AS DECIMAL(18,2)) AS items_sum, count(*) AS n_items, count(DISTINCT r) AS n_rates, max(r) AS rate, avg((n % 8) / 8.0) AS item_conf FROM si GROUP BY k),
h0 AS (SELECT o.*, s.*, s0 + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS s FROM orders o LEFT JOIN sums s ON s.k = o.o_orderkey),
h1 AS (SELECT *, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(floor(s * 5) AS BIGINT) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS tax, CASE WHEN o_orderkey % 6 = 0 THEN CAST(1.5 AS DECIMAL(18,2)) END AS discount FROM h0),
sh AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(s AS DECIMAL(18,2)) END AS subtotal, tax, discount,
  CASE WHEN o_orderkey % 29 <> 0 THEN CAST(s + coalesce(tax, 0) - coalesce(discount, 0) + CASE WHEN o_orderkey % 23 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) END AS grand_total,
  CASE WHEN o_orderkey % 31 <> 0 THEN 'Vendor ' || (o_custkey % 97) END AS vendor_name, CASE WHEN o_custkey % 97 % 5 <> 0 THEN 'TX' || (o_custkey % 97) END AS vendor_tax_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Street ' || o_orderkey END AS vendor_address, CASE WHEN o_orderkey % 11 = 0 THEN 'ap' || o_orderkey || '@acme.test' END AS vendor_email,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'INV-' || o_orderkey END AS invoice_number,
  CASE WHEN o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0 THEN CAST(o_orderdate AS DATE) END AS invoice_date, o_orderkey % 37 = 0 AS bad_date, o_orderkey % 37 <> 0 AND o_orderkey % 41 = 0 AS no_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 - 3 AS INTEGER) AS due_date, CASE o_orderkey % 5 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'EUR' WHEN 3 THEN 'ZZZ' END AS currency,
  CASE WHEN o_orderkey % 2 = 1 THEN 'PO-' || o_orderkey END AS purchase_order, coalesce(n_items, 0) AS n_items, items_sum, n_rates, rate,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) / 100.0 ELSE item_conf END AS ai, CASE WHEN o_orderkey % 8 <> 0 THEN 0.5 + (o_orderkey % 51) / 100.0 END AS ocr FROM h1)"""

_LINE = "abs(CAST(round_even(q * p, 2) AS DECIMAL(18,2)) - t) <= 0.02"
#: One row a check: document_id, name, status, field.
CHECKS_SQL = f"""{SILVER_SQL},
ck AS (
  SELECT k, 'INVOICE_DATE_VALID' AS name, CASE WHEN invoice_date IS NULL THEN 'FAILED' ELSE 'PASSED' END AS status, 'invoice_date' AS field FROM sh
  UNION ALL SELECT k, 'CURRENCY_VALID', CASE WHEN currency IN ('USD', 'EUR') THEN 'PASSED' ELSE 'WARNING' END, 'currency' FROM sh
  UNION ALL SELECT k, 'UNIT_PRICE_DERIVED', 'PASSED', 'line_items[' || i || '].unit_price' FROM si WHERE pd
  UNION ALL SELECT k, 'LINE_TOTAL_DERIVED', 'WARNING', 'line_items[' || i || '].line_total' FROM si WHERE td
  UNION ALL SELECT k, 'VENDOR_NAME_PRESENT', CASE WHEN vendor_name IS NULL THEN 'FAILED' ELSE 'PASSED' END, 'vendor_name' FROM sh
  UNION ALL SELECT k, 'INVOICE_NUMBER_PRESENT', CASE WHEN invoice_number IS NULL THEN 'FAILED' ELSE 'PASSED' END, 'invoice_number' FROM sh
  UNION ALL SELECT k, 'GRAND_TOTAL_PRESENT', CASE WHEN grand_total IS NULL THEN 'FAILED' ELSE 'PASSED' END, 'grand_total' FROM sh
  UNION ALL SELECT k, 'LINE_ITEMS_PRESENT', CASE WHEN n_items = 0 THEN 'FAILED' ELSE 'PASSED' END, 'line_items' FROM sh
  UNION ALL SELECT k, 'PURCHASE_ORDER_PRESENT', CASE WHEN purchase_order IS NULL THEN 'SKIPPED' ELSE 'PASSED' END, 'purchase_order' FROM sh
  UNION ALL SELECT k, 'LINE_ITEM_MATH', CASE WHEN p IS NULL OR t IS NULL THEN 'WARNING' WHEN {_LINE} THEN 'PASSED' ELSE 'FAILED' END,
    'line_items[' || i || ']' || CASE WHEN p IS NULL OR t IS NULL OR {_LINE} THEN '' ELSE '.line_total' END FROM si
  UNION ALL SELECT k, 'SUBTOTAL_MATCHES_ITEMS', CASE WHEN subtotal IS NULL OR items_sum IS NULL THEN 'SKIPPED' WHEN abs(items_sum - subtotal) <= 0.02 THEN 'PASSED' ELSE 'FAILED' END, 'subtotal' FROM sh
  UNION ALL SELECT k, 'GRAND_TOTAL_MATH', CASE WHEN grand_total IS NULL OR coalesce(subtotal, items_sum) IS NULL THEN 'SKIPPED'
    WHEN abs(coalesce(subtotal, items_sum) + coalesce(tax, 0) - coalesce(discount, 0) - grand_total) <= 0.02 THEN 'PASSED' ELSE 'FAILED' END, 'grand_total' FROM sh
  UNION ALL SELECT k, 'TAX_CONSISTENT', CASE WHEN coalesce(n_rates, 0) <> 1 OR subtotal IS NULL OR tax IS NULL THEN 'SKIPPED'
    WHEN abs(CAST(round_even(subtotal * rate * CAST(0.01 AS DECIMAL(3,2)), 2) AS DECIMAL(18,2)) - tax) <= 0.02 THEN 'PASSED' ELSE 'FAILED' END, 'tax_amount' FROM sh
  UNION ALL SELECT k, 'DATE_ORDER', CASE WHEN due_date >= invoice_date THEN 'PASSED' ELSE 'FAILED' END, 'due_date' FROM sh WHERE invoice_date IS NOT NULL AND due_date IS NOT NULL),
cn AS (SELECT k, count(*) FILTER (status = 'PASSED') AS n_passed, count(*) FILTER (status = 'FAILED') AS n_failed, count(*) FILTER (status = 'WARNING') AS n_warning, count(*) FILTER (status = 'SKIPPED') AS n_skipped FROM ck GROUP BY k),
cr AS (SELECT *, coalesce(n_passed / nullif(n_passed + n_failed, 0), 0.0) AS ratio FROM cn JOIN sh USING (k)),
raw AS (SELECT *, (coalesce(0.3::DOUBLE * least(greatest(ocr::DOUBLE, 0), 1), 0) + coalesce(0.4::DOUBLE * least(greatest(ai::DOUBLE, 0), 1), 0) + 0.3::DOUBLE * ratio)
  / (CASE WHEN ocr IS NULL THEN 0::DOUBLE ELSE 0.3::DOUBLE END + CASE WHEN ai IS NULL THEN 0::DOUBLE ELSE 0.4::DOUBLE END + 0.3::DOUBLE) AS x FROM cr),
sc AS (SELECT *, {r4("x")} AS composite FROM raw)"""
