"""Queries over planned analytics; their definitions are this library's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_text import prune
from ..operators import analytics, exports, intake
from . import views
from .views import DOCUMENTS_SQL, INVOICES_SQL, ITEMS_SQL, LOGS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("product"), F.col("l_shipdate").cast("date").alias("day"), (F.round("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("amount"))


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL} SELECT inv.id AS invoice_id, invoice_number, invoice_date, vendor_name, currency, CAST(grand_total AS DOUBLE) AS grand_total, sort_order, description, CAST(it.line_total AS DOUBLE) AS line_total
FROM inv JOIN it ON it.invoice_id = inv.id WHERE status = 'VALIDATED' AND invoice_date >= DATE '1996-01-01'""")
def bulk_export(spark, sf_dir):
    rows = exports.bulk_rows(views.invoices(spark, sf_dir), views.items(spark, sf_dir), from_date="1996-01-01")
    return rows.select("invoice_id", "invoice_number", "invoice_date", "vendor_name", "currency", F.col("grand_total").cast("double").alias("grand_total"), "sort_order", "description", F.col("line_total").cast("double").alias("line_total"))


@query(f"""WITH {INVOICES_SQL}, x AS (SELECT id, vendor_tax_id, right(invoice_number, 2) AS n, date_trunc('year', invoice_date) AS d FROM inv WHERE vendor_tax_id IS NOT NULL AND invoice_number IS NOT NULL),
c AS (SELECT *, count(*) OVER w AS copies, min(id) OVER w AS first_id FROM x WINDOW w AS (PARTITION BY vendor_tax_id, n, d)) SELECT id, CAST(copies AS BIGINT) AS copies, first_id FROM c WHERE copies > 1""")
def logical_duplicates(spark, sf_dir):
    rows = views.invoices(spark, sf_dir).withColumn("invoice_number", F.right("invoice_number", F.lit(2))).withColumn("invoice_date", F.date_trunc("year", "invoice_date"))
    return intake.logical_duplicates(rows).select("id", "copies", "first_id")


@query(f"WITH {INVOICES_SQL} SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, vendor_name, CAST(sum(grand_total) AS DOUBLE) AS spend, CAST(count(*) AS BIGINT) AS invoices FROM inv GROUP BY 1, 2")
def monthly_vendor_spend(spark, sf_dir):
    return analytics.monthly(views.invoices(spark, sf_dir), "vendor_name").withColumn("spend", F.col("spend").cast("double"))


@query("SELECT p_type, round(sum(l_extendedprice), 2) AS spend, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 9) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type")
def category_spend(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return analytics.spend_share(rows, "p_type", "l_extendedprice").select("p_type", F.round("spend", 2).alias("spend"), F.round("share", 9).alias("share"))


@query(f"WITH {INVOICES_SQL} SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, currency, CAST(sum(coalesce(tax_amount, 0)) AS DOUBLE) AS tax FROM inv GROUP BY 1, 2")
def tax_liability(spark, sf_dir):
    rows = views.invoices(spark, sf_dir).withColumn("tax_amount", F.coalesce("tax_amount", F.lit(0).cast("decimal(14,2)")))
    return analytics.monthly(rows, "currency", "tax_amount").select("month", "currency", F.col("spend").cast("double").alias("tax"))


@query(f"WITH {INVOICES_SQL} SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, status, CAST(count(*) AS BIGINT) AS invoices FROM inv GROUP BY 1, 2")
def invoice_volume(spark, sf_dir):
    return analytics.monthly(views.invoices(spark, sf_dir), "status").drop("spend")


@query(f"WITH {INVOICES_SQL} SELECT vendor_name, CAST(sum(grand_total) AS DOUBLE) AS spend FROM inv GROUP BY 1 ORDER BY spend DESC, vendor_name LIMIT 10")
def top10_vendors(spark, sf_dir):
    return analytics.top_by_spend(views.invoices(spark, sf_dir), "vendor_name").withColumn("spend", F.col("spend").cast("double"))


@query("""WITH l AS (SELECT l_suppkey % 10 AS vendor, l_partkey % 50 AS product, CAST(l_shipdate AS DATE) AS day, round(l_extendedprice) / l_quantity AS price, l_orderkey, l_linenumber FROM lineitem),
d AS (SELECT vendor, product, day, sum(price) AS s, count(price) AS n FROM l GROUP BY ALL),
r AS (SELECT vendor, product, day, sum(s) OVER w / sum(n) OVER w AS avg_price FROM d WINDOW w AS (PARTITION BY vendor, product ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT vendor, product, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (price / avg_price - 1 > 0.15) AS BIGINT) AS alerts, round(max(price / avg_price - 1), 6) AS worst FROM l JOIN r USING (vendor, product, day) GROUP BY 1, 2""")
def price_deviation(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("vendor", F.col("vendor") % 10).withColumn("product", F.col("product") % 50)
    return analytics.price_deviation(rows).groupBy("vendor", "product").agg(F.count("*").alias("lines"), F.count_if("alert").alias("alerts"), F.round(F.max("deviation"), 6).alias("worst"))


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, l AS (SELECT invoice_id, count(*) AS n FROM it GROUP BY 1)
SELECT vendor_name, round(avg(CAST(grand_total AS DOUBLE)), 6) AS avg_value, round(avg(coalesce(n, 0)), 6) AS avg_lines, CAST(count(*) AS BIGINT) AS invoices, CAST(sum(grand_total) AS DOUBLE) AS spend, CAST(count(DISTINCT date_trunc('month', invoice_date)) AS BIGINT) AS active_months
FROM inv LEFT JOIN l ON l.invoice_id = inv.id GROUP BY 1""")
def vendor_profile(spark, sf_dir):
    rows = analytics.vendor_profile(views.invoices(spark, sf_dir).withColumn("v", F.col("grand_total").cast("double")), views.items(spark, sf_dir))
    return rows.select("vendor_name", F.round((F.col("spend") / F.col("invoices")).cast("double"), 6).alias("avg_value"), F.round("avg_lines", 6).alias("avg_lines"), "invoices", F.col("spend").cast("double").alias("spend"), "active_months")


@query(f"""WITH {INVOICES_SQL}, q AS (SELECT vendor_name, CAST(date_trunc('quarter', invoice_date) AS DATE) AS quarter, CAST(sum(grand_total) AS DOUBLE) AS spend FROM inv GROUP BY 1, 2)
SELECT q.vendor_name, q.quarter, q.spend, round(q.spend / b.spend - 1, 9) AS change FROM q LEFT JOIN q b ON b.vendor_name = q.vendor_name AND CAST(b.quarter + INTERVAL 3 MONTH AS DATE) = q.quarter""")
def spend_qoq(spark, sf_dir):
    rows = views.invoices(spark, sf_dir).withColumn("grand_total", F.col("grand_total"))
    out = analytics.quarter_change(rows, "vendor_name")
    return out.select("vendor_name", "quarter", F.col("spend").cast("double").alias("spend"), F.round(F.col("spend").cast("double") / F.col("before").cast("double") - 1, 9).alias("change"))


@query("""WITH l AS (SELECT l_partkey AS product, CAST(l_shipdate AS DATE) AS day, round(l_extendedprice) / l_quantity AS price FROM lineitem)
SELECT product, round(arg_min(price, (day, price)), 9) AS first_price, round(arg_max(price, (day, -price)), 9) AS last_price FROM l GROUP BY product""")
def product_price_change(spark, sf_dir):
    return analytics.price_change(_lines(spark, sf_dir)).select("product", F.round("first_price", 9).alias("first_price"), F.round("last_price", 9).alias("last_price"))


@query(f"""WITH {LOGS_SQL} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (status = 'FAILURE') AS BIGINT) AS bad,
  round(count(*) FILTER (status = 'FAILURE') / count(*), 9) AS rate, count(*) FILTER (status = 'FAILURE') / count(*) > 0.05 AS alert FROM logs GROUP BY date_trunc('hour', created_at)""")
def failure_rate_alerts(spark, sf_dir):
    rows = analytics.rate_by_window(views.logs(spark, sf_dir), F.col("status") == "FAILURE")
    return rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).withColumn("rate", F.round("rate", 9))


@query("""WITH r AS (SELECT o_orderkey % 3 AS c, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) / 100000 AS rate FROM orders WHERE o_orderkey % 10 = 0 GROUP BY 1, 2),
i AS (SELECT o_orderkey, o_orderkey % 3 AS c, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(14,2)) AS total FROM orders)
SELECT i.o_orderkey, round(CAST(i.total AS DOUBLE) * r.rate, 4) AS amount_base FROM i ASOF LEFT JOIN r ON i.c = r.c AND i.day >= r.day""")
def currency_conversion(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").withColumn("currency", F.col("o_orderkey") % 3).withColumn("invoice_date", F.col("o_orderdate").cast("date")).withColumn("grand_total", F.col("o_totalprice").cast("decimal(14,2)"))
    rates = o.where("o_orderkey % 10 = 0").groupBy("currency", F.col("invoice_date").alias("day")).agg((F.max("o_totalprice") / 100000).alias("rate"))
    out = analytics.convert(o.select("o_orderkey", "currency", "invoice_date", "grand_total"), rates)
    return out.select("o_orderkey", F.round("amount_base", 4).alias("amount_base"))


@query(f"WITH {INVOICES_SQL} SELECT CAST(date_trunc('week', due_date) AS DATE) AS week, CAST(sum(grand_total) AS DOUBLE) AS due FROM inv GROUP BY 1")
def cash_flow_by_week(spark, sf_dir):
    return analytics.due_by_week(views.invoices(spark, sf_dir)).withColumn("due", F.col("due").cast("double"))


@query("""WITH l AS (SELECT l_orderkey AS po, l_partkey AS product, sum(l_quantity) AS q, round(sum(l_extendedprice), 2) AS a FROM lineitem GROUP BY 1, 2),
x AS (SELECT po, product, q AS ordered, a AS ordered_amount, CASE WHEN po % 7 <> 0 THEN q - CASE WHEN po % 11 = 0 THEN 1 ELSE 0 END END AS received, CASE WHEN po % 5 <> 0 THEN q END AS billed, CASE WHEN po % 5 <> 0 THEN a + CASE WHEN product % 13 = 0 THEN 1 ELSE 0 END END AS billed_amount FROM l)
SELECT CASE WHEN received IS NULL THEN 'not received' WHEN billed IS NULL THEN 'not billed' WHEN abs(received - ordered) > 0.02 OR abs(billed - received) > 0.02 THEN 'quantity differs' WHEN abs(billed_amount - ordered_amount) > 0.02 THEN 'amount differs' ELSE 'matched' END AS state, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY 1""")
def three_way_match(spark, sf_dir):
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("po_number"), F.col("l_partkey").alias("product")).agg(F.sum("l_quantity").alias("q"), F.round(F.sum("l_extendedprice"), 2).alias("a"))
    one = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    orders = lines.select("po_number", "product", F.col("q").alias("ordered"), F.col("a").alias("ordered_amount"))
    receipts = lines.where("po_number % 7 <> 0").select("po_number", "product", (F.col("q") - one(F.col("po_number") % 11 == 0, 1)).alias("received"))
    billed = lines.where("po_number % 5 <> 0").select("po_number", "product", F.col("q").alias("billed"), (F.col("a") + one(F.col("product") % 13 == 0, 1)).alias("billed_amount"))
    return analytics.three_way_match(orders, receipts, billed).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey * 7919 AS VARCHAR), 12, '0') AS code FROM part), d AS (SELECT *, list_transform(range(1, 13), lambda i: CAST(substr(code, i, 1) AS INTEGER)) AS x FROM c)
SELECT p_partkey, (10 - ((x[1] + x[3] + x[5] + x[7] + x[9] + x[11]) * 3 + x[2] + x[4] + x[6] + x[8] + x[10]) % 10) % 10 = x[12] AS valid FROM d""")
def upc_check(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 7919).cast("string"), 12, "0")
    return views.table(spark, sf_dir, "part").select("p_partkey", analytics.upc_valid(code).alias("valid"))


@query("SELECT CASE WHEN a <= 90 THEN 'hot' WHEN a <= 365 THEN 'warm' WHEN a <= 2555 THEN 'cold' ELSE 'expired' END AS tier, CAST(count(*) AS BIGINT) AS n FROM (SELECT date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS a FROM orders) GROUP BY 1")
def storage_tiers(spark, sf_dir):
    tier = analytics.storage_tier(F.col("o_orderdate").cast("date"), F.lit("1999-01-01").cast("date"))
    return views.table(spark, sf_dir, "orders").groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query(f"""WITH {LOGS_SQL} SELECT CAST(created_at AS DATE) AS day, CAST(sum(CAST(json_extract_string(payload, '$.total_tokens') AS BIGINT)) AS BIGINT) AS tokens, round(sum(CAST(json_extract_string(payload, '$.estimated_cost_usd') AS DOUBLE)), 9) AS cost
FROM logs WHERE stage = 'AI_STRUCTURING' GROUP BY 1""")
def daily_cost(spark, sf_dir):
    calls = views.logs(spark, sf_dir).where("stage = 'AI_STRUCTURING'")
    read = lambda p, k: F.get_json_object("payload", p).try_cast(k)
    return calls.groupBy(F.col("created_at").cast("date").alias("day")).agg(F.sum(read("$.total_tokens", "bigint")).alias("tokens"), F.round(F.sum(read("$.estimated_cost_usd", "double")), 9).alias("cost"))


@query(f"""WITH {DOCUMENTS_SQL} SELECT CAST(date_trunc('week', created_at) AS DATE) AS week, source_type, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (status = 'REVIEW_REQUIRED') / count(*), 9) AS rate
FROM docs WHERE status IN ('COMPLETED', 'REVIEW_REQUIRED') GROUP BY 1, 2""")
def review_rate_weekly(spark, sf_dir):
    return analytics.review_rate_by_week(views.documents(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query(f"WITH {DOCUMENTS_SQL}, {INVOICES_SQL} SELECT vendor_name, round(CAST(sum(ms) AS DOUBLE) * 1000 / count(*) / 1000, 6) AS avg_ms FROM inv JOIN docs ON docs.id = inv.document_id GROUP BY 1")
def vendor_cycle_time(spark, sf_dir):
    return analytics.vendor_cycle_time(views.documents(spark, sf_dir), views.invoices(spark, sf_dir)).withColumn("avg_ms", F.round("avg_ms", 6))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') LIKE '%7%' THEN '{\"k\": ' || json_extract_string(props, '$.k') || '}' END AS pruned FROM events")
def json_prune(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", prune(F.col("props"), "7").alias("pruned"))
