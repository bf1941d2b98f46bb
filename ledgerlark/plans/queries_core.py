"""Queries over the built operators: read models, normalisation, rules, scoring, intake, vendors, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CURRENCIES, CURRENCY_SYMBOLS, MODEL_PRICES
from ..functions import numbers, text
from ..operators import exports, intake, ocr, persistence, readmodels, rules, vendors
from ..operators.confidence import composite
from ..operators.normalization import normalize_invoices
from . import views
from .views import CHECKS_SQL, DOCUMENTS_SQL, INVOICES_SQL, ITEMS_SQL, LOGS_SQL, SILVER_SQL, VENDORS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_invoices(views.extracted(spark, sf_dir), ("document_id", "ord", "ocr_confidence"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.validate(_silver(spark, sf_dir))


_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_HISTORY = f"""{DOCUMENTS_SQL}, {INVOICES_SQL}, hist AS (SELECT d.id AS document_id, i.id AS invoice_id, d.filename, d.status, i.vendor_name, i.invoice_number, i.invoice_date,
  CAST(i.grand_total AS DOUBLE) AS grand_total, i.currency, CAST(i.composite_confidence AS DOUBLE) AS composite_confidence, d.source_type, {_STAMP.format("d.created_at")} AS created_at
  FROM docs d LEFT JOIN inv i ON i.document_id = d.id)"""


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", _stamp("created_at"))


def _history(spark: SparkSession, sf_dir: str, **kwargs) -> DataFrame:
    return readmodels.history(views.documents(spark, sf_dir), views.invoices(spark, sf_dir), **kwargs)


@query(f"WITH {_HISTORY} SELECT * FROM hist")
def history_left_join(spark, sf_dir):
    return _shown(_history(spark, sf_dir))


@query(f"WITH {_HISTORY} SELECT * FROM hist WHERE filename ILIKE '%vendor 1%' OR invoice_number ILIKE '%vendor 1%' OR vendor_name ILIKE '%vendor 1%'")
def history_search(spark, sf_dir):
    return _shown(_history(spark, sf_dir, search=" VENDOR 1 "))


@query(f"WITH {_HISTORY} SELECT * FROM hist WHERE status = 'FAILED'")
def history_status_filter(spark, sf_dir):
    return _shown(_history(spark, sf_dir, status="FAILED"))


@query(f"WITH {_HISTORY} SELECT * FROM hist ORDER BY grand_total DESC NULLS FIRST, document_id DESC LIMIT 20 OFFSET 20")
def history_page_sorted(spark, sf_dir):
    return _shown(readmodels.history_page(_history(spark, sf_dir), "grand_total", True, page=2))


@query(f"WITH {_HISTORY} SELECT * FROM hist ORDER BY vendor_name ASC NULLS LAST, document_id DESC LIMIT 15")
def history_page_by_vendor(spark, sf_dir):
    sort, descending = readmodels.PRESETS["vendor"]
    return _shown(readmodels.history_page(_history(spark, sf_dir), sort, descending, size=15))


@query(f"WITH {_HISTORY} SELECT CAST(count(*) AS BIGINT) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS pages FROM hist")
def history_total(spark, sf_dir):
    rows = _history(spark, sf_dir)
    return rows.agg(F.count("*").alias("total")).withColumn("pages", readmodels.total_pages(F.col("total"), 20).cast("long"))


@query(f"WITH {_HISTORY} SELECT document_id, CASE WHEN invoice_id IS NOT NULL THEN '/invoices/' || invoice_id ELSE '/documents/' || document_id END AS path FROM hist")
def history_destination(spark, sf_dir):
    return _history(spark, sf_dir).select("document_id", readmodels.destination(F.col("invoice_id"), F.col("document_id")).alias("path"))


@query(f"WITH {DOCUMENTS_SQL} SELECT status, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY status")
def status_breakdown(spark, sf_dir):
    return readmodels.status_breakdown(views.documents(spark, sf_dir))


@query(f"WITH {INVOICES_SQL} SELECT round(avg(CAST(composite_confidence AS DOUBLE)), 9) AS avg_confidence FROM inv")
def avg_confidence(spark, sf_dir):
    return readmodels.average_confidence(views.invoices(spark, sf_dir)).select(F.round("avg_confidence", 9).alias("avg_confidence"))


@query(f"WITH {DOCUMENTS_SQL} SELECT round(avg(CAST(ms AS DOUBLE)), 6) AS avg_processing_ms FROM docs WHERE status IN ('COMPLETED', 'REVIEW_REQUIRED', 'FAILED')")
def avg_processing_ms(spark, sf_dir):
    return readmodels.average_processing_ms(views.documents(spark, sf_dir)).select(F.round("avg_processing_ms", 6).alias("avg_processing_ms"))


_USAGE = """SELECT CAST(coalesce(sum(CAST(json_extract_string(payload, '$.total_tokens') AS BIGINT)), 0) AS BIGINT) AS total_tokens,
  round(coalesce(sum(CAST(json_extract_string(payload, '$.estimated_cost_usd') AS DOUBLE)), 0), 6) AS total_cost FROM logs WHERE stage = 'AI_STRUCTURING' AND payload IS NOT NULL"""


@query(f"WITH {LOGS_SQL} {_USAGE}")
def usage_totals_json(spark, sf_dir):
    return readmodels.usage_totals(views.logs(spark, sf_dir)).withColumn("total_cost", F.round("total_cost", 6))


@query(f"""WITH {DOCUMENTS_SQL}, {INVOICES_SQL}, {LOGS_SQL}, u AS ({_USAGE}),
d AS (SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'REVIEW_REQUIRED') AS review_required, count(*) FILTER (status = 'FAILED') AS failed,
  avg(CAST(ms AS DOUBLE)) FILTER (status IN ('COMPLETED', 'REVIEW_REQUIRED', 'FAILED')) AS ms FROM docs)
SELECT total, completed, review_required, failed, total - completed - review_required - failed AS in_progress, completed / nullif(completed + review_required + failed, 0) AS success_rate,
  (SELECT round(avg(CAST(composite_confidence AS DOUBLE)), 9) FROM inv) AS avg_confidence, round(ms, 6) AS avg_processing_ms, total_tokens, total_cost FROM d CROSS JOIN u""")
def dashboard_kpis(spark, sf_dir):
    row = readmodels.dashboard(views.documents(spark, sf_dir), views.invoices(spark, sf_dir), views.logs(spark, sf_dir))
    return row.withColumn("avg_confidence", F.round("avg_confidence", 9)).withColumn("avg_processing_ms", F.round("avg_processing_ms", 6))


@query(f"WITH {_HISTORY} SELECT * FROM hist ORDER BY created_at DESC NULLS FIRST, document_id DESC LIMIT 8")
def recent_topk(spark, sf_dir):
    return _shown(readmodels.history_page(_history(spark, sf_dir), size=8))


@query(f"""WITH {_HISTORY}, r AS (SELECT * FROM hist WHERE composite_confidence IS NOT NULL ORDER BY created_at DESC NULLS FIRST, document_id DESC LIMIT 10)
SELECT document_id, CASE WHEN length(coalesce(invoice_number, filename)) > 14 THEN left(coalesce(invoice_number, filename), 12) || '…' ELSE coalesce(invoice_number, filename) END AS label,
  CAST(floor(composite_confidence * 100 + 0.5) AS INTEGER) AS percent, CASE WHEN composite_confidence >= 0.85 THEN 'success' WHEN composite_confidence >= 0.6 THEN 'warning' ELSE 'danger' END AS band,
  CAST(row_number() OVER (ORDER BY created_at, document_id) AS INTEGER) AS place FROM r""")
def confidence_chart(spark, sf_dir):
    return readmodels.chart_rows(_history(spark, sf_dir))


@query(f"""WITH {INVOICES_SQL} SELECT coalesce(CASE WHEN composite_confidence >= 0.85 THEN 'success' WHEN composite_confidence >= 0.6 THEN 'warning' WHEN composite_confidence IS NOT NULL THEN 'danger' END, 'none') AS band,
  CAST(count(*) AS BIGINT) AS n FROM inv GROUP BY 1""")
def confidence_bands(spark, sf_dir):
    band = readmodels.confidence_band(F.col("composite_confidence").cast("double"))
    return views.invoices(spark, sf_dir).groupBy(F.coalesce(band, F.lit("none")).alias("band")).agg(F.count("*").alias("n"))


@query(f"""WITH {DOCUMENTS_SQL}, {INVOICES_SQL}, {LOGS_SQL},
f AS (SELECT document_id, stage, message, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS r FROM logs WHERE status = 'FAILURE'),
s AS (SELECT document_id, count(*) AS n_stages, string_agg(stage, '>' ORDER BY created_at, id) AS path FROM logs GROUP BY document_id)
SELECT d.id AS document_id, d.status, d.status IN ('COMPLETED', 'REVIEW_REQUIRED', 'FAILED') AS is_terminal, i.id AS invoice_id, f.stage AS failed_stage, CAST(coalesce(n_stages, 0) AS BIGINT) AS n_stages, path
FROM docs d LEFT JOIN inv i ON i.document_id = d.id LEFT JOIN f ON f.document_id = d.id AND f.r = 1 LEFT JOIN s ON s.document_id = d.id""")
def document_status(spark, sf_dir):
    rows = readmodels.document_status(views.documents(spark, sf_dir), views.invoices(spark, sf_dir), views.logs(spark, sf_dir))
    n = F.coalesce(F.size("stages"), F.lit(0))
    return rows.select("document_id", "status", "is_terminal", "invoice_id", F.col("error.stage").alias("failed_stage"), F.when(n < 0, 0).otherwise(n).cast("long").alias("n_stages"), F.array_join("stages.stage", ">").alias("path"))


@query(f"""WITH {LOGS_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS r FROM logs WHERE status = 'FAILURE')
SELECT document_id, stage, message, payload, {_STAMP.format("created_at")} AS created_at FROM f WHERE r = 1""")
def first_failure(spark, sf_dir):
    return _shown(readmodels.first_failure(views.logs(spark, sf_dir)))


@query(f"""WITH {LOGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY created_at DESC, id DESC) AS r FROM logs WHERE payload IS NOT NULL AND payload <> '{{}}')
SELECT document_id, stage, payload FROM p WHERE r = 1""")
def latest_payload_per_stage(spark, sf_dir):
    return readmodels.latest_payloads(views.logs(spark, sf_dir))


@query(f"""WITH {LOGS_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY created_at DESC, id DESC) AS r FROM logs WHERE duration_ms IS NOT NULL)
SELECT document_id, stage, duration_ms FROM p WHERE r = 1""")
def stage_durations(spark, sf_dir):
    return readmodels.stage_durations(views.logs(spark, sf_dir))


@query(f"""WITH {DOCUMENTS_SQL}, {LOGS_SQL}, st(stage) AS (VALUES ('UPLOAD'), ('TEXT_EXTRACTION'), ('AI_STRUCTURING'), ('VALIDATION'), ('PERSISTENCE')),
f AS (SELECT document_id, min_by(stage, (created_at, id)) AS failed FROM logs WHERE status = 'FAILURE' GROUP BY document_id),
ok AS (SELECT DISTINCT document_id, stage FROM logs WHERE status = 'SUCCESS')
SELECT d.id AS document_id, st.stage, CASE WHEN st.stage = f.failed THEN 'failed' WHEN ok.stage IS NOT NULL THEN 'done' WHEN f.failed IS NOT NULL THEN 'pending'
  WHEN d.status = 'AI_PROCESSING' AND st.stage = 'AI_STRUCTURING' THEN 'active' ELSE 'pending' END AS state
FROM docs d CROSS JOIN st LEFT JOIN f ON f.document_id = d.id LEFT JOIN ok ON ok.document_id = d.id AND ok.stage = st.stage""")
def stage_step_states(spark, sf_dir):
    docs, logs = views.documents(spark, sf_dir), views.logs(spark, sf_dir)
    done = logs.where("status = 'SUCCESS'").groupBy("document_id").agg(F.collect_set("stage").alias("done"))
    failed = readmodels.first_failure(logs).select("document_id", F.col("stage").alias("failed_stage"))
    rows = docs.select(F.col("id").alias("document_id"), "status", F.col("status").isin("COMPLETED", "REVIEW_REQUIRED", "FAILED").alias("is_terminal"))
    return readmodels.step_states(rows.join(done, "document_id", "left").join(failed, "document_id", "left"))


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, {VENDORS_SQL}, {LOGS_SQL},
l AS (SELECT invoice_id, count(*) AS n, sum(line_total) AS lines FROM it GROUP BY 1), g AS (SELECT document_id, count(*) AS n, sum(coalesce(duration_ms, 0)) AS ms FROM logs GROUP BY 1)
SELECT inv.id AS invoice_id, inv.document_id, ven.name AS vendor, CAST(coalesce(l.n, 0) AS BIGINT) AS items_saved, CAST(l.lines AS DOUBLE) AS lines_total, CAST(coalesce(g.n, 0) AS BIGINT) AS logs_saved, CAST(coalesce(g.ms, 0) AS BIGINT) AS total_duration_ms
FROM inv LEFT JOIN ven ON ven.id = inv.vendor_id LEFT JOIN l ON l.invoice_id = inv.id LEFT JOIN g ON g.document_id = inv.document_id""")
def invoice_detail_flat(spark, sf_dir):
    rows = _detail(spark, sf_dir)
    total = F.aggregate("items", F.lit(0).cast("decimal(20,2)"), lambda a, i: (a + i["line_total"]).cast("decimal(20,2)"))
    return rows.select(F.col("id").alias("invoice_id"), "document_id", F.col("vendor.name").alias("vendor"), "items_saved", total.cast("double").alias("lines_total"), "logs_saved", F.col("total_duration_ms").cast("long").alias("total_duration_ms"))


def _detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readmodels.invoice_detail(views.invoices(spark, sf_dir), views.items(spark, sf_dir), views.vendors(spark, sf_dir), views.logs(spark, sf_dir))


# ---- normalisation ----


@query("""SELECT p_partkey, CAST(CAST(CAST(p_retailprice AS VARCHAR) AS DECIMAL(18,2)) AS VARCHAR) AS money, CAST(CAST(CAST(p_retailprice / 8 AS VARCHAR) AS DECIMAL(18,4)) AS VARCHAR) AS rate FROM part""")
def normalize_money(spark, sf_dir):
    p = F.col("p_retailprice")
    return views.table(spark, sf_dir, "part").select("p_partkey", numbers.to_decimal(p, 2).cast("string").alias("money"), numbers.to_decimal(p / 8, 4).cast("string").alias("rate"))


@query("""SELECT c_custkey, nullif(regexp_replace(CASE c_custkey % 4 WHEN 0 THEN ' ' || chr(9) || c_name || chr(160) WHEN 1 THEN chr(28) || '  ' WHEN 2 THEN c_name ELSE NULL END,
  '^[ \\t\\x{00A0}\\x{001C}]+|[ \\t\\x{00A0}\\x{001C}]+$', '', 'g'), '') AS cleaned FROM customer""")
def normalize_text(spark, sf_dir):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.concat(F.lit(" \t"), F.col("c_name"), F.lit(" "))).when(k == 1, "\x1c  ").when(k == 2, F.col("c_name"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", text.clean_text(raw).alias("cleaned"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (0, 1, 5) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 6 = 2 THEN CAST(date_trunc('week', o_orderdate) AS DATE) END AS parsed FROM orders""")
def normalize_iso_date(spark, sf_dir):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 6
    year = F.year(F.date_add(F.date_trunc("week", d).cast("date"), 3))
    week = F.format_string("%04d-W%02d", year, F.weekofyear(d))
    forms = F.when(k == 0, d.cast("string")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, week).when(k == 3, F.date_format(d, "dd/MM/yyyy")).when(k == 4, F.concat(d.cast("string"), F.lit("T00:00")))
    day = F.concat(F.replace(week, F.lit("-"), F.lit("")), (F.weekday(d) + 1).cast("string"))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", text.parse_iso_date(F.coalesce(forms, day)).alias("parsed"))


_SYMBOL = " ".join(f"WHEN '{s}' THEN '{c}'" for s, c in CURRENCY_SYMBOLS.items())


@query(f"""WITH r AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' WHEN 2 THEN '€' WHEN 3 THEN '₹' WHEN 4 THEN 'ZZZ' WHEN 5 THEN 'C$' END AS raw FROM customer),
c AS (SELECT c_custkey, CASE raw {_SYMBOL} ELSE upper(raw) END AS code FROM r)
SELECT c_custkey, code, CASE WHEN code IN {CURRENCIES} THEN 'PASSED' ELSE 'WARNING' END AS status FROM c""")
def normalize_currency(spark, sf_dir):
    k = F.col("c_custkey") % 7
    raw = F.when(k == 0, "usd").when(k == 1, " EUR ").when(k == 2, "€").when(k == 3, "₹").when(k == 4, "ZZZ").when(k == 5, "C$")
    rows = views.table(spark, sf_dir, "customer").select("c_custkey", text.currency_code(raw).alias("code"))
    return rows.withColumn("status", F.when(text.known_currency(F.col("code")), "PASSED").otherwise("WARNING"))


@query(f"WITH {SILVER_SQL} SELECT CAST(k AS VARCHAR) AS document_id, i AS sort_order, CAST(q AS VARCHAR) AS quantity, CAST(p AS VARCHAR) AS unit_price, CAST(t AS VARCHAR) AS line_total, pd AS unit_price_derived, td AS line_total_derived FROM si")
def reconcile_line_items(spark, sf_dir):
    each = _silver(spark, sf_dir).select("document_id", F.explode("line_items").alias("i"))
    text_ = lambda f: F.col(f"i.{f}").cast("string").alias(f)
    return each.select("document_id", "i.sort_order", text_("quantity"), text_("unit_price"), text_("line_total"), "i.unit_price_derived", "i.line_total_derived")


@query(f"WITH {SILVER_SQL} SELECT document_id, vendor_name, vendor_tax_id, invoice_number, invoice_date, due_date, currency, purchase_order, subtotal, tax AS tax_amount, discount AS discount_amount, grand_total, CAST(n_items AS INTEGER) AS n_items, round(ai, 9) AS ai_confidence FROM sh")
def normalize_headers(spark, sf_dir):
    money = [F.col(c).alias(c) for c in ("subtotal", "tax_amount", "discount_amount", "grand_total")]
    return _silver(spark, sf_dir).select("document_id", "vendor_name", "vendor_tax_id", "invoice_number", "invoice_date", "due_date", "currency", "purchase_order", *money, F.size("line_items").alias("n_items"), F.round("ai_confidence", 9).alias("ai_confidence"))


# ---- rules ----


def _checks(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    silver = _silver(spark, sf_dir)
    rows = rules.checks_named(silver, names, "document_id") if names else rules.checks_long(rules.with_checks(silver), "document_id")
    return rows.select("document_id", "name", "status", "field")


def _checks_sql(*names: str) -> str:
    where = f" WHERE name IN ({', '.join(repr(n) for n in names)})" if names else ""
    return f"WITH {CHECKS_SQL} SELECT CAST(k AS VARCHAR) AS document_id, name, status, field FROM ck{where}"


RULES = {
    "checks_long": (),
    "check_required_fields": ("VENDOR_NAME_PRESENT", "INVOICE_NUMBER_PRESENT", "GRAND_TOTAL_PRESENT", "LINE_ITEMS_PRESENT", "PURCHASE_ORDER_PRESENT"),
    "check_invoice_date": ("INVOICE_DATE_VALID",),
    "check_currency": ("CURRENCY_VALID",),
    "check_derivations": ("UNIT_PRICE_DERIVED", "LINE_TOTAL_DERIVED"),
    "check_line_item_math": ("LINE_ITEM_MATH",),
    "check_subtotal": ("SUBTOTAL_MATCHES_ITEMS",),
    "check_grand_total": ("GRAND_TOTAL_MATH",),
    "check_tax_consistent": ("TAX_CONSISTENT",),
    "check_date_order": ("DATE_ORDER",),
}
for _name, _rules in RULES.items():
    QUERIES[_name] = lambda spark, sf_dir, _rules=_rules: _checks(spark, sf_dir, *_rules)
    ORACLE[_name] = _checks_sql(*_rules)


@query(f"WITH {CHECKS_SQL} SELECT document_id, CAST(n_passed AS INTEGER) AS passed, CAST(n_failed AS INTEGER) AS failed, CAST(n_warning AS INTEGER) AS warnings, CAST(n_skipped AS INTEGER) AS skipped, round(ratio, 9) AS validation_score FROM sc")
def validation_score(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("document_id", F.col("n_passed").alias("passed"), F.col("n_failed").alias("failed"), F.col("n_warning").alias("warnings"), F.col("n_skipped").alias("skipped"), F.round("validation_score", 9).alias("validation_score"))


@query(f"WITH {CHECKS_SQL} SELECT document_id, composite FROM sc")
def composite_confidence(spark, sf_dir):
    return rules.decide(_silver(spark, sf_dir)).select("document_id", F.col("confidence.composite").alias("composite"))


@query(f"""WITH {CHECKS_SQL} SELECT document_id, CAST(n_passed AS INTEGER) AS passed, CAST(n_failed AS INTEGER) AS failed, CAST(n_warning AS INTEGER) AS warnings, CAST(n_skipped AS INTEGER) AS skipped,
  round(ratio, 9) AS validation_score, composite, CASE WHEN n_failed = 0 AND composite >= 0.85 THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS decision FROM sc""")
def quality_gate(spark, sf_dir):
    v = rules.decide(_silver(spark, sf_dir))
    return v.select(
        "document_id", F.col("n_passed").alias("passed"), F.col("n_failed").alias("failed"), F.col("n_warning").alias("warnings"), F.col("n_skipped").alias("skipped"), F.round("validation_score", 9).alias("validation_score"), F.col("confidence.composite").alias("composite"), "decision"
    )


@query(f"WITH {CHECKS_SQL} SELECT document_id, CAST(n_failed + CASE WHEN composite < 0.85 THEN 1 ELSE 0 END AS INTEGER) AS reasons, CASE WHEN composite < 0.85 THEN 'Composite confidence ' || printf('%.4f', composite) || ' is below the 0.85 review threshold.' END AS low FROM sc")
def review_reasons(spark, sf_dir):
    low = F.filter("review_reasons", lambda r: r.startswith("Composite confidence"))
    return _validated(spark, sf_dir).select("document_id", F.size("review_reasons").alias("reasons"), F.get(low, F.lit(0)).alias("low"))


@query("""WITH s AS (SELECT d.doc_id, l.quality, l.toxic, (d.n_chars % 101) / 100.0 AS ocr, CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id % 77) / 77.0 END AS ai, (d.doc_id % 10) / 10.0 AS v FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, (0.3::DOUBLE * ocr + coalesce(0.4::DOUBLE * ai, 0) + 0.3::DOUBLE * v) / (0.3::DOUBLE + CASE WHEN ai IS NULL THEN 0::DOUBLE ELSE 0.4::DOUBLE END + 0.3::DOUBLE) AS x FROM s)
SELECT doc_id, """ + views.r4("x") + """ AS composite, CASE WHEN ai IS NULL THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS ocr_weight FROM r""")
def confidence_renormalized(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id", "left")
    score = composite((F.col("n_chars") % 101) / 100, F.when(F.col("quality").isNotNull(), (F.col("doc_id") % 77) / 77), (F.col("doc_id") % 10) / 10)
    return docs.withColumn("c", score).select("doc_id", F.col("c.composite").alias("composite"), F.col("c.weights.ocr").alias("ocr_weight"))


# ---- persistence ----


@query(f"""WITH {CHECKS_SQL} SELECT document_id, coalesce(currency, 'USD') AS currency, CAST(coalesce(discount, 0) AS DOUBLE) AS discount_amount, CASE WHEN n_failed = 0 AND composite >= 0.85 THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS status,
  vendor_name IS NOT NULL AS has_vendor, CAST(composite AS DOUBLE) AS composite_confidence FROM sc""")
def persist_defaults(spark, sf_dir):
    rows = persistence.invoice_rows(rules.decide(_silver(spark, sf_dir)))
    return rows.select("document_id", "currency", F.col("discount_amount").cast("double").alias("discount_amount"), "status", F.col("vendor_id").isNotNull().alias("has_vendor"), F.col("composite_confidence").cast("double").alias("composite_confidence"))


@query(f"WITH {SILVER_SQL} SELECT CAST(count(*) AS BIGINT) AS items, CAST(sum(coalesce(t, 0)) AS DOUBLE) AS total, CAST(sum(coalesce(p, 0)) AS DOUBLE) AS prices, CAST(count(*) FILTER (p IS NULL) AS BIGINT) AS defaulted FROM si")
def persist_items(spark, sf_dir):
    rows = persistence.item_rows(_validated(spark, sf_dir))
    return rows.agg(F.count("*").alias("items"), F.sum("line_total").cast("double").alias("total"), F.sum("unit_price").cast("double").alias("prices"), F.count_if(F.col("unit_price") == 0).alias("defaulted"))


@query(f"""WITH {SILVER_SQL}, v AS (SELECT *, CASE WHEN vendor_tax_id IS NOT NULL THEN 'T:' || vendor_tax_id ELSE 'N:' || vendor_name END AS vendor_key FROM sh WHERE vendor_name IS NOT NULL)
SELECT vendor_key, min_by(vendor_name, k) AS name, min(vendor_tax_id) AS tax_id, min_by(vendor_address, k) FILTER (vendor_address IS NOT NULL) AS address, min_by(vendor_email, k) FILTER (vendor_email IS NOT NULL) AS email, CAST(count(*) AS BIGINT) AS invoices FROM v GROUP BY vendor_key""")
def vendor_upsert(spark, sf_dir):
    return vendors.upsert(_silver(spark, sf_dir)).select("vendor_key", "name", "tax_id", "address", "email", "invoices")


@query(f"""WITH {SILVER_SQL}, v AS (SELECT *, CASE WHEN vendor_name IS NULL THEN NULL WHEN vendor_tax_id IS NOT NULL THEN 'T:' || vendor_tax_id ELSE 'N:' || vendor_name END AS vendor_key FROM sh)
SELECT document_id, vendor_key, vendor_key IS NOT NULL AND row_number() OVER (PARTITION BY vendor_key ORDER BY k) = 1 AS vendor_created FROM v""")
def vendor_created(spark, sf_dir):
    return vendors.new_vendor_rows(_silver(spark, sf_dir)).select("document_id", "vendor_key", "vendor_created")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'ERR_UNSUPPORTED_FORMAT' WHEN n_chars < 1024 THEN 'ERR_EMPTY_FILE' END AS error_code FROM documents""")
def upload_gate(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 9 == 0, "text/html; charset=utf-8").otherwise(" Application/PDF ; q=1")
    rows = views.table(spark, sf_dir, "documents").select("doc_id", kind.alias("content_type"), F.col("n_chars").alias("file_size_bytes"))
    return intake.gate(rows).select("doc_id", "error_code")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("file_hash"), F.col("doc_id").alias("ord"))


@query("WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) SELECT doc_id AS document_id FROM h WHERE doc_id = first")
def dedup_first_by_hash(spark, sf_dir):
    return intake.first_by_hash(_uploads(spark, sf_dir)).where("duplicate_of is null").select("document_id")


@query("WITH h AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents) SELECT doc_id AS document_id, first AS duplicate_of FROM h WHERE doc_id <> first")
def duplicate_uploads(spark, sf_dir):
    return intake.first_by_hash(_uploads(spark, sf_dir)).where("duplicate_of is not null").select("document_id", "duplicate_of")


@query("""SELECT doc_id, CAST(length(CASE WHEN length(text) > 24000 THEN left(text, 23965) || chr(10) || chr(10) || '[... document text truncated ...]' ELSE text END) AS INTEGER) AS chars, length(text) > 24000 AS truncated,
  sha256(CASE WHEN length(text) > 24000 THEN left(text, 23965) || chr(10) || chr(10) || '[... document text truncated ...]' ELSE text END) AS digest FROM documents""")
def text_budget(spark, sf_dir):
    fit = views.table(spark, sf_dir, "documents").withColumn("fit", text.fit_budget(F.col("text")))
    return fit.select("doc_id", F.length("fit.text").alias("chars"), "fit.truncated", F.sha2("fit.text", 256).alias("digest"))


_MODELS = [*MODEL_PRICES, "gpt-4o-mini-2024-07-18", "gpt-4.1-2025", "other-model"]


@query(f"""WITH m AS (SELECT event_id, [{', '.join(repr(m) for m in _MODELS)}][CAST(event_id % {len(_MODELS)} AS INTEGER) + 1] AS model, event_id % 5000 AS i, user_id % 900 AS o FROM events)
SELECT event_id, model, CASE WHEN model = 'gpt-4o-mini' THEN i * 0.15::DOUBLE + o * 0.6::DOUBLE WHEN model = 'gpt-4o' THEN i * 2.5::DOUBLE + o * 10::DOUBLE WHEN model = 'gpt-4.1-mini' THEN i * 0.4::DOUBLE + o * 1.6::DOUBLE WHEN model = 'gpt-4.1' THEN i * 2::DOUBLE + o * 8::DOUBLE
  WHEN starts_with(model, 'gpt-4o-mini-') THEN i * 0.15::DOUBLE + o * 0.6::DOUBLE WHEN starts_with(model, 'gpt-4.1-') THEN i * 2::DOUBLE + o * 8::DOUBLE END / 1e6 AS cost FROM m""")
def cost_estimate(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % len(_MODELS) + 1).cast("int"))
    rows = views.table(spark, sf_dir, "events").select("event_id", model.alias("model"), (F.col("event_id") % 5000).alias("i"), (F.col("user_id") % 900).alias("o"))
    return rows.select("event_id", "model", numbers.estimated_cost(F.col("model"), F.col("i"), F.col("o")).alias("cost"))


# ---- exports ----


@query(f"WITH {INVOICES_SQL} SELECT id, 'invoice_' || coalesce(invoice_number, left(id, 8)) || '_items.csv' AS filename FROM inv")
def export_filename(spark, sf_dir):
    return views.invoices(spark, sf_dir).select("id", exports.export_filename(F.col("invoice_number"), F.col("id"), "csv").alias("filename"))


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL} SELECT inv.id AS invoice_id, it.sort_order, it.description AS "Description", CAST(it.l_quantity AS VARCHAR) AS "Quantity", CAST((l_partkey % 1000) AS VARCHAR) || '.0' AS "Unit Price",
  CASE WHEN it.tax_rate IS NULL THEN '' ELSE '5.0' END AS "Tax Rate (%)", coalesce(product_sku, '') AS "UPC" FROM inv JOIN it ON it.invoice_id = inv.id""")
def export_items(spark, sf_dir):
    return exports.csv_rows(_detail(spark, sf_dir)).drop("Line Total")


def _export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = views.documents(spark, sf_dir).select(F.col("id").alias("document_id"), "filename", "source_type")
    return _detail(spark, sf_dir).join(docs, "document_id")


_EXPORTED = f"""WITH {DOCUMENTS_SQL}, {INVOICES_SQL}, {ITEMS_SQL}, {VENDORS_SQL}, ln AS (SELECT invoice_id, list({{'position': sort_order + 1, 'description': description, 'quantity': l_quantity,
  'unit_price': CAST(l_partkey % 1000 AS DOUBLE), 'line_total': l_extendedprice, 'tax_rate': CAST(tax_rate AS DOUBLE), 'sku_upc': product_sku}} ORDER BY sort_order) AS items FROM it GROUP BY 1),
ex AS (SELECT inv.id, document_id, invoice_number, CAST(invoice_date AS VARCHAR) AS invoice_date, CAST(due_date AS VARCHAR) AS due_date, currency, CAST(tax_amount AS DOUBLE) AS tax, CAST(grand_total AS DOUBLE) AS total, inv.status,
  CAST(composite_confidence AS DOUBLE) AS conf, docs.filename, docs.source_type, inv.created_at, coalesce(items, []) AS items, coalesce(ven.name, vendor_name) AS vendor,
  CASE WHEN ven.id IS NULL THEN vendor_tax_id ELSE ven.tax_id END AS tax_id, ven.address FROM inv JOIN docs ON docs.id = inv.document_id LEFT JOIN ven ON ven.id = inv.vendor_id LEFT JOIN ln ON ln.invoice_id = inv.id)"""


# Spark writes numbers below a thousandth with an exponent.
@query(rf"""{_EXPORTED} SELECT id, regexp_replace(CAST(to_json({{'schema_version': '1.0', 'invoice_id': id, 'document_id': document_id,
  'invoice': {{'invoice_number': invoice_number, 'invoice_date': invoice_date, 'due_date': due_date, 'currency': currency, 'totals': {{'subtotal': NULL::DOUBLE, 'tax': tax, 'discount': 0::DOUBLE, 'grand_total': total}}}},
  'vendor': {{'name': vendor, 'tax_id': tax_id, 'address': address, 'phone': NULL::VARCHAR, 'email': NULL::VARCHAR}}, 'line_items': items,
  'validation': {{'status': status, 'review_required': status = 'REVIEW_REQUIRED', 'composite_confidence': conf}},
  'processing': {{'filename': filename, 'source_type': source_type, 'extraction_model': 'gpt-4o-mini', 'processed_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00')}}}}) AS VARCHAR),
  '"composite_confidence":0\.000([1-9])}}', '"composite_confidence":\1.0E-4}}') AS json FROM ex""")
def export_json(spark, sf_dir):
    return _export_rows(spark, sf_dir).select("id", exports.export_json().alias("json"))


def _block(label: str, value: str) -> str:
    return f"'{label}:' || chr(10) || coalesce({value}, '—') || chr(10) || chr(10)"


def _grouped(value: str) -> str:
    return f"format('{{:,.2f}}', {value})"


_RULE = "repeat('-', 48) || chr(10) || chr(10)"
_ITEM_TEXT = " || ".join(["x.position || '.' || chr(10)", _block("Description", "x.description"), _block("Quantity", _grouped("x.quantity")), _block("Unit Price", _grouped("x.unit_price")), _block("Line Total", _grouped("x.line_total"))])
_TEXT = " || ".join(
    [
        "'Vendor' || chr(10) || '------' || chr(10) || coalesce(vendor, '—') || chr(10) || chr(10)",
        *(_block(label, c) for label, c in (("Invoice Number", "invoice_number"), ("Invoice Date", "invoice_date"), ("Due Date", "due_date"), ("Currency", "currency"))),
        f"{_RULE} || 'Items' || chr(10) || chr(10)",
        f"array_to_string(list_transform(items, lambda x: {_ITEM_TEXT}), '')",
        f"{_RULE} || 'Totals' || chr(10) || chr(10)",
        _block("Subtotal", "NULL"),
        _block("Tax", _grouped("tax")),
        _block("Discount", "'0.00'"),
        _block("Grand Total", _grouped("total") + " || ' ' || currency"),
        _RULE,
        _block("Validation Status", "status"),
        _block("Confidence", "printf('%.1f', conf * 100) || '%'"),
        "'Review Required:' || chr(10) || CASE WHEN status = 'REVIEW_REQUIRED' THEN 'Yes' ELSE 'No' END || chr(10)",
    ]
)


@query(f"{_EXPORTED} SELECT id, {_TEXT} AS txt FROM ex")
def export_text(spark, sf_dir):
    return _export_rows(spark, sf_dir).select("id", exports.export_text().alias("txt"))


@query()
def ocr_tokens(spark, sf_dir):
    """The words of each page's HTML as a saved annotation, flattened to tokens."""
    words = F.transform(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+"), lambda w: F.struct(F.array(F.struct(w.alias("text"))).alias("symbols"), F.lit(0.9).alias("confidence"), F.lit(None).cast("struct<vertices:array<struct<x:double,y:double>>>").alias("boundingBox")))
    page = F.array(F.struct(F.array(F.struct(F.array(F.struct(words.alias("words"))).alias("paragraphs"))).alias("blocks")))
    rows = views.table(spark, sf_dir, "pages").select("page_id", F.array(F.struct(F.regexp_replace("html", "<[^>]*>", " ").alias("text"), page.alias("pages"))).alias("annotations"))
    out = ocr.ocr_results(rows)
    return out.select("page_id", F.size("tokens").alias("n_tokens"), F.round("mean_confidence", 6).alias("mean_confidence"), "page_count", F.length("text").alias("chars"))


ORACLE["ocr_tokens"] = r"""WITH p AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS t FROM pages),
w AS (SELECT page_id, t, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) AS n FROM p)
SELECT page_id, CAST(n AS INTEGER) AS n_tokens, CASE WHEN n > 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS mean_confidence, 1 AS page_count, CAST(length(regexp_replace(t, '^[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+|[\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$', '', 'g')) AS INTEGER) AS chars FROM w"""


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 AND regexp_matches(html, '>[^<]*[A-Za-z]') THEN 'digital_pdf' ELSE 'ocr' END AS route FROM pages")
def extraction_route(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "application/pdf").otherwise("application/pdf; q=1")
    return views.table(spark, sf_dir, "pages").select("page_id", ocr.route(kind, F.col("html").rlike(">[^<]*[A-Za-z]")).alias("route"))


def _fixed(x: str, digits: int) -> str:
    """SQL for text.fixed: printf is exact but for ties, which it rounds to even; they are moved up a little."""
    return f"printf('%.{digits}f', {x} + CASE WHEN {x} * {4 * digits} = floor({x} * {4 * digits}) THEN {0.1 ** (digits + 1):.{digits + 1}f} ELSE 0 END)"


@query(f"""SELECT event_id, CASE WHEN value >= 60000 THEN {_fixed("(value / 60000)", 1)} || ' min' WHEN value >= 1000 THEN {_fixed("(value / 1000)", 1)} || ' s' ELSE CAST(CAST(floor(value + 0.5) AS BIGINT) AS VARCHAR) || ' ms' END AS duration,
  CASE WHEN event_id >= 1000000 THEN {_fixed("(event_id / 1000000)", 2)} || 'M' WHEN event_id >= 1000 THEN {_fixed("(event_id / 1000)", 1)} || 'k' ELSE CAST(event_id AS VARCHAR) END AS tokens FROM events""")
def display_formats(spark, sf_dir):
    return views.table(spark, sf_dir, "events").select("event_id", text.duration(F.col("value")).alias("duration"), text.tokens(F.col("event_id")).alias("tokens"))


@query("SELECT CAST(1 AS INTEGER) AS alive")
def liveness(spark, sf_dir):
    return spark.sql("select 1 as alive")
