"""Queries over what is stored, shown and exchanged: files, prompts, responses, log rows, screen texts, exports, reviews."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CHECK_STATUSES
from ..operators import analytics, exports, intake, ocr, persistence, readmodels, rules
from ..operators.normalization import normalize_invoices
from ..sources import files
from ..sources.workspace import workspace
from . import views
from .pipeline import process
from .queries_core import _detail, _fixed, _silver, _uploads
from .views import CHECKS_SQL, DOCUMENTS_SQL, INVOICES_SQL, ITEMS_SQL, LOGS_SQL, SILVER_SQL, VENDORS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _pick(values: tuple[str | None, ...], at):
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


# ---- files, prompts, responses ----


@query(f"""WITH {DOCUMENTS_SQL}, n AS (SELECT *, CASE CAST(id AS BIGINT) % 3 WHEN 0 THEN 'Scan.' || id || '.PDF' WHEN 1 THEN 'scan' || id ELSE filename END AS name FROM docs)
SELECT id, 'store/default/' || strftime(created_at, '%Y/%m') || '/' || id || CASE CAST(id AS BIGINT) % 3 WHEN 1 THEN '.bin' ELSE '.pdf' END AS path FROM n""")
def store_paths(spark, sf_dir):
    k = F.col("id").cast("long") % 3
    name = F.when(k == 0, F.concat(F.lit("Scan."), "id", F.lit(".PDF"))).when(k == 1, F.concat(F.lit("scan"), "id")).otherwise(F.col("filename"))
    return views.documents(spark, sf_dir).select("id", intake.store_path("store", F.lit("default"), F.col("created_at"), F.col("id"), name).alias("path"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars * 4096 END AS size FROM documents)
SELECT doc_id, CASE WHEN size < 1024 THEN 'File is too small (' || size || ' bytes). Minimum is 1024 bytes.' WHEN size > 26214400 THEN 'File size ' || printf('%.1f', size / 1048576) || ' MB exceeds the 25 MB limit.' END AS error_message FROM s""")
def gate_messages(spark, sf_dir):
    size = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(F.col("n_chars") * 4096)
    rows = views.table(spark, sf_dir, "documents").select("doc_id", F.lit("application/pdf").alias("content_type"), size.alias("file_size_bytes"))
    return intake.gate(rows).select("doc_id", "error_message")


_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"""WITH p AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^{_SPACE}|{_SPACE}$', '', 'g')) AS pages FROM documents),
t AS (SELECT doc_id, len(pages) AS n, array_to_string(list_filter(pages, lambda x: x <> ''), chr(10) || chr(10)) AS text, len(list_filter(pages[1:3], lambda x: x <> '')) > 0 AS digital FROM p)
SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS digest, CAST(coalesce(n, 0) AS INTEGER) AS page_count, coalesce(digital, FALSE) AS digital, text IS NULL OR text = '' AS failed FROM t""")
def text_layers(spark, sf_dir):
    """Documents as files whose pages are their lines, through the text layer's reader."""

    def make_reader():
        return lambda content: content.decode("utf-8").split("\n")

    rows = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    out = files.read_text_layers(rows, make_reader)
    return out.select("path", F.sha2("text", 256).alias("digest"), "page_count", "digital", F.col("error").isNotNull().alias("failed"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ' (extraction method: ocr)' WHEN 1 THEN ' (extraction method: digital_pdf)' ELSE '' END AS note, length(text) > 24000 AS truncated,
  CASE WHEN length(text) > 24000 THEN left(text, 23965) || chr(10) || chr(10) || '[... document text truncated ...]' ELSE text END AS body FROM documents)
SELECT doc_id, sha256('Extract structured invoice data from the following document text' || note || '.' || chr(10) || chr(10) || '<document>' || chr(10) || body || chr(10) || '</document>') AS digest, truncated FROM f""")
def prompt_texts(spark, sf_dir):
    rows = views.table(spark, sf_dir, "documents").withColumn("source_type", _pick(("ocr", "digital_pdf", None), F.col("doc_id") % 3))
    return files.prompts(rows).select("doc_id", F.sha2("prompt", 256).alias("digest"), "truncated")


@query("""SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN text IS NOT NULL AND length(text) % 7 <> 0 THEN 'N-' || length(text) END AS invoice_number,
  CASE WHEN text IS NOT NULL AND length(text) % 7 <> 0 THEN CAST(length(text) // 4 AS INTEGER) END AS input_tokens, CASE WHEN text IS NULL THEN 'no prompt' WHEN length(text) % 7 = 0 THEN 'refused' END AS error FROM documents""")
def structured_texts(spark, sf_dir):
    """Calls of a stand-in model that refuses some prompts, and its answers parsed."""

    def make_model():
        def call(system, user):
            if user is None or len(user) % 7 == 0:
                raise ValueError("no prompt" if user is None else "refused")
            return f'{{"invoice_number": "N-{len(user)}"}}', "stand-in", "stop", len(user) // 4, 1

        return call

    texts = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("prompt"))
    answers = files.structure_texts(texts, make_model, "extract")
    return files.parse_extractions(answers).select("document_id", "invoice_number", "input_tokens", "error")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE WHEN o_orderkey % 31 <> 0 THEN ' Vendor ' || (o_custkey % 97) || chr(160) END AS vendor_name, CASE WHEN o_orderkey % 13 <> 0 THEN 'INV-' || o_orderkey END AS invoice_number,
  CAST(coalesce(n, 0) AS INTEGER) AS items, coalesce(q, 0) AS quantity, CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 100) / 100.0::DOUBLE END AS confidence FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def parsed_responses(spark, sf_dir):
    """Extracted records as a model answers them, in JSON, parsed back."""
    bronze = views.extracted(spark, sf_dir)
    raw = bronze.select("document_id", F.to_json(F.struct(*[c for c in bronze.columns if c not in ("document_id", "ord", "ocr_confidence")])).alias("raw"))
    quantity = F.coalesce(F.aggregate("line_items", F.lit(0.0), lambda a, i: a + i["quantity"]), F.lit(0.0))
    return files.parse_extractions(raw).select("document_id", F.col("vendor.name").alias("vendor_name"), "invoice_number", F.coalesce(F.size("line_items"), F.lit(0)).alias("items"), quantity.alias("quantity"), "confidence")


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'HTTP 503' WHEN page_id % 5 = 1 THEN 'empty response' WHEN page_id % 5 = 2 THEN 'bad page ' || page_id END AS error FROM pages""")
def ocr_response_errors(spark, sf_dir):
    k = F.col("page_id") % 5
    one = F.struct(F.struct(F.when(k == 2, F.concat(F.lit("bad page "), F.col("page_id").cast("string"))).alias("message")).alias("error"))
    responses = F.when(k == 1, F.array().cast("array<struct<error:struct<message:string>>>")).otherwise(F.array(one))
    return views.table(spark, sf_dir, "pages").select("page_id", ocr.response_error(F.when(k == 0, 503).otherwise(200), responses).alias("error"))


@query("""WITH p AS (SELECT page_id, least(page_id % 9, 5) AS n FROM pages)
SELECT page_id, CAST(n AS INTEGER) AS page_count, coalesce(array_to_string(list_transform(range(1, n + 1), lambda i: 'Page ' || i), chr(10) || chr(10)), '') AS text FROM p""")
def ocr_page_limit(spark, sf_dir):
    """Annotations of up to eight pages, of which five are read."""
    n = (F.col("page_id") % 9).cast("int")
    pages = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: i <= n)
    found = F.to_json(F.transform(pages, lambda i: F.struct(F.concat(F.lit("  Page "), i.cast("string"), F.lit("\n")).alias("text"))))
    rows = views.table(spark, sf_dir, "pages").select("page_id", found.alias("annotations"))
    return ocr.ocr_results(rows).select("page_id", "page_count", "text")


# ---- checks ----

_PRESENT = """SELECT document_id, '{{"name":"{name}","status":"' || CASE WHEN {good} THEN 'PASSED","field":"{field}"}}' ELSE '{bad}","field":"{field}","message":"{message}"}}' END AS json FROM sh"""
_PRESENCE = (
    ("VENDOR_NAME_PRESENT", "vendor_name IS NOT NULL", "vendor_name", "FAILED", "Vendor name was not found on the document."),
    ("INVOICE_NUMBER_PRESENT", "invoice_number IS NOT NULL", "invoice_number", "FAILED", "Invoice number was not found on the document."),
    ("GRAND_TOTAL_PRESENT", "grand_total IS NOT NULL", "grand_total", "FAILED", "Grand total was not found on the document."),
    ("LINE_ITEMS_PRESENT", "n_items > 0", "line_items", "FAILED", "No line items were extracted."),
    ("PURCHASE_ORDER_PRESENT", "purchase_order IS NOT NULL", "purchase_order", "SKIPPED", "No purchase order on document."),
)
_DATED = """SELECT document_id, CASE WHEN invoice_date IS NOT NULL THEN '{"name":"INVOICE_DATE_VALID","status":"PASSED","field":"invoice_date"}'
  ELSE '{"name":"INVOICE_DATE_VALID","status":"FAILED","field":"invoice_date","message":"Invoice date was not found on the document."}' END AS json FROM sh WHERE invoice_date IS NOT NULL OR no_date"""


@query(f"WITH {SILVER_SQL} " + " UNION ALL ".join([*(_PRESENT.format(name=n, good=g, field=f, bad=b, message=m) for n, g, f, b, m in _PRESENCE), _DATED]))
def checks_as_json(spark, sf_dir):
    """The checks of presence as stored: without empty fields."""
    return _silver(spark, sf_dir).select("document_id", F.explode(rules.presence_checks()).alias("c")).select("document_id", rules.check_json(F.col("c")).alias("json"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'INVOICE_DATE_VALID' AS name, 'FAILED' AS status, '15/01/2026' AS actual FROM orders WHERE o_orderkey % 37 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'DUE_DATE_VALID', 'WARNING', '2026-13-01' FROM orders WHERE o_orderkey % 17 = 0""")
def check_date_formats(spark, sf_dir):
    bronze = views.extracted(spark, sf_dir).withColumn("due_date", F.when(F.col("ord") % 17 == 0, "2026-13-01").otherwise(F.col("due_date")))
    silver = normalize_invoices(bronze, ("document_id",))
    return silver.select("document_id", F.explode(rules.date_format_checks()).alias("c")).select("document_id", "c.name", "c.status", "c.actual")


# ---- stored rows ----


@query(f"""WITH {SILVER_SQL} SELECT document_id, NOT (k % 101 = 0 OR k % 103 = 0 OR k % 107 = 0 OR (k % 109 = 0 AND n_items > 0)) AS persistable FROM sh""")
def persistable_rows(spark, sf_dir):
    """Amounts, names, codes and quantities that are too long for their columns."""
    k = F.col("document_id").cast("long")
    far = lambda i: F.when(k % 109 == 0, i.withField("quantity", F.lit(10**12).cast("decimal(18,4)"))).otherwise(i)
    rows = _silver(spark, sf_dir).withColumns(
        {
            "subtotal": F.when(k % 101 == 0, F.lit(10**12).cast("decimal(18,2)")).otherwise(F.col("subtotal")),
            "vendor_name": F.when(k % 103 == 0, F.repeat(F.lit("x"), F.lit(256))).otherwise(F.col("vendor_name")),
            "currency": F.when(k % 107 == 0, "ABCDEFGHIJK").otherwise(F.col("currency")),
            "line_items": F.transform("line_items", far),
        }
    )
    return rows.select("document_id", persistence.persistable().alias("persistable"))


@query(f"WITH {SILVER_SQL} SELECT CAST(count(*) AS BIGINT) AS items, 0::DOUBLE AS discount, CAST(0 AS BIGINT) AS skus, CAST(count(r) AS BIGINT) AS rates, CAST(count(*) FILTER (i = 0) AS BIGINT) AS first_items FROM si")
def persist_unset(spark, sf_dir):
    """Stored items have no discount and no product code."""
    rows = persistence.item_rows(_silver(spark, sf_dir))
    return rows.agg(F.count("*").alias("items"), F.sum("discount").cast("double").alias("discount"), F.count("product_sku").alias("skus"), F.count("tax_rate").alias("rates"), F.count_if(F.col("sort_order") == 0).alias("first_items"))


_DECIDED = f"""{CHECKS_SQL}, dc AS (SELECT *, CASE WHEN n_failed = 0 AND composite >= 0.85 THEN 'VALIDATED' ELSE 'REVIEW_REQUIRED' END AS decision,
  CASE WHEN n_failed = 0 AND composite >= 0.85 THEN 'COMPLETED' ELSE 'REVIEW_REQUIRED' END AS final FROM sc)"""


@query(f"WITH {_DECIDED} SELECT document_id, final AS status FROM dc")
def process_status(spark, sf_dir):
    return process(views.extracted(spark, sf_dir))["status"]


@query(f"""WITH {_DECIDED}, vk AS (SELECT *, CASE WHEN vendor_name IS NULL THEN NULL WHEN vendor_tax_id IS NOT NULL THEN 'T:' || vendor_tax_id ELSE 'N:' || vendor_name END AS vk FROM dc)
SELECT document_id, 'VALIDATION' AS stage, 'SUCCESS' AS status, 'Decision: ' || decision AS message, decision AS outcome, CAST(n_passed AS BIGINT) AS n, NULL AS created FROM vk
UNION ALL SELECT document_id, 'PERSISTENCE', 'SUCCESS', 'Invoice persisted; document ' || final || '.', final, CAST(n_items AS BIGINT),
  CASE WHEN vk IS NOT NULL AND row_number() OVER (PARTITION BY vk ORDER BY k) = 1 THEN 'true' ELSE 'false' END FROM vk""")
def process_logs(spark, sf_dir):
    """Log rows of validation and persistence with what their payloads say."""
    logs = process(views.extracted(spark, sf_dir), saved=workspace(spark, "process"))["processing_logs"]
    read = lambda a, b: F.coalesce(F.get_json_object("payload", a), F.get_json_object("payload", b))
    return logs.select(
        "document_id", "stage", "status", "message", read("$.decision", "$.final_status").alias("outcome"), read("$.summary.passed", "$.line_item_count").cast("bigint").alias("n"), F.get_json_object("payload", "$.vendor_created").alias("created")
    )


@query("""WITH f AS (SELECT CAST(event_id AS VARCHAR) AS document_id, repeat('fault ' || event_id || ' ', CAST(event_id % 90 AS INTEGER)) AS detail FROM events)
SELECT document_id, 'OCR' AS stage, 'FAILURE' AS status, left(detail, 500) AS message, '{"error_code":"ERR_OCR_FAILED","detail":"' || left(detail, 500) || '"}' AS payload FROM f""")
def failure_log_rows(spark, sf_dir):
    number = F.col("event_id").cast("string")
    rows = views.table(spark, sf_dir, "events").select(number.alias("document_id"), F.repeat(F.concat(F.lit("fault "), number, F.lit(" ")), (F.col("event_id") % 90).cast("int")).alias("text"))
    return persistence.failure_logs(rows, "OCR", "ERR_OCR_FAILED", F.col("text")).select("document_id", "stage", "status", "message", "payload")


@query("SELECT CAST(user_id AS VARCHAR) AS document_id, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def latest_status(spark, sf_dir):
    log = views.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return persistence.current_status(log)


@query("SELECT sha256(text) AS file_hash, CAST(count(*) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def hash_violations(spark, sf_dir):
    return persistence.key_violations(_uploads(spark, sf_dir), "file_hash")


# ---- shown texts ----


@query(f"""WITH {DOCUMENTS_SQL} SELECT id, CASE status WHEN 'AI_PROCESSING' THEN 'AI structuring' WHEN 'REVIEW_REQUIRED' THEN 'Review required' WHEN 'COMPLETED' THEN 'Completed' ELSE 'Failed' END AS label,
  CASE status WHEN 'AI_PROCESSING' THEN 'info' WHEN 'REVIEW_REQUIRED' THEN 'warning' WHEN 'COMPLETED' THEN 'success' ELSE 'danger' END AS tone FROM docs""")
def status_labels(spark, sf_dir):
    return views.documents(spark, sf_dir).select("id", readmodels.status_label(F.col("status")).alias("s")).select("id", "s.label", "s.tone")


@query("""SELECT event_id, ['success', 'danger', 'warning', 'neutral'][CAST(event_id % 4 AS INTEGER) + 1] AS tone, ['✓', '✕', '!', '—'][CAST(event_id % 4 AS INTEGER) + 1] AS symbol FROM events""")
def check_tones(spark, sf_dir):
    status = _pick(CHECK_STATUSES, F.col("event_id") % 4)
    return views.table(spark, sf_dir, "events").select("event_id", readmodels.check_tone(status).alias("c")).select("event_id", "c.tone", "c.symbol")


@query(f"WITH {INVOICES_SQL} SELECT id, coalesce(invoice_number, '(no invoice number)') AS title FROM inv")
def detail_titles(spark, sf_dir):
    return views.invoices(spark, sf_dir).select("id", readmodels.detail_title(F.col("invoice_number")).alias("title"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey + CASE l_linenumber % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.125 WHEN 2 THEN 0.0625 ELSE 0 END AS price FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN format('{:,.3f}', price::DOUBLE) WHEN 2 THEN format('{:,.4f}', price::DOUBLE) ELSE format('{:,.2f}', price::DOUBLE) END AS price,
  CASE WHEN l_linenumber = 3 THEN '—' ELSE ['0', '2.5', '5', '7.5', '10'][l_linenumber % 5 + 1] || '%' END AS rate FROM p""")
def detail_amounts(spark, sf_dir):
    n = F.col("l_linenumber")
    part = _pick(("0.5", "0.125", "0.0625", "0"), n % 4).cast("decimal(5,4)")
    price = (F.col("l_partkey").cast("decimal(14,0)") + part).cast("decimal(18,4)")
    rate = F.when(n != 3, (n % 5) * 2.5)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", readmodels.unit_price_text(price).alias("price"), readmodels.rate_text(rate).alias("rate"))


@query(f"""WITH {LOGS_SQL}, m AS (SELECT *, CAST(id AS BIGINT) * 13 AS ms FROM logs)
SELECT id, lower(replace(stage, '_', ' ')) || ': ' || CASE WHEN ms % 3 = 0 THEN status ELSE message END || ' · ' || CASE WHEN ms >= 60000 THEN {_fixed("(ms / 60000)", 1)} || ' min' WHEN ms >= 1000 THEN {_fixed("(ms / 1000)", 1)} || ' s' ELSE ms || ' ms' END AS line FROM m""")
def stage_lines(spark, sf_dir):
    rows = views.logs(spark, sf_dir).withColumn("ms", F.col("id").cast("long") * 13)
    message = F.when(F.col("ms") % 3 != 0, F.col("message"))
    return rows.select("id", readmodels.stage_line(F.col("stage"), F.col("status"), message, F.col("ms")).alias("line"))


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, {LOGS_SQL} SELECT id, EXISTS (SELECT 1 FROM it WHERE it.invoice_id = inv.id) AS items, EXISTS (SELECT 1 FROM logs l WHERE l.document_id = inv.document_id) AS logs FROM inv""")
def saved_flags(spark, sf_dir):
    return _detail(spark, sf_dir).select("id", readmodels.saved_flags(F.col("items_saved"), F.col("logs_saved")).alias("f")).select("id", "f.items", "f.logs")


@query(f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, {VENDORS_SQL}, ln AS (SELECT invoice_id, list({{'name': description, 'quantity': l_quantity, 'price_unit': CAST(l_partkey % 1000 AS DOUBLE)}} ORDER BY sort_order) AS items FROM it GROUP BY 1)
SELECT inv.id, CAST(to_json({{'move_type': 'in_invoice', 'partner': coalesce(ven.name, vendor_name), 'ref': coalesce(invoice_number, '?'), 'invoice_date': CAST(invoice_date AS VARCHAR), 'currency': currency, 'invoice_line_ids': coalesce(items, [])}}) AS VARCHAR) AS json
FROM inv LEFT JOIN ven ON ven.id = inv.vendor_id LEFT JOIN ln ON ln.invoice_id = inv.id""")
def erp_bills(spark, sf_dir):
    rows = _detail(spark, sf_dir).withColumn("invoice_number", F.coalesce("invoice_number", F.lit("?")))
    return rows.select("id", exports.erp_payload().alias("json"))


# ---- reviews, tenants, caches, texts ----


@query(f"""WITH {INVOICES_SQL}, c AS (SELECT id, document_id, status, coalesce(invoice_number, '-') AS n, currency, CAST(document_id AS BIGINT) AS k FROM inv),
a AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'GBP' ELSE currency END AS new FROM c)
SELECT id, CASE WHEN k % 10 = 0 THEN 'VALIDATED' ELSE status END AS status, '{{"invoice_number":"' || n || '","currency":"' || currency || '"}}' AS audit_before, '{{"invoice_number":"' || n || '","currency":"' || new || '"}}' AS audit_after, new AS currency FROM a""")
def corrections_audit(spark, sf_dir):
    rows = views.invoices(spark, sf_dir).withColumn("invoice_number", F.coalesce("invoice_number", F.lit("-")))
    k = F.col("document_id").cast("long")
    wanted = rows.where(k % 5 == 0).select("id", (k % 10 == 0).alias("approved"), F.lit(None).cast("string").alias("invoice_number"), F.lit("GBP").alias("currency"))
    return analytics.corrected(rows, wanted, ("invoice_number", "currency")).select("id", "status", "audit_before", "audit_after", "currency")


@query(f"WITH {INVOICES_SQL} SELECT id, CAST(grand_total AS DOUBLE) AS grand_total FROM inv WHERE CAST(document_id AS BIGINT) % 3 = 1")
def tenant_invoices(spark, sf_dir):
    """The invoices of one organisation of three."""
    rows = views.invoices(spark, sf_dir).withColumn("organization_id", F.concat(F.lit("org-"), (F.col("document_id").cast("long") % 3).cast("string")))
    return analytics.of_tenant(rows, "org-1").select("id", F.col("grand_total").cast("double").alias("grand_total"))


@query(f"""WITH {INVOICES_SQL}, {VENDORS_SQL}, c AS (SELECT tax_id, 'prompt for ' || tax_id AS prompt FROM ven WHERE CAST(substr(id, 2) AS INTEGER) % 20 >= 17)
SELECT inv.id, prompt FROM inv LEFT JOIN c ON c.tax_id = inv.vendor_tax_id""")
def vendor_prompts(spark, sf_dir):
    s = F.substring("id", 2, 9).cast("int")
    cache = views.vendors(spark, sf_dir).select("tax_id", F.concat(F.lit("prompt for "), "tax_id").alias("prompt"), ((s % 20) / 20).alias("success_rate"))
    return analytics.cached_prompts(views.invoices(spark, sf_dir), cache).select("id", "prompt")


@query(r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def compacted_texts(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(analytics.compacted(F.col("text")), 256).alias("digest"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+', '[email]', 'g'), '\+[0-9][0-9 ().-]{7,}[0-9]', '[phone]', 'g')) AS digest FROM documents")
def masked_contacts(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(analytics.masked_contact(F.col("text")), 256).alias("digest"))


@query("""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), l AS (SELECT doc_id, pages, list_max(list_transform(range(1, len(pages) + 1), lambda i: CASE WHEN regexp_matches(pages[i], '[0-9]') THEN i ELSE 0 END)) AS last FROM p)
SELECT doc_id, CAST(CASE WHEN last > 0 THEN last ELSE len(pages) END AS INTEGER) AS kept FROM l""")
def pages_with_items(spark, sf_dir):
    """Lines as pages; those after the last one with a digit go."""
    pages = analytics.through_last(F.split("text", "\n"), lambda p: p.rlike("[0-9]"))
    return views.table(spark, sf_dir, "documents").select("doc_id", F.size(pages).alias("kept"))


# ---- questions ----


@query("""SELECT l_partkey AS product, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-03-01' AND CAST(l_shipdate AS DATE) < DATE '1996-04-01' GROUP BY 1 ORDER BY quantity DESC, product LIMIT 10""")
def top_products_of_month(spark, sf_dir):
    return analytics.top_products(_purchases(spark, sf_dir), "1996-03-01", "1996-04-01")


@query("""SELECT l_suppkey AS vendor, round(sum(l_extendedprice), 2) AS spend, CAST(count(*) AS BIGINT) AS lines FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1996-04-01' GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, vendor LIMIT 1""")
def largest_vendor_of_quarter(spark, sf_dir):
    return analytics.largest_vendor(_purchases(spark, sf_dir), "1996-01-01", "1996-04-01").withColumn("spend", F.round("spend", 2))


@query("""SELECT l_suppkey AS vendor, sum(l_quantity) AS quantity FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1997-01-01' GROUP BY 1""")
def quantity_by_vendor_of_year(spark, sf_dir):
    return analytics.quantity_by_vendor(_purchases(spark, sf_dir), "1996-01-01", "1997-01-01")


@query("""WITH l AS (SELECT l_partkey AS product, CAST(l_shipdate AS DATE) AS day, round(l_extendedprice) / l_quantity AS price FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1996-01-01' AND CAST(l_shipdate AS DATE) < DATE '1996-07-01'),
f AS (SELECT product, arg_min(price, (day, price)) AS a, arg_max(price, (day, -price)) AS b FROM l GROUP BY product) SELECT product, round(b / a - 1, 9) AS increase FROM f ORDER BY b / a - 1 DESC, product LIMIT 10""")
def largest_price_increases(spark, sf_dir):
    return analytics.largest_increases(_purchases(spark, sf_dir), "1996-01-01", "1996-07-01").withColumn("increase", F.round("increase", 9))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.round("l_extendedprice") / F.col("l_quantity")
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("product"), F.col("l_shipdate").cast("date").alias("day"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"), price.alias("unit_price")
    )


@query("SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (event_type <> 'error') / count(*), 9) AS rate FROM events GROUP BY 1")
def sync_success_by_day(spark, sf_dir):
    rows = analytics.rate_by_day(views.table(spark, sf_dir, "events"), "ts", F.col("event_type") != "error")
    return rows.withColumn("rate", F.round("rate", 9))


@query("SELECT CAST(count(*) AS BIGINT) AS n, round(count(*) FILTER (ceil(length(text) / 4) > 6000) / count(*), 9) AS share FROM documents")
def long_document_share(spark, sf_dir):
    return analytics.long_share(views.table(spark, sf_dir, "documents")).withColumn("share", F.round("share", 9))
