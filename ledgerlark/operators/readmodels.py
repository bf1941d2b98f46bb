"""Read models: history, dashboard, document status, invoice detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ACTIVE_STEP, CHECK_TONES, STAGES, STATUS_LABELS, TERMINAL
from ..functions.text import duration, spaced

SORT_KEYS = ("created_at", "filename", "status", "vendor", "invoice_number", "invoice_date", "grand_total", "confidence")
_SORT = {"vendor": "vendor_name", "confidence": "composite_confidence"}

# Sort presets of the history page.
PRESETS = {"newest": ("created_at", True), "oldest": ("created_at", False), "total": ("grand_total", True), "confidence": ("confidence", False), "vendor": ("vendor", False)}


def history(documents: DataFrame, invoices: DataFrame, search: str | None = None, status: str | None = None) -> DataFrame:
    """One row a document with its invoice, if any. ``search``: pattern within filename, number or vendor, any case.

    ``%`` and ``_`` in the search keep their meaning; a blank search matches all, and one of over 200 characters is an error.
    """
    if search and len(search) > 200:
        raise ValueError("search has at most 200 characters")
    d, i = documents.alias("d"), invoices.alias("i")
    rows = d.join(i, F.col("i.document_id") == F.col("d.id"), "left")
    if status:
        rows = rows.where(F.col("d.status") == status)
    if search:
        pattern = f"%{search.strip()}%"
        rows = rows.where(F.col("d.filename").ilike(pattern) | F.col("i.invoice_number").ilike(pattern) | F.col("i.vendor_name").ilike(pattern))
    return rows.select(
        F.col("d.id").alias("document_id"),
        F.col("i.id").alias("invoice_id"),
        "d.filename",
        "d.status",
        "i.vendor_name",
        "i.invoice_number",
        "i.invoice_date",
        F.col("i.grand_total").cast("double").alias("grand_total"),
        "i.currency",
        F.col("i.composite_confidence").cast("double").alias("composite_confidence"),
        "d.source_type",
        "d.created_at",
    )


def history_page(rows: DataFrame, sort: str = "created_at", descending: bool = True, page: int = 1, size: int = 20) -> DataFrame:
    """A page of the history. Nulls come first when descending and last when ascending; ties go by document, descending."""
    if not (page >= 1 and 1 <= size <= 100):
        raise ValueError("page starts at 1 and size is 1 to 100")
    key = F.col(_SORT.get(sort, sort) if sort in SORT_KEYS else "created_at")
    order = key.desc_nulls_first() if descending else key.asc_nulls_last()
    return rows.orderBy(order, F.col("document_id").desc()).offset((page - 1) * size).limit(size)


def recent(rows: DataFrame, limit: int = 8) -> DataFrame:
    """The newest documents of the history, as the dashboard shows them."""
    if not 1 <= limit <= 25:
        raise ValueError("limit is 1 to 25")
    return history_page(rows, size=limit)


def total_pages(total: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(total / size))


def destination(invoice_id: Column, document_id: Column) -> Column:
    return F.when(invoice_id.isNotNull(), F.concat(F.lit("/invoices/"), invoice_id)).otherwise(F.concat(F.lit("/documents/"), document_id))


def status_breakdown(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count("*").alias("n"))


def average_confidence(invoices: DataFrame) -> DataFrame:
    return invoices.agg(F.avg(F.col("composite_confidence").cast("double")).alias("avg_confidence"))


def average_processing_ms(documents: DataFrame) -> DataFrame:
    micros = F.unix_micros(F.col("updated_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    return documents.where(F.col("status").isin(*TERMINAL)).agg(F.avg(micros / 1000).alias("avg_processing_ms"))


def usage_totals(logs: DataFrame) -> DataFrame:
    """Tokens and cost of all model calls, from the JSON payloads; payloads without the fields add nothing."""
    calls = logs.where((F.col("stage") == "AI_STRUCTURING") & F.col("payload").isNotNull())
    read = lambda path, kind: F.get_json_object("payload", path).try_cast(kind)
    return calls.agg(F.coalesce(F.sum(read("$.total_tokens", "bigint")), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum(read("$.estimated_cost_usd", "double")), F.lit(0.0)).alias("total_cost"))


def dashboard(documents: DataFrame, invoices: DataFrame, logs: DataFrame) -> DataFrame:
    """The KPI row: one pass over documents, one over invoices, one over logs, joined as single rows."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    docs = documents.agg(F.count("*").alias("total"), n("COMPLETED").alias("completed"), n("REVIEW_REQUIRED").alias("review_required"), n("FAILED").alias("failed"))
    wide = docs.join(average_confidence(invoices)).join(average_processing_ms(documents)).join(usage_totals(logs))
    terminal = F.col("completed") + F.col("review_required") + F.col("failed")
    return wide.select(
        "total",
        "completed",
        "review_required",
        "failed",
        (F.col("total") - terminal).alias("in_progress"),
        (F.col("completed") / F.nullif(terminal, F.lit(0))).alias("success_rate"),
        "avg_confidence",
        "avg_processing_ms",
        "total_tokens",
        F.round("total_cost", 6).alias("total_cost"),
    )


def timeline(logs: DataFrame, with_payload: bool = False) -> DataFrame:
    """Each document's stages in order of time and id."""
    entry = F.struct("created_at", "id", "stage", "status", "message", "duration_ms", *(["payload"] if with_payload else []))
    return logs.groupBy("document_id").agg(F.sort_array(F.collect_list(entry)).alias("stages"))


def first_failure(logs: DataFrame) -> DataFrame:
    """document_id with stage, message, payload and time of its first failure."""
    entry = F.struct("created_at", "id", "stage", "message", "payload")
    return logs.where("status = 'FAILURE'").groupBy("document_id").agg(F.min(entry).alias("e")).select("document_id", "e.stage", "e.message", "e.payload", "e.created_at")


def latest_payloads(logs: DataFrame) -> DataFrame:
    """The last payload of each document and stage; empty objects don't count."""
    return logs.where("payload is not null and payload <> '{}'").groupBy("document_id", "stage").agg(F.max_by("payload", F.struct("created_at", "id")).alias("payload"))


def document_status(documents: DataFrame, invoices: DataFrame, logs: DataFrame) -> DataFrame:
    """status, whether final, invoice, error and ordered stages of every document."""
    failure = first_failure(logs).select(F.col("document_id").alias("id"), F.struct("stage", "message", "payload").alias("error"))
    stages = timeline(logs).withColumnRenamed("document_id", "id")
    invoice = invoices.select(F.col("document_id").alias("id"), F.col("id").alias("invoice_id"))
    rows = documents.join(invoice, "id", "left").join(failure, "id", "left").join(stages, "id", "left")
    return rows.select(F.col("id").alias("document_id"), "filename", "status", F.col("status").isin(*TERMINAL).alias("is_terminal"), "source_type", "invoice_id", "error", "stages", "created_at", "updated_at")


def step_states(statuses: DataFrame) -> DataFrame:
    """State of the five steps for ``statuses(document_id, status, is_terminal, done, failed_stage)``; done: array of stages."""
    active = F.create_map(*[F.lit(x) for pair in ACTIVE_STEP.items() for x in pair])
    rows = statuses.withColumn("stage", F.explode(F.array(*map(F.lit, STAGES))))
    state = (
        F.when(F.col("stage") == F.col("failed_stage"), "failed")
        .when(F.array_contains(F.coalesce("done", F.array().cast("array<string>")), F.col("stage")), "done")
        .when(F.col("failed_stage").isNotNull(), "pending")
        .when(~F.col("is_terminal") & (F.col("stage") == active[F.col("status")]), "active")
        .otherwise("pending")
    )
    return rows.select("document_id", "stage", state.alias("state"))


def stage_durations(logs: DataFrame) -> DataFrame:
    return logs.where("duration_ms is not null").groupBy("document_id", "stage").agg(F.max_by("duration_ms", F.struct("created_at", "id")).alias("duration_ms"))


def invoice_detail(invoices: DataFrame, items: DataFrame, vendors: DataFrame, logs: DataFrame) -> DataFrame:
    """Header, ordered items, vendor, and what the run saved. Items and logs are aggregated before the joins."""
    entry = F.struct("sort_order", "id", "description", "quantity", "unit_price", "line_total", "tax_rate", "product_sku")
    lines = items.groupBy("invoice_id").agg(F.sort_array(F.collect_list(entry)).alias("items"), F.count("*").alias("items_saved"))
    spent = logs.groupBy("document_id").agg(F.count("*").alias("logs_saved"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_duration_ms"))
    v = vendors.select(F.col("id").alias("vendor_id"), F.struct("id", "name", "tax_id", "address", "phone", "email").alias("vendor"))
    rows = invoices.join(v, "vendor_id", "left").join(lines, invoices["id"] == lines["invoice_id"], "left").drop("invoice_id").join(spent, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(*[c for c in invoices.columns if c != "raw_extraction_json"], "vendor", "items", zero("items_saved"), zero("logs_saved"), zero("total_duration_ms"))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.85, "success").when(c >= 0.6, "warning").when(c.isNotNull(), "danger")


def chart_rows(recent: DataFrame) -> DataFrame:
    """The ten newest rows with a confidence, oldest first: label, percent, band."""
    known = recent.where("composite_confidence is not null").orderBy(F.col("created_at").desc_nulls_first(), F.col("document_id").desc()).limit(10)
    name = F.coalesce(F.nullif("invoice_number", F.lit("")), "filename")
    label = F.when(F.length(name) > 14, F.concat(F.substring(name, 1, 12), F.lit("…"))).otherwise(name)
    rank = F.row_number().over(W.orderBy(F.col("created_at").asc_nulls_last(), "document_id"))
    return known.select("document_id", label.alias("label"), F.floor(F.col("composite_confidence") * 100 + 0.5).cast("int").alias("percent"), confidence_band(F.col("composite_confidence")).alias("band"), rank.alias("place"))


def status_label(status: Column) -> Column:
    """Struct of label and tone."""
    pick = lambda at: F.create_map(*[F.lit(x) for k, v in STATUS_LABELS.items() for x in (k, v[at])])[status]
    return F.struct(pick(0).alias("label"), pick(1).alias("tone"))


def check_tone(status: Column) -> Column:
    """Struct of tone and symbol."""
    pick = lambda at: F.create_map(*[F.lit(x) for k, v in CHECK_TONES.items() for x in (k, v[at])])[status]
    return F.struct(pick(0).alias("tone"), pick(1).alias("symbol"))


def stage_line(stage: Column, status: Column, message: Column, ms: Column) -> Column:
    """A line of the stage log as shown."""
    took = F.when(ms.isNotNull(), F.concat(F.lit(" · "), duration(ms))).otherwise("")
    return F.concat(spaced(stage), F.lit(": "), F.coalesce(F.nullif(message, F.lit("")), status), took)


def blockers(checks: Column) -> Column:
    """Struct of the checks that need attention and the rest."""
    bad = lambda c: c["status"].isin("FAILED", "WARNING")
    return F.struct(F.filter(checks, bad).alias("blockers"), F.filter(checks, lambda c: ~bad(c)).alias("rest"))


def detail_title(invoice_number: Column) -> Column:
    return F.coalesce(F.nullif(invoice_number, F.lit("")), F.lit("(no invoice number)"))


def unit_price_text(price: Column) -> Column:
    """Two to four decimals, as needed."""
    return F.coalesce(F.regexp_replace(F.format_number(price, 4), "(\\.[0-9]{2}[1-9]?)0+$", "$1"), F.lit("—"))


def rate_text(rate: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(rate.cast("decimal(20,4)").cast("string"), "0+$", ""), "\\.$", "")
    return F.when(rate.isNull(), "—").otherwise(F.concat(plain, F.lit("%")))


def saved_flags(items_saved: Column, logs_saved: Column) -> Column:
    """What the developer panel confirms as stored."""
    return F.struct((items_saved > 0).alias("items"), (logs_saved > 0).alias("logs"))
