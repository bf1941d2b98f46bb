"""Planned analytics: features described but not built before; the definitions are this library's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CHARS_PER_TOKEN, TEXT_BUDGET_TOKENS


def monthly(invoices: DataFrame, by: str, amount: str = "grand_total", date: str = "invoice_date") -> DataFrame:
    """Spend and number of invoices by month and ``by``."""
    return invoices.groupBy(F.date_trunc("month", date).cast("date").alias("month"), by).agg(F.sum(amount).alias("spend"), F.count("*").alias("invoices"))


def top_by_spend(invoices: DataFrame, by: str, n: int = 10) -> DataFrame:
    return invoices.groupBy(by).agg(F.sum("grand_total").alias("spend")).orderBy(F.desc("spend"), by).limit(n)


def spend_share(df: DataFrame, by: str, amount: str) -> DataFrame:
    """Each value's part of all spend; the total is a single row joined to the groups."""
    groups = df.groupBy(by).agg(F.sum(amount).alias("spend"))
    return groups.join(df.agg(F.sum(amount).alias("_all"))).select(by, "spend", (F.col("spend") / F.nullif("_all", F.lit(0))).alias("share"))


def price_deviation(lines: DataFrame, days: int = 90, limit: float = 0.15) -> DataFrame:
    """Lines whose unit price exceeds the mean of the ``days`` days before for the same vendor and product.

    Adds avg_price, deviation and alert. The day itself does not count, days without a price give no alert.
    A vendor and product pair with very many lines is averaged by day first, so the window sees a row a day.
    """
    key = ["vendor", "product"]
    daily = lines.groupBy(*key, "day").agg(F.sum("unit_price").alias("s"), F.count("unit_price").alias("n"))
    w = W.partitionBy(*key).orderBy(F.unix_date("day")).rangeBetween(-days, -1)
    rolled = daily.withColumn("avg_price", F.sum("s").over(w) / F.sum("n").over(w)).select(*key, "day", "avg_price")
    out = lines.join(rolled, [*key, "day"])
    ratio = F.col("unit_price") / F.nullif("avg_price", F.lit(0.0)) - 1
    return out.withColumn("deviation", ratio).withColumn("alert", F.coalesce(ratio > limit, F.lit(False)))


def vendor_profile(invoices: DataFrame, items: DataFrame) -> DataFrame:
    """Average value, average number of lines, frequency and spend of each vendor."""
    lines = items.groupBy("invoice_id").agg(F.count("*").alias("lines"))
    rows = invoices.join(lines, invoices["id"] == lines["invoice_id"], "left")
    return rows.groupBy("vendor_name").agg(F.avg("grand_total").alias("avg_value"), F.avg(F.coalesce("lines", F.lit(0))).alias("avg_lines"), F.count("*").alias("invoices"), F.sum("grand_total").alias("spend"), F.count_distinct(F.date_trunc("month", "invoice_date")).alias("active_months"))


def quarter_change(invoices: DataFrame, by: str) -> DataFrame:
    """Spend by quarter with the change against the quarter before (null where that has none)."""
    q = invoices.groupBy(by, F.date_trunc("quarter", "invoice_date").cast("date").alias("quarter")).agg(F.sum("grand_total").alias("spend"))
    before = q.select(by, F.add_months("quarter", 3).alias("quarter"), F.col("spend").alias("before"))
    return q.join(before, [by, "quarter"], "left").withColumn("change", F.col("spend") / F.nullif("before", F.lit(0.0)) - 1)


def price_change(lines: DataFrame) -> DataFrame:
    """Change from the first to the last price of each product; the smallest price holds among lines of one day."""
    first, last = F.min(F.struct("day", "unit_price")), F.max(F.struct("day", (-F.col("unit_price")).alias("p")))
    rows = lines.groupBy("product").agg(first.alias("f"), last.alias("l"))
    return rows.select("product", F.col("f.unit_price").alias("first_price"), (-F.col("l.p")).alias("last_price"))


def rate_by_window(logs: DataFrame, bad: Column, width: str = "1 hour", limit: float = 0.05, time: str = "created_at") -> DataFrame:
    """Share of bad events in each tumbling window, and whether it exceeds the limit; batch or stream."""
    grouped = logs.groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    rate = F.col("bad") / F.col("n")
    return grouped.select(F.col("window.start").alias("start"), "n", "bad", rate.alias("rate"), (rate > limit).alias("alert"))


def three_way_match(orders: DataFrame, receipts: DataFrame, invoiced: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Order, goods receipt and invoice by number and product: quantities and amounts agree within the tolerance or not."""
    key = ["po_number", "product"]
    rows = orders.join(receipts, key, "full").join(invoiced, key, "full")
    quantity = (F.abs(F.col("received") - F.col("ordered")) <= tolerance) & (F.abs(F.col("billed") - F.col("received")) <= tolerance)
    amount = F.abs(F.col("billed_amount") - F.col("ordered_amount")) <= tolerance
    state = F.when(F.col("ordered").isNull(), "no order").when(F.col("received").isNull(), "not received").when(F.col("billed").isNull(), "not billed").when(~quantity, "quantity differs").when(~amount, "amount differs").otherwise("matched")
    return rows.withColumn("state", state)


def vendor_habits(invoices: DataFrame) -> DataFrame:
    """vendor_name, invoices, first_day, last_day, gap_days, usual_terms: how often a vendor bills, and on which terms.

    ``invoices(vendor_name, invoice_date, payment_terms)``. gap_days is the mean number of days from one invoice to the
    next, null with a single dated one; usual_terms the commonest text, of equally common ones the first, null where none
    is given. Terms are counted before they are compared, so a vendor of very many invoices is a row for each text.
    """
    texts = invoices.groupBy("vendor_name", "payment_terms").agg(F.count("*").alias("_n"), F.count("invoice_date").alias("_dated"), F.min("invoice_date").alias("_first"), F.max("invoice_date").alias("_last"))
    usual = F.min(F.when(F.col("payment_terms").isNotNull(), F.struct((-F.col("_n")).alias("n"), "payment_terms"))).getField("payment_terms")
    rows = texts.groupBy("vendor_name").agg(F.sum("_n").alias("invoices"), F.min("_first").alias("first_day"), F.max("_last").alias("last_day"), F.sum("_dated").alias("_dated"), usual.alias("usual_terms"))
    gap = F.date_diff("last_day", "first_day") / F.nullif(F.col("_dated") - 1, F.lit(0))
    return rows.select("vendor_name", "invoices", "first_day", "last_day", gap.alias("gap_days"), "usual_terms")


def due_by_week(invoices: DataFrame) -> DataFrame:
    """Cash needed by week of the due date; without one, thirty days after the invoice date."""
    due = F.coalesce("due_date", F.date_add("invoice_date", 30))
    return invoices.groupBy(F.date_trunc("week", due).cast("date").alias("week")).agg(F.sum("grand_total").alias("due"))


def convert(invoices: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds amount_base: grand_total by the latest rate of its currency at or before the invoice date.

    The last known rate is carried over the days of each currency that have a rate or an invoice, one row a day, so a
    currency with a third of all invoices costs the window no more than another; invoices then join by currency and day.
    """
    quotes = rates.groupBy("currency", "day").agg(F.max("rate").alias("rate"))
    asked = invoices.select("currency", F.col("invoice_date").alias("day")).distinct()
    carried = F.last("rate", True).over(W.partitionBy("currency").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    daily = asked.join(quotes, ["currency", "day"], "full").select("currency", F.col("day").alias("invoice_date"), carried.alias("_rate"))
    rated = invoices.join(daily, ["currency", "invoice_date"], "left").withColumn("amount_base", F.col("grand_total").cast("double") * F.col("_rate"))
    return rated.select(*invoices.columns, "amount_base")


def tax_number_valid(country: Column, number: Column) -> Column:
    """Pattern of a tax number by country; null for countries without one here."""
    patterns = {"GB": "^GB[0-9]{9}([0-9]{3})?$", "DE": "^DE[0-9]{9}$", "FR": "^FR[0-9A-Z]{2}[0-9]{9}$", "IN": "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]$", "US": "^[0-9]{2}-?[0-9]{7}$"}
    out = None
    for code, pattern in patterns.items():
        out = F.when(country == code, number.rlike(pattern)) if out is None else out.when(country == code, number.rlike(pattern))
    return out


def upc_valid(code: Column) -> Column:
    """Whether twelve digits end in the UPC-A check digit."""
    digit = lambda k: F.substring(code, k, 1).try_cast("int")
    odd = sum((digit(k) for k in range(3, 12, 2)), digit(1))
    even = sum((digit(k) for k in range(4, 11, 2)), digit(2))
    return F.when(code.rlike("^[0-9]{12}$"), (10 - (odd * 3 + even) % 10) % 10 == digit(12)).otherwise(F.lit(False))


def storage_tier(created: Column, today: Column) -> Column:
    age = F.date_diff(today, created)
    return F.when(age <= 90, "hot").when(age <= 365, "warm").when(age <= 7 * 365, "cold").otherwise("expired")


def compacted(text: Column) -> Column:
    """Text with runs of blanks and of empty lines collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \\t]+", " "), "\\n{3,}", "\n\n"))


def through_last(pages: Column, wanted) -> Column:
    """An array up to the last page that ``wanted`` holds for; all of it where that holds for none."""
    after = F.array_position(F.reverse(F.transform(pages, wanted)), F.lit(True)).cast("int")
    return F.when(after > 0, F.slice(pages, F.lit(1), F.size(pages) - after + 1)).otherwise(pages)


def masked_contact(text: Column) -> Column:
    """Mail addresses and phone numbers masked."""
    mail = F.regexp_replace(text, r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+", "[email]")
    return F.regexp_replace(mail, r"\+[0-9][0-9 ().-]{7,}[0-9]", "[phone]")


def due_retries(sync_log: DataFrame, most: int = 5) -> DataFrame:
    """Documents whose latest sync failed and that have attempts left: document_id, attempts."""
    latest = sync_log.groupBy("document_id").agg(F.max_by("status", "attempt").alias("status"), F.max("attempt").alias("attempts"))
    return latest.where((F.col("status") == "FAILED") & (F.col("attempts") < most)).select("document_id", "attempts")


def corrected(invoices: DataFrame, corrections: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Invoices after reviewers' corrections, with before and after as JSON; approved ones become VALIDATED.

    ``corrections(id, approved, <field>…)``: a null field leaves the value.
    """
    c = corrections.select(F.col("id"), F.col("approved"), *[F.col(f).alias(f"_{f}") for f in fields])
    rows = invoices.join(c, "id", "left")
    new = {f: F.coalesce(f"_{f}", f) for f in fields}
    before, after = F.to_json(F.struct(*fields)), F.to_json(F.struct(*[new[f].alias(f) for f in fields]))
    status = F.when(F.coalesce("approved", F.lit(False)), "VALIDATED").otherwise(F.col("status"))
    rows = rows.withColumn("audit_before", before).withColumn("audit_after", after).withColumn("status", status)
    return rows.withColumns(new).drop("approved", *[f"_{f}" for f in fields])


def of_tenant(df: DataFrame, organization_id: str) -> DataFrame:
    return df.where(F.col("organization_id") == organization_id)


def review_rate_by_week(documents: DataFrame) -> DataFrame:
    """Share of finished documents sent to review, by week and source type."""
    week = F.date_trunc("week", "created_at").cast("date").alias("week")
    done = documents.where(F.col("status").isin("COMPLETED", "REVIEW_REQUIRED"))
    return done.groupBy(week, "source_type").agg(F.count("*").alias("n"), (F.count_if(F.col("status") == "REVIEW_REQUIRED") / F.count("*")).alias("rate"))


def vendor_cycle_time(documents: DataFrame, invoices: DataFrame) -> DataFrame:
    """Mean milliseconds from upload to the last change, by vendor."""
    d = documents.select(F.col("id").alias("document_id"), (F.unix_micros("updated_at") - F.unix_micros("created_at")).alias("micros"))
    return invoices.select("document_id", "vendor_name").join(d, "document_id").groupBy("vendor_name").agg((F.sum("micros") / F.count("micros") / 1000).alias("avg_ms"))


def cached_prompts(invoices: DataFrame, cache: DataFrame, least: float = 0.85) -> DataFrame:
    """Adds the cached prompt of each invoice's tax id, unless its success rate has fallen below ``least``."""
    good = cache.where(F.col("success_rate") >= least).select(F.col("tax_id").alias("vendor_tax_id"), "prompt")
    return invoices.join(good, "vendor_tax_id", "left")


def blended_cost(share_small: Column, cost_small: Column, share_retried: Column, cost_large: Column) -> Column:
    """Cost of an invoice when a share of the calls is repeated with the larger model."""
    return share_small * cost_small + share_retried * cost_large


def between(lines: DataFrame, start: str, end: str, time: str = "day") -> DataFrame:
    """Rows from the first day up to, without, the last."""
    return lines.where((F.col(time) >= F.lit(start).cast("date")) & (F.col(time) < F.lit(end).cast("date")))


def top_products(lines: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """What was bought most in a span."""
    return between(lines, start, end).groupBy("product").agg(F.sum("quantity").alias("quantity")).orderBy(F.desc("quantity"), "product").limit(n)


def largest_vendor(lines: DataFrame, start: str, end: str) -> DataFrame:
    """The vendor with the highest spend in a span."""
    return between(lines, start, end).groupBy("vendor").agg(F.sum("amount").alias("spend"), F.count("*").alias("lines")).orderBy(F.desc("spend"), "vendor").limit(1)


def quantity_by_vendor(lines: DataFrame, start: str, end: str) -> DataFrame:
    return between(lines, start, end).groupBy("vendor").agg(F.sum("quantity").alias("quantity"))


def largest_increases(lines: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """Products whose price rose most from the first to the last day of a span."""
    change = price_change(between(lines, start, end)).select("product", (F.col("last_price") / F.nullif("first_price", F.lit(0.0)) - 1).alias("increase"))
    return change.orderBy(F.desc("increase"), "product").limit(n)


def rate_by_day(rows: DataFrame, time: str, good: Column) -> DataFrame:
    return rows.groupBy(F.col(time).cast("date").alias("day")).agg(F.count("*").alias("n"), (F.count_if(good) / F.count("*")).alias("rate"))


def long_share(documents: DataFrame, budget: int = TEXT_BUDGET_TOKENS) -> DataFrame:
    """Share of documents whose text exceeds the budget of tokens."""
    over = F.ceil(F.length("text") / CHARS_PER_TOKEN) > budget
    return documents.agg(F.count("*").alias("n"), (F.count_if(over) / F.count("*")).alias("share"))
