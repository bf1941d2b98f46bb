"""The validation rules: expressions over one silver row that build its ordered array of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import REVIEW_THRESHOLD, TOLERANCE
from ..functions.numbers import within
from ..functions.text import known_currency
from ..schemas import CHECK
from .confidence import composite

_BARE = CHECK.replace("seq:int,", "")


def check(name: str, status: Column | str, field: Column | str, message: Column | str = "", expected: Column | None = None, actual: Column | None = None) -> Column:
    col = lambda v: F.lit(v) if isinstance(v, str) else v
    text = lambda v: F.lit(None).cast("string") if v is None else v.cast("string")
    return F.struct(F.lit(name).alias("name"), col(status).alias("status"), col(field).alias("field"), col(message).alias("message"), text(expected).alias("expected"), text(actual).alias("actual"))


def _none() -> Column:
    return F.array().cast(f"array<{_BARE}>")


def _if(condition: Column, one: Column) -> Column:
    return F.when(condition, F.array(one)).otherwise(_none())


def _pass_fail(name: str, ok: Column, field: str, message: str, expected: Column | None = None, actual: Column | None = None) -> Column:
    bad = check(name, "FAILED", field, message, expected, actual)
    return F.when(ok, check(name, "PASSED", field)).otherwise(bad)


def date_format_checks() -> Column:
    bad = lambda raw, parsed: F.col(raw).isNotNull() & F.col(parsed).isNull()
    return F.concat(
        _if(bad("raw_invoice_date", "invoice_date"), check("INVOICE_DATE_VALID", "FAILED", "invoice_date", "Invoice date is not a valid ISO-8601 date.", actual=F.col("raw_invoice_date"))),
        _if(bad("raw_due_date", "due_date"), check("DUE_DATE_VALID", "WARNING", "due_date", "Due date is not a valid ISO-8601 date.", actual=F.col("raw_due_date"))),
    )


def currency_check() -> Column:
    c = F.col("currency")
    missing = check("CURRENCY_VALID", "WARNING", "currency", "No currency detected; the platform default will apply.")
    unknown = check("CURRENCY_VALID", "WARNING", "currency", F.concat(F.lit("Unrecognized currency '"), F.coalesce("raw_currency", c), F.lit("'; kept as-is for review.")), actual=c)
    return F.array(F.when(c.isNull(), missing).when(known_currency(c), check("CURRENCY_VALID", "PASSED", "currency", actual=c)).otherwise(unknown))


def derivation_checks() -> Column:
    return F.flatten(F.transform(F.filter("line_items", lambda i: i["unit_price_derived"] | i["line_total_derived"]), _derivations))


def _derivations(i: Column) -> Column:
    at = F.concat(F.lit("line_items["), i["sort_order"].cast("string"), F.lit("]"))
    price, total = i["unit_price"].cast("string"), i["line_total"].cast("string")
    from_total = check("UNIT_PRICE_DERIVED", "PASSED", F.concat(at, F.lit(".unit_price")), F.concat(F.lit("Unit price not printed; derived as line_total / quantity = "), price, F.lit(".")), actual=price)
    text = F.concat(F.lit("Line total not printed; derived as quantity × unit_price = "), total, F.lit(". Derived totals should be verified in review."))
    from_price = check("LINE_TOTAL_DERIVED", "WARNING", F.concat(at, F.lit(".line_total")), text, actual=total)
    return F.when(i["unit_price_derived"], F.array(from_total)).when(i["line_total_derived"], F.array(from_price)).otherwise(_none())


def presence_checks() -> Column:
    dated, missing = date_presence_checks()
    return F.concat(field_checks(), dated, content_checks(), missing)


def field_checks() -> Column:
    required = (("VENDOR_NAME_PRESENT", "vendor_name", "Vendor name"), ("INVOICE_NUMBER_PRESENT", "invoice_number", "Invoice number"), ("GRAND_TOTAL_PRESENT", "grand_total", "Grand total"))
    return F.array(*[_pass_fail(name, F.col(f).isNotNull(), f, f"{label} was not found on the document.") for name, f, label in required])


def date_presence_checks() -> tuple[Column, Column]:
    """The check of an invoice date that is there, and of one that is missing; either array may be empty."""
    dated = F.col("invoice_date")
    nothing = dated.isNull() & F.col("raw_invoice_date").isNull()
    good = check("INVOICE_DATE_VALID", "PASSED", "invoice_date")
    return _if(dated.isNotNull(), good), _if(nothing, check("INVOICE_DATE_VALID", "FAILED", "invoice_date", "Invoice date was not found on the document."))


def content_checks() -> Column:
    items = _pass_fail("LINE_ITEMS_PRESENT", F.size("line_items") > 0, "line_items", "No line items were extracted.")
    order = F.when(F.col("purchase_order").isNotNull(), check("PURCHASE_ORDER_PRESENT", "PASSED", "purchase_order")).otherwise(check("PURCHASE_ORDER_PRESENT", "SKIPPED", "purchase_order", "No purchase order on document."))
    return F.array(items, order)


def _tolerance(tolerance: str) -> Column:
    return F.lit(tolerance).cast("decimal(6,4)")


def line_math_checks(tolerance: str = TOLERANCE) -> Column:
    return F.transform("line_items", lambda i: _line_check(i, tolerance))


def _line_check(i: Column, tolerance: str) -> Column:
    at = F.concat(F.lit("line_items["), i["sort_order"].cast("string"), F.lit("]"))
    known, expected, ok = _line_math(i, tolerance)
    unknown = check("LINE_ITEM_MATH", "WARNING", at, "Item is missing quantity, unit price, or line total; math not verifiable.")
    bad = check("LINE_ITEM_MATH", "FAILED", F.concat(at, F.lit(".line_total")), "quantity × unit_price does not match the printed line total.", expected, i["line_total"])
    return F.when(~known, unknown).when(ok, check("LINE_ITEM_MATH", "PASSED", at)).otherwise(bad)


def _line_math(i: Column, tolerance: str) -> tuple[Column, Column, Column]:
    """(whether the item's numbers are known, quantity times price, whether that is the line total)."""
    expected = F.bround(i["quantity"] * i["unit_price"], 2)
    return i["quantity"].isNotNull() & i["unit_price"].isNotNull() & i["line_total"].isNotNull(), expected, within(expected, i["line_total"], _tolerance(tolerance))


def items_sum() -> Column:
    """Sum of the known line totals; null where none is known."""
    return F.aggregate("line_items", F.lit(None).cast("decimal(20,2)"), lambda a, i: F.coalesce((a + i["line_total"]).cast("decimal(20,2)"), a, i["line_total"].cast("decimal(20,2)")))


def subtotal_check(tolerance: str = TOLERANCE) -> Column:
    printed = F.col("subtotal")
    skipped = check("SUBTOTAL_MATCHES_ITEMS", "SKIPPED", "subtotal", "Subtotal or line totals unavailable.")
    verdict = lambda total: _pass_fail("SUBTOTAL_MATCHES_ITEMS", within(total, printed, _tolerance(tolerance)), "subtotal", "Sum of line totals does not match the printed subtotal.", total, printed)
    return F.transform(F.array(items_sum()), lambda total: F.when(printed.isNull() | total.isNull(), skipped).otherwise(verdict(total)))


def grand_total_check(tolerance: str = TOLERANCE) -> Column:
    printed = F.col("grand_total")
    skip = lambda why: check("GRAND_TOTAL_MATH", "SKIPPED", "grand_total", why)

    def of(base: Column) -> Column:
        total = _grand_total(base)
        verdict = _pass_fail("GRAND_TOTAL_MATH", within(total, printed, _tolerance(tolerance)), "grand_total", "subtotal + tax − discount does not match the printed grand total.", total, printed)
        return F.when(printed.isNull(), skip("No grand total to verify.")).when(base.isNull(), skip("No subtotal or line totals available to verify against.")).otherwise(verdict)

    return F.transform(F.array(F.coalesce(F.col("subtotal"), items_sum())), of)


def _grand_total(base: Column) -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return base + F.coalesce("tax_amount", zero) - F.coalesce("discount_amount", zero)


def _rates() -> Column:
    return F.array_distinct(F.filter(F.transform("line_items", lambda i: i["tax_rate"]), lambda r: r.isNotNull()))


def _tax(rate: Column) -> Column:
    return F.bround(F.col("subtotal") * rate * F.lit("0.01").cast("decimal(2,2)"), 2)


def tax_check(tolerance: str = TOLERANCE) -> Column:
    def of(rates: Column) -> Column:
        rate = F.get(rates, F.lit(0))
        expected = _tax(rate)
        known = (F.size(rates) == 1) & F.col("subtotal").isNotNull() & F.col("tax_amount").isNotNull()
        message = F.concat(F.lit("Tax amount is inconsistent with a uniform "), rate.cast("string"), F.lit("% rate on the subtotal."))
        bad = check("TAX_CONSISTENT", "FAILED", "tax_amount", message, expected, F.col("tax_amount"))
        skipped = check("TAX_CONSISTENT", "SKIPPED", "tax_amount", "Uniform tax rate, subtotal, or tax amount unavailable.")
        return F.when(~known, skipped).when(within(expected, F.col("tax_amount"), _tolerance(tolerance)), check("TAX_CONSISTENT", "PASSED", "tax_amount")).otherwise(bad)

    return F.transform(F.array(_rates()), of)


def date_order_check() -> Column:
    start, due = F.col("invoice_date"), F.col("due_date")
    verdict = _pass_fail("DATE_ORDER", due >= start, "due_date", "Due date is earlier than the invoice date.", F.concat(F.lit(">= "), start.cast("string")), due)
    return _if(start.isNotNull() & due.isNotNull(), verdict)


def _parts(tolerance: str) -> list[tuple[set[str], Column]]:
    """The rules in their fixed order: the names that a part's checks may have, and the part."""
    dates, (dated, missing) = {"INVOICE_DATE_VALID"}, date_presence_checks()
    return [
        (dates | {"DUE_DATE_VALID"}, date_format_checks()),
        ({"CURRENCY_VALID"}, currency_check()),
        ({"UNIT_PRICE_DERIVED", "LINE_TOTAL_DERIVED"}, derivation_checks()),
        ({"VENDOR_NAME_PRESENT", "INVOICE_NUMBER_PRESENT", "GRAND_TOTAL_PRESENT"}, field_checks()),
        (dates, dated),
        ({"LINE_ITEMS_PRESENT", "PURCHASE_ORDER_PRESENT"}, content_checks()),
        (dates, missing),
        ({"LINE_ITEM_MATH"}, line_math_checks(tolerance)),
        ({"SUBTOTAL_MATCHES_ITEMS"}, subtotal_check(tolerance)),
        ({"GRAND_TOTAL_MATH"}, grand_total_check(tolerance)),
        ({"TAX_CONSISTENT"}, tax_check(tolerance)),
        ({"DATE_ORDER"}, date_order_check()),
    ]


def with_checks(silver: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Adds ``checks``: all rules in their fixed order, without stopping at a failure."""
    parts = [part for _, part in _parts(tolerance)]
    numbered = F.transform(F.concat(*parts), lambda c, i: F.struct(i.cast("int").alias("seq"), *[c[f].alias(f) for f in ("name", "status", "field", "message", "expected", "actual")]))
    return silver.withColumn("checks", numbered)


def checks_named(silver: DataFrame, names: tuple[str, ...], *keys: str, tolerance: str = TOLERANCE) -> DataFrame:
    """One row a check of these names, as ``checks_long`` has them but for seq; no other rule is built or its columns read."""
    parts = [part for own, part in _parts(tolerance) if own & set(names)]
    rows = silver.select(*keys, F.explode_outer(F.concat(*parts) if len(parts) > 1 else parts[0]).alias("c")).select(*keys, "c.*")
    return rows.where(F.col("name").isin(*names))


def with_outcomes(silver: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Adds n_passed, n_failed, n_warning and n_skipped: how many checks of each outcome ``with_checks`` would build.

    No check is built for it: each item becomes a number for its outcomes in one pass, those of the header are summed.
    """

    def code(i: Column) -> Column:
        """Tens for the derivation, ones for the math: 1 passed, 2 failed, 3 warning."""
        known, _, ok = _line_math(i, tolerance)
        return F.when(i["unit_price_derived"], 10).when(i["line_total_derived"], 30).otherwise(0) + F.when(~known, 3).when(ok, 1).otherwise(2)

    rows = silver.withColumns({"_total": items_sum(), "_rates": _rates(), "_codes": F.transform("line_items", code)})
    verdict = lambda ok: F.when(ok, 1).otherwise(2)
    skipped = lambda missing, ok: F.when(missing, 4).otherwise(verdict(ok))
    dated, due, total = F.col("invoice_date").isNotNull(), F.col("due_date").isNotNull(), F.col("_total")
    base, subtotal, tax = F.coalesce("subtotal", total), F.col("subtotal"), F.col("tax_amount")
    near = lambda a, b: within(a, b, _tolerance(tolerance))
    header = {
        "_dated": verdict(dated),
        "_due": F.when(F.col("raw_due_date").isNotNull() & ~due, 3).otherwise(0),
        "_currency": F.when(F.coalesce(known_currency(F.col("currency")), F.lit(False)), 1).otherwise(3),
        **{f"_{c}": verdict(F.col(c).isNotNull()) for c in ("vendor_name", "invoice_number", "grand_total")},
        "_items": verdict(F.size("line_items") > 0),
        "_order": F.when(F.col("purchase_order").isNotNull(), 1).otherwise(4),
        "_sum": skipped(subtotal.isNull() | total.isNull(), near(total, subtotal)),
        "_grand": skipped(F.col("grand_total").isNull() | base.isNull(), near(_grand_total(base), F.col("grand_total"))),
        "_tax": skipped((F.size("_rates") != 1) | subtotal.isNull() | tax.isNull(), near(_tax(F.get("_rates", F.lit(0))), tax)),
        "_between": F.when(dated & due, verdict(F.col("due_date") >= F.col("invoice_date"))).otherwise(0),
    }
    rows = rows.withColumns(header)

    def n(outcome: int) -> Column:
        own = F.size(F.filter("_codes", lambda c: c % 10 == outcome)) + F.size(F.filter("_codes", lambda c: c >= 10 * outcome)) - F.size(F.filter("_codes", lambda c: c >= 10 * outcome + 10))
        out = own if outcome != 4 else F.lit(0)
        for c in header:
            out = out + (F.col(c) == outcome).cast("int")
        return out

    return rows.withColumns({f"n_{name}": n(k) for k, name in enumerate(("passed", "failed", "warning", "skipped"), 1)}).drop("_total", "_rates", "_codes", *header)


def decide(silver: DataFrame, tolerance: str = TOLERANCE, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Adds the counts, validation_score, confidence and decision of ``validate``, without checks and reasons."""
    scored = _scored(with_outcomes(silver, tolerance))
    good = (F.col("n_failed") == 0) & ~(F.col("confidence.composite") < threshold)
    return scored.withColumn("decision", F.when(good, "VALIDATED").otherwise("REVIEW_REQUIRED"))


def _scored(counted: DataFrame) -> DataFrame:
    ratio = F.coalesce(F.col("n_passed") / F.nullif(F.col("n_passed") + F.col("n_failed"), F.lit(0)), F.lit(0.0))
    return counted.withColumn("validation_score", ratio).withColumn("confidence", composite(F.col("ocr_confidence"), F.col("ai_confidence"), F.col("validation_score")))


def with_decision(checked: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Adds counts of outcomes, the confidence breakdown, review reasons and the decision. Needs ``ocr_confidence``."""
    counted = checked
    for status in ("passed", "failed", "warning", "skipped"):
        counted = counted.withColumn(f"n_{status}", F.size(F.filter("checks", _has(status.upper()))))
    return with_reasons(_scored(counted), threshold).withColumn("decision", F.when(F.size("review_reasons") == 0, "VALIDATED").otherwise("REVIEW_REQUIRED"))


def with_reasons(scored: DataFrame, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    """Adds review reasons to rows that have checks and confidence."""
    low = F.col("confidence.composite") < threshold
    reasons = F.transform(F.filter("checks", _has("FAILED")), lambda c: F.concat(c["name"], F.lit(": "), F.coalesce(F.nullif(c["message"], F.lit("")), F.lit("check failed"))))
    sentence = F.format_string(f"Composite confidence %.4f is below the {threshold} review threshold.", F.col("confidence.composite"))
    reasons = F.when(low, F.array_append(reasons, sentence)).otherwise(reasons)
    return scored.withColumn("review_reasons", reasons)


def _has(status: str):
    return lambda c: c["status"] == status


def validate(silver: DataFrame, tolerance: str = TOLERANCE, threshold: float = REVIEW_THRESHOLD) -> DataFrame:
    return with_decision(with_checks(silver, tolerance), threshold)


def checks_long(checked: DataFrame, *keys: str) -> DataFrame:
    """One row a check. Every row has checks, so the outer explode changes nothing but keeps the optimiser from testing the array's size, which would build all checks once more."""
    return checked.select(*keys, F.explode_outer("checks").alias("c")).select(*keys, "c.*")


def check_json(c: Column) -> Column:
    """A check as JSON without empty fields."""
    thin = F.struct(c["name"].alias("name"), c["status"].alias("status"), *[F.nullif(c[f], F.lit("")).alias(f) for f in ("field", "message", "expected", "actual")])
    return F.to_json(thin)


def report_json() -> Column:
    """The validation report as JSON: decision, confidence, summary, checks, reasons."""
    summary = F.struct(F.col("n_passed").alias("passed"), F.col("n_failed").alias("failed"), F.col("n_warning").alias("warnings"), F.col("n_skipped").alias("skipped"))
    bare = F.transform("checks", lambda c: F.struct(c["name"].alias("name"), c["status"].alias("status"), *[F.nullif(c[f], F.lit("")).alias(f) for f in ("field", "message", "expected", "actual")]))
    return F.to_json(F.struct("decision", "confidence", summary.alias("summary"), bare.alias("checks"), "review_reasons"))
