"""Normalisation, rules, confidence and decision on single invoices."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import numbers, text
from ledgerlark.operators import persistence, rules
from ledgerlark.operators.confidence import composite
from ledgerlark.operators.normalization import normalize_invoices
from ledgerlark.schemas import EXTRACTED

SCHEMA = f"document_id string, ord bigint, ocr_confidence double, {EXTRACTED}"


def item(**over):
    return {"description": "Blue Widget", "quantity": 2.0, "unit_price": 9.45, "line_total": 18.9, "tax_rate": None, "confidence": 0.95} | over


def invoice(items=None, ocr=1.0, **over):
    vendor = {"name": "Acme Corp", "tax_id": "GB123", "address": None, "phone": None, "email": None} | over.pop("vendor", {})
    base = {"document_id": "d", "ord": 1, "ocr_confidence": ocr, "vendor": vendor, "invoice_number": "INV-001", "invoice_date": "2026-01-15", "due_date": "2026-02-14", "currency": "USD", "purchase_order": "PO-777", "payment_terms": "Net 30"}
    base |= {"subtotal": 18.9, "tax_amount": None, "discount_amount": None, "grand_total": 18.9, "line_items": [item()] if items is None else items, "confidence": 0.95}
    return base | over


#: name, invoice, expected status of a check (or of the decision), expected and actual texts.
CASES = [
    ("clean", invoice(), {"decision": "VALIDATED"}, None),
    ("math", invoice([item(unit_price=5.0)]), {"decision": "REVIEW_REQUIRED", "LINE_ITEM_MATH": "FAILED"}, ("LINE_ITEM_MATH", "10.00", "18.90")),
    ("low ocr", invoice(ocr=0.4), {"decision": "REVIEW_REQUIRED"}, None),
    ("warning", invoice(currency=None), {"decision": "VALIDATED", "CURRENCY_VALID": "WARNING"}, None),
    ("derive price", invoice([item(unit_price=None)]), {"UNIT_PRICE_DERIVED": "PASSED", "LINE_ITEM_MATH": "PASSED"}, ("UNIT_PRICE_DERIVED", None, "9.4500")),
    ("derive total", invoice([item(line_total=None)], subtotal=None), {"LINE_TOTAL_DERIVED": "WARNING", "SUBTOTAL_MATCHES_ITEMS": "SKIPPED", "GRAND_TOTAL_MATH": "PASSED"}, ("LINE_TOTAL_DERIVED", None, "18.90")),
    ("incomplete", invoice([item(quantity=None, unit_price=None)]), {"LINE_ITEM_MATH": "WARNING"}, None),
    ("zero quantity", invoice([item(quantity=0.0, unit_price=None)]), {"LINE_ITEM_MATH": "WARNING"}, None),
    ("tolerance in", invoice([item(line_total=18.92)], subtotal=18.92, grand_total=18.92), {"LINE_ITEM_MATH": "PASSED"}, None),
    ("tolerance out", invoice([item(line_total=18.93)]), {"LINE_ITEM_MATH": "FAILED"}, None),
    ("subtotal", invoice(subtotal=99.0), {"SUBTOTAL_MATCHES_ITEMS": "FAILED"}, ("SUBTOTAL_MATCHES_ITEMS", "18.90", "99.00")),
    ("grand", invoice(tax_amount=3.78, discount_amount=1.0, grand_total=21.68), {"GRAND_TOTAL_MATH": "PASSED"}, None),
    ("grand bad", invoice(tax_amount=3.78, grand_total=99.99), {"GRAND_TOTAL_MATH": "FAILED"}, ("GRAND_TOTAL_MATH", "22.68", "99.99")),
    ("tax", invoice([item(tax_rate=18.0)], tax_amount=3.40, grand_total=22.30), {"TAX_CONSISTENT": "PASSED"}, None),
    ("tax bad", invoice([item(tax_rate=18.0)], tax_amount=9.99), {"TAX_CONSISTENT": "FAILED"}, None),
    ("tax mixed", invoice([item(tax_rate=18.0), item(tax_rate=5.0)], tax_amount=1.0), {"TAX_CONSISTENT": "SKIPPED"}, None),
    ("tax partly", invoice([item(tax_rate=18.0), item()], subtotal=37.8, tax_amount=6.80, grand_total=44.6), {"TAX_CONSISTENT": "PASSED"}, None),
    ("no vendor", invoice(vendor={"name": "  "}), {"VENDOR_NAME_PRESENT": "FAILED", "decision": "REVIEW_REQUIRED"}, None),
    ("no number", invoice(invoice_number="   "), {"INVOICE_NUMBER_PRESENT": "FAILED"}, None),
    ("no total", invoice(grand_total=None), {"GRAND_TOTAL_PRESENT": "FAILED", "GRAND_TOTAL_MATH": "SKIPPED"}, None),
    ("no items", invoice([]), {"LINE_ITEMS_PRESENT": "FAILED"}, None),
    ("no order", invoice(purchase_order=None), {"PURCHASE_ORDER_PRESENT": "SKIPPED", "decision": "VALIDATED"}, None),
    ("no date", invoice(invoice_date=None), {"INVOICE_DATE_VALID": "FAILED"}, None),
    ("bad date", invoice(invoice_date="15/01/2026"), {"INVOICE_DATE_VALID": "FAILED"}, ("INVOICE_DATE_VALID", None, "15/01/2026")),
    ("bad due", invoice(due_date="soon"), {"DUE_DATE_VALID": "WARNING"}, None),
    ("order", invoice(due_date="2026-01-01"), {"DATE_ORDER": "FAILED"}, ("DATE_ORDER", ">= 2026-01-15", "2026-01-01")),
    ("unknown currency", invoice(currency="ZZZ"), {"CURRENCY_VALID": "WARNING"}, ("CURRENCY_VALID", None, "ZZZ")),
    ("half cent", invoice([item(quantity=0.5, unit_price=0.05, line_total=0.0)], subtotal=None, grand_total=0.0), {"LINE_ITEM_MATH": "PASSED"}, None),
    ("nan", invoice([item(quantity=float("nan"))]), {"LINE_ITEM_MATH": "WARNING"}, None),
    ("huge", invoice([item(quantity=1e30)]), {"LINE_ITEM_MATH": "WARNING"}, None),
]


def validated(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return rules.validate(normalize_invoices(df, ("document_id", "ord", "ocr_confidence")))


@pytest.fixture(scope="module")
def results(spark):
    rows = [case[1] | {"document_id": case[0]} for case in CASES]
    return {r["document_id"]: r for r in validated(spark, rows).collect()}


@pytest.mark.parametrize("name,_,statuses,texts", CASES, ids=[c[0] for c in CASES])
def test_case(results, name, _, statuses, texts):
    row = results[name]
    for check, status in statuses.items():
        if check == "decision":
            assert row["decision"] == status
        else:
            assert status in [c["status"] for c in row["checks"] if c["name"] == check]
    if texts:
        check, expected, actual = texts
        assert (expected, actual) in [(c["expected"], c["actual"]) for c in row["checks"] if c["name"] == check]


def test_order_and_single_date_check(results):
    for row in results.values():
        assert [c["seq"] for c in row["checks"]] == list(range(len(row["checks"])))
        assert sum(c["name"] == "INVOICE_DATE_VALID" for c in row["checks"]) == 1


def test_reasons(results):
    assert results["clean"]["review_reasons"] == []
    assert results["low ocr"]["review_reasons"][0].endswith("is below the 0.85 review threshold.")
    assert results["math"]["review_reasons"][0] == "LINE_ITEM_MATH: quantity × unit_price does not match the printed line total."


def test_custom_tolerance(spark):
    silver = normalize_invoices(spark.createDataFrame([invoice([item(line_total=18.99)])], SCHEMA), ("document_id", "ord", "ocr_confidence"))
    names = {c["name"]: c["status"] for c in rules.with_checks(silver, "0.10").first()["checks"]}
    assert names["LINE_ITEM_MATH"] == "PASSED"


def test_confidence(spark):
    from ledgerlark.operators.confidence import composite

    rows = [(0.9, 0.8, 0.75), (1.0, None, 1.0), (None, None, None), (0.9, 0.2, 2.0)]
    got = [r["c"] for r in spark.createDataFrame(rows, "o double, a double, v double").select(composite(F.col("o"), F.col("a"), F.col("v")).alias("c")).collect()]
    assert got[0]["composite"] == round(0.3 * 0.9 + 0.4 * 0.8 + 0.3 * 0.75, 4)
    assert (got[1]["composite"], got[1]["weights"]["ai"], got[1]["weights"]["ocr"]) == (1.0, 0.0, 0.5)
    assert got[2]["composite"] == 0.0
    assert got[3]["composite"] == round(0.27 + 0.08 + 0.3, 4)


def test_ai_falls_back_to_items(spark):
    row = validated(spark, [invoice([item(confidence=0.6), item(confidence=0.8), item(confidence=None)], confidence=None)]).first()
    assert row["ai_confidence"] == pytest.approx(0.7)


def test_rounding_matches_python(spark):
    values = [k / 100000 for k in range(40000, 100001, 7)] + [0.84995, 0.85005, 0.5, 1.0, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "x double").select(numbers.round4(F.col("x")).alias("r")).collect()
    assert [r["r"] for r in got] == [round(v, 4) for v in values]


def test_decimals_match_python(spark):
    values = [1.005, 18.925, -1.005, 12345678.9, 0.1 + 0.2, 1e17, float("inf"), float("nan"), None]
    got = [r["d"] for r in spark.createDataFrame([(v,) for v in values], "x double").select(numbers.to_decimal(F.col("x")).alias("d")).collect()]
    assert got == [Decimal("1.01"), Decimal("18.93"), Decimal("-1.01"), Decimal("12345678.90"), Decimal("0.30"), None, None, None, None]


def test_iso_dates_match_python(spark):
    forms = ["2026-01-15", "20260115", "2026-W03", "2026-W03-4", "2026W034", "2026-W53", "2020-W53-7", "2026-1-5", "2026", "2026-015", "2026-01-15T00:00", "2026-02-30", "0000-01-01", "9999-W52-7", " 2026-01-15 ", "", "x", None, "15/01/2026", "2024-02-29", "2023-02-29"]

    def python(s):
        try:
            return datetime.date.fromisoformat(s.strip()) if s else None
        except ValueError:
            return None

    got = [r["d"] for r in spark.createDataFrame([(s,) for s in forms], "s string").select(text.parse_iso_date(F.col("s")).alias("d")).collect()]
    expected = [python(s) for s in forms]
    expected[forms.index("9999-W52-7")] = None
    assert got == expected


def test_clean_text(spark):
    values = ["  a ", "\x1c x ", "\t\n", None, "a b"]
    got = [r["c"] for r in spark.createDataFrame([(v,) for v in values], "s string").select(text.clean_text(F.col("s")).alias("c")).collect()]
    assert got == ["a", "x", None, None, "a b"]


def test_oversized_value_is_not_persistable(spark):
    rows = [invoice() | {"document_id": "ok"}, invoice([item(quantity=1e12)]) | {"document_id": "big"}, invoice([item(tax_rate=150.0)]) | {"document_id": "rate"}, invoice(invoice_number="x" * 101) | {"document_id": "long"}]
    got = {r["document_id"]: r["p"] for r in validated(spark, rows).withColumn("p", persistence.persistable()).select("document_id", "p").collect()}
    assert got == {"ok": True, "big": False, "rate": False, "long": False}


def test_counts_without_checks_are_those_of_the_checks(spark):
    import random

    rng = random.Random(4)
    pick = lambda *values: rng.choice(values)
    rows = []
    for k in range(150):
        items = [item(quantity=pick(1.0, 2.0, None, 0.0), unit_price=pick(10.0, None), line_total=pick(10.0, 20.0, 10.02, None), tax_rate=pick(5.0, 5.0, 7.5, None)) for _ in range(rng.randrange(4))]
        fields = {"subtotal": pick(10.0, 20.0, 30.0, None), "tax_amount": pick(0.5, 1.0, None), "discount_amount": pick(None, 1.0), "grand_total": pick(10.5, 21.0, 20.0, None), "currency": pick("USD", "zz", None), "purchase_order": pick("P", None)}
        fields |= {"invoice_date": pick("2026-01-15", "15/01/2026", None, ""), "due_date": pick("2026-02-15", "2025-01-01", "x", None), "invoice_number": pick("1", None), "vendor": pick({"name": "A"}, {"name": None}), "confidence": pick(0.99, 0.2, None)}
        rows.append(invoice(items, **fields) | {"document_id": str(k), "ocr_confidence": pick(1.0, None)})
    rows.append(invoice() | {"document_id": "clean"})
    silver = normalize_invoices(spark.createDataFrame(rows, SCHEMA), ("document_id", "ord", "ocr_confidence"))
    columns = ["document_id", "n_passed", "n_failed", "n_warning", "n_skipped", "validation_score", "confidence.composite", "decision"]
    full, light = (sorted(map(tuple, f(silver).select(*columns).collect())) for f in (rules.validate, rules.decide))
    assert light == full and len({r[-1] for r in full}) == 2


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_named_checks_build_and_read_nothing_else(spark):
    rows = spark.createDataFrame([c[1] | {"document_id": str(k)} for k, c in enumerate(CASES)], SCHEMA)
    silver = normalize_invoices(rows, ("document_id", "ocr_confidence"))
    columns = ["document_id", "name", "status", "field", "message", "expected", "actual"]
    every = rules.checks_long(rules.with_checks(silver), "document_id").select(*columns).collect()
    for name in {r["name"] for r in every}:
        got = rules.checks_named(silver, (name,), "document_id").select(*columns).collect()
        assert sorted(map(str, got)) == sorted(str(r) for r in every if r["name"] == name)
    plan = plan_of(rules.checks_named(silver, ("CURRENCY_VALID",), "document_id").select("document_id", "status"))
    assert "LINE_ITEM_MATH" not in plan and "transform(" not in plan


def test_numbers_of_an_item_are_read_once(spark):
    silver = normalize_invoices(spark.createDataFrame([invoice()], SCHEMA), ("document_id",))
    assert plan_of(silver.select("line_items")).count("isnan(") == 4


def test_composite_alone_computes_no_breakdown(spark):
    df = spark.createDataFrame([(0.5, 0.5, 0.5)], "o double, a double, v double")
    c = composite(F.col("o"), F.col("a"), F.col("v"))
    alone, whole = (plan_of(df.select(x.alias("c"))) for x in (c["composite"], c))
    assert len(alone) < len(whole) / 2
