"""Intake, vendors, the batch pipeline, read models, exports, sources, guard and streams."""

from __future__ import annotations

import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from ledgerlark import envelope, schemas
from ledgerlark.functions import numbers, text
from ledgerlark.operators import analytics, exports, intake, ocr, readmodels, vendors
from ledgerlark.plans import guard, pipeline
from ledgerlark.settings import listed
from ledgerlark.sources import files, sinks
from ledgerlark.streaming import jobs

from .test_rules import SCHEMA, invoice, item


def test_gate(spark):
    rows = [(1, "application/pdf; q=1", 2048), (2, "text/html", 10), (3, "image/png", 10), (4, "IMAGE/JPEG", 30 * 2**20), (5, None, 2048)]
    got = {r["id"]: r for r in intake.gate(spark.createDataFrame(rows, "id int, content_type string, file_size_bytes long")).collect()}
    assert [got[k]["error_code"] for k in range(1, 6)] == [None, "ERR_UNSUPPORTED_FORMAT", "ERR_EMPTY_FILE", "ERR_FILE_TOO_LARGE", "ERR_UNSUPPORTED_FORMAT"]
    assert got[4]["error_message"] == "File size 30.0 MB exceeds the 25 MB limit."


def test_first_by_hash(spark):
    batch = spark.createDataFrame([("a", "h1", 1), ("b", "h1", 2), ("c", "h2", 3), ("d", "h3", 4)], "document_id string, file_hash string, ord long")
    stored = spark.createDataFrame([("old", "h2")], "id string, file_hash string")
    got = {r["document_id"]: r["duplicate_of"] for r in intake.first_by_hash(batch, stored).collect()}
    assert got == {"a": None, "b": "a", "c": "old", "d": None}


def test_vendor_upsert(spark):
    cols = "ord long, vendor_name string, vendor_tax_id string, vendor_address string, vendor_phone string, vendor_email string"
    rows = [(1, "Acme", "T1", None, None, "a@x"), (2, "Acme Ltd", "T1", "Street", None, "b@x"), (3, "Acme", None, None, None, None), (4, None, "T9", None, None, None), (5, "Acme", None, "Road", None, None)]
    got = {r["vendor_key"]: r for r in vendors.upsert(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {"T:T1", "N:Acme"}
    assert (got["T:T1"]["name"], got["T:T1"]["address"], got["T:T1"]["email"]) == ("Acme", "Street", "a@x")
    stored = spark.createDataFrame([("v1", "Old Name", "T1", None, "p", None)], "id string, name string, tax_id string, address string, phone string, email string")
    merged = {r["vendor_key"]: r for r in vendors.upsert(spark.createDataFrame(rows, cols), stored).collect()}
    assert (merged["T:T1"]["id"], merged["T:T1"]["name"], merged["T:T1"]["address"], merged["T:T1"]["phone"], merged["T:T1"]["created"]) == ("v1", "Old Name", "Street", "p", False)


def test_pipeline_batch(spark):
    rows = [invoice() | {"document_id": "a", "ord": 1}, invoice([item(unit_price=5.0)]) | {"document_id": "b", "ord": 2}, invoice([item(quantity=1e12)], vendor={"name": "Big", "tax_id": "X"}) | {"document_id": "c", "ord": 3}]
    out = pipeline.process(spark.createDataFrame(rows, SCHEMA))
    assert {r["document_id"]: r["status"] for r in out["status"].collect()} == {"a": "COMPLETED", "b": "REVIEW_REQUIRED", "c": "FAILED"}
    assert out["invoices"].count() == 2 and out["vendors"].count() == 1
    again = pipeline.process(spark.createDataFrame(rows, SCHEMA))
    assert sorted(out["invoice_items"].collect()) == sorted(again["invoice_items"].collect())
    logs = {(r["document_id"], r["stage"]): r for r in out["processing_logs"].collect()}
    assert json.loads(logs["a", "PERSISTENCE"]["payload"])["final_status"] == "COMPLETED"
    assert logs["c", "PERSISTENCE"]["status"] == "FAILURE"
    report = json.loads(logs["b", "VALIDATION"]["payload"])
    assert report["decision"] == "REVIEW_REQUIRED" and report["summary"]["failed"] == 1


def test_sinks_publish_once(spark, tmp_path):
    df = spark.range(3).withColumn("x", F.lit("y"))
    for _ in range(2):
        sinks.write_batch({"t": df}, str(tmp_path), "b1")
    df.write.parquet(f"{tmp_path}/t/batch=unpublished")
    assert sinks.read_table(spark, str(tmp_path), "t").count() == 3


def _detail(spark):
    inv = spark.createDataFrame(
        [("0123456789", "d1", "v1", "INV/2026 #42*", "2026-03-31", "2026-04-30", "38.90", "7.78", "0.00", "46.68", "USD", "Shown", "T", None, "VALIDATED", "0.9840"), ("abcdefghij", "d2", None, None, None, None, None, None, "0.00", None, None, None, None, None, "REVIEW_REQUIRED", None)],
        "id string, document_id string, vendor_id string, invoice_number string, invoice_date string, due_date string, subtotal string, tax_amount string, discount_amount string, grand_total string, currency string, vendor_name string, vendor_tax_id string, vendor_address string, status string, composite_confidence string",
    )
    for c in ("subtotal", "tax_amount", "discount_amount", "grand_total"):
        inv = inv.withColumn(c, F.col(c).cast("decimal(14,2)"))
    inv = inv.withColumns({"invoice_date": F.col("invoice_date").cast("date"), "due_date": F.col("due_date").cast("date"), "composite_confidence": F.col("composite_confidence").cast("decimal(5,4)"), "extraction_model": F.lit("gpt-4o-mini"), "created_at": F.lit("2026-04-01 10:00:00").cast("timestamp")})
    items = spark.createDataFrame([("i2", "0123456789", 'MODELO "24", can', "2", "18.5", "37.00", None, None, 1), ("i1", "0123456789", "COORS LIGHT 2/12/12 CAN", "3", "21.95", "65.85", "6", "0071990030", 0)], "id string, invoice_id string, description string, quantity string, unit_price string, line_total string, tax_rate string, product_sku string, sort_order int")
    for c, kind in (("quantity", "decimal(12,4)"), ("unit_price", "decimal(14,4)"), ("line_total", "decimal(14,2)"), ("tax_rate", "decimal(6,4)")):
        items = items.withColumn(c, F.col(c).cast(kind))
    ven = spark.createDataFrame([("v1", "Vendor Row", "T", None, "1", None)], "id string, name string, tax_id string, address string, phone string, email string")
    logs = spark.createDataFrame([], schemas.LOGS)
    return readmodels.invoice_detail(inv, items, ven, logs).withColumn("filename", F.lit("f.pdf")).withColumn("source_type", F.lit("ocr"))


def test_export_json_and_text(spark):
    rows = {r["id"]: r for r in _detail(spark).select("id", exports.export_json().alias("j"), exports.export_text().alias("t")).collect()}
    doc = json.loads(rows["0123456789"]["j"])
    assert doc["vendor"] == {"name": "Vendor Row", "tax_id": "T", "address": None, "phone": "1", "email": None}
    assert [i["position"] for i in doc["line_items"]] == [1, 2] and doc["line_items"][0]["sku_upc"] == "0071990030"
    assert doc["invoice"]["totals"]["grand_total"] == 46.68 and doc["validation"]["review_required"] is False
    lines = rows["0123456789"]["t"].split("\n")
    assert lines[:6] == ["Vendor", "------", "Vendor Row", "", "Invoice Number:", "INV/2026 #42*"]
    assert "46.68 USD" in lines and "98.4%" in lines and lines[-3:] == ["Review Required:", "No", ""]
    empty = rows["abcdefghij"]["t"]
    assert "Grand Total:\n—\n" in empty and empty.endswith("Review Required:\nYes\n")


def test_export_csv(spark, tmp_path):
    exports.write_items_csv(_detail(spark), str(tmp_path / "csv"))
    part = next((tmp_path / "csv" / "invoice_id=0123456789").glob("*.csv"))
    raw = part.read_bytes().decode()
    rows = list(csv.reader(io.StringIO(raw)))
    assert "\r\n" in raw and rows[0] == list(exports.CSV_HEADERS)
    assert rows[1] == ["COORS LIGHT 2/12/12 CAN", "3.0", "21.95", "65.85", "6.0", "0071990030"]
    assert rows[2] == ['MODELO "24", can', "2.0", "18.5", "37.0", "", ""]


def test_filenames(spark):
    rows = [("INV-2026-0042", "0123456789"), ("INV/2026 #42*", "0123456789"), (None, "0123456789"), ("***", "0123456789")]
    got = [r["f"] for r in spark.createDataFrame(rows, "n string, i string").select(text.file_stem(F.col("n"), F.col("i")).alias("f")).collect()]
    assert got == ["invoice_INV-2026-0042", "invoice_INV-2026-42", "invoice_01234567", "invoice_01234567"]
    with pytest.raises(ValueError):
        exports.export_filename(F.lit("a"), F.lit("b"), "xml")


def test_costs(spark):
    rows = [("gpt-4o-mini", 1000000, 1000000), ("gpt-4o-mini-2024-07-18", 1000000, 0), ("mystery", 1, 1), ("gpt-4o", 0, 0)]
    got = [r["c"] for r in spark.createDataFrame(rows, "m string, i long, o long").select(numbers.estimated_cost(F.col("m"), F.col("i"), F.col("o")).alias("c")).collect()]
    assert got == [0.75, 0.15, None, 0.0]


def test_text_budget(spark):
    got = spark.createDataFrame([("x" * 24000,), ("x" * 24001,), (None,)], "t string").select(text.fit_budget(F.col("t")).alias("f")).collect()
    assert [(len(r["f"]["text"] or ""), r["f"]["truncated"]) for r in got] == [(24000, False), (24000, True), (0, False)]


def test_characters_are_counted_by_bytes_only_where_they_are_as_many(spark):
    texts = ["", "plain " * 9, "é" * 12, "tail é", "\U0001f600 and more, é", "x" * 30 + "é", " ", "\n" * 20]
    raw = [bytearray(t.encode()) for t in texts] + [bytearray(b"\xff\x80 not valid \xe2\x82"), None]
    rows = spark.createDataFrame([(r,) for r in raw], "b binary").select(F.col("b").cast("string").alias("t"))
    n = text.char_count(F.col("t"))
    assert rows.where(~n.eqNullSafe(F.length("t"))).count() == 0
    cut = text.first_chars(F.col("t"), 5, n)
    assert rows.where(F.length("t") > 5).where(~cut.cast("binary").eqNullSafe(F.substring("t", 1, 5).cast("binary"))).count() == 0
    long = spark.createDataFrame([("é" * 24001,), ("x" * 24000 + "é",)], "t string").withColumn("n", F.length("t"))
    fitted = long.select(text.fit_budget(F.col("t")).alias("a"), text.fit_budget(F.col("t"), chars=F.col("n")).alias("b")).collect()
    assert [r["a"] for r in fitted] == [r["b"] for r in fitted] and {len(r["a"]["text"]) for r in fitted} == {24000}


def _word(w, conf, vertices):
    return {"symbols": [{"text": c} for c in w], "confidence": conf, "boundingBox": None if vertices is None else {"vertices": vertices}}


def test_ocr(spark):
    words = [_word("INV", 0.9, [{"x": 1.0, "y": 2.0}, {"x": 5.0, "y": None}]), _word("", 0.1, None), _word("7", 0.98, None)]
    page = {"text": " Page one ", "pages": [{"blocks": [{"paragraphs": [{"words": words}]}]}]}
    notes = json.dumps([page, {"text": None, "pages": None}, {"text": "Page two", "pages": []}])
    row = ocr.ocr_results(spark.createDataFrame([(1, notes), (2, "[]")], "id int, annotations string")).orderBy("id").collect()
    assert row[0]["text"] == "Page one\n\nPage two" and row[0]["page_count"] == 3
    assert [tuple(t) for t in row[0]["tokens"]] == [("INV", 0.9, 1.0, 0.0, 5.0, 2.0, 0), ("7", 0.98, 0.0, 0.0, 0.0, 0.0, 0)]
    assert row[0]["mean_confidence"] == pytest.approx(0.94) and row[1]["mean_confidence"] == 0.0


def test_text_layers_and_models(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|| two ")
    (tmp_path / "b.pdf").write_bytes(b"|||late")
    (tmp_path / "c.pdf").write_bytes(b"broken")

    def make_reader():
        def read(content):
            if content == b"broken":
                raise ValueError("corrupt")
            return content.decode().split("|")

        return read

    raw = files.raw_files(spark, str(tmp_path), "*.pdf")
    got = {r["path"][-5:]: r for r in files.read_text_layers(raw, make_reader).collect()}
    assert (got["a.pdf"]["text"], got["a.pdf"]["page_count"], got["a.pdf"]["digital"]) == ("one\n\ntwo", 3, True)
    assert got["b.pdf"]["digital"] is False and got["c.pdf"]["error"] == "corrupt"

    texts = spark.createDataFrame([("d", "hello", "ocr")], "document_id string, text string, source_type string")
    prompt = files.prompts(texts)
    assert "(extraction method: ocr)" in prompt.first()["prompt"]

    def make_model():
        return lambda system, user: (json.dumps({"invoice_number": "N1", "line_items": []}), "gpt-4o-mini", "stop", 10, 5)

    parsed = files.parse_extractions(files.structure_texts(prompt, make_model, "system")).first()
    assert parsed["invoice_number"] == "N1" and parsed["input_tokens"] == 10


def test_registry():
    r = files.Registry("provider", planned=("cloud",))
    r.add("local", 1)
    assert r.get("local") == 1
    with pytest.raises(NotImplementedError):
        r.get("cloud")
    with pytest.raises(KeyError):
        r.get("other")


def test_history_search_keeps_wildcards(spark):
    docs = spark.createDataFrame([("1", "a_b.pdf", "FAILED"), ("2", "axb.pdf", "COMPLETED")], "id string, filename string, status string").withColumn("source_type", F.lit("ocr")).withColumn("created_at", F.lit(None).cast("timestamp"))
    inv = spark.createDataFrame([], schemas.INVOICES)
    count = lambda **k: readmodels.history(docs, inv, **k).count()
    assert (count(search="a_b"), count(search="   "), count(search="zz"), count(status="FAILED")) == (2, 2, 0, 1)
    with pytest.raises(ValueError):
        readmodels.history_page(readmodels.history(docs, inv), size=101)


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("allowed_view")
    assert guard.guarded(spark, "with q as (select id from allowed_view) select count(*) from q", {"allowed_view"}).first()[0] == 5
    for bad in ("drop table allowed_view", "select 1; select 2", "select * from other_table", "insert into allowed_view select 1"):
        with pytest.raises(guard.Refused):
            guard.guarded(spark, bad, {"allowed_view"})
    assert len(guard.collect_within(spark.range(5), 30)) == 5


def test_envelopes():
    assert envelope.success({"a": 1})["success"] is True
    assert envelope.failure("ERR_NOT_FOUND", "gone")["error"]["http_status"] == 404
    assert envelope.failure("boom", "x", {"secret": 1})["error"]["detail"] is None
    assert listed(" a, ,b ") == ("a", "b")


def test_stream_equals_batch(spark, tmp_path):
    rows = [invoice() | {"document_id": f"d{k}", "ord": k} for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("file_hash", F.when(F.col("ord") == 3, "h0").otherwise(F.concat(F.lit("h"), F.col("ord").cast("string"))))
    df.coalesce(1).write.json(str(tmp_path / "landing"))
    query = jobs.run_intake(jobs.landing(spark, str(tmp_path / "landing")), str(tmp_path / "gold"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    got = {r["document_id"] for r in sinks.read_table(spark, str(tmp_path / "gold"), "invoices").collect()}
    assert got == {"d0", "d1", "d2"}


def test_stream_alerts(spark, tmp_path):
    logs = spark.createDataFrame([("2026-01-01 00:10:00", "FAILURE"), ("2026-01-01 00:20:00", "SUCCESS"), ("2026-01-01 05:00:00", "SUCCESS")], "created_at string, status string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    logs.coalesce(1).write.parquet(str(tmp_path / "logs"))
    stream = jobs.failure_alerts(spark.readStream.schema(logs.schema).parquet(str(tmp_path / "logs")))
    query = stream.writeStream.format("memory").queryName("alerts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["n"], r["bad"], r["alert"]) for r in spark.table("alerts").collect()} == {(2, 1, True), (1, 0, False)}


def test_corrections(spark):
    inv = spark.createDataFrame([("1", "A", "REVIEW_REQUIRED"), ("2", "B", "REVIEW_REQUIRED")], "id string, vendor_name string, status string")
    fix = spark.createDataFrame([("1", True, "A2")], "id string, approved boolean, vendor_name string")
    got = {r["id"]: (r["vendor_name"], r["status"]) for r in analytics.corrected(inv, fix, ("vendor_name",)).collect()}
    assert got == {"1": ("A2", "VALIDATED"), "2": ("B", "REVIEW_REQUIRED")}


def test_fixed_rounds_by_the_exact_value(spark):
    from decimal import ROUND_HALF_UP, Decimal

    values = [0.0, 0.25, 0.05, 0.15, 0.35, 1.005, 1.25, 1.35, 2.675, 8.345, 10.25, 99.95, 999.95, 1.45, 1234567.125, 0.125, 0.375, -0.25, -0.04, 1e9 + 0.05]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.fixed(F.col("v"), 1).alias("one"), text.fixed(F.col("v"), 2).alias("two")).collect()
    exact = lambda v, q: ("-" if v < 0 else "") + str(abs(Decimal(v)).quantize(Decimal(q), ROUND_HALF_UP))
    assert [(r["one"], r["two"]) for r in rows] == [(exact(v, "0.1"), exact(v, "0.01")) for v in values]


def test_stream_keeps_known_vendors(spark, tmp_path):
    """A vendor of an earlier micro-batch keeps its id and contacts and isn't created again."""
    for k, phone in enumerate(("1", None, "3")):
        row = invoice(vendor={"name": "Acme", "tax_id": "T1", "phone": phone}) | {"document_id": f"d{k}", "ord": k}
        spark.createDataFrame([row], SCHEMA).withColumn("file_hash", F.lit(f"h{k}")).coalesce(1).write.mode("append").json(str(tmp_path / "landing"))
        jobs.run_intake(jobs.landing(spark, str(tmp_path / "landing")), str(tmp_path / "gold"), str(tmp_path / "ck")).awaitTermination(120)
    got = [sinks.read_latest(spark, str(tmp_path / "gold"), "vendors", before).collect() for before in (f"{1:012d}", f"{2:012d}", None)]
    assert [(len(v), v[0]["created"], v[0]["phone"]) for v in got] == [(1, True, "1"), (1, False, "1"), (1, False, "1")]
    assert len({v[0]["id"] for v in got}) == 1
    assert sinks.read_latest(spark, str(tmp_path / "none"), "vendors") is None


def test_text_layers_hold_few_files_at_once(spark, tmp_path):
    log = tmp_path / "log"

    def make_reader():
        def read(content):
            with open(log, "a") as f:
                f.write("x")
            return [content.decode()]

        return read

    rows = spark.range(5000).selectExpr("cast(id as string) as path", "encode(repeat('y', 20000), 'UTF-8') as content").coalesce(1)
    assert files.read_text_layers(rows, make_reader).limit(1).count() == 1
    assert log.stat().st_size < 5000
