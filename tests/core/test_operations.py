"""Costs, payment terms, stock, the whole chain, raw responses, and the history of queries."""

from __future__ import annotations

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import variant
from ledgerlark.operators import costs, readmodels, stock, terms
from ledgerlark.plans import chain, guard, history, pipeline
from ledgerlark.plans.pipeline import process
from ledgerlark.settings import Settings
from ledgerlark.sources import files, sinks

from .test_rules import invoice

DAY = datetime.date(2026, 1, 20)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Net 30", [("2026-02-19", 100, None, None)]),
        ("NET  45 days", [("2026-03-06", 100, None, None)]),
        ("n/15", [("2026-02-04", 100, None, None)]),
        ("payable within 10 days", [("2026-01-30", 100, None, None)]),
        ("2/10 net 30", [("2026-02-19", 100, 2, "2026-01-30")]),
        ("1.5%/7 n/60", [("2026-03-21", 100, 1.5, "2026-01-27")]),
        ("EOM", [("2026-01-31", 100, None, None)]),
        ("End of month", [("2026-01-31", 100, None, None)]),
        ("net 10 EOM", [("2026-02-10", 100, None, None)]),
        ("2/10 EOM", [("2026-01-31", 100, 2, "2026-01-30")]),
        ("15 MFI", [("2026-02-15", 100, None, None)]),
        ("31st of the following month", [("2026-02-28", 100, None, None)]),
        ("Due on receipt", [("2026-01-20", 100, None, None)]),
        ("C.O.D", [("2026-01-20", 100, None, None)]),
        ("50% in 30 days, 50% in 60 days", [("2026-02-19", 50, None, None), ("2026-03-21", 50, None, None)]),
        ("30% upon receipt; net 30 and net 60", [("2026-01-20", 30, None, None), ("2026-02-19", 35, None, None), ("2026-03-21", 35, None, None)]),
        ("50% net 30, 40% net 60", [("2026-02-19", 100, None, None)]),  # not the whole
        ("net 30, as agreed", [("2026-02-19", 100, None, None)]),  # a part without a date
        ("as agreed", [("2026-02-19", 100, None, None)]),
        ("", [("2026-02-19", 100, None, None)]),
        (None, [("2026-02-19", 100, None, None)]),
    ],
)
def test_terms(spark, text, expected):
    row = spark.createDataFrame([(text, DAY)], "t string, d date").select(F.explode(terms.instalments(F.col("t"), F.col("d"))).alias("i")).select("i.*")
    number = lambda v: None if v is None else float(v)
    assert [(str(r["due"]), float(r["share"]), number(r["discount"]), r["discount_until"] and str(r["discount_until"])) for r in row.collect()] == expected


def test_payment_plan_adds_up(spark):
    rows = [("a", DAY, "net 10, net 20, net 30", Decimal("100.00")), ("b", DAY, "2/10 net 30", Decimal("0.01")), ("c", None, "net 30", Decimal("5")), ("d", DAY, "net 30", None)]
    plan = terms.payment_plan(spark.createDataFrame(rows, "id string, invoice_date date, payment_terms string, grand_total decimal(14,2)"))
    got = sorted((r["id"], r["part"], str(r["amount"]), str(r["discounted"])) for r in plan.collect())
    assert got == [("a", 1, "33.33", "None"), ("a", 2, "33.34", "None"), ("a", 3, "33.33", "None"), ("b", 1, "0.01", "0.01")]
    weeks = {str(r["week"]): (str(r["due"]), r["payments"]) for r in terms.cash_flow(plan, early=True).collect()}
    assert weeks == {"2026-01-26": ("33.34", 2), "2026-02-09": ("33.34", 1), "2026-02-16": ("33.33", 1)}


def test_ranges_of_what_callers_may_ask():
    with pytest.raises(ValueError, match="200 characters"):
        readmodels.history(None, None, search="x" * 201)
    for limit in (0, 26):
        with pytest.raises(ValueError, match="1 to 25"):
            readmodels.recent(None, limit)
    for page, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError, match="page starts at 1"):
            readmodels.history_page(None, page=page, size=size)


def test_costs_by_level(spark):
    rows = [("o1", "v1", "i1", 1000, 0, "0.5"), ("o1", "v1", "i1", 1000, 500, "0.5"), ("o1", None, "i2", None, 1000, "2"), (None, "v1", "i3", 500, 0, None)]
    calls = spark.createDataFrame([(o, DAY, v, i, t, c, p) for o, v, i, t, c, p in rows], "organization_id string, day date, vendor string, invoice_id string, tokens long, cached_tokens long, price_per_1k string")
    found = {(r["level"], r["organization_id"], r["vendor"], r["invoice_id"]): (r["calls"], r["invoices"], float(r["cost"]), float(r["saved"])) for r in costs.cost_report(calls).collect()}
    assert found[("all", None, None, None)] == (4, 3, 1.0, 2.25)
    assert found[("organization", "o1", None, None)] == (3, 2, 1.0, 2.25) and found[("organization", None, None, None)] == (1, 1, 0.0, 0.0)
    assert found[("vendor", "o1", None, None)] == (1, 1, 0.0, 2.0) and found[("invoice", "o1", "v1", "i1")] == (2, 1, 1.0, 0.25)
    assert {k[0] for k in found} == set(costs.LEVELS) and costs.cost_report(calls.limit(0)).where("level <> 'all'").count() == 0


def test_running_stock(spark):
    moves = [("p", "2026-01-30", 5.0), ("p", "2026-03-02", -2.0), ("p", "2026-03-02", 1.0), ("p", "2026-01-30", None), ("q", "2026-02-01", 1.5), (None, "2026-02-01", 1.0), ("p", None, 1.0)]
    found = stock.running_stock(spark.createDataFrame(moves, "product string, day string, quantity double").withColumn("day", F.col("day").cast("date")))
    days = {(r["product"], str(r["day"])): (float(r["moved"]), float(r["stock"])) for r in found.collect()}
    assert len(days) == 32 + 1 and days[("q", "2026-02-01")] == (1.5, 1.5)
    assert days[("p", "2026-01-30")] == (5.0, 5.0) and days[("p", "2026-02-14")] == (0.0, 5.0) and days[("p", "2026-03-01")] == (0.0, 5.0) and days[("p", "2026-03-02")] == (-1.0, 4.0)


def test_responses_without_parsed(spark):
    texts = [
        {"id": "r", "z": {"b": 1, "a": [1, {"x": None}]}, "choices": [{"index": 0, "message": {"role": "assistant", "content": "é\n", "parsed": {"k": 1}}}, {"message": None}, "odd", {"message": {"content": None}}]},
        {"choices": []},
        {"id": 1.5},
    ]
    rows = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(texts)] + [(8, "no json"), (9, None), (10, "[1]")], "k int, t string")
    got = {r["k"]: r["v"] for r in rows.select("k", variant.without_parsed(F.col("t")).alias("v")).collect()}
    texts[0]["choices"][0]["message"].pop("parsed")
    assert [json.loads(got[k]) for k in range(3)] == texts
    assert got[8] is got[9] is got[10] is None
    fields = rows.where("k = 0").select(variant.field(F.col("t"), "$.z.b", "int").alias("b"), variant.field(F.col("t"), "$.id", "int").alias("id")).first()
    assert tuple(fields) == (1, None)


UPLOADS = "document_id string, ord long, filename string, content_type string, file_size_bytes long, file_hash string"
TEXTS = "document_id string, text string, source_type string, page_count int, mean_confidence double, duration_ms int, error string"
ANSWERS = "document_id string, response string, request_id string, model string, finish_reason string, input_tokens int, output_tokens int, latency_ms int, refusal string, http_status int, fault string"


def chain_parts(spark):
    uploads = [(f"d{k}", k, f"f{k}.pdf", "application/pdf" if k != 8 else "text/plain", 5000, "same" if k in (1, 9) else f"h{k}") for k in range(10)]
    texts = [("d0", "text", "ocr", 1, 0.91234, 7, None), ("d1", "text", "digital_pdf", 2, 1.0, 8, None), ("d2", None, None, None, None, None, "broken file"), ("d3", "  ", "ocr", 1, 0.0, 1, None), *((f"d{k}", "x" * 30000, "ocr", 1, 0.5, 1, None) for k in (5, 6, 7))]
    record = {k: v for k, v in invoice().items() if k not in ("document_id", "ord", "ocr_confidence")}
    answer = json.dumps({"id": "r", "choices": [{"message": {"content": json.dumps(record, default=float), "parsed": record}}]}, default=float)
    answers = [("d0", answer, "r0", "gpt-4o-mini", "stop", 1000, 100, 20, None, 200, None), ("d1", answer, "r1", "local", "stop", 1, 1, 5, None, 200, None), ("d5", None, None, None, None, None, None, None, None, 429, None), ("d6", answer, "r6", "m", "length", 1, 1, 1, None, 200, None)]
    frames = (spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(texts, TEXTS))
    calls = []

    def model(asked):
        calls.append(asked.count())
        return asked.select("document_id").join(spark.createDataFrame(answers, ANSWERS), "document_id")

    return frames, model, calls


def logged(tables):
    return {(r["document_id"], r["stage"]): (r["status"], json.loads(r["payload"]), r["duration_ms"]) for r in tables["processing_logs"].collect()}


def test_chain_from_uploads_to_invoices(spark, tmp_path):
    (uploads, texts), model, calls = chain_parts(spark)
    tables = chain.run_chain(uploads, texts, model, str(tmp_path / "run"))
    logs = logged(tables)
    assert {d for d, s in logs if s == "UPLOAD"} == {f"d{k}" for k in range(8)}
    assert logs[("d0", "TEXT_EXTRACTION")] == ("SUCCESS", {"source_type": "ocr", "page_count": 1, "mean_confidence": 0.9123, "text_chars": 4}, 7)
    errors = {k: v[1]["error_code"] for k, v in logs.items() if v[0] == "FAILURE"}
    text, ai = "TEXT_EXTRACTION", "AI_STRUCTURING"
    assert errors == {("d2", text): "ERR_OCR_FAILED", ("d3", text): "ERR_OCR_FAILED", ("d4", text): "ERR_OCR_FAILED", ("d5", ai): "ERR_LLM_RATE_LIMITED", ("d6", ai): "ERR_LLM_INVALID_RESPONSE", ("d7", ai): "ERR_LLM_UNAVAILABLE"}
    status, payload, ms = logs[("d0", ai)]
    assert (status, ms, payload["total_tokens"], payload["prompt_version"], payload["ocr_text_truncated"], payload["model"]) == ("SUCCESS", 20, 1100, "v1", False, "gpt-4o-mini")
    assert abs(payload["estimated_cost_usd"] - 0.00021) < 1e-12 and logs[("d1", ai)][1]["estimated_cost_usd"] is None
    assert {d for d, s in logs if s == "PERSISTENCE"} == {"d0", "d1"} == {r["document_id"] for r in tables["invoices"].collect()}
    states = {r["document_id"]: r["status"] for r in tables["status"].collect()}
    assert len(states) == tables["status"].count() == 8 and {d for d, s in states.items() if s == "FAILED"} == {"d2", "d3", "d4", "d5", "d6", "d7"}
    assert {(r["document_id"], r["error_code"], r["duplicate_of"]) for r in tables["rejected"].collect()} == {("d8", "ERR_UNSUPPORTED_FORMAT", None), ("d9", "ERR_DUPLICATE_DOCUMENT", "d1")}
    assert all("parsed" not in json.loads(r["raw_extraction_json"])["choices"][0]["message"] for r in tables["extractions"].collect())


def test_chain_stores_texts_once(spark, tmp_path):
    (uploads, texts), model, _ = chain_parts(spark)
    tables = chain.run_chain(uploads, texts, model, str(tmp_path / "run"))
    assert not {"text", "prompt"} & set(spark.read.parquet(str(tmp_path / "run" / "ai_structuring")).columns)
    assert {(r["document_id"], r["text"]) for r in tables["extractions"].collect()} == {("d0", "text"), ("d1", "text")}
    files_ = [f.name for f in (tmp_path / "run").rglob("*.parquet")]
    assert files_ and all(".zstd." in f for f in files_)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chain_reads_texts_for_the_prompts_alone(spark, tmp_path):
    (uploads, texts), model, _ = chain_parts(spark)
    chain.run_chain(uploads, texts, model, str(tmp_path / "run"), end="TEXT_EXTRACTION")
    stored = spark.read.parquet(str(tmp_path / "run" / "text_extraction")).where("error is null")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], ANSWERS).schema if f.name not in ("document_id", "input_tokens")]
    rows = chain.structure(stored, lambda asked: asked.select("document_id", F.length("prompt").alias("input_tokens"), *empty), Settings())
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    try:
        read = [x.split(">")[0] for x in plan_of(rows).split("ReadSchema: struct<")[1:]]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted("text:string" in x for x in read) == [False, True]
    got = {r["document_id"]: (r["truncated"], r["input_tokens"]) for r in rows.collect()}
    assert {d: t for d, (t, _) in got.items()} == {"d0": False, "d1": False, "d5": True, "d6": True, "d7": True}
    assert got["d5"][1] - got["d0"][1] == 24000 - len("text")


def test_chain_judges_an_upload_once(spark, tmp_path):
    (uploads, texts), model, _ = chain_parts(spark)
    uploads.write.parquet(str(tmp_path / "uploads"))
    seen = []
    stored = spark.createDataFrame([("old", "h5")], "id string, file_hash string")

    def judged(*args):
        seen.append(pipeline.judged(*args))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(chain, "judged", judged)
        tables = chain.run_chain(spark.read.parquet(str(tmp_path / "uploads")), texts, model, str(tmp_path / "run"), stored=stored, end="UPLOAD")
    assert plan_of(seen[0]).count("FileScan parquet") == 3  # the firsts of the hashes, the rows, and those that the gate refuses
    rejected = {(r["document_id"], r["error_code"], r["duplicate_of"]) for r in tables["rejected"].collect()}
    assert rejected == {("d8", "ERR_UNSUPPORTED_FORMAT", None), ("d9", "ERR_DUPLICATE_DOCUMENT", "d1"), ("d5", "ERR_DUPLICATE_DOCUMENT", "old")}
    assert {r["document_id"] for r in tables["status"].collect()} == {f"d{k}" for k in (0, 1, 2, 3, 4, 6, 7)}


def test_chain_neither_sorts_nor_broadcasts_texts(spark):
    (uploads, texts), _, _ = chain_parts(spark)
    plan = plan_of(chain.extract(uploads, texts))
    assert "ShuffledHashJoin" in plan and "BuildLeft" in plan
    assert "SortMergeJoin" not in plan and "BroadcastExchange" not in plan


def test_chain_builds_checks_for_the_logs_alone(spark, tmp_path):
    (uploads, texts), model, _ = chain_parts(spark)
    tables = chain.run_chain(uploads, texts, model, str(tmp_path / "run"))
    stored = spark.read.parquet(str(tmp_path / "run" / "validation"))
    assert {"decision", "confidence", "line_items"} <= set(stored.columns) and not {"checks", "review_reasons"} & set(stored.columns)
    good = spark.read.parquet(str(tmp_path / "run" / "ai_structuring")).where("error is null").withColumn("ocr_confidence", F.col("mean_confidence"))
    plain = logged(process(good))
    assert plain and {k: v for k, v in logged(tables).items() if k[1] in ("VALIDATION", "PERSISTENCE")} == plain
    assert all(v[1]["checks"] for k, v in plain.items() if k[1] == "VALIDATION")


def test_chain_goes_on_from_a_stage(spark, tmp_path):
    (uploads, texts), model, calls = chain_parts(spark)
    first = logged(chain.run_chain(uploads, texts, model, str(tmp_path / "run")))
    nothing = uploads.limit(0)
    for start, asked in (("AI_STRUCTURING", 2), ("VALIDATION", 2)):
        again = chain.run_chain(nothing, texts.limit(0), model, str(tmp_path / "run"), start=start)
        assert logged(again) == first and len(calls) == asked
    early = chain.run_chain(uploads, texts, model, str(tmp_path / "early"), end="TEXT_EXTRACTION")
    assert len(calls) == 2 and set(early) == {"rejected", "processing_logs", "status"}
    assert {r["document_id"] for r in early["status"].where("status = 'OCR_COMPLETED'").collect()} == {"d0", "d1", "d5", "d6", "d7"}
    with pytest.raises(ValueError, match="no such stage"):
        chain.run_chain(uploads, texts, model, str(tmp_path / "run"), start="OCR")


def test_larger_model_answers_what_the_small_one_could_not(spark, tmp_path):
    (uploads, texts), model, calls = chain_parts(spark)
    good = model(uploads.select("document_id")).where("document_id = 'd0'").first()
    asked = []

    def large(prompts):
        asked.extend(r["document_id"] for r in prompts.collect())
        rows = [(d, *list(good)[1:3], "gpt-4o", *list(good)[4:]) for d in asked]
        return spark.createDataFrame(rows, ANSWERS)

    tables = chain.run_chain(uploads, texts, chain.tiered(model, large), str(tmp_path / "run"))
    assert asked == ["d6"]
    assert {r["document_id"]: r["model"] for r in tables["extractions"].collect()} == {"d0": "gpt-4o-mini", "d1": "local", "d6": "gpt-4o"}
    errors = {r["document_id"] for r in tables["processing_logs"].where("stage = 'AI_STRUCTURING' and status = 'FAILURE'").collect()}
    assert errors == {"d5", "d7"}


def test_history_of_questions(spark, tmp_path):
    spark.range(5).createOrReplaceTempView("numbers_view")
    path = str(tmp_path / "asked")
    assert len(history.ask(spark, "how many?", "SELECT id FROM numbers_view", {"numbers_view"}, path)) == 5
    with pytest.raises(guard.Refused):
        history.ask(spark, "drop it", "DROP TABLE x", {"numbers_view"}, path)
    with pytest.raises(Exception, match="UNRESOLVED"):
        history.ask(spark, "how many?", "SELECT nothing FROM numbers_view", {"numbers_view"}, path)
    rows = {(r["question"], r["outcome"], r["n_rows"]) for r in spark.read.parquet(path).collect()}
    assert rows == {("how many?", "ANSWERED", 5), ("drop it", "REFUSED", 0), ("how many?", "FAILED", 0)}
    assert {(r["question"], r["asked"], r["answered"]) for r in history.questions(spark, path).collect()} == {("how many?", 1, 1), ("drop it", 1, 0), ("how many?", 1, 0)}


def test_history_of_queries(spark, tmp_path):
    path = str(tmp_path / "ran")
    with history.QueryHistory(spark, path) as log:
        assert spark.range(7).where("id > 3").count() == 3
        with pytest.raises(Exception, match="boom"):
            spark.range(1).select(F.raise_error(F.lit("boom"))).collect()
        assert log.flush() >= 2
    spark.range(3).count()
    rows = spark.read.parquet(path).collect()
    assert {"OK", "FAILED"} == {r["outcome"] for r in rows} and any("boom" in (r["detail"] or "") for r in rows)
    assert any("Filter" in r["plan"] and r["ms"] is not None for r in rows) and not any("ran" in r["plan"] and path in r["plan"] for r in rows)


def test_terms_are_read_once(spark):
    rows = spark.createDataFrame([("a", datetime.date(2026, 1, 31), "50% in 30 days, 50% in 60 days", Decimal("10.01")), ("b", None, "Net 30", Decimal("1.00"))], "id string, invoice_date date, payment_terms string, grand_total decimal(14,2)")
    plan = terms.payment_plan(rows)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [(r["part"], str(r["due"]), str(r["amount"])) for r in plan.orderBy("part").collect()] == [(1, "2026-03-02", "5.01"), (2, "2026-04-01", "5.00")]


def test_annotations_are_stored_compressed(spark, tmp_path):
    rows = spark.range(200).selectExpr("cast(id as string) as document_id", "array(named_struct('text', repeat('word ', 200))) as annotations")
    sinks.store_annotations(rows, str(tmp_path / "a"))
    assert sum(f.stat().st_size for f in (tmp_path / "a").glob("part-*")) < 200 * 1000 / 4
    assert files.annotations(spark, str(tmp_path / "a")).where("annotations[0].text like 'word word%'").count() == 200
