"""The whole chain from uploads to stored invoices, a checkpoint a stage: it can go on from any stage.

Each stage gives its rows an ``error`` (code and detail, null for good rows). Good rows go on; others end with a failed
status and a failure log, and cost later stages nothing. A stage's rows are written once under the chain's folder and read
again by what follows, so a rerun from a stage reads what the stage before left, and gives the same ids. Texts are
stored by their own stage alone: later stages read them there and store neither texts nor prompts again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import STAGES
from ..functions.numbers import estimated_cost
from ..functions.text import char_count
from ..functions.variant import without_parsed
from ..operators import persistence
from ..settings import Settings
from ..sources import files
from .pipeline import judged, process

UPLOAD, TEXT, AI, VALIDATION, PERSISTENCE = STAGES


def failed(code: str, detail: Column) -> Column:
    """The error of a row whose ``detail`` says what went wrong; null without detail."""
    return F.when(detail.isNotNull(), F.struct(F.lit(code).alias("code"), detail.alias("detail")))


def extract(uploads: DataFrame, texts: DataFrame) -> DataFrame:
    """Uploads with ``texts(document_id, text, source_type, page_count, mean_confidence, duration_ms, error)``.

    No row of texts, or an empty text, is an error like one that the reader met.
    """
    # Uploads are hashed: to merge them, texts would be sorted, and a table of long texts looks small enough to broadcast.
    rows = uploads.hint("shuffle_hash").join(texts.withColumnRenamed("error", "_why").withColumn("_there", F.lit(True)), "document_id", "left")
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    why = F.when(F.col("_there").isNull(), "No extraction result.").otherwise(F.coalesce("_why", F.when(empty, "No text found on the document.")))
    return rows.withColumn("error", failed("ERR_OCR_FAILED", why)).withColumn("text_chars", char_count(F.col("text"))).drop("_why", "_there")


def provider_error(status: Column, fault: Column, finish: Column, refusal: Column, parsed: Column) -> Column:
    """The error of a call by what the provider did: refused access, too many calls, no answer in time, no usable answer."""
    http = F.concat(F.lit("OpenAI API returned HTTP "), status.cast("string"), F.lit("."))
    case = lambda code, text: F.struct(F.lit(code).alias("code"), (F.lit(text) if isinstance(text, str) else text).alias("detail"))
    return (
        F.when(status.isin(401, 403), case("ERR_LLM_AUTH_FAILED", http))
        .when(status == 429, case("ERR_LLM_RATE_LIMITED", http))
        .when(fault == "timeout", case("ERR_LLM_TIMEOUT", "The AI provider did not answer in time."))
        .when(fault.isNotNull(), case("ERR_LLM_UNAVAILABLE", fault))
        .when(status != 200, case("ERR_AI_STRUCTURING_FAILED", http))
        .when(finish == "length", case("ERR_LLM_INVALID_RESPONSE", "AI response was truncated before completing the invoice schema."))
        .when(finish == "content_filter", case("ERR_LLM_INVALID_RESPONSE", "AI response was blocked by the provider's content filter."))
        .when(refusal.isNotNull(), case("ERR_LLM_INVALID_RESPONSE", "The AI provider refused to process this document."))
        .when(~F.coalesce(parsed, F.lit(False)), case("ERR_LLM_INVALID_RESPONSE", "AI response contained no parsed content."))
    )


def structure(extracted: DataFrame, answer: Callable[[DataFrame], DataFrame], settings: Settings) -> DataFrame:
    """Prompt_version, truncated, what the model answered and the columns of the extracted record in place of the text.

    ``answer`` takes ``(document_id, prompt)`` and gives ``(document_id, response, request_id, model, finish_reason,
    input_tokens, output_tokens, latency_ms, refusal, http_status, fault)``: the whole response as JSON with the record in
    its first message's content; fault is "timeout" or what broke the connection. A document without an answer is one
    that the provider could not be reached for.
    """
    asked = files.prompts(extracted.drop("error"), chars="text_chars")
    said = answer(asked.select("document_id", "prompt")).withColumn("_there", F.lit(True))
    rows = asked.drop("text", "prompt").join(said, "document_id", "left").withColumn("content", F.get_json_object("response", "$.choices[0].message.content"))
    rows = files.parse_extractions(rows, "content").withColumn("prompt_version", F.lit(settings.prompt_version)).withColumn("raw_extraction_json", without_parsed(F.col("response")))
    fault = F.when(F.col("_there").isNull(), "No answer.").otherwise(F.col("fault"))
    parsed = F.from_json("content", "map<string,string>").isNotNull()
    error = provider_error(F.col("http_status"), fault, F.col("finish_reason"), F.col("refusal"), parsed)
    return rows.withColumn("error", error).drop("_there", "content", "response", "fault")


def tiered(small: Callable[[DataFrame], DataFrame], large: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """An ``answer`` that asks the larger model again where the small one's answer is no record of the schema.

    Only such answers go on: refused access, limits and faults of the connection are errors of either model.
    """

    def answer(asked: DataFrame) -> DataFrame:
        said = small(asked)
        parsed = F.from_json(F.get_json_object("response", "$.choices[0].message.content"), "map<string,string>").isNotNull()
        error = provider_error(F.col("http_status"), F.col("fault"), F.col("finish_reason"), F.col("refusal"), parsed)
        again = F.coalesce(error["code"] == "ERR_LLM_INVALID_RESPONSE", F.lit(False))
        retried = asked.join(said.where(again).select("document_id"), "document_id", "left_semi")
        return said.where(~again).unionByName(large(retried))

    return answer


def upload_logs(rows: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("filename", F.col("content_type").alias("mime_type"), "file_size_bytes", "file_hash"))
    return persistence.log_rows(rows, UPLOAD, payload, "Document received and stored.")


def text_logs(rows: DataFrame) -> DataFrame:
    payload = F.to_json(F.struct("source_type", "page_count", F.bround("mean_confidence", 4).alias("mean_confidence"), "text_chars"))
    return persistence.log_rows(rows, TEXT, payload, F.concat(F.lit("Text extracted via "), "source_type", F.lit(".")), duration=F.col("duration_ms"))


def ai_logs(rows: DataFrame, provider: str = "openai") -> DataFrame:
    """Metadata of the call with the prompt's version; the cost is in USD, null for models without a price."""
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    cost = estimated_cost(F.col("model"), F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)))
    call = F.struct(F.lit(provider).alias("provider"), "model", "request_id", "finish_reason", "latency_ms", "input_tokens", "output_tokens", total.alias("total_tokens"), cost.alias("estimated_cost_usd"), "prompt_version", F.col("truncated").alias("ocr_text_truncated"))
    return persistence.log_rows(rows, AI, F.to_json(call, {"ignoreNullFields": "false"}), F.concat(F.lit("Structured by "), "model", F.lit(".")), duration=F.col("latency_ms"))


def run_chain(uploads: DataFrame, texts: DataFrame, answer: Callable[[DataFrame], DataFrame], root: str, settings: Settings | None = None, stored: DataFrame | None = None, stored_vendors: DataFrame | None = None, start: str = UPLOAD, end: str = PERSISTENCE) -> dict[str, DataFrame]:
    """Tables of a batch: those of ``process`` with all logs and statuses, ``extractions`` (texts and raw responses), ``rejected``.

    ``uploads(document_id, ord, filename, content_type, file_size_bytes, file_hash)``; ``root``: a shared folder of this
    batch. ``start`` is the stage to go on from: what stages before it left in ``root`` is read, not made again. ``end`` is
    the stage to stop after; good rows then have the status that the next stage begins with, and tables of later stages
    are not there (validation and persistence go together).
    """
    s, spark = settings or Settings(), uploads.sparkSession
    if unknown := {start, end} - set(STAGES):
        raise ValueError(f"no such stage: {sorted(unknown)}")
    last = STAGES.index(end)

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{root}/{name.lower()}"
        if STAGES.index(name) >= STAGES.index(start):
            make().write.mode("overwrite").option("compression", "zstd").parquet(path)
        return spark.read.parquet(path)

    def received() -> DataFrame:
        return judged(uploads, stored).withColumn("accepted", F.col("error_code").isNull())

    good, logs, ended = F.col("error").isNull(), [], []

    def split(name: str, rows: DataFrame) -> DataFrame:
        bad = rows.where(~good)
        logs.append(persistence.failure_logs(bad, name, F.col("error.code"), F.col("error.detail")))
        ended.append(bad.select("document_id", F.lit("FAILED").alias("status")))
        return rows.where(good)

    arrived = stage(UPLOAD, received)
    going = arrived.where("accepted").drop("accepted", "error_code", "error_message", "duplicate_of")
    tables = {"rejected": arrived.where("not accepted").select("document_id", "file_hash", "error_code", "error_message", "duplicate_of")}
    logs.append(upload_logs(going))
    if last >= STAGES.index(TEXT):
        accepted = going
        going = split(TEXT, stage(TEXT, lambda: extract(accepted, texts)))
        logs.append(text_logs(going))
    if last >= STAGES.index(AI):
        with_text = going
        going = split(AI, stage(AI, lambda: structure(with_text, answer, s)))
        logs.append(ai_logs(going))
        tables["extractions"] = going.hint("shuffle_hash").join(with_text.select("document_id", "text"), "document_id").select("document_id", "text", "source_type", "raw_extraction_json", "model", "prompt_version")
    if last >= STAGES.index(VALIDATION):
        tables |= process(going.withColumn("ocr_confidence", F.col("mean_confidence")), s, stored_vendors, f"{root}/{VALIDATION.lower()}")
        logs.append(tables["processing_logs"])
        ended.append(tables["status"])
    else:
        ended.append(going.select("document_id", F.lit({UPLOAD: "UPLOADED", TEXT: "OCR_COMPLETED", AI: "AI_PROCESSING"}[end]).alias("status")))
    return tables | {"processing_logs": _union(logs), "status": _union(ended)}


def _union(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p)
    return first
