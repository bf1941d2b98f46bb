"""Text extraction results: saved OCR annotations to tokens and text, and the digital-or-OCR route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MAX_OCR_PAGES
from ..functions.text import strip
from ..schemas import ANNOTATION, TOKEN


def route(mime_type: Column, has_text: Column) -> Column:
    """digital_pdf for a PDF with a text layer, else ocr; the type must match exactly."""
    return F.when((mime_type == "application/pdf") & F.coalesce(has_text, F.lit(False)), "digital_pdf").otherwise("ocr")


def response_error(status: Column, responses: Column) -> Column:
    """Message for a response that can't be used, null for a good one. ``responses``: array with an error.message each."""
    first = F.get(responses, F.lit(0))
    return F.when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.coalesce(F.size(responses), F.lit(0)) <= 0, "empty response").otherwise(first["error"]["message"])


def _word(w: Column, page: Column) -> Column:
    xy = lambda f: F.transform(F.coalesce(w["boundingBox"]["vertices"], F.array().cast("array<struct<x:double,y:double>>")), lambda v: F.coalesce(v[f], F.lit(0.0)))
    edge = lambda pick, f: F.coalesce(pick(xy(f)), F.lit(0.0))
    text = F.array_join(F.transform(F.coalesce(w["symbols"], F.array().cast("array<struct<text:string>>")), lambda s: F.coalesce(s["text"], F.lit(""))), "")
    return F.struct(
        text.alias("text"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence"), edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"), page.cast("int").alias("page")
    )


def _all(outer: Column, f) -> Column:
    return F.flatten(F.filter(F.transform(outer, f), lambda a: a.isNotNull()))


def tokens(annotations: Column) -> Column:
    """Array of word tokens of an array of annotations; the page is the annotation's index. Empty words are dropped."""
    annotations = F.slice(annotations, 1, MAX_OCR_PAGES)

    def of(a: Column, page: Column) -> Column:
        words = _all(a["pages"], lambda p: _all(p["blocks"], lambda b: _all(b["paragraphs"], lambda g: g["words"])))
        return F.coalesce(F.transform(words, lambda w: _word(w, page)), F.array().cast(f"array<{TOKEN}>"))

    return F.filter(F.flatten(F.transform(annotations, of)), lambda t: t["text"] != "")


def page_text(annotations: Column) -> Column:
    """Stripped non-empty texts of the pages, an empty line between."""
    texts = F.transform(F.slice(annotations, 1, MAX_OCR_PAGES), lambda a: strip(F.coalesce(a["text"], F.lit(""))))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def ocr_results(df: DataFrame, column: str = "annotations") -> DataFrame:
    """Adds text, tokens, page_count and mean_confidence (0.0 without tokens) from an array of annotations.

    A JSON text column is parsed first.
    """
    if dict(df.dtypes)[column] == "string":
        df = df.withColumn(column, F.from_json(column, f"array<{ANNOTATION}>"))
    out = df.withColumn("tokens", tokens(F.col(column))).withColumn("text", page_text(F.col(column))).withColumn("page_count", F.size(F.slice(column, 1, MAX_OCR_PAGES)))
    total = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["confidence"])
    return out.withColumn("mean_confidence", F.when(F.size("tokens") > 0, total / F.size("tokens")).otherwise(0.0)).withColumn("source_type", F.lit("ocr"))
