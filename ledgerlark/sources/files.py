"""Sources: raw files, catalogues, saved OCR annotations and model responses, and the two edges to outside services."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DIGITAL_PROBE_PAGES
from ..functions.text import fit_budget
from ..schemas import ANNOTATION, EXTRACTED, LLM_RESPONSE

#: Files whose contents and texts a task holds as Python objects at once.
FILES_AT_ONCE = 64
CATALOGUE = "sku string, description string, category string, unit_price double, embedding string"


class PageReader(Protocol):
    """Reads the text layer of a file: one text a page; raises for what it can't read."""

    def __call__(self, content: bytes) -> list[str]: ...


class Model(Protocol):
    """Structures a text: (raw JSON, model, finish reason, input tokens, output tokens); raises on failure."""

    def __call__(self, system: str, user: str) -> tuple[str, str, str, int, int]: ...


def raw_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content and the SHA-256 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.withColumn("file_hash", F.sha2("content", 256)).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def read_text_layers(files: DataFrame, make_reader: Callable[[], PageReader]) -> DataFrame:
    """path, text, page_count, digital, error: non-empty stripped pages with an empty line between.

    ``make_reader`` runs once a task, which reads ``FILES_AT_ONCE`` files and gives their texts on before the next. digital: any text in the first three pages. A file without text is an error, and
    one that can't be read as well; neither stops the job.
    """

    names = ["path", "text", "page_count", "digital", "error"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make_reader()
        for batch in batches:
            for lo in range(0, batch.num_rows, FILES_AT_ONCE):
                rows, few = [], batch.slice(lo, FILES_AT_ONCE)
                for path, content in zip(few.column("path"), few.column("content"), strict=True):
                    try:
                        pages = [(p or "").strip() for p in reader(bytes(content.as_py()))]
                        text = "\n\n".join(p for p in pages if p)
                        rows.append((path.as_py(), text, len(pages), any(pages[:DIGITAL_PROBE_PAGES]), None if text else "no text layer"))
                    except Exception as e:  # whatever a reader raises becomes the file's error
                        rows.append((path.as_py(), None, 0, False, str(e)[:500]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return files.select("path", "content").mapInArrow(run, "path string, text string, page_count int, digital boolean, error string")


def structure_texts(texts: DataFrame, make_model: Callable[[], Model], system: str) -> DataFrame:
    """document_id with the model's response for ``texts(document_id, prompt)``; a failed call becomes the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            rows = []
            for i, prompt in zip(pdf["document_id"], pdf["prompt"], strict=True):
                try:
                    rows.append((i, *model(system, prompt), None, None))
                except Exception as e:  # whatever a provider raises becomes the document's error
                    rows.append((i, None, None, None, None, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["document_id", "raw", "model", "finish_reason", "input_tokens", "output_tokens", "duration_ms", "error"])

    return texts.select("document_id", "prompt").mapInPandas(run, f"document_id string, {LLM_RESPONSE}")


def parse_extractions(responses: DataFrame, column: str = "raw") -> DataFrame:
    """The extracted record of each response's JSON, as bronze columns beside the rest."""
    return responses.withColumn("_x", F.from_json(column, EXTRACTED)).select("*", "_x.*").drop("_x")


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Saved OCR annotations, one JSON object a line: document_id and annotations."""
    return spark.read.schema(f"document_id string, annotations array<{ANNOTATION}>").json(path)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Product catalogue CSV with a header; the embedding is a JSON array."""
    rows = spark.read.schema(CATALOGUE).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("embedding", F.from_json("embedding", "array<float>"))


def prompts(texts: DataFrame, source_type: str = "source_type", chars: str | None = None) -> DataFrame:
    """Adds prompt and truncated to ``texts(text, source_type)``; with ``chars``, a column of the texts' lengths, truncated reads no text."""
    note = F.when(F.coalesce(source_type, F.lit("")) != "", F.concat(F.lit(" (extraction method: "), F.col(source_type), F.lit(")"))).otherwise("")
    fitted = texts.withColumn("_fit", fit_budget(F.col("text"), chars=None if chars is None else F.col(chars)))
    body = F.concat(F.lit("Extract structured invoice data from the following document text"), note, F.lit(".\n\n<document>\n"), F.col("_fit.text"), F.lit("\n</document>"))
    return fitted.withColumn("prompt", body).withColumn("truncated", F.col("_fit.truncated")).drop("_fit")


class Registry:
    """Named values, versioned prompts or providers; an unknown name is an error that lists the known ones."""

    def __init__(self, what: str, planned: tuple[str, ...] = ()):
        self.what, self.planned, self.known = what, planned, {}

    def add(self, name: str, value) -> None:
        self.known[name] = value

    def get(self, name: str):
        if name in self.known:
            return self.known[name]
        if name in self.planned:
            raise NotImplementedError(f"{self.what} '{name}' is planned, not available")
        raise KeyError(f"unknown {self.what} '{name}'; known: {sorted(self.known)}")
