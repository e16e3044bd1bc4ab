"""Texts of project documents, cut into chunks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seams.config import DOCUMENT_SUFFIXES
from seams.functions.text import TEXT_LEAST, chunks, classify_document, clean_text, html_text, markdown_text
from seams.sources.source_tree import read_files

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """Paragraphs outside tables, then table cells, joined by spaces."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    parts = [said(p) for p in body.findall(f"{_W}p")]
    parts += [said(c) for t in body.findall(f"{_W}tbl") for c in t.iter(f"{_W}tc")]
    return " ".join(parts)


def pdf_text(raw: bytes) -> str:
    """By pdfminer where it is installed, else empty."""
    try:
        from pdfminer.high_level import extract_text
    except ImportError:
        return ""
    return extract_text(io.BytesIO(raw)) or ""


def extract(files: DataFrame) -> DataFrame:
    """files (path, name, bytes) -> (source_file, name, raw, error); a file that cannot be read has an error and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name, raw in zip(*(c.to_pylist() for c in batch.columns)):
                suffix, text, error = "." + name.rsplit(".", 1)[-1].lower(), None, None
                try:
                    text = docx_text(raw) if suffix == ".docx" else pdf_text(raw) if suffix == ".pdf" else (raw or b"").decode("utf-8", "ignore")
                except Exception as e:  # noqa: BLE001  a broken document does not end the scan
                    error = f"{type(e).__name__}: {e}"
                rows.append({"source_file": path, "name": name, "raw": text, "error": error})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.string()) for c in ("source_file", "name", "raw", "error")]))

    texts = files.select("path", "name", "bytes").mapInArrow(run, "source_file string, name string, raw string, error string")
    suffix = F.lower(F.substring_index("name", ".", -1))
    text = F.when(suffix == "md", markdown_text(F.col("raw"))).when(suffix.isin("html", "htm"), html_text(F.col("raw"))).otherwise(F.col("raw"))
    return texts.select("source_file", "name", text.alias("text"), "error")


def chunk_documents(texts: DataFrame) -> DataFrame:
    """texts (source_file, name, text) -> (source_file, chunk_no, text, doc_type); texts of under 50 characters have none."""
    own = texts.where(F.length(F.trim("text")) >= TEXT_LEAST)
    cut = own.select("source_file", classify_document(F.col("text"), F.col("name")).alias("doc_type"), F.explode(chunks(clean_text(F.col("text")))).alias("chunk"))
    return cut.select("source_file", F.col("chunk.chunk_no").alias("chunk_no"), F.col("chunk.text").alias("text"), "doc_type")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the documents in a folder (not below it), or of a file."""
    return chunk_documents(extract(read_files(spark, folder, DOCUMENT_SUFFIXES, recursive=False, binary=True)))
