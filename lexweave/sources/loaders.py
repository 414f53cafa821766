"""Document files: plain text, PDF (with a parser given), DOCX; routed by extension."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Extensions and their loaders. Fixed values.
ROUTES = {"txt": "text", "pdf": "pdf", "docx": "docx"}


def route(uri: Column) -> Column:
    """The loader's name, or null for an unknown extension."""
    extension = F.lower(F.regexp_extract(uri, r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for e, name in ROUTES.items():
        out = F.when(extension == e, name).otherwise(out)
    return out


def title(uri: Column) -> Column:
    return F.regexp_replace(F.substring_index(uri, "/", -1), r"(?<=.)\.[^.]*$", "")


def docx_text(data: bytes) -> str:
    """S3: the body's paragraphs, joined by line ends; tables and headers don't count."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    read = lambda p: "".join((e.text or "") if e.tag == f"{_WORD}t" else signs.get(e.tag, "") for e in p.iter())
    return "\n".join(read(p) for p in (body if body is not None else []) if p.tag == f"{_WORD}p")


def load(spark: SparkSession, path: str | list[str], pdf_pages: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """uri, title, raw_text, error of every file: one row a file, errors as rows.

    Binary files are read by Spark, so any store it reads will do; a map over partitions.
    """
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), "content", route(F.col("path")).alias("kind"))

    def one(kind: str | None, data: bytes) -> str:
        if kind == "text":
            return data.decode("utf-8")
        if kind == "docx":
            return docx_text(data)
        if kind == "pdf":
            if pdf_pages is None:
                raise ValueError("no PDF parser was given")
            return "".join(pdf_pages(data))
        raise ValueError("unsupported file type")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, error = [], []
            for kind, data in zip(batch.column("kind").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    text.append(one(kind, data)), error.append(None)
                except Exception as e:  # a parser may raise anything; the file's row says so
                    text.append(None), error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("uri"), pa.array(text, pa.string()), pa.array(error, pa.string())], ["uri", "raw_text", "error"])

    return files.mapInArrow(run, "uri string, raw_text string, error string").select("uri", title(F.col("uri")).alias("title"), "raw_text", "error")
