"""Documents from files: plain text, Markdown, Word and PDF, told apart by their endings."""

from __future__ import annotations

import importlib.util
import io
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources.markdown import markdown_text

FORMATS = ("txt", "md", "pdf", "docx")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(raw: bytes) -> str:
    """The paragraphs of the document part, one a line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in root.iter(f"{WORD}p"))


def pdf_text(raw: bytes) -> str:
    """The pages' texts, one after the other; needs the optional pdfplumber."""
    import pdfplumber

    with pdfplumber.open(io.BytesIO(raw)) as pdf:
        return "\n".join(filter(None, (page.extract_text() for page in pdf.pages)))


def _converted(format_: Column, content: Column) -> Column:
    """(text, error) of files that need Python; a file that can't be read has an error and no text."""

    def convert(kinds: pd.Series, raws: pd.Series) -> pd.DataFrame:
        rows = []
        for kind, raw in zip(kinds, raws, strict=True):
            try:
                rows.append((None, None) if raw is None else (markdown_text(bytes(raw).decode()) if kind == "md" else docx_text(bytes(raw)) if kind == "docx" else pdf_text(bytes(raw)), None))
            except Exception as e:
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["text", "error"])

    return F.pandas_udf(convert, "text string, error string")(format_, content)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, format, text, raw, error) of all files below ``path``.

    ``text`` is what spans count lines of; ``raw`` what the file held, where that is text.
    A format that isn't known, or PDF without its library, gives an error and no text; a
    path that doesn't exist raises as Spark's readers do. doc_id is a hash of the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"), "content")
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    python = F.col("format").isin("md", "docx", *(["pdf"] if importlib.util.find_spec("pdfplumber") else []))
    df = df.withColumn("_c", _converted(F.col("format"), F.when(python, F.col("content"))))
    error = F.when(F.col("format") == "txt", F.when(plain.isNull(), "not UTF-8")).when(python, F.col("_c.error")).when(F.col("format") == "pdf", "pdfplumber is needed for PDF").otherwise(F.concat(F.lit("unsupported format: "), "format"))
    text = F.when(F.col("format") == "txt", plain).when(python, F.col("_c.text"))
    return df.select(F.xxhash64("path").alias("doc_id"), "path", "format", text.alias("text"), F.when(F.col("format").isin("txt", "md"), plain).alias("raw"), error.alias("error"))
