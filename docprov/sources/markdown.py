"""Reading corpus files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from io import BytesIO
from xml.etree import ElementTree
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docprov.operators.frontmatter import parse_documents

TEXT_TYPES = ("txt", "md", "markdown", "json", "yaml", "yml")
SKIPPED = "AUTHORING.md"
FILE = "file_path string, extension string, raw string, error string"


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, raw) of the Markdown files below a folder; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file_path string, raw string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    return files.where(~F.col("path").endswith("/" + SKIPPED)).select(F.col("path").alias("file_path"), F.decode("content", "UTF-8").alias("raw"))


def corpora(spark: SparkSession, folder: str) -> DataFrame:
    return parse_documents(markdown_files(spark, folder))


def inline(spark: SparkSession, raw: str) -> DataFrame:
    return parse_documents(spark.createDataFrame([(raw,)], "raw string"))


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word file."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with ZipFile(BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))


def uploads(spark: SparkSession, folder: str, extractors: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """Files as text by their extension; PDF and other formats by the extractors given. What
    has none, or fails, keeps a null text and an error."""
    known = {"docx": docx_text, **(extractors or {})}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select(F.col("path").alias("file_path"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)\z", 1)).alias("extension"), "content")
    plain = files.where(F.col("extension").isin(*TEXT_TYPES)).select("file_path", "extension", F.decode("content", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("error"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, extension, content in zip(part["file_path"], part["extension"], part["content"], strict=True):
                try:
                    text, error = known[extension](content), None
                    error = None if text.strip() else "no text found"
                except KeyError:
                    text, error = None, f"unsupported type: {extension}"
                except Exception as e:  # a broken file is a row, not a failed job
                    text, error = None, f"{type(e).__name__}: {e}"
                rows.append((path, extension, text, error))
            yield pd.DataFrame(rows, columns=["file_path", "extension", "raw", "error"])

    return plain.unionByName(files.where(~F.col("extension").isin(*TEXT_TYPES)).mapInPandas(run, FILE))
