"""Whole text files, and sections of the ontology document."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def basename(filename: str | None) -> str | None:
    """The last part of a path, None if there is none or it would leave its folder."""
    last = (filename or "").strip().replace("\\", "/").rstrip("/").rpartition("/")[2]
    return None if last in ("", ".", "..") else last


def read_text(spark: SparkSession, folder: str, filename: str | None) -> dict:
    """``{"name", "text"}`` of a file in ``folder``, or ``{"error"}``: directories in the name are dropped, only UTF-8 is read."""
    if not (filename or "").strip():
        return {"error": "a file name is needed"}
    name = basename(filename)
    if name is None:
        return {"error": f"{filename!r} names no file in the folder"}
    try:
        rows = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{name}").select("content").take(2)
    except AnalysisException:
        rows = []
    if len(rows) != 1:
        return {"error": f"no such file: {name}"}
    try:
        return {"name": name, "text": bytes(rows[0]["content"]).decode()}
    except UnicodeDecodeError as e:
        return {"error": f"{name} isn't UTF-8: {e}"}


def section(doc: DataFrame, name: str | None, text_col: str = "text") -> DataFrame:
    """``doc`` (one row a document) with its text cut to the first ``##`` section whose heading begins with ``name``, in any case.

    Without a name, or if no section has it, the whole text stays.
    """
    if not name:
        return doc
    blocks = F.split(F.col(text_col), "\n## ")
    found = F.filter(blocks, lambda b: F.startswith(F.lower(b), F.lit(name.lower())))
    return doc.withColumn(text_col, F.when(F.size(found) > 0, found[0]).otherwise(F.col(text_col)))
