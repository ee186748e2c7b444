"""Exports through Spark's writers, whose commit protocol replaces temporary files and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.memory import chat_rows, dataset_rows, export_due


def write_jsonl(state: DataFrame, path: str) -> None:
    dataset_rows(state).write.mode("overwrite").text(path)


def write_chat(state: DataFrame, path: str, system: str) -> None:
    chat_rows(state, system).select("value").write.mode("overwrite").text(path)


def export_if_due(state: DataFrame, path: str, last: int, every: int) -> int:
    """Write the data set if the memory passed another multiple; returns the mark for the next call."""
    total = state.count()
    due = state.sparkSession.range(1).select(export_due(F.lit(total), F.lit(last), every)).first()[0]
    if due:
        write_jsonl(state, path)
    return total if due else last


def write_documents(documents: DataFrame, path: str, key: str = "doc_id", text: str = "markdown") -> None:
    """Rendered documents as JSON lines with their ids; files are dealt out by id."""
    documents.select(F.to_json(F.struct(F.col(key), F.col(text).alias("text"))).alias("value")).write.mode("overwrite").text(path)


def report_json(report: DataFrame, key: str = "doc_id") -> DataFrame:
    return report.select(key, F.to_json(F.struct(*[c for c in report.columns if c != key])).alias("report"))
