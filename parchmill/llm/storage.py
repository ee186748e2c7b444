"""Shared tables, and frames whose columns may have any names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch, materialise, remove, shared_dir

__all__ = ["Scratch", "boxed", "materialise", "others", "ref", "remove", "shared_dir", "unboxed"]


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(docs: DataFrame, added: list[str]) -> list[str]:
    """The columns of ``docs`` that none of the added ones replaces; names are compared as Spark does, without case."""
    new = {a.lower() for a in added}
    return [c for c in docs.columns if c.lower() not in new]


def boxed(docs: DataFrame, box: str = "__pm_row", **columns: Column) -> DataFrame:
    """All columns of ``docs`` in one struct, and new columns beside it, so that no name can clash."""
    row = F.struct(*[ref(c) for c in docs.columns]) if docs.columns else F.struct(F.lit(None).alias("none"))
    return docs.select(row.alias(box), *[value.alias(name) for name, value in columns.items()])


def unboxed(docs: DataFrame, names: list[str], box: str = "__pm_row") -> list[Column]:
    return [F.col(box)[n].alias(n) for n in names]
