"""Markdown to typed blocks, and blocks back to documents.

Block structure is a grammar over lines; one regular expression of alternatives is
scanned over a text in an Arrow UDF (backreferences and look-aheads over many lines
have no Catalyst form).  All that follows works on rows (doc_id, idx, type, text).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, is_blank, lines, strip
from ..workers import small_batches

TRANSLATABLE = ("heading", "paragraph", "table")
BLOCK_ARRAY = T.ArrayType(T.StructType().add("type", "string").add("text", "string"))
#: Headings of a bibliography.
REFERENCES = rf"(?iU)\A#{{1,6}}{SPACE}*(?:[0-9]+\.?{SPACE}*)?(references|bibliography|список литературы|литература|cited works|works cited){SPACE}*\z"
HTML_TAGS = "div|table|tr|td|th|img|figure|p|span|br|hr"

_IN = r"[^\S\n]*"  # white space within a line
_REST = r"[^\n]*(?:\n|\Z)"
_FENCE, _MATH, _ENV = rf"{_IN}(?:```|~~~)", rf"{_IN}\$\$", rf"{_IN}\\begin\{{[a-zA-Z*]+\}}"
_HEADING, _IMAGE, _ROW = r"\#{1,6}[^\S\n]", rf"{_IN}!\[[^\]\n]*\]\([^)\n]*\){_IN}$", rf"{_IN}\|"
_TEXT = rf"(?!{_FENCE}|{_MATH}|{_ENV}|{_HEADING}|{_IMAGE}|{_ROW}){_IN}[^\s]{_REST}"
_GRAMMAR = rf"""
    (?P<code>{_IN}(?P<fence>```|~~~){_REST}(?:(?!{_IN}(?P=fence)){_REST})*?{_IN}(?P=fence){_REST})
  | (?P<math>{_MATH}(?:[^\n]*?\$\$[^\n]*(?:\n|\Z)|[^\n]*\n(?:(?![^\n]*\$\$){_REST})*?[^\n]*\$\${_REST}))
  | (?P<env>{_IN}\\begin\{{(?P<name>[a-zA-Z*]+)\}}(?:[^\n]*\n)*?[^\n]*?\\end\{{(?P=name)\}}{_REST})
  | (?P<open>(?:{_FENCE}|{_MATH}|{_ENV})(?s:.*))
  | (?P<heading>{_HEADING}{_REST})
  | (?P<image>{_IMAGE}(?:\n|\Z))
  | (?P<table>(?:{_ROW}{_REST})+)
  | (?P<html>{_IN}</?(?i:{HTML_TAGS})\b{_REST})
  | (?P<paragraph>(?:{_TEXT})+)
  | (?P<blank>{_IN}(?:\n|\Z))
"""
_BLOCK = re.compile(_GRAMMAR, re.M | re.X)
_PARAGRAPH = re.compile(rf"(?:{_TEXT})+", re.M)
_TYPES = {"env": "math", "open": "paragraph"}


def parse_blocks(markdown: str | None) -> list[dict[str, str]]:
    """Typed blocks of a text.  A construct that is never closed is a paragraph to the end of the text."""
    text = "\n".join((markdown or "").splitlines())
    out: list[dict[str, str]] = []
    at, after_table = 0, False
    while at < len(text):
        found = _BLOCK.match(text, at)
        kind = found.lastgroup if found else "blank"
        for group in ("code", "math", "env", "open", "heading", "image", "table", "html", "paragraph", "blank"):
            if found and found.group(group) is not None:
                kind = group
                break
        if kind == "html" and after_table:  # a tag right below a table begins a paragraph
            kind, found = "paragraph", _PARAGRAPH.match(text, at)
        end = found.end() if found else at + 1
        if kind != "blank":
            out.append({"type": _TYPES.get(kind, kind), "text": text[at:end].rstrip("\n")})
        after_table = kind == "table"
        at = end if end > at else at + 1
    return out


@F.pandas_udf(BLOCK_ARRAY)
def _parse(texts: pd.Series) -> pd.Series:
    return texts.map(parse_blocks)


def split_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, idx, type, text, translatable); null and blank texts have none."""
    small_batches(docs.sparkSession)
    blocks = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_parse(F.col(text_col))).alias("idx", "block"))
    return blocks.select("doc_id", "idx", "block.type", "block.text", F.col("block.type").isin(*TRANSLATABLE).alias("translatable"))


def mark_references(blocks: DataFrame) -> DataFrame:
    """``blocks`` plus ``skipped``: translatable blocks of a bibliography, which end with any heading.

    The last heading's verdict is carried forward in one window over a document.
    """
    verdict = F.when(F.col("type") == "heading", strip(F.col("text")).rlike(REFERENCES))
    so_far = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.last(verdict, ignorenulls=True).over(so_far), F.lit(False))
    skipped = inside & F.col("translatable") & (F.col("type") != "heading")
    return blocks.withColumn("skipped", skipped).withColumn("translatable", F.col("translatable") & ~F.col("skipped"))


def assemble(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, markdown): texts that aren't blank in order, an empty line between them, a line end at last."""
    kept = F.expr(f"listagg({text}, '\\n\\n') within group (order by {order})")
    return rows.where(~is_blank(F.col(text))).groupBy(key).agg(F.concat(kept, F.lit("\n")).alias("markdown"))


def quote_lines(text: Column) -> Column:
    return F.array_join(F.transform(lines(text), lambda x: F.concat(F.lit("> "), x)), "\n")


def bilingual(rows: DataFrame, key: str, order: str, source: str, translation: str, kind: str | None = None) -> DataFrame:
    """(key, markdown): each translated source quoted before its translation, other sources as they are."""
    translated = F.coalesce(F.col(translation), F.lit("")) != ""
    if kind:
        translated = translated & (F.col(kind) == "translate")
    parts = F.when(translated, F.array(quote_lines(F.col(source)), F.col(translation))).otherwise(F.array(F.col(source)))
    both = rows.select(key, F.col(order).alias("__o"), F.posexplode(parts).alias("__p", "__t")).withColumn("__o", F.col("__o") * 2 + F.col("__p"))
    return assemble(both, key, "__o", "__t")
