"""HTML tables inside Markdown to Markdown tables, with nested regular expressions in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import join_words

#: A run of rows with or without its table, a row, a cell, other tags.
REGION = r"(?is)((?:<table[^>]*>\s*)?(?:<t(?:head|body)[^>]*>\s*)?(?:<tr[^>]*>.*?</tr>\s*)+(?:</t(?:head|body)>\s*)?(?:</table>)?)"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
TAG = r"</?[a-zA-Z][^<>]*>"


def cell_text(html: Column) -> Column:
    return F.replace(join_words(F.regexp_replace(html, TAG, " ")), F.lit("|"), F.lit(r"\|"))


def table_rows(html: Column) -> Column:
    """Rows of cell texts; rows without cells are left out."""
    rows = F.regexp_extract_all(html, F.lit(ROW), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), cell_text))
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_markdown(html: Column) -> Column:
    """A region as a Markdown table: ragged rows padded, the first row as head; null without cells."""

    def render(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, lambda r: F.size(r)))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
        return F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r))), "\n")

    # the rows are bound once, as the element of an array of one
    return F.get(F.transform(F.array(table_rows(html)), lambda rows: F.when(F.size(rows) > 0, render(rows))), 0)


def convert_tables(text: Column) -> Column:
    """Every region replaced by its table between empty lines; regions without cells stay."""

    def splice(between: Column, regions: Column) -> Column:
        put = F.transform(regions, lambda r: F.coalesce(F.concat(F.lit("\n\n"), table_markdown(r), F.lit("\n\n")), r))
        return F.array_join(F.zip_with(between, put, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), "")

    has = F.contains(F.lower(text), F.lit("<tr"))
    return F.when(has, splice(F.split(text, REGION, -1), F.regexp_extract_all(text, F.lit(REGION), F.lit(1)))).otherwise(text)
