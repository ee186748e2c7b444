"""Lenient JSON as models return it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: The widest object and array in a text, and a fence around it.
OBJECT, ARRAY = r"(?s)(\{.*\})", r"(?s)(\[.*\])"
FENCE = r"\A```[a-z]*\n?|\n?```\z"


def object_variant(raw: Column) -> Column:
    """The object in a text, as a variant: the whole text, else its widest braces; null unless an object."""
    text = strip(raw)
    bare = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(text, FENCE, "")).otherwise(text)
    whole = F.try_parse_json(bare)
    inner = F.try_parse_json(F.nullif(F.regexp_extract(bare, OBJECT, 1), F.lit("")))
    # a whole text that is JSON but no object isn't searched any further
    parsed = F.when(whole.isNotNull(), whole).otherwise(inner)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def score(raw: Column) -> Column:
    """The number under "score" in the widest braces, else null."""
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(raw, OBJECT, 1), F.lit("")))
    return F.try_variant_get(parsed, "$.score", "double")


def terms(raw: Column, limit: int = 25) -> Column:
    """Of the first items of the widest brackets, those with a term and a translation, stripped."""
    items = F.from_json(F.nullif(F.regexp_extract(raw, ARRAY, 1), F.lit("")), "array<struct<term:string,translation:string>>")
    given = F.filter(F.slice(items, 1, limit), lambda x: (x["term"] != "") & (x["translation"] != ""))
    return F.coalesce(F.transform(given, lambda x: F.struct(strip(x["term"]).alias("term"), strip(x["translation"]).alias("translation"))), F.array().cast("array<struct<term:string,translation:string>>"))
