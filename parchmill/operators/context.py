"""What surrounds a document's translation: summary, terms and figures by a model, images for prompts, the largest output file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semi import terms as parsed_terms
from ..functions.text import is_blank, strip
from .models import Model

#: Characters of a document that go into the prompts, and of an answer that are kept.
SUMMARY_PREFIX, TERMS_PREFIX, SUMMARY_KEPT = 6000, 8000, 1500
#: Terms and figures of a document at most.
TERMS, FIGURES = 25, 30
IMAGE_PIXELS = 1600


def summary_prompt(text: Column) -> Column:
    return F.concat(F.lit("Say in three sentences what this document is about:\n\n"), F.left(text, F.lit(SUMMARY_PREFIX)))


def terms_prompt(text: Column, source: str, target: str) -> Column:
    return F.concat(F.lit(f'List the technical terms as JSON [{{"term": ..., "translation": ...}}], {source} to {target}:\n\n'), F.left(text, F.lit(TERMS_PREFIX)))


def document_context(docs: DataFrame, model: Model, source: str, target: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, summary, terms): answers of the model, a bounded summary and the readable terms.

    Blank documents aren't sent and have neither.
    """
    asked = docs.where(~is_blank(F.col("text")))
    answered = asked.select("doc_id", model(summary_prompt(F.col("text"))).alias("s"), model(terms_prompt(F.col("text"), source, target)).alias("t"))
    summary = F.nullif(F.left(strip(F.coalesce("s", F.lit(""))), F.lit(SUMMARY_KEPT)), F.lit(""))
    found = answered.select("doc_id", summary.alias("summary"), parsed_terms(F.col("t"), TERMS).alias("terms"))
    return docs.select("doc_id").join(found, "doc_id", "left")


def figures(blocks: DataFrame, limit: int = FIGURES) -> DataFrame:
    """Image blocks (doc_id, idx, type, text) -> (doc_id, number, idx, alt, path): the first figures of each document."""
    image = r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)"
    found = blocks.where("type = 'image'").select("doc_id", "idx", F.regexp_extract("text", image, 1).alias("alt"), F.regexp_extract("text", image, 2).alias("path")).where("path != ''")
    listed = found.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("idx", "alt", "path"))), 1, limit).alias("f"))
    return listed.select("doc_id", F.posexplode("f").alias("n", "f")).select("doc_id", (F.col("n") + 1).alias("number"), "f.*")


def described(found: DataFrame, images: DataFrame, model: Model) -> DataFrame:
    """Figures with their image's bytes (path, content) -> ``description``; figures without an image aren't sent and have none."""
    met = found.join(images.select("path", "content"), "path", "left")
    asked = met.where("content is not null")
    prompt = F.concat(F.lit("Describe the figure '"), F.col("alt"), F.lit("'."))
    answers = asked.select("doc_id", "idx", F.nullif(strip(F.coalesce(model(prompt), F.lit(""))), F.lit("")).alias("description"))
    return met.drop("content").join(answers, ["doc_id", "idx"], "left")


def scaled_size(width: Column, height: Column, most: int = IMAGE_PIXELS) -> Column:
    """struct(width, height) of an image whose longer side may have ``most`` pixels; its proportions stay, no side falls under 1."""
    share = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height, F.lit(1)))
    side = lambda x: F.greatest(F.floor(x * share + 0.5), F.lit(1)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def largest_file(files: DataFrame, key: str = "folder") -> DataFrame:
    """(folder, path, bytes) -> the largest file of each folder, the first by path on ties."""
    most = files.groupBy(key).agg(F.max("bytes").alias("bytes"))
    return files.join(most, [key, "bytes"]).groupBy(key).agg(F.min("path").alias("path"), F.first("bytes").alias("bytes"))
