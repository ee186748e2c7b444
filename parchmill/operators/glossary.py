"""Glossary: upserts, listing, and matching terms in texts.

A term in a text begins and ends at a word boundary.  Texts and terms don't meet in a join, in which a
common first word would gather all texts: an Aho-Corasick automaton of all terms goes to every task, and each text is
streamed through it once, whatever the number of terms, overlapping occurrences included.  A glossary over
``AUTOMATON_CHARACTERS`` is cut into automata of that size, which pass over the texts one after another.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..workers import small_batches

#: Word characters of Python's \w, alone and with the hyphen.
WORD = r"\p{L}\p{N}_"
KEY = ["term", "src_lang", "tgt_lang"]
#: Characters of the terms, and terms, that one automaton holds.
AUTOMATON_CHARACTERS, AUTOMATON_TERMS = 1 << 25, 1 << 20


def upsert(log: DataFrame, order: str = "seq") -> DataFrame:
    """The last entry of each term and language pair, in the place of its first."""
    return log.groupBy(*KEY).agg(F.min(order).alias(order), F.max_by(F.struct("translation", "notes"), order).alias("v")).select(*KEY, order, "v.*")


def listed(entries: DataFrame, src_lang: str | None = None, tgt_lang: str | None = None) -> DataFrame:
    """All entries, or those of a pair where both languages are given; by term."""
    rows = entries.where((F.col("src_lang") == src_lang) & (F.col("tgt_lang") == tgt_lang)) if src_lang and tgt_lang else entries
    return rows.orderBy("term")


def delete(entries: DataFrame, removed: DataFrame) -> DataFrame:
    return entries.join(removed.select(*KEY), KEY, "left_anti")


def read_csv_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """CSV records (_c0, _c1, ...) -> (term, translation, notes) and columns to keep; comments and short records are left out."""
    notes = F.col("_c2") if "_c2" in lines.columns else F.lit(None).cast("string")
    good = lines.where(F.col("_c0").isNotNull() & F.col("_c1").isNotNull() & ~F.startswith(strip(F.col("_c0")), F.lit("#")))
    return good.select(*keep, strip(F.col("_c0")).alias("term"), strip(F.col("_c1")).alias("translation"), F.nullif(strip(F.coalesce(notes, F.lit(""))), F.lit("")).alias("notes"))


def bounded(term: Column, text: Column, edge: str) -> Column:
    """Whether the term is in the text with none of ``edge`` next to it."""
    return F.rlike(text, F.concat(F.lit(f"(?<![{edge}])\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(f"\\E(?![{edge}])")))


class _Word(dict):
    """Whether a character is one of ``WORD``."""

    def __missing__(self, c: str) -> bool:
        self[c] = found = c == "_" or unicodedata.category(c)[0] in "LN"
        return found


_word = _Word()
_automata: dict[str, tuple[ahocorasick.Automaton, list[int]]] = {}


def _automaton(name: str, terms: list[str]) -> tuple[ahocorasick.Automaton, list[int]]:
    """The worker's automaton of a group of terms, built when first used, and the places of empty terms."""
    if name not in _automata:
        _automata.clear()  # one group is held at a time
        found: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            found.setdefault(term, []).append(k)
        automaton = ahocorasick.Automaton()
        for term, places in found.items():
            if term:
                automaton.add_word(term, (len(term), places))
        automaton.make_automaton()
        _automata[name] = automaton, found.get("", [])
    return _automata[name]


def _apart(c: str) -> bool:
    """Neither a word character nor a hyphen; the ends of a text are apart too."""
    return not c or (c != "-" and not _word[c])


def _alone(text: str, start: int, end: int) -> bool:
    return _apart(text[start - 1 : start]) and _apart(text[end : end + 1])


def _at_boundaries(text: str, start: int, end: int) -> bool:
    """A regular expression's word boundary at both ends."""
    inside = lambda c: bool(c) and _word[c]
    return inside(text[start - 1 : start]) != inside(text[start]) and inside(text[end - 1]) != inside(text[end : end + 1])


def occurring(texts: DataFrame, entries: DataFrame, test: Callable[[str, int, int], bool], limit: int | None = None) -> DataFrame:
    """(text_id, text) x (seq, term, translation) -> (text_id, rank, seq, term, translation): terms with an occurrence that passes ``test``, by seq.

    Terms and texts are compared in lower case.  Entries of a group come to the driver, which a group's size bounds; of a
    text's terms only the first ``limit`` of each group leave a task.  Null texts and empty terms find nothing.
    """
    small_batches(texts.sparkSession)
    rows = entries.select("seq", "term", "translation", F.lower("term").alias("low")).where("low != ''")
    size = rows.agg(F.coalesce(F.sum(F.length("low")), F.lit(0)).alias("characters"), F.count("*").alias("many")).first()
    groups = max(1, -(-size["characters"] // AUTOMATON_CHARACTERS), -(-size["many"] // AUTOMATON_TERMS))
    fields = [texts.schema["text_id"], T.StructField("rank", T.IntegerType()), *[rows.schema[c] for c in ("seq", "term", "translation")]]
    asked = texts.select("text_id", F.lower("text").alias("low")).where("low is not null")
    out = None
    for g in range(groups):
        own = rows if groups == 1 else rows.where(F.pmod(F.xxhash64("seq", "term"), F.lit(groups)) == g)
        table = own.orderBy("seq", "term").toArrow().combine_chunks()
        found = asked.mapInArrow(_search(table, test, limit), T.StructType(fields))
        out = found if out is None else out.unionByName(found)
    if groups == 1:
        return out
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy("seq", "term"))
    ranked = out.withColumn("rank", rank)
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def _search(table: pa.Table, test: Callable[[str, int, int], bool], limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    name, kept, terms = uuid.uuid4().hex, table.select(["seq", "term", "translation"]), table.column("low").to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = _automaton(name, terms)
        for batch in batches:
            texts, ranks, places = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist() if len(automaton) else ()):
                hits: set[int] = set()
                for last, (length, own) in automaton.iter(text):
                    if own[0] not in hits and test(text, last + 1 - length, last + 1):
                        hits.update(own)
                first = sorted(hits)[:limit]
                texts += [row] * len(first)
                ranks += range(1, len(first) + 1)
                places += first
            if texts:
                entries = kept.take(pa.array(places, pa.int64())).combine_chunks()
                columns = [entries.column(c).chunk(0) if entries.column(c).num_chunks else pa.array([], entries.column(c).type) for c in kept.column_names]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(texts, pa.int64())), pa.array(ranks, pa.int32()), *columns], ["text_id", "rank", *kept.column_names])

    return run


def match(texts: DataFrame, entries: DataFrame, limit: int = 30) -> DataFrame:
    """(text_id, text) x (seq, term, translation) -> (text_id, rank, seq, term, translation): the first terms in glossary order."""
    return occurring(texts, entries, _alone, limit)


def match_document_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    r"""Terms of a document in its segments: regular-expression word boundaries, any case; blank terms are skipped.

    A boundary lies between a word character and another, so a term that begins with
    another character needs a word character before it.
    """
    entries = terms.withColumn("term", strip(F.col("term"))).where("term != ''")
    return occurring(texts, entries, _at_boundaries).drop("rank")


def merge_terms(hits: DataFrame) -> DataFrame:
    """(text_id, source_rank, seq, term, translation): one entry for each lower-case term, the document's before the stored one."""
    order = Window.partitionBy("text_id", F.lower("term")).orderBy("source_rank", "seq")
    return hits.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
