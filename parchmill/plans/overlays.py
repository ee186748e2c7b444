"""Deterministic overlays that give structural operators something to work on, in Spark and in SQL.

The test tables have plain prose, so Markdown structure, damaged encodings, translation
pairs, a translation log and a job log are derived from them by row numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.models import CYRILLIC, LATIN

FENCE = "```"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _heading(line: Column) -> Column:
    return F.concat(F.lit("## "), F.left(line, F.lit(60)))


def docs_md(spark: SparkSession, sf_dir: str, text: Column | str = "text", heading: Callable[[Column], Column] = _heading, paragraph: Callable[[Column], Column] = lambda line: line) -> DataFrame:
    """(doc_id, lang, text): documents with headings, bibliographies, tables, formulas, code and links by line number.

    ``heading`` and ``paragraph`` say how a line is written as one.
    """

    def item(line, i):
        plain = F.replace(line, F.lit("$"), F.lit(""))
        number = i.cast("string")
        return (
            F.when(i % 17 == 9, F.lit("## References"))
            .when(i % 7 == 0, heading(plain))
            .when(i % 11 == 3, F.concat(F.lit("| a | b |\n|---|---|\n| "), F.length(line).cast("string"), F.lit(" | "), number, F.lit(" |")))
            .when(i % 19 == 11, F.lit("$$\ny_i = 1\n$$"))
            .when(i % 23 == 15, F.concat(F.lit(f"{FENCE}\ncode "), number, F.lit(f"\n{FENCE}")))
            .when(i % 13 == 5, paragraph(F.concat(plain, F.lit(" $x_i$ ["), number, F.lit("] see https://ex.org/"), F.col("doc_id").cast("string"))))
            .otherwise(paragraph(plain))
        )

    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.array_join(F.transform(F.split(text, "\n"), item), "\n\n").alias("text"))


ITEMS_SQL = """
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
    items AS (SELECT doc_id, i, CASE
        WHEN i % 17 = 9 THEN '## References'
        WHEN i % 7 = 0 THEN '## ' || left(replace(ln, '$', ''), 60)
        WHEN i % 11 = 3 THEN '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || length(ln) || ' | ' || i || ' |'
        WHEN i % 19 = 11 THEN '$$' || chr(10) || 'y_i = 1' || chr(10) || '$$'
        WHEN i % 23 = 15 THEN '```' || chr(10) || 'code ' || i || chr(10) || '```'
        WHEN i % 13 = 5 THEN replace(ln, '$', '') || ' $x_i$ [' || i || '] see https://ex.org/' || doc_id
        ELSE replace(ln, '$', '') END AS item FROM ln),
    blocks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS idx, item AS text,
        CASE WHEN starts_with(item, '```') THEN 'code' WHEN starts_with(item, '$$') THEN 'math' WHEN regexp_matches(item, '^#{1,6}\\s') THEN 'heading'
             WHEN regexp_matches(item, '^\\s*\\|') THEN 'table' WHEN regexp_matches(item, '(?i)^\\s*</?(div|table|tr|td|th|img|figure|p|span|br|hr)\\b') THEN 'html' ELSE 'paragraph' END AS type
        FROM items WHERE regexp_matches(item, '\\S')),
    marked AS (SELECT *, type IN ('heading', 'paragraph', 'table') AND NOT skipped AS translatable FROM (SELECT *,
        type IN ('paragraph', 'table') AND coalesce(last_value(CASE WHEN type = 'heading' THEN regexp_matches(trim(text), '(?i)^#{1,6}\\s*(?:\\d+\\.?\\s*)?(references|bibliography|список литературы|литература|cited works|works cited)\\s*$') END IGNORE NULLS)
            OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipped FROM blocks))
"""


def docs_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, text): private-use letters, mojibake, filler and Cyrillic by the last digit of the id."""
    docs = _read(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 10
    text = (
        F.when(kind == 0, F.translate("text", "aeiou", ""))
        .when(kind == 1, F.replace(F.col("text"), F.lit("e"), F.lit("Ð°")))
        .when(kind == 2, F.repeat(F.lit("·"), F.col("n_chars").cast("int")))
        .when(kind == 3, F.translate(F.lower("text"), LATIN, CYRILLIC))
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", "lang", text.alias("text"))


BAD_SQL = f"""
    bad AS (SELECT doc_id, lang, CASE doc_id % 10
        WHEN 0 THEN translate(text, 'aeiou', chr(57345) || chr(57346) || chr(57347) || chr(57348) || chr(57349))
        WHEN 1 THEN replace(text, 'e', chr(208) || chr(176))
        WHEN 2 THEN repeat(chr(183), n_chars)
        WHEN 3 THEN translate(lower(text), '{LATIN}', '{CYRILLIC}')
        ELSE text END AS text FROM documents)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, seg_no, kind, source_text, translation): lines and translations of several faults by line number."""
    docs = _read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "source_text"))
    cyrillic = F.translate(F.lower("source_text"), LATIN, CYRILLIC)
    translation = F.when(F.col("seg_no") % 5 == 0, F.col("source_text")).when(F.col("seg_no") % 5 == 1, F.left(cyrillic, F.floor(F.length("source_text") / 5).cast("int"))).when(F.col("seg_no") % 5 == 2, F.lit("")).otherwise(cyrillic)
    return rows.withColumn("kind", F.lit("translate")).withColumn("translation", translation)


PAIRS_SQL = f"""
    pr AS (SELECT doc_id, seg_no, src, t, CASE seg_no % 5 WHEN 0 THEN src WHEN 1 THEN left(t, length(src) // 5) WHEN 2 THEN '' ELSE t END AS tr FROM (
        SELECT *, translate(lower(src), '{LATIN}', '{CYRILLIC}') AS t FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS src, unnest(range(len(string_split(text, chr(10)))))::INT AS seg_no FROM documents)))
"""


def tm_log(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """The translation log: user turns with the assistant's answer.

    With ``repeats``, each is logged a second time, and each fifth a third time, as whole copies with
    later numbers and answers of their own.
    """
    turns = _read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = turns.withColumn("next_role", F.lead("role").over(w)).withColumn("target", F.lead("text").over(w))
    rows = following.where("role = 'user' and next_role = 'assistant'")
    number = F.col("conv_id") * 100 + F.col("turn")
    log = rows.select(
        number.alias("tm_id"),
        F.col("text").alias("source"),
        "target",
        F.lit("en").alias("src_lang"),
        F.lit("ru").alias("tgt_lang"),
        F.when(F.col("conv_id") % 5 == 0, "human").otherwise("auto").alias("origin"),
    )
    if repeats:
        times = F.when(F.col("tm_id") % 5 == 0, 3).otherwise(2)
        copies = log.withColumn("copy", F.explode(F.sequence(F.lit(0), times - 1)))
        answer = F.when(F.col("copy") == 0, F.col("target")).otherwise(F.concat("target", F.lit(" "), F.col("copy").cast("string")))
        log = copies.withColumn("target", answer).withColumn("tm_id", F.col("tm_id") + 1_000_000_000 * F.col("copy")).withColumn("origin", F.when(F.col("tm_id") % 7 == 0, "human").otherwise(F.col("origin"))).drop("copy")
    return log.withColumn("created_at", F.col("tm_id").cast("double"))


TM_SQL = """
    tm AS (SELECT conv_id * 100 + turn AS tm_id, text AS source, target, CASE WHEN conv_id % 5 = 0 THEN 'human' ELSE 'auto' END AS origin FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS target FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'),
    rp AS (SELECT tm_id + 1000000000 * c AS tm_id, source, CASE WHEN c = 0 THEN target ELSE target || ' ' || c END AS target, CASE WHEN (tm_id + 1000000000 * c) % 7 = 0 THEN 'human' ELSE origin END AS origin
        FROM tm, (SELECT unnest([0, 1, 2]) AS c) WHERE c < 2 OR tm_id % 5 = 0)
"""


def tm_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, memory) from the embeddings: all rows, with those whose id is divisible by 100 as queries with their own domain."""
    rows = _read(spark, sf_dir, "embeddings")
    domain = F.when(F.col("label") < 3, "").otherwise(F.concat(F.lit("d"), F.col("label").cast("string")))
    memory = rows.select(F.col("vec_id").alias("tm_id"), "embedding", domain.alias("domain"), F.when(F.col("vec_id") % 10 == 0, "human").otherwise("auto").alias("origin"))
    return rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", domain.alias("domain")), memory


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, event_id, at, outcome, retry_after, event_type): events as a service's log, times in microseconds."""
    events = _read(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("long").alias("owner"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "purchase", "success").otherwise("other").alias("outcome"),
        F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("retry_after"),
        "event_type",
    )


JOBS_SQL = """
    jl AS (SELECT user_id::BIGINT AS owner, event_id, epoch_us(ts) AS ts_us, CASE event_type WHEN 'error' THEN 'refused' WHEN 'purchase' THEN 'success' ELSE 'other' END AS outcome,
           (props->>'$.k')::BIGINT AS retry_after, event_type FROM events),
    jn AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts_us, event_id) AS n FROM jl)
"""


def pages_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, html): list items as table rows."""
    html = F.replace(F.replace(F.col("html"), F.lit("<li>"), F.lit("<tr><td>")), F.lit("</li>"), F.lit("</td></tr>"))
    return _read(spark, sf_dir, "pages").select("page_id", html.alias("html"))


PAGES_SQL = "pt AS (SELECT page_id, replace(replace(html, '<li>', '<tr><td>'), '</li>', '</td></tr>') AS html FROM pages)"
