"""Deterministic checks of translated segments, and reports over them; Catalyst only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SEGMENT_LANGUAGE_SCRIPT, heading_count, is_blank, length_scale, occurrences, residual_source_ratio, strip_placeholders, table_rows

#: Sources up to this length aren't checked for words left in the source language.
LONG_SOURCE = 200
ISSUE = "struct<code:string,severity:string,message:string>"
NO_ISSUES = f"array<{ISSUE}>"
#: Codes that other stages add, with their severity.
OTHER_CODES = {
    "placeholder_missing": "error", "placeholder_unknown": "error", "placeholder_residual": "error",
    "dedup": "info", "resumed": "info", "tm_exact": "info", "unmasked_rescue": "info",
    "reviewed_ok": "info", "reviewed_revised": "info", "review_rejected": "warning", "review_unparsed": "warning", "review_error": "warning",
    "low_quality_score": "warning", "backtranslation": "warning", "latex_syntax": "warning", "latex_delimiters": "warning", "katex_error": "warning",
    "paused": "info", "exception": "error",
}


def issue(when: Column, code: str, severity: str, message: Column | str) -> Column:
    said = F.lit(message) if isinstance(message, str) else message
    found = F.array(F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("message")))
    return F.when(F.coalesce(when, F.lit(False)), found).otherwise(F.array().cast(NO_ISSUES))


#: Measures of a pair of texts that the checks read; each is evaluated once.
MEASURES = ("blank", "ratio", "n_source", "residual", "headings_before", "headings_after", "rows_before", "rows_after", "columns_before", "columns_after", "dollars", "begins", "ends")


def pair_measures(source: Column, translation: Column, source_lang: str, target_lang: str, masked: Column | None = None) -> Column:
    """A struct of ``MEASURES``."""
    said = F.coalesce(translation, F.lit(""))
    base = F.coalesce(F.nullif(masked, F.lit("")), source) if masked is not None else source
    bars = lambda rows: F.coalesce(F.array_max(F.transform(rows, lambda r: F.length(r) - F.length(F.replace(r, F.lit("|"), F.lit(""))))), F.lit(0))
    before, after = table_rows(source), table_rows(said)
    values = (
        is_blank(said),
        F.length(said) / F.greatest(F.length(strip_placeholders(base)), F.lit(1)) * length_scale(source_lang, target_lang),
        F.length(source),
        F.when(F.length(source) > LONG_SOURCE, residual_source_ratio(said, source_lang, target_lang)).otherwise(F.lit(0.0)),
        heading_count(source), heading_count(said),
        F.size(before), F.size(after), bars(before), bars(after),
        occurrences(said, "$$"), occurrences(said, "\\begin{"), occurrences(said, "\\end{"),
    )
    return F.struct(*[v.alias(name) for name, v in zip(MEASURES, values)])


def issues_of(m: Column, source_lang: str, target_lang: str, shortest: float = 0.4, longest: float = 3.5, residual: float = 0.35) -> Column:
    """Issues from :func:`pair_measures` in a fixed order; a blank translation has no issue but that."""
    a, b = SEGMENT_LANGUAGE_SCRIPT.get(source_lang), SEGMENT_LANGUAGE_SCRIPT.get(target_lang)
    counts = lambda what, x, y: F.concat(F.lit(f"{what}: "), x.cast("string"), F.lit(" before, "), y.cast("string"), F.lit(" after"))
    found = F.concat(
        issue(m["ratio"] < shortest, "too_short", "error", F.format_string("length ratio %.2f is low: something may be left out", m["ratio"])),
        issue(m["ratio"] > longest, "too_long", "error", F.format_string("length ratio %.2f is high: something may be added or repeated", m["ratio"])),
        issue((m["n_source"] > LONG_SOURCE) & (m["residual"] > residual), "untranslated", "error", F.format_string("%.0f%% of the words have the source's script", m["residual"] * 100)) if a and b and a != b else F.array().cast(NO_ISSUES),
        issue(m["headings_before"] != m["headings_after"], "heading_mismatch", "warning", counts("headings", m["headings_before"], m["headings_after"])),
        issue((m["rows_before"] > 0) & (m["rows_before"] != m["rows_after"]), "table_rows", "error", counts("table rows", m["rows_before"], m["rows_after"])),
        issue((m["rows_before"] > 0) & (m["rows_before"] == m["rows_after"]) & (m["columns_before"] != m["columns_after"]), "table_cols", "warning", counts("table columns", m["columns_before"], m["columns_after"])),
        issue(m["dollars"] % 2 == 1, "math_delimiters", "warning", "a $$ has no partner"),
        issue(m["begins"] != m["ends"], "latex_env", "warning", counts("\\begin and \\end", m["begins"], m["ends"])),
    )
    return F.when(m["blank"], issue(F.lit(True), "empty_translation", "error", "nothing was translated")).otherwise(found)


def segment_issues(source: Column, translation: Column, source_lang: str, target_lang: str, masked: Column | None = None, shortest: float = 0.4, longest: float = 3.5, residual: float = 0.35) -> Column:
    """The issues as one expression: the measures pass through an array, so that each is evaluated once a row."""
    measured = F.array(pair_measures(source, translation, source_lang, target_lang, masked))
    return F.get(F.transform(measured, lambda m: issues_of(m, source_lang, target_lang, shortest, longest, residual)), 0)


def placeholder_residual(translation: Column) -> Column:
    """A placeholder that was left in a final text."""
    return issue(translation.rlike("⟦PH[0-9]+⟧"), "placeholder_residual", "error", "a placeholder is left in the text")


def has(issues: Column, *severities: str) -> Column:
    return F.exists(issues, lambda i: i["severity"].isin(*severities))


def is_ok(issues: Column) -> Column:
    return ~has(issues, "error")


def has_code(issues: Column, *codes: str) -> Column:
    return F.exists(issues, lambda i: i["code"].isin(*codes))


def final_text(kind: Column, source: Column, translation: Column, issues: Column, corrected: Column | None = None) -> Column:
    """What goes into the document: a correction, else a translation that kept its placeholders, else the source."""
    broken = F.exists(issues, lambda i: (i["severity"] == "error") & i["code"].isin("placeholder_missing", "placeholder_unknown"))
    given = F.when((kind == "translate") & (F.coalesce(translation, F.lit("")) != "") & ~F.coalesce(broken, F.lit(False)), translation).otherwise(source)
    return F.coalesce(F.nullif(corrected, F.lit("")), given) if corrected is not None else given


def segment_view(rows: DataFrame) -> DataFrame:
    """A segment as an interface shows it: no masks and no report, its final text, codes and whether it is fine."""
    final = final_text(F.col("kind"), F.col("source_text"), F.col("translation"), F.col("issues"))
    return rows.select("doc_id", "seg_no", "kind", "source_text", "translation", final.alias("final_text"), F.transform("issues", lambda i: i["code"]).alias("codes"), is_ok(F.col("issues")).alias("ok"), "attempts")


def needs_review(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("kind") == "translate") & has(F.col("issues"), "warning", "error"))


def learnable(rows: DataFrame, warned: DataFrame | None = None) -> DataFrame:
    """Segments worth remembering: translated, without errors, not from memory, not of a warned document."""
    good = rows.where((F.col("kind") == "translate") & (F.coalesce("translation", F.lit("")) != "") & is_ok(F.col("issues")) & ~has_code(F.col("issues"), "tm_exact"))
    return good.join(warned.select("doc_id").distinct(), "doc_id", "left_anti") if warned is not None else good


def document_report(rows: DataFrame, preview: int = 200) -> DataFrame:
    """Segments (doc_id, seg_no, kind, source_text, attempts, issues) -> one row a document."""
    done = F.col("kind") == "translate"
    failed = done & ~is_ok(F.col("issues"))
    some = done & (F.size("issues") > 0)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("segments_total"),
        F.count_if(done).alias("segments_translated"),
        F.count_if(failed).alias("segments_failed"),
        F.coalesce(F.sum(F.when(done, F.size(F.filter("issues", lambda i: i["severity"] == "warning")))), F.lit(0)).cast("long").alias("warnings"),
        F.coalesce(F.sum(F.when(done, F.col("attempts"))), F.lit(0)).cast("long").alias("attempts_total"),
        F.array_sort(F.collect_list(F.when(failed, F.struct("seg_no", F.left("source_text", F.lit(preview)).alias("source_preview"), "issues")))).alias("failed_segments"),
        F.array_sort(F.collect_list(F.when(some, F.struct("seg_no", "issues")))).alias("segment_issues"),
    )


def issue_histogram(rows: DataFrame) -> DataFrame:
    flat = rows.where("kind = 'translate'").select(F.explode("issues").alias("i"))
    return flat.groupBy("i.code", "i.severity").agg(F.count("*").alias("n"))


def coverage_warning(truncated: Column, done: Column, total: Column, lost: Column) -> Column:
    """What of a scanned document is missing, as one text; null if nothing."""
    parts = F.concat_ws(
        "; ",
        F.when(truncated, F.concat(F.lit("only the first "), done.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" pages"))),
        F.when(F.size(lost) > 0, F.concat(F.lit("lost pages "), F.array_join(lost.cast("array<string>"), ", "))),
    )
    return F.nullif(parts, F.lit(""))


def job_status(failed: Column, *problems: Column) -> Column:
    clean = failed == 0
    for problem in problems:
        clean = clean & F.coalesce(problem, F.lit("")).eqNullSafe("")
    return F.when(clean, "completed").otherwise("partial")


def score_summary(scores: DataFrame, group: list[str], score: str, threshold: float = 70) -> DataFrame:
    """Mean to one digit, least, how many below the threshold; groups without scores have no row."""
    known = scores.where(F.col(score).isNotNull())
    return known.groupBy(*group).agg(F.bround(F.avg(score), 1).alias("mean"), F.min(score).alias("min"), F.count_if(F.col(score) < threshold).alias("below_threshold"), F.count("*").alias("scored"))
