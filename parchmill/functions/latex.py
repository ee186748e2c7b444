"""Syntax checks of LaTeX formulas, without TeX."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, is_blank, occurrences, strip

#: Formulas of a document, and environment names.
FORMULAS = r"(?s)(\$\$(.+?)\$\$|(?<!\$)\$(?!\s)([^$\n]+?)(?<!\s)\$(?!\$)|\\begin\{([a-zA-Z*]+)\}(.*?)\\end\{\4\})"
BEGIN, END = r"\\begin\{([a-zA-Z*]+)\}", r"\\end\{([a-zA-Z*]+)\}"
#: Issues reported for a document at most.
REPORTED = 20


def brace_state(formula: Column) -> Column:
    """struct(depth, negative): open braces at the end, and closings without an opening.

    Escaped pairs are dropped first, then only braces are left, which a fold runs over.
    """
    bare = F.regexp_replace(F.regexp_replace(formula, r"(?s)\\.", ""), r"[^{}]", "")
    braces = F.filter(F.split(bare, ""), lambda c: c != "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("negative"))
    return F.aggregate(
        braces,
        start,
        lambda s, c: F.when(c == "{", F.struct((s["depth"] + 1).alias("depth"), s["negative"].alias("negative")))
        .when(s["depth"] > 0, F.struct((s["depth"] - 1).alias("depth"), s["negative"].alias("negative")))
        .otherwise(F.struct(F.lit(0).alias("depth"), (s["negative"] + 1).alias("negative"))),
    )


def _listed(names: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))


def formula_problems(formula: Column) -> Column:
    """What is wrong with a formula's body, in a fixed order; an empty array if nothing."""
    state = brace_state(formula)
    begins, ends = (F.regexp_extract_all(formula, F.lit(p), F.lit(1)) for p in (BEGIN, END))
    # an odd run of backslashes at the end leaves the last one without a character
    trailing = F.length(F.regexp_extract(formula, r"(\\*)\z", 1)) % 2 == 1
    found = F.concat(
        F.array_repeat(F.lit("a closing brace without an opening one"), state["negative"]),
        F.when(state["depth"] > 0, F.array(F.concat(F.lit("braces left open: "), state["depth"].cast("string")))).otherwise(F.array().cast("array<string>")),
        F.when(trailing, F.array(F.lit("a backslash at the end"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.array_sort(begins).eqNullSafe(F.array_sort(ends)), F.array(F.concat(F.lit("environments begin as "), _listed(begins), F.lit(" and end as "), _listed(ends)))).otherwise(F.array().cast("array<string>")),
        F.when(is_blank(formula), F.array(F.lit("nothing in the formula"))).otherwise(F.array().cast("array<string>")),
    )
    return found


def formula_bodies(markdown: Column) -> Column:
    """Bodies of a document's formulas in order."""
    whole = F.regexp_extract_all(markdown, F.lit(FORMULAS), F.lit(1))
    return F.transform(
        whole,
        lambda f: F.when(F.startswith(f, F.lit("$$")), F.substr(f, F.lit(3), F.length(f) - 4))
        .when(F.startswith(f, F.lit("$")), F.substr(f, F.lit(2), F.length(f) - 2))
        .otherwise(F.regexp_replace(f, r"(?s)\A\\begin\{[a-zA-Z*]+\}|\\end\{[a-zA-Z*]+\}\z", "")),
    )


def document_issues(markdown: Column) -> Column:
    """Issues of a document as array of struct(code, message): broken formulas, then odd delimiters."""
    judged = F.transform(formula_bodies(markdown), lambda b: F.struct(b.alias("body"), formula_problems(b).alias("problems")))
    broken = F.slice(F.filter(judged, lambda x: F.size(x["problems"]) > 0), 1, REPORTED)
    snippet = lambda b: F.substring(F.replace(strip(b), F.lit("\n"), F.lit(" ")), 1, 80)
    formulas = F.transform(broken, lambda x: F.struct(F.lit("latex_syntax").alias("code"), F.concat(F.lit("in "), snippet(x["body"]), F.lit(": "), F.array_join(x["problems"], "; ")).alias("message")))
    odd = F.when(occurrences(markdown, "$$") % 2 == 1, F.array(F.struct(F.lit("latex_delimiters").alias("code"), F.lit("a $$ in the document has no partner").alias("message")))).otherwise(F.array().cast("array<struct<code:string,message:string>>"))
    return F.concat(formulas, odd)


__all__ = ["SPACE", "brace_state", "document_issues", "formula_bodies", "formula_problems"]
