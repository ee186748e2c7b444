"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once a document; the ledger holds its measurements and the bits
of the rules it fails.  Policies are versioned masks over those bits, applied without
reading texts again, and ablations come from bitwise counts over the ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import small_batches
from .mixing import WORD
from .storage import boxed, others, ref, unboxed

#: White space between words, characters counted as symbols.
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5

#: Rules by bit: a name and the condition under which a document fails, on the ledger's measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 20 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
    ("exclamations", "100 * n_exclamations > 50 * n_words"),
)
#: The bits that fail a document under any policy.
BASE = 0b11
#: Versions of the policy: the rules that reject.
POLICIES: dict[str, int] = {"1": 0b0001111, "2": 0b1111111}
CURRENT = "2"


def measurements(text: Column) -> list[tuple[str, Column]]:
    """Steps of named columns; each may use those before it.  Null text counts as empty."""
    hashes = F.transform(F.filter(F.split(text, SPACE + "+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    words = F.col("__pm_words")
    last = F.size(words) - WINDOW
    windows = F.when(
        last >= 0,
        F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("k"), i.alias("p")))),
    )
    sorted_windows = F.col("__pm_windows")
    twice = F.filter(sorted_windows, lambda w, j: F.coalesce(F.get(sorted_windows, j - 1)["k"] == w["k"], F.lit(False)) | F.coalesce(F.get(sorted_windows, j + 1)["k"] == w["k"], F.lit(False)))
    places = F.array_sort(F.transform(twice, lambda w: w["p"]))
    at = F.col("__pm_places")
    covered = F.aggregate(F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1), p + WINDOW) - p)), F.lit(0).cast("long"), lambda a, x: a + x)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return [
        ("__pm_words", hashes),
        ("__pm_windows", windows),
        ("__pm_places", places),
        ("__pm_lines", lines),
        ("n_words", F.size(words).cast("long")),
        ("word_chars", (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long")),
        ("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long")),
        ("n_lines", F.size("__pm_lines").cast("long")),
        ("n_dup_lines", (F.size("__pm_lines") - F.size(F.array_distinct("__pm_lines"))).cast("long")),
        ("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")),
        ("n_capitals", F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")),
        ("n_exclamations", F.regexp_count(text, F.lit("!")).cast("long")),
    ]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_exclamations")


def ledger(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` plus its measurements and ``failed_bits`` (bit k: rule k of RULES failed), which replace columns of those names.

    Null and empty texts have no words, 0 in every measure and fail ``few_words``; very long
    texts are measured whole.  Rows are judged one by one, so ties and repeats get
    equal answers, and an empty table gives an empty table.  A ``prefix`` goes before the
    added names, where the columns of ``docs`` must stay.
    """
    small_batches(docs.sparkSession)
    # names of this module would shadow columns of docs, so these are carried in one struct
    out = boxed(docs, __pm_text=F.coalesce(ref(text_col).cast("string"), F.lit("")))
    for name, value in measurements(F.col("__pm_text")):
        out = out.withColumn(name, value)
    bits = sum((F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, rule) in enumerate(RULES)), F.lit(0).cast("long"))
    out = out.withColumn("failed_bits", bits)
    added = [*MEASURES, "failed_bits"]
    # a filter on the ledger must not be pushed into the measures, which would evaluate them
    # anew inside each other; it isn't pushed through a generator
    measured = out.select("__pm_row", F.inline(F.array(F.struct(*[F.col(m) for m in added]))))
    return measured.select(*unboxed(docs, others(docs, [prefix + m for m in added])), *[F.col(m).alias(prefix + m) for m in added])


def kept(bits: Column, policy: str = CURRENT) -> Column:
    """Whether a document passes a policy: no base rule and none of the policy's rules failed."""
    return bits.bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0


def ablations(marked: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger -> for each rule of a policy: rejected, rejected by it alone, kept without it.

    The ledger is first counted by its bits (at most 2 ** rules rows), so no text and no
    document is read again.
    """
    mask = POLICIES[policy] | BASE
    counts = marked.select(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).groupBy("bits").count()
    rules = [k for k in range(len(RULES)) if mask >> k & 1]
    rows = counts.select("bits", "count", F.explode(F.array(*[F.lit(k) for k in rules])).alias("rule"))
    own = F.expr("shiftleft(1L, rule)")
    name = F.element_at(F.array(*[F.lit(n) for n, _ in RULES]), F.col("rule") + 1)
    return rows.groupBy("rule").agg(
        F.first(name).alias("name"),
        F.sum(F.when(F.col("bits").bitwiseAND(own) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == own, F.col("count")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(own)) == 0, F.col("count")).otherwise(0)).alias("n_kept_without"),
    )
