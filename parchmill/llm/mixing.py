"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import small_batches
from .storage import materialise, others, ref, unboxed

#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows aimed at in a group that is ranked in one task.
ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes by weight; none gets above ``most`` times its size, and the
    excess is shared anew by weight until none is above.  That ends at the level L for
    which the minima of L * weight and the limit sum to the total: in order of
    limit / weight, the sources at their limit come first.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.get(turn, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    # the level if exactly the sources before this one are at their limit
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") < F.col("limit"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level").alias("level")))).over(every)
    reached = levels.withColumn("reached", first["level"])
    return reached.select("source", "source_size", F.when(F.col("free"), F.col("reached") * F.col("weight")).otherwise(F.col("limit")).alias("target"))


SIZED = ("m_id", "m_source", "m_size")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **columns: Column) -> DataFrame:
    """Rows of ``docs`` -> (m_id, m_source, m_size), with other columns where asked for."""
    return docs.select(ref(id_col).cast("long").alias("m_id"), ref(source_col).cast("string").alias("m_source"), word_count(ref(text_col).cast("string")).alias("m_size"), *[v.alias(k) for k, v in columns.items()])


def draw(rows: DataFrame, counted: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """Sized rows plus ``m_source_size``, ``m_target`` and ``m_copies``; ``counted`` are the same rows, as cheap to read as may be.

    A source's order is by band of size, then salt, then size and id.  A band has as many salts
    as its rows need, so a task ranks about ``ROWS`` rows; sums of rows run over a source's
    bands (under a thousand) and over a band's salts.
    """
    size, source, key = F.col("m_size"), F.col("m_source"), F.col("m_id")
    digits = size.cast("string")
    # length and first two digits: increases with the size, exact in any engine
    band = (F.length(digits) * 100 + F.substring(digits, 1, 2).cast("int")).cast("int").alias("m_band")
    counted = counted.select(key, source, size, band)
    bands = counted.groupBy("m_source", "m_band").agg(F.count("*").alias("b_rows"), F.sum("m_size").alias("b_size"))
    by_band = Window.partitionBy("m_source").orderBy("m_band").rowsBetween(Window.unboundedPreceding, -1)
    targets = source_targets(bands.groupBy(F.col("m_source").alias("source")).agg(F.sum("b_size").alias("source_size")), weights, share, most)
    bands = bands.withColumn("b_before", F.coalesce(F.sum("b_rows").over(by_band), F.lit(0))).join(targets, F.col("m_source").eqNullSafe(F.col("source")))
    bands = bands.select(F.col("m_source").alias("b_source"), F.col("m_band").alias("b_band"), "b_before", F.ceil(F.col("b_rows") / F.lit(ROWS)).cast("int").alias("b_salts"), F.col("source_size").alias("m_source_size"), F.col("target").alias("m_target"))
    in_band = lambda df: df.join(bands, df["m_source"].eqNullSafe(F.col("b_source")) & (df["m_band"] == F.col("b_band"))).withColumn("m_salt", salt)
    salt = F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long"), F.col("b_salts")).cast("int")
    by_salt = Window.partitionBy("s_source", "s_band").orderBy("s_salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = in_band(counted).groupBy(F.col("m_source").alias("s_source"), F.col("m_band").alias("s_band"), F.col("m_salt").alias("s_salt")).agg(F.count("*").alias("s_rows"))
    salts = salts.withColumn("s_before", F.coalesce(F.sum("s_rows").over(by_salt), F.lit(0))).drop("s_rows")
    within = Window.partitionBy("m_source", "m_band", "m_salt").orderBy("m_size", "m_id")
    ranked = in_band(rows.select("*", band)).withColumn("m_rank", F.row_number().over(within))
    joined = ranked.join(salts, F.col("m_source").eqNullSafe(F.col("s_source")) & (F.col("m_band") == F.col("s_band")) & (F.col("m_salt") == F.col("s_salt")))
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("")), source.isNull().cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    expected = F.when(F.col("m_source_size") > 0, F.col("m_target") / F.col("m_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(expected)
    part = expected - whole
    at = F.col("b_before") + F.col("s_before") + F.col("m_rank")
    copies = whole + F.floor(at * part + offset) - F.floor((at - 1) * part + offset)
    return joined.select(*rows.columns, "m_source_size", "m_target", copies.cast("long").alias("m_copies"))


ADDED = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """``docs`` plus ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``, which replace columns of those names.

    A document's expected copies are its source's target over its source's size.  Within
    a source, documents are put in order of size (bands of like size, dealt over as
    many salts as the band's rows need, each in size and id order), expected copies are
    summed along that order from one offset that the seed and the source fix, and a
    document is taken once for each integer crossed.  Neighbours are of like size, so
    the words taken come near the target.  A rerun gives the same copies.

    Null, empty and wordless texts have size 0; they are taken like others, but add
    no words.  A null source is a source.  A source of size 0 is not taken.  Repeated
    rows are documents of their own; of rows equal in size and id any may be taken; null
    ids order first; very long texts are counted whole; an empty table gives an empty
    table.  Words are counted once for the sums and once for the rows themselves.
    """
    small_batches(docs.sparkSession)
    counted = materialise(sized(docs, id_col, text_col, source_col), "sizes")
    row = F.struct(*[ref(c) for c in docs.columns])
    drawn = draw(sized(docs, id_col, text_col, source_col, __pm_row=row), counted, weights, share, most, seed)
    return drawn.select(*unboxed(docs, others(docs, ADDED)), *[F.col("m_" + a.removeprefix("mix_")).alias(a) for a in ADDED])
