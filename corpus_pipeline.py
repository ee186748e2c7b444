"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm.langid import UND, fit, predicted
from parchmill.llm.mixing import mix_copies
from parchmill.llm.ngram_join import one_of_each
from parchmill.llm.packing import pack
from parchmill.llm.quality import kept, ledger
from parchmill.llm.storage import boxed, materialise, ref
from parchmill.llm.tokens import default_vocabulary

#: Least share of letters in the predicted language.
LANGUAGE_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which half the letters at least are in one learned language.

    Null, empty and letterless texts go, and all texts where no language can be learned (an empty
    table stays empty).  Rows are judged by their text alone: repeats stay or go together,
    whatever ids, nulls and names the other columns have; very long texts are read whole.
    """
    judged = boxed(docs, found=predicted(ref("text").cast("string"), fit(docs)))
    known = judged.where((F.col("found")["lang_pred"] != UND) & (F.col("found")["score"] >= LANGUAGE_SHARE))
    return known.select("__pm_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the current policy.

    Null and empty texts fail for too few words.  Rows are judged by their text alone, so
    repeats stay or go together; other columns may be null or have any name; very long texts are
    measured whole; an empty table stays empty.
    """
    return ledger(boxed(docs, text=ref("text"))).where(kept(F.col("failed_bits"))).select("__pm_row.*")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: that with the smallest id, null ids last.

    Of repeated rows one stays; rows that share an id but not their text are judged apart; texts
    without words, null or empty, are in no group and stay.  Other columns may be null or
    have any name; very long texts are compared whole; an empty table stays empty.
    """
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it: not at all, once or twice.

    A null source is a source; texts without words count as size 0; repeated rows are documents
    of their own, and of rows equal in size and id any may be taken; null ids order first.
    Other columns may be null or have any name; an empty table stays empty.
    """
    mixed = mix_copies(boxed(docs, doc_id=ref("doc_id"), text=ref("text"), source=ref("source"))).where("mix_copies > 0")
    return mixed.select("__pm_row", F.explode(F.expr("sequence(1, mix_copies)"))).select("__pm_row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences.

    Null and empty texts are the end id alone; repeated rows are packed each; null ids stay null;
    very long texts are cut into pieces; other columns are left out; an empty table stays empty.
    """
    return pack(docs, default_vocabulary())


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the learned language model nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
