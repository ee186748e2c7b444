"""Documents in, translated documents and a memory out."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmill.engine import Engine
from parchmill.operators.models import transliterate
from tests.test_documents import PAPER


def model(prompt):
    return F.replace(transliterate(prompt), F.lit("⟦пх"), F.lit("⟦PH"))


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([(1, PAPER), (2, "Last paragraph.\n\n## References\n\n[1] A. Author."), (3, None)], "doc_id long, text string")
    engine = Engine(spark, str(tmp_path), model=model, budget=10)
    rows = engine.translate(docs, "one").collect()
    assert {r["doc_id"] for r in rows} == {1, 2}
    assert sum(r["attempts"] for r in rows) == len({r["source_text"] for r in rows if r["kind"] == "translate"})
    text = {r["doc_id"]: r["markdown"] for r in engine.documents("one").collect()}
    assert "$x$" in text[1] and "E = mc^2" in text[1] and "0.92" in text[1] and 'print("$notmath$")' in text[1] and "[1] A. Author." in text[2]
    assert engine.report("one").agg(F.sum("segments_failed")).first()[0] == 0 and engine.tm_stats()["segments"] > 0
    again = engine.translate(docs, "two").collect()
    assert sum(r["attempts"] for r in again) == 0 and {r["doc_id"]: r["markdown"] for r in engine.documents("two").collect()} == text
    engine.add_correction("Last paragraph.", "Последний абзац")
    engine.add_correction("loss function", "функция потерь")
    assert engine.tm_stats()["human_corrections"] == 2 and [r["term"] for r in engine.terms().collect()] == ["loss function"]
    third = engine.translate(docs.where("doc_id = 2"), "three")
    assert [r["translation"] for r in third.where("kind = 'translate'").orderBy("seg_no").limit(1).collect()] == ["Последний абзац"]
    fix = spark.createDataFrame([(2, 0, "Иначе.")], "doc_id long, seg_no int, corrected string")
    assert engine.documents("three", fix).first()["markdown"].startswith("Иначе.")
    assert "> Last paragraph." in engine.bilingual("three").first()["markdown"]
    assert [(r["job_id"], r["status"]) for r in engine.jobs().collect()] == [("three", "completed"), ("two", "completed"), ("one", "completed")]
