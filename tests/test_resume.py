"""A job whose model was down is asked again; what a chat model is asked."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from parchmill.engine import Engine
from parchmill.operators import memory, models


class Recorder:
    """Writes a line for each call; fails while a file is there."""

    def __init__(self, log: str, down: str = "", poison: str = "\0"):
        self.log, self.down, self.poison = log, down, poison

    def chat(self, *parts: str) -> str:
        import os

        with open(self.log, "a") as file:
            file.write(json.dumps(parts) + "\n")
        if os.path.exists(self.down) or self.poison in parts[-1]:
            raise ConnectionError("the model is down")
        text = parts[-1].split("TEXT TO TRANSLATE:\n")[-1]
        table = str.maketrans(models.LATIN, models.CYRILLIC)
        return "".join(x if x.startswith("⟦") else x.lower().translate(table) for x in __import__("re").split(r"(⟦[^⟧]*⟧)", text))


def calls(log) -> list[list[str]]:
    return [json.loads(x) for x in log.read_text().splitlines()] if log.exists() else []


def test_failed_segments_are_asked_again(spark, tmp_path):
    log, down = tmp_path / "calls", tmp_path / "down"
    texts = [f"Sentence number {k} says something of its own." for k in range(6)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate([*texts, texts[0]])], "doc_id long, text string")
    down.touch()
    engine = Engine(spark, str(tmp_path / "engine"), model=models.from_client(lambda: Recorder(str(log), str(down)), errors=True), repairs=0)
    first = engine.translate(docs, "job").collect()
    assert len(first) == 7 and not any(r["translation"] for r in first)
    assert {i["code"] for r in first for i in r["issues"]} == {"exception"} and "ConnectionError" in first[0]["issues"][0]["message"]
    assert [r["status"] for r in engine.jobs().collect()] == ["partial"] and len(calls(log)) == 6
    assert engine.tm_stats()["segments"] == 0
    # half of them work now: the others are asked a third time, those that are good never again
    down.unlink()
    half = Engine(spark, str(tmp_path / "engine"), model=models.from_client(lambda: Recorder(str(log), poison="number 3"), errors=True), repairs=0)
    second = {r["doc_id"]: r for r in half.translate(docs, "job", batches=2).collect()}
    assert len(calls(log)) == 12 and [d for d, r in second.items() if not r["translation"]] == [3]
    third = {r["doc_id"]: r for r in engine.translate(docs, "job").collect()}
    assert len(calls(log)) == 13 and all(r["translation"] for r in third.values())
    assert {i["code"] for d in (1, 2, 4, 5) for i in third[d]["issues"]} <= {"tm_exact", "resumed"} and third[3]["attempts"] == 1
    assert engine.jobs().first()["status"] == "completed" and not (tmp_path / "engine/checkpoint/job").exists()


def test_paused_job_tells_failed_from_pending(spark, tmp_path):
    log = tmp_path / "calls"
    docs = spark.createDataFrame([(k, f"Sentence number {k} says something.") for k in range(12)], "doc_id long, text string")
    bad = Engine(spark, str(tmp_path / "engine"), model=models.from_client(lambda: Recorder(str(log), poison="Sentence"), errors=True), repairs=0)
    rows = bad.translate(docs, "job", batches=3, should_pause=lambda: True).collect()
    codes = [i["code"] for r in rows for i in r["issues"]]
    assert len(rows) == 12 and codes.count("exception") == len(calls(log)) and codes.count("paused") == 12 - len(calls(log)) > 0
    good = Engine(spark, str(tmp_path / "engine"), model=models.from_client(lambda: Recorder(str(log)), errors=True), repairs=0)
    before = len(calls(log))
    assert all(r["translation"] for r in good.translate(docs, "job").collect()) and len(calls(log)) == before + 12


def test_settled_checkpoint(spark):
    rows = [("a", 1, "x", True), ("a", 2, "y", False), ("b", 1, "p", False), ("b", 3, "q", False), ("c", 1, "u", True), ("c", 2, "v", True), ("d", 1, None, None)]
    best = memory.settled(spark.createDataFrame(rows, "k string, seq long, t string, good boolean"), F.col("good")).collect()
    assert {r["k"]: (r["t"], r["ok"]) for r in best} == {"a": ("x", True), "b": ("q", False), "c": ("v", True), "d": (None, False)}


def test_chat_model_gets_glossary_examples_terms_and_context(spark, tmp_path):
    log = tmp_path / "calls"
    engine = Engine(spark, str(tmp_path / "engine"), model=models.from_chat(lambda: Recorder(str(log))), budget=60, repairs=0)
    engine.add_correction("The loss function is minimised over many steps.", "Функция потерь минимизируется за много шагов.")
    engine.add_term("loss function", "функция потерь")
    engine.add_term("absent term", "нет")
    text = "The loss function is minimised over many steps\n\nA gradient of $x$ is taken there.\n\nThe loss function is minimised over many steps."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    describe = lambda p: F.when(F.startswith(p, F.lit("Say")), F.lit("About gradients.")).otherwise(F.lit('[{"term": "Gradient", "translation": "градиент"}, {"term": "Loss Function", "translation": "потери"}, {"term": "steppe", "translation": "степь"}]'))
    rows = {r["source_text"]: r for r in engine.translate(docs, "job", describe=describe, back=lambda t: F.lit("quite another thing")).collect()}
    asked = {user: system for system, user in calls(log)}
    first = next(s for u, s in asked.items() if "minimised" in u.split("TEXT TO TRANSLATE:\n")[-1])
    second = next(s for u, s in asked.items() if "gradient" in u.split("TEXT TO TRANSLATE:\n")[-1])
    assert len(asked) == 2 and "SOURCE: The loss function is minimised over many steps." in first and "Функция потерь" in first
    # the document's own entry wins over the stored one in any case; terms that the text lacks aren't listed
    assert "- Loss Function -> потери" in first and "функция потерь\n" not in first and "absent" not in first and "steppe" not in first
    assert "- Gradient -> градиент" in second and "SOURCE:" not in second and "About gradients." in second
    user = next(u for u in asked if "gradient" in u)
    assert user.startswith("The text before, for context only:\nThe loss function") and user.endswith("TEXT TO TRANSLATE:\nA gradient of ⟦PH0⟧ is taken there.")
    assert rows["The loss function is minimised over many steps."]["translation"].startswith("Функция") and "$x$" in rows["A gradient of $x$ is taken there."]["translation"]
    assert "backtranslation" in {i["code"] for i in rows["A gradient of $x$ is taken there."]["issues"]}
