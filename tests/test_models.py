"""Loops around a client that counts its calls: as many calls as attempts, and none for segments that need none."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parchmill.engine import Engine
from parchmill.operators import context, models, validation
from parchmill.streaming import streams
from tests.test_documents import FOX, LIS, PAPER, prepared

SOURCE = "The value $x$ is shown in the figure number %d below."
GOOD = "Значение ⟦PH%d⟧ показано на рисунке номер %d ниже, да."


class Client:
    """Writes a line for each call; answers well from the n-th call about a text on, null and errors by name."""

    def __init__(self, path: str, answers):
        self.path, self.answers = path, answers

    def chat(self, prompt: str) -> str | None:
        with open(self.path, "a") as file:
            file.write(prompt.replace("\n", " ") + "\n")
        return self.answers(prompt)


def calls(path) -> int:
    return len(path.read_text().splitlines()) if path.exists() else 0


def model_of(path, answers):
    return models.from_client(lambda: Client(str(path), answers))


def number(prompt: str) -> tuple[int, int]:
    k = int(prompt.split("number ")[1].split(" ")[0])
    return int(prompt.split("⟦PH")[1].split("⟧")[0]), k


@pytest.mark.parametrize("repairs", [0, 2, 4])
def test_good_segments_are_asked_once(spark, tmp_path, repairs):
    log = tmp_path / "calls"
    rows = prepared(spark, *[SOURCE % k for k in range(10)])
    done = models.translate(rows, model_of(log, lambda p: GOOD % number(p)), "en", "ru", repairs=repairs).collect()
    assert [r["attempts"] for r in done] == [1] * 10 and calls(log) == 10


def test_failing_segments_are_asked_again(spark, tmp_path):
    log = tmp_path / "calls"

    def answers(prompt):
        ph, k = number(prompt)
        again = prompt.startswith("- ")
        lost = f"Значение показано на рисунке номер {k} ниже, да, вот и всё {prompt.count('вот')}."
        return GOOD % (ph, k) if k % 2 == 0 or (k % 4 == 1 and again) else lost

    rows = prepared(spark, *[SOURCE % k for k in range(8)])
    done = {r["seg_no"]: r for r in models.translate(rows, model_of(log, answers), "en", "ru", repairs=2).collect()}
    assert [done[k]["attempts"] for k in range(8)] == [1, 2, 1, 3, 1, 2, 1, 3]
    assert calls(log) == sum(r["attempts"] for r in done.values())
    assert all(("placeholder_missing" in [i["code"] for i in done[k]["issues"]]) == (k % 4 == 3) for k in done)


def test_chain_asks_the_next_client_only_after_a_failure(spark, tmp_path):
    first, second = tmp_path / "first", tmp_path / "second"

    def fails(prompt):
        if "3" in prompt:
            raise TimeoutError
        return None if "4" in prompt else "one"

    model = models.from_client(lambda: Client(str(first), fails), lambda: Client(str(second), lambda p: "two"))
    rows = spark.createDataFrame([(k, f"text {k}") for k in range(10)] + [(10, None)], "k int, t string")
    got = [a for _, a in sorted(map(tuple, rows.select("k", model(F.col("t")).alias("a")).collect()))]  # a sort in Spark would sample, and ask twice
    assert got == ["two" if k in (3, 4) else "one" for k in range(10)] + [None]
    assert (calls(first), calls(second)) == (10, 2)


def test_rescue_and_retranslation_ask_flagged_segments_only(spark, tmp_path):
    rows = prepared(spark, *[SOURCE % k for k in range(6)])
    done = models.translate(rows, lambda p: F.when(F.col("seg_no") < 4, F.regexp_replace(F.regexp_replace(p, "The value", "Значение"), "is shown in the figure number", "показано на рисунке номер")).otherwise(F.lit("Значение показано на рисунке номер, да.")), "en", "ru", repairs=0)
    log = tmp_path / "rescue"
    saved = {r["seg_no"]: r for r in models.rescue(done, model_of(log, lambda p: f"Значение $x$ показано на рисунке номер {p.split('number ')[1][0]} ниже."), "en", "ru").collect()}
    assert calls(log) == 2 and [saved[k]["attempts"] for k in range(6)] == [1, 1, 1, 1, 2, 2]
    assert [[i["code"] for i in saved[k]["issues"]] for k in (4, 5)] == [["unmasked_rescue"]] * 2
    log = tmp_path / "again"
    left = models.translate(prepared(spark, FOX.strip(), LIS.strip()), lambda p: p, "en", "ru", repairs=0)
    again = {r["seg_no"]: r for r in models.retranslate_residual(left, model_of(log, lambda p: LIS.strip()), "en", "ru").collect()}
    assert calls(log) == 1 and [again[k]["translation"] for k in (0, 1)] == [LIS.strip()] * 2


def test_embedder(spark, tmp_path):
    class Shaky:
        tries = 0

        def embed(self, rows):
            Shaky.tries += 1
            return [[float(len(x))] for x in rows][: -1 if Shaky.tries % 3 else None]

    rows = spark.createDataFrame([("a",), ("bcd",), (None,)], "t string").coalesce(1)
    assert [r["v"] for r in rows.select(models.from_embedder(Shaky, 3, 0.0)("t").alias("v")).collect()] == [[1.0], [3.0], [0.0]]


def test_engine_resumes_pauses_and_reviews(spark, tmp_path):
    docs = spark.createDataFrame([(1, PAPER)], "doc_id long, text string")
    log = tmp_path / "calls"
    answer = lambda p: p.replace("⟦PH", "⟦PH")

    def make(fail: bool):
        return Engine(spark, str(tmp_path / "engine"), "en", "en", model=model_of(log, answer), budget=10, repairs=0)

    asked = []
    engine = make(False)
    paused = engine.translate(docs, "job", batches=3, should_pause=lambda: asked.append(1) or len(asked) == 2)
    counts, first = engine.pending("job"), calls(log)
    assert counts["pending"] > 0 and engine.jobs().first()["status"] == "paused" and 0 < first
    assert "paused" in {i["code"] for r in paused.collect() for i in r["issues"]}
    rows = engine.translate(docs, "job", batches=3).collect()
    texts = {r["source_text"] for r in rows if r["kind"] == "translate"}
    assert calls(log) == len(texts) and engine.pending("job")["pending"] == 0  # nothing is asked twice
    codes = [i["code"] for r in rows for i in r["issues"]]
    assert codes.count("resumed") == first and engine.jobs().first()["status"] == "completed"
    assert engine._rows("checkpoint/job", "k string").count() == 0
    reviewed = Engine(spark, str(tmp_path / "reviewed"), "en", "en", model=lambda p: p, budget=10).translate(docs, "r", review=lambda p: F.lit('{"ok": true}'), judge=lambda p: F.lit('{"score": 50}')).collect()
    assert all({"reviewed_ok", "low_quality_score"} <= {i["code"] for i in r["issues"]} for r in reviewed if r["kind"] == "translate" and r["attempts"])


def test_engine_prompts(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), "en", "ru")
    engine.add_term("loss function", "функция потерь")
    engine.add_term("gradient", "градиент")
    rows = spark.createDataFrame([(1, 0, "translate", "The loss function here."), (1, 1, "translate", "Nothing.")], "doc_id long, seg_no int, kind string, source_text string")
    found = context.document_context(spark.createDataFrame([(1, "x y")], "doc_id long, text string"), lambda p: F.when(F.startswith(p, F.lit("Say")), "About x.").otherwise('[{"term": "x", "translation": "икс"}]'), "en", "ru")
    examples = rows.where("seg_no = 1").select("doc_id", "seg_no", F.array(F.struct(F.lit("a").alias("source"), F.lit("b").alias("target"))).alias("examples"))
    got = [r["system"] for r in engine.prompts(rows, found, examples).orderBy("seg_no").collect()]
    assert "- x -> икс\n- loss function -> функция потерь" in got[0] and "gradient" not in got[0] and "About x." in got[0]
    assert "loss function" not in got[1] and "SOURCE: a\nTRANSLATION: b" in got[1]


def test_figures_described(spark):
    found = spark.createDataFrame([(1, 1, 4, "a", "p.png"), (1, 2, 6, "b", "q.png")], "doc_id long, number int, idx int, alt string, path string")
    images = spark.createDataFrame([("p.png", b"x")], "path string, content binary")
    got = context.described(found, images, lambda p: F.upper(p)).orderBy("idx").collect()
    assert [r["description"] for r in got] == ["DESCRIBE THE FIGURE 'A'.", None]


def test_snapshot():
    now, reads = [0.0], []
    held = streams.Snapshot(lambda: reads.append(now[0]) or len(reads), 300, lambda: now[0])
    assert (held.get(), held.get()) == (1, 1)
    now[0] = 299.9
    assert held.get() == 1
    now[0] = 300.0
    assert held.get() == 2
    held.invalidate()
    assert held.get() == 3


def test_watchdog_tells_open_stalls(spark, tmp_path):
    """A key that falls silent is told when another key's rows move the watermark on."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    batches = [[(1, at(0)), (2, at(0))], [(2, at(50)), (1, at(5))], [(2, at(300))], [(2, at(310))]]
    for rows in batches:
        spark.createDataFrame(rows, "owner long, t string").select("owner", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("owner long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, streams.ROCKSDB)
    streams.drain(streams.watchdog(stream, 60), f"{tmp_path}/out", f"{tmp_path}/state")
    spark.conf.set(name, before)
    got = sorted((r["owner"], r["stalled_at"] % 1_000_000_000 // 1000 - 1704067200 % 1_000_000, r["resumed"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 5, False), (2, 50, True)]


def test_codes_are_known():
    assert {"paused", "resumed", "tm_exact", "dedup", "unmasked_rescue"} <= set(validation.OTHER_CODES)
